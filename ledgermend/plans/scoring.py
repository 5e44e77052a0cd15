"""Customers in sessions of twelve as accounts of three sources, scored in all fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.operators import scoring
from ledgermend.plans.catalog import query, table

#: A customer's first three orders as sources; values are coarse, so that accounts of a session agree now and then.  Both engines read this.
SOURCES_SQL = """SELECT c_custkey, CAST(FLOOR(c_custkey / 12) AS BIGINT) AS session, c_mktsegment, n, CASE WHEN k % 5 = 0 THEN '' ELSE '***' || CAST(k % 60 AS STRING) END AS number, CAST(CASE WHEN k % 7 = 0 THEN NULL ELSE y END AS BIGINT) AS y,
CAST(CASE WHEN k % 9 = 0 THEN 0 ELSE FLOOR(p / 60000) * 6000000 END AS BIGINT) AS balance, CAST(CASE WHEN k % 4 = 0 THEN NULL ELSE FLOOR(p) * 100 END AS BIGINT) AS high, o_orderpriority AS kind, CASE WHEN k % 11 = 0 THEN NULL ELSE o_orderstatus END AS status
FROM (SELECT o_custkey, o_orderkey AS k, o_totalprice AS p, o_orderpriority, o_orderstatus, EXTRACT(YEAR FROM o_orderdate) AS y, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) o JOIN customer ON c_custkey = o_custkey WHERE n <= 3"""


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = SOURCES_SQL.replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}")
    rows = spark.sql(sql, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))
    listed = F.array_sort(F.collect_list(F.struct("n", "number", "y", "balance", "high", "kind", "status")))
    each = rows.groupBy("session", "c_custkey", "c_mktsegment").agg(listed.alias("s"))
    of = lambda name: F.transform("s", lambda x: x[name])
    status = F.array_compact(of("status"))
    late = lambda s: F.size(F.filter(status, lambda x: x == s))
    return each.select(
        "session", "c_custkey", of("number").alias("account_number"), F.transform(of("y"), lambda y: F.make_date(y.cast("int"), F.lit(1), F.lit(1))).alias("date_opened"), of("balance").alias("balance_owed"),
        of("high").alias("high_balance"), of("kind").alias("account_type"), of("status").alias("account_status"), status.alias("history_2y"),
        F.when(F.size(status) > 1, F.struct(late("O").alias("late30"), late("F").alias("late60"), late("P").alias("late90"))).alias("history_7y"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("account_label"),
    )


_OVERLAP = "LEN(LIST_INTERSECT({a}, {b})) > 0"
SCORES_SQL = f"""WITH src AS ({SOURCES_SQL}), acc AS (SELECT session, c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN LOWER(c_mktsegment) END AS label, LIST(REGEXP_REPLACE(number, '[^0-9]', '', 'g') ORDER BY n) AS numbers, LIST(y) FILTER (y IS NOT NULL) AS ys,
 LIST(balance) FILTER (balance <> 0) AS bals, LIST(high) FILTER (high IS NOT NULL) AS highs, LIST(kind) AS kinds, LIST(status ORDER BY n) FILTER (status IS NOT NULL) AS sts FROM src GROUP BY ALL),
p AS (SELECT a.session, a.c_custkey AS c_custkey_a, b.c_custkey AS c_custkey_b, COALESCE(LEN([1 FOR x IN a.numbers IF x <> '' AND LEN([1 FOR z IN b.numbers IF z <> '' AND (CONTAINS(x, z) OR CONTAINS(z, x))]) > 0]) > 0, FALSE) AS m1,
 COALESCE({_OVERLAP.format(a="a.ys", b="b.ys")}, FALSE) AS m2, COALESCE({_OVERLAP.format(a="a.bals", b="b.bals")}, FALSE) AS m3, {_OVERLAP.format(a="a.kinds", b="b.kinds")} AS m4, COALESCE({_OVERLAP.format(a="a.sts", b="b.sts")}, FALSE) AS m5,
 COALESCE(LEN(a.sts) > 0 AND LEN(b.sts) > 0 AND LEN([1 FOR i IN RANGE(0, LEAST(LEN(a.sts), LEN(b.sts))) IF a.sts[LEN(a.sts) - i] <> b.sts[LEN(b.sts) - i]]) = 0, FALSE) AS m6,
 COALESCE(LEN(a.sts) > 1 AND LEN(b.sts) > 1 AND LIST_SORT(a.sts) = LIST_SORT(b.sts), FALSE) AS m7, COALESCE(a.label = b.label, FALSE) AS m8,
 COALESCE(LEN(a.highs) > 0 AND LEN(b.highs) > 0 AND LEN([1 FOR x IN a.highs IF LEN([1 FOR z IN b.highs IF ABS(x - z) / 100.0::DOUBLE <= GREATEST(20000, LEAST(x, z) / 100.0::DOUBLE * 0.05::DOUBLE)]) > 0]) = 0, FALSE) AS c2 FROM acc a JOIN acc b ON a.session = b.session AND a.c_custkey < b.c_custkey),
s AS (SELECT *, m1::INT + m2::INT + 3 * m3::INT + 0.5::DOUBLE * m4::INT + 0.5::DOUBLE * m5::INT + m6::INT + m7::INT + m8::INT AS points FROM p)
SELECT session, c_custkey_a, c_custkey_b, points, CASE WHEN points >= 5 AND m3 AND NOT c2 THEN 'auto' WHEN points >= 3 THEN 'ai' ELSE 'different' END AS decision, CASE WHEN points >= 5 AND m3 AND NOT c2 THEN 'points:direct' WHEN points >= 3 THEN 'points:ai' ELSE '' END AS triggers,
 ARRAY_TO_STRING([x FOR x IN [CASE WHEN m1 THEN 'account_number' END, CASE WHEN m2 THEN 'date_opened' END, CASE WHEN m3 THEN 'balance_owed' END, CASE WHEN m4 THEN 'account_type' END, CASE WHEN m5 THEN 'account_status' END, CASE WHEN m6 THEN 'history_2y' END, CASE WHEN m7 THEN 'history_7y' END, CASE WHEN m8 THEN 'account_label' END] IF x IS NOT NULL], ',') AS matched,
 ARRAY_TO_STRING([x FOR x IN [CASE WHEN NOT m3 THEN 'amount_conflict:balance_owed' END, CASE WHEN c2 THEN 'amount_conflict:high_balance' END] IF x IS NOT NULL], ',') AS conflicts FROM s"""


@query("account_scores", SCORES_SQL)
def account_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight fields of every pair; high balances conflict beyond 20,000 and a twentieth."""
    policy = scoring.Policy(amount_abs=20000.0, amount_ratio=0.05)
    found = scoring.scored_pairs(accounts(spark, sf_dir), "session", "c_custkey", policy, ("high_balance",))
    return found.withColumns({c: F.array_join(c, ",") for c in ("triggers", "matched", "conflicts")})
