"""Report lines of orders read without places, and what three sources say of a field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.operators import textlines
from ledgermend.plans.catalog import query, table
from ledgermend.plans.scoring import SOURCES_SQL
from ledgermend.workspace import partitions

#: Orders whose lines a task reads.
ORDERS = 100_000

#: The lines of an order by place; both engines read this.
LINES = (
    "CASE WHEN k % 3 > 0 THEN 'TransUnion Experian Equifax' END", "CASE WHEN k % 4 = 0 THEN 'Account #:  ' || CAST(k AS STRING) || '-1  none  **' || CAST(k % 100 AS STRING) ELSE 'Account # disputed' END",
    "CASE k % 3 WHEN 0 THEN 'Experian' WHEN 1 THEN 'Equifax Acct No. ' || CAST(k % 50 AS STRING) END", "CASE WHEN k % 5 < 3 THEN 'Account Number: ' || CAST(k % 70 AS STRING) || ' ' || CAST(k % 7 AS STRING) ELSE 'Type: Loan' END",
    "CASE WHEN k % 8 > 0 THEN 'Two-Year Payment History' END", "'TransUnion ok ' || s", "CASE WHEN k % 2 = 0 THEN 'co  30' END", "CASE WHEN k % 7 > 2 THEN 'Experian' || CASE WHEN k % 7 = 3 THEN '' ELSE ' 60' END END", "CASE WHEN k % 6 = 0 THEN 'TransUnion again' ELSE 'more' END",
    "CASE WHEN k % 9 > 0 THEN 'Days Late -7 Year History' END", "'Experian 30:' || CAST(k % 4 AS STRING) || ' 60:1 90:' || CAST(k % 3 AS STRING)", "CASE WHEN k % 2 = 0 THEN 'Equifax late 30:1  60:2 90:' || CAST(k % 5 AS STRING) ELSE 'Equifax' END", "'experian 30:9 60:9 90:9'",
)
LINES_SQL = "SELECT * FROM (WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders)\n" + "\nUNION ALL ".join(f"SELECT k, CAST({j} AS INT) AS position, {text} AS text FROM o" for j, text in enumerate(LINES)) + ") AS every WHERE text IS NOT NULL"
MARKED_SQL = f"""lines AS ({LINES_SQL}),
named AS (SELECT *, LENGTH(REGEXP_EXTRACT(LOWER(text), 'transunion')) / 10 + LENGTH(REGEXP_EXTRACT(LOWER(text), 'experian')) / 8 + LENGTH(REGEXP_EXTRACT(LOWER(text), 'equifax')) / 7 AS several, LOWER(REGEXP_EXTRACT(text, '(?i)^(transunion|experian|equifax)\\b', 1)) AS name FROM lines)"""


def tasks(spark: SparkSession, sf_dir: str) -> int:
    return max(partitions(spark), -(-table(spark, sf_dir, "orders").count() // ORDERS))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``LINES_SQL``, from one pass over the orders, which are dealt by key before they become lines: so many that a task sorts about ``ORDERS`` of them."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    orders = orders.repartition(tasks(spark, sf_dir), "k")
    return orders.select("k", F.posexplode(F.array(*[F.expr(text) for text in LINES])).alias("position", "text")).where("text is not null")


@query("line_numbers", f"""WITH {MARKED_SQL}, held AS (SELECT *, NULLIF(LAST_VALUE(CASE WHEN several > 1 THEN '' WHEN name <> '' THEN name END IGNORE NULLS) OVER (PARTITION BY k ORDER BY position ROWS UNBOUNDED PRECEDING), '') AS source FROM named),
own AS (SELECT k, source, position, REGEXP_EXTRACT(text, CASE WHEN several <= 1 AND name <> '' THEN '(?i)(?:Account\\s*(?:#|Number|No\\.?)|Acct\\s*(?:#|No\\.?))\\s*:?\\s*(.+)' ELSE '(?i)^(?:Account\\s*(?:#|Number|No\\.?)|Acct\\s*(?:#|No\\.?))\\s*:?\\s*(.+)' END, 1) AS v FROM held WHERE source IS NOT NULL),
last AS (SELECT k, source, ARG_MAX(REGEXP_REPLACE(v, '[ -]', '', 'g'), position) AS v FROM own WHERE REGEXP_MATCHES(v, '[0-9]') GROUP BY 1, 2),
wide AS (SELECT k, STRING_SPLIT(SUBSTR(text, 13), '  ') AS p FROM lines WHERE text LIKE 'Account #:  %'), parts AS (SELECT k, 'transunion' AS source, p[1] AS v FROM wide UNION ALL SELECT k, 'experian', p[2] FROM wide UNION ALL SELECT k, 'equifax', p[3] FROM wide),
rows3 AS (SELECT k, source, REGEXP_REPLACE(v, '[ -]', '', 'g') AS v FROM parts WHERE REGEXP_MATCHES(v, '[0-9]'))
SELECT COALESCE(r.k, l.k) AS k, COALESCE(r.source, l.source) AS source, COALESCE(l.v, r.v) AS "value" FROM rows3 r FULL JOIN last l ON l.k = r.k AND l.source = r.source""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textlines.account_numbers(report_lines(spark, sf_dir), ["k"], tasks(spark, sf_dir))


@query("line_histories", f"""WITH {MARKED_SQL}, w AS (SELECT *, MIN(CASE WHEN text = 'Two-Year Payment History' THEN position END) OVER (PARTITION BY k) AS a, MIN(CASE WHEN text = 'Days Late -7 Year History' THEN position END) OVER (PARTITION BY k) AS z FROM named),
two AS (SELECT *, LAST_VALUE(CASE WHEN name <> '' THEN {{'at': position, 'source': name}} END IGNORE NULLS) OVER (PARTITION BY k ORDER BY position ROWS UNBOUNDED PRECEDING) AS st FROM w WHERE position > a AND position < z),
txt AS (SELECT k, st, TRIM(REGEXP_REPLACE(STRING_AGG(CASE WHEN name <> '' THEN TRIM(SUBSTR(text, LENGTH(name) + 1)) ELSE text END, ' ' ORDER BY position), '\\s+', ' ', 'g')) AS h FROM two WHERE st IS NOT NULL GROUP BY 1, 2),
hist AS (SELECT k, st.source AS source, ARG_MAX(h, st.at) AS history FROM txt GROUP BY 1, 2),
late AS (SELECT k, name AS source, position, REGEXP_EXTRACT(text, '30:(\\d+)\\s+60:(\\d+)\\s+90:(\\d+)', ['a', 'b', 'c']) AS n FROM w WHERE position > z AND name <> '' AND REGEXP_MATCHES(text, '30:\\d+')),
tot AS (SELECT k, source, ARG_MIN(CAST(n.a AS INT) + CAST(n.b AS INT) + CAST(n.c AS INT), position) AS days_late FROM late GROUP BY 1, 2)
SELECT COALESCE(h.k, t.k) AS k, COALESCE(h.source, t.source) AS source, history, days_late FROM hist h FULL JOIN tot t ON t.k = h.k AND t.source = h.source""")
def line_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = report_lines(spark, sf_dir)
    two, seven = (df.repartition(tasks(spark, sf_dir), "k", "source") for df in (textlines.two_year_texts(lines, ["k"]), textlines.seven_year_totals(lines, ["k"])))
    return two.join(seven, ["k", "source"], "full")


@query("field_summaries", f"""WITH src AS ({SOURCES_SQL}), v AS (SELECT c_custkey, 'kind' AS field, n, kind AS "value" FROM src UNION ALL SELECT c_custkey, 'status', n, status FROM src UNION ALL SELECT c_custkey, 'number', n, number FROM src),
t AS (SELECT c_custkey, field, "value", COUNT(*) AS votes, MIN(n) AS first FROM v WHERE "value" <> '' GROUP BY 1, 2, 3), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey, field ORDER BY votes DESC, first) AS i, COUNT(*) OVER (PARTITION BY c_custkey, field) AS d FROM t),
b AS (SELECT c_custkey, field, STRING_AGG(CAST(n AS VARCHAR) || '=' || "value", ';' ORDER BY n) AS by_source FROM v WHERE "value" <> '' GROUP BY 1, 2),
f AS (SELECT c_custkey, COALESCE(ARG_MIN(number, n) FILTER (number <> '' AND n = 3), ARG_MIN(number, n) FILTER (number <> '')) AS first_number FROM src GROUP BY 1)
SELECT r.c_custkey, r.field, by_source, r."value" AS majority, d > 1 AS disagrees, first_number FROM r JOIN b ON b.c_custkey = r.c_custkey AND b.field = r.field JOIN f ON f.c_custkey = r.c_custkey WHERE i = 1""")
def field_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, status and number of a customer's three sources; the first known number, the third source's preferred."""
    sql = SOURCES_SQL.replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}")
    rows = spark.sql(sql, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("kind", "status", "number")])
    told = rows.select("c_custkey", F.col("n").cast("string").alias("source"), F.explode(fields).alias("x")).select("c_custkey", "source", "x.*")
    shown = F.array_join(F.transform(F.map_entries("by_source"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    numbers = rows.groupBy("c_custkey").agg(*[F.max(F.when(F.col("n") == k, F.col("number"))).alias(f"s{k}") for k in (1, 2, 3)])
    first = numbers.select("c_custkey", textlines.first_known({f"s{k}": F.col(f"s{k}") for k in (1, 2, 3)}, ("s3",))["value"].alias("first_number"))
    return textlines.source_summary(told, ["c_custkey"]).withColumn("by_source", shown).join(first, "c_custkey")
