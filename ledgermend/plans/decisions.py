"""Requirements, decisions, pairs of accounts and coverage over lines, orders, customers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.functions import dates, histories, money, predicates, text
from ledgermend.operators import consensus, findings, layout, letters, matching, monthly, outcomes, requirements, rules, sequence, taxonomy
from ledgermend.plans.catalog import query, table

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")

RULES_SQL = """WITH x AS (SELECT *, CASE l_linenumber WHEN 1 THEN 'history' WHEN 2 THEN 'account_number' WHEN 3 THEN 'semantic' WHEN 4 THEN 'date' WHEN 5 THEN 'numeric' ELSE 'free' END AS kind, l_returnflag = 'N' AS absent,
  CASE WHEN l_returnflag = 'N' THEN 'supportive_needs_companion' WHEN l_linestatus = 'F' THEN 'strong' ELSE 'no_case' END AS decision FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  CASE WHEN kind = 'history' AND NOT absent AND l_discount > 0.05 THEN 'strong' WHEN kind IN ('account_number', 'date', 'numeric') AND NOT absent THEN 'strong' WHEN kind = 'semantic' AND l_linestatus = 'O' THEN 'strong' ELSE 'soft' END AS strength,
  ARRAY_TO_STRING(LIST_SORT(LIST_FILTER([CASE WHEN l_discount > 0.05 THEN 'equifax' WHEN l_quantity < 10 AND NOT l_tax > 0.04 THEN 'equifax' END, CASE WHEN l_tax > 0.04 OR l_quantity < 10 THEN 'experian' END, CASE WHEN l_quantity < 10 THEN 'transunion' END], lambda b: b IS NOT NULL)), ',') AS asked_raw,
  CASE WHEN decision = 'supportive_needs_companion' AND l_quantity < 25 AND l_linenumber <> 4 THEN 'neutral_context_only' ELSE decision END AS downgraded,
  CASE WHEN decision = 'strong' AND kind IN ('semantic', 'free') AND NOT (l_discount > 0.02 AND l_linenumber >= 3) THEN 'no_case' ELSE decision END AS gated,
  CASE WHEN l_linestatus = 'O' THEN CASE l_returnflag WHEN 'A' THEN 'same_account_same_debt' WHEN 'R' THEN 'same_account_diff_debt' ELSE 'same_account_debt_unknown' END WHEN l_returnflag = 'A' THEN 'same_debt_diff_account' ELSE 'different' END AS pair_raw FROM x"""


@query("finding_rules", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, strength, downgraded, gated,
  CASE WHEN pair_raw LIKE 'same_account%' AND (l_quantity > 40 OR l_partkey % 10 = 0) THEN 'different' ELSE pair_raw END AS pair FROM ({RULES_SQL})""")
def finding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as findings: the line number is the kind of field, flags say what is missing or differs."""
    n, gone, same = F.col("l_linenumber"), F.col("l_returnflag") == "N", F.col("l_linestatus") == "O"
    kind = F.coalesce(F.try_element_at(F.array(*[F.lit(k) for k in ("history", "account_number", "semantic", "date", "numeric")]), n), F.lit("free"))
    decision = F.when(gone, "supportive_needs_companion").when(~same, "strong").otherwise("no_case")
    debt = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A")
    return table(spark, sf_dir, "lineitem").select(
        *LINE, findings.strength(kind, gone, F.when(same, "split").otherwise("majority"), F.col("l_discount") > 0.05).alias("strength"),
        findings.downgraded(decision, n.cast("string"), gone, F.col("l_quantity") >= 25, ["4"]).alias("downgraded"),
        findings.conditional(decision, kind.isin("semantic", "free"), F.col("l_discount") > 0.02, n, 3).alias("gated"),
        findings.guarded(findings.pair_decision(same, debt), F.col("l_quantity") > 40, F.col("l_partkey") % 10 != 0).alias("pair"),
    )


@query("asked_bureaus", """WITH x AS (SELECT *, [CASE WHEN l_discount > 0.05 THEN 'equifax' END, CASE WHEN l_tax > 0.04 THEN 'experian' END] AS d, l_quantity < 10 AS gone FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST_FILTER(CASE WHEN gone THEN ['transunion', 'experian', 'equifax'] ELSE d END, lambda b: b IS NOT NULL))), ',') AS bureaus, 'equifax,experian,transunion' AS everyone FROM x""")
def asked_bureaus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom to ask about a line: those that differ, and all three where one has nothing."""
    some = lambda *pairs: F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in pairs]))
    differs = some((F.col("l_discount") > 0.05, "equifax"), (F.col("l_tax") > 0.04, "experian"))
    gone = some((F.col("l_quantity") < 10, "transunion"))
    there = some((F.lit(True), "experian"), (F.lit(True), "equifax"))
    names = ["transunion", "experian", "equifax"]
    asked = lambda everyone: F.array_join(findings.requirement_bureaus(differs, gone, there, everyone, names), ",")
    return table(spark, sf_dir, "lineitem").select(*LINE, asked(False).alias("bureaus"), asked(True).alias("everyone"))


POLARITY_SQL = """SELECT event_id, CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 50 THEN 'bad' WHEN value - 50 = 0 THEN 'good' ELSE 'neutral' END WHEN event_type = 'error' THEN 'bad' WHEN event_type = 'view' THEN 'good' ELSE 'neutral' END AS polarity,
  CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND value > 50) THEN 'high' ELSE 'low' END AS severity FROM events"""


@query("event_polarity", POLARITY_SQL)
def event_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases by amount, other events by their name."""
    kind = F.when(F.col("event_type") == "purchase", "money").otherwise("text")
    p = findings.polarity(kind, F.col("value") - 50, F.col("event_type"), "view", "err", "high")
    return table(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", "p.polarity", "p.severity")


ORDER_SQL = """WITH i AS (SELECT o_custkey AS k, o_orderkey, SUBSTR(o_orderpriority, 1, 1) AS field, CASE o_orderstatus WHEN 'O' THEN 'opener' WHEN 'F' THEN 'supporter' ELSE 'skipped' END AS role, ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k, field ORDER BY CASE role WHEN 'opener' THEN 0 ELSE 1 END, place) AS n FROM i WHERE role <> 'skipped')
SELECT k, o_orderkey, field, role, CAST(ROW_NUMBER() OVER (PARTITION BY k ORDER BY CASE role WHEN 'opener' THEN 0 ELSE 1 END, place) AS INT) AS position FROM f WHERE n = 1"""


@query("canonical_order", ORDER_SQL)
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as ranked findings, their priority as the field: a field's first place counts."""
    role = F.when(F.col("o_orderstatus") == "O", "opener").when(F.col("o_orderstatus") == "F", "supporter").otherwise("skipped")
    ranked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice", F.left("o_orderpriority", F.lit(1)).alias("field"), role.alias("role"))
    ranked = sequence.islands(ranked.withColumn("_order", -F.col("o_totalprice")), ["k", "role"], ["_order", "o_orderkey"], F.lit(True), "place")
    return findings.dispute_order(ranked, "k").select("k", "o_orderkey", "field", "role", "position")


TIER_SQL = """WITH d AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS n, l_returnflag || l_linestatus AS reason, CASE l_linenumber WHEN 1 THEN 'bankruptcy' WHEN 2 THEN 'severe_delinquency' WHEN 3 THEN 'derogatory' WHEN 4 THEN 'high_utilization' WHEN 5 THEN 'charge_off' ELSE 'unknown' END AS issue,
  CASE l_linenumber WHEN 1 THEN 1 WHEN 5 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 5 END AS t, LEAST(1.0, l_quantity / 40.0) AS confidence FROM lineitem),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY t, confidence DESC, n) AS place FROM d)
SELECT k, issue AS primary_issue, CASE t WHEN 5 THEN 'none' ELSE 'Tier' || t END AS tier, confidence FROM b WHERE place = 1"""


@query("tier_decisions", TIER_SQL)
def tier_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as decisions on their order, in spellings that must be made canonical first: the strongest tier wins."""
    said = F.try_element_at(F.array(*[F.lit(x) for x in (" Bankruptcy ", "severe_delinquency", "DEROGATORY", "high_utilization", "chargeoff", "late?", "")]), F.col("l_linenumber"))
    d = taxonomy.normalized_decision(said, F.lit("rules"), F.array("l_returnflag"), (F.col("l_quantity") / 40).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("n"), F.concat("l_returnflag", "l_linestatus").alias("reason"), d.alias("d"))
    rows = rows.select("k", "n", "reason", "d.primary_issue", "d.tier", "d.confidence")
    return consensus.strongest_decision(rows, "k", "n").select("k", "primary_issue", "tier", "confidence")


@query("fallback_actions", """SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1, 2) THEN 'dispute' ELSE '' END AS action, CASE c_custkey % 5 WHEN 0 THEN 'identity_theft' WHEN 1 THEN 'not_mine' WHEN 2 THEN 'goodwill' ELSE 'inaccurate_reporting' END AS category, c_custkey % 5 <> 4 AS sure FROM customer""")
def fallback_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a status, a kind of dispute and a statement each."""
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % n + 1).cast("int"))
    action = taxonomy.fallback_action(pick(4, "In Collection", "Charge-Off", "current", "Paid"), pick(4, "", None, "late", ""))
    kind, facts = pick(5, "", "NOT_MINE", "other", "", "other"), pick(5, "my card was stolen", "x", "asks for goodwill", "", "wrong balance")
    category = taxonomy.category(kind, facts, F.when(F.col("c_custkey") % 5 < 3, F.array(F.lit("unclear"))), ["identity_theft", "not_mine", "goodwill"])
    return table(spark, sf_dir, "customer").select("c_custkey", action.alias("action"), category.alias("c")).select("c_custkey", "action", "c.category", "c.sure")


STATUS_SQL = """WITH r AS (SELECT user_id, event_type, 0 AS side, event_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, 1, event_id FROM events WHERE event_id % 2 = 1),
k AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS rank FROM r)
SELECT user_id, ARG_MAX(event_type, rank * 2 + side) AS status, MAX(rank * 2 + side) % 2 = 1 AS incoming FROM k GROUP BY 1"""


@query("status_merge", STATUS_SQL)
def status_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events as the stored statuses, odd ones as incoming: the higher rank wins, the incoming one on ties."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), (F.col("event_id") % 2 == 1).alias("incoming"))
    return outcomes.higher_status(e.where("not incoming"), e.where("incoming"), ["user_id"], ["signup", "view", "click", "purchase"]).select("user_id", "status", "incoming")


@query("content_dedup", """SELECT user_id, event_type, props, MIN(event_id) AS event_id FROM events GROUP BY 1, 2, 3""")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    return outcomes.first_by_content(e, ["user_id"], "event_id").select("user_id", "event_type", "props", "event_id")


KEYED_SQL = """WITH e AS (SELECT user_id, event_type, MAX(value) FILTER (event_id % 2 = 0) AS a, MAX(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1, 2)
SELECT user_id, STRING_AGG(event_type || '=' || COALESCE(b, a), ',' ORDER BY a IS NULL, event_type) AS merged FROM e GROUP BY 1"""


@query("keyed_merge", KEYED_SQL)
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the best value of each kind of event: those of even events patched by those of odd ones."""
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type", (F.col("event_id") % 2).alias("side")).agg(F.max("value").alias("v"))
    entry = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct(F.col("event_type").alias("k"), "v"))))
    sides = best.groupBy("user_id").agg(entry(0).alias("base"), entry(1).alias("patch"))
    merged = outcomes.merged_keyed_list(F.col("base"), F.col("patch"), "k", "v")
    return sides.select("user_id", F.array_join(F.transform(merged, lambda x: F.concat(x["k"], F.lit("="), x["v"].cast("string"))), ",").alias("merged"))


@query("reviewed_decisions", """WITH r AS (SELECT user_id, event_type, ARG_MAX(props, event_id) AS reviewed FROM events WHERE value > 60 GROUP BY 1, 2)
SELECT e.event_id, COALESCE(reviewed, 'default') AS decision FROM events e LEFT JOIN r ON r.user_id = e.user_id AND r.event_type = e.event_type""")
def reviewed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of over 60 as reviews of their user and kind: the last one's word replaces the default."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("field"), "value", "props", F.lit("default").alias("default_decision"))
    reviews = e.where("value > 60").select("user_id", "field", F.col("props").alias("decision"), F.col("event_id").alias("seq"))
    return findings.with_decisions(e, reviews, "user_id").select("event_id", "decision")


@query("review_results", """WITH f AS (SELECT o_custkey AS k, o_orderkey AS n, o_orderstatus AS code, SUBSTR(o_orderpriority, 1, 1) AS field FROM orders WHERE o_totalprice > 100000),
r AS (SELECT o_custkey AS k, o_orderkey AS result_id, o_orderstatus AS code, CASE WHEN o_orderkey % 3 > 0 THEN SUBSTR(o_orderpriority, 1, 1) END AS field FROM orders),
j AS (SELECT r.k, r.result_id, f.n, f.field, ROW_NUMBER() OVER (PARTITION BY r.k, r.result_id ORDER BY f.n) AS place FROM r JOIN f ON f.k = r.k AND f.code = r.code AND (r.field IS NULL OR r.field = f.field))
SELECT k, result_id, n, field FROM j WHERE place = 1""")
def review_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dear orders as findings that were sent, every order as a result, some without a field."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("reason_code"), F.left("o_orderpriority", F.lit(1)).alias("field"), (F.col("o_totalprice") > 100000).alias("send_to_ai"))
    results = o.select("k", F.col("n").alias("result_id"), F.col("reason_code").alias("mismatch_code"), F.when(F.col("n") % 3 > 0, F.col("field")).alias("field"))
    return requirements.with_results(o, results, "k", "n").select("k", "result_id", "n", "field")


RULE_ROWS = [("1", "status", 10), ("2", "activity", 20), ("3", "terms", 30)]
MATRIX_ROWS = [(" 1 ", "c1_x", " strong_actionable "), ("1", "C4", "no_case"), ("2", "C5_ALL", "support_paired"), ("3", "c1", "neutral")]


@query("requirement_defaults", """WITH rules(field, category, min_days) AS (VALUES ('1', 'status', 10), ('2', 'activity', 20), ('3', 'terms', 30)), m(field, reason, decision) AS (VALUES ('1', 'C1', 'strong_actionable'), ('1', 'C4', 'no_case'), ('2', 'C5', 'support_paired'), ('3', 'C1', 'neutral')),
o AS (SELECT o_orderkey, SUBSTR(o_orderpriority, 1, 1) AS field, CASE o_orderstatus WHEN 'O' THEN 'C1' WHEN 'F' THEN 'C4' ELSE 'C5' END AS reason FROM orders)
SELECT o_orderkey, o.field, category, min_days, decision AS default_decision FROM o JOIN rules ON rules.field = o.field LEFT JOIN m ON m.field = o.field AND m.reason = o.reason""")
def requirement_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as disagreements on a field (their priority): its rule, and the default decision for the reason."""
    code = F.when(F.col("o_orderstatus") == "O", "c1_two_present").when(F.col("o_orderstatus") == "F", "C4_TWO_MATCH").otherwise(" C5")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.left("o_orderpriority", F.lit(1)).alias("field"), code.alias("reason_code"))
    found = requirements.with_rules(o, spark.createDataFrame(RULE_ROWS, "field string, category string, min_days int"))
    found = requirements.with_default_decisions(found, spark.createDataFrame(MATRIX_ROWS, "field string, reason string, decision string"))
    return found.select("o_orderkey", "field", "category", "min_days", "default_decision")


ELIGIBLE_SQL = """WITH c AS (SELECT l_orderkey, l_returnflag AS field, COUNT(*) AS n, COUNT(DISTINCT l_linestatus) AS d FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN n = 1 THEN 'case_1' WHEN n = 2 AND d = 1 THEN 'case_2' WHEN n = 2 THEN 'case_3' WHEN d = 1 THEN 'case_5' ELSE 'case_4' END AS pattern FROM c)
SELECT l_orderkey, field, pattern, pattern IN ('case_3', 'case_4', 'case_5') AS mismatch, CASE field WHEN 'A' THEN TRUE WHEN 'R' THEN pattern IN ('case_3', 'case_4', 'case_5') ELSE FALSE END AS eligible,
  CASE WHEN n < 3 THEN 'soft' WHEN d > 1 AND n % 2 = 0 THEN 'soft' ELSE 'strong' END AS strength FROM p"""


@query("field_eligibility", ELIGIBLE_SQL)
def field_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of an order as fields with a reporting pattern; statuses of its lines as histories."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("l_linestatus").alias("s"))
    d = F.size("s")
    pattern = F.when(F.col("n") == 1, "case_1").when(F.col("n") == 2, F.when(d == 1, "case_2").otherwise("case_3")).when(d == 1, "case_5").otherwise("case_4")
    late = F.when(F.col("n") % 2 == 0, F.lit("OK")).otherwise(F.lit("late 30"))
    tokens = F.transform("s", lambda x: F.array(F.concat(x, F.lit("K")), late))
    strength = requirements.history_strength(F.greatest(3 - F.col("n"), F.lit(0)), F.col("n"), F.lit(True), F.array(F.array(F.lit(0))), tokens)
    flags = requirements.eligibility(F.col("field"), F.col("pattern"), ["A"], ["R"])
    rows = c.withColumn("pattern", pattern).select("l_orderkey", "field", "pattern", flags.alias("e"), strength.alias("strength"))
    return rows.select("l_orderkey", "field", "pattern", "e.mismatch", "e.eligible", "strength")


NUMBERS_SQL = """WITH c AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k, c_custkey % 6 AS m FROM customer),
n AS (SELECT c_custkey, CASE m WHEN 0 THEN '****' || k WHEN 1 THEN NULL WHEN 2 THEN 'AB' || k ELSE '99' || k END AS a, CASE WHEN m < 3 THEN k ELSE k || '7' END AS b, CASE m WHEN 5 THEN '' ELSE 'x99' || k END AS c,
  CASE WHEN m IN (0, 2) THEN '88' || k WHEN m = 5 THEN k || '79' ELSE '4' END AS d FROM c),
g AS (SELECT *, REGEXP_REPLACE(COALESCE(a, ''), '[^0-9]', '', 'g') AS da, REGEXP_REPLACE(b, '[^0-9]', '', 'g') AS db, REGEXP_REPLACE(c, '[^0-9]', '', 'g') AS dc FROM n),
r AS (SELECT *, da <> '' AND (CONTAINS(da, db) OR CONTAINS(db, da)) AS ab, da <> '' AND dc <> '' AND (CONTAINS(da, dc) OR CONTAINS(dc, da)) AS ac, dc <> '' AND (CONTAINS(db, dc) OR CONTAINS(dc, db)) AS bc,
  da <> '' AND NOT (CONTAINS(da, db) OR CONTAINS(db, da)) AS xab, da <> '' AND dc <> '' AND NOT (CONTAINS(da, dc) OR CONTAINS(dc, da)) AS xac, dc <> '' AND NOT (CONTAINS(db, dc) OR CONTAINS(dc, db)) AS xbc FROM g),
l AS (SELECT *, CASE WHEN xab THEN 2 ELSE 1 END AS lb FROM r),
v AS (SELECT c_custkey, lb, CASE WHEN lb = 1 THEN CASE WHEN xac OR xbc THEN 2 ELSE 1 END WHEN NOT xac AND (ac OR NOT (NOT xbc AND bc)) THEN 1 WHEN NOT xbc THEN 2 ELSE 3 END AS lc FROM l)
SELECT c_custkey, '1,' || lb || ',' || lc AS labels FROM v"""


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an account number in three sources (a, b, c), masked, prefixed, missing or cut, and another account's (d)."""
    k, m = F.col("c_custkey").cast("string"), F.col("c_custkey") % 6
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(m == 0, F.concat(F.lit("****"), k)).when(m == 2, F.concat(F.lit("AB"), k)).when(m != 1, F.concat(F.lit("99"), k)).alias("a"),
        F.when(m < 3, k).otherwise(F.concat(k, F.lit("7"))).alias("b"), F.when(m == 5, "").otherwise(F.concat(F.lit("x99"), k)).alias("c"),
        F.when(m.isin(0, 2), F.concat(F.lit("88"), k)).when(m == 5, F.concat(k, F.lit("79"))).otherwise("4").alias("d"),
    )


@query("number_groups", NUMBERS_SQL)
def number_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = consensus.number_groups([F.col(x) for x in "abc"])
    return numbers(spark, sf_dir).select("c_custkey", F.array_join(F.transform(labels, lambda x: x.cast("string")), ",").alias("labels"))


PAIR_SQL = NUMBERS_SQL.split("r AS (")[0] + """q AS (SELECT *, REGEXP_REPLACE(d, '[^0-9]', '', 'g') AS dd FROM g),
h AS (SELECT *, da <> '' AND (CONTAINS(da, dd) OR CONTAINS(dd, da)) AS h0, CONTAINS(db, dd) OR CONTAINS(dd, db) AS h1, dc <> '' AND (CONTAINS(dc, dd) OR CONTAINS(dd, dc)) AS h2, LENGTH(dd) >= 2 AS long FROM q)
SELECT c_custkey, long AND ((h0 AND LENGTH(da) >= 2) OR (h1 AND LENGTH(db) >= 2) OR (h2 AND LENGTH(dc) >= 2)) AS matched,
  CASE WHEN long AND h0 AND LENGTH(da) >= 2 THEN 0 WHEN long AND h1 AND LENGTH(db) >= 2 THEN 1 WHEN long AND h2 AND LENGTH(dc) >= 2 THEN 2 WHEN h0 THEN 0 WHEN h1 THEN 1 WHEN h2 THEN 2 WHEN da <> '' THEN 0 ELSE 1 END AS left_source,
  CASE WHEN UPPER(REGEXP_REPLACE(COALESCE(a, ''), '[^A-Za-z0-9]', '', 'g')) = d THEN 'match' WHEN b = d OR UPPER(REGEXP_REPLACE(c, '[^A-Za-z0-9]', '', 'g')) = d THEN 'match' ELSE 'none' END AS strict FROM h"""


@query("number_pairs", PAIR_SQL)
def number_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's three numbers against one other number: by visible digits, two at least, and strictly."""
    left, right = [F.col(x) for x in "abc"], [F.col("d")]
    pair, strict = matching.number_pair(left, right, 2), matching.strict_number_pair(left, right)
    return numbers(spark, sf_dir).select("c_custkey", pair.alias("p"), strict["level"].alias("strict")).select("c_custkey", "p.matched", F.col("p.left").alias("left_source"), "strict")


TOLERANCE_SQL = """WITH o AS (SELECT l_orderkey AS k, l_returnflag AS f, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, COUNT(*) AS n, MIN(CAST(l_shipdate AS DATE)) AS a, MAX(CAST(l_shipdate AS DATE)) AS b FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, GREATEST(5000.0, hi * 0.1) AS cap, hi - lo AS span, CAST(b - a AS DOUBLE) AS days FROM o)
SELECT k, f, lo <> hi AND span > cap AS money_differs, CASE WHEN span <= cap THEN span END AS span, CASE WHEN span <= cap THEN cap END AS ceiling, days > 30 AS dates_differ, CASE WHEN days <= 30 THEN days END AS days FROM t"""


@query("tolerances", TOLERANCE_SQL)
def tolerances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extremes of a flag's prices and dates in an order as two sources."""
    day = F.to_date("l_shipdate")
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f")).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.min(day).alias("a"), F.max(day).alias("b"))
    of = lambda kind: consensus.tolerated(F.lit(kind), [F.col("lo"), F.col("hi")], [F.col("a"), F.col("b")], 5000.0, 0.1, 30)
    rows = o.select("k", "f", of("amount").alias("m"), of("date").alias("d"))
    return rows.select("k", "f", F.col("m.is_mismatch").alias("money_differs"), F.col("m.metric").alias("span"), "m.ceiling", F.col("d.is_mismatch").alias("dates_differ"), F.col("d.metric").alias("days"))


@query("tolerance_hits", """WITH o AS (SELECT l_orderkey, l_returnflag, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, CAST(SUM(CASE WHEN hi <> lo AND hi - lo <= GREATEST(5000.0, hi * 0.1) THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM o GROUP BY 1""")
def tolerance_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.tolerance_hits(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_extendedprice", 5000.0, 0.1)


CONFLICT_SQL = """WITH s AS (SELECT l_orderkey AS k, LIST(DISTINCT CAST(ROUND(l_quantity * 100) AS BIGINT)) FILTER (l_linestatus = 'O') AS qo, LIST(DISTINCT CAST(ROUND(l_quantity * 100) AS BIGINT)) FILTER (l_linestatus = 'F') AS qf FROM lineitem GROUP BY 1),
j AS (SELECT a.l_orderkey AS k, BOOL_OR(ABS(a.l_extendedprice - b.l_extendedprice) <= GREATEST(100.0, LEAST(ABS(a.l_extendedprice), ABS(b.l_extendedprice)) * 0.05)) AS near FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linestatus = 'O' AND b.l_linestatus = 'F' GROUP BY 1)
SELECT s.k, CONCAT_WS(',', CASE WHEN NOT COALESCE(LIST_HAS_ANY(qo, qf), FALSE) THEN 'amount_conflict:balance_owed' END, CASE WHEN near IS NOT NULL AND NOT near THEN 'amount_conflict:high_balance' END) AS conflicts FROM s LEFT JOIN j ON j.k = s.k"""


@query("amount_conflicts", CONFLICT_SQL)
def amount_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and finished lines of an order as two accounts: quantities must agree to the cent, prices within a tolerance."""
    side = lambda s, c: F.collect_set(F.when(F.col("l_linestatus") == s, c))
    cents = F.round(F.col("l_quantity") * 100).cast("long")
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(side("O", cents).alias("qo"), side("F", cents).alias("qf"), side("O", F.col("l_extendedprice")).alias("po"), side("F", F.col("l_extendedprice")).alias("pf"))
    found = matching.amount_conflicts({"balance_owed": (F.col("qo"), F.col("qf")), "high_balance": (F.col("po"), F.col("pf"))}, 100.0, 0.05)
    return o.select("k", F.array_join(found, ",").alias("conflicts"))


ANY_SQL = """WITH p AS (SELECT l_orderkey AS k, MIN(l_quantity) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS a0, MIN(l_quantity) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS a1, MIN(l_quantity) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS b0, MIN(l_quantity) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS b1 FROM lineitem GROUP BY 1)
SELECT k, COALESCE(ABS(a0 - b0) <= 5, FALSE) OR COALESCE(ABS(a0 - b1) <= 5, FALSE) OR COALESCE(ABS(a1 - b0) <= 5, FALSE) OR COALESCE(ABS(a1 - b1) <= 5, FALSE) AS matched,
  CASE WHEN ABS(a0 - b0) <= 5 THEN '00' WHEN ABS(a0 - b1) <= 5 THEN '01' WHEN ABS(a1 - b0) <= 5 THEN '10' WHEN ABS(a1 - b1) <= 5 THEN '11' WHEN a0 - b0 IS NOT NULL THEN '00' WHEN a0 - b1 IS NOT NULL THEN '01' WHEN a1 - b0 IS NOT NULL THEN '10' WHEN a1 - b1 IS NOT NULL THEN '11' END AS pair,
  CAST((a0 - b0 IS NOT NULL)::INT + (a0 - b1 IS NOT NULL)::INT + (a1 - b0 IS NOT NULL)::INT + (a1 - b1 IS NOT NULL)::INT AS INT) AS evaluated FROM p"""


@query("any_source_match", ANY_SQL)
def any_source_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = lambda flag, status: F.min(F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), F.col("l_quantity")))
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(least("A", "O").alias("a0"), least("R", "O").alias("a1"), least("A", "F").alias("b0"), least("R", "F").alias("b1"))
    m = matching.any_source_match([F.col("a0"), F.col("a1")], [F.col("b0"), F.col("b1")], lambda a, b: F.abs(a - b) <= 5)
    return p.select("k", m.alias("m")).select("k", "m.matched", F.concat(F.col("m.left").cast("string"), F.col("m.right").cast("string")).alias("pair"), F.size(F.filter("m.tried", lambda e: e["evaluated"])).alias("evaluated"))


COVERAGE_SQL = """SELECT event_id, CAST(ROUND_EVEN(((value > 10)::INT + (event_type <> 'view')::INT + (props IS NOT NULL AND props <> '')::INT) * 100.0::DOUBLE / 3, 0) AS BIGINT) AS percent FROM events"""


@query("field_coverage", COVERAGE_SQL)
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = [F.when(F.col("value") > 10, F.col("value")), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(""), F.col("props")]
    return table(spark, sf_dir, "events").select("event_id", consensus.coverage(filled).alias("percent"))


@query("missing_fields", """SELECT * FROM (SELECT 'a' AS field, CAST(COUNT(*) FILTER (value <= 10) AS BIGINT) AS missing FROM events UNION ALL SELECT 'b', COUNT(*) FILTER (event_type = 'view') FROM events UNION ALL SELECT 'c', COUNT(*) FILTER (props IS NULL OR props = '') FROM events)""")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("value") > 10, F.col("value")).alias("a"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("b"), F.col("props").alias("c"))
    return consensus.missing_counts(e, ["a", "b", "c"])


@query("mapping_coverage", """SELECT l_linestatus AS bureau, CAST(COUNT(*) FILTER ((l_linestatus = 'O' AND l_returnflag IN ('A', 'N')) OR (l_linestatus = 'F' AND l_returnflag = 'R')) AS BIGINT) AS mapped, CAST(COUNT(*) AS BIGINT) AS total,
  ROUND(100.0::DOUBLE * COUNT(*) FILTER ((l_linestatus = 'O' AND l_returnflag IN ('A', 'N')) OR (l_linestatus = 'F' AND l_returnflag = 'R')) / COUNT(*), 2) AS percent FROM lineitem GROUP BY 1""")
def mapping_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("bureau"), F.col("l_returnflag").alias("label"))
    return consensus.mapping_coverage(labels, spark.createDataFrame([("O", "A"), ("O", "N"), ("F", "R"), ("O", "A")], "bureau string, label string"))


@query("branch_visibility", """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'conflict' WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'skipped' END AS a, CASE WHEN o_custkey % 3 = 0 THEN 'skipped_missing_data' ELSE 'conflict' END AS b FROM orders)
SELECT o_orderkey, CONCAT_WS(',', CASE WHEN a <> 'skipped' THEN 'a' END, 'b') AS eligible, CONCAT_WS(',', CASE WHEN a <> 'skipped' THEN 'a' END, CASE WHEN b = 'conflict' THEN 'b' END) AS executed, CONCAT_WS(',', CASE WHEN a = 'conflict' THEN 'a' END, CASE WHEN b = 'conflict' THEN 'b' END) AS fired FROM s""")
def branch_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("o_orderstatus") == "O", "conflict").when(F.col("o_orderstatus") == "F", "ok").otherwise("skipped")
    b = F.when(F.col("o_custkey") % 3 == 0, "skipped_missing_data").otherwise("conflict")
    v = rules.visibility({"a": a, "b": b})
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.array_join(v[c], ",").alias(c) for c in ("eligible", "executed", "fired")])


FORMS_SQL = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size * 1000 AS DOUBLE) + 0.5 WHEN 1 THEN CAST(p_size AS DOUBLE) END AS found, CASE p_partkey % 3 WHEN 2 THEN CAST(0 AS DECIMAL(18, 4)) ELSE CAST(p_retailprice AS DECIMAL(18, 4)) END AS packed,
  CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS finite, CASE WHEN p_size < 50 THEN p_size + 2000 ELSE p_size + 1900 END AS year, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size * 12 ELSE p_size END AS BIGINT) AS months,
  CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 999 END AS severity FROM part"""


@query("amount_forms", FORMS_SQL)
def amount_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in running text and packs, terms, two-digit years and statuses of parts."""
    size, price, m = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.col("p_partkey") % 3
    shown = F.when(m == 0, F.concat(F.lit("about $"), size, F.lit(",000.5 or 7"))).when(m == 1, F.concat(F.lit("owes "), size, F.lit(" now"))).otherwise("nothing")
    packed = F.when(m == 0, F.concat(F.lit(" $"), price)).when(m == 1, price).otherwise("n/a")
    status = F.element_at(F.array(*[F.lit(x) for x in (" OK", "90", "CO", "?")]), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", money.found_amount(shown).alias("found"), money.pack_amount(packed).alias("packed"), money.finite(F.when(m == 0, "Infinity").otherwise(price)).alias("finite"),
        money.pivot_year(F.col("p_size")).alias("year"), money.term_months(F.concat(size, F.when(F.col("p_partkey") % 2 == 0, " years").otherwise(" months"))).alias("months"), money.severity(status).alias("severity"),
    )


@query("elapsed_days", """SELECT event_id, CAST(FLOOR(DATEDIFF('second', DATE_TRUNC('second', ts), TIMESTAMP '2024-03-01 00:00:00') / 86400) AS BIGINT) AS days, CAST(ts AS DATE) + CAST((7 + 2 - (ISODOW(ts) - 1)) % 7 AS INT) AS wednesday FROM events""")
def elapsed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", dates.elapsed_days(F.col("ts"), F.lit("2024-03-01").cast("timestamp")).alias("days"), dates.next_weekday(F.col("ts"), 2, "UTC").alias("wednesday"))


@query("named_forms", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'semimonthly' WHEN 1 THEN 'biweekly' WHEN 2 THEN 'annually' ELSE 'as ' || LOWER(c_mktsegment) END AS frequency, CASE c_custkey % 2 WHEN 0 THEN 'credit card' ELSE 'auto loan' END AS kind, CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'open' ELSE 'x ' || LOWER(c_mktsegment) END AS status,
  SHA256('{"a":"' || c_mktsegment || '","b":' || c_nationkey || '}') AS hash FROM customer""")
def named_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of payment frequencies, account types and statuses; the hash of a summary."""
    pick = lambda n, *values: F.element_at(F.array(*values), (F.col("c_custkey") % n + 1).cast("int"))
    said = pick(4, F.lit("Twice, a MONTH!"), F.lit("every other week?"), F.lit("once a year"), F.concat(F.lit("As -- "), "c_mktsegment"))
    kind = pick(2, F.lit("Flexible_Spending-CREDITCARD"), F.lit("Auto  Loan."))
    kind = text.account_type(kind, {"flexible spending creditcard": "credit card"})
    status = text.enum_value(pick(3, F.lit(" O-pen "), F.lit("OPEN"), F.concat(F.lit("x   "), "c_mktsegment")), {"open": "open"})
    c = table(spark, sf_dir, "customer").withColumn("a", F.col("c_mktsegment")).withColumn("b", F.col("c_nationkey"))
    return c.select("c_custkey", text.payment_frequency(said).alias("frequency"), kind.alias("kind"), status.alias("status"), text.summary_hash("b", "a").alias("hash"))


@query("rule_texts", """SELECT event_id, value > 20 AND value <= 80 AND (event_type = 'click' OR NOT user_id < 10) AS hit, FALSE AS broken FROM events""")
def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"amount": F.col("value"), "kind": F.col("event_type"), "user": F.col("user_id")}
    hit = predicates.rule_text("20 < Amount <= 80 and (kind == 'click' or not user < 10)", known)
    broken = predicates.rule_text("amount > 0 and __import__('os')", known)
    return table(spark, sf_dir, "events").select("event_id", hit.alias("hit"), broken.alias("broken"))


@query("registry_dates", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN STRFTIME(o_orderdate, '%Y-%m-%d') WHEN 1 THEN STRFTIME(o_orderdate, '%Y-%m-01') WHEN 2 THEN STRFTIME(o_orderdate, '%Y-01-01') WHEN 5 THEN o_orderpriority END AS value, o_orderkey % 6 IN (1, 2) AS derived FROM orders""")
def registry_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda pattern: F.date_format("o_orderdate", pattern)
    said = F.element_at(F.array(day("M/d/yyyy"), day("M.yyyy"), day("yyyy"), F.lit(" n/a"), F.lit("12 2 1"), F.col("o_orderpriority")), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.registry_date(said).alias("d")).select("o_orderkey", "d.value", "d.derived")


@query("keyword_hits", """SELECT p_partkey, CASE WHEN REGEXP_MATCHES(p_name, '^s[a-z]+') THEN 's_words' WHEN CONTAINS(p_name, 'ring') THEN 'ring' WHEN REGEXP_MATCHES(p_type, 'ECON') THEN 'raw' END AS rule_hit,
  CASE WHEN REGEXP_MATCHES(p_name, '^s[a-z]+') THEN REGEXP_EXTRACT(p_name, '^s[a-z]+') WHEN CONTAINS(p_name, 'ring') THEN 'Ring' WHEN REGEXP_MATCHES(p_type, 'ECON') THEN 'ECON' END AS matched, LOWER(p_type) AS history FROM part""")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules_ = [{"id": "s_words", "pattern": "^S[a-z]+"}, {"id": "ring", "value": "Ring"}, {"id": "raw", "pattern": "econ", "match_on": "raw"}]
    hit = text.keyword_hit(F.col("p_name"), F.col("p_type"), rules_)
    return table(spark, sf_dir, "part").select("p_partkey", hit.alias("h"), text.history_text(F.concat(F.lit("  "), "p_type")).alias("history")).select("p_partkey", "h.rule_hit", "h.matched", "history")


@query("letter_checks", """WITH t AS (SELECT conv_id, turn, text, REGEXP_REPLACE(text, 'th(e|is)', 'X', 'gi') AS fixed FROM conversations)
SELECT conv_id, turn, MD5(fixed) AS digest, CAST(LEN(REGEXP_EXTRACT_ALL(text, '(?i)th(e|is)')) AS INT) AS replaced, CAST(LEN(REGEXP_EXTRACT_ALL(fixed, '(?i)an?d')) AS INT) AS kept FROM t""")
def letter_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = text.checked_letter(F.col("text"), [("pii", text.SSN)], [("wording", "th(e|is)", "X"), ("style", "an?d", None)])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", checked.alias("c"))
    count = lambda rule: F.coalesce(F.get(F.filter("c.violations", lambda e: e["rule"] == rule), F.lit(0))["n"], F.lit(0))
    return rows.select("conv_id", "turn", F.md5(F.col("c.text").cast("binary")).alias("digest"), count("wording").alias("replaced"), count("style").alias("kept"))


@query("ai_payloads", """SELECT c_custkey, 'status=' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ',type=****' || RIGHT(LPAD(CAST(c_custkey AS VARCHAR), 12, '4'), 4) ELSE '' END AS fields, c_custkey % 2 = 0 AS has_type, RIGHT(LPAD(CAST(c_custkey AS VARCHAR), 9, '7'), 4) AS last4 FROM customer""")
def ai_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' fields, a long number in one of them, as they may be sent."""
    key = F.col("c_custkey").cast("string")
    base = F.create_map(F.lit("status"), F.col("c_mktsegment"), F.lit("account_number"), F.concat(F.lit("#"), F.lpad(key, 9, "7")))
    more = F.create_map(F.lit("type"), F.lpad(key, 12, "4"))
    fields = F.when(F.col("c_custkey") % 2 == 0, F.map_concat(base, more)).otherwise(base)
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.ai_payload(fields, ["status", "type"]).alias("p"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("p.fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return rows.select("c_custkey", shown.alias("fields"), F.element_at("p.present", "type").alias("has_type"), "p.last4")


MONTHLY_SQL = """WITH l AS (SELECT l_orderkey, STRFTIME(MIN(l_shipdate), '%b') AS month, CAST(STRFTIME(MIN(l_shipdate), '%m') AS INT) AS month_number, CASE CAST(MIN(l_quantity) AS INT) % 4 WHEN 0 THEN 'ok' WHEN 1 THEN '30' WHEN 2 THEN 'co' ELSE '--' END AS status, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT l_orderkey, 'experian' AS bureau, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INT) AS place, month, status, month_number FROM l"""


def layout_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as accounts: a section heading, a bureau, a row of statuses and below it a row of months, a column a line number."""
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("day"), F.min("l_quantity").cast("int").alias("q"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("OK", "30", "CO", "none")]), F.col("q") % 4 + 1)
    token = lambda place, text_, x0, y0, width=8.0: F.struct(place.cast("int").alias("n"), text_.alias("text"), x0.cast("double").alias("x0"), (x0 + width).cast("double").alias("x1"), F.lit(y0).alias("y0"), F.lit(y0 + 1).alias("y1"))
    cells = lines.select("l_orderkey", F.explode(F.array(token(10 + n, status, n * 10, 0.0), token(100 + n, F.date_format("day", "MMM"), n * 10 + 2, 9.0))).alias("t"))
    heads = lines.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.array(token(F.lit(1), F.lit("Two-Year"), F.lit(0), 0.0), token(F.lit(2), F.lit("Experian"), F.lit(0), 0.0), token(F.lit(900), F.lit("Seven Years"), F.lit(0), 0.0))).alias("t"))
    return cells.unionByName(heads).select("l_orderkey", F.lit(1).alias("page"), "t.*")


@query("monthly_history", MONTHLY_SQL)
def monthly_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = monthly.monthly_history(layout_tokens(spark, sf_dir), ["l_orderkey"])
    return found.select("l_orderkey", "bureau", "place", "month", "status", "month_number")


@query("debt_pairs", """WITH a AS (SELECT c_custkey // 12 AS session, c_custkey AS k, c_custkey % 3 > 0 AS owes, c_acctbal < 0 AS due FROM customer)
SELECT x.session, x.k AS k_a, y.k AS k_b FROM a x JOIN a y ON x.session = y.session AND x.k < y.k WHERE x.owes OR y.owes OR x.due OR y.due""")
def debt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers in sessions of twelve; a third owes nothing, and only negative balances are due."""
    owed = F.when(F.col("c_custkey") % 3 > 0, "$1,200").otherwise(F.element_at(F.array(F.lit("$0.00"), F.lit("n/a"), F.lit("")), (F.col("c_custkey") % 2 + 1).cast("int")))
    due = F.when(F.col("c_acctbal") < 0, F.col("c_acctbal").cast("string")).otherwise("0")
    accounts = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 12).alias("session"), F.col("c_custkey").alias("k"), owed.alias("owed"), due.alias("due"))
    return matching.without_zero_debt(matching.pairs(accounts, "session", "k"), ["owed", "due"]).select("session", "k_a", "k_b")


@query("bureau_items", """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, UNNEST(['a', 'b', 'c']) AS bureau, UNNEST([CASE l_returnflag WHEN 'N' THEN 'missing' ELSE 'aligned' END, CASE l_linestatus WHEN 'O' THEN 'conflict' ELSE 'solo' END, CASE WHEN l_quantity > 25 THEN 'conflict' ELSE 'aligned' END]) AS state FROM lineitem)
SELECT k, n, p, bureau, state FROM s WHERE state IN ('missing', 'conflict')""")
def bureau_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bureau's inventory: lines in which it is missing or differs."""
    states = F.create_map(
        F.lit("a"), F.when(F.col("l_returnflag") == "N", "missing").otherwise("aligned"), F.lit("b"), F.when(F.col("l_linestatus") == "O", "conflict").otherwise("solo"),
        F.lit("c"), F.when(F.col("l_quantity") > 25, "conflict").otherwise("aligned"),
    )
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), states.alias("states"))
    return findings.by_bureau(lines, "states").select("k", "n", "p", "bureau", "state")


@query("lacking_fields", """SELECT o_orderkey, CONCAT_WS(',', CASE WHEN o_orderstatus = 'O' THEN 'name' END, CASE WHEN o_custkey % 5 = 0 THEN 'number' END) AS critical, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'note' END AS optional FROM orders""")
def lacking_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.create_map(
        F.lit("name"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")), F.lit("number"), F.when(F.col("o_custkey") % 5 == 0, "").otherwise("1"), F.lit("note"), F.when(F.col("o_orderkey") % 2 == 0, "x"),
    )
    gone = letters.lacking(context, ["name", "number"], ["note"])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(gone["critical"], ",").alias("critical"), F.array_join(gone["optional"], ",").alias("optional"))


@query("late_totals", """WITH l AS (SELECT l_orderkey, CAST(SUM(l_quantity) FILTER (l_linenumber % 3 = 0) AS BIGINT) AS a, CAST(SUM(l_quantity) FILTER (l_linenumber % 3 = 1) AS BIGINT) AS b, CAST(SUM(l_quantity) FILTER (l_linenumber % 3 = 2) AS BIGINT) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, COALESCE(a, 0) + COALESCE(b, 0) AS late30, COALESCE(c, 0) AS late60, CAST(0 AS BIGINT) AS late90 FROM l WHERE COALESCE(a, 0) + COALESCE(b, 0) + COALESCE(c, 0) > 0""")
def late_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as counters under two spellings of one bucket and one of another."""
    total = lambda k: F.sum(F.when(F.col("l_linenumber") % 3 == k, F.col("l_quantity"))).cast("long").cast("string")
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.create_map(F.lit("30"), total(0), F.lit("Late_30"), total(1), F.lit("60 days"), total(2), F.lit("other"), F.lit("9")).alias("m"))
    found = histories.seven_year(F.col("m"), {"30": "late30", "late 30": "late30", "60 days": "late60"})
    return l.select("l_orderkey", found.alias("f")).where("f is not null").select("l_orderkey", "f.*")


@query("month_directions", """WITH m AS (SELECT l_orderkey, EXTRACT(month FROM l_shipdate) AS m, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity AS q FROM lineitem),
p AS (SELECT *, LAG(m) OVER (PARTITION BY l_orderkey ORDER BY n, p, s, q) AS b FROM m)
SELECT l_orderkey, CASE WHEN SUM(CASE WHEN b IS NULL THEN 0 WHEN b = 12 AND m = 1 THEN 1 WHEN b = 1 AND m = 12 THEN -1 ELSE SIGN(m - b) END) >= 0 THEN 'forward' ELSE 'backward' END AS direction FROM p GROUP BY 1""")
def month_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.month("l_shipdate").alias("m"))
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["m"]).alias("months"))
    return l.select("l_orderkey", sequence.month_direction(F.col("months")).alias("direction"))


@query("token_rows", """WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS y, CAST(l_partkey AS DOUBLE) AS x FROM lineitem WHERE l_quantity IS NOT NULL),
g AS (SELECT *, CASE WHEN y - LAG(y) OVER (PARTITION BY l_orderkey ORDER BY y, x, l_linenumber) > 3 THEN 1 ELSE 0 END AS b FROM t)
SELECT l_orderkey, CAST(SUM(b) AS BIGINT) + 1 AS rows, CAST(COUNT(*) AS BIGINT) AS tokens FROM g GROUP BY 1""")
def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as tokens at the height of their quantity."""
    q, part = F.col("l_quantity"), F.col("l_partkey").cast("double")
    tokens = table(spark, sf_dir, "lineitem").where(q.isNotNull()).select("l_orderkey", q.alias("y0"), q.alias("y1"), part.alias("x0"))
    rows = layout.rows_by_gap(tokens, ["l_orderkey"], 3.0)
    return rows.groupBy("l_orderkey").agg((F.max("row") + 1).alias("rows"), F.count(F.lit(1)).alias("tokens"))
