"""Ordered checks, branch rules, states and calendars over events, lines and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermend.functions import dates
from ledgermend.operators import findings, outcomes, rules, sequence
from ledgermend.plans.catalog import query, table
from ledgermend.streaming import accounts

SEVERITY_SQL = "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 30 WHEN 'click' THEN 60 WHEN 'purchase' THEN 90 WHEN 'error' THEN 999 END"


def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("severity", F.expr(SEVERITY_SQL))


@query("monotonicity", f"""WITH e AS (SELECT user_id, ts, event_id, {SEVERITY_SQL} AS severity FROM events), l AS (SELECT *, LAG(severity) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM e WHERE severity IS NOT NULL),
d AS (SELECT *, COUNT(*) OVER (PARTITION BY user_id) AS drops, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM l WHERE severity < previous)
SELECT user_id, ts, event_id, previous, severity, CAST(drops AS BIGINT) AS drops FROM d WHERE n = 1""")
def monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.severity_drops(severities(spark, sf_dir), ["user_id"], ["ts", "event_id"], "severity")


@query("islands", """WITH e AS (SELECT user_id, EPOCH(ts) AS s FROM events), g AS (SELECT *, CASE WHEN s - LAG(s) OVER (PARTITION BY user_id ORDER BY s) > 86400 OR LAG(s) OVER (PARTITION BY user_id ORDER BY s) IS NULL THEN 1 ELSE 0 END AS b FROM e),
i AS (SELECT user_id, s, SUM(b) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, CAST(COUNT(*) AS BIGINT) AS events, CAST(FLOOR(MAX(s) - MIN(s)) AS BIGINT) AS seconds FROM i GROUP BY 1, 2""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    numbered = sequence.gap_islands(events, ["user_id"], "s", 86400.0)
    return numbered.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count(F.lit(1)).alias("events"), F.floor(F.max("s") - F.min("s")).alias("seconds"))


@query("debounced_refreshes", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER w >= INTERVAL 30 MINUTE OR LAG(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, SUM(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, MIN(ts) AS first_at, MAX(ts) + INTERVAL 30 MINUTE AS refresh_at, CAST(COUNT(*) AS BIGINT) AS events FROM i GROUP BY user_id, s""")
def debounced_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.debounced(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


@query("latest_stage", """WITH e AS (SELECT user_id, event_type AS stage, MAX(ts) AS seen FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2)
SELECT user_id, ARG_MAX(stage, seen) AS stage, MAX(seen) AS "at" FROM e GROUP BY 1""")
def latest_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermend.operators.analytics import latest_stage as latest

    stages = table(spark, sf_dir, "events").where("event_type in ('view', 'click', 'purchase')").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.max("ts").alias("last_at"))
    return latest(stages.withColumns({"ended_at": F.lit(None).cast("timestamp"), "started_at": F.lit(None).cast("timestamp")}), "user_id", ("view", "click", "purchase"))


CARRY_SQL = """WITH m AS (SELECT o_custkey, o_orderkey, CAST(EXTRACT(month FROM o_orderdate) AS INT) AS mon, CASE WHEN o_orderkey % 4 = 0 THEN CAST(EXTRACT(year FROM o_orderdate) AS INT) END AS anchor FROM orders),
b AS (SELECT *, LAG(mon) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM m),
s AS (SELECT *, SUM(CASE WHEN prev IS NULL THEN 0 WHEN prev = 12 AND mon = 1 THEN 1 WHEN prev = 1 AND mon = 12 THEN -1 ELSE SIGN(mon - prev) END) OVER (PARTITION BY o_custkey) >= 0 AS fwd FROM b),
t AS (SELECT *, SUM(CASE WHEN fwd AND prev = 12 AND mon = 1 THEN 1 WHEN NOT fwd AND prev = 1 AND mon = 12 THEN -1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS turns FROM s),
y AS (SELECT *, COALESCE(LAST_VALUE(anchor - turns IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  FIRST_VALUE(anchor - turns IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) + turns AS yr FROM t)
SELECT o_custkey, o_orderkey, CAST(COALESCE(anchor, yr) AS INT) AS derived_year, CASE WHEN COALESCE(anchor, yr) IS NOT NULL THEN LPAD(CAST(CAST(COALESCE(anchor, yr) AS INT) AS VARCHAR), 4, '0') || '-' || LPAD(CAST(mon AS VARCHAR), 2, '0') END AS month_year_key FROM y"""


@query("carry_years", CARRY_SQL)
def carry_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as months of which every fourth carries a year."""
    months = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.month("o_orderdate").alias("mon"), F.when(F.col("o_orderkey") % 4 == 0, F.year("o_orderdate")).alias("anchor"))
    return sequence.carry_years(months, ["o_custkey"], "o_orderkey", "mon", "anchor").select("o_custkey", "o_orderkey", "derived_year", "month_year_key")


HISTORY_SQL = """h AS (SELECT l_orderkey, LIST({'m': STRFTIME(l_shipdate, '%Y-%m'), 's': CASE CAST(l_quantity AS INT) % 7 WHEN 0 THEN '--' WHEN 1 THEN '30' WHEN 2 THEN '60' WHEN 3 THEN '90' WHEN 4 THEN 'CO' ELSE 'ok' END}
  ORDER BY l_shipdate, l_linenumber, l_quantity, l_partkey, l_suppkey) AS hist FROM lineitem GROUP BY 1),
t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS opened, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + 60 END AS closed, CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 AS INT) AS reported,
  CASE WHEN o_custkey % 3 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 120 AS INT) - 20 END AS paid, o_orderstatus, o_custkey, COALESCE(hist, []) AS hist FROM orders LEFT JOIN h ON l_orderkey = o_orderkey),
q AS (SELECT *, CASE WHEN o_custkey % 11 = 0 THEN 'conflict' WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'unknown' END AS state FROM t)"""

RULES_SQL = f"""WITH {HISTORY_SQL},
x AS (SELECT *, STRFTIME(reported, '%Y-%m') AS ceil_m, STRFTIME(opened, '%Y-%m') AS open_m, STRFTIME(closed, '%Y-%m') AS closed_m, STRFTIME(paid, '%Y-%m') AS paid_m, STRFTIME(CAST(closed + INTERVAL 1 MONTH AS DATE), '%Y-%m') AS forb, LIST_MAX(LIST_FILTER(LIST_TRANSFORM(hist, lambda e: e.m), lambda m: m >= '2000')) AS max_m FROM q)
SELECT o_orderkey, state,
  CASE WHEN opened > reported OR closed > reported OR paid > reported THEN 'conflict' ELSE 'ok' END AS f0_a01,
  CASE WHEN closed < opened OR paid < opened OR reported < opened THEN 'conflict' ELSE 'ok' END AS f0_a02,
  CASE WHEN LEN(hist) = 0 THEN 'skipped_missing_data' WHEN LEN(LIST_FILTER(hist, lambda e: e.m > ceil_m)) > 0 THEN 'conflict' ELSE 'ok' END AS f0_a03,
  CASE WHEN LEN(hist) = 0 THEN 'skipped_missing_data' WHEN LEN(LIST_FILTER(hist, lambda e: e.m < open_m AND e.s <> '--')) > 0 THEN 'conflict' ELSE 'ok' END AS f0_a04,
  CASE WHEN state <> 'open' THEN 'skipped' WHEN LEN(hist) = 0 THEN 'unknown' ELSE 'ok' END AS f2_b01,
  CASE WHEN state <> 'closed' THEN 'skipped' WHEN closed IS NULL THEN 'skipped_missing_data' WHEN paid > closed THEN 'conflict' ELSE 'ok' END AS f2_b02,
  CASE WHEN state = 'open' THEN 'skipped' WHEN closed IS NULL OR LEN(hist) = 0 THEN 'skipped_missing_data' WHEN LEN(LIST_FILTER(hist, lambda e: e.m >= forb AND e.s = 'ok')) > 0 THEN 'conflict' ELSE 'ok' END AS f3_b01,
  CASE WHEN state = 'open' THEN 'skipped' WHEN closed IS NULL OR max_m IS NULL THEN 'skipped_missing_data' WHEN closed_m > max_m THEN 'conflict' ELSE 'ok' END AS f3_b02,
  CASE WHEN paid IS NULL OR max_m IS NULL THEN 'skipped_missing_data' WHEN paid_m > max_m THEN 'conflict' ELSE 'ok' END AS fx_b03 FROM x"""


def tradelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one source's accounts: dates derived from the order, monthly history from its lines."""
    status = F.expr("case int(l_quantity) % 7 when 0 then '--' when 1 then '30' when 2 then '60' when 3 then '90' when 4 then 'CO' else 'ok' end")
    entry = F.struct("l_shipdate", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month_year_key"), status.alias("status"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(entry)).alias("h"))
    opened = F.to_date("o_orderdate")
    history = F.transform(F.coalesce("h", F.array().cast(lines.schema["h"].dataType)), lambda e: F.struct(e["month_year_key"].alias("month_year_key"), e["status"].alias("status")))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(
        "o_orderkey", "o_custkey", opened.alias("date_opened"),
        F.when(F.col("o_orderstatus") != "O", F.date_add(opened, 60)).alias("closed_date"),
        F.date_add(opened, (F.col("o_custkey") % 90).cast("int")).alias("date_reported"),
        F.when(F.col("o_custkey") % 3 > 0, F.date_add(opened, (F.col("o_custkey") % 120).cast("int") - 20)).alias("last_payment"),
        F.when(F.col("o_custkey") % 11 == 0, F.array(F.lit("open"), F.lit("closed"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("Open"), F.lit("--"))).when(F.col("o_orderstatus") == "F", F.array(F.lit("Closed"), F.lit("paid"))).otherwise(F.array(F.lit("pending"), F.lit("--"))).alias("statuses"),
        history.alias("history"),
    )


@query("rule_branches", RULES_SQL)
def rule_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tradelines(spark, sf_dir)
    q1 = rules.account_state({"account_status": F.get("statuses", F.lit(0)), "payment_status": F.get("statuses", F.lit(1))}, ["--"])
    t = t.withColumn("q1", q1).withColumn("r1", rules.route(F.col("q1.declared_state")))
    d = {"date_opened": F.col("date_opened"), "closed_date": F.col("closed_date"), "date_reported": F.col("date_reported"), "last_payment": F.col("last_payment"), "last_verified": F.lit(None).cast("date")}
    number, history = F.col("r1.state_num"), F.col("history")
    named = {
        "f0_a01": rules.time_ceiling(d), "f0_a02": rules.opening_floor(d), "f0_a03": rules.monthly_ceiling(d, history), "f0_a04": rules.monthly_floor(d, history),
        "f2_b01": rules.activity_history(number, history), "f2_b02": rules.post_closure_activity(number, d["closed_date"], [("last_payment", d["last_payment"])]),
        "f3_b01": rules.post_closure_ok(number, d["closed_date"], history), "f3_b02": rules.month_coverage(d["closed_date"], history, rules.in_states(number, [2, 3, 4])),
        "fx_b03": rules.month_coverage(d["last_payment"], history),
    }
    return t.select("o_orderkey", F.col("q1.declared_state").alias("state"), *[c["status"].alias(k) for k, c in named.items()])


LINES_SQL = """l AS (SELECT l_orderkey, STRFTIME(l_shipdate, '%Y-%m') AS m, CAST(l_quantity AS INT) % 7 AS q, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_quantity, l_partkey, l_suppkey) AS pos FROM lineitem)"""

MONTH_SQL = f"""WITH {LINES_SQL},
o AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN STRFTIME(CAST(o_orderdate AS DATE) + CAST(o_custkey % 120 AS INT) - 20, '%Y-%m') END AS paid FROM orders),
j AS (SELECT o_orderkey, m, pos, CASE q WHEN 0 THEN NULL WHEN 1 THEN 30 WHEN 2 THEN 60 WHEN 3 THEN 90 WHEN 4 THEN 999 ELSE 0 END AS s, MIN(CASE WHEN m = paid THEN pos END) OVER (PARTITION BY o_orderkey) AS start FROM o JOIN l ON l_orderkey = o_orderkey),
v AS (SELECT o_orderkey, pos, m, s, LAG(s) OVER (PARTITION BY o_orderkey ORDER BY pos) AS ps, LAG(m) OVER (PARTITION BY o_orderkey ORDER BY pos) AS pm FROM j WHERE pos >= start AND s IS NOT NULL),
f AS (SELECT o_orderkey, ARG_MIN(pm, pos) AS previous_month, ARG_MIN(m, pos) AS month FROM v WHERE s < ps GROUP BY 1),
a AS (SELECT DISTINCT o_orderkey FROM j WHERE start IS NOT NULL)
SELECT o.o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'skipped_missing_data' WHEN f.month IS NOT NULL THEN 'conflict' ELSE 'ok' END AS status, f.previous_month, f.month FROM o LEFT JOIN a ON a.o_orderkey = o.o_orderkey LEFT JOIN f ON f.o_orderkey = o.o_orderkey"""


@query("payment_monotone", MONTH_SQL)
def payment_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tradelines(spark, sf_dir)
    return t.select("o_orderkey", rules.payment_monotone(F.col("last_payment"), F.col("history")).alias("r")).select("o_orderkey", "r.status", "r.previous_month", "r.month")


SEVEN_SQL = f"""WITH {LINES_SQL}, b AS (SELECT l_orderkey, m, MAX(LEAST(q, 3)) AS k, MIN(pos) AS p FROM l WHERE q BETWEEN 1 AND 4 GROUP BY 1, 2),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY k DESC, p) AS n FROM b),
c AS (SELECT l_orderkey, COUNT(*) FILTER (k = 1) AS c1, COUNT(*) FILTER (k = 2) AS c2, COUNT(*) FILTER (k = 3) AS c3, STRING_AGG(m, ',' ORDER BY n) FILTER (n <= 5) AS months FROM r GROUP BY 1)
SELECT o_orderkey, CASE WHEN c1 IS NULL THEN 'skipped_missing_data' WHEN c1 > o_custkey % 3 OR c2 > o_custkey % 2 OR c3 > o_custkey % 4 THEN 'conflict' ELSE 'ok' END AS status,
  CASE WHEN c1 > o_custkey % 3 OR c2 > o_custkey % 2 OR c3 > o_custkey % 4 THEN months END AS examples FROM orders LEFT JOIN c ON l_orderkey = o_orderkey"""


@query("seven_against_two", SEVEN_SQL)
def seven_against_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tradelines(spark, sf_dir)
    counts = {"late30": F.col("o_custkey") % 3, "late60": F.col("o_custkey") % 2, "late90": F.col("o_custkey") % 4}
    r = rules.seven_against_two(counts, F.col("history"))
    return t.select("o_orderkey", r.alias("r")).select("o_orderkey", "r.status", F.array_join("r.examples", ",").alias("examples"))


NEXT_SQL = """WITH e AS (SELECT user_id, MAX(ts) FILTER (event_type = 'purchase') AS sent, ARG_MAX(event_type, ts) FILTER (event_type IN ('click', 'error', 'view')) AS outcome FROM events GROUP BY 1),
s AS (SELECT user_id, sent, CASE WHEN sent IS NULL THEN 'PLANNED' ELSE 'SENT' END AS status, CASE outcome WHEN 'click' THEN 'verified' WHEN 'error' THEN 'updated' END AS outcome FROM e)
SELECT user_id, status, CASE WHEN outcome = 'verified' THEN 'mov,direct_dispute' WHEN outcome = 'updated' THEN 'bureau_dispute' WHEN status = 'PLANNED' THEN 'dispute' WHEN TIMESTAMP '2024-01-20 00:00:00' >= sent + INTERVAL 30 DAY THEN 'followup' ELSE '' END AS tags,
  CASE WHEN outcome IS NULL AND status = 'SENT' AND TIMESTAMP '2024-01-20 00:00:00' < sent + INTERVAL 30 DAY THEN sent + INTERVAL 30 DAY END AS next_eligible_at FROM s"""


@query("next_steps", NEXT_SQL)
def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as accounts: purchases are letters sent, the last click or error an outcome."""
    kind = F.col("event_type")
    state = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(kind == "purchase", F.col("ts"))).alias("sent"), F.max(F.when(kind.isin("click", "error", "view"), F.struct("ts", "event_type"))).alias("last"))
    state = state.withColumn("status", F.when(F.col("sent").isNull(), "PLANNED").otherwise("SENT")).withColumn("outcome", F.when(F.col("last.event_type") == "click", "verified").when(F.col("last.event_type") == "error", "updated"))
    step = outcomes.next_step(F.col("status"), F.col("outcome"), F.col("sent"), F.lit(None).cast("timestamp"), F.to_timestamp(F.lit("2024-01-20 00:00:00")))
    return state.select("user_id", "status", step.alias("x")).select("user_id", "status", F.array_join("x.tags", ",").alias("tags"), F.col("x.next_eligible_at").alias("next_eligible_at"))


@query("account_states", """WITH e AS (SELECT user_id, ts, event_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type IN ('purchase', 'click', 'error')),
l AS (SELECT *, LAG(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e WHERE event_type = 'purchase')
SELECT CAST(e.user_id AS VARCHAR) AS account_id, CASE ARG_MAX(event_type, event_id) WHEN 'purchase' THEN 'SENT' WHEN 'click' THEN 'CRA_RESPONDED_VERIFIED' ELSE 'CRA_RESPONDED_UPDATED' END AS status,
  CAST(COUNT(*) FILTER (event_type = 'purchase') AS INT) AS step, ARG_MAX(ts, event_id) FILTER (event_type = 'purchase') AS last_sent,
  CAST(COALESCE((SELECT COUNT(*) FROM l WHERE l.user_id = e.user_id AND l.ts > before + INTERVAL 30 DAY), 0) AS INT) AS violations FROM e GROUP BY e.user_id""")
def account_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine folded over each user's events in the order of event_id; the stream gives the same rows."""
    events = table(spark, sf_dir, "events").where("event_type in ('purchase', 'click', 'error')")
    name = F.when(F.col("event_type") == "purchase", "send").when(F.col("event_type") == "click", "verified").otherwise("updated")
    moves = events.select(F.col("user_id").cast("string").alias("account_id"), F.col("event_id").alias("seq"), name.alias("event"), F.col("ts").alias("at"))
    return final_states(moves)


def final_states(moves: DataFrame) -> DataFrame:
    """The last state of each account in batch form, by windows instead of state."""
    w = Window.partitionBy("account_id").orderBy("seq")
    sent = moves.where("event = 'send'").withColumn("before", F.lag("at").over(w))
    late = F.count_if(F.col("at") > F.col("before") + F.expr("interval 30 days")).cast("int")
    sends = sent.groupBy("account_id").agg(F.count(F.lit(1)).cast("int").alias("step"), F.max_by("at", "seq").alias("last_sent"), late.alias("violations"))
    last = moves.groupBy("account_id").agg(F.max_by("event", "seq").alias("event"))
    status = F.when(F.col("event") == "send", "SENT").otherwise(F.concat(F.lit("CRA_RESPONDED_"), F.upper("event")))
    return last.join(sends, "account_id", "left").select("account_id", status.alias("status"), F.coalesce("step", F.lit(0)).alias("step"), "last_sent", F.coalesce("violations", F.lit(0)).alias("violations"))


BUSINESS_SQL = """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 20 AS INT) AS n FROM orders),
c AS (SELECT o_orderkey, d, n, CAST(d + CAST(g AS INT) AS DATE) AS x, CAST(g AS INT) AS g FROM o, RANGE(-60, 61) r(g)), b AS (SELECT *, ISODOW(x) < 6 AS open FROM c)
SELECT o_orderkey, n, CASE WHEN n = 0 THEN d ELSE MIN(x) FILTER (open AND g > 0 AND fwd = n) END AS advanced, CASE WHEN n = 0 THEN d ELSE MAX(x) FILTER (open AND g < 0 AND bwd = n) END AS subtracted,
  CASE WHEN n = 0 THEN 0 ELSE CAST(MIN(g) FILTER (open AND g >= 0 AND here = n) + 1 AS INT) END AS calendar_days, MIN(x) FILTER (open AND g >= 0) AS rolled, CAST(COUNT(*) FILTER (open AND g BETWEEN 1 AND 45) AS INT) AS open_days
FROM (SELECT *, SUM(CASE WHEN open AND g > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderkey ORDER BY g) AS fwd, SUM(CASE WHEN open AND g >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderkey ORDER BY g) AS here,
  SUM(CASE WHEN open AND g < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderkey ORDER BY g DESC) AS bwd FROM b) GROUP BY o_orderkey, d, n"""


@query("business_days", BUSINESS_SQL)
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = F.to_date("o_orderdate"), (F.col("o_orderkey") % 20).cast("int")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", n.alias("n"), dates.advance_business_days(d, n).alias("advanced"), dates.subtract_business_days(d, n).alias("subtracted"),
        dates.business_to_calendar(d, n).alias("calendar_days"), dates.roll_forward(d)["day"].alias("rolled"), dates.business_days_between(d, F.date_add(d, 45)).alias("open_days"),
    )


RANK_SQL = """WITH f AS (SELECT p_partkey // 8 AS k, p_partkey, p_name AS field, CASE p_partkey % 5 WHEN 0 THEN 'status' WHEN 1 THEN 'activity' WHEN 2 THEN 'terms' WHEN 3 THEN 'history' ELSE 'other' END AS category, p_size AS min_days,
  CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS bonus, CAST(p_partkey % 4 AS INT) AS present, CASE p_partkey % 4 WHEN 0 THEN 'opener' WHEN 1 THEN 'supporter' WHEN 2 THEN 'opener' ELSE 'skipped' END AS role FROM part)
SELECT k, p_partkey, role, min_days + bonus AS score, CAST(ROW_NUMBER() OVER (PARTITION BY k, role ORDER BY min_days + bonus DESC, min_days DESC, present DESC, CASE category WHEN 'status' THEN 1 WHEN 'activity' THEN 2 WHEN 'terms' THEN 3 WHEN 'history' THEN 4 ELSE 5 END, bonus DESC, field, p_partkey) AS INT) AS place FROM f"""


@query("findings_rank", RANK_SQL)
def findings_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(
        F.floor(key / 8).alias("k"), "p_partkey", F.concat("p_name", F.lit(" "), F.lpad(key.cast("string"), 12, "0")).alias("field"),
        F.element_at(F.array(*[F.lit(c) for c in ("status", "activity", "terms", "history", "other")]), (key % 5 + 1).cast("int")).alias("category"),
        F.col("p_size").alias("min_days"), F.element_at(F.array(*[F.lit(c) for c in ("C5_ALL_DIFF", "C4_TWO_MATCH_ONE_DIFF", "C2_ONE_MISSING")]), (key % 3 + 1).cast("int")).alias("reason_code"),
        (key % 4).cast("int").alias("present_count"), F.array().cast("array<string>").alias("documents"), F.array().cast("array<string>").alias("bureaus"),
        F.element_at(F.array(*[F.lit(c) for c in ("strong_actionable", "support_paired", "dispute_primary", "no_case")]), (key % 4 + 1).cast("int")).alias("default_decision"),
    )
    return findings.rank(parts, "k").select("k", "p_partkey", "role", "score", "place")


@query("stronger_items", """WITH r AS (SELECT p_brand, p_type, p_partkey, p_size, p_retailprice, ROW_NUMBER() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS n FROM part)
SELECT p_brand, p_type, p_partkey FROM r WHERE n = 1""")
def stronger_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_partkey").alias("order_index"), F.col("p_size").alias("strength"), F.col("p_retailprice").alias("min_days"))
    return findings.stronger(items, ["p_brand", "p_type"]).select("p_brand", "p_type", F.col("order_index").alias("p_partkey"))


@query("weakest_inner", """WITH r AS (SELECT *, p_partkey // 8 AS account, MIN(p_partkey) OVER w AS lo, MAX(p_partkey) OVER w AS hi FROM part WINDOW w AS (PARTITION BY p_partkey // 8)),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY account ORDER BY p_size, p_retailprice, p_partkey) AS n FROM r WHERE p_partkey > lo AND p_partkey < hi)
SELECT account, p_partkey AS order_index, p_size AS strength FROM n WHERE n = 1""")
def weakest_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 8).alias("account"), F.col("p_partkey").alias("order_index"), F.col("p_size").alias("strength"), F.col("p_retailprice").alias("min_days"))
    return findings.weakest_inner(items, ["account"])


@query("turn_blocks", """WITH b AS (SELECT conv_id, turn, role, SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) + CASE WHEN FIRST_VALUE(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' THEN 0 ELSE 1 END AS block FROM conversations)
SELECT conv_id, CAST(block AS BIGINT) AS block, MIN(turn) AS first_turn, MAX(turn) AS last_turn, CAST(COUNT(*) AS BIGINT) AS turns FROM b GROUP BY 1, 2""")
def turn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = sequence.islands(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", "block")
    return turns.groupBy("conv_id", F.col("block").cast("long").alias("block")).agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("turns"))


@query("look_back", """SELECT conv_id, turn, LAST_VALUE(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS asked_at FROM conversations""")
def look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return sequence.look_back(turns, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), 3, "asked_at").select("conv_id", "turn", "asked_at")


@query("head_and_tail", """WITH h AS (SELECT user_id, LIST(event_type ORDER BY ts, event_id) AS l FROM events GROUP BY 1)
SELECT user_id, ARRAY_TO_STRING(l[1:6], ',') AS first, ARRAY_TO_STRING(l[GREATEST(LEN(l) - 5, 1):], ',') AS last FROM h""")
def head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequence.ends(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return found.select("user_id", F.array_join("first", ",").alias("first"), F.array_join("last", ",").alias("last"))
