"""Metrics reports, counters, views and exports over orders, lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.functions import predicates
from ledgermend.operators import analytics, sequence
from ledgermend.plans.catalog import query, table
from ledgermend.sources import records

SAMPLES_SQL = """s AS (SELECT o_orderpriority AS tag, l_returnflag AS template, l_quantity AS render_ms, l_extendedprice AS ai_cost,
  CASE WHEN l_linenumber % 2 = 0 THEN ['ssn', 'address'] ELSE ['address'] END AS missing1, CASE WHEN l_partkey % 10 = 0 THEN ['name'] ELSE [] END AS failed,
  CASE WHEN l_suppkey % 3 = 0 THEN ['phone'] ELSE [] END AS missing2, CASE WHEN l_quantity > 45 THEN ['tone down', 'drop claim'] ELSE [] END AS cleaned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rendered letters: priority is the action tag, return flag the template, quantity the time, price the cost."""
    none = F.array().cast("array<string>")
    some = lambda *names: F.array(*[F.lit(n) for n in names])
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_orderpriority").alias("action_tag"), F.col("l_returnflag").alias("template"), F.col("l_quantity").alias("render_ms"), F.col("l_extendedprice").alias("ai_cost"),
        F.when(F.col("l_linenumber") % 2 == 0, some("ssn", "address")).otherwise(some("address")).alias("candidate_missing_fields"),
        F.when(F.col("l_partkey") % 10 == 0, some("name")).otherwise(none).alias("validation_failed_fields"),
        F.when(F.col("l_suppkey") % 3 == 0, some("phone")).otherwise(none).alias("final_missing_fields"),
        F.when(F.col("l_quantity") > 45, some("tone down", "drop claim")).otherwise(none).alias("sanitizer_overrides"),
    )


REPORT_SQL = f"""WITH {SAMPLES_SQL},
p AS (SELECT template, 'render' AS what, LIST_SORT(LIST(render_ms)) AS v, AVG(render_ms) AS a FROM s GROUP BY 1 UNION ALL SELECT template, 'ai', LIST_SORT(LIST(ai_cost)), AVG(ai_cost) FROM s GROUP BY 1)
SELECT section, category, item, '' AS extra, ROUND(CAST(value AS DOUBLE), 6) AS value FROM (
SELECT 'finalization_pass_rate' AS section, tag AS category, '' AS item, COUNT(*) FILTER (LEN(failed) = 0) / COUNT(*)::DOUBLE AS value FROM s GROUP BY tag UNION ALL
SELECT 'missing_fields_after_normalization', tag, f, COUNT(*) FROM (SELECT tag, UNNEST(missing1) AS f FROM s) GROUP BY 1, 2, 3 UNION ALL
SELECT 'missing_fields_after_strategy', tag, f, COUNT(*) FROM (SELECT tag, UNNEST(missing2) AS f FROM s) GROUP BY 1, 2, 3 UNION ALL
SELECT 'validation_failed', template, f, COUNT(*) FROM (SELECT template, UNNEST(failed) AS f FROM s) GROUP BY 1, 2, 3 UNION ALL
SELECT 'sanitizer_applied_rate', template, '', COUNT(*) FILTER (LEN(cleaned) > 0) / COUNT(*)::DOUBLE FROM s GROUP BY template UNION ALL
SELECT 'policy_override_reason', template, REPLACE(f, ' ', '_'), COUNT(*) FROM (SELECT template, UNNEST(cleaned) AS f FROM s) GROUP BY 1, 2, 3 UNION ALL
SELECT CASE what WHEN 'render' THEN 'render_latency_avg_ms' ELSE 'ai_cost_avg' END, template, '', a FROM p UNION ALL
SELECT CASE what WHEN 'render' THEN 'render_latency_p95_ms' ELSE 'ai_cost_p95' END, template, '', v[GREATEST(1, CAST(FLOOR(LEN(v) * 95.0::DOUBLE / 100) AS INT))] FROM p)"""


@query("batch_report", REPORT_SQL)
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = analytics.batch_report(samples(spark, sf_dir))
    return report.withColumn("value", F.round("value", 6))


@query("percentile_floor", "SELECT o_orderpriority, v[GREATEST(1, CAST(FLOOR(LEN(v) * 0.95::DOUBLE) AS INT))] AS p95 FROM (SELECT o_orderpriority, LIST_SORT(LIST(o_totalprice)) AS v FROM orders GROUP BY 1)")
def percentile_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.floor_rank(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 95, "p95")


@query("percentile_ceil", "SELECT o_orderpriority, QUANTILE_DISC(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1")
def percentile_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.nearest_rank(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 95, "p95")


@query("heatmap", "SELECT event_type AS tag, STRFTIME(ts, '%Y-%m-%d') AS field, CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), F.array(F.date_format("ts", "yyyy-MM-dd")).alias("days"))
    return analytics.heatmap(rows, "tag", "days")


COUNTER_SQL = """e AS (SELECT 'router.missing_fields.' || event_type || '.tpl' || (user_id % 3) || '.f' || (event_id % 5) AS name, value FROM events UNION ALL
  SELECT 'router.skipped.' || event_type, 1 FROM events UNION ALL SELECT 'router.missing_fields.finalize.' || event_type || '.x', 1 FROM events)"""


def emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("details")
    first = e.select(F.concat(F.lit("router.missing_fields."), "event_type", F.lit(".tpl"), (F.col("user_id") % 3).cast("string"), F.lit(".f"), (F.col("event_id") % 5).cast("string")).alias("name"), F.lit(1.0).alias("increment"), none)
    second = e.select(F.concat(F.lit("router.skipped."), "event_type").alias("name"), F.lit(None).cast("double").alias("increment"), F.create_map(F.lit("bureau"), (F.col("user_id") % 3).cast("string"), F.lit("noise"), F.lit("x")).alias("details"))
    third = e.select(F.concat(F.lit("router.missing_fields.finalize."), "event_type", F.lit(".x")).alias("name"), F.lit(1.0).alias("increment"), none)
    return first.union(second).union(third)


@query("counters", """WITH n AS (SELECT 'router.missing_fields.' || event_type || '.tpl' || (user_id % 3) || '.f' || (event_id % 5) AS name FROM events UNION ALL SELECT 'router.skipped.' || event_type FROM events
UNION ALL SELECT 'router.skipped.' || event_type || '.bureau.' || (user_id % 3) FROM events UNION ALL SELECT 'router.missing_fields.finalize.' || event_type || '.x' FROM events) SELECT name, CAST(COUNT(*) AS DOUBLE) AS value FROM n GROUP BY 1""")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.counters(emitted(spark, sf_dir))


@query("missing_field_heatmap", "SELECT event_type AS tag, 'f' || (event_id % 5) AS field, CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def missing_field_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.missing_field_counts(counters(spark, sf_dir))


@query("router_skips", "SELECT event_type AS tag, CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1 UNION ALL SELECT event_type || '.bureau.' || (user_id % 3), CAST(COUNT(*) AS BIGINT) FROM events GROUP BY 1")
def router_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.skipped_counts(counters(spark, sf_dir))


@query("gauges", "SELECT event_type AS name, ARG_MAX(value, event_id) AS value FROM events GROUP BY 1")
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.gauges(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value", "event_id"), "event_id")


@query("usage_totals", "SELECT event_type, CAST(SUM(user_id) AS BIGINT) AS tokens, ROUND(SUM(value), 2) AS cost, CAST(COUNT(*) AS BIGINT) AS calls FROM events GROUP BY 1")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.usage_totals(table(spark, sf_dir, "events"), ["event_type"], "user_id", "value")


GUARD_SQL = """WITH t AS (SELECT 't' || (user_id % 7) AS template, COUNT(*) FILTER (event_type = 'view') AS total, COUNT(*) FILTER (event_type = 'error') AS fails,
  COUNT(*) FILTER (event_type = 'click') AS sanitized FROM events GROUP BY 1)
SELECT template, (total > 0 AND (fails >= 0.01 * total OR sanitized > 0.9 * total)) AS breached FROM t WHERE total + fails + sanitized > 0"""


@query("guardrails", GUARD_SQL)
def guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")))
    prefix = F.when(F.col("event_type") == "view", "router.finalized.").when(F.col("event_type") == "error", "validation.failed.").when(F.col("event_type") == "click", "sanitizer.applied.")
    counts = e.where(prefix.isNotNull()).groupBy(F.concat(prefix, "t").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return analytics.guardrails(counts, 1e9, 0.9).select("template", "breached")


@query("eval_change", """WITH a AS (SELECT event_type AS metric, AVG(value) AS pre FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, AVG(value) AS post FROM events WHERE user_id % 2 = 1 GROUP BY 1)
SELECT COALESCE(a.metric, b.metric) AS metric, ROUND(COALESCE(pre, 0), 6) AS pre, ROUND(COALESCE(post, 0), 6) AS post, ROUND(COALESCE(post, 0) - COALESCE(pre, 0), 6) AS delta FROM a FULL OUTER JOIN b ON a.metric = b.metric""")
def eval_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("metric"), "value")
    found = analytics.eval_change(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1"))
    return found.select("metric", *[F.round(c, 6).alias(c) for c in ("pre", "post", "delta")])


@query("stage_counts", """WITH s AS (SELECT o_orderpriority AS stage, COUNT(*) AS total, COUNT(*) FILTER (o_orderstatus = 'F') AS done, COUNT(*) FILTER (o_orderstatus = 'P') AS pend FROM orders GROUP BY 1)
SELECT stage, CAST(total AS BIGINT) AS total, CAST(LEAST(done, total) AS BIGINT) AS completed, CAST(GREATEST(pend, total - done) AS BIGINT) AS pending FROM s""")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "pending").otherwise("running")
    return analytics.stage_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage"), status.alias("status")))


@query("sampled_steps", """WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS ok, ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM s WHERE NOT ok OR n = 1 OR n % 4 = 0""")
def sampled_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "success").otherwise("error"))
    return analytics.sampled_steps(steps, ["o_custkey"], ["o_orderkey"], 4).select("o_custkey", "o_orderkey")


@query("views_export", """SELECT 's' || (o_custkey % 10) AS session_id, 'f' || o_custkey AS family_id, o_orderpriority AS action_tag, o_orderkey % 5 AS cycle_id, o_orderstatus AS outcome, CASE WHEN o_orderstatus = 'O' THEN 'SENT' ELSE 'COMPLETED' END AS planner_status,
CAST(o_orderdate AS VARCHAR) AS last_sent_at, NULL::VARCHAR AS next_eligible_at FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 5 BETWEEN 1 AND 3 AND o_orderdate >= TIMESTAMP '1995-01-01'""")
def views_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as planner outcomes, filtered like an export: membership, a cycle range and a start."""
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), (F.col("o_custkey") % 10).cast("string")).alias("session_id"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("family_id"),
        F.col("o_orderpriority").alias("action_tag"), (F.col("o_orderkey") % 5).alias("cycle_id"), F.col("o_orderstatus").alias("outcome"),
        F.when(F.col("o_orderstatus") == "O", "SENT").otherwise("COMPLETED").alias("planner_status"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("last_sent_at"),
        F.lit(None).cast("string").alias("next_eligible_at"), "o_orderdate",
    )
    wanted = predicates.ExportFilter(members={"action_tag": ["1-URGENT", "2-HIGH"]}, ranges={"cycle_id": (1, 3)})
    return records.export_rows(orders.where(F.col("o_orderdate") >= F.to_timestamp(F.lit("1995-01-01 00:00:00"))), wanted)


@query("outcome_view", """SELECT CAST(o_custkey AS VARCHAR) AS session_id, CAST(o_orderkey AS VARCHAR) AS account_id, NULL::VARCHAR AS family_id, NULL::VARCHAR AS tri_merge_snapshot_id, o_orderpriority AS plan_id, NULL::VARCHAR AS step_id, o_orderstatus AS outcome_id, o_orderkey % 4 AS cycle_id FROM orders""")
def outcome_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.export_view(table(spark, sf_dir, "orders"), {"session_id": F.col("o_custkey"), "account_id": F.col("o_orderkey"), "plan_id": F.col("o_orderpriority"), "outcome_id": F.col("o_orderstatus"), "cycle_id": F.col("o_orderkey") % 4})


@query("canary", """SELECT DISTINCT user_id, CAST(CAST('0x' || SUBSTR(SHA256(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS BIGINT) AS bucket, CAST('0x' || SUBSTR(SHA256(CAST(user_id AS VARCHAR)), 1, 4) AS BIGINT) % 100 < 20 AS validation FROM events""")
def canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", predicates.hash_bucket(F.col("user_id")).alias("bucket"), predicates.sampled(F.col("user_id"), 20, 4).alias("validation"))


@query("compiled_rule", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus = 'O') OR (o_orderpriority <> '5-LOW' AND o_totalprice <= 20000)")
def compiled_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"any": [
        {"all": [{"field": "o_totalprice", "gt": 100000}, {"field": "o_orderstatus", "eq": "O"}]},
        {"all": [{"not": {"field": "o_orderpriority", "eq": "5-LOW"}}, {"field": "o_totalprice", "lte": 20000}]},
    ]}
    return table(spark, sf_dir, "orders").where(predicates.compiled(rule)).select("o_orderkey")


@query("json_props", """SELECT event_id, CAST(LEN(json_keys(props)) AS INT) AS n_keys, md5(ARRAY_TO_STRING(LIST_SORT(json_keys(props)), ',')) AS key_hash FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.size(keys).alias("n_keys"), F.md5(F.array_join(F.array_sort(keys), ",").cast("binary")).alias("key_hash"))
