"""Documents without banned keys, and orders under a rulebook."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.functions import trees
from ledgermend.operators import rulebook
from ledgermend.plans.catalog import query, table

#: An event as a document with its own properties inside; both engines read this.
DOCUMENT_SQL = """'{"id": ' || CAST(event_id AS STRING) || ', "ssn": "' || event_type || '", "in": [' || props || CASE WHEN event_id % 3 = 0 THEN ', {"k": 1, "b": {"ssn": [2], "z": [' || props || ', "k", null]}}' ELSE '' END || '], "e": "' || event_type || '"}'"""
BANNED = ("k", "ssn")


@query("scrubbed_events", """SELECT event_id, '{"e":"' || event_type || '","id":' || CAST(event_id AS VARCHAR) || ',"in":[' || p || CASE WHEN event_id % 3 = 0 THEN ',{"b":{"z":[' || p || ',"k",null]}}' ELSE '' END || ']}' AS doc FROM
(SELECT *, '{' || ARRAY_TO_STRING([TO_JSON(key)::VARCHAR || ':' || JSON_EXTRACT(props, '$."' || key || '"')::VARCHAR FOR key IN LIST_SORT(JSON_KEYS(props)) IF key NOT IN ('k', 'ssn')], ',') || '}' AS p FROM events)""")
def scrubbed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.without_keys(table(spark, sf_dir, "events").select("event_id", F.expr(DOCUMENT_SQL).alias("doc")), "doc", BANNED)


RULES = (
    {"id": "large", "when": {"field": "o_totalprice", "gt": 300000}, "effect": {"action_tag": "review", "priority": "High", "needs_evidence": ["invoice"], "excludes": ["open"]}},
    {"id": "open", "when": {"all": [{"field": "o_orderstatus", "eq": "O"}, {"field": "o_totalprice", "gte": 1000}]}, "effect": {"action_tag": "wait", "priority": "Medium", "suggested_dispute_frame": "pending"}},
    {"id": "urgent", "when": {"any": [{"field": "o_orderpriority", "eq": "1-URGENT"}, {"all": [{"field": "flags.strict", "eq": True}, {"field": "o_orderpriority", "eq": "2-HIGH"}]}]}, "effect": {"rule_hits": ["fast", "large"], "action_tag": "call"}},
    {"id": "plain", "when": {"field": "o_orderstatus", "ne": "P"}, "effect": {"needs_evidence": ["receipt", "invoice"], "suggested_dispute_frame": "standard"}},
    {"id": "odd", "when": {"field": "o_totalprice", "lt": 200000}, "effect": {"action_tag": "note", "priority": "Odd"}},
)


@query("rulebook_actions", """WITH t AS (SELECT *, o_totalprice > 300000 AS r1, o_orderstatus = 'O' AND o_totalprice >= 1000 AS r2, o_orderpriority IN ('1-URGENT', '2-HIGH') AS r3, o_orderstatus <> 'P' AS r4, o_totalprice < 200000 AS r5 FROM orders),
u AS (SELECT *, r3 AS a3 FROM t), v AS (SELECT *, r1 AS a1 FROM u), w AS (SELECT *, r2 AND NOT a1 AS a2 FROM v), x AS (SELECT *, r4 AND NOT a2 AS a4, r5 AND NOT a3 AS a5 FROM w),
h AS (SELECT *, [q FOR q IN [CASE WHEN a3 THEN 'fast' END, CASE WHEN a3 OR a1 THEN 'large' END, CASE WHEN a2 THEN 'open' END, CASE WHEN a4 THEN 'plain' END, CASE WHEN a5 THEN 'odd' END] IF q IS NOT NULL] AS hits,
 CASE WHEN a1 AND a4 THEN ['invoice', 'receipt'] WHEN a1 THEN ['invoice'] WHEN a4 THEN ['receipt', 'invoice'] ELSE [] END AS ev FROM x)
SELECT o_orderkey, ARRAY_TO_STRING(hits, ',') AS rule_hits, ARRAY_TO_STRING(ev, ',') AS needs_evidence, CASE WHEN CONTAINS(LOWER(o_orderpriority), 'late') THEN 'late_payment' ELSE '' END AS red_flags, CASE WHEN a2 THEN 'pending' WHEN a4 THEN 'standard' ELSE '' END AS suggested_dispute_frame,
 CASE WHEN a1 THEN 'review' WHEN a2 THEN 'wait' WHEN a3 THEN 'call' WHEN a5 THEN 'note' ELSE '' END AS action_tag FROM h""")
def rulebook_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained exclusions: a large order isn't open, an open one isn't plain, an urgent one isn't odd."""
    found = rulebook.evaluated(table(spark, sf_dir, "orders"), "o_orderpriority", RULES, ("urgent", "large", "open"), {"open": ["plain"], "urgent": ["odd"]}, {"strict": True})
    joined = [F.array_join(c, ",").alias(c) for c in ("rule_hits", "needs_evidence", "red_flags")]
    return found.select("o_orderkey", *joined, "suggested_dispute_frame", "action_tag")
