"""Letter routing and strategy merges over orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.operators import letters
from ledgermend.plans.catalog import query, table

ROUTING_SQL = """WITH o AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'dispute' WHEN '2-HIGH' THEN 'mov' WHEN '3-MEDIUM' THEN 'bureau_dispute' WHEN '4-NOT SPECIFIED' THEN 'goodwill' ELSE 'other' END AS tag, o_orderstatus = 'O' AS known FROM orders)
SELECT o_orderkey, CASE tag WHEN 'dispute' THEN 'dispute_letter_template.html' WHEN 'mov' THEN 'mov_letter_template.html' WHEN 'bureau_dispute' THEN 'bureau_dispute_letter_template.html' WHEN 'goodwill' THEN 'goodwill_letter_template.html' END AS template,
  CASE tag WHEN 'dispute' THEN CASE WHEN known THEN '' ELSE 'bureau' END WHEN 'mov' THEN 'account_number_masked,legal_safe_summary,cra_last_result,days_since_cra_result'
  WHEN 'bureau_dispute' THEN 'account_number_masked,' || CASE WHEN known THEN '' ELSE 'bureau,' END || 'legal_safe_summary' WHEN 'goodwill' THEN 'creditor' ELSE '' END AS missing FROM o"""


@query("letter_routing", ROUTING_SQL)
def letter_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as actions; open orders know their bureau, all know the creditor's name."""
    tags = F.create_map(*[F.lit(x) for p in {"1-URGENT": "dispute", "2-HIGH": "MOV ", "3-MEDIUM": "bureau_dispute", "4-NOT SPECIFIED": "goodwill", "5-LOW": "other"}.items() for x in p])
    context = F.create_map(F.lit("creditor_name"), F.lit("x"), F.lit("bureau"), F.when(F.col("o_orderstatus") == "O", "TU"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", letters.routed(F.try_element_at(tags, F.col("o_orderpriority")), context).alias("r"))
    return found.select("o_orderkey", "r.template", F.array_join("r.missing", ",").alias("missing"))


MERGE_SQL = """WITH p AS (SELECT s_name, LPAD(CAST(s_suppkey AS VARCHAR), 4, '0') AS four, s_nationkey FROM supplier),
a AS (SELECT c_custkey, LPAD(CAST(c_custkey % 500 AS VARCHAR), 4, '0') AS four FROM customer), l AS (SELECT four, ARG_MAX(CASE s_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'dispute' ELSE 'sing' END, four) AS act, COUNT(*) AS n, MAX(s_nationkey % 3) AS k FROM p GROUP BY 1)
SELECT c_custkey, CASE WHEN l.k = 1 THEN 'dispute' END AS action_tag, CASE WHEN l.four IS NULL THEN 'missing_input' WHEN l.k = 0 THEN 'empty_output' WHEN l.k = 2 THEN 'unrecognized_format' END AS failure_reason FROM a LEFT JOIN l ON a.four = l.four"""


@query("strategy_merge", MERGE_SQL)
def strategy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as strategy rows and customers as accounts of one creditor, joined on four digits."""
    bank = F.lit("Acme Bank")
    plan = table(spark, sf_dir, "supplier").select(bank.alias("name"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0").alias("account_number"), F.col("s_suppkey").alias("seq"), F.when(F.col("s_nationkey") % 3 == 1, "Dispute").when(F.col("s_nationkey") % 3 == 2, "sing").alias("recommended_action"))
    accounts = table(spark, sf_dir, "customer").select("c_custkey", F.lit("ACME").alias("name"), F.concat(F.lit("****-"), F.lpad((F.col("c_custkey") % 500).cast("string"), 4, "0")).alias("account_number"))
    return letters.with_strategy(accounts, plan, [("acme", "acme bank")], {"dispute": "dispute", "follow up": "mov"}).select("c_custkey", "action_tag", "failure_reason")
