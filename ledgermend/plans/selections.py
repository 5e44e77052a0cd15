"""Top reasons and issues over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.operators import picks
from ledgermend.plans.catalog import query, table


@query("top_reasons", "WITH c AS (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) SELECT user_id, event_type, CAST(n AS BIGINT) AS n FROM r WHERE k = 1")
def top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.top_reason(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("primary_issues", """WITH s AS (SELECT o_custkey, LIST(DISTINCT o_orderpriority) AS l FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN LIST_CONTAINS(l, '1-URGENT') THEN '1-URGENT' WHEN LIST_CONTAINS(l, '4-NOT SPECIFIED') THEN '4-NOT SPECIFIED' WHEN LIST_CONTAINS(l, '2-HIGH') THEN '2-HIGH' ELSE 'unknown' END AS issue FROM s""")
def primary_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("l"))
    return held.select("o_custkey", picks.primary_issue(F.col("l"), ("1-URGENT", "4-NOT SPECIFIED", "2-HIGH")).alias("issue"))


@query("resolution_rate", "SELECT AVG(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS resolution_rate, AVG(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 4 END) AS avg_cycles FROM orders")
def resolution_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("SENT")
    return picks.resolution(table(spark, sf_dir, "orders").select(status.alias("status"), (F.col("o_orderkey") % 4).alias("cycle")))
