"""Layout, fuzzy matching, page texts and schedules over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.functions import pages, text
from ledgermend.operators import layout, planning, similarity
from ledgermend.plans.catalog import query, table
from ledgermend.plans.links import matched_sql


@query("band_assign", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN (l_quantity + l_quantity + 4) / 2 >= 40 THEN 'eq' WHEN l_quantity + 2 >= 25 THEN 'xp' WHEN l_quantity + 2 >= 10 THEN 'tu' WHEN l_quantity + 2 >= 5 THEN 'label' ELSE 'none' END AS band FROM lineitem""")
def band_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", layout.band(F.col("l_quantity"), F.col("l_quantity") + 4, (5.0, 10.0, 25.0, 40.0)).alias("band"))


@query("best_overlap", """WITH t AS (SELECT l_orderkey AS k, l_linenumber % 2 AS side, l_partkey AS id, MIN(l_quantity) AS lo, MIN(l_quantity) + 10 AS hi FROM lineitem GROUP BY 1, 2, 3),
j AS (SELECT a.k, a.id AS left_id, b.id AS right_id, LEAST(a.hi, b.hi) - GREATEST(a.lo, b.lo) AS overlap FROM t a JOIN t b ON a.k = b.k AND a.side = 0 AND b.side = 1),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k, left_id ORDER BY overlap DESC, right_id) AS n FROM j WHERE overlap > 0) SELECT k, left_id, right_id, overlap FROM n WHERE n = 1""")
def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as tokens of two rows, each [quantity, quantity + 10] wide."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 2).alias("side"), F.col("l_partkey").alias("id")).agg(F.min("l_quantity").alias("lo"))
    t = t.withColumn("hi", F.col("lo") + 10)
    return layout.best_overlap(t.where("side = 0").withColumnRenamed("id", "left_id"), t.where("side = 1").withColumnRenamed("id", "right_id"), ["k"], "left_id", "right_id")


@query("nearest_column", "SELECT p_partkey, CASE WHEN ABS(p_size - 10) <= ABS(p_size - 25) AND ABS(p_size - 10) <= ABS(p_size - 40) THEN 0 WHEN ABS(p_size - 25) <= ABS(p_size - 40) THEN 1 ELSE 2 END AS k FROM part")
def nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", layout.nearest_column(F.col("p_size"), (10.0, 25.0, 40.0)).alias("k"))


@query("packed_tokens", """WITH t AS (SELECT p_partkey, STRING_SPLIT_REGEX(TRIM(p_type), '\\s+') AS parts FROM part)
SELECT p_partkey, parts[k] AS text, ROUND((k - 1) * 100.0::DOUBLE / LEN(parts), 9) AS x0, ROUND(k * 100.0::DOUBLE / LEN(parts), 9) AS x1 FROM (SELECT *, UNNEST(RANGE(1, LEN(parts) + 1)) AS k FROM t)""")
def packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("text"), F.lit(0.0).alias("x0"), F.lit(100.0).alias("x1"))
    out = layout.expand_packed(tokens)
    return out.select("p_partkey", "text", F.round("x0", 9).alias("x0"), F.round("x1", 9).alias("x1"))


@query("late_indicators", """SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN TRUE WHEN event_type = 'view' THEN FALSE WHEN event_type = 'signup' THEN FALSE WHEN event_type = 'click' THEN TRUE ELSE FALSE END AS late FROM events""")
def late_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    counts = F.when((F.col("event_type") == "error") & (F.col("value") > 50), 2).otherwise(0)
    flags = F.when(F.col("event_type") == "view", F.array(F.lit("Late Payments"))).otherwise(F.array().cast("array<string>"))
    words = F.when(F.col("event_type") == "signup", "never late").when(F.col("event_type") == "click", "30 days past due").otherwise("paid as agreed")
    return e.select("event_id", layout.late_indicator(counts, flags, words).alias("late"))


VALUES_SQL = """WITH v AS (SELECT p_partkey, UNNEST([p_name, p_type, '$ ' || CAST(p_size AS VARCHAR), CAST(p_size % 28 + 1 AS VARCHAR) || '.' || CAST(p_size % 12 + 1 AS VARCHAR) || '.2024 paid', '****' || CAST(p_partkey AS VARCHAR),
  CAST(p_size + 10 AS VARCHAR) || ' month(s)x', 'Paid as agreed', 'CHARGEOFF ' || p_brand, 'Jan ' || CAST(p_size AS VARCHAR), CAST(30 * (p_size % 8) AS VARCHAR), '  ']) AS t FROM part),
c AS (SELECT p_partkey, t, TRIM(COALESCE(t, '')) AS z, LOWER(TRIM(COALESCE(t, ''))) AS l FROM v)
SELECT p_partkey, t AS value, CASE WHEN z = '' THEN 'empty' WHEN REGEXP_MATCHES(z, '\\$\\s*\\d') THEN 'money' WHEN REGEXP_MATCHES(z, '\\b\\d{1,2}[./]\\d{1,2}[./]\\d{2,4}\\b') THEN 'date' WHEN REGEXP_MATCHES(l, '\\b\\d{2,4}\\s*month\\(s\\)\\b') THEN 'term'
  WHEN l IN ('late', 'ok', '120', '90', '60', '30', 'co', 'cof', 'joint', 'authorized user', 'co-signer', 'authorized', 'authorizeduser', 'bank - mortgage loans', 'mortgage companies - finance', 'bank', 'credit card', 'auto loan')
    OR REGEXP_MATCHES(l, 'chargeoff|collection|closed|current|paid|individual|open|delinquent') THEN 'enum' WHEN REGEXP_MATCHES(l, 'mortgage|loan|card|finance|bank|company') THEN 'text' WHEN REGEXP_MATCHES(l, '\\b[0-9*]{4,}\\b') THEN 'id' ELSE 'text' END AS kind,
  l IN ('ok', '30', '60', '90', '120', '150', '180') OR REGEXP_MATCHES(l, '^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)') AS is_history FROM c"""


@query("value_types", VALUES_SQL)
def value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every text of a part, and of numbers, dates and statuses made from its columns."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    as_text = lambda c: c.cast("string")
    values = [
        F.col("p_name"), F.col("p_type"),
        F.concat(F.lit("$ "), as_text(size)), F.concat(as_text(size % 28 + 1), F.lit("."), as_text(size % 12 + 1), F.lit(".2024 paid")), F.concat(F.lit("****"), key), F.concat(as_text(size + 10), F.lit(" month(s)x")),
        F.lit("Paid as agreed"), F.concat(F.lit("CHARGEOFF "), "p_brand"), F.concat(F.lit("Jan "), as_text(size)), as_text(30 * (size % 8)), F.lit("  "),
    ]
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*values)).alias("value"))
    return rows.select("p_partkey", "value", text.value_type(F.col("value")).alias("kind"), text.history_token(F.col("value")).alias("is_history"))


@query("ratio_similarity", f"""WITH RECURSIVE next AS (SELECT x.p_partkey, x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1), two AS (SELECT DISTINCT 0 AS key, a, b FROM next), {matched_sql("two")}
SELECT p_partkey, ratio FROM next JOIN ratios ON ratios.a = next.a AND ratios.b = next.b""")
def ratio_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against the next part's, by matching blocks."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    return similarity.ratio(part.join(following, "p_partkey"), "p_partkey", "p_name", "next_name").select("p_partkey", "ratio")


@query("normalized_pages")
def normalized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility forms, validated dates and amounts of every page; no SQL form."""
    normal = table(spark, sf_dir, "pages").select("page_id", pages.normalized_page(F.col("html")).alias("p"))
    return normal.select("page_id", F.sha2(F.col("p.text").cast("binary"), 256).alias("digest"), "p.dates", "p.amounts", "p.marks", "p.spaces")


@query("dispute_plans")
def dispute_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as accounts, their lines as findings; tests hold the plans against a search account by account."""
    lines = table(spark, sf_dir, "lineitem")
    findings = lines.select(F.col("l_orderkey").cast("string").alias("account"), F.concat(F.lit("f"), (F.col("l_partkey") % 7).cast("string")).alias("field"), (F.col("l_suppkey") % 5).cast("int").alias("strength"), (F.col("l_quantity").cast("int") % 12 + 3).alias("min_days"), (F.col("l_linenumber") % 2 == 0).alias("business"))
    return planning.plans(findings)
