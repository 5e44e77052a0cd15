"""Normalisers of money, dates, names, numbers and texts over derived raw strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.functions import dates, histories, money, text
from ledgermend.operators import sequence
from ledgermend.plans.catalog import query, table

MONEY_SQL = """WITH o AS (SELECT o_orderkey, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS c FROM orders),
r AS (SELECT *, CAST(c // 100 AS VARCHAR) || '.' || LPAD(CAST(c % 100 AS VARCHAR), 2, '0') AS t, o_orderkey % 6 AS k FROM o)
SELECT o_orderkey, CASE WHEN k IN (3, 5) THEN NULL WHEN k = 1 THEN -CAST(t AS DOUBLE) WHEN k = 4 THEN CAST('1' || t AS DOUBLE) ELSE CAST(t AS DOUBLE) END AS amount,
  CASE WHEN k IN (3, 5) THEN NULL WHEN k = 1 THEN -c WHEN k = 4 THEN CAST(CAST('1' || t AS DECIMAL(18, 2)) * 100 AS BIGINT) ELSE c END AS cents,
  CASE WHEN k IN (3, 5) THEN NULL WHEN k = 1 THEN -CAST(t AS DOUBLE) WHEN k = 4 THEN 1.0 ELSE CAST(t AS DOUBLE) END AS field_amount,
  CASE WHEN k IN (3, 5) THEN NULL WHEN k = 4 THEN CAST('1' || t AS DOUBLE) ELSE CAST(t AS DOUBLE) END AS rule_amount,
  CASE WHEN k IN (2, 3, 4, 5) THEN NULL WHEN k = 1 THEN -CAST(t AS DOUBLE) ELSE CAST(t AS DOUBLE) END AS polarity_amount FROM r"""


@query("money_forms", MONEY_SQL)
def money_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in six ways, read by five rules."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    plain = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    kind = F.col("o_orderkey") % 6
    raw = F.when(kind == 0, F.concat(F.lit(" $"), plain)).when(kind == 1, F.concat(F.lit("($"), plain, F.lit(")"))).when(kind == 2, F.concat(plain, F.lit(" USD"))).when(kind == 3, "--").when(kind == 4, F.concat(F.lit("1/"), plain)).otherwise("")
    o = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    r = F.col("raw")
    return o.select("o_orderkey", money.match_amount(r).alias("amount"), money.match_cents(r).alias("cents"), money.field_amount(r).alias("field_amount"), money.rule_amount(r).alias("rule_amount"), money.polarity_amount(r).alias("polarity_amount"))


DATES_SQL = """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 4 THEN NULL WHEN k = 2 AND EXTRACT(day FROM d) <= 12 THEN MAKE_DATE(EXTRACT(year FROM d), EXTRACT(day FROM d), EXTRACT(month FROM d)) ELSE d END AS match_date,
  CASE WHEN k = 4 THEN NULL ELSE d END AS field_date, CASE WHEN k = 4 THEN NULL ELSE d END AS found_date, CASE WHEN k = 1 THEN d WHEN k = 0 THEN d WHEN k = 3 THEN d
  WHEN k = 2 AND EXTRACT(day FROM d) <= 12 THEN MAKE_DATE(EXTRACT(year FROM d), EXTRACT(day FROM d), EXTRACT(month FROM d)) END AS convention_date FROM o"""


@query("date_forms", DATES_SQL)
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in five ways (dots day first, slashes and dashes month first), read by four rules."""
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = F.when(kind == 0, F.date_format(d, "yyyy-MM-dd")).when(kind == 1, F.date_format(d, "M/d/yyyy")).when(kind == 2, F.date_format(d, "dd.MM.yyyy")).when(kind == 3, F.date_format(d, "M-d-yyyy")).otherwise("pending")
    o = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    r = F.col("raw")
    return o.select("o_orderkey", dates.match_date(r).alias("match_date"), dates.field_date(r).alias("field_date"), dates.found_date(r).alias("found_date"), dates.convention_date(r, "MDY").alias("convention_date"))


@query("text_forms", """SELECT p_partkey, TRIM(REGEXP_REPLACE(LOWER(p_name || ' / ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS plain, UPPER('JP ' || REPLACE(p_brand, '#', '')) AS issuer,
REGEXP_REPLACE(p_name, '[^0-9]', '', 'g') AS digits, '****' || RIGHT(REGEXP_REPLACE(p_brand || p_partkey, '[^0-9]', '', 'g'), 4) AS masked FROM part""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.plain(F.concat(name, F.lit(" / "), "p_type")).alias("plain"), text.issuer(F.concat(F.lit("J.P. "), F.replace(brand, F.lit("#"), F.lit("")))).alias("issuer"),
        F.coalesce(text.digits(name), F.lit("")).alias("digits"), text.masked(F.concat(brand, F.col("p_partkey").cast("string"))).alias("masked"),
    )


@query("logical_keys", """SELECT c_custkey, SUBSTR(SHA1('L4:' || LPAD(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '|I:' || UPPER(c_mktsegment) || '|T:' || 'REVOLVING' || '|D:' || '2020-01-01'), 1, 16) AS logical_key FROM customer""")
def logical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", text.logical_key(F.col("c_mktsegment"), four, F.lit("revolving"), F.lit("2020-01-01")).alias("logical_key"))


@query("account_numbers", """WITH c AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS n, c_custkey % 5 AS k FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN 'masked' WHEN 1 THEN CASE WHEN LEN(n) <= 4 THEN 'masked_last4' ELSE 'masked' END WHEN 2 THEN 'unmasked' WHEN 3 THEN 'missing' ELSE 'nondigit' END AS mask_class,
  CASE k WHEN 0 THEN '12345*' || n WHEN 1 THEN '*' || n WHEN 2 THEN '12345678' || n WHEN 3 THEN 'N/A' ELSE 'PENDING' END AS canonical, k = 2 OR (k IN (0, 1) AND INSTR('12345678' || n, CASE k WHEN 0 THEN '12345' || n ELSE n END) > 0) AS visible FROM c""")
def account_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 5
    raw = F.when(kind == 0, F.concat(F.lit("123-45 xxx"), n)).when(kind == 1, F.concat(F.lit("**** "), n)).when(kind == 2, F.concat(F.lit("1234-5678-"), n)).when(kind == 3, "n/a").otherwise("pending")
    c = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"), F.concat(F.lit("12345678"), n).alias("other"))
    return c.select("c_custkey", text.number_class(F.col("raw")).alias("mask_class"), text.number_mask(F.col("raw")).alias("canonical"), text.visible_match(F.col("raw"), F.col("other")).alias("visible"))


REDACT_SQL = r"""SELECT doc_id, md5(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(COALESCE(text, ''),
  '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[REDACTED]', 'g'), '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b', '[REDACTED]', 'g'), '\b(?:\d{3}[- ]\d{2}[- ]|\d{5})(\d{4})\b', '***-**-\1', 'g'),
  '(?i)(ssn[\s:#-]*)(\d{4})', '\1***-**-\2', 'g'), '\b(?:\d{4}[ -]?){2,4}(\d{4})\b', '****\1', 'g')) AS digest,
  CAST(LEN(REGEXP_EXTRACT_ALL(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) AS BIGINT) AS emails, CAST(LEN(REGEXP_EXTRACT_ALL(text, '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b')) AS BIGINT) AS phones FROM documents"""


@query("redact_documents", REDACT_SQL)
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = text.redaction_counts(F.col("text"))
    return docs.select("doc_id", F.md5(text.redacted(F.col("text")).cast("binary")).alias("digest"), counts["emails"].alias("emails"), counts["phones"].alias("phones"))


@query("history_tokens", """WITH h AS (SELECT user_id, LIST(CASE event_type WHEN 'error' THEN 'CO' WHEN 'click' THEN '30' WHEN 'view' THEN 'OK' WHEN 'purchase' THEN '60' ELSE '120' END) AS t FROM events GROUP BY 1)
SELECT user_id, CAST(LEN(t) AS INT) AS tokens, CAST(LEN(LIST_FILTER(t, lambda x: x = 'CO')) AS INT) AS charge_offs, CAST(LEN(LIST_FILTER(t, lambda x: x = '30')) AS INT) AS late30, CAST(LEN(LIST_FILTER(t, lambda x: x = '60')) AS INT) AS late60, CAST(LEN(LIST_FILTER(t, lambda x: x = '120')) AS INT) AS late90 FROM h""")
def history_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("case event_type when 'error' then 'co' when 'click' then '30' when 'view' then 'ok' when 'purchase' then ' 60' else '120' end")
    each = table(spark, sf_dir, "events").select("user_id", histories.two_year(F.array(status)).alias("x"))  # a row is a history of one token
    counts = {"tokens": F.size("x.tokens"), "charge_offs": F.col("x.counts.CO")} | {k: F.col(f"x.counts.{k}") for k in ("late30", "late60", "late90")}
    return each.groupBy("user_id").agg(*[F.sum(v).cast("int").alias(k) for k, v in counts.items()])


@query("history_similarity", """WITH h AS (SELECT l_orderkey, LIST(l_returnflag ORDER BY l_shipdate, l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1),
p AS (SELECT x.l_orderkey, x.a, y.a AS b, LEAST(LEN(x.a), LEN(y.a)) AS n FROM h x JOIN h y ON y.l_orderkey = x.l_orderkey + 1)
SELECT l_orderkey, LEN(LIST_FILTER(RANGE(1, n + 1), lambda i: a[LEN(a) + 1 - i] = b[LEN(b) + 1 - i])) / n::DOUBLE AS similarity FROM p""")
def history_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_returnflag")
    h = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda e: e["l_returnflag"]).alias("a"))
    both = h.join(h.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("a").alias("b")), "l_orderkey")
    return both.select("l_orderkey", histories.aligned_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query("gap_columns", """WITH v AS (SELECT DISTINCT p_partkey % 8 + 8 * (p_partkey // 1000) AS page, p_retailprice AS x FROM part), g AS (SELECT *, CASE WHEN x - LAG(x) OVER (PARTITION BY page ORDER BY x) > 0.9 OR LAG(x) OVER (PARTITION BY page ORDER BY x) IS NULL THEN 1 ELSE 0 END AS b FROM v),
i AS (SELECT *, SUM(b) OVER (PARTITION BY page ORDER BY x ROWS UNBOUNDED PRECEDING) AS c FROM g) SELECT page, CAST(c AS BIGINT) AS cluster, ROUND(AVG(x), 4) AS centre FROM i GROUP BY 1, 2""")
def gap_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "part").select((F.col("p_partkey") % 8 + 8 * F.floor(F.col("p_partkey") / 1000)).alias("page"), F.col("p_retailprice").alias("x")).distinct()
    runs = sequence.gap_islands(values, ["page"], "x", 0.9, "cluster")
    return runs.groupBy("page", F.col("cluster").cast("long").alias("cluster")).agg(F.round(F.avg("x"), 4).alias("centre"))
