"""Fuzzy joins over the hosts of pages, and tables of three sources from tokens laid out by order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.operators import links, tables
from ledgermend.plans.catalog import query, table
from ledgermend.plans.textlines import tasks

#: The longest run that two pieces share, the first in a, then in b: as one list expression.
RUN = """LIST_MAX(FLATTEN(FLATTEN([[[CASE WHEN SUBSTR(a, i, n) = SUBSTR(b, j, n) THEN {{'n': n, 'i': -i, 'j': -j}} END FOR n IN RANGE(1, LEAST({ah} - i, {bh} - j) + 1)] FOR j IN RANGE({bl}, {bh})] FOR i IN RANGE({al}, {ah})])))"""
HOSTS_SQL = r"""hosts AS (SELECT DISTINCT REGEXP_EXTRACT(url, '^https?://([^/]*)\.example\.([a-z]+)', 2) AS domain, REGEXP_EXTRACT(url, '^https?://([^/]*)\.example\.([a-z]+)', 1) AS name FROM pages)"""


def matched_sql(two: str) -> str:
    """CTEs ``piece`` and ``ratios(key, a, b, ratio)`` of a CTE with key, a and b: shares of letters in matching blocks, pieces left and right of a run being matched again."""
    return f"""piece AS (SELECT *, 1 AS al, LENGTH(a) + 1 AS ah, 1 AS bl, LENGTH(b) + 1 AS bh, {RUN.format(al="1", ah="(LENGTH(a) + 1)", bl="1", bh="(LENGTH(b) + 1)")} AS run FROM {two}
UNION ALL SELECT key, a, b, al, ah, bl, bh, {RUN.format(al="al", ah="ah", bl="bl", bh="bh")} FROM
 (SELECT key, a, b, CASE s WHEN 0 THEN al ELSE -run.i + run.n END AS al, CASE s WHEN 0 THEN -run.i ELSE ah END AS ah, CASE s WHEN 0 THEN bl ELSE -run.j + run.n END AS bl, CASE s WHEN 0 THEN -run.j ELSE bh END AS bh FROM piece, (VALUES (0), (1)) v(s) WHERE run IS NOT NULL) WHERE al < ah AND bl < bh),
ratios AS (SELECT key, a, b, 2.0::DOUBLE * SUM(COALESCE(run.n, 0)) / (LENGTH(a) + LENGTH(b)) AS ratio FROM piece GROUP BY key, a, b)"""


#: Of all pairs of names by brute force.
RATIO_SQL = f"""{HOSTS_SQL}, two AS (SELECT x.domain AS key, x.name AS a, y.name AS b FROM hosts x JOIN hosts y ON x.domain = y.domain AND x.name < y.name WHERE LENGTH(x.name) > 0), {matched_sql("two")},
similar_pairs AS (SELECT key AS domain, a, b, ratio FROM ratios WHERE ratio >= 0.8 - 1e-12)"""


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.regexp_extract("url", r"^https?://([^/]*)\.example\.([a-z]+)", k)
    return table(spark, sf_dir, "pages").select("page_id", "url", "html", part(2).alias("domain"), part(1).alias("name"))


@query("similar_hosts", f"WITH RECURSIVE {RATIO_SQL} SELECT domain, a, b, ROUND(ratio, 9) AS ratio FROM similar_pairs")
def similar_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.similar_names(hosts(spark, sf_dir), ["domain"], "name").withColumn("ratio", F.round("ratio", 9))


@query("host_groups", f"""WITH RECURSIVE {RATIO_SQL}, both_ways AS (SELECT domain || '/' || a AS x, domain || '/' || b AS y FROM similar_pairs UNION SELECT domain || '/' || b, domain || '/' || a FROM similar_pairs),
reach AS (SELECT DISTINCT x AS node, x AS r FROM both_ways UNION SELECT reach.node, y FROM reach JOIN both_ways ON x = r) SELECT node, MIN(r) AS component FROM reach GROUP BY 1""")
def host_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = links.similar_names(hosts(spark, sf_dir), ["domain"], "name")
    return links.connected(pairs.select(F.concat_ws("/", "domain", "a").alias("a"), F.concat_ws("/", "domain", "b").alias("b")))


ACCOUNTS_SQL = r"""acc AS (SELECT page_id AS id, REGEXP_EXTRACT(url, '^https?://([^/]*)\.example\.([a-z]+)', 2) AS domain, REGEXP_EXTRACT(url, '^https?://([^/]*)\.example\.([a-z]+)', 1) AS name, REGEXP_EXTRACT(url, '/(\d*)', 1) AS dummy,
  RIGHT(REGEXP_REPLACE(CASE WHEN page_id % 3 = 0 THEN '' ELSE REGEXP_EXTRACT(url, '/([0-9]+)', 1) END, '[^0-9]', '', 'g'), 4) AS last4, CAST(LENGTH(html) AS DOUBLE) AS balance, CASE WHEN page_id % 5 = 0 THEN NULL ELSE CAST('2020-01-01' AS DATE) + CAST(page_id % 200 AS INT) END AS opened FROM pages),
one AS (SELECT domain, name, last4, opened, MIN(id) AS id, ARG_MIN(balance, id) AS balance FROM acc GROUP BY 1, 2, 3, 4)"""


@query("duplicate_accounts", f"""WITH RECURSIVE {RATIO_SQL}, {ACCOUNTS_SQL}, met AS (SELECT x.id AS a, y.id AS b FROM one x JOIN one y ON x.domain = y.domain AND x.id < y.id LEFT JOIN similar_pairs p ON p.domain = x.domain AND p.a = LEAST(x.name, y.name) AND p.b = GREATEST(x.name, y.name)
 WHERE (STARTS_WITH(x.name, y.name) OR STARTS_WITH(y.name, x.name) OR p.a IS NOT NULL) AND (x.last4 = '' OR y.last4 = '' OR x.last4 = y.last4) AND ABS(x.balance - y.balance) <= GREATEST(100, 0.1::DOUBLE * LEAST(x.balance, y.balance)) AND COALESCE(ABS(DATE_DIFF('day', x.opened, y.opened)) <= 90, TRUE)),
edges AS (SELECT a AS x, b AS y FROM met UNION SELECT b, a FROM met), reach AS (SELECT DISTINCT x AS node, x AS r FROM edges UNION SELECT reach.node, y FROM reach JOIN edges ON x = r), grouped AS (SELECT node, MIN(r) AS g FROM reach GROUP BY 1)
SELECT id, name, g AS suspect_group, g IS NOT NULL AS duplicate_suspect FROM one LEFT JOIN grouped ON node = id""")
def duplicate_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as accounts of their domain: the host is the name, digits of the path the number, the length the balance."""
    k = F.col("page_id")
    accounts = hosts(spark, sf_dir).select(
        "domain", k.alias("id"), "name", F.when(k % 3 == 0, "").otherwise(F.regexp_extract("url", r"/([0-9]+)", 1)).alias("account_number"), F.array(F.lit("experian")).alias("bureaus"),
        F.lit("Collection").alias("status"), F.when(k % 5 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (k % 200).cast("int"))).alias("opened"), F.lit(None).cast("date").alias("closed"),
        F.length("html").cast("double").alias("balance"), F.lit("negative_accounts").alias("category"),
    )
    return links.duplicate_suspects(accounts, "domain").select("id", "name", "suspect_group", "duplicate_suspect")


#: Fixed values of the layout below: labels and their fields.
LABELS = {"high balance": "high_balance", "date opened": "date_opened", "status": "account_status"}
#: Tokens of an order: a head, label lines 8 apart and values that drift by the line's numbers; both engines read this.
TOKENS_SQL = """SELECT o_orderkey AS k, 0 AS line, s AS text, CAST(100 + 150 * j + o_orderkey % 40 AS DOUBLE) AS x0, CAST(150 + 150 * j + o_orderkey % 40 AS DOUBLE) AS x1, 0.0D AS y0, 4.0D AS y1 FROM orders, (SELECT 0 AS j, 'TransUnion' AS s UNION ALL SELECT 1, 'Experian' UNION ALL SELECT 2, 'Equifax:') h WHERE o_orderkey % 10 <> 3 OR j < 1
UNION ALL SELECT o_orderkey, 1 + n, t, CAST(10 + 20 * p AS DOUBLE), CAST(25 + 20 * p AS DOUBLE), CAST(8 + 8 * n AS DOUBLE), CAST(12 + 8 * n AS DOUBLE) FROM orders, (SELECT 0 AS n, 0 AS p, 'High' AS t UNION ALL SELECT 0, 1, 'Balance:' UNION ALL SELECT 1, 0, 'Date' UNION ALL SELECT 1, 1, 'Opened' UNION ALL SELECT 3, 0, 'STATUS' UNION ALL SELECT 5, 0, 'Remarks') l WHERE o_orderkey % 7 <> n
UNION ALL SELECT l_orderkey, 10 + l_linenumber, CASE WHEN l_partkey % 6 = 0 THEN '--' ELSE l_shipmode_or END, CAST(90 + l_partkey % 450 AS DOUBLE), CAST(120 + l_partkey % 450 AS DOUBLE), CAST(7 + l_linenumber * 6 + l_partkey % 4 AS DOUBLE), CAST(11 + l_linenumber * 6 + l_partkey % 4 AS DOUBLE)
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag || CAST(l_partkey AS STRING) AS l_shipmode_or FROM lineitem) x""".replace("0.0D", "CAST(0 AS DOUBLE)").replace("4.0D", "CAST(4 AS DOUBLE)")
LABEL_CASE = " ".join(f"WHEN '{label}' THEN '{field}'" for label, field in LABELS.items())
COLUMNS_SQL = f"""tok AS ({TOKENS_SQL}),
mids AS (SELECT k, REGEXP_REPLACE(LOWER(text), '[^a-z]', '', 'g') AS source, LIST_SORT(LIST((x0 + x1) / 2)) AS xs FROM tok WHERE REGEXP_REPLACE(LOWER(text), '[^a-z]', '', 'g') IN ('transunion', 'experian', 'equifax') GROUP BY 1, 2),
mid AS (SELECT k, source, xs[LEN(xs) // 2 + 1] AS mid FROM mids), nb AS (SELECT *, LAG(mid) OVER w AS lo, LEAD(mid) OVER w AS hi FROM mid WINDOW w AS (PARTITION BY k ORDER BY mid, source)),
half AS (SELECT *, LEAST(140, GREATEST(60, LEAST(COALESCE(mid - lo, hi - mid), COALESCE(hi - mid, mid - lo)) / 2 * 0.95::DOUBLE)) AS h FROM nb WHERE lo IS NOT NULL OR hi IS NOT NULL),
cols AS (SELECT k, source, GREATEST(mid - h, COALESCE((lo + mid) / 2 + 0.5, mid - h)) AS "left", LEAST(mid + h, COALESCE((mid + hi) / 2 - 0.5, mid + h)) AS "right" FROM half)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``TOKENS_SQL``; orders and their lines are dealt by key before they become tokens, which then lie by block."""
    count = tasks(spark, sf_dir)
    orders, lines = (table(spark, sf_dir, name).repartition(count, key) for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")))
    return spark.sql(TOKENS_SQL.replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}"), orders=orders, lineitem=lines)


@query("source_columns", f'WITH {COLUMNS_SQL} SELECT k, source, ROUND("left", 6) AS "left", ROUND("right", 6) AS "right" FROM cols')
def source_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.source_columns(tokens(spark, sf_dir), ["k"])
    return found.select("k", "source", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


@query("source_tables", f"""WITH {COLUMNS_SQL}, ln AS (SELECT k, line, TRIM(REGEXP_REPLACE(LOWER(STRING_AGG(text, ' ' ORDER BY x0, x1, text)), '[^a-z0-9]+', ' ', 'g')) AS lab, LIST_SORT(LIST((y0 + y1) / 2)) AS ys FROM tok GROUP BY 1, 2),
lines AS (SELECT k, line, ys[LEN(ys) // 2 + 1] AS y, CASE lab {LABEL_CASE} END AS field FROM ln), rws AS (SELECT k, field, MIN(y) AS ry FROM lines WHERE field IS NOT NULL GROUP BY 1, 2),
mdl AS (SELECT k, field, ry AS m FROM rws UNION ALL SELECT r.k, r.field, l.y FROM rws r JOIN lines l ON l.k = r.k AND l.field IS NULL AND l.y > r.ry + 3 AND l.y <= r.ry + 9),
parts AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k, field ORDER BY m) AS part FROM mdl),
vals AS (SELECT p.k, p.field, c.source, STRING_AGG(t.text, ' ' ORDER BY p.part, (t.x0 + t.x1) / 2, t.text) AS v FROM parts p JOIN lines l ON l.k = p.k AND ABS(l.y - p.m) <= 3 JOIN tok t ON t.k = l.k AND t.line = l.line JOIN cols c ON c.k = t.k AND (t.x0 + t.x1) / 2 BETWEEN c."left" AND c."right" GROUP BY 1, 2, 3),
clean AS (SELECT k, field, source, CASE WHEN REGEXP_FULL_MATCH(v, '-+') THEN '--' ELSE v END AS v FROM vals)
SELECT r.k, r.field, COALESCE(MAX(CASE WHEN source = 'transunion' THEN v END), '') AS transunion, COALESCE(MAX(CASE WHEN source = 'experian' THEN v END), '') AS experian, COALESCE(MAX(CASE WHEN source = 'equifax' THEN v END), '') AS equifax FROM rws r LEFT JOIN clean c ON c.k = r.k AND c.field = r.field GROUP BY 1, 2""")
def source_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.source_table(tokens(spark, sf_dir), ["k"], LABELS)


@query("template_detection", f"""WITH tok AS ({TOKENS_SQL}), cut AS (SELECT * FROM tok WHERE (y0 + y1) / 2 BETWEEN 0 AND 40 AND (x0 + x1) / 2 BETWEEN 0 AND 450),
ln AS (SELECT k, line, TRIM(REGEXP_REPLACE(LOWER(STRING_AGG(text, ' ' ORDER BY x0, x1, text)), '[^a-z0-9]+', ' ', 'g')) AS lab FROM cut GROUP BY 1, 2),
b AS (SELECT k, COUNT(DISTINCT CASE WHEN LOWER(text) IN ('transunion', 'experian', 'equifax') THEN LOWER(text) END) AS s FROM cut GROUP BY 1),
l AS (SELECT k, COUNT(DISTINCT CASE WHEN lab IN ('high balance', 'date opened', 'status') THEN lab END) / 3.0::DOUBLE AS c FROM ln GROUP BY 1)
SELECT CAST(FLOOR(b.k / 20) AS BIGINT) AS session, COUNT(*) AS blocks_checked, CAST(SUM((s >= 2)::INT) AS BIGINT) AS blocks_with_bands, ROUND(AVG(c), 9) AS label_coverage_mean, ROUND(0.5::DOUBLE * SUM((s >= 2)::INT) / COUNT(*) + 0.5::DOUBLE * AVG(c), 9) AS confidence FROM b JOIN l USING (k) GROUP BY 1""")
def template_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as blocks, twenty a session, seen through a window of their page."""
    laid = tokens(spark, sf_dir).withColumns({"session": F.floor(F.col("k") / 20).cast("long"), "page": F.lit(1)})
    frame = laid.select("session", "k").distinct().select("session", "k", F.lit(1).alias("page"), F.lit(0.0).alias("x_min"), F.lit(450.0).alias("x_max"), F.lit(0.0).alias("y_top"), F.lit(40.0).alias("y_bottom"))
    found = tables.template_confidence(tables.in_windows(laid, frame, ["session", "k"]), "session", "k", list(LABELS))
    return found.withColumns({c: F.round(c, 9) for c in ("label_coverage_mean", "confidence")})
