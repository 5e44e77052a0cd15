"""Reports as lines: each customer is a document, each order an account of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermend.operators import statements
from ledgermend.plans.catalog import query, table
from ledgermend.plans.textlines import tasks

#: The lines of an order, by place: both engines read this.  Names, gaps, dashes, sections, noise and ends come and go with the key.
LINES = (
    "CASE WHEN k % 17 = 0 THEN 'Collection' WHEN k % 23 = 0 THEN 'Unknown' END",
    "CASE WHEN k % 13 = 0 THEN 'Mixed Case Bank' ELSE 'BANK ' || CAST(k % 97 AS STRING) || ' ' || s END",
    "CASE WHEN k % 5 <> 0 THEN 'TransUnion Experian Equifax' END",
    "'Account # ' || CAST(k % 1000 AS STRING) || '* -- ' || CAST(k % 7 AS STRING) || '*'",
    "'Balance: $' || CAST(price AS STRING) || ' $' || CAST(price + k % 3 AS STRING) || ' $' || CAST(price - k % 2 AS STRING)",
    "CASE WHEN k % 3 = 0 THEN 'Creditor Type:' ELSE 'Type: ' || p || '  Store Card  Bank' END",
    "CASE WHEN k % 4 = 0 THEN 'of record' WHEN k % 7 = 0 THEN 'no' END",
    "'Opened: Jan ' || CAST(2000 + k % 20 AS STRING) || ' Feb. 2021 soon'",
    "CASE WHEN k % 6 = 0 THEN '-- -- $' || CAST(k % 50 AS STRING) WHEN k % 6 = 1 THEN '$1 $2 $3' END",
    "CASE WHEN k % 3 = 0 THEN 'https://example.org/' || CAST(k AS STRING) END",
    "CASE WHEN k % 2 = 0 THEN 'Two-Year Payment History' WHEN k % 9 = 0 THEN 'OTHER' END",
    "CASE WHEN k % 2 = 0 THEN 'ok ok 30' WHEN k % 10 = 1 THEN 'Experian' END",
    "CASE WHEN k % 11 = 0 THEN 'Days Late - 7 Year History' END",
    "'Late: ' || CAST(k % 4 AS STRING) || ' -- ' || CAST(k % 3 AS STRING)",
    "CASE WHEN k % 61 = 0 THEN 'Public Information' END",
)
LINES_SQL = """SELECT * FROM (WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, CAST(FLOOR(o_totalprice) AS BIGINT) AS price, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
{}) AS every WHERE text IS NOT NULL""".format("\nUNION ALL ".join(f"SELECT doc, CAST(1 + FLOOR(n / 3) AS INT) AS page, CAST(16 * n + {j} AS BIGINT) AS position, {text} AS text FROM o" for j, text in enumerate(LINES)))

SPLIT_SQL = f"""lines AS ({LINES_SQL}),
plain AS (SELECT *, REGEXP_REPLACE(LOWER(text), '[^a-z0-9]', '', 'g') AS low, REGEXP_REPLACE(text, '[^A-Za-z0-9/&-]', '', 'g') AS core FROM lines),
flags AS (SELECT *, BOOL_OR(low = 'publicinformation') OVER (PARTITION BY doc ORDER BY position) AS stopped, CONTAINS(LOWER(text), 'transunion') AND CONTAINS(LOWER(text), 'experian') AND CONTAINS(LOWER(text), 'equifax') AS triad,
  CASE low WHEN 'collection' THEN 'collections' WHEN 'unknown' THEN 'unknown' END AS sec, LENGTH(core) >= 3 AND REGEXP_MATCHES(core, '[A-Z]') AND NOT REGEXP_MATCHES(core, '[a-z]') AS head, STARTS_WITH(text, 'Account #') AS anchor FROM plain),
live AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc, page ORDER BY position) AS nr, LAG(CASE WHEN head THEN {{'p': position, 't': text}} END) OVER (PARTITION BY doc, page ORDER BY position) AS prev FROM flags WHERE NOT stopped),
back AS (SELECT *, LAST_VALUE(CASE WHEN triad THEN {{'p': position, 'h': prev}} END IGNORE NULLS) OVER b AS names, LAST_VALUE(CASE WHEN head THEN {{'p': position, 't': text}} END IGNORE NULLS) OVER b AS near,
  [x FOR x IN [CASE WHEN LEAD(head, 1) OVER d THEN {{'p': LEAD(position, 1) OVER d, 't': LEAD(text, 1) OVER d}} END, CASE WHEN LEAD(head, 2) OVER d THEN {{'p': LEAD(position, 2) OVER d, 't': LEAD(text, 2) OVER d}} END,
   CASE WHEN LEAD(head, 3) OVER d THEN {{'p': LEAD(position, 3) OVER d, 't': LEAD(text, 3) OVER d}} END, CASE WHEN LEAD(head, 4) OVER d THEN {{'p': LEAD(position, 4) OVER d, 't': LEAD(text, 4) OVER d}} END] IF x IS NOT NULL][1] AS ahead,
  CASE WHEN LEAD(position) OVER d IS NOT NULL THEN {{'p': LEAD(position) OVER d, 't': LEAD(text) OVER d}} END AS nextline FROM live
  WINDOW b AS (PARTITION BY doc, page ORDER BY position ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), d AS (PARTITION BY doc ORDER BY position)),
foot AS (SELECT doc, page + 1 AS page, ARG_MIN(text, up) AS foot FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc, page ORDER BY position DESC) AS up FROM flags) WHERE up <= 3 AND head AND NOT REGEXP_MATCHES(LOWER(text), '{statements.NO_HEADING}') GROUP BY 1, 2),
anchors AS (SELECT b.doc, ROW_NUMBER() OVER (PARTITION BY b.doc ORDER BY position) AS account, COALESCE(names.h.p, near.p, names.p, position) AS start, COALESCE(names.h.t, near.t, CASE WHEN nr <= 3 THEN foot END) AS heading,
  CASE WHEN names.h IS NOT NULL THEN 'triad_above' WHEN near IS NOT NULL THEN 'backtrack' WHEN nr <= 3 AND foot IS NOT NULL THEN 'cross_page_backtrack' ELSE 'anchor_no_heading' END AS source FROM back b LEFT JOIN foot f ON f.doc = b.doc AND f.page = b.page WHERE anchor),
named AS (SELECT b.doc, b.position, b.sec, COALESCE(ahead, nextline) AS head, MIN(a.account) AS account FROM back b JOIN anchors a ON a.doc = b.doc AND a.start > b.position WHERE sec IS NOT NULL GROUP BY ALL),
lastnamed AS (SELECT doc, account, ARG_MAX(sec, position) AS sec, ARG_MAX(head, position) AS head FROM named GROUP BY 1, 2),
heads AS (SELECT a.doc, a.account, COALESCE(n.head.p, a.start) AS start, CASE WHEN n.head IS NOT NULL THEN n.head.t ELSE a.heading END AS heading, CASE WHEN n.doc IS NOT NULL THEN 'section+heading' ELSE a.source END AS source,
  LAST_VALUE(n.sec IGNORE NULLS) OVER (PARTITION BY a.doc ORDER BY a.account ROWS UNBOUNDED PRECEDING) AS section, n.doc IS NOT NULL AS section_start FROM anchors a LEFT JOIN lastnamed n ON n.doc = a.doc AND n.account = a.account),
held AS (SELECT * FROM (SELECT *, LEAD(start) OVER (PARTITION BY doc ORDER BY account) AS nx FROM heads) WHERE nx IS NULL OR start < nx),
placed AS (SELECT b.doc, b.page, b.position, b.text, b.triad, b.sec, LAST_VALUE(h.account IGNORE NULLS) OVER (PARTITION BY b.doc ORDER BY b.position ROWS UNBOUNDED PRECEDING) AS account FROM back b LEFT JOIN held h ON h.doc = b.doc AND h.start = b.position),
kept AS (SELECT *, MAX(CASE WHEN NOT triad THEN position END) OVER (PARTITION BY doc, account) AS lastplain FROM (SELECT *, MIN(CASE WHEN sec IS NOT NULL THEN position END) OVER (PARTITION BY doc, account) AS cut FROM placed WHERE account IS NOT NULL)
  WHERE (cut IS NULL OR position < cut) AND NOT REGEXP_MATCHES(text, '^https?://')),
owned AS (SELECT *, FIRST_VALUE(CASE WHEN position <= lastplain THEN account END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS owner FROM kept),
split AS (SELECT o.doc, o.page, o.position, o.text, CAST(o.owner AS INT) AS account, h.heading, h.source, h.section, h.section_start FROM owned o JOIN held h ON h.doc = o.doc AND h.account = o.owner)"""


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``LINES_SQL``, from one pass over the orders."""
    price = F.floor("o_totalprice").cast("long")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), price.alias("price"))
    # Dealt by the name that lines keep, so that they lie by document already, into tasks of bounded size.
    orders = orders.repartition(tasks(spark, sf_dir), "doc").withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("k")) - 1)
    lines = orders.select("doc", "n", F.posexplode(F.array(*[F.expr(text) for text in LINES])).alias("j", "text")).where("text is not null")
    return lines.select("doc", (1 + F.floor(F.col("n") / 3)).cast("int").alias("page"), (16 * F.col("n") + F.col("j")).cast("long").alias("position"), "text")


def longest(spark: SparkSession, sf_dir: str) -> int | None:
    """A number that no position of ``report_lines`` exceeds."""
    most = table(spark, sf_dir, "orders").groupBy("o_custkey").count().agg(F.max("count")).first()[0]
    return most and 16 * most


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.split_accounts(report_lines(spark, sf_dir), ["doc"])


@query("account_split", f"WITH {SPLIT_SQL} SELECT * FROM split")
def account_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir)


MOVES_SQL = ", ".join(f"('{kind}', {before}, {after})" for kind, to in statements.MOVES.items() for before, after in enumerate(to))
KIND_SQL = r"""CASE WHEN low = 'publicinformation' THEN 'stop' WHEN low IN ('collection', 'unknown') THEN 'section' WHEN STARTS_WITH(text, 'Account #') THEN 'anchor' WHEN REGEXP_MATCHES(text, '(?i)\bTwo[-\s]?Year\b.*\bPayment\b.*\bHistory\b') THEN 'two_years'
  WHEN REGEXP_MATCHES(text, '(?i)Days\s*Late|7\s*Year\s*History') THEN 'seven_years' WHEN CONTAINS(LOWER(text), 'transunion') AND CONTAINS(LOWER(text), 'experian') AND CONTAINS(LOWER(text), 'equifax') THEN 'triad' WHEN low IN ('transunion', 'experian', 'equifax') THEN 'source'
  WHEN REGEXP_FULL_MATCH(LOWER(text), '(ok|0|30|60|90) (ok|0|30|60|90) (ok|0|30|60|90)') THEN 'grid' WHEN REGEXP_MATCHES(text, '^[^:#]+[:#]') THEN 'row' WHEN (LENGTH(core) >= 3 AND REGEXP_MATCHES(core, '[A-Z]') AND NOT REGEXP_MATCHES(core, '[a-z]')) OR REGEXP_FULL_MATCH(text, '\S{1,3}') THEN 'other' ELSE 'values' END"""
ADD_SQL = "CASE WHEN {f} = '' THEN {v} WHEN {f} = '--' THEN CASE WHEN {v} = '' THEN '--' ELSE {v} END WHEN {v} IN ('', '--') THEN {f} ELSE {v} || ' ' || {f} END"


def _added(k: int) -> str:
    """The value of source ``k`` after a line: of a new row from nothing, else from what is held."""
    value, fragment = f"(CASE WHEN opens THEN '' ELSE r.v{k} END)", f"(CASE WHEN NOT multi AND NOT opens THEN CASE WHEN r.last = {k} THEN l.text ELSE '' END ELSE p{k} END)"
    return f"CASE WHEN NOT (opens OR goes) THEN r.v{k} ELSE {ADD_SQL.format(f=fragment, v=value)} END"


# The list of a tail's parts; then three values; then one recursion over the lines of an account for states and open rows.
ROWS_SQL = f"""WITH RECURSIVE {SPLIT_SQL},
kinds AS (SELECT *, {KIND_SQL} AS kind, ROW_NUMBER() OVER (PARTITION BY doc, account ORDER BY position) AS i FROM (SELECT *, REGEXP_REPLACE(LOWER(text), '[^a-z0-9]', '', 'g') AS low, REGEXP_REPLACE(text, '[^A-Za-z0-9/&-]', '', 'g') AS core FROM split)),
tails AS (SELECT *, CASE WHEN kind IN ('row', 'anchor') THEN TRIM(REGEXP_EXTRACT(text, '^[^:#]+[:#](.*)$', 1)) ELSE text END AS tail FROM kinds),
words AS (SELECT *, [x FOR x IN STRING_SPLIT(tail, ' ') IF x <> ''] AS w, STRING_SPLIT_REGEX(tail, '\\s{{2,}}') AS gaps FROM tails),
months AS (SELECT *, CASE WHEN REGEXP_MATCHES(w[1], '(?i)^(jan|feb|mar)[a-z]*[.]?$') AND REGEXP_MATCHES(w[2], '^\\d{{2,4}}$') THEN 2 ELSE 1 END AS a FROM words),
seconds AS (SELECT *, a + CASE WHEN REGEXP_MATCHES(w[a + 1], '(?i)^(jan|feb|mar)[a-z]*[.]?$') AND REGEXP_MATCHES(w[a + 2], '^\\d{{2,4}}$') THEN 2 ELSE 1 END AS b FROM months),
parts AS (SELECT *, CASE WHEN CONTAINS(tail, ' -- ') OR LEN(STRING_SPLIT(tail, '--')) > 2 THEN [CASE WHEN TRIM(x) = '' THEN '--' ELSE TRIM(x) END FOR x IN STRING_SPLIT(tail, '--')] WHEN LEN(gaps) >= 3 THEN gaps
  WHEN LEN(w) >= 3 THEN [ARRAY_TO_STRING(w[1:a], ' '), ARRAY_TO_STRING(w[a + 1:b], ' '), ARRAY_TO_STRING(w[b + 1:], ' ')] ELSE w END AS p FROM seconds),
laid AS (SELECT *, COALESCE(p[1], '') AS p0, COALESCE(p[2], '') AS p1, ARRAY_TO_STRING(COALESCE(p[3:], []), ' ') AS p2, LEN(STRING_SPLIT(tail, '--')) > 2 OR LEN(gaps) > 1 OR LEN(REGEXP_EXTRACT_ALL(tail, '\\$\\s*\\d')) >= 2 OR LEN(REGEXP_EXTRACT_ALL(tail, '\\b\\d[\\d,./]*\\b')) >= 3 AS multi FROM parts),
moves(kind, was, becomes) AS (VALUES {MOVES_SQL}),
run AS (SELECT DISTINCT doc, account, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS "row", '' AS label, CAST(-1 AS BIGINT) AS first_position, '' AS v0, '' AS v1, '' AS v2, 0 AS last, FALSE AS mine FROM laid
UNION ALL SELECT doc, account, i, becomes, "row" + opens::INT, CASE WHEN opens THEN TRIM(REGEXP_EXTRACT(text, '^([^:#]+)[:#]', 1)) ELSE label END, CASE WHEN opens THEN position ELSE first_position END, v0, v1, v2,
  CASE WHEN NOT (opens OR goes) THEN last WHEN NOT opens AND NOT multi THEN last WHEN p2 NOT IN ('', '--') THEN 2 WHEN p1 NOT IN ('', '--') THEN 1 WHEN p0 NOT IN ('', '--') THEN 0 WHEN opens THEN 0 ELSE last END, opens OR goes
 FROM (SELECT l.*, r.label, r."row", r.first_position, r.last, r.becomes, r.opens, r.goes, {", ".join(f"{_added(k)} AS v{k}" for k in range(3))} FROM laid l JOIN
   (SELECT r.*, l2.i AS j, COALESCE(m.becomes, r.state) AS becomes, l2.kind IN ('row', 'anchor') AND COALESCE(m.becomes, r.state) = 2 AS opens, l2.kind = 'values' AND r.state = 2 AS goes FROM run r JOIN laid l2 ON l2.doc = r.doc AND l2.account = r.account AND l2.i = r.i + 1 LEFT JOIN moves m ON m.kind = l2.kind AND m.was = r.state) r
   ON l.doc = r.doc AND l.account = r.account AND l.i = r.j))
SELECT doc, account, "row", label, first_position, v0 AS transunion, v1 AS experian, v2 AS equifax FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc, account, "row" ORDER BY i DESC) AS n FROM run WHERE mine) WHERE n = 1"""


@query("account_rows", ROWS_SQL)
def account_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled rows of every account, with what their continuation lines add."""
    return statements.triad_rows(split(spark, sf_dir).select("doc", "account", "position", "text"), ["doc", "account"], longest(spark, sf_dir))


@query("report_states", f"""WITH RECURSIVE lines AS ({LINES_SQL}), kinds AS (SELECT *, {KIND_SQL} AS kind, ROW_NUMBER() OVER (PARTITION BY doc ORDER BY position) AS i FROM (SELECT *, REGEXP_REPLACE(LOWER(text), '[^a-z0-9]', '', 'g') AS low, REGEXP_REPLACE(text, '[^A-Za-z0-9/&-]', '', 'g') AS core FROM lines)),
moves(kind, was, becomes) AS (VALUES {MOVES_SQL}),
run AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS position, '' AS kind, 0 AS before, 0 AS after FROM kinds UNION ALL SELECT k.doc, k.i, k.position, k.kind, r.after, COALESCE(m.becomes, r.after) FROM run r JOIN kinds k ON k.doc = r.doc AND k.i = r.i + 1 LEFT JOIN moves m ON m.kind = k.kind AND m.was = r.after)
SELECT doc, position, kind, before, after FROM run WHERE i > 0""")
def report_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The automaton over whole reports, as one parallel scan."""
    lines = report_lines(spark, sf_dir).select("doc", "position", statements.line_kind(F.col("text")).alias("kind"))
    return statements.scan_states(lines, ["doc"], "position", "kind", statements.MOVES, longest=longest(spark, sf_dir)).select("doc", "position", "kind", "before", "after")
