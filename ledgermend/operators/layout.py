"""Layout tokens to rows, columns and blocks, and late-payment readings of block texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermend.functions.lets import bound

BUREAU_NAMES = ("transunion", "experian", "equifax")
GAP = 1 / 2


def expand_packed(tokens: DataFrame) -> DataFrame:
    """One token for each word of a token's text; the x range is shared evenly."""
    parts = F.filter(F.split(F.trim("text"), r"\s+"), lambda p: p != "")
    rows = tokens.withColumn("_parts", parts).select("*", F.posexplode("_parts").alias("_k", "_part"))
    width = (F.col("x1") - F.col("x0")) / F.size("_parts")
    return rows.withColumns({"text": F.col("_part"), "x0": F.col("x0") + F.col("_k") * width, "x1": F.col("x0") + (F.col("_k") + 1) * width}).drop("_parts", "_k", "_part")


def band(x0: Column, x1: Column, edges: Sequence[float], names: Sequence[str] = ("label", "tu", "xp", "eq")) -> Column:
    """The half-open band of a token's middle; the last band is open to the right, ``none`` lies left of all."""
    middle = (x0 + x1) / 2
    out = F.lit("none")
    for edge, name in zip(edges, names, strict=True):
        out = F.when(middle >= edge, name).otherwise(out)
    return out


def triad_headers(tokens: DataFrame) -> DataFrame:
    """The first line of each page that holds all three bureau names, with the middle of each name."""
    word = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    named = tokens.withColumn("name", word).where(F.col("name").isin(*BUREAU_NAMES))
    lines = named.groupBy("page", "line").agg(*[F.min(F.when(F.col("name") == n, (F.col("x0") + F.col("x1")) / 2)).alias(n) for n in BUREAU_NAMES]).na.drop(subset=list(BUREAU_NAMES))
    return lines.groupBy("page").agg(F.min(F.struct("line", *BUREAU_NAMES)).alias("h")).select("page", "h.*")


def column_edges(headers: DataFrame) -> DataFrame:
    """Edges half-way between the names' middles; the first column starts as far left of its middle as it ends right."""
    x = list(BUREAU_NAMES)
    one, two = (F.col(x[0]) + F.col(x[1])) / 2, (F.col(x[1]) + F.col(x[2])) / 2
    return headers.withColumns({"edge_1": 2 * F.col(x[0]) - one, "edge_2": one, "edge_3": two})


def rows_by_gap(tokens: DataFrame, keys: Sequence[str], dy: float) -> DataFrame:
    """Rows of a page: a token whose y lies further than ``dy`` from the one above opens a row; a window, no Python."""
    middle = (F.col("y0") + F.col("y1")) / 2
    w = Window.partitionBy(*keys).orderBy("_y", "x0")
    placed = tokens.withColumn("_y", middle).withColumn("_new", F.when(F.col("_y") - F.lag("_y").over(w) > dy, 1).otherwise(0))
    return placed.withColumn("row", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_y", "_new")


def best_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """For each left interval the right one that overlaps most; the least id on ties, no row without overlap.

    Both sides have ``lo`` and ``hi``; keys bound how many intervals meet (a row of tokens).
    """
    l = left.select(*keys, left_id, F.col("lo").alias("_a"), F.col("hi").alias("_b"))
    r = right.select(*keys, right_id, F.col("lo").alias("_c"), F.col("hi").alias("_d"))
    overlap = F.least("_b", "_d") - F.greatest("_a", "_c")
    hits = l.join(r, list(keys)).withColumn("overlap", overlap).where("overlap > 0")
    return hits.groupBy(*keys, left_id).agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col(right_id).alias("id"))).alias("x")).select(*keys, left_id, F.col("x.id").alias(right_id), (-F.col("x.o")).alias("overlap"))


def nearest_column(x: Column, centres: Sequence[float]) -> Column:
    """The number of the nearest centre, the first on ties."""
    return F.array_min(F.array(*[F.struct(F.abs(x - c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]))["k"]


def zipped(values: Column, labels: Column) -> Column:
    """Labels to values by position: missing values are empty, surplus ones join the last label's."""
    n = F.size(labels)
    rest = F.array_join(F.slice(values, n, F.greatest(F.size(values) - n + 1, F.lit(1))), " ")
    value = lambda k: F.when((k == n - 1) & (F.size(values) > n), rest).otherwise(F.coalesce(F.get(values, k), F.lit("")))
    return F.transform(labels, lambda label, k: F.struct(label.alias("label"), value(k).alias("value")))


def bureau_segments(lines: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """The bureau whose header stands last above each line; header lines and lines above the first are dropped."""
    head = F.lower(F.trim(text))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(head.isin(*BUREAU_NAMES), head)
    return lines.withColumn("bureau", F.last(named, ignorenulls=True).over(w)).where(F.col("bureau").isNotNull() & ~head.isin(*BUREAU_NAMES))


def bureau_order(line: Column) -> Column:
    """The three names in the order in which a line has them; null if one is absent."""
    low = F.lower(line)
    places = F.array_sort(F.array(*[F.struct(F.instr(low, n).alias("p"), F.lit(n).alias("n")) for n in BUREAU_NAMES]))
    return F.when(F.get(places, F.lit(0))["p"] > 0, F.transform(places, lambda x: x["n"]))


def headings(lines: DataFrame, keys: Sequence[str], order: str, text: str, above: int = 5) -> DataFrame:
    """Account number lines with the nearest heading (a line in capitals without digits or colon) above them."""
    heading = F.when(F.col(text).rlike(r"^[A-Z][A-Z &./'-]{2,}$"), F.trim(text))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-above, -1)
    return lines.withColumn("heading", F.last(heading, ignorenulls=True).over(w)).where(F.lower(text).rlike(r"account\s*(#|number|no\.)"))


#: The head of the inquiries section, one of its lines, and an inquiry in running text.
INQUIRY_HEAD = r"(?i)Creditor Name\s+Date of Inquiry\s+Credit Bureau"
INQUIRY_LINE = r"(?i)([A-Za-z0-9 .,'&/-]+?)\s+(\d{1,2}/\d{1,2}/\d{2,4})\s+(TransUnion|Trans Union|TU|Experian|EX|Equifax|EQ)"
INQUIRY_TEXT = r"(?i)([A-Za-z0-9 .,'&/-]{3,})\s+(\d{1,2}/\d{2,4})\s+(TransUnion|Experian|Equifax)"


def inquiries(text: Column) -> Column:
    """``array<struct<creditor, day, bureau>>`` of a report text.

    From the lines after the head that stands one or two lines below ``Inquiries``, up to ``Creditor
    Contacts``; if they give none, from the whole text with its line breaks as spaces.
    """
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda t: F.trim(t))
    bureau = lambda b: F.when(b.startswith("t"), "transunion").when(b.startswith("ex"), "experian").otherwise("equifax")

    def found(source: Column, pattern: str) -> Column:
        part = lambda k: F.trim(F.regexp_extract(source, pattern, k))
        return F.struct(part(1).alias("creditor"), part(2).alias("day"), bureau(F.lower(part(3))).alias("bureau"))

    def section(own: Column) -> Column:
        at = F.transform(own, lambda t, k: F.when(t == "Inquiries", F.coalesce(*[F.when(F.coalesce(F.get(own, k + n), F.lit("")).rlike(INQUIRY_HEAD), k + n + 1) for n in (1, 2)])))
        start = F.array_min(F.filter(at, lambda x: x.isNotNull()))
        rest = F.when(start.isNotNull(), F.slice(own, start + 1, F.size(own))).otherwise(F.array().cast("array<string>"))
        stop = F.array_position(F.transform(rest, lambda t: t.startswith("Creditor Contacts")), True)
        listed = F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest)
        return F.transform(F.filter(listed, lambda t: t.rlike(INQUIRY_LINE)), lambda t: found(t, INQUIRY_LINE))

    running = F.transform(F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit(INQUIRY_TEXT), F.lit(0)), lambda t: found(t, INQUIRY_TEXT))
    return bound(bound(lines, section), lambda listed: F.when(F.size(listed) > 0, listed).otherwise(running))


#: How a count of late payments is written.
LATE_COUNT = r"(?<!\d){code}[\s-]*:?\s*(\d+)(?!\d)"


def late_counts(segment: Column) -> Column:
    """The last plausible count (12 at most) of 30, 60 and 90 days in a text such as ``30: 2 60: 1``."""

    def last(code: str) -> Column:
        found = F.transform(F.regexp_extract_all(segment, F.lit(LATE_COUNT.replace("{code}", code)), F.lit(1)), lambda t: t.try_cast("int"))
        return F.try_element_at(F.filter(found, lambda n: n <= 12), F.lit(-1))

    return F.struct(*[last(c).alias(f"late{c}") for c in ("30", "60", "90")])


def late_grid(lines: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Per block and bureau its late counts (null if none could be read) and its grid text, the last mention counting.

    A bureau's line holds them itself; one without counts takes the next line along unless that is a bureau's.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    clean = F.trim(text)
    named = F.lower(F.regexp_extract(clean, r"(?i)^(TransUnion|Experian|Equifax)\s*:?(.*)", 1))
    rest = F.trim(F.regexp_extract(clean, r"(?i)^(TransUnion|Experian|Equifax)\s*:?(.*)", 2))
    some = lambda c: F.coalesce(c["late30"], c["late60"], c["late90"]).isNotNull()
    placed = lines.withColumn("_bureau", F.nullif(named, F.lit(""))).withColumn("_rest", rest)
    placed = placed.withColumn("_own", late_counts(F.col("_rest"))).withColumn("_next", F.when(F.lead("_bureau").over(w).isNull(), F.lead(clean).over(w)))
    open_ = ~some(F.col("_own")) & F.col("_next").isNotNull()
    later = late_counts(F.col("_next"))
    counts = F.when(some(F.col("_own")), F.col("_own")).when(open_ & some(later), later)
    grid = F.when(open_, F.trim(F.concat_ws(" ", "_rest", "_next"))).otherwise(F.col("_rest"))
    rows = placed.where("_bureau is not null").select(*keys, F.col("_bureau").alias("bureau"), order, counts.alias("counts"), grid.alias("grid"))
    return rows.groupBy(*keys, "bureau").agg(F.max_by("counts", F.when(F.col("counts").isNotNull(), F.col(order))).alias("counts"), F.max_by("grid", order).alias("grid"))


#: Words that deny or tell of late payments.
NO_LATE = r"no late|never late|0 late|zero late"
LATE = r"(?i)\blate\b|past due|delinquen|charge[- ]?off|collection"


def late_indicator(total_lates: Column, flags: Column, text: Column) -> Column:
    """True by counts; the bare flag without counts says no; then a denial, then a mention."""
    return F.when(total_lates > 0, True).when(F.coalesce(F.array_contains(flags, "Late Payments"), F.lit(False)), False).when(F.lower(text).rlike(NO_LATE), False).otherwise(F.coalesce(text.rlike(LATE), F.lit(False)))


def enforced_collection(kind: Column, status: Column, text: Column) -> Column:
    """An account that is both charged off and in collection is a collection; the status as reported is kept."""
    both = F.coalesce(text.rlike(r"(?i)charge[- ]?off") & text.rlike("(?i)collection"), F.lit(False))
    return F.struct(F.when(both, "Collection").otherwise(kind).alias("account_type"), F.when(both, "Collection").otherwise(status).alias("status"), F.when(both, status).alias("reported_status"))


def neutralized(statement: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """A statement with admissions replaced: of ``(pattern, flag, text)`` rules the last that fits gives the text, all give flags."""
    out = statement
    for pattern, _, text in rules:
        out = F.when(statement.rlike(pattern), text).otherwise(out)
    flags = F.array_compact(F.array(*[F.when(statement.rlike(p), F.lit(f)) for p, f, _ in rules]))
    return F.struct(out.alias("statement"), flags.alias("flags"), (F.size(flags) > 0).alias("admission"))


def sections(lines: DataFrame, keys: Sequence[str], order: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """The first line of each section of a report, null if it has none."""
    first = [F.min(F.when(F.lower(text).rlike(p), F.col(order))).alias(name) for name, p in patterns.items()]
    return lines.groupBy(*keys).agg(*first)
