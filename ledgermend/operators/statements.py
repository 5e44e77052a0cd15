"""Report lines to accounts and their three-source rows: a parallel automaton, account starts, open rows.

A line moves an automaton from state to state, so a line is a function of
states, and so are many lines in a row.  ``scan_states`` composes the functions of
chunks level by level and then hands states down again: a document of any length
is spread over tasks, and a task reads its chunks in order, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ledgermend.functions.lets import bound
from ledgermend.workspace import stored

#: Positions a chunk; a document that is shorter is read in one pass.
CHUNK = 65_536

# -- the automaton ----------------------------------------------------------------------------


def _packed(moves: Iterable[int]) -> bytes:
    """A function of states as bytes, two for each state."""
    return np.asarray(list(moves), "<u2").tobytes()


def composed(moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What rows do together, from the ``first`` one of their run up to each row: rows of next states, composed by doubling."""
    at = np.arange(len(moves))
    since = at - np.maximum.accumulate(np.where(first, at, 0))
    done, reach = moves, 1
    while reach <= since.max(initial=0):
        later = np.flatnonzero(since >= reach)
        further = done.copy()
        further[later] = np.take_along_axis(done[later], done[later - reach], axis=1)
        done, reach = further, 2 * reach
    return done


def _functions(batch: pa.RecordBatch, states: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("_moves").to_pylist()), "<u2").reshape(-1, states).astype(np.intp)


def _whole(batches: Iterable[pa.RecordBatch], names: Sequence[str], states: int) -> Iterator[pa.RecordBatch]:
    """A row a chunk, with what all its rows do together."""
    held = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        moves, first = _functions(batch, states), batch.column("_row").to_numpy() == 1
        if not first[0]:
            moves[0] = moves[0][held]
        elif last is not None:
            yield last
        done = composed(moves, first)
        ends = np.append(np.flatnonzero(first[1:]), batch.num_rows - 1)
        rows = pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(ends)) for c in names], pa.array([_packed(done[k]) for k in ends], pa.binary())], names=[*names, "_moves"])
        yield rows.slice(0, len(ends) - 1)
        held, last = done[-1], rows.slice(len(ends) - 1)
    if last is not None:
        yield last


def _states(batches: Iterable[pa.RecordBatch], names: Sequence[str], states: int) -> Iterator[pa.RecordBatch]:
    """Each row with the states before and after it: the rows that are as far into their chunk take a step at once."""
    now = 0
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        moves, first, at = _functions(batch, states).ravel(), batch.column("_row").to_numpy() == 1, np.arange(size)
        since = at - np.maximum.accumulate(np.where(first, at, 0))
        before, after = batch.column("_entry").to_numpy().astype(np.intp), np.empty(size, np.intp)
        if not first[0]:
            before[0] = now
        order, ends = np.argsort(since, kind="stable"), np.cumsum(np.bincount(since))
        for low, high in zip([0, *ends], ends, strict=False):
            rows = order[low:high]
            if low:
                before[rows] = after[rows - 1]
            after[rows] = moves[rows * states + before[rows]]
        now = after[-1]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(before, pa.int32()), pa.array(after, pa.int32())], names=[*names, "_before", "_after"])


def _around(moves: DataFrame, keys: list[str], start: int, states: int, longest: int, chunk: int) -> DataFrame:
    """``moves(keys, _at, _moves, ...)`` with ``_before`` and ``_after``, the states around each row, without ``_moves``."""
    parts = moves.withColumn("_chunk", F.floor(F.col("_at") / chunk).cast("long"))
    order = Window.partitionBy(*keys, "_chunk").orderBy("_at")
    schema = moves.drop("_moves").schema

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_row", F.row_number().over(order)).sortWithinPartitions(*keys, "_chunk", "_at")

    if longest < chunk:
        entered = parts.withColumn("_entry", F.lit(start))
    else:
        parts = stored(parts, "chunks")
        whole = StructType([*parts.select(*keys, "_chunk").schema, StructField("_moves", BinaryType())])
        each = stored(in_order(parts.select(*keys, "_chunk", "_at", "_moves")).mapInArrow(partial(_whole, names=[*keys, "_chunk"], states=states), whole), "chunk-moves")
        above = _around(each.withColumnRenamed("_chunk", "_at"), keys, start, states, longest // chunk, chunk)
        above = above.select(*[F.col(k).alias(f"_up_{n}") for n, k in enumerate(keys)], F.col("_at").alias("_up"), F.col("_before").alias("_entry"))
        met = F.col("_chunk") == F.col("_up")
        for n, k in enumerate(keys):
            met = met & F.col(k).eqNullSafe(F.col(f"_up_{n}"))
        entered = parts.join(above, met).select(*parts.columns, "_entry")
    out = StructType([*schema, StructField("_before", IntegerType()), StructField("_after", IntegerType())])
    return in_order(entered).mapInArrow(partial(_states, names=schema.names, states=states), out)


def scan_states(lines: DataFrame, keys: Sequence[str], position: str, kind: str, table: dict[str, Sequence[int]], start: int = 0, chunk: int = CHUNK, longest: int | None = None) -> DataFrame:
    """``lines`` with ``before`` and ``after``, the states of an automaton around each line.

    ``table`` gives for a kind of line the next state of every state; a kind that it doesn't name, or null, changes nothing.
    ``position`` numbers the lines of a key from 0 without repeats; gaps are allowed.  ``longest``, a number that no position
    exceeds, spares a pass over ``lines`` that finds the greatest one.
    """
    keys, states = list(keys), len(next(iter(table.values())))
    moves = F.lit(_packed(range(states)))
    for name, to in table.items():
        moves = F.when(F.col(kind) == name, F.lit(_packed(to))).otherwise(moves)
    placed = lines.select(*keys, F.col(position).cast("long").alias("_at"), moves.alias("_moves"), F.struct(*[c for c in lines.columns if c not in keys]).alias("_line"))
    if longest is None:
        longest = placed.agg(F.max("_at")).first()[0]
    if longest is None:
        return lines.withColumns({"before": F.lit(start), "after": F.lit(start)})
    found = _around(placed, keys, start, states, longest, chunk)
    return found.select(*keys, "_line.*", F.col("_before").alias("before"), F.col("_after").alias("after"))


# -- what a line is ---------------------------------------------------------------------------

#: The names and headings that structure a report.
SOURCES = ("transunion", "experian", "equifax")
STOP_MARKER = "publicinformation"
SECTION_NAMES = {"collection": "collections", "unknown": "unknown"}
TWO_YEARS = r"(?i)\bTwo[-\s]?Year\b.*\bPayment\b.*\bHistory\b"
SEVEN_YEARS = r"(?i)Days\s*Late|7\s*Year\s*History"
GRID_TOKENS = ("ok", "0", "30", "60", "90")
NOISE = r"(?i)^https?://|^\d{1,2}/\d{1,2}/\d{2,4}.*(Credit\s*Report|SmartCredit)"
LABEL = r"^(\s*+[^:#：﹕︓\s][^:#：﹕︓]*+)[:#：﹕︓]\s*(.*)$"  # possessive: a line without a mark is told in one pass
MONTH = r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?$"
NO_HEADING = "public information|inquiries|collections|total accounts|credit summary"
BACK_LINES = 7


def plain(text: Column) -> Column:
    """Letters and digits of ASCII, lower-cased."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def is_plain(text: Column, *words: str) -> Column:
    """Whether the text is one of these words but for marks, spaces and capitals: most texts are told by their length or first letter."""
    spelled = "|".join("".join(f"{letter}[^a-z0-9]*" for letter in word) for word in words)
    return (F.length(text) >= min(map(len, words))) & F.lower(text).rlike(rf"^[^a-z0-9]*(?:{spelled})\z")


def is_triad(text: Column) -> Column:
    found = F.lit(True)
    for name in SOURCES:
        found = found & F.contains(F.lower(text), F.lit(name))
    return found


def is_anchor(text: Column) -> Column:
    return F.startswith(F.trim(text), F.lit("Account #"))


def is_headline(text: Column) -> Column:
    """All capitals: at least three letters, digits or ``/&-``, none of them a small letter."""
    # Most lines have a small letter, which is told soonest.
    return ~text.rlike("[a-z]") & text.rlike("[A-Z]") & (F.length(F.regexp_replace(text, r"[^A-Za-z0-9/&\-]", "")) >= 3)


def line_kind(text: Column) -> Column:
    """What a report line does to the automaton of ``MOVES``; null and blank lines are ``other``."""
    low = F.lower(text)
    spelled = "|".join("".join(rf"{letter}[®\s]*" for letter in name) for name in SOURCES)
    token = f"(?:{'|'.join(GRID_TOKENS)})"
    grid = F.lower(F.trim(text)).rlike(rf"^{token}\s+{token}\s+{token}\z")
    short = (F.length(F.trim(text)) <= 3) & ~F.trim(text).rlike(r"\s")
    # The words that a heading can't be without are looked for first.
    year = F.contains(low, F.lit("year"))
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "other")
        .when(is_plain(text, STOP_MARKER), "stop").when(is_plain(text, *SECTION_NAMES), "section")
        .when(is_anchor(text), "anchor").when(year & text.rlike(TWO_YEARS), "two_years").when((year | F.contains(low, F.lit("days"))) & text.rlike(SEVEN_YEARS), "seven_years")
        .when(is_triad(text), "triad").when(low.rlike(rf"^[®\s]*(?:{spelled})\z"), "source").when(grid, "grid")
        .when(text.rlike(LABEL), "row").when(is_headline(text) | short, "other").otherwise("values")
    )


OUTSIDE, READY, OPEN, TWO, SEVEN_TITLE, SEVEN, ENDED = range(7)
#: What each kind of line makes of the seven states, in their order.
MOVES = {
    "stop": (ENDED,) * 7,
    "section": (OUTSIDE, OUTSIDE, OUTSIDE, OUTSIDE, OUTSIDE, OUTSIDE, ENDED),
    "anchor": (OPEN, OPEN, OPEN, OPEN, OPEN, OPEN, ENDED),
    "two_years": (TWO, TWO, TWO, TWO, TWO, TWO, ENDED),
    "seven_years": (SEVEN_TITLE, SEVEN_TITLE, SEVEN_TITLE, SEVEN_TITLE, SEVEN_TITLE, SEVEN, ENDED),
    "triad": (OUTSIDE, READY, READY, OUTSIDE, SEVEN, OUTSIDE, ENDED),
    "source": (OUTSIDE, OUTSIDE, OUTSIDE, TWO, SEVEN_TITLE, OUTSIDE, ENDED),
    "grid": (OUTSIDE, OUTSIDE, OUTSIDE, TWO, SEVEN_TITLE, SEVEN, ENDED),
    "row": (OUTSIDE, OPEN, OPEN, TWO, SEVEN_TITLE, SEVEN, ENDED),
    "other": (OUTSIDE, READY, READY, TWO, SEVEN_TITLE, SEVEN, ENDED),
}

# -- accounts ---------------------------------------------------------------------------------


def split_accounts(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lines of each account of ``lines(keys, page, position, text)``: account, heading, source, section, section_start.

    Accounts are numbered by their anchors.  An account begins at its heading: the headline above the three source
    names, else the nearest headline of the same page within ``BACK_LINES`` lines, else the names or the anchor
    itself, with the heading of the previous page's last three lines if the anchor stands at the top of its page.  A section
    line moves the next account's start to the first headline of the four lines after it (else to the line after it) and
    names the section of that account and those after it; of several before one account the last counts.
    An account ends at the next one's start or at a section line.  Noise lines and everything from the first stop marker on go.  Section
    lines and names of sources at the end of an account belong to the next account that has other lines.
    ``position`` orders a document's lines.  Windows are of a page or run along a document in order.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("position")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    page = Window.partitionBy(*keys, "page").orderBy("position")
    back = page.rowsBetween(-BACK_LINES, -1)
    text = F.trim(F.coalesce("text", F.lit("")))
    head = is_headline(text) & ~is_triad(text)
    marked = lines.withColumn("_stopped", F.max(is_plain(text, STOP_MARKER)).over(upto)).where(~F.col("_stopped"))
    marked = marked.withColumns({"_triad": is_triad(text), "_head": head, "_anchor": is_anchor(text), "_section": F.when(is_plain(text, *SECTION_NAMES), plain(text))})
    here = F.struct("position", text.alias("text"))
    above = F.struct("position", F.when(F.lag("_head").over(page), F.lag(here).over(page)).alias("head"))
    marked = marked.withColumns({"_names": F.when(F.col("_triad"), above), "_row": F.row_number().over(page)})
    marked = marked.withColumns({"_names": F.last("_names", ignorenulls=True).over(back), "_near": F.last(F.when(F.col("_head"), here), ignorenulls=True).over(back)})
    # The headline among the last three lines of each page, for anchors in the first three lines of the next.
    foot = lines.select(*keys, "page", "position", text.alias("text")).withColumn("_up", F.row_number().over(Window.partitionBy(*keys, "page").orderBy(F.col("position").desc()))).where("_up <= 3")
    usable = is_headline(F.col("text")) & ~F.lower("text").rlike(rf"^https?://|\bpage\s+\d+\s+of\s+\d+\b|^\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}$|{NO_HEADING}")
    foot = foot.where(usable).groupBy(*keys, (F.col("page") + 1).alias("page")).agg(F.min_by("text", "_up").alias("_foot"))
    start = F.coalesce("_names.head.position", "_near.position", "_names.position", "position")
    heading = F.coalesce("_names.head.text", "_near.text", F.when(F.col("_row") <= 3, F.col("_foot")))
    source = F.when(F.col("_names.head").isNotNull(), "triad_above").when(F.col("_near").isNotNull(), "backtrack").when((F.col("_row") <= 3) & F.col("_foot").isNotNull(), "cross_page_backtrack").otherwise("anchor_no_heading")
    # Only anchors meet the foot of the page before: lines stay where they are.
    anchors = marked.where("_anchor").join(foot, [*keys, "page"], "left").select(*keys, "position", start.alias("start"), heading.alias("heading"), source.alias("source")).withColumn("account", F.row_number().over(w))
    # A section line comes before the first account that starts after it.
    ahead = F.array(*[F.when(F.lead("_head", k).over(w), F.lead(here, k).over(w)) for k in range(1, 5)])
    following = F.coalesce(F.get(F.array_compact(ahead), F.lit(0)), F.lead(here).over(w))
    named = marked.withColumn("_next", following).where("_section is not null").select(*keys, F.col("position").alias("start"), F.struct("position", "_section", F.col("_next.position").alias("at"), F.col("_next.text").alias("text")).alias("named"), F.lit(None).cast("int").alias("account"))
    after = Window.partitionBy(*keys).orderBy(F.col("start").desc(), F.col("account").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = anchors.select(*keys, "start", F.lit(None).cast(named.schema["named"].dataType).alias("named"), "account").unionByName(named)
    named = both.withColumn("account", F.last("account", ignorenulls=True).over(after)).where("named is not null and account is not null").groupBy(*keys, "account").agg(F.max("named").alias("named"))
    joined = anchors.drop("position").join(named, [*keys, "account"], "left")
    section = F.create_map(*[F.lit(x) for pair in SECTION_NAMES.items() for x in pair])
    joined = joined.select(
        *keys, "account", F.coalesce("named.at", "start").alias("position"), F.when(F.col("named.at").isNotNull(), F.col("named.text")).otherwise(F.col("heading")).alias("heading"),
        F.when(F.col("named").isNotNull(), "section+heading").otherwise(F.col("source")).alias("source"), F.element_at(section, F.col("named._section")).alias("section"), F.col("named").isNotNull().alias("section_start"),
    )
    by_account = Window.partitionBy(*keys).orderBy("account").rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("section", F.last("section", ignorenulls=True).over(by_account))
    # An account that a section moved to or past the next one's start has no lines.
    following = F.lead("position").over(Window.partitionBy(*keys).orderBy("account"))
    joined = joined.withColumn("_following", following).where(F.col("_following").isNull() | (F.col("position") < F.col("_following"))).drop("_following")
    starts = joined.groupBy(*keys, "position").agg(F.max("account").alias("_starts"))
    placed = marked.join(starts, [*keys, "position"], "left").withColumn("account", F.last("_starts", ignorenulls=True).over(upto))
    within = Window.partitionBy(*keys, "account")
    cut = F.min(F.when(F.col("_section").isNotNull(), F.col("position"))).over(within)
    placed = placed.where("account is not null").withColumn("_cut", cut).where((F.col("_cut").isNull() | (F.col("position") < F.col("_cut"))) & ~text.rlike(NOISE))
    last = F.max(F.when(~F.col("_triad"), F.col("position"))).over(within)
    placed = placed.withColumn("_last", last).withColumn("_owner", F.when(F.col("position") <= F.col("_last"), F.col("account")))
    # Read from the end: a frame that ends at the document's end would be read anew for every line.
    later = Window.partitionBy(*keys).orderBy(F.col("position").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("account", F.last("_owner", ignorenulls=True).over(later)).where("account is not null")
    return placed.select(*keys, "page", "position", "text", "account").join(joined.drop("position"), [*keys, "account"])


# -- rows of three sources --------------------------------------------------------------------


def clean(text: Column) -> Column:
    bare = F.replace(text, F.lit("®"), F.lit(""))
    # Most texts have single spaces only.
    return F.trim(F.when(bare.rlike(r"\s\s|[^\S ]"), F.regexp_replace(bare, r"\s+", " ")).otherwise(bare))


def split_tail(tail: Column) -> Column:
    """What follows a label, as three values: at dashes, else at wide gaps, else word by word.

    Dashes alone are three dashes; an empty part between dashes is one.  With single spaces a month and its year are one
    word and the third value takes the rest; a fourth value and those after it join the third; missing ones are empty.
    """
    text = F.trim(F.replace(F.coalesce(tail, F.lit("")), F.lit("\u00a0"), F.lit(" ")))
    text = F.replace(F.replace(text, F.lit("—"), F.lit("--")), F.lit("–"), F.lit("--"))

    def parts(s: Column) -> Column:
        trimmed = F.transform(F.split(s, "--"), lambda p: F.trim(p))
        by_dash = F.transform(trimmed, lambda p: F.when(p == "", "--").otherwise(p))
        by_gap = F.filter(F.transform(F.split(s, r"\s{2,}"), lambda p: F.trim(p)), lambda p: p != "")
        tokens = F.filter(F.split(s, " "), lambda p: p != "")

        def months(words: Column) -> Column:
            bare = lambda k: F.regexp_replace(F.coalesce(F.get(words, k), F.lit("")), "[.,]$", "")
            taken = lambda k: F.when(bare(k).rlike(MONTH) & bare(k + 1).rlike(r"^\d{2,4}$"), 2).otherwise(1)

            def grouped(first: Column) -> Column:
                def rest(second: Column) -> Column:
                    piece = lambda at, n: F.array_join(F.slice(words, at + 1, n), " ")
                    return F.array(piece(F.lit(0), first), piece(first, second), piece(first + second, F.size(words)))

                return bound(taken(first), rest)

            return bound(taken(F.lit(0)), grouped)

        # Dashes and wide gaps are looked for before texts are cut at them.
        dashes = F.contains(s, F.lit("--")) & (F.contains(s, F.lit(" -- ")) | (F.size(F.split(s, "--")) > 2))
        gaps = s.rlike(r"\s\s") & (F.size(by_gap) >= 3)
        some = F.when(dashes, by_dash).when(gaps, by_gap).otherwise(bound(tokens, lambda words: F.when(F.size(words) >= 3, months(words)).otherwise(words)))
        cleaned = lambda p: F.transform(p, clean)
        third = lambda p: clean(F.array_join(F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0))), " "))
        three = lambda p: F.array(F.coalesce(F.get(p, F.lit(0)), F.lit("")), F.coalesce(F.get(p, F.lit(1)), F.lit("")), third(p))
        return bound(bound(some, cleaned), three)

    empty, dash = F.array(*[F.lit("")] * 3), F.array(*[F.lit("--")] * 3)
    return F.when(text == "", empty).when(F.replace(text, F.lit(" "), F.lit("")).rlike("^-+$"), dash).otherwise(bound(text, parts))


#: What shows that a line holds values of several sources.
SEVERAL = (
    (r"--", 2), (r"\d{1,2}\.\d{1,2}\.\d{2,4}", 2), (r"\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}/\d{2,4}", 2),
    (r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{2,4}\b", 2), (r"\$\s*\d", 2), (r"\b\d[\d,./]*\b", 3), (r"\s{2,}", 1),
)


def looks_multi(text: Column) -> Column:
    sample = F.trim(F.replace(text, F.lit(" "), F.lit(" ")))
    found, digits = F.lit(False), sample.rlike("[0-9]")
    for pattern, least in SEVERAL:
        if pattern == "--":
            several = F.contains(sample, F.lit("--")) & (F.regexp_count(F.regexp_replace(sample, r"\s+", " "), F.lit(pattern)) >= least)
        elif least == 1:
            several = sample.rlike(pattern)
        else:  # all of these have a digit
            several = digits & (F.regexp_count(sample, F.lit(pattern)) >= least)
        found = found | several
    return found


def triad_rows(lines: DataFrame, keys: Sequence[str], longest: int | None = None) -> DataFrame:
    """``keys, row, label, first_position, transunion, experian, equifax``: labelled rows with their continuation lines.

    ``lines(keys, position, text)``: positions number a key's lines.  A labelled line opens a row after an anchor; a line of values goes on with
    it, split in three if it looks like several values, else as one more fragment of the source that last got text (the first
    if none did); any other line closes it.  A label without values takes them from the lines that follow.  ``longest`` is that of ``scan_states``.
    """
    keys = list(keys)
    held = scan_states(lines.select(*keys, "position", "text", line_kind(F.col("text")).alias("kind")), keys, "position", "kind", MOVES, longest=longest)
    opens = F.col("kind").isin("row", "anchor") & (F.col("after") == OPEN)
    goes_on = (F.col("kind") == "values") & (F.col("before") == OPEN)
    kept = held.where(opens | goes_on).withColumn("_opens", opens)
    w = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("row", F.sum(F.col("_opens").cast("int")).over(w).cast("long"))
    text = F.trim("text")
    kept = kept.withColumn("_tail", F.when(F.col("_opens"), F.regexp_extract(text, LABEL, 2)).otherwise(text))
    tail = F.col("_tail")
    single = ~F.col("_opens") & ~F.coalesce(looks_multi(tail), F.lit(False))
    told = lambda v: ~v.isin("", "--")
    kept = kept.withColumns({"_single": single, "_parts": F.when(single, F.array(clean(tail))).otherwise(split_tail(tail))})
    part = [F.get("_parts", F.lit(k)) for k in range(3)]
    # The source that last got text: a fragment goes to it and changes nothing, so it is that of the latest line of several values, or of the row's first.
    latest = F.when(~F.col("_single"), F.when(told(part[2]), 2).when(told(part[1]), 1).when(told(part[0]) | F.col("_opens"), 0))
    kept = kept.withColumn("_source", F.last(latest, ignorenulls=True).over(w))
    values = [F.when(F.col("_single"), F.when(F.col("_source") == k, part[0]).otherwise("")).otherwise(part[k]).alias(name) for k, name in enumerate(SOURCES)]
    listed = F.array_sort(F.collect_list(F.struct("position", *values)))
    label = F.min_by(F.when(F.col("_opens"), clean(F.regexp_extract(text, LABEL, 1))), "position")
    rows = kept.groupBy(*keys, "row").agg(label.alias("label"), F.min("position").alias("first_position"), listed.alias("_pieces"))

    def joined(fragments: Column) -> Column:
        """Fragments one after another: a dash only fills an empty value, and text replaces a dash."""
        texts = F.filter(fragments, told)
        return bound(texts, lambda some: F.when(F.size(some) > 0, F.array_join(some, " ")).when(F.array_contains(fragments, "--"), "--").otherwise(""))

    return rows.select(*keys, "row", "label", "first_position", *[joined(F.col(f"_pieces.{name}")).alias(name) for name in SOURCES])
