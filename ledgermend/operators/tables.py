"""Tables of three sources from tokens with places: source columns, label rows and what stands where they cross."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermend.functions.lets import bound
from ledgermend.operators.statements import SOURCES

HALF_WIDTHS = (60.0, 140.0)
BAND = 3.0
WRAP = 9.0


def source_columns(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, source, left, right``: where each source's column lies, from the tokens that name it.

    The upper middle of a source's centres counts; half the distance to the nearer neighbour, less 5 %, within 60 to 140,
    is its half-width; columns are clipped half a unit short of the middle between neighbours.  A block that names
    fewer than two sources has no columns.  ``tokens`` has the keys, text, x0 and x1.
    """
    keys = list(keys)
    named = tokens.withColumn("source", F.regexp_replace(F.lower("text"), "[^a-z]", "")).where(F.col("source").isin(*SOURCES))
    middles = F.array_sort(F.collect_list((F.col("x0") + F.col("x1")) / 2))
    centres = named.groupBy(*keys, "source").agg(middles.alias("_all")).select(*keys, "source", F.get("_all", F.floor(F.size("_all") / 2).cast("int")).alias("mid"))
    w = Window.partitionBy(*keys).orderBy("mid", "source")
    sided = centres.withColumn("_column", _column(F.col("mid"), F.lag("mid").over(w), F.lead("mid").over(w))).where("_column is not null")
    return sided.select(*keys, "source", "_column.left", "_column.right")


def _column(mid: Column, before: Column, after: Column) -> Column:
    """left and right of a column between the middles of its neighbours; null if it has none."""
    gap = F.least(mid - before, after - mid)
    half = F.least(F.lit(HALF_WIDTHS[1]), F.greatest(F.lit(HALF_WIDTHS[0]), gap / 2 * 0.95))
    left, right = F.greatest(mid - half, (before + mid) / 2 + 0.5), F.least(mid + half, (mid + after) / 2 - 0.5)
    sides = F.when(left > right, F.struct((mid - 1).alias("left"), (mid + 1).alias("right"))).otherwise(F.struct(left.alias("left"), right.alias("right")))
    return F.when(gap.isNotNull(), sides)


def plain_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def source_table(tokens: DataFrame, keys: Sequence[str], labels: dict[str, str]) -> DataFrame:
    """``keys, field, transunion, experian, equifax``: what stands right of each label in each source's column; a label that isn't there has no row.

    ``labels`` maps a label's plain text to its field.  ``tokens`` has the keys, line, text, x0, x1, y0 and y1.  A line that is a label (the
    topmost, if several) gives a row: tokens of lines within ``BAND`` of its middle, left to right, then those around each further
    line, top to bottom, up to ``WRAP`` below that is no label.  Dashes alone are ``--``.

    A block is one row of lines, so tokens are shuffled at most to their lines and these to their block, and neither where ``tokens`` lies dealt by
    the keys already.  Null keys have rows without values.
    """
    keys = list(keys)
    words = tokens.withColumns({"text": F.trim("text"), "_x": (F.col("x0") + F.col("x1")) / 2})
    # Most tokens are told by their first letter.
    named = F.when(F.lower("text").rlike("^[^a-z]*[te]"), F.regexp_replace(F.lower("text"), "[^a-z]", ""))
    token = F.struct(F.col("x0").alias("from"), F.col("x1").alias("to"), "text", "_x", ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.when(named.isin(*SOURCES), named).alias("source"))
    line = words.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(token)).alias("_tokens"))
    heights = F.array_sort(F.filter(F.col("_tokens.y"), lambda y: y.isNotNull()))
    field = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    shown = F.filter("_tokens", lambda t: t["text"] != "")
    line = line.select(
        *keys, bound(heights, lambda ys: F.get(ys, F.floor(F.size(ys) / 2).cast("int"))).alias("y"), F.element_at(field, plain_label(F.array_join(F.col("_tokens.text"), " "))).alias("field"),
        F.transform(shown, lambda t: F.struct(t["_x"].alias("x"), t["text"].alias("text"), t["source"].alias("source"))).alias("tokens"),
    )
    block = line.groupBy(*keys).agg(F.collect_list(F.struct("y", "field", "tokens")).alias("_lines"))
    block = block.select(*keys, "_lines", F.filter(F.array_distinct(F.col("_lines.field")), lambda f: f.isNotNull()).alias("_fields")).where(F.size("_fields") > 0)
    block = block.select(*keys, "_lines", "_fields", bound(F.filter(F.flatten("_lines.tokens"), lambda t: t["source"].isNotNull()), _columns_of).alias("_columns"))
    found = block.select(*keys, "_lines", "_columns", F.explode("_fields").alias("field"))
    found = found.select(*keys, "field", bound(_pieces(F.col("_lines"), F.col("field")), lambda pieces: F.struct(*[_text_of(pieces, F.col("_columns")[source]).alias(source) for source in SOURCES])).alias("_values"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return found.select(*keys, "field", *[F.when(known, F.col("_values")[source]).otherwise("").alias(source) for source in SOURCES])


def _columns_of(tokens: Column) -> Column:
    """The columns of ``source_columns`` by source, from a block's tokens that name them."""

    def centre(source: str) -> Column:
        middles = F.array_sort(F.transform(F.filter(tokens, lambda t: (t["source"] == source) & t["x"].isNotNull()), lambda t: t["x"]))
        return bound(middles, lambda xs: F.get(xs, F.floor(F.size(xs) / 2).cast("int")))

    centres = F.filter(F.array_sort(F.array(*[F.struct(centre(source).alias("mid"), F.lit(source).alias("source")) for source in SOURCES])), lambda c: c["mid"].isNotNull())
    sided = lambda cs: F.transform(cs, lambda c, k: F.struct(c["source"].alias("source"), _column(c["mid"], F.get(cs, k - 1)["mid"], F.get(cs, k + 1)["mid"]).alias("column")))
    of = lambda cs, source: F.get(F.filter(cs, lambda c: c["source"] == source), F.lit(0))["column"].alias(source)
    return bound(bound(centres, sided), lambda cs: F.struct(*[of(cs, source) for source in SOURCES]))


def _pieces(lines: Column, field: Column) -> Column:
    """part, x and text of the tokens around a field's row and the lines below it that go on with it."""
    row = F.array_min(F.transform(F.filter(lines, lambda line: line["field"] == field), lambda line: line["y"]))

    def middles(y: Column) -> Column:
        below = F.filter(lines, lambda line: line["field"].isNull() & (line["y"] > y + BAND) & (line["y"] <= y + WRAP))
        return F.array_sort(F.concat(F.array(y), F.transform(below, lambda line: line["y"])))

    def around(middle: Column, part: Column) -> Column:
        near = F.filter(lines, lambda line: F.abs(line["y"] - middle) <= BAND)
        return F.flatten(F.transform(near, lambda line: F.transform(line["tokens"], lambda t: F.struct(part.alias("part"), t["x"].alias("x"), t["text"].alias("text")))))

    return F.flatten(F.transform(bound(row, middles), around))


def _text_of(pieces: Column, column: Column) -> Column:
    """One column's joined tokens; runs of dashes are ``--``."""
    within = F.array_sort(F.filter(pieces, lambda p: p["x"].between(column["left"], column["right"])))

    def shown(found: Column) -> Column:
        joined = F.trim(F.regexp_replace(F.array_join(F.transform(found, lambda p: p["text"]), " "), r"\s+", " "))
        return F.when(F.size(found) == 0, "").otherwise(bound(joined, lambda text: F.when(text.rlike("^[-–—]+$"), "--").otherwise(text)))

    return bound(within, shown)


def in_windows(tokens: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The tokens of each window of their page whose middle lies in it: ``windows`` has the keys, block, page, x_min, x_max, y_top, y_bottom."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    met = tokens.join(windows, [*keys, "page"]).where(x.between(F.col("x_min"), F.col("x_max")) & y.between(F.col("y_top"), F.col("y_bottom")))
    return met.drop("x_min", "x_max", "y_top", "y_bottom")


def template_confidence(tokens: DataFrame, session: str, block: str, labels: Sequence[str]) -> DataFrame:
    """Per session how surely its blocks follow the template: confidence, blocks_checked, blocks_with_bands, label_coverage_mean.

    Half is the share of blocks that name two sources at least as tokens of their own, half the mean share of ``labels`` (plain texts) that are lines of a block.
    Blocks without tokens don't count; a session without any isn't listed.
    """
    known = sorted(set(labels))
    named = F.collect_set(F.when(F.lower(F.trim("text")).isin(*SOURCES), F.lower(F.trim("text"))))
    line = tokens.groupBy(session, block, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda t: t["text"]), " ").alias("_text"), named.alias("_named"))
    line = line.withColumn("_label", plain_label(F.col("_text")))
    each = line.groupBy(session, block).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_named")))).alias("_sources"), F.count_distinct(F.when(F.col("_label").isin(*known), F.col("_label"))).alias("_found")
    )
    total = each.groupBy(session).agg(F.count(F.lit(1)).alias("blocks_checked"), F.count_if(F.col("_sources") >= 2).alias("blocks_with_bands"), F.avg(F.col("_found") / max(len(known), 1)).alias("label_coverage_mean"))
    return total.withColumn("confidence", 0.5 * F.col("blocks_with_bands") / F.col("blocks_checked") + 0.5 * F.col("label_coverage_mean"))
