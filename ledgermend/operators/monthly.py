"""Monthly payment histories from layout tokens: months and statuses found, rows paired, years attributed.

Everything is joins and windows by account and source; arrays hold the rows of
one source's two years, some fifty tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermend.functions.text import HEBREW_MONTHS, table
from ledgermend.operators import layout, sequence
from ledgermend.workspace import discard, stored

#: Statuses of a history, months, and how a year is marked.
STATUSES = ("ok", "co", "30", "60", "90", "120", "150", "180")
MONTH_NUMBERS = {"jan": "1", "feb": "2", "mar": "3", "apr": "4", "may": "5", "jun": "6", "jul": "7", "aug": "8", "sep": "9", "sept": "9", "oct": "10", "nov": "11", "dec": "12"}
YEAR_MARK = "^[\"'’](\\d{2})$"
#: How far apart rows on different pages count, and how far tokens of one row may lie.
PAGE_HEIGHT = 800.0
ROW_HEIGHT = 2.5


def month_number(raw: Column) -> Column:
    """1 to 12 of an English month (with a dot or a year behind it) or a Hebrew one; null for other texts."""
    word = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"\.+$", ""), r"\s*\(?\s*['’]?\d{2,4}\)?$", "")
    hebrew = F.nullif(F.array_position(F.array(*[F.lit(m) for m in HEBREW_MONTHS]), F.trim(raw)), F.lit(0))
    return F.coalesce(F.try_element_at(table(MONTH_NUMBERS), word).cast("int"), hebrew.cast("int"))


def marked_year(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(raw), YEAR_MARK, 1), F.lit("")).cast("int") + 2000


def two_years(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """The tokens of the two-year section with their bureau: from its heading up to that of seven years, below the first bureau's name."""
    low = F.lower(F.trim("text"))
    heading = low.contains("two") & (low.contains("year") | low.contains("payment"))
    other = low.contains("history") & (F.length(low) > 3)
    seven = (low.contains("seven") | low.contains("7")) & (low.contains("year") | low.contains("history") | (F.length(low) <= 2))
    every = Window.partitionBy(*keys)
    inside = tokens.withColumn("_from", F.coalesce(F.min(F.when(heading, F.col("n"))).over(every), F.min(F.when(other, F.col("n"))).over(every))).where(F.col("n") >= F.col("_from"))
    inside = inside.withColumn("_to", F.min(F.when(seven & (F.col("n") > F.col("_from")), F.col("n"))).over(every)).where(F.col("_to").isNull() | (F.col("n") < F.col("_to")))
    named = F.coalesce(*[F.when(low.contains(b), F.lit(b)) for b in layout.BUREAU_NAMES])
    w = Window.partitionBy(*keys).orderBy("n")
    mark = F.when(F.row_number().over(Window.partitionBy(*keys, named).orderBy("n")) == 1, named)
    placed = inside.withColumn("_mark", mark).withColumn("bureau", F.last("_mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.where("bureau is not null").drop("_from", "_to", "_mark")


def in_rows(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens with the number of their row: by page, then by height, a row's first token deciding."""
    y = ((F.col("y0") + F.col("y1")) / 2).alias("y")
    entry = F.struct(y, ((F.col("x0") + F.col("x1")) / 2).alias("x"), "n", "text", "x0", "x1")
    pages = tokens.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(entry)).alias("t"))
    numbered = sequence.clusters_from_anchor(F.transform("t", lambda e: e["y"]), ROW_HEIGHT)
    return pages.select(*keys, "page", F.explode(F.arrays_zip(F.col("t"), numbered.alias("row"))).alias("z")).select(*keys, "page", F.col("z.row").alias("row"), "z.t.*")


def paired_rows(months: DataFrame, statuses: DataFrame, keys: list[str]) -> DataFrame:
    """``page, row`` of month rows with the status row above each (``s_page, s_row``): the nearest that no earlier month row took.

    On another page only if months and statuses don't fill the same pages.
    """
    rows = lambda df, name: df.groupBy(*keys, "page", "row").agg(F.min("y").alias("y")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page", "row", "y"))).alias(name))
    both = rows(months, "m").join(rows(statuses, "s"), keys)
    sheets = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda r: r["page"])))
    both = both.withColumn("across", sheets(F.col("m")) != sheets(F.col("s")))
    pair = "array<struct<page:int,row:int,s_page:int,s_row:int>>"

    def step(done: Column, month: Column) -> Column:
        def above(status: Column) -> Column:
            same = (status["page"] == month["page"]) & (status["y"] < month["y"])
            free = ~F.exists(done, lambda d: (d["s_page"] == status["page"]) & (d["s_row"] == status["row"]))
            return free & (same | (F.col("across") & (status["page"] < month["page"])))

        far = lambda s: (month["page"] - s["page"]) * PAGE_HEIGHT + month["y"] - s["y"]
        best = F.array_min(F.transform(F.filter("s", above), lambda s: F.struct(far(s).alias("d"), s["page"].alias("s_page"), s["row"].alias("s_row"))))
        found = F.struct(month["page"].cast("int").alias("page"), month["row"].cast("int").alias("row"), best["s_page"].cast("int").alias("s_page"), best["s_row"].cast("int").alias("s_row"))
        return F.concat(done, F.array(found))

    found = F.aggregate("m", F.array().cast(pair), step)
    return both.select(*keys, F.explode(found).alias("p")).select(*keys, "p.*")


def monthly_history(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, bureau, place, month, status, month_number, derived_year, month_year_key`` of the two-year sections.

    ``tokens`` has the keys, n (reading order), page, text, x0, x1, y0 and y1.  A month takes the status that
    overlaps it most in the nearest free row above, ``--`` if there is none.  A year's mark is January of that
    year; years go on from mark to mark.
    """
    own = [*keys, "bureau"]
    found = stored(layout.expand_packed(two_years(tokens, keys)), "monthly-tokens")  # read twice, and what follows several times
    months = in_rows(found.where(month_number(F.col("text")).isNotNull() | marked_year(F.col("text")).isNotNull()), own)
    statuses = in_rows(found.where(F.lower(F.trim("text")).isin(*STATUSES)), own)
    w = Window.partitionBy(*own).orderBy("page", "row", "x", "n")
    months, statuses = stored(months.withColumn("place", F.row_number().over(w)), "monthly-months"), stored(statuses, "monthly-statuses")
    discard(found)
    pairs = paired_rows(months, statuses, own)
    left = months.join(pairs, [*own, "page", "row"]).where("s_row is not null").select(*own, F.col("s_page").alias("page"), F.col("s_row").alias("row"), "place", F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    right = statuses.withColumn("_status", F.struct("x", "n", F.lower(F.trim("text")).alias("status"))).select(*own, "page", "row", "_status", F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    hit = layout.best_overlap(left, right, [*own, "page", "row"], "place", "_status").select(*own, "place", F.col("_status.status").alias("status"))
    rows = months.join(hit, [*own, "place"], "left").select(*own, "place", F.trim("text").alias("month"), F.coalesce("status", F.lit("--")).alias("status"), marked_year(F.col("text")).alias("_year"), F.coalesce(month_number(F.col("text")), F.when(marked_year(F.col("text")).isNotNull(), 1)).alias("month_number"))
    return sequence.carry_years(rows, own, "place", "month_number", "_year").drop("_year")
