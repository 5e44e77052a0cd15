"""Accounts from plain report lines: the source that a line speaks of carried down, numbers, statuses and histories read from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermend.operators.layout import BUREAU_NAMES

#: How sources, numbers, statuses and histories are written.
SOURCE = r"(?i)^(Trans\s*Union|Experian|Equifax)\b"
NUMBER = r"(?i)(?:Account\s*(?:#|Number|No\.?)|Acct\s*(?:#|No\.?))\s*:?\s*(.+)"
STATUS = r"(?i)payment status:\s*(.+)"
TWO_YEARS, SEVEN_YEARS = "two-year payment history", "days late -7 year history"
LATE = r"30:(\d+)\s+60:(\d+)\s+90:(\d+)"


def clean(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[Â®™]", "")), r"\s+", " ")


def source_of(text: Column) -> Column:
    """The source whose name begins a clean line; null if none does."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(text, SOURCE, 1)), r"\s", ""), F.lit(""))


def with_source(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``lines(keys, position, text)`` with ``clean``, ``named`` (the source that begins the line) and ``source``, that of the nearest such line up to here.

    A line that names two sources or more ends what a source says.
    """
    w = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    low = F.lower(F.col("clean"))
    several = sum((low.rlike(p).cast("int") for p in (r"trans\s*union", "experian", "equifax")), F.lit(0)) > 1
    marked = lines.withColumn("clean", clean(F.col("text"))).withColumn("named", F.when(~several, source_of(F.col("clean"))))
    return marked.withColumn("_mark", F.when(several, "").otherwise(F.col("named"))).withColumn("source", F.nullif(F.last("_mark", ignorenulls=True).over(w), F.lit(""))).drop("_mark")


def account_number(text: Column) -> Column:
    """Without white space and dashes; null if no digit is in it."""
    return F.when(text.rlike(r"\d"), F.regexp_replace(text, r"[\s-]", ""))


def _split_row(lines: DataFrame, keys: list[str], found: Column, names: Column) -> DataFrame:
    """The first line of each key with three values after its label (``found``), one row a source and value."""
    first = lines.where(found.isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(found.alias("rest"), names.alias("names")), "position").alias("x"))
    parts = F.split(F.col("x.rest"), r"\s{2,}")
    return first.select(*keys, F.posexplode(F.coalesce("x.names", F.array().cast("array<string>"))).alias("_k", "source"), parts.alias("parts")).select(*keys, "source", F.get("parts", F.col("_k")).alias("value"))


def _last_of(row: DataFrame, own: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Values of the row that names no source, unless a source's own lines tell another: the last of those counts."""
    last = own.where("value is not null").groupBy(*keys, "source").agg(F.max_by("value", "position").alias("own"))
    row = row.where("value is not null")
    if tasks:
        row, last = (df.repartition(tasks, *keys, "source") for df in (row, last))
    return row.join(last, [*keys, "source"], "full").select(*keys, "source", F.coalesce("own", "value").alias("value"))


def account_numbers(lines: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """``keys, source, value``: the account number of each source of a block of lines.

    From a row of three values apart by wide gaps (in the order TransUnion, Experian, Equifax), and from the lines that a source's name begins or that follow it.
    ``tasks``: into how many both kinds meet (else as the session says).
    """
    keys = list(keys)
    told = with_source(lines, keys)
    rest = F.nullif(F.regexp_extract(F.regexp_replace(F.coalesce("text", F.lit("")), "[Â®™]", ""), NUMBER, 1), F.lit(""))
    three = F.when(F.size(F.split(F.trim(rest), r"\s{2,}")) >= 3, F.trim(rest))
    row = _split_row(told, keys, three, F.array(*[F.lit(n) for n in BUREAU_NAMES]))
    at = F.when(F.col("named").isNotNull(), F.regexp_extract("clean", NUMBER, 1)).otherwise(F.regexp_extract("clean", "(?i)^" + NUMBER[4:], 1))
    own = told.where("source is not null").select(*keys, "position", "source", account_number(F.nullif(at, F.lit(""))).alias("value"))
    return _last_of(row.withColumn("value", account_number(F.col("value"))), own, keys, tasks)


def payment_statuses(lines: DataFrame, keys: Sequence[str], order: DataFrame) -> DataFrame:
    """``keys, source, value``: the payment status of each source, in lower case.

    From the first line that tells statuses, cut at wide gaps in the block's ``order(keys, names)``, and from the lines of single sources.
    """
    keys = list(keys)
    told = with_source(lines, keys)
    rest = F.when(F.col("clean").rlike(r"(?i)payment\s*status"), F.trim(F.regexp_extract(F.regexp_replace("text", "[Â®]", ""), r"(?i)Payment\s*Status\s*:?(.*)", 1)))
    row = _split_row(told.join(order, keys, "left"), keys, rest, F.col("names"))
    plain = lambda c: F.nullif(F.lower(clean(c)), F.lit(""))
    at = F.when(F.col("named").isNotNull(), F.regexp_extract("clean", STATUS, 1))  # a source's further lines never begin with the label alone
    own = told.where("source is not null").select(*keys, "position", "source", plain(at).alias("value"))
    return _last_of(row.withColumn("value", plain(F.col("value"))), own, keys)


def two_year_texts(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, source, history``: what stands after each source's name between the headings of two and of seven years; the last mention of a source counts."""
    keys = list(keys)
    every = Window.partitionBy(*keys)
    low = F.lower(F.coalesce("text", F.lit("")))
    begun = lines.withColumn("_from", F.min(F.when(F.contains(low, F.lit(TWO_YEARS)), F.col("position"))).over(every)).where(F.col("position") > F.col("_from"))
    begun = begun.withColumn("_to", F.min(F.when(F.contains(low, F.lit(SEVEN_YEARS)), F.col("position"))).over(every)).where(F.col("position") < F.col("_to"))
    line = clean(F.col("text"))
    loose = F.nullif(F.regexp_replace(F.lower(F.regexp_extract(line, r"(?i)^(Trans\s*Union|Experian|Equifax)", 1)), r"\s", ""), F.lit(""))
    w = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    placed = begun.select(*keys, "position", line.alias("line"), loose.alias("named"))
    placed = placed.withColumn("start", F.last(F.when(F.col("named").isNotNull(), F.struct(F.col("position").alias("at"), F.col("named").alias("source"))), ignorenulls=True).over(w)).where("start is not null")
    text = F.when(F.col("named").isNotNull(), F.trim(F.regexp_replace("line", r"(?i)^(Trans\s*Union|Experian|Equifax)\s*", ""))).otherwise(F.col("line"))
    listed = F.array_sort(F.collect_list(F.struct("position", text.alias("text"))))
    pieces = placed.groupBy(*keys, "start").agg(F.trim(F.regexp_replace(F.array_join(F.transform(listed, lambda x: x["text"]), " "), r"\s+", " ")).alias("history"))
    return pieces.groupBy(*keys, F.col("start.source").alias("source")).agg(F.max_by("history", "start.at").alias("history"))


def seven_year_totals(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, source, days_late``: the counts of 30, 60 and 90 days summed, of the first line below the heading that has the source's name and then its counts."""
    keys = list(keys)
    below = lines.withColumn("_from", F.min(F.when(F.contains(F.lower("text"), F.lit(SEVEN_YEARS)), F.col("position"))).over(Window.partitionBy(*keys))).where(F.col("position") > F.col("_from"))
    each = below.select(*keys, "position", "text", F.explode(F.array(*[F.lit(n) for n in BUREAU_NAMES])).alias("source"))
    part = F.regexp_substr(F.regexp_substr(F.lower("text"), F.concat(F.col("source"), F.lit(".*"))), F.lit(r"30:\d+\s+60:\d+\s+90:\d+"))
    numbers = F.transform(F.regexp_extract_all(part, F.lit(r":(\d+)"), F.lit(1)), lambda t: t.cast("int"))
    found = each.select(*keys, "position", "source", F.aggregate(numbers, F.lit(0), lambda a, b: a + b).alias("days")).where("days is not null")
    return found.groupBy(*keys, "source").agg(F.min_by("days", "position").alias("days_late"))


def first_known(values: dict[str, Column], preferred: Sequence[str] = ()) -> Column:
    """The first value of the sources, ``preferred`` ones first, that isn't missing (null, empty or two dashes), and where it comes from."""
    order = [*[s for s in preferred if s in values], *values]
    missing = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("source"))
    return F.coalesce(*[F.when(values[s].isNotNull() & ~values[s].isin("", "--"), F.struct(values[s].alias("value"), F.lit(s).alias("source"))) for s in order], missing)


def source_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, field, by_source, majority, disagrees`` of ``rows(keys, source, field, value)``: what each source says of a field (a map in order of its names).

    Majority is the value of most sources, on ties that of the first source by name; missing values don't count, a field without any isn't listed.
    """
    keys = list(keys)
    known = rows.where(F.col("value").isNotNull() & (F.trim("value") != "")).groupBy(*keys, "field", "source").agg(F.min(F.trim("value")).alias("value"))
    votes = known.groupBy(*keys, "field", "value").agg(F.count(F.lit(1)).alias("votes"), F.min("source").alias("first"), F.collect_list(F.struct("source", "value")).alias("own"))
    best = F.min_by("value", F.struct((-F.col("votes")).alias("v"), "first"))
    out = votes.groupBy(*keys, "field").agg(F.map_from_entries(F.array_sort(F.flatten(F.collect_list("own")))).alias("by_source"), best.alias("majority"), (F.count(F.lit(1)) > 1).alias("disagrees"))
    return out.select(*keys, "field", "by_source", "majority", "disagrees")
