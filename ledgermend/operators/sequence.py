"""Ordered analytics: islands, monotone severities, carried years, tops and look-backs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers each run of rows: a run begins where ``starts`` holds, the first row begins run 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    begin = F.when(F.coalesce(starts, F.lit(False)) | (F.row_number().over(w) == 1), 1).otherwise(0)
    return df.withColumn("_begin", begin).withColumn(name, F.sum("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begin")


def gap_islands(df: DataFrame, keys: Sequence[str], position: str, gap: float, name: str = "island") -> DataFrame:
    """A run ends where the distance to the row before exceeds the gap."""
    w = Window.partitionBy(*keys).orderBy(position)
    return islands(df, keys, [position], (F.col(position) - F.lag(position).over(w)) > gap, name)


def severity_drops(df: DataFrame, keys: Sequence[str], order: Sequence[str], severity: str) -> DataFrame:
    """The first drop of each key: severities in order, unknown ones skipped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    known = df.where(F.col(severity).isNotNull()).withColumn("previous", F.lag(severity).over(w))
    drops = known.where(F.col(severity) < F.col("previous"))
    first = F.min(F.struct(*order, "previous", severity)).alias("x")
    return drops.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("drops")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in order], F.col("x.previous").alias("previous"), F.col(f"x.{severity}").alias(severity), "drops")


def month_direction(months: Column) -> Column:
    """``forward`` unless more steps of an array of month numbers go back in time; December to January goes forward."""
    known = F.filter(months, lambda m: m.isNotNull())
    steps = F.zip_with(F.slice(known, F.lit(1), F.greatest(F.size(known) - 1, F.lit(0))), F.slice(known, F.lit(2), F.greatest(F.size(known) - 1, F.lit(0))), lambda a, b: F.when((a == 12) & (b == 1), 1).when((a == 1) & (b == 12), -1).otherwise(F.signum(b - a).cast("int")))
    return F.when(F.aggregate(steps, F.lit(0), lambda s, x: s + x) >= 0, "forward").otherwise("backward")


def carry_years(df: DataFrame, keys: Sequence[str], position: str, month: str, anchor: str) -> DataFrame:
    """Years for a list of months of which some carry a year, as ``derived_year`` and ``month_year_key``.

    Each month takes the last anchor before it, or failing that the first one after it, moved by
    the turns of the year in between (December to January going forward in time,
    January to December going backward, by the direction that most steps have).
    """
    parts = Window.partitionBy(*keys)
    w = parts.orderBy(position)
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    from_here = w.rowsBetween(0, Window.unboundedFollowing)
    # The month before, rows without one skipped.
    seen = F.last(month, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_before", seen)
    step = F.when((F.col("_before") == 12) & (F.col(month) == 1), 1).when((F.col("_before") == 1) & (F.col(month) == 12), -1).otherwise(F.signum(F.col(month) - F.col("_before")).cast("int"))
    df = df.withColumn("_step", F.coalesce(step, F.lit(0)))
    df = df.withColumn("_forward", F.sum("_step").over(parts) >= 0)
    turn = F.when(F.col("_forward") & (F.col("_before") == 12) & (F.col(month) == 1), 1).when(~F.col("_forward") & (F.col("_before") == 1) & (F.col(month) == 12), -1).otherwise(0)
    df = df.withColumn("_turns", F.sum(F.coalesce(turn, F.lit(0))).over(to_here))
    base = F.when(F.col(anchor).isNotNull(), F.col(anchor) - F.col("_turns"))
    # What follows is read from the end: a frame that ends at the list's end would be read anew for every row.
    from_end = parts.orderBy(F.col(position).desc()).rowsBetween(Window.unboundedPreceding, 0)
    before, after = F.last(base, ignorenulls=True).over(to_here), F.last(base, ignorenulls=True).over(from_end)
    year = F.when(F.col(month).isNotNull(), F.coalesce(before, after) + F.col("_turns"))
    df = df.withColumn("derived_year", F.coalesce(F.col(anchor), year).cast("int")).drop("_before", "_step", "_forward", "_turns")
    key = F.when(F.col("derived_year").isNotNull() & F.col(month).isNotNull(), F.format_string("%04d-%02d", "derived_year", F.col(month).cast("int")))
    return df.withColumn("month_year_key", key)


def head_and_tail(items: Column, n: int = 6) -> Column:
    """The first and the last ``n`` of an array, all of it if it is shorter."""
    size = F.size(items)
    return F.struct(F.slice(items, F.lit(1), F.lit(n)).alias("first"), F.slice(items, F.greatest(size - n + 1, F.lit(1)), F.lit(n)).alias("last"))


def ends(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = 6) -> DataFrame:
    """Per key the first and the last ``n`` values, as arrays in order: two bounded windows, so no group meets in one row."""
    w = Window.partitionBy(*keys)
    head = df.withColumn("_n", F.row_number().over(w.orderBy(*order))).where(F.col("_n") <= n)
    tail = df.withColumn("_n", -F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order]))).where(F.col("_n") >= -n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value])
    return head.groupBy(*keys).agg(listed.alias("first")).join(tail.groupBy(*keys).agg(listed.alias("last")), list(keys))


def look_back(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, lines: int, name: str) -> DataFrame:
    """The nearest non-null value within so many rows above."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-lines, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def floor_percentile(values: Column, percent: float) -> Column:
    """Of an array: the value at rank ``floor(n p / 100)``, at least the first; 0 if empty."""
    ranked = F.array_sort(values)
    place = F.greatest(F.lit(1), F.floor(F.size(ranked) * percent / 100).cast("int"))
    return F.coalesce(F.try_element_at(ranked, place), F.lit(0.0))


def floor_rank(df: DataFrame, keys: Sequence[str], value: str, percent: float, name: str) -> DataFrame:
    """The same for each key by sorting instead of collecting, so that a group may be of any size.

    Equal values are counted first and ranks run over distinct values.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = counted.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    wanted = F.greatest(F.lit(1), F.floor(F.col("all") * percent / 100))
    return ranked.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)).select(*keys, F.col(value).alias(name))


def clusters_from_anchor(positions: Column, tolerance: float) -> Column:
    """Cluster numbers of an ordered array: a value further than the tolerance from its cluster's first opens the next."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["anchor"].isNull() | (F.abs(x - acc["anchor"]) > tolerance)
        n = acc["n"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, x.cast("double")).otherwise(acc["anchor"]).alias("anchor"), n.alias("n"), F.concat(acc["out"], F.array(n)).alias("out"))

    return F.aggregate(positions, start, step, lambda acc: acc["out"])


def clusters_from_mean(positions: Column, tolerance: float) -> Column:
    """The same against the running mean of the cluster."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("size"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["size"] == 0) | (F.abs(x - acc["sum"] / F.greatest(acc["size"], F.lit(1))) > tolerance)
        n = acc["n"] + F.when(new, 1).otherwise(0)
        total = F.when(new, x.cast("double")).otherwise(acc["sum"] + x)
        return F.struct(total.alias("sum"), F.when(new, 1).otherwise(acc["size"] + 1).alias("size"), n.alias("n"), F.concat(acc["out"], F.array(n)).alias("out"))

    return F.aggregate(positions, start, step, lambda acc: acc["out"])


def clusters_from_median(positions: Column, tolerance: float) -> Column:
    """The same against the upper median of the cluster."""
    start = F.struct(F.array().cast("array<double>").alias("own"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        own = acc["own"]
        middle = F.get(F.array_sort(own), F.floor(F.size(own) / 2).cast("int"))
        new = F.coalesce(F.abs(x - middle) > tolerance, F.lit(True))
        n = acc["n"] + F.when(new, 1).otherwise(0)
        held = F.when(new, F.array(x.cast("double"))).otherwise(F.concat(own, F.array(x.cast("double"))))
        return F.struct(held.alias("own"), n.alias("n"), F.concat(acc["out"], F.array(n)).alias("out"))

    return F.aggregate(positions, start, step, lambda acc: acc["out"])
