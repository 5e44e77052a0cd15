"""Small selections: top parts and reasons, primary issues, resolution rates, eligibility flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_parts(parts: Column, limit: int = 5) -> Column:
    """``field=points`` of the best parts of a map, most points first, then by field; zeros are left out."""
    kept = F.filter(F.map_entries(parts), lambda e: e["value"] != 0)
    ranked = F.array_sort(F.transform(kept, lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("f"))))
    return F.transform(F.slice(ranked, F.lit(1), F.lit(limit)), lambda e: F.concat(e["f"], F.lit("="), (-e["p"]).cast("string")))


def top_reason(df: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """The most frequent reason of each key, the first by name on ties."""
    counted = df.groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(reason).alias("r"))).alias("x")).select(*keys, F.col("x.r").alias(reason), (-F.col("x.n")).alias("n"))


def deduped(reasons: Column, width: int = 200, limit: int = 10) -> Column:
    """Distinct non-empty reasons in the order of appearance, cut in length and number."""
    cut = F.transform(F.filter(F.transform(reasons, lambda r: F.trim(r)), lambda r: r.isNotNull() & (r != "")), lambda r: F.left(r, F.lit(width)))
    return F.slice(F.array_distinct(cut), F.lit(1), F.lit(limit))


def primary_issue(issues: Column, order: Sequence[str]) -> Column:
    """The first of an order of severity that an array holds, else ``unknown``."""
    return F.coalesce(*[F.when(F.array_contains(issues, name), F.lit(name)) for name in order], F.lit("unknown"))


def resolution(states: DataFrame) -> DataFrame:
    """Share of completed accounts, and the mean of their cycles."""
    done = F.col("status") == "COMPLETED"
    return states.agg(F.avg(done.cast("double")).alias("resolution_rate"), F.avg(F.when(done, F.col("cycle"))).alias("avg_cycles"))


def calendar_span(days: Column, start_weekday: int, weekend: Sequence[int] = (5, 6)) -> Column:
    """Days until the last of consecutive waits is over, each next one starting on a working day."""

    def step(total: Column, wait: Column) -> Column:
        weekday = F.pmod(F.lit(start_weekday) + total, F.lit(7))
        roll = F.lit(0)
        for day in range(7):
            shift, at = 0, day
            while at % 7 in weekend and shift < 7:
                shift, at = shift + 1, at + 1
            roll = F.when(weekday == day, shift).otherwise(roll)
        return (total + roll + wait).cast("int")

    return F.aggregate(days, F.lit(0), step)
