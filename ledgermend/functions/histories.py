"""Payment histories: arrays of tokens, late counts and similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How tokens of a two-year history count.
BUCKETS = {"CO": ("CO",), "late30": ("30", "LATE30"), "late60": ("60", "LATE60"), "late90": ("90", "120", "150", "180", "LATE90")}
MONTH_BUCKET = {"30": 1, "60": 2, "90": 3, "120": 3, "150": 3, "180": 3, "co": 3, "chargeoff": 3}
BUCKET_NAMES = ("late30", "late60", "late90")


def tokens(text: Column) -> Column:
    """Upper-case tokens between commas and spaces."""
    return F.filter(F.transform(F.split(text, r"[\s,]+"), lambda t: F.upper(F.trim(t))), lambda t: t != "")


def two_year(history: Column) -> Column:
    """Tokens and counts of an array of statuses; null if there is none."""
    kept = F.filter(F.transform(history, lambda t: F.upper(F.trim(t))), lambda t: t.isNotNull() & (t != ""))
    one_of = lambda words: lambda t: t.isin(*words)
    counts = F.struct(*[F.size(F.filter(kept, one_of(words))).alias(name) for name, words in BUCKETS.items()])
    return F.when(F.size(kept) > 0, F.struct(kept.alias("tokens"), counts.alias("counts")))


def seven_year(counters: Column, aliases: dict[str, str]) -> Column:
    """Late counts of a map of counters, alias keys summed; null if all are zero."""
    key = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for p in aliases.items() for x in p]), F.regexp_replace(F.lower(F.trim(k)), r"[\s_-]+", " "))
    total = lambda name: F.aggregate(F.map_entries(counters), F.lit(0).cast("long"), lambda acc, e: acc + F.when(key(e["key"]) == name, F.coalesce(e["value"].try_cast("long"), F.lit(0))).otherwise(0))
    found = F.struct(*[total(b).alias(b) for b in BUCKET_NAMES])
    return F.when(total("late30") + total("late60") + total("late90") > 0, found)


def aligned_similarity(a: Column, b: Column) -> Column:
    """Share of equal tokens of two histories aligned at their newest end; null if either is empty."""
    n = F.least(F.size(a), F.size(b))
    same = F.size(F.filter(F.zip_with(F.slice(F.reverse(a), F.lit(1), n), F.slice(F.reverse(b), F.lit(1), n), lambda x, y: x.eqNullSafe(y)), lambda t: t))
    return F.when(n > 0, same / n)


def counter_similarity(a: list[Column], b: list[Column]) -> Column:
    """1 less the summed differences by the sum of both, at least 0; two empty histories are alike."""
    zero = F.lit(0)
    a, b = [F.coalesce(x, zero) for x in a], [F.coalesce(x, zero) for x in b]
    gap = sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), zero)
    total = sum(a, zero) + sum(b, zero)
    return F.when(total == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - gap / total))


def month_status(history: Column) -> Column:
    """One status a month of ``array<struct<month_year_key, status>>``: ok if any is, else the first that isn't ``--``."""
    usable = F.filter(history, lambda e: (F.coalesce(e["month_year_key"], F.lit("")) != "") & (F.coalesce(e["status"], F.lit("")) != ""))
    months = F.array_distinct(F.transform(usable, lambda e: e["month_year_key"]))

    def pick(month: Column) -> Column:
        own = F.transform(F.filter(usable, lambda e: e["month_year_key"] == month), lambda e: e["status"])
        real = F.filter(own, lambda s: s != "--")
        status = F.when(F.array_contains(own, "ok"), "ok").otherwise(F.coalesce(F.get(real, F.lit(0)), F.get(own, F.lit(0))))
        return F.struct(month.alias("month_year_key"), status.alias("status"))

    return F.transform(months, pick)


def worst_months(history: Column) -> Column:
    """``array<struct<month_year_key, bucket>>``: the worst late bucket (1 to 3) of each month that has one, in order of appearance."""
    bucket = lambda s: F.try_element_at(F.create_map(*[F.lit(x) for p in MONTH_BUCKET.items() for x in p]), F.lower(F.trim(s)))
    late = F.filter(F.transform(history, lambda e: F.struct(e["month_year_key"].alias("month_year_key"), bucket(e["status"]).alias("bucket"))), lambda e: e["bucket"].isNotNull() & e["month_year_key"].isNotNull())
    months = F.array_distinct(F.transform(late, lambda e: e["month_year_key"]))
    return F.transform(months, lambda m: F.struct(m.alias("month_year_key"), F.array_max(F.transform(F.filter(late, lambda e: e["month_year_key"] == m), lambda e: e["bucket"])).alias("bucket")))


def max_month(history: Column) -> Column:
    from ledgermend.functions.dates import valid_month

    return F.array_max(F.filter(F.transform(history, lambda e: valid_month(e["month_year_key"])), lambda m: m.isNotNull()))


def late_counts(text: Column) -> Column:
    """Counts of 30, 60, 90 and 120 in a history text, trailing D or plus signs ignored."""
    found = F.transform(tokens(text), lambda t: F.regexp_replace(t, r"[D+]+$", ""))
    equal = lambda code: lambda t: t == code
    return F.struct(*[F.size(F.filter(found, equal(code))).alias(f"late{code}") for code in ("30", "60", "90", "120")])
