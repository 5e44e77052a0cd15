"""Agreement between up to three sources, field by field.

Groups are greedy and ordered: a value joins the first earlier group whose first
value it matches, which isn't a transitive closure.  Missing values are a group of
their own.  Everything is a column over the three values, so no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermend.functions.lets import bound
from ledgermend.functions.text import strict_level, visible_match

SOURCES = ("transunion", "experian", "equifax")


def exactly(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def days_apart(days: int = 5) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.abs(F.datediff(a, b)) <= days


def equals(value: Column) -> Callable[[Column], Column]:
    return lambda x: x == value


def group_labels(values: Sequence[Column], missing: Sequence[Column], match: Callable[[Column, Column], Column]) -> Column:
    """A group number for each of three sources, as an array; 0 is missing."""
    (a, b, c), (ma, mb, mc) = values, missing
    first = F.when(ma, 0).otherwise(1)
    second = F.when(mb, 0).when(~ma & match(b, a), 1).otherwise(2)
    third = lambda two: F.when(mc, 0).when(~ma & match(c, a), 1).when(~mb & (two == 2) & match(c, b), 2).otherwise(3)
    return bound(second, lambda two: F.array(first, two, third(two)))


def consensus(values: Sequence[Column], missing: Sequence[Column], match: Callable[[Column, Column], Column] = exactly, names: Sequence[str] = SOURCES) -> Column:
    """Struct of consensus (unanimous, majority, split), disagreeing and missing sources; null if no source has a value."""

    def result(labels: Column) -> Column:
        one, two, three = (F.get(labels, F.lit(k)) for k in range(3))
        alone = [(one != two) & (one != three), (two != one) & (two != three), (three != one) & (three != two)]
        split = alone[0] & alone[1] & alone[2]
        state = F.when((one == two) & (two == three), "unanimous").when(split, "split").otherwise("majority")
        odd = F.array_sort(F.array_compact(F.array(*[F.when(x, F.lit(n)) for x, n in zip(alone, names, strict=True)])))
        gone = F.array_sort(F.array_compact(F.array(*[F.when(m, F.lit(n)) for m, n in zip(missing, names, strict=True)])))
        return F.struct(state.alias("consensus"), odd.alias("disagreeing"), gone.alias("missing"))

    some = ~(missing[0] & missing[1] & missing[2])
    return F.when(some, bound(group_labels(values, missing, match), result))


def _shown(values: Sequence[Column], missing: Sequence[Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~m, v) for v, m in zip(values, missing, strict=True)]))


def reason(values: Sequence[Column], missing: Sequence[Column]) -> Column:
    """The pattern of disagreement, C1 to C6, with its counts."""

    def result(n: Column) -> Column:
        present, distinct = n["present"], n["distinct"]
        gone = F.lit(len(values)) - present
        code = F.when(present == 0, "C6_ALL_MISSING").when(present == 1, "C2_ONE_MISSING")
        code = code.when((gone > 0) & (distinct <= 1), "C1_TWO_PRESENT_ONE_MISSING").when(gone > 0, "C3_TWO_PRESENT_CONFLICT")
        code = code.when(distinct <= 2, "C4_TWO_MATCH_ONE_DIFF").otherwise("C5_ALL_DIFF")
        return F.struct(code.alias("reason_code"), (gone > 0).alias("is_missing"), (distinct > 1).alias("is_mismatch"), gone.alias("missing_count"), present.alias("present_count"), distinct.alias("distinct_values"))

    counts = lambda shown: F.struct(F.size(shown).alias("present"), F.size(F.array_distinct(shown)).alias("distinct"))
    return bound(bound(_shown(values, missing), counts), result)


def reporting_pattern(values: Sequence[Column], missing: Sequence[Column]) -> Column:
    """The same as case_1 (one present) to case_6 (none), in the numbering of the eligibility rules."""
    ladder = lambda r: (
        F.when(r["present_count"] == 0, "case_6").when(r["present_count"] == 1, "case_1")
        .when(r["present_count"] == 2, F.when(r["distinct_values"] <= 1, "case_2").otherwise("case_3"))
        .when(r["distinct_values"] >= 3, "case_5").otherwise("case_4")
    )
    return bound(reason(values, missing), ladder)


def send_to_ai(field: Column, code: Column) -> Column:
    """Free-text fields whose values conflict (C3, C4, C5)."""
    named = F.lower(F.trim(field)).isin("account_type", "creditor_type", "account_rating")
    return F.coalesce(named & F.split_part(F.upper(F.trim(code)), F.lit("_"), F.lit(1)).isin("C3", "C4", "C5"), F.lit(False))


def source_states(values: Sequence[Column], missing: Sequence[Column], names: Sequence[str] = SOURCES) -> Column:
    """aligned, conflict, solo or missing per source, by the most frequent value (which needs two)."""

    def result(shown: Column) -> Column:
        out = []
        for v, m, n in zip(values, missing, names, strict=True):
            own = F.size(F.filter(shown, equals(v)))
            out.append(F.when(m, "missing").when(F.size(shown) == 1, "solo").when(own > 1, "aligned").otherwise("conflict").alias(n))
        return F.struct(*out)

    return bound(_shown(values, missing), result)


def majority_value(df: DataFrame, keys: list[str], value: str, priority: str) -> DataFrame:
    """The most frequent value of each key; ties by the least priority of a row that holds it, then by value."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(priority).alias("first_priority"))
    best = Window.partitionBy(*keys).orderBy(F.col("votes").desc(), "first_priority", value)
    return counted.withColumn("n", F.row_number().over(best)).where("n = 1").select(*keys, value, "votes")


def amounts_agree(values: Sequence[Column], tol_abs: float, tol_ratio: float) -> Column:
    """Whether all given amounts span at most the tolerance; fewer than two always do."""

    def result(shown: Column) -> Column:
        high, low = F.array_max(shown), F.array_min(shown)
        return F.when(F.size(shown) < 2, True).otherwise(high - low <= F.greatest(F.lit(tol_abs), F.greatest(F.abs(high), F.abs(low)) * tol_ratio))

    return bound(F.array_compact(F.array(*values)), result)


def dates_agree(values: Sequence[Column], tol_days: int = 5) -> Column:
    shown = F.array_compact(F.array(*values))
    return F.when(F.size(shown) < 2, True).otherwise(F.datediff(F.array_max(shown), F.array_min(shown)) <= tol_days)


def number_relation(a: Column, b: Column) -> Column:
    """match, conflict or insufficient: by visible digits, else by letters and digits, else by letters alone."""
    bare = lambda c, p: F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), p, ""))
    level = strict_level(a, b)
    digits = (bare(a, r"\D") != "") & (bare(b, r"\D") != "")
    x, y = bare(a, "[^A-Za-z]"), bare(b, "[^A-Za-z]")
    words = (level == "empty") & (x != "") & (y != "") & (x != y)
    return F.when(visible_match(a, b), "match").when(digits, "conflict").when(level == "match", "match").when(level.isin("digit_conflict", "alnum_conflict") | words, "conflict").otherwise("insufficient")


def number_groups(values: Sequence[Column]) -> Column:
    """A group number for each of three sources' account numbers, as an array.

    A number joins the first group that it conflicts with in no member and matches in one, else the
    first without a conflict.
    """
    a, b, c = values
    clash = lambda r: r == "conflict"
    relations = F.struct(number_relation(b, a).alias("ab"), number_relation(c, a).alias("ac"), number_relation(c, b).alias("bc"))

    def labels(r: Column) -> Column:
        apart = clash(r["ab"])
        alone = F.when(clash(r["ac"]) | clash(r["bc"]), 2).otherwise(1)
        first, second = ~clash(r["ac"]), ~clash(r["bc"])
        split = F.when(first & ((r["ac"] == "match") | ~(second & (r["bc"] == "match"))), 1).when(second, 2).otherwise(3)
        return F.array(F.lit(1), F.when(apart, 2).otherwise(1), F.when(apart, split).otherwise(alone))

    return bound(relations, labels)


def tolerated(kind: Column, amounts: Sequence[Column], days: Sequence[Column], tol_abs: float = 50.0, tol_ratio: float = 0.01, tol_days: int = 5) -> Column:
    """Whether a field still differs once its tolerance is applied: struct of is_mismatch, metric (the span) and ceiling.

    ``kind`` is ``date``, ``amount`` or anything else, which has no tolerance.
    """
    money, dates_ = F.array_compact(F.array(*amounts)), F.array_compact(F.array(*days))

    def result(x: Column) -> Column:
        span = F.when(F.size(x["m"]) >= 2, F.array_max(x["m"]) - F.array_min(x["m"]))
        ceiling = F.greatest(F.lit(tol_abs), F.coalesce(F.greatest(F.abs(F.array_max(x["m"])), F.abs(F.array_min(x["m"]))), F.lit(0.0)) * tol_ratio)
        apart = F.when(F.size(x["d"]) >= 2, F.datediff(F.array_max(x["d"]), F.array_min(x["d"])).cast("double"))
        metric = F.when(kind == "amount", span).when(kind == "date", apart)
        limit = F.when(kind == "amount", ceiling).when(kind == "date", F.lit(float(tol_days)))
        within = limit.isNotNull() & F.coalesce(metric <= limit, F.lit(True))
        return F.struct((~within).alias("is_mismatch"), F.when(within, metric).alias("metric"), F.when(within, limit).alias("ceiling"))

    return bound(F.struct(money.alias("m"), dates_.alias("d")), result)


def tolerance_hits(df: DataFrame, keys: list[str], field: str, value: str, tol_abs: float, tol_ratio: float) -> DataFrame:
    """Per key how many fields have different amounts that a tolerance lets pass."""
    each = df.groupBy(*keys, field).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    allowed = F.greatest(F.lit(tol_abs), F.greatest(F.abs("hi"), F.abs("lo")) * tol_ratio)
    hit = (F.col("hi") != F.col("lo")) & (F.col("hi") - F.col("lo") <= allowed)
    return each.groupBy(*keys).agg(F.sum(F.when(hit, 1).otherwise(0)).alias("hits"))


def mapping_coverage(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """The share of a table's (bureau, label) rows that a registry maps, in per cent, per bureau: mapped, total, percent."""
    known = mapping.select("bureau", "label").distinct().withColumn("_known", F.lit(1))
    joined = labels.join(known, ["bureau", "label"], "left")
    return joined.groupBy("bureau").agg(F.count("_known").alias("mapped"), F.count(F.lit(1)).alias("total")).withColumn("percent", F.round(100.0 * F.col("mapped") / F.col("total"), 2))


def month_language(lines: DataFrame, keys: list[str], order: str, text: str, marker: str, foreign: Sequence[str], english: Sequence[str]) -> DataFrame:
    """Which language the months below the first line with ``marker`` are in, and the date order that follows: he and DMY, en and MDY, or unknown."""
    first = lines.where(F.col(text).contains(marker)).groupBy(*keys).agg(F.min(order).alias("_from"))
    below = lines.join(first, keys).where(F.col(order) >= F.col("_from"))
    words = F.split(F.lower(F.col(text)), r"(?U)[^\p{L}]+")
    en = F.size(F.filter(words, lambda w: w.isin(*english)))
    he = sum((F.size(F.split(F.col(text), F.lit(m))) - 1 for m in foreign), F.lit(0))
    votes = below.agg(F.coalesce(F.sum(he), F.lit(0)).alias("he_hits"), F.coalesce(F.sum(en), F.lit(0)).alias("en_hits"))
    pick = lambda a, b: F.when(F.col("he_hits") > F.col("en_hits"), a).when(F.col("en_hits") > F.col("he_hits"), b)
    return votes.select("he_hits", "en_hits", F.coalesce(pick("he", "en"), F.lit("unknown")).alias("language"), pick("DMY", "MDY").alias("convention"))


def coverage(fields: Sequence[Column]) -> Column:
    """Per cent of expected fields that are filled, half to even."""
    filled = sum((F.when(c.isNotNull() & (c.cast("string") != ""), 1).otherwise(0) for c in fields), F.lit(0))
    return F.bround(filled * 100.0 / len(fields), 0).cast("long")


def missing_counts(df: DataFrame, fields: Sequence[str], top: int = 10) -> DataFrame:
    """How often each field is missing, the most frequent first."""
    sums = df.agg(*[F.sum(F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), 1).otherwise(0)).alias(f) for f in fields])
    long = sums.unpivot([], list(fields), "field", "missing")
    return long.orderBy(F.col("missing").desc(), "field").limit(top)


def overlay(values: Sequence[Column], missing: Sequence[Column], derived: Column, order: Sequence[int] = (2, 0, 1)) -> Column:
    """One value for all sources and how it came about: the most frequent one, ties in the given order of sources."""

    def result(shown: Column) -> Column:
        votes = lambda v: F.size(F.filter(shown, lambda x: x == v))
        status = F.when(F.size(shown) == 0, "missing").when(F.size(F.array_distinct(shown)) > 1, "conflict").when(derived, "derived").otherwise("agreed")
        pick = lambda most: F.coalesce(*[F.when(~missing[k] & (votes(values[k]) == most), values[k]) for k in order])
        return F.struct(bound(F.array_max(F.transform(shown, votes)), pick).alias("value"), status.alias("status"))

    return bound(_shown(values, missing), result)


#: Tiers of issues, the strongest first.
TIERS = ("Tier1", "Tier2", "Tier3", "Tier4", "none")


def strongest_decision(df: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the decision of the strongest tier, then of the highest confidence, then the first; reasons of all in order."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier")), F.lit(0)), F.lit(len(TIERS) + 1))
    best = F.struct(rank.alias("r"), (-F.col("confidence")).alias("c"), F.col(order).alias("o"), "primary_issue", "tier", "confidence")
    return df.groupBy(key).agg(F.min(best).alias("b"), F.array_sort(F.collect_list(F.struct(order, "reason"))).alias("all")).select(
        key, F.col("b.primary_issue").alias("primary_issue"), F.col("b.tier").alias("tier"), F.col("b.confidence").alias("confidence"), F.array_distinct(F.col("all.reason")).alias("reasons")
    )
