"""Pairs of accounts that may be one: pairing, best matches, scores and families."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermend.functions.lets import bound
from ledgermend.functions.money import close_for_matching, pack_amount
from ledgermend.functions.text import strict_level, visible_match
from ledgermend.workspace import partitions

#: Points of a matched field.
WEIGHTS = {"account_number": 1.0, "date_opened": 1.0, "balance_owed": 3.0, "account_type": 0.5, "account_status": 0.5, "history_2y": 1.0, "history_7y": 1.0, "account_label": 1.0}
DIRECT_POINTS, AI_POINTS = 5.0, 3.0


def pairs(df: DataFrame, session: str, index: str) -> DataFrame:
    """All unordered pairs of a session's accounts, columns suffixed _a and _b.

    An equi-join on the session: accounts of one session are few by nature (one
    person's report), so a session's pairs are bounded.
    """
    left = df.select(session, *[F.col(c).alias(f"{c}_a") for c in df.columns if c != session])
    right = df.select(session, *[F.col(c).alias(f"{c}_b") for c in df.columns if c != session])
    return left.join(right, session).where(F.col(f"{index}_a") < F.col(f"{index}_b"))


def best_of_nine(left: Sequence[Column], right: Sequence[Column], match) -> Column:
    """The first matching pair of sources in order, else the first pair with both values: struct of matched, left, right."""
    hits, both = [], []
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            there = a.isNotNull() & b.isNotNull()
            hits.append(F.when(there & match(a, b), F.struct(F.lit(True).alias("matched"), F.lit(i).alias("left"), F.lit(j).alias("right"))))
            both.append(F.when(there, F.struct(F.lit(False).alias("matched"), F.lit(i).alias("left"), F.lit(j).alias("right"))))
    return F.coalesce(*hits, *both)


def any_source_match(left: Sequence[Column], right: Sequence[Column], match) -> Column:
    """The first matching pair of sources in order, else the first with both values (null if there is none), and all that was tried.

    struct of matched, left, right (source numbers) and tried: left, right, evaluated, matched and reasons of all pairs.
    """
    def entry(i: int, j: int) -> Column:
        a, b = left[i], right[j]
        both = a.isNotNull() & b.isNotNull()
        hit = F.coalesce(both & match(a, b), F.lit(False))
        why = F.array(F.when(a.isNull(), "left_missing"), F.when(b.isNull(), "right_missing"), F.when(both & ~hit, "no_match"))
        return F.struct(F.lit(i).alias("left"), F.lit(j).alias("right"), both.alias("evaluated"), hit.alias("matched"), F.array_compact(why).alias("reasons"))

    def pick(tried: Column) -> Column:
        hits, both = F.filter(tried, lambda e: e["matched"]), F.filter(tried, lambda e: e["evaluated"])
        best = F.coalesce(F.get(hits, F.lit(0)), F.get(both, F.lit(0)))
        return F.struct((F.size(hits) > 0).alias("matched"), best["left"].alias("left"), best["right"].alias("right"), tried.alias("tried"))

    return bound(F.array(*[entry(i, j) for i in range(len(left)) for j in range(len(right))]), pick)


def strict_number_pair(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """The first pair of sources whose account numbers agree in letters and digits: level ``match`` or ``none`` (then the first pair), left, right."""
    pair = lambda level, i, j: F.struct(F.lit(level).alias("level"), F.lit(i).alias("left"), F.lit(j).alias("right"))
    hits = [F.when(strict_level(a, b) == "match", pair("match", i, j)) for i, a in enumerate(left) for j, b in enumerate(right)]
    return F.coalesce(*hits, pair("none", 0, 0))


def number_pair(left: Sequence[Column], right: Sequence[Column], min_length: int = 0, hard: bool = True) -> Column:
    """The pair of sources whose visible digits contain one another, both at least ``min_length`` long.

    struct of matched, left, right: the first match; else the first pair of best level, short ones
    included; null numbers if no pair shows digits.  Without ``hard`` nothing matches.
    """
    shown = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", ""))
    found, contained, some = [], [], []
    pair = lambda matched, i, j: F.struct(F.lit(matched).alias("matched"), F.lit(i).alias("left"), F.lit(j).alias("right"))
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            there, inside = (shown(a) > 0) & (shown(b) > 0), visible_match(a, b)
            long = (shown(a) >= min_length) & (shown(b) >= min_length)
            found.append(F.when(there & inside & long & F.lit(hard), pair(True, i, j)))
            contained.append(F.when(there & inside, pair(False, i, j)))
            some.append(F.when(there, pair(False, i, j)))
    empty = F.struct(F.lit(False).alias("matched"), F.lit(None).cast("int").alias("left"), F.lit(None).cast("int").alias("right"))
    return F.coalesce(*found, *contained, *some, empty)


def amount_conflicts(fields: dict[str, tuple[Column, Column]], tol_abs: float, tol_ratio: float, exact: Sequence[str] = ("balance_owed",)) -> Column:
    """``amount_conflict:<field>`` for each field whose arrays of amounts have no close pair.

    Fields of ``exact`` must share a value other than zero; other fields conflict only where both sides have amounts.
    """
    def near_any(mine: Column, theirs: Column) -> Column:
        return F.exists(mine, lambda a: F.exists(theirs, lambda b: close_for_matching(a, b, tol_abs, tol_ratio)))

    out = []
    for name, (left, right) in sorted(fields.items()):
        mine, theirs = (F.filter(x, lambda v: v.isNotNull()) for x in (left, right))
        if name in exact:
            bad = ~exact_balance(mine, theirs)
        else:
            bad = (F.size(mine) > 0) & (F.size(theirs) > 0) & ~near_any(mine, theirs)
        out.append(F.when(bad, F.lit(f"amount_conflict:{name}")))
    return F.array_compact(F.array(*out))


def without_zero_debt(scored: DataFrame, amounts: Sequence[str]) -> DataFrame:
    """Pairs but those whose amounts (texts, ``_a`` and ``_b`` of each) are all zero; what is no number counts as zero."""
    zero = F.lit(True)
    for name in amounts:
        for side in ("a", "b"):
            zero = zero & (pack_amount(F.col(f"{name}_{side}")) == 0)
    return scored.where(~zero)


def exact_balance(left: Column, right: Column) -> Column:
    """Whether two arrays of cents share a value other than zero."""
    real = lambda a: F.filter(a, lambda x: x.isNotNull() & (x != 0))
    return F.coalesce(F.arrays_overlap(real(left), real(right)), F.lit(False))


def score(matched: dict[str, Column], conflict: Column, balance_exact: Column, weights: dict[str, float] | None = None) -> Column:
    """Points of the matched fields and what they lead to: auto, ai or different."""
    weights = weights or WEIGHTS
    points = sum((F.when(F.coalesce(m, F.lit(False)), F.lit(weights[f])).otherwise(F.lit(0.0)) for f, m in sorted(matched.items())), F.lit(0.0))
    decision = F.when((points >= DIRECT_POINTS) & ~conflict & balance_exact, "auto").when(points >= AI_POINTS, "ai").otherwise("different")
    return F.struct(points.alias("points"), decision.alias("decision"))


def strong_priority(triggers: Column) -> Column:
    return F.when(F.array_contains(triggers, "strong:balance_owed"), 2).when(F.array_contains(triggers, "strong:account_number"), 1).otherwise(0)


def best_partner(scored: DataFrame, session: str, a: str, b: str, rank: str, points: str) -> DataFrame:
    """For every account its best partner: strongest, then most points, then the least index."""
    both = scored.select(session, F.col(a).alias("index"), F.col(b).alias("partner"), rank, points).unionByName(scored.select(session, F.col(b).alias("index"), F.col(a).alias("partner"), rank, points))
    order = F.struct((-F.col(rank)).alias("r"), (-F.col(points)).alias("p"), F.col("partner").alias("partner"))
    best = both.groupBy(session, "index").agg(F.min(order).alias("x"))
    return best.select(session, "index", F.col("x.partner").alias("partner"), (-F.col("x.r")).alias(rank), (-F.col("x.p")).alias(points))


#: Rows of a bucket that are dealt together, and how many of them are unfolded at once.
BAND_ROWS, BAND_SLICE = 4096, 64


def band_join(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str, tol_abs: float, tol_ratio: float) -> DataFrame:
    """Rows of equal key whose amounts are close: bucketed by magnitude, so the join stays an equi-join.

    Amounts match within ``tol_abs`` or a share of the smaller one.  Buckets grow
    with that width, a row joins its own and both neighbouring buckets.

    Not rows join but parts of a bucket, of ``BAND_ROWS`` rows; pairs of parts are dealt to all tasks and each is unfolded where it
    lies, slice by slice, so the pairs of a full bucket neither lie in one task nor are shuffled or held.  Infinite amounts have a bucket of their own.
    """
    wide = 1 + 1e-9  # buckets a little wider than the tolerance, for amounts that lie exactly that far apart

    def parts(df: DataFrame, amount: str, steps: Sequence[int], side: str) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(*key, "_bucket").orderBy(amount))
        bucket = F.when(F.abs(amount) == float("inf"), F.lit(1 << 40)).otherwise(_bucket(F.col(amount), tol_abs * wide, tol_ratio * wide))
        placed = df.where(F.col(amount).isNotNull()).withColumn("_bucket", F.explode(F.array(*[bucket + step for step in steps]))).withColumn(f"{side}_part", F.floor((number - 1) / BAND_ROWS))
        return placed.groupBy(*key, "_bucket", f"{side}_part").agg(F.collect_list(F.struct(*[c for c in df.columns if c not in key])).alias(f"{side}_rows"))

    met = parts(left, a, (-1, 0, 1), "_left").join(parts(right, b, (0,), "_right"), [*key, "_bucket"])
    tasks = 4 * partitions(left.sparkSession)
    met = met.repartition(tasks, *key, "_bucket", "_left_part", "_right_part")
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("_left_rows") - 1) / BAND_SLICE).cast("int")), lambda k: F.slice("_left_rows", k * BAND_SLICE + 1, BAND_SLICE))
    # Generated code holds what it unfolds from a row until all is unfolded: coalesce, which moves nothing here, parts it at the slices.
    met = met.select(*key, F.explode(slices).alias("_left_rows"), "_right_rows").coalesce(tasks)
    joined = met.select(*key, F.inline("_left_rows"), "_right_rows")
    joined = joined.select(*[c for c in joined.columns if c != "_right_rows"], F.inline("_right_rows"))
    return joined.where(close_for_matching(F.col(a), F.col(b), tol_abs, tol_ratio))


def _bucket(c: Column, tol_abs: float, tol_ratio: float) -> Column:
    """The bucket of an amount: close amounts lie in the same one or in neighbours."""
    if not 0 <= tol_ratio < 1:
        raise ValueError("tol_ratio must be in [0, 1)")
    step = max(tol_abs, 1e-9)
    # Below step/ratio the fixed tolerance rules, above it the share does: a logarithm keeps widths above it.
    if tol_ratio == 0:
        return F.floor(c / step)
    turn = step / tol_ratio
    size = F.abs(c)
    level = F.when(size <= turn, size / step).otherwise(F.lit(turn / step) + F.log(size / turn) / F.log(F.lit(1 + tol_ratio)))
    return F.floor(F.signum(c) * level)


def _counted_links(tol_abs: float, tol_ratio: float):
    """Of a bucket's own amounts how many rows are close, among its rows and its neighbours': what is close lies around an amount in order."""

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.abs(a - b) <= np.maximum(max(tol_abs, 0.0), np.minimum(np.abs(a), np.abs(b)) * max(tol_ratio, 0.0))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_amount")
        amounts, total = group["_amount"].to_numpy(np.float64), np.concatenate([[0], group["_rows"].to_numpy(np.int64).cumsum()])
        own = np.flatnonzero(group["_own"].to_numpy(bool))
        edges = []
        for way, end in ((-1, -1), (1, len(amounts))):
            inside, outside = own.copy(), np.full(len(own), end)
            while (np.abs(outside - inside) > 1).any():
                middle = inside + way * (np.abs(outside - inside) // 2)
                near = close(amounts[own], amounts[middle])
                inside, outside = np.where(near, middle, inside), np.where(near, outside, middle)
            edges.append(inside)
        out = group.iloc[own].drop(columns=["_own", "_bucket", "_rows"])
        return out.assign(_links=total[edges[1] + 1] - total[edges[0]] - 1)

    return run


def band_links(df: DataFrame, key: list[str], ident: str, amount: str, tol_abs: float, tol_ratio: float) -> DataFrame:
    """``ident, class_id, links`` of every row: the least ``ident`` with its key and amount, and how many other rows of its key are close to it.

    ``band_join`` of a table with itself, counted: rows of one key and amount are one class, and a class finds the ends of what is
    close to it among the amounts of its bucket and both neighbouring ones in order, so no pair is made.  A group holds the different amounts of one
    key within about three times the tolerance.  Null keys and amounts that are null or not finite have no links.
    """
    value = F.col(amount).cast("double")
    wide = 1 + 1e-9  # buckets a little wider than the tolerance, for amounts that lie exactly that far apart
    rows = df.select(*key, ident, value.alias("_amount")).withColumn("class_id", F.min(ident).over(Window.partitionBy(*key, "_amount")))
    finite = F.abs("_amount") < float("inf")  # false for NaN, which is the largest
    classes = rows.where(finite).groupBy(*key, "_amount").agg(F.count(F.lit(1)).alias("_rows")).na.drop(subset=key)
    around = classes.withColumn("_step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    around = around.withColumns({"_bucket": _bucket(F.col("_amount"), tol_abs * wide, tol_ratio * wide) + F.col("_step"), "_own": F.col("_step") == 0}).drop("_step")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key, "_amount").schema) + ", _links long"
    linked = around.groupBy(*key, "_bucket").applyInPandas(_counted_links(tol_abs, tol_ratio), schema)
    return rows.join(linked, [*key, "_amount"], "left").select(ident, "class_id", F.coalesce("_links", F.lit(0)).alias("links"))


def day_window_join(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str, days: int) -> DataFrame:
    """Rows of equal key whose dates are at most ``days`` apart, by windows of that width."""
    width = max(days, 1)
    window = lambda c: F.floor(F.unix_date(F.to_date(c)) / width)
    spread = left.withColumn("_window", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: window(F.col(a)) + d)))
    joined = spread.join(right.withColumn("_window", window(F.col(b))), [*key, "_window"])
    return joined.where(F.abs(F.datediff(F.to_date(a), F.to_date(b))) <= days).drop("_window")


def family_id(parts: Sequence[Column]) -> Column:
    """The first ten hex digits of SHA-1 over the parts, joined by a bar, null as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 10)


def families(df: DataFrame, parts: Sequence[str], source: str, order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Rows of one identity as a family: the first row of each source, duplicates by source, and a confidence.

    Aggregates in two steps, by family and source and then by family, so rows of a
    frequent identity combine before they are shuffled.
    """
    ident = family_id([F.col(p) for p in parts])
    first = F.min(F.struct(*order, *[c for c in carry if c not in order]))
    each = df.withColumn("family_id", ident).groupBy("family_id", *parts, source).agg(first.alias("row"), F.count(F.lit(1)).alias("rows"))
    filled = sum((F.when(F.coalesce(F.col(p).cast("string"), F.lit("")) != "", 1).otherwise(0) for p in parts), F.lit(0))
    rows = F.sort_array(F.collect_list(F.struct(F.col(source).alias("source"), F.struct(*[F.col(f"row.{c}").alias(c) for c in carry]).alias("row"), (F.col("rows") - 1).alias("duplicates"))))
    return each.groupBy("family_id", *parts).agg(rows.alias("rows")).withColumn("confidence", filled / len(parts))


def mismatches(families: DataFrame, fields: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """What differs inside each family: presence, each field, duplicates, in that order."""
    present = F.col("rows.source")
    found = [F.when(F.size(F.array_except(F.array(*[F.lit(s) for s in sources]), present)) > 0, F.lit("presence"))]
    of = lambda f: lambda r: F.coalesce(r["row"][f].cast("string"), F.lit("\0"))
    for f in fields:
        shown = F.transform(F.col("rows"), of(f))
        found.append(F.when(F.size(F.array_distinct(shown)) > 1, F.lit(f)))
    found.append(F.when(F.exists("rows", lambda r: r["duplicates"] > 0), F.lit("duplicate")))
    return families.withColumn("mismatches", F.array_compact(F.array(*found)))
