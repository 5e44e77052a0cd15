"""Findings: requirements, strength, ranking and the order of a dispute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the ranking.
OPENERS = ("strong_actionable", "dispute_primary")
SUPPORTERS = ("supportive_needs_companion", "support_paired")
CATEGORIES = ("status", "activity", "terms", "history")
RARE_DOCUMENTS = ("audit_log", "collection_history", "cra_report_7y")


def _decision() -> Column:
    return F.lower(F.trim(F.coalesce("default_decision", F.lit(""))))


def score_columns(findings: DataFrame) -> DataFrame:
    """base, reason_bonus, doc_bonus and present of each finding."""
    code = F.upper(F.coalesce("reason_code", F.lit("")))
    rare = F.coalesce(F.exists("documents", lambda d: F.lower(d).rlike("|".join(RARE_DOCUMENTS))), F.lit(False))
    present = F.coalesce(F.greatest(F.col("present_count"), F.lit(0)), F.size(F.filter("bureaus", lambda b: b != "")), F.lit(0))
    return findings.withColumns({
        "base": F.greatest(F.coalesce(F.col("min_days"), F.lit(0)), F.lit(0)),
        "reason_bonus": F.when(code == "C5_ALL_DIFF", 2).when(code == "C4_TWO_MATCH_ONE_DIFF", 1).otherwise(0),
        "doc_bonus": F.when(rare, 1).otherwise(0), "present": present,
    }).withColumn("score", F.col("base") + F.col("reason_bonus") + F.col("doc_bonus"))


def rank(findings: DataFrame, key: str, include_supporters: bool = True) -> DataFrame:
    """Openers, then supporters, then what is skipped and why, each in the order of the six keys.

    The order within a role: score, days, bureaus present (more first), category,
    bonuses (more first), field.
    """
    decision = _decision()
    skip = F.when(F.lower(F.trim("category")) == "natural_text", "excluded_category")
    skip = skip.when(decision.isin(*OPENERS) | (decision.isin(*SUPPORTERS) & F.lit(include_supporters)), F.lit(None))
    skip = skip.when(F.col("min_days").isNull(), "no_sla_or_min_days").when(decision.isin(*SUPPORTERS), "supporters_disabled").otherwise("unsupported_decision")
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.lower("category"))
    scored = score_columns(findings).withColumn("skip_reason", skip)
    scored = scored.withColumn("role", F.when(F.col("skip_reason").isNotNull(), "skipped").when(decision.isin(*OPENERS), "opener").otherwise("supporter"))
    order = [F.col("score").desc(), F.col("base").desc(), F.col("present").desc(), F.when(place == 0, len(CATEGORIES) + 1).otherwise(place), (F.col("reason_bonus") + F.col("doc_bonus")).desc(), "field"]
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(key, "role").orderBy(*order)))


def dispute_order(ranked: DataFrame, key: str) -> DataFrame:
    """The canonical order: openers, then supporters, a field's first place counting."""
    phase = F.when(F.col("role") == "opener", 0).otherwise(1)
    used = ranked.where("role <> 'skipped'").withColumn("phase", phase)
    first = used.withColumn("_n", F.row_number().over(Window.partitionBy(key, "field").orderBy("phase", "place"))).where("_n = 1").drop("_n")
    return first.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("phase", "place"))).drop("phase")


def stronger(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One item per key: the strongest, then the most days, then the first."""
    w = Window.partitionBy(*keys).orderBy(F.col("strength").desc(), F.col("min_days").desc(), "order_index")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def weakest_inner(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The weakest item that is neither first nor last; no row for two items or fewer."""
    ends = Window.partitionBy(*keys)
    inner = df.withColumn("_lo", F.min("order_index").over(ends)).withColumn("_hi", F.max("order_index").over(ends)).where("order_index > _lo and order_index < _hi")
    return inner.groupBy(*keys).agg(F.min(F.struct("strength", "min_days", "order_index")).alias("x")).select(*keys, F.col("x.order_index").alias("order_index"), F.col("x.strength").alias("strength"))


def by_bureau(findings: DataFrame, states: str) -> DataFrame:
    """A row for each bureau in which the finding is missing or differs, from a map of bureau states."""
    return findings.select("*", F.explode(states).alias("bureau", "state")).where(F.col("state").isin("missing", "conflict"))


def strength(field_kind: Column, missing_only: Column, consensus: Column, history_differs: Column) -> Column:
    """How strongly a field can be argued, by the kind of field and of disagreement."""
    return (
        F.when(field_kind == "history", F.when(missing_only, "soft").when(history_differs, "strong").otherwise("soft"))
        .when(field_kind == "account_number", F.when(missing_only, "soft").otherwise("strong"))
        .when(field_kind == "semantic", F.when(consensus == "split", "strong").otherwise("soft"))
        .when(field_kind.isin("date", "numeric"), F.when(missing_only, "soft").otherwise("strong")).otherwise("soft")
    )


def requirement_bureaus(disagreeing: Column, missing: Column, present: Column, broadcast_all: bool, everyone: Sequence[str]) -> Column:
    """Whom to ask: all, or those that disagree or miss it, and with a missing one those that have it too."""
    if broadcast_all:
        return F.array(*[F.lit(b) for b in sorted(everyone)])
    asked = F.array_union(disagreeing, missing)
    return F.array_sort(F.when(F.size(missing) > 0, F.array_union(asked, present)).otherwise(asked))


def downgraded(decision: Column, field: Column, is_missing: Column, is_mismatch: Column, material: Sequence[str]) -> Column:
    """A supporter whose only fault is a missing value is context only, unless the field is material."""
    plain = is_missing & ~is_mismatch & ~field.isin(*material)
    return F.when(plain & (F.trim(decision) == "supportive_needs_companion"), "neutral_context_only").otherwise(decision)


def pair_decision(account_flag: Column, debt_flag: Column) -> Column:
    """From whether the account and the debt are the same: true, false or null for unsure."""
    return (
        F.when(account_flag & debt_flag, "same_account_same_debt").when(account_flag & ~debt_flag, "same_account_diff_debt")
        .when(account_flag & debt_flag.isNull(), "same_account_debt_unknown").when(~account_flag & debt_flag, "same_debt_diff_account").otherwise("different")
    )


def guarded(decision: Column, number_conflict: Column, stem_equal: Column) -> Column:
    """No two accounts are one if their numbers conflict or their stems differ."""
    breach = F.coalesce(number_conflict, F.lit(False)) | F.coalesce(~stem_equal, F.lit(False))
    return F.when(decision.startswith("same_account_") & breach, "different").otherwise(decision)


def conditional(decision: Column, conditional_field: Column, is_mismatch: Column, corroboration: Column, minimum: int) -> Column:
    """A strong decision on a conditional field needs a mismatch and enough corroboration."""
    return F.when((decision == "strong") & conditional_field & ~(is_mismatch & (corroboration >= minimum)), "no_case").otherwise(decision)


def polarity(kind: Column, amount: Column, text: Column, good: str, bad: str, severity: str = "medium") -> Column:
    """good, bad, neutral or unknown: amounts above zero are bad, texts go by pattern, the bad one first."""
    by_text = F.when(text.rlike(bad), "bad").when(text.rlike(good), "good").when(F.trim(text) == "", "unknown").otherwise("neutral")
    by_amount = F.when(amount > 0, "bad").when(amount == 0, "good").when(amount.isNull(), "unknown").otherwise("neutral")
    value = F.coalesce(F.when(kind == "money", by_amount).otherwise(by_text), F.lit("unknown"))
    return F.struct(value.alias("polarity"), F.when(value == "bad", severity).otherwise("low").alias("severity"))


def with_decisions(findings: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Decisions of an earlier review written over the defaults where there is one."""
    found = results.groupBy(key, "field").agg(F.max_by("decision", "seq").alias("reviewed"))
    return findings.join(found, [key, "field"], "left").withColumn("decision", F.coalesce("reviewed", "default_decision")).drop("reviewed")


def gaps(items: int, low: int, high: int) -> Column:
    """All combinations of handoff gaps between so many items, as an array of arrays."""
    out = F.array(F.array().cast("array<int>"))
    choices = F.array(*[F.lit(g) for g in range(low, high + 1)])
    for _ in range(max(items - 1, 0)):
        out = F.flatten(F.transform(out, lambda have: F.transform(choices, lambda g: F.concat(have, F.array(g)))))
    return out
