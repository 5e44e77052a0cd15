"""The score of two accounts in all fields: matches of any two sources, histories, label, amount conflicts and what follows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermend.functions import histories
from ledgermend.operators import matching

#: The fields that are compared, in their order.
FIELDS = ("account_number", "date_opened", "balance_owed", "account_type", "account_status", "history_2y", "history_7y", "account_label")
LATE_COUNTS = ("late30", "late60", "late90")


@dataclass(frozen=True)
class Policy:
    """Which fields count and how much, and how near values must be."""

    fields: Sequence[str] = FIELDS
    weights: Mapping[str, float] = field(default_factory=lambda: dict(matching.WEIGHTS))
    history_similarity: float = 1.0
    number_length: int = 0
    opened_days: int = 0
    amount_abs: float = 50.0
    amount_ratio: float = 0.01
    direct_points: float = matching.DIRECT_POINTS
    ai_points: float = matching.AI_POINTS


def any_equal(left: Column, right: Column) -> Column:
    """Whether two arrays of sources share a value; nulls match nothing."""
    return F.coalesce(F.arrays_overlap(F.array_compact(left), F.array_compact(right)), F.lit(False))


def plain_label(text: Column) -> Column:
    """A heading in lower case with single spaces; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(""))


def field_matches(policy: Policy) -> dict[str, Column]:
    """Of a pair with columns ``<field>_a`` and ``<field>_b``: which fields match.

    account_number, date_opened, balance_owed (cents), account_type and account_status are arrays of three sources, history_2y is an array of
    tokens (null or empty: none), history_7y a struct of late30, late60 and late90 (null: none) and account_label a text.
    """
    a, b = (lambda name, side=side: F.col(f"{name}_{side}") for side in ("a", "b"))
    sources = lambda col: [F.get(col, F.lit(k)) for k in range(3)]
    number = matching.number_pair(sources(a("account_number")), sources(b("account_number")), policy.number_length)["matched"]
    near = F.exists(F.array_compact(a("date_opened")), lambda x: F.exists(F.array_compact(b("date_opened")), lambda y: F.abs(F.date_diff(x, y)) <= policy.opened_days))
    counts = lambda side: [F.col(f"history_7y_{side}.{c}") for c in LATE_COUNTS]
    seven = F.when(a("history_7y").isNotNull() & b("history_7y").isNotNull(), histories.counter_similarity(counts("a"), counts("b")))
    return {
        "account_number": number,
        "date_opened": near,
        "balance_owed": matching.exact_balance(a("balance_owed"), b("balance_owed")),
        "account_type": any_equal(a("account_type"), b("account_type")),
        "account_status": any_equal(a("account_status"), b("account_status")),
        "history_2y": histories.aligned_similarity(a("history_2y"), b("history_2y")) >= policy.history_similarity,
        "history_7y": seven >= policy.history_similarity,
        "account_label": plain_label(a("account_label")) == plain_label(b("account_label")),
    }


def scored_pairs(accounts: DataFrame, session: str, index: str, policy: Policy | None = None, amounts: Sequence[str] = ()) -> DataFrame:
    """``session, <index>_a, <index>_b`` and points, decision, triggers, matched fields and conflicts of every pair of a session's accounts.

    ``accounts`` has the fields of ``field_matches`` and, for ``amounts``, further arrays of cents.  Balances conflict unless they share a value other than
    zero; further amounts conflict where both sides have some and none are close.  A pair with points for it, no conflict and equal balances is merged at
    once (auto), one with fewer points is asked about (ai).  A missing value matches nothing.
    """
    policy = policy or Policy()
    both = matching.pairs(accounts, session, index)
    matched = {name: F.coalesce(hit, F.lit(False)) for name, hit in field_matches(policy).items() if name in policy.fields}
    both = both.withColumns({f"_{name}": hit for name, hit in matched.items()})
    told = {"balance_owed": (F.col("balance_owed_a"), F.col("balance_owed_b"))} if "balance_owed" in policy.fields else {}
    told |= {name: tuple(F.transform(F.col(f"{name}_{side}"), lambda c: c / 100) for side in ("a", "b")) for name in amounts}
    conflicts = matching.amount_conflicts(told, policy.amount_abs, policy.amount_ratio)
    both = both.withColumn("conflicts", conflicts)
    points = sum((F.when(F.col(f"_{name}"), policy.weights[name]).otherwise(0.0) for name in matched), F.lit(0.0))
    exact = F.col("_balance_owed") if "balance_owed" in matched else F.lit(False)
    decision = F.when((F.col("points") >= policy.direct_points) & (F.size("conflicts") == 0) & exact, "auto").when(F.col("points") >= policy.ai_points, "ai").otherwise("different")
    names = F.array_compact(F.array(*[F.when(F.col(f"_{name}"), F.lit(name)) for name in matched]))
    out = both.withColumn("points", points).withColumn("decision", decision)
    trigger = F.when(F.col("decision") == "auto", F.array(F.lit("points:direct"))).when(F.col("decision") == "ai", F.array(F.lit("points:ai"))).otherwise(F.array().cast("array<string>"))
    return out.select(session, f"{index}_a", f"{index}_b", "points", "decision", trigger.alias("triggers"), names.alias("matched"), "conflicts")
