"""Issues, tiers and actions of a problem account."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermend.functions.lets import bound
from ledgermend.functions.text import table
from ledgermend.operators.picks import deduped

#: The tier of every known issue, other spellings, and what the fallback and the categories go by.
ISSUE_TIERS = {
    "bankruptcy": "Tier1", "charge_off": "Tier1", "collection": "Tier1", "repossession": "Tier1", "foreclosure": "Tier1", "severe_delinquency": "Tier2",
    "moderate_delinquency": "Tier3", "derogatory": "Tier3", "high_utilization": "Tier4", "none": "none", "unknown": "none",
}
ISSUE_ALIASES = {"chargeoff": "charge_off", "repo": "repossession", "moderate_deliquency": "moderate_delinquency"}
DEROGATORY = ("collection", "chargeoff", "charge-off", "charge off", "repossession", "repos", "delinquent", "late payments")


def clamped_issue(raw: Column) -> Column:
    """A known issue, by its name or another spelling; anything else is unknown."""
    key = F.lower(F.trim(raw))
    named = F.coalesce(F.try_element_at(table(ISSUE_ALIASES), key), key)
    return F.when(named.isin(*ISSUE_TIERS), named).otherwise("unknown")


def issue_tier(issue: Column) -> Column:
    return F.coalesce(F.try_element_at(table(ISSUE_TIERS), issue), F.lit("none"))


def normalized_decision(issue: Column, source: Column, reasons: Column, confidence: Column) -> Column:
    """A decision with a known issue and its tier, source ``ai`` or ``rules``, distinct reasons, confidence between 0 and 1 (0 if it is no number)."""
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence.try_cast("double"), F.lit(0.0))))
    whole = lambda name: F.struct(name.alias("primary_issue"), issue_tier(name).alias("tier"), F.when(source == "rules", "rules").otherwise("ai").alias("decision_source"), deduped(reasons).alias("problem_reasons"), sure.alias("confidence"))
    return bound(clamped_issue(issue), whole)


def fallback_action(status: Column, dispute_type: Column) -> Column:
    """``dispute`` for a derogatory status or a named kind of dispute, else empty."""
    low = F.lower(F.coalesce(status, F.lit("")))
    bad = F.coalesce(dispute_type != "", F.lit(False))
    for word in DEROGATORY:
        bad = bad | low.contains(word)
    return F.when(bad, "dispute").otherwise("")


def category(dispute_type: Column, facts: Column, errors: Column, known: Sequence[str]) -> Column:
    """The category of a client's summary and whether it is sure: a known kind of dispute, else by words."""
    kind = F.lower(F.coalesce(dispute_type, F.lit("")))
    bits = F.concat(F.array(F.coalesce(dispute_type, F.lit("")), F.coalesce(facts, F.lit(""))), F.coalesce(errors, F.array().cast("array<string>")))
    text = F.trim(F.array_join(F.transform(bits, lambda t: F.replace(F.lower(t), F.lit("_"), F.lit(" "))), " "))
    by_words = lambda t: F.when(t.contains("identity") | t.contains("stolen"), "identity_theft").when(t.contains("not mine"), "not_mine").when(t.contains("goodwill"), "goodwill")
    name = F.when(text == "", "inaccurate_reporting").when(kind.isin(*known), kind).otherwise(F.coalesce(by_words(text), F.lit("inaccurate_reporting")))
    return F.struct(name.alias("category"), ((text == "") | kind.isin(*known) | by_words(text).isNotNull()).alias("sure"))
