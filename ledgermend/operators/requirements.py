"""From disagreements to requirements: rules, default decisions, eligibility and the results of reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermend.functions.dates import business_to_calendar
from ledgermend.operators.findings import downgraded, requirement_bureaus, strength

#: Statuses, and words in them, that make a history delinquent.
DELINQUENT = ("30", "60", "90", "120", "150", "180", "CO", "LATE30", "LATE60", "LATE90")
DELINQUENT_WORDS = ("CHARGE", "COLLECT", "DEROG")


def with_rules(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """Each disagreeing field with the columns of its rule; fields without a rule are dropped.

    ``rules`` has one row per field and is a configuration.  It is broadcast by name: its size is unknown to the planner, and where
    fields hold one name a product would compute them anew for each of its partitions.
    """
    return fields.join(F.broadcast(rules), "field")


def reason_prefix(code: Column) -> Column:
    return F.split_part(F.upper(F.trim(code)), F.lit("_"), F.lit(1))


def with_default_decisions(findings: DataFrame, matrix: DataFrame) -> DataFrame:
    """``default_decision`` by field and the reason's prefix, from ``matrix(field, reason, decision)``; null if it has none."""
    named = matrix.select(F.trim("field").alias("_field"), reason_prefix(F.col("reason")).alias("_reason"), F.trim("decision").alias("default_decision"))
    keyed = findings.withColumn("_field", F.trim("field")).withColumn("_reason", reason_prefix(F.col("reason_code")))
    return keyed.join(F.broadcast(named), ["_field", "_reason"], "left").drop("_field", "_reason")


def with_results(findings: DataFrame, results: DataFrame, key: str, order: str) -> DataFrame:
    """The finding that each review result belongs to: the first that was sent, has its reason and, where both name one, its field.

    ``results`` has the key, result_id, mismatch_code and field; results without a code or finding have no row.
    """
    sent = findings.where("send_to_ai").select(key, F.col("reason_code").alias("mismatch_code"), F.col("field").alias("_own"), order)
    met = results.where(F.col("mismatch_code").isNotNull()).join(sent, [key, "mismatch_code"])
    met = met.where(F.col("field").isNull() | (F.col("field") == "") | F.col("_own").isNull() | (F.col("_own") == "") | (F.col("field") == F.col("_own")))
    return met.groupBy(key, "result_id").agg(F.min(F.struct(order, "_own")).alias("x")).select(key, "result_id", F.col(f"x.{order}").alias(order), F.col("x._own").alias("field"))


def eligibility(field: Column, pattern: Column, always: Sequence[str], on_mismatch: Sequence[str]) -> Column:
    """missing, mismatch, both and eligible of a field's reporting pattern (case_1 to case_6)."""
    missing, mismatch = pattern.isin("case_1", "case_2", "case_3", "case_6"), pattern.isin("case_3", "case_4", "case_5")
    eligible = F.when(field.isin(*always), missing | mismatch).when(field.isin(*on_mismatch), mismatch).otherwise(False)
    return F.struct(missing.alias("missing"), mismatch.alias("mismatch"), (missing & mismatch).alias("both"), eligible.alias("eligible"))


def history_strength(missing: Column, present: Column, structured: Column, counts: Column, tokens: Column) -> Column:
    """``strong`` or ``soft`` of a disagreeing two-year history.

    ``missing`` and ``present`` count sources, ``structured`` says that all present ones could be read,
    ``counts`` and ``tokens`` are the present sources' signatures (arrays of arrays).  Equal counts with
    different tokens, none of them delinquent, are soft.
    """
    bad = lambda t: F.replace(F.upper(t), F.lit(" "), F.lit("")).isin(*DELINQUENT) | F.upper(t).rlike("|".join(DELINQUENT_WORDS))
    late = F.exists(tokens, lambda own: F.exists(own, bad))
    alike = (F.size(F.array_distinct(counts)) <= 1) & (F.size(F.array_distinct(tokens)) > 1) & ~late
    return F.when((missing > 0) & (present > 0), "soft").when(present == 0, "strong").when(~structured | alike, "soft").otherwise("strong")


def requirements(fields: DataFrame, rules: DataFrame, everyone: Sequence[str], broadcast_all: bool = False, monday: str = "2024-01-01") -> DataFrame:
    """Disagreeing fields as requirements: category, calendar days to answer, strength and whom to ask.

    ``fields`` has field, consensus, disagreeing, missing and present (names of sources), is_missing and
    is_mismatch, and for histories history_differs; ``rules`` has field, kind, category, min_days and
    duration_unit (business days count from a Monday).  Fields that agree or have no rule are dropped.
    """
    found = with_rules(fields.where("consensus <> 'unanimous'"), rules)
    business = business_to_calendar(F.lit(monday).cast("date"), F.col("min_days"))
    days = F.when(F.col("duration_unit") == "business_days", business).otherwise(F.col("min_days"))
    differs = F.col("history_differs") if "history_differs" in fields.columns else F.lit(True)
    missing_only = F.col("is_missing") & ~F.col("is_mismatch")
    return found.withColumns({
        "min_days": days.cast("int"), "duration_unit": F.lit("calendar_days"), "strength": strength(F.col("kind"), missing_only, F.col("consensus"), differs),
        "bureaus": requirement_bureaus(F.col("disagreeing"), F.col("missing"), F.col("present"), broadcast_all, everyone),
    })


def built_findings(required: DataFrame, matrix: DataFrame, material: Sequence[str] = ()) -> DataFrame:
    """Requirements with their default decision: by field and reason, context only where nothing but a value is missing."""
    decided = with_default_decisions(required, matrix)
    return decided.withColumn("default_decision", downgraded(F.col("default_decision"), F.col("field"), F.col("is_missing"), F.col("is_mismatch"), material))
