"""Letters: which template an action takes, what it still lacks, and what a strategy says about an account."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermend.functions.text import creditor

# Templates and required fields of the plain routes.
ROUTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "dispute": ("dispute_letter_template.html", ("bureau",)),
    "goodwill": ("goodwill_letter_template.html", ("creditor",)),
    "custom_letter": ("general_letter_template.html", ("recipient",)),
    "debt_validation": ("debt_validation_letter_template.html", ("collector_name", "account_number_masked", "bureau", "legal_safe_summary", "days_since_first_contact")),
    "mov": ("mov_letter_template.html", ("creditor_name", "account_number_masked", "legal_safe_summary", "cra_last_result", "days_since_cra_result")),
    "cease_and_desist": ("cease_and_desist_letter_template.html", ("collector_name", "account_number_masked", "legal_safe_summary")),
    "direct_dispute": ("direct_dispute_letter_template.html", ("creditor_name", "account_number_masked", "legal_safe_summary", "furnisher_address")),
    "bureau_dispute": ("bureau_dispute_letter_template.html", ("creditor_name", "account_number_masked", "bureau", "legal_safe_summary")),
}


def routed(tag: Column, context: Column, routes: Mapping[str, tuple[str, Sequence[str]]] = ROUTES) -> Column:
    """Template, required and missing fields of an action; ``context`` maps field names to values, null if absent.

    An unknown action has no template and requires nothing.
    """
    low = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    template, required = F.lit(None).cast("string"), F.array().cast("array<string>")
    for name, (file, fields) in routes.items():
        template = F.when(low == name, file).otherwise(template)
        required = F.when(low == name, F.array(*[F.lit(f) for f in fields])).otherwise(required)
    have = F.map_keys(F.map_filter(context, lambda k, v: v.isNotNull()))
    return F.struct(template.alias("template"), required.alias("required"), F.array_except(required, have).alias("missing"))


def filled(sources: Sequence[Column], fields: Sequence[str]) -> Column:
    """A context whose fields come from the first source map that has a non-empty value."""
    pick = lambda f: F.coalesce(*[F.nullif(F.try_element_at(s, F.lit(f)), F.lit("")) for s in sources])
    return F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[pick(f) for f in fields]))


def lacking(context: Column, critical: Sequence[str], optional: Sequence[str]) -> Column:
    """The critical and the optional fields without a value, in the order given."""
    gone = lambda names: F.array_compact(F.array(*[F.when(F.coalesce(F.try_element_at(context, F.lit(n)), F.lit("")) == "", F.lit(n)) for n in names]))
    return F.struct(gone(critical).alias("critical"), gone(optional).alias("optional"))


def with_strategy(accounts: DataFrame, plan: DataFrame, aliases: Sequence[tuple[str, str]], actions: Mapping[str, str]) -> DataFrame:
    """Each account with the last strategy row of its creditor and last four digits, and why there is none.

    Both sides have name and account_number; ``plan`` has seq and recommended_action;
    ``actions`` maps phrases to action tags.
    """
    four = F.right(F.regexp_replace(F.coalesce("account_number", F.lit("")), r"\D", ""), F.lit(4))
    keyed = lambda df: df.withColumn("_name", creditor(F.coalesce("name", F.lit("")), aliases)).withColumn("_four", four)
    last = keyed(plan).groupBy("_name", "_four").agg(F.max_by(F.struct("recommended_action"), "seq").alias("s"))
    tags = F.create_map(*[F.lit(x) for p in actions.items() for x in p])
    raw = F.col("s.recommended_action")
    tag = F.try_element_at(tags, F.lower(F.trim(raw)))
    why = F.when(F.col("s").isNull(), "missing_input").when(raw.isNull(), "empty_output").when(tag.isNull(), "unrecognized_format")
    return keyed(accounts).join(last, ["_name", "_four"], "left").withColumns({"action_tag": tag, "raw_action": raw, "failure_reason": why}).drop("_name", "_four", "s")
