"""Money text to numbers.  The reading rules differ by consumer, so each has its own function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermend.functions.predicates import missing_exact, missing_trimmed


def _bracketed(text: Column) -> Column:
    return text.startswith("(") & text.endswith(")")


def _first_number(text: Column, dropped: str, signed: str) -> Column:
    """The first number once the dropped characters are gone, as text; null if there is none."""
    inner = F.when(_bracketed(text), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    return F.nullif(F.regexp_extract(F.regexp_replace(inner, dropped, ""), rf"({signed}\d+(?:\.\d+)?)", 1), F.lit(""))


def _negated(value: Column, text: Column) -> Column:
    return F.when(_bracketed(text) & (value >= 0), -value).otherwise(value)


def match_amount(raw: Column) -> Column:
    """For matching: ``$ , /`` and spaces dropped, brackets negative."""
    text = F.trim(raw)
    return F.when(~missing_exact(raw), _negated(_first_number(text, r"[\s$,/]", "[-+]?").try_cast("double"), text))


def match_cents(raw: Column) -> Column:
    """The same in whole cents, half up."""
    text = F.trim(raw)
    value = _negated(_first_number(text, r"[\s$,/]", "[-+]?").try_cast("decimal(28,10)"), text)
    return F.when(~missing_exact(raw), F.round(value * 100, 0).cast("long"))


def field_amount(raw: Column) -> Column:
    """For consensus: as for matching, but a slash ends the number."""
    text = F.trim(raw)
    return F.when(~missing_trimmed(raw), _negated(_first_number(text, r"[,$\s]", "-?").try_cast("double"), text))


def rule_amount(raw: Column) -> Column:
    """For problem rules: all but digits, dot and minus dropped, so brackets do not negate."""
    return F.regexp_replace(F.trim(raw), r"[^\d.\-]", "").try_cast("double")


def polarity_amount(raw: Column) -> Column:
    """For polarity: what is left after ``$ ,`` and spaces must be a number; brackets negative, ``--`` dropped."""
    text = F.regexp_replace(F.trim(raw), "[$, ]", "")
    text = F.when(_bracketed(text), F.concat(F.lit("-"), F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)
    text = F.replace(text, F.lit("--"), F.lit(""))
    return F.when(~text.isin("", "-", "-0", "0-"), text.try_cast("double"))


def found_amount(text: Column) -> Column:
    """The first amount with an optional dollar sign and thousands commas anywhere in a text."""
    hit = F.regexp_extract(text, r"(-?\$?\d[\d,]*(?:\.\d+)?)", 1)
    return F.regexp_replace(hit, "[$,]", "").try_cast("double")


def pack_amount(raw: Column) -> Column:
    """As a decimal; what is no number is 0."""
    return F.coalesce(F.regexp_replace(F.trim(raw), "[$,]", "").try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))


def finite(raw: Column) -> Column:
    """A double that is neither NaN nor infinite, else null."""
    value = raw.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def term_months(raw: Column) -> Column:
    """The first number of a term, years times twelve, half to even."""
    text = F.regexp_replace(F.lower(F.trim(raw)), "[,()]", " ")
    value = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    years = text.rlike(r"\b(years?|yrs?|y\b)")
    return F.when(~missing_trimmed(raw), F.bround(F.when(years, value * 12).otherwise(value), 0).cast("long"))


def pivot_year(year: Column) -> Column:
    """Two digits: below 50 is 20xx, else 19xx."""
    return F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)


#: Months late per status; 180 and charge-off are terminal.
SEVERITY = {"ok": 0, "current": 0, "30": 30, "60": 60, "90": 90, "120": 120, "150": 150, "180": 999, "co": 999, "chargeoff": 999}


def severity(status: Column) -> Column:
    """Null for an unknown status."""
    table = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(status)))


def close_for_matching(a: Column, b: Column, tol_abs: float, tol_ratio: float) -> Column:
    """Within the larger of a fixed tolerance and a share of the smaller magnitude."""
    allowed = F.greatest(F.lit(max(tol_abs, 0.0)), F.least(F.abs(a), F.abs(b)) * max(tol_ratio, 0.0))
    return F.coalesce(F.abs(a - b) <= allowed, F.lit(False))


def close_for_consensus(a: Column, b: Column, tol_abs: float = 50.0, tol_ratio: float = 0.01) -> Column:
    """Within the larger of a fixed tolerance and a share of the larger magnitude."""
    return F.abs(a - b) <= F.greatest(F.lit(tol_abs), F.greatest(F.abs(a), F.abs(b)) * tol_ratio)
