"""Page texts in canonical form, and repairs of damaged JSON, as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermend.functions.lets import bound

#: Marks of text direction, and what counts as a date and as an amount on a page.
DIRECTION_MARKS = "[‎‏‪‫‬‭‮]"
PAGE_DATE = r"(?U)\b(\d{1,4})([/-])(\d{1,2})\2(\d{1,4})\b"
PAGE_AMOUNT = r"(?U)(?<!\w)[$€£₪]?\s*[+-]?\d[\d,]*(?:\.\d+)?"


@F.pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Compatibility forms (NFKC), which no built-in function gives."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def rewritten(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Every match of a pattern replaced by ``change`` of it (kept where that is null): struct of text and found, an array of old and new."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda old: F.struct(old.alias("old"), change(old).alias("new")))

    def joined(pairs: Column) -> Column:
        between = F.split(text, pattern, -1)
        return F.struct(F.array_join(F.zip_with(between, pairs, lambda gap, p: F.concat(gap, F.coalesce(p["new"], p["old"], F.lit("")))), "").alias("text"), pairs.alias("found"))

    return bound(found, joined)


def page_day(old: Column) -> Column:
    """``YYYY-MM-DD`` of a date with its year first or last (month first with slashes, day first with dashes); null if the calendar lacks it."""
    part = lambda k: F.element_at(F.split(old, "[/-]"), k)
    wide = lambda k: F.length(part(k)) == 4
    parts = F.when(wide(1), F.array(part(1), part(2), part(3))).when(wide(3) & old.contains("/"), F.array(part(3), part(1), part(2))).when(wide(3), F.array(part(3), part(2), part(1)))
    return F.date_format(F.try_to_timestamp(F.array_join(parts, "-"), F.lit("yyyy-M-d")), "yyyy-MM-dd")


def page_number(old: Column) -> Column:
    return F.regexp_replace(old, "[^0-9.-]", "")


def normalized_page(raw: Column) -> Column:
    """Canonical text, and how many dates, amounts, direction marks and spaces changed.

    Compatibility forms, then direction marks and control characters go, spaces collapse, dates become
    ISO and amounts bare numbers.
    """
    count = lambda pairs, test: F.size(F.filter(pairs, test))

    def cleaned(plain: Column) -> Column:
        bare = F.regexp_replace(plain, DIRECTION_MARKS, "")
        kept = F.regexp_replace(bare, r"[\p{C}&&[^\n\r\t]]", "")
        one = F.regexp_replace(kept, r"(?U)\s+", " ")
        return F.struct(one.alias("text"), (F.length(plain) - F.length(bare)).alias("marks"), (F.length(kept) - F.length(one)).alias("spaces"))

    def numbers(page: Column, dated: Column) -> Column:
        return bound(rewritten(dated["text"], PAGE_AMOUNT, page_number), lambda done: F.struct(
            F.trim(done["text"]).alias("text"), count(dated["found"], lambda p: p["new"].isNotNull()).alias("dates"),
            count(done["found"], lambda p: p["new"] != p["old"]).alias("amounts"), page["marks"].alias("marks"), page["spaces"].alias("spaces")))

    plain = compatible(F.coalesce(raw, F.lit("")))
    return bound(plain, lambda p: bound(cleaned(p), lambda page: bound(rewritten(page["text"], PAGE_DATE, page_day), lambda dated: numbers(page, dated))))


#: What is mended in a text that is no JSON, in this order.
JSON_REPAIRS = (
    (r",(?=\s*[}\]])", ""), (r",\s*,+", ","), (r"'([^']*)'(?=\s*:)", '"$1"'), (r":\s*'([^']*)'", ': "$1"'),
    (r"(^|[,{])\s*([A-Za-z_][A-Za-z0-9_-]*)\s*(?=:)", '$1"$2"'),
    (r'(:\s*)(true|false|null|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(\s+)(?=")', "$1$2,$3"),
)


def lenient_json(text: Column) -> Column:
    """Canonical JSON of a text (scalars too), mended if need be; ``{}`` and ``invalid_json`` if nothing helps."""
    mended = text
    for pattern, new in JSON_REPAIRS:
        mended = F.regexp_replace(mended, pattern, new)
    read = F.coalesce(F.to_json(F.try_parse_json(text)), F.to_json(F.try_parse_json(mended)))
    return bound(read, lambda json: F.struct(F.coalesce(json, F.lit("{}")).alias("json"), F.when(json.isNull(), "invalid_json").alias("error")))
