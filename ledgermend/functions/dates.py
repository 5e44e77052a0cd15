"""Date text to dates, months and business days as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermend.functions.predicates import missing_exact, missing_trimmed

#: English month names, by their first three letters.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
WEEKEND = (5, 6)


def _built(year: Column, month: Column, day: Column) -> Column:
    """A date from digits; null if it isn't one."""
    text = F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def _read(text: Column, pattern: str, order: str, pivot: bool = False) -> Column:
    """A date whose pattern's groups stand in the given order, such as ``mdy``; years of two digits turn at 69."""
    part = {k: F.regexp_extract(text, pattern, i + 1) for i, k in enumerate(order)}
    year = F.when(part["y"].try_cast("int") < 69, F.concat(F.lit("20"), part["y"])).otherwise(F.concat(F.lit("19"), part["y"])) if pivot else part["y"]
    return F.when(text.rlike(pattern), _built(year, part["m"], part["d"]))


def match_date(raw: Column) -> Column:
    """For matching: year first, then month first, then day first, then two-digit years, then any mixture of separators."""
    text = F.trim(raw)
    text = F.regexp_extract(F.split_part(text, F.lit("T"), F.lit(1)), r"^\s*(\S*)", 1)
    tries = [
        _read(text, rf"^(\d{{4}}){s}(\d{{1,2}}){s}(\d{{1,2}})$", "ymd") for s in ("-", "/", r"\.")
    ]
    tries += [_read(text, rf"^(\d{{1,2}}){s}(\d{{1,2}}){s}(\d{{4}})$", "mdy") for s in ("/", "-", r"\.")]
    tries += [_read(text, rf"^(\d{{1,2}}){s}(\d{{1,2}}){s}(\d{{4}})$", "dmy") for s in (r"\.", "-", "/")]
    tries += [_read(text, rf"^(\d{{1,2}}){s}(\d{{1,2}}){s}(\d{{2}})$", "mdy", True) for s in ("/", "-")]
    tries.append(_read(text, r"^(\d{4})(\d{2})(\d{2})$", "ymd"))
    mixed = r"[./\\-]"
    tries.append(_read(text, rf"^(\d{{4}}){mixed}(\d{{1,2}}){mixed}(\d{{1,2}})$", "ymd"))
    tries.append(_read(text, rf"^(\d{{1,2}}){mixed}(\d{{1,2}}){mixed}(\d{{4}})$", "mdy"))
    tries.append(_read(text, rf"^(\d{{1,2}}){mixed}(\d{{1,2}}){mixed}(\d{{2}})$", "mdy", True))
    tries.append(_read(text, rf"^(\d{{1,2}}){mixed}(\d{{1,2}}){mixed}(\d{{4}})$", "dmy"))
    return F.when(~missing_exact(raw), F.coalesce(*tries))


def field_date(raw: Column, day_first: Column | bool = False) -> Column:
    """For consensus: year first; dots day first; else by convention; two-digit years turn at 50; month names."""
    text = F.trim(raw)
    first = F.lit(day_first) if isinstance(day_first, bool) else day_first
    plain = r"^(\d{1,2})[.\-/]+(\d{1,2})[.\-/]+(\d{4}|\d{2})$"
    parts = [F.regexp_extract(text, plain, k) for k in (1, 2, 3)]
    year = F.when(F.length(parts[2]) == 4, parts[2]).when(parts[2].try_cast("int") < 50, F.concat(F.lit("20"), parts[2])).otherwise(F.concat(F.lit("19"), parts[2]))
    by_convention = F.when(text.rlike(plain), F.when(first, _built(year, parts[1], parts[0])).otherwise(_built(year, parts[0], parts[1])))
    return F.when(
        ~missing_trimmed(raw),
        F.coalesce(
            _read(text, r"^(\d{4})[.\-/]+(\d{1,2})[.\-/]+(\d{1,2})$", "ymd"),
            _read(text, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "dmy"),
            by_convention,
            named_month_date(text),
        ),
    )


def named_month_date(raw: Column) -> Column:
    """An English month name, a day and a year of four digits, in any order of month and day."""
    text = F.lower(F.trim(F.regexp_replace(raw, r"[,\-.\s]+", " ")))
    table = F.create_map(*[F.lit(x) for k, v in MONTHS.items() for x in (k, f"{v:02d}")])
    word = F.regexp_extract(text, r"\b([a-z]{3,9})\b", 1)
    month = F.try_element_at(table, F.substring(word, 1, 3))
    day, year = F.regexp_extract(text, r"\b(\d{1,2})\b", 1), F.regexp_extract(text, r"\b(\d{4})\b", 1)
    return F.when(month.isNotNull() & (year != ""), _built(year, month, F.when(day == "", "01").otherwise(day)))


#: The order of searches of the branch rules' date reader.
FOUND = ((r"\b(\d{4})-(\d{2})-(\d{2})\b", "ymd"), (r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b", "dmy"), (r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", "mdy"), (r"\b(\d{1,2})-(\d{1,2})-(\d{4})\b", "mdy"), (r"\b(\d{1,2})\s+(\d{1,2})\s+(\d{4})\b", "mdy"))


def found_date_text(text: Column) -> Column:
    """The first date found anywhere, as ``YYYY-MM-DD`` without a check of the calendar."""
    out = []
    for pattern, order in FOUND:
        part = {k: F.lpad(F.regexp_extract(text, pattern, i + 1), 4 if k == "y" else 2, "0") for i, k in enumerate(order)}
        out.append(F.when(text.rlike(pattern), F.concat_ws("-", part["y"], part["m"], part["d"])))
    return F.coalesce(*out)


def found_date(text: Column) -> Column:
    """The same as a date; what the calendar lacks is null."""
    return F.try_to_date(found_date_text(text), "yyyy-MM-dd")


def convention_date(raw: Column, convention: str) -> Column:
    """ISO, or digits in the order that ``DMY`` or ``MDY`` says."""
    text = F.trim(raw)
    iso = _read(text, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "ymd")
    if convention.upper() not in ("DMY", "MDY"):
        return iso
    return F.coalesce(iso, _read(text, r"^(\d{1,2})[./\-\s](\d{1,2})[./\-\s](\d{4})$", convention.lower()))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def first_forbidden_month(closed: Column) -> Column:
    """The month after closure."""
    return month_key(F.add_months(closed, 1))


def valid_month(key: Column) -> Column:
    """``YYYY-MM`` between 2000 and 2100, else null."""
    good = key.rlike(r"^\d{4}-\d{2}$") & F.substring(key, 1, 4).between("2000", "2100") & F.substring(key, 6, 2).between("01", "12")
    return F.when(good, key)


def elapsed_days(since: Column, now: Column) -> Column:
    """Whole periods of 24 hours, not calendar days."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(since)) / 86400)


def is_business_day(day: Column, weekend: Sequence[int] = WEEKEND, holidays: Column | None = None) -> Column:
    open_day = ~F.weekday(day).isin(*weekend)
    return open_day if holidays is None else open_day & ~F.coalesce(F.array_contains(holidays, day), F.lit(False))


def _open_days(first: Column, last: Column, holidays: Column | None, weekend: Sequence[int]) -> Column:
    span = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
    return F.filter(span, lambda d: is_business_day(d, weekend, holidays))


def _reach(n: Column, holidays: Column | None) -> Column:
    """Calendar days that surely hold ``n`` business days (at least one a week, besides the holidays)."""
    return (n * 7 + 7 + (F.lit(0) if holidays is None else F.size(holidays))).cast("int")


def _plain(holidays: Column | None, weekend: Sequence[int]) -> bool:
    """Saturdays and Sundays only: then a count of days is arithmetic, without a list of them."""
    return holidays is None and tuple(weekend) == (5, 6)


def _days_after(start: Column, n: Column) -> Column:
    """Calendar days to the ``n``-th business day after the start; a weekend counts as its Friday."""
    back = F.greatest(F.weekday(start) - 4, F.lit(0))
    rest = n % 5
    over = F.when(F.least(F.weekday(start), F.lit(4)) + rest > 4, 2).otherwise(0)
    return (F.floor(n / 5) * 7 + rest + over - back).cast("int")


def _business_days_upto(day: Column) -> Column:
    """Business days from a Monday long ago through the day."""
    k = F.unix_date(day) + 3  # 1970-01-01 was a Thursday
    return F.floor(k / 7) * 5 + F.least(F.pmod(k, F.lit(7)) + 1, F.lit(5))


def advance_business_days(start: Column, n: Column, holidays: Column | None = None, weekend: Sequence[int] = WEEKEND) -> Column:
    """``n`` business days after the start, which doesn't count."""
    if _plain(holidays, weekend):
        return F.when(n <= 0, start).otherwise(F.date_add(start, _days_after(start, n)))
    days = _open_days(F.date_add(start, 1), F.date_add(start, _reach(n, holidays)), holidays, weekend)
    return F.when(n <= 0, start).otherwise(F.try_element_at(days, n.cast("int")))


def subtract_business_days(start: Column, n: Column, holidays: Column | None = None, weekend: Sequence[int] = WEEKEND) -> Column:
    if _plain(holidays, weekend):
        w = F.weekday(start)
        ahead, rest = F.when(w > 4, 7 - w).otherwise(0), n % 5
        over = F.when(F.when(w > 4, 0).otherwise(w) - rest < 0, 2).otherwise(0)
        return F.when(n <= 0, start).otherwise(F.date_sub(start, (F.floor(n / 5) * 7 + rest + over - ahead).cast("int")))
    days = _open_days(F.date_sub(start, _reach(n, holidays)), F.date_sub(start, F.lit(1)), holidays, weekend)
    return F.when(n <= 0, start).otherwise(F.try_element_at(days, (-n).cast("int")))


def business_days_between(start: Column, end: Column, holidays: Column | None = None, weekend: Sequence[int] = WEEKEND) -> Column:
    """Business days after the start up to the end, which counts."""
    if _plain(holidays, weekend):
        return F.when(start >= end, 0).otherwise(_business_days_upto(end) - _business_days_upto(start)).cast("int")
    return F.when(start >= end, 0).otherwise(F.size(_open_days(F.date_add(start, 1), end, holidays, weekend)))


def business_to_calendar(start: Column, n: Column, holidays: Column | None = None, weekend: Sequence[int] = WEEKEND) -> Column:
    """Calendar days until ``n`` business days are over, the start itself counting."""
    if _plain(holidays, weekend):
        return F.when(n <= 0, 0).otherwise(_days_after(F.date_sub(start, 1), n))
    days = _open_days(start, F.date_add(start, _reach(n, holidays)), holidays, weekend)
    return F.when(n <= 0, 0).otherwise(F.datediff(F.try_element_at(days, n.cast("int")), start) + 1)


def roll_forward(day: Column, holidays: Column | None = None, weekend: Sequence[int] = WEEKEND) -> Column:
    """The day itself or the next business day, and why it moved."""
    if _plain(holidays, weekend):
        shift = F.greatest(7 - F.weekday(day), F.lit(0))
        shift = F.when(F.weekday(day) > 4, shift).otherwise(0)
        return F.struct(F.date_add(day, shift).alias("day"), F.when(shift > 0, "shifted_to_avoid_weekend").alias("reason"))
    rolled = F.try_element_at(_open_days(day, F.date_add(day, _reach(F.lit(1), holidays)), holidays, weekend), F.lit(1))
    why = F.when(rolled == day, F.lit(None)).when(F.weekday(day).isin(*weekend), "shifted_to_avoid_weekend").otherwise("shifted_due_to_holiday")
    return F.struct(rolled.alias("day"), why.alias("reason"))


def latest_business_day(anchor: Column, low: int, high: int, holidays: Column | None = None, weekend: Sequence[int] = WEEKEND) -> Column:
    """The latest business day between two offsets from the anchor; if there is none, the first one after them."""
    inside = _open_days(F.date_add(anchor, low), F.date_add(anchor, high), holidays, weekend)
    return F.coalesce(F.try_element_at(inside, F.lit(-1)), roll_forward(F.date_add(anchor, high), holidays, weekend)["day"])


def next_weekday(moment: Column, target: int, zone: str) -> Column:
    """The next date, today included, on a weekday (Monday is 0) in a time zone."""
    day = F.to_date(F.from_utc_timestamp(moment, zone))
    return F.date_add(day, F.pmod(F.lit(target) - F.weekday(day), F.lit(7)).cast("int"))


#: What stands for no date.
NO_DATE = ("--", "-", "N/A", "NA")


def registry_date(raw: Column) -> Column:
    """An ISO date of a registry value and whether its day was made up: struct of value and derived.

    Whole dates first, then a month and year, then a year; digits that are none of them give null and
    other texts stay as they are.
    """
    text = F.trim(raw)
    part = lambda k: F.regexp_extract(text, r"^(\d{1,2})[.\-/\s](\d{4})$", k)
    month = F.date_format(F.try_to_date(F.concat_ws("-", part(2), F.lpad(part(1), 2, "0"), F.lit("01")), "yyyy-MM-dd"), "yyyy-MM-dd")
    year = F.concat(text, F.lit("-01-01"))
    is_month, is_year = text.rlike(r"^\d{1,2}[.\-/\s]\d{4}$"), text.rlike(r"^\d{4}$")
    whole = found_date_text(text)
    value = F.when(whole.isNotNull(), whole).when(is_month, month).when(is_year, year).when(~text.rlike(r"^[\d\s./-]+$"), text)
    given = raw.isNotNull() & (text != "") & ~F.upper(text).isin(*NO_DATE)
    made_up = whole.isNull() & ((is_month & month.isNotNull()) | is_year)
    return F.struct(F.when(given, value).alias("value"), F.coalesce(given & made_up, F.lit(False)).alias("derived"))
