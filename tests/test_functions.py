"""Row-level cases of the normalisers, taken from the semantics each consumer relies on."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgermend.functions import dates, histories, money, predicates, text


def values(spark, inputs, fn):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r["x"] for r in rows.select("k", fn(F.col("v")).alias("x")).orderBy("k").collect()]


def test_missing_differs_by_consumer(spark):
    raw = [None, "", "--", " -- ", "n/a", "x"]
    assert values(spark, raw, predicates.missing_exact) == [True, True, True, False, False, False]
    assert values(spark, raw, predicates.missing_trimmed) == [True, True, True, True, False, False]
    assert values(spark, raw, lambda c: predicates.missing_placeholder(c, ["--", "n/a"])) == [True, True, True, True, True, False]


def test_brackets_negate_except_for_rules(spark):
    raw = ["(1,234)", "$7,520", "1/2", "-5.555", "--", "abc", None]
    assert values(spark, raw, money.match_amount) == [-1234.0, 7520.0, 12.0, -5.555, None, None, None]
    assert values(spark, raw, money.field_amount) == [-1234.0, 7520.0, 1.0, -5.555, None, None, None]
    assert values(spark, raw[:3], money.rule_amount) == [1234.0, 7520.0, 12.0]
    assert values(spark, ["(12)", "$1", "--", "x"], money.polarity_amount) == [-12.0, 1.0, None, None]
    assert values(spark, ["1.005", "(2.345)", "0.5"], money.match_cents) == [101, -235, 50]


def test_terms_round_half_to_even(spark):
    assert values(spark, ["5 years", "2.5", "3.5", "60 months", "1 yr", "--"], money.term_months) == [60, 2, 4, 60, 12, None]


def test_severity(spark):
    assert values(spark, ["OK", "30", "180", "CO", "150", "--", "x", None], money.severity) == [0, 30, 999, 999, 150, None, None, None]


def test_dates_of_matching(spark):
    d = dt.date
    raw = ["2024-01-08", "1/8/2024", "16.8.2022", "25/12/2023", "12/25/23", "20240108", "2024/1.8", "2024-13-45", "2011-01-08T10:00", "--"]
    assert values(spark, raw, dates.match_date) == [d(2024, 1, 8), d(2024, 1, 8), d(2022, 8, 16), d(2023, 12, 25), d(2023, 12, 25), d(2024, 1, 8), d(2024, 1, 8), None, d(2011, 1, 8), None]


def test_dates_of_consensus(spark):
    d = dt.date
    raw = ["2024-01-08", "16.8.2022", "1/8/2024", "1/8/49", "1/8/50", "Jan 5, 2023", "junk"]
    assert values(spark, raw, dates.field_date) == [d(2024, 1, 8), d(2022, 8, 16), d(2024, 1, 8), d(2049, 1, 8), d(1950, 1, 8), d(2023, 1, 5), None]
    assert values(spark, ["1/8/2024"], lambda c: dates.field_date(c, True)) == [d(2024, 8, 1)]


def test_found_dates_are_not_checked_until_parsed(spark):
    raw = ["seen 2024-13-45 there", "on 5.6.2020", "6/5/2020", "none"]
    assert values(spark, raw, dates.found_date_text) == ["2024-13-45", "2020-06-05", "2020-06-05", None]
    assert values(spark, raw, dates.found_date) == [None, dt.date(2020, 6, 5), dt.date(2020, 6, 5), None]


def test_business_days(spark):
    friday = F.lit("2024-03-01").cast("date")
    none, some = None, F.array(F.lit("2024-03-04").cast("date"))
    row = spark.range(1).select(
        dates.advance_business_days(friday, F.lit(1)).alias("a"), dates.advance_business_days(friday, F.lit(1), some).alias("b"), dates.subtract_business_days(friday, F.lit(5)).alias("c"),
        dates.business_to_calendar(friday, F.lit(2)).alias("d"), dates.business_days_between(friday, F.lit("2024-03-08").cast("date")).alias("e"), dates.roll_forward(F.lit("2024-03-02").cast("date"), none).alias("f"),
        dates.advance_business_days(friday, F.lit(0)).alias("g"), dates.first_forbidden_month(F.lit("2023-12-31").cast("date")).alias("h"), dates.latest_business_day(friday, 0, 2).alias("i"),
    ).first()
    assert (row.a, row.b, row.c) == (dt.date(2024, 3, 4), dt.date(2024, 3, 5), dt.date(2024, 2, 23))
    assert (row.d, row.e, row.f.day, row.f.reason) == (4, 5, dt.date(2024, 3, 4), "shifted_to_avoid_weekend")
    assert (row.g, row.h, row.i) == (dt.date(2024, 3, 1), "2024-01", dt.date(2024, 3, 1))


def test_redaction_order(spark):
    raw = ["mail a.b@c.org now", "call 555-123-4567", "ssn 123-45-6789", "SSN: 6789", "card 1234 5678 9012 3456", "123456789", None]
    assert values(spark, raw, text.redacted) == ["mail [REDACTED] now", "call [REDACTED]", "ssn ***-**-6789", "SSN: ***-**-6789", "card ****3456", "***-**-6789", ""]


@pytest.mark.parametrize("name,want", [("J.P. Morgan", "JP MORGAN"), ("a b c bank", "ABC BANK"), ("US-Bank/NA", "US BANK NA"), ("", "")])
def test_issuer(spark, name, want):
    assert values(spark, [name], text.issuer) == [want]


def test_keys_and_numbers(spark):
    row = spark.range(1).select(
        text.logical_key(F.lit("Chase"), F.lit("1234"), F.lit("card"), F.lit("2020-01-01")).alias("a"), text.logical_key(F.lit(None), F.lit(""), F.lit("card"), F.lit(None)).alias("b"),
        text.visible_match(F.lit("****1234"), F.lit("99-1234-5")).alias("c"), text.visible_match(F.lit("x"), F.lit("1")).alias("d"), text.strict_level(F.lit("12-34"), F.lit("1234")).alias("e"),
        text.strict_level(F.lit("1234"), F.lit("9999")).alias("f"), text.strict_level(F.lit("AB1"), F.lit("CD1")).alias("g"), text.number_display(F.lit("XXXX-1234")).alias("h"),
    ).first()
    assert row.b is None and len(row.a) == 16 and row.c and not row.d
    assert (row.e, row.f, row.g) == ("match", "digit_conflict", "alnum_conflict")
    assert (row.h.last4, row.h.mask_class) == ("1234", "masked_last4")


def test_enum_and_frequency(spark):
    domain = {"paidclosed": "closed", "open": "open"}
    assert values(spark, ["Paid / Closed", "OPEN", "some  thing", "--"], lambda c: text.enum_value(c, domain)) == ["closed", "open", "some thing", None]
    assert values(spark, ["Every Month", "bi-weekly", "two weeks", "per 3 quarters", "odd"], text.payment_frequency) == ["monthly", "biweekly", "biweekly", "quarterly", "odd"]
    assert values(spark, ["CreditCard", "Bank-Credit_Card", "auto.loan"], lambda c: text.account_type(c, {})) == ["credit card", "credit card", "auto loan"]


def test_histories(spark):
    row = spark.range(1).select(
        histories.aligned_similarity(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "xcd"))).alias("a"),
        histories.counter_similarity([F.lit(1), F.lit(2)], [F.lit(1), F.lit(0)]).alias("b"), histories.counter_similarity([F.lit(0)], [F.lit(0)]).alias("c"),
        histories.month_status(F.array(*[F.struct(F.lit(m).alias("month_year_key"), F.lit(s).alias("status")) for m, s in (("2024-01", "--"), ("2024-01", "30"), ("2024-02", "60"), ("2024-02", "ok"))])).alias("d"),
    ).first()
    assert row.a == pytest.approx(2 / 3) and row.b == pytest.approx(0.5) and row.c == 1.0
    assert [(m.month_year_key, m.status) for m in row.d] == [("2024-01", "30"), ("2024-02", "ok")]


def test_canary_bucket_is_stable(spark):
    import hashlib

    ids = ["a", "acct-7", "12"]
    assert values(spark, ids, predicates.hash_bucket) == [int(hashlib.sha256(i.encode()).hexdigest()[:8], 16) % 100 for i in ids]
