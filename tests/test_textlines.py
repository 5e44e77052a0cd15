"""Numbers, statuses and histories of report lines, first known values and summaries, by cases."""

import pytest
from pyspark.sql import functions as F

from ledgermend.operators import layout, textlines
from ledgermend.plans import textlines as plans


def lines_of(spark, *blocks):
    return spark.createDataFrame([(b, k, t) for b, own in enumerate(blocks) for k, t in enumerate(own)], "b int, position int, text string")


def test_account_numbers(spark):
    made = lines_of(
        spark, ["BANK", "TransUnion® Experian Equifax", "Account #:  1-23*  t disputed  45 6", "Experian", "Account No. 77 8", "Equifax Acct # 9*9", "other"],
        ["Account Number: 5  6", "Trans Union Account # none", "Acct #: 12", "see Account # 99", None], ["nothing"],
    )
    got = sorted(map(tuple, textlines.account_numbers(made, ["b"]).collect()))
    assert got == [(0, "equifax", "9*9"), (0, "experian", "778"), (0, "transunion", "123*"), (1, "transunion", "12")]


def test_payment_statuses(spark):
    made = lines_of(spark, ["H", "TransUnion  Equifax  Experian", "Payment Status:  Current   Late  30  ", "Experian Payment Status: Paid  Off"], ["Payment Status: a  b"])
    order = made.withColumn("names", layout.bureau_order(F.col("text"))).where("names is not null").groupBy("b").agg(F.min_by("names", "position").alias("names"))
    got = sorted(map(tuple, textlines.payment_statuses(made, ["b"], order).collect()))
    assert got == [(0, "equifax", "late"), (0, "experian", "paid off"), (0, "transunion", "current")]


def test_histories_by_lines(spark):
    made = lines_of(
        spark, ["x", "Two-Year Payment History", "junk", "TransUnion ok  ok", "30 60", "Experian", "co", "TransUnion 90", "Days Late -7 Year History", "Experian 1 30:1 60:2 90:3", "Equifax", "30:9 60:9 90:9", "experian 30:5 60:5 90:5"],
        ["Two-Year Payment History", "TransUnion ok"],
    )
    assert sorted(map(tuple, textlines.two_year_texts(made, ["b"]).collect())) == [(0, "experian", "co"), (0, "transunion", "90")]
    assert sorted(map(tuple, textlines.seven_year_totals(made, ["b"]).collect())) == [(0, "experian", 6)]


@pytest.mark.parametrize(("values", "preferred", "want"), [(("--", "5", "6"), (), ("5", "b")), (("1", "", "6"), ("c", "b"), ("6", "c")), ((None, "", "--"), ("a",), (None, None)), (("1", "2", "3"), ("x",), ("1", "a"))])
def test_first_known(spark, values, preferred, want):
    row = spark.createDataFrame([values], "a string, b string, c string").select(textlines.first_known({c: F.col(c) for c in "abc"}, preferred).alias("x")).first()
    assert tuple(row.x) == want


def test_source_summary(spark):
    rows = [(1, "b", "f", "x"), (1, "a", "f", "y"), (1, "c", "f", "x "), (1, "a", "g", "1"), (1, "b", "g", "2"), (1, "a", "h", ""), (1, "b", "h", None), (2, "a", "f", "z"), (2, "a", "f", "z")]
    got = {(r.k, r.field): (list(r.by_source.items()), r.majority, r.disagrees) for r in textlines.source_summary(spark.createDataFrame(rows, "k int, source string, field string, value string"), ["k"]).collect()}
    assert got == {(1, "f"): ([("a", "y"), ("b", "x"), ("c", "x")], "x", True), (1, "g"): ([("a", "1"), ("b", "2")], "1", True), (2, "f"): ([("a", "z")], "z", False)}


def test_tasks_grow_in_number_not_in_orders(spark, tmp_path, monkeypatch):
    orders = spark.range(2_000).select(F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(plans, "ORDERS", 100)
    orders.createOrReplaceTempView("orders")
    made = plans.report_lines(spark, str(tmp_path))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, spark.sql(plans.LINES_SQL).collect()))
    held = [r.n for r in plans.line_numbers(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count_distinct("k").alias("n")).collect()]
    lines = [r.n for r in made.groupBy(F.spark_partition_id()).agg(F.count_distinct("k").alias("n")).collect()]
    assert len(lines) == 20 and max(lines) < 200 and sum(held) > 0
