from pyspark.sql import functions as F

from ledgermend.operators import picks


def test_picks(spark):
    row = spark.range(1).select(
        picks.top_parts(F.create_map(F.lit("b"), F.lit(3), F.lit("a"), F.lit(3), F.lit("z"), F.lit(0), F.lit("c"), F.lit(5)), 2).alias("a"),
        picks.deduped(F.array(F.lit(" x "), F.lit("x"), F.lit(""), F.lit(None), F.lit("y" * 300))).alias("b"), picks.primary_issue(F.array(F.lit("late")), ("charge_off", "late")).alias("c"),
        picks.calendar_span(F.array(F.lit(5), F.lit(2)), 0).alias("d"), picks.calendar_span(F.array().cast("array<int>"), 0).alias("e"),
    ).first()
    assert list(row.a) == ["c=5", "a=3"] and list(row.b) == ["x", "y" * 200] and row.c == "late"
    assert (row.d, row.e) == (9, 0)  # five days lead to Saturday, the second wait starts on Monday
