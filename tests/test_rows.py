"""Open rows: how often lines are read, and values put together."""

from pyspark.sql import functions as F

from ledgermend.operators import statements as st


def test_known_positions_spare_a_pass_over_the_lines(spark):
    """Lines that can't be computed do no harm until rows are read, and values aren't folded by interpreted steps."""
    lines = spark.range(1).select(F.lit(1).alias("doc"), F.raise_error(F.lit("read")).cast("long").alias("position"), F.lit("x").alias("text"))
    rows = st.triad_rows(lines, ["doc"], longest=9)
    assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_fragments_follow_the_last_source_with_text(spark):
    texts = ["Account # 1 2 3", "Late: 1 -- 2", "more", "again", "-- -- --", "$4 -- --", "onward", "Type: --", "word", "Sum: -- $5 --", "and\u00a0so", "Gap: a  b\tc  d®", "— – x", "Empty:", "--", "tail"]
    made = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc int, position int, text string")
    got = sorted(tuple(r)[2:4] + tuple(r)[4:] for r in st.triad_rows(made, ["doc"], longest=len(texts)).collect())
    assert got == sorted(tuple(r)[2:] for r in st.triad_rows(made, ["doc"]).collect()) and {r[0]: r[2:] for r in got}["Late"] == ("1 $4 onward", "2 more again", "--")


def test_lines_lie_by_document(spark):
    """Orders are dealt before they become lines, which aren't shuffled for what is done by document."""
    import __spark_entry__ as entry
    from ledgermend.plans import statements

    plan = statements.report_lines(spark, entry.SMOKE_DIR).groupBy("doc").agg(F.max("position"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
