"""Tables of three sources: odd blocks, and how often tokens are moved."""

from ledgermend.operators import tables

TOKENS = "k long, line int, text string, x0 double, x1 double, y0 double, y1 double"
LABELS = {"status": "status", "high balance": "high"}


def head(k, *xs):
    return [(k, 0, name, x, x + 20.0, 0.0, 4.0) for name, x in zip(("TransUnion", "Experian", "Equifax"), xs)]


def test_odd_blocks(spark):
    label = lambda k, line=1, y=10.0: (k, line, "Status:", 0.0, 9.0, y, y + 4.0)
    rows = [*head(1, 100.0, 300.0), label(1), (1, 5, "a", 110.0, 112.0, 10.0, 14.0), (1, 2, "-", 310.0, 311.0, 11.0, 15.0), (1, 3, "–", 309.0, 310.0, 17.0, 21.0), (1, 4, None, 110.0, 111.0, 10.0, 14.0)]
    rows += [*head(2, 100.0), label(2), (2, 5, "one source has no column", 110.0, 112.0, 10.0, 14.0)]
    rows += [*head(3, 100.0, 300.0), (3, 1, "Status", 0.0, 9.0, None, None), (3, 2, "x", 110.0, 112.0, 10.0, 14.0)]
    rows += [*head(None, 100.0, 300.0), label(None), (None, 5, "a null key meets nothing", 110.0, 112.0, 10.0, 14.0)]
    rows += [*head(4, 100.0, 300.0), (4, 1, "x", 110.0, 112.0, 10.0, 14.0), *head(5, 100.0, 300.0, 300.0), label(5), label(5, 2, 40.0), (5, 3, "far", 110.0, 112.0, 41.0, 45.0), (5, 4, "near", 110.0, 112.0, 12.0, 16.0)]
    got = {r.k: (r.field, r.transunion, r.experian, r.equifax) for r in tables.source_table(spark.createDataFrame(rows, TOKENS), ["k"], LABELS).collect()}
    assert got == {1: ("status", "a", "- –", ""), 2: ("status", "", "", ""), 3: ("status", "", "", ""), None: ("status", "", "", ""), 5: ("status", "near", "", "")}


def test_tokens_dealt_by_block_are_not_moved_again(spark):
    """Tokens are read once, and neither they nor what is made of them are shuffled or written."""
    made = spark.createDataFrame([*head(1, 100.0, 300.0), (1, 1, "Status", 0.0, 9.0, 10.0, 14.0)], TOKENS).repartition(3, "k")
    plan = tables.source_table(made, ["k"], LABELS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan") == 1


def test_orders_and_their_lines_are_moved_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["source_tables"](spark, entry.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 == plan.count("REPARTITION_BY_NUM")
