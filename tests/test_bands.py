"""Amounts of one key that are close: every pair, of the query too."""

import random

import duckdb
import pytest

from ledgermend.operators import matching


@pytest.mark.parametrize(("rows", "piece"), [(3, 2), (4096, 64)])
def test_every_close_pair_of_two_tables_is_found(spark, monkeypatch, rows, piece):
    monkeypatch.setattr(matching, "BAND_ROWS", rows)
    monkeypatch.setattr(matching, "BAND_SLICE", piece)
    rng = random.Random(7)
    edge = [0.0, -0.0, 5.0, 10.0, 500.0, 505.0, 510.05, None, float("nan"), float("inf"), float("-inf")]
    sides = [[(rng.choice("kk2"), 100 * s + i, rng.choice([*edge, rng.uniform(-900, 900)])) for i in range(90)] + [(None, 100 * s + 90, 5.0)] for s in (0, 1)]
    left, right = (spark.createDataFrame(side, f"key string, {k} int, {v} double") for side, k, v in zip(sides, "ij", "xy"))
    got = matching.band_join(left, right, ["key"], "x", "y", 5.0, 0.01)
    assert got.columns == ["key", "i", "x", "j", "y"]
    close = lambda x, y: (x != x and y != y) or abs(x - y) <= max(5.0, 0.01 * min(abs(x), abs(y)))
    want = {(p[0], p[1], q[1]) for p in sides[0] for q in sides[1] if p[0] and p[0] == q[0] and p[2] is not None and q[2] is not None and close(p[2], q[2])}
    found = [(r.key, r.i, r.j) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 50


def test_the_query_gives_every_pair(spark, tmp_path):
    """A row a pair, not a row a part with a number of links."""
    import __spark_entry__ as entry

    rng = random.Random(9)
    rows = [(i, rng.choice((1, 2)), rng.choice((7.5, 12.5, 900.0, round(rng.uniform(880, 1000), 1), float("nan"), float("inf"), float("-inf")))) for i in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = entry.queries()["band_join"](spark, str(tmp_path))
    assert got.columns == ["left_key", "right_key"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["band_join"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 1000
