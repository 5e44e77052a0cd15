"""Operators on small tables whose results are known."""

import datetime as dt
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgermend.functions.money import close_for_consensus
from ledgermend.operators import analytics, consensus, findings, matching, outcomes, planning, rules, sequence
from ledgermend.streaming import accounts


def agreed(spark, triples, match, kind="double"):
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(triples)], f"k int, a {kind}, b {kind}, c {kind}")
    vs = [F.col(x) for x in "abc"]
    got = rows.select("k", consensus.consensus(vs, [v.isNull() for v in vs], match, ("a", "b", "c")).alias("x")).orderBy("k").collect()
    return [(r.x.consensus, list(r.x.disagreeing), list(r.x.missing)) if r.x else None for r in got]


def test_consensus_is_greedy_and_ordered(spark):
    got = agreed(spark, [(100.0, 140.0, 180.0), (140.0, 100.0, 180.0), (1.0, None, 1.0), (1.0, 500.0, 900.0), (None, None, None), (None, None, 7.0)], close_for_consensus)
    assert got[0] == ("majority", ["c"], [])  # 180 is near 140 but not near the group's first, 100
    assert got[1] == ("unanimous", [], [])
    assert got[2] == ("majority", ["b"], ["b"])  # missing is a group
    assert got[3] == ("split", ["a", "b", "c"], [])
    assert got[4] is None
    assert got[5] == ("majority", ["c"], ["a", "b"])


def test_reasons(spark):
    rows = spark.createDataFrame([("x", "x", None), ("x", "y", None), ("x", None, None), ("x", "x", "y"), ("x", "y", "z"), (None, None, None)], "a string, b string, c string")
    vs = [F.col(x) for x in "abc"]
    got = [r.x[:2] for r in rows.select(consensus.reason(vs, [v.isNull() for v in vs])["reason_code"].alias("x")).collect()]
    assert got == ["C1", "C3", "C2", "C4", "C5", "C6"]


def test_plans_take_one_finding_of_a_field_in_any_order(spark):
    ties = [("a", "f", 3, 10, False), ("a", "f", 3, 10, True), ("a", "f", 2, 40, True)]
    kind = "account string, field string, strength int, min_days int, business boolean"
    got = [planning.plans(spark.createDataFrame(rows, kind).coalesce(1)).collect() for rows in (ties, ties[::-1])]
    assert got[0] == got[1] == planning.plans(spark.createDataFrame(ties[1:2], kind)).collect()


def test_history_tokens_gathers_no_user(spark, tmp_path):
    from ledgermend.plans import scalars

    kinds = ["error", "click", "view", "purchase", "signup", "error", None]
    spark.createDataFrame([(k % 2, x) for k, x in enumerate(kinds)], "user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    found = scalars.history_tokens(spark, str(tmp_path))
    assert "collect_list" not in found._jdf.queryExecution().toString()
    assert {tuple(r) for r in found.collect()} == {(0, 4, 1, 0, 0, 2), (1, 3, 1, 1, 1, 0)}


def test_two_percentiles_differ(spark):
    ten = spark.range(1, 11).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    assert sequence.floor_rank(ten, ["g"], "v", 95, "p").first().p == 9.0
    assert ten.agg(F.expr("percentile_disc(0.95) within group (order by v)").alias("p")).first().p == 10.0
    assert spark.range(1).select(sequence.floor_percentile(F.array().cast("array<double>"), 95).alias("p")).first().p == 0.0


def test_year_attribution(spark):
    months = [(0, 9, None), (1, 10, None), (2, 11, None), (3, 12, None), (4, 1, 2025), (5, 2, None), (6, 3, None)]
    rows = spark.createDataFrame([("d", *m) for m in months], "doc string, pos int, mon int, anchor int")
    got = [r.month_year_key for r in sequence.carry_years(rows, ["doc"], "pos", "mon", "anchor").orderBy("pos").collect()]
    assert got == ["2024-09", "2024-10", "2024-11", "2024-12", "2025-01", "2025-02", "2025-03"]


def test_clusters(spark):
    row = spark.range(1).select(sequence.clusters_from_anchor(F.array(*[F.lit(x) for x in (0.0, 2.0, 4.0, 4.5)]), 2.5).alias("a"), sequence.clusters_from_mean(F.array(*[F.lit(x) for x in (0.0, 2.0, 3.2, 9.0)]), 2.5).alias("b")).first()
    assert list(row.a) == [1, 1, 2, 2] and list(row.b) == [1, 1, 1, 2]


def test_band_join_equals_nested_loop(spark):
    import random

    rng = random.Random(3)
    a = [(i, "k", rng.choice([-1, 1]) * 10 ** rng.uniform(0, 5)) for i in range(120)]
    df = spark.createDataFrame(a, "id int, key string, v double")
    got = matching.band_join(df.select(F.col("id").alias("i"), "key", F.col("v").alias("x")), df.select(F.col("id").alias("j"), "key", F.col("v").alias("y")), ["key"], "x", "y", 20.0, 0.05).where("i < j").select("i", "j").collect()
    want = {(p[0], q[0]) for p, q in combinations(a, 2) if abs(p[2] - q[2]) <= max(20.0, 0.05 * min(abs(p[2]), abs(q[2])))}
    assert {tuple(r) for r in got} == want


def test_band_links_count_every_pair_of_the_band_join(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice("kk2"), rng.choice([-1, 1]) * round(10 ** rng.uniform(0, 4), rng.choice([0, 2]))) for i in range(300)]
    rows += [(300 + i, "k", v) for i, v in enumerate([20.0, 40.0, 60.0, 0.0, -0.0, None, float("nan"), float("inf"), float("inf")])] + [(400 + i, "c", 7.5) for i in range(3000)] + [(5000, None, 7.5)]
    got = {r.id: (r.class_id, r.links) for r in matching.band_links(spark.createDataFrame(rows, "id long, key string, v double"), ["key"], "id", "v", 20.0, 0.05).collect()}
    real = [r for r in rows if r[1] and r[1] != "c" and r[2] is not None and abs(r[2]) < float("inf")]
    close = lambda p, q: p[1] == q[1] and abs(p[2] - q[2]) <= max(20.0, 0.05 * min(abs(p[2]), abs(q[2])))
    assert {p[0]: got[p[0]] for p in real} == {p[0]: (min(q[0] for q in real if q[1:] == p[1:]), sum(close(p, q) for q in real) - 1) for p in real}
    assert all(got[k] == (k, 0) for k in (305, 306, 5000)) and got[308] == (307, 0) and len(got) == len(rows)
    assert all(got[400 + i] == (400, 2999) for i in range(3000))


def test_families_of_one_number_stay_apart(spark, tmp_path):
    """Two identities whose first ten hex digits agree are two families, in SQL too."""
    import datetime

    import duckdb

    import __spark_entry__ as entry

    day = datetime.datetime(1995, 1, 1)
    rows = [(1, 1, part, supplier, "N" if flag is None else flag, status, 5.0, day) for part, supplier, flag in ((80778, 4414, "R"), (104923, 5568, "R"), (7, 7, None)) for status in "FO"]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double, l_shipdate timestamp")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(r) for r in entry.queries()["families"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert [r[0] for r in got].count("282bd15b7e") == 2 and len(got) == 3
    assert sorted(con.sql(entry.oracle_sql()["families"]).fetchall()) == got


def test_first_snapshot_gives_no_events(spark):
    old = spark.createDataFrame([("a", "f1", 1), ("a", "f2", 1), ("a", "f3", 1)], "account string, family string, n int")
    new = spark.createDataFrame([("a", "f1", 1), ("a", "f2", 2), ("a", "f4", 1), ("b", "f9", 1)], "account string, family string, n int")
    got = {r.family: r.outcome for r in outcomes.snapshot_diff(old, new, "account", "family", "n").collect()}
    assert got == {"f1": "Verified", "f2": "Updated", "f3": "Deleted", "f4": "NoChange"}


def history(*months):
    return F.array(*[F.struct(F.lit(m).alias("month_year_key"), F.lit(s).alias("status")) for m, s in months])


@pytest.mark.parametrize("months,status", [
    ([("2024-01", "ok"), ("2024-02", "30"), ("2024-03", "60")], "ok"), ([("2024-01", "60"), ("2024-02", "--"), ("2024-03", "30")], "conflict"),
    ([("2024-02", "60"), ("2024-03", "30")], "skipped_missing_data"), ([("2024-01", "??"), ("2024-02", "90"), ("2024-03", "OK")], "conflict"),
])
def test_monotone_after_payment(spark, months, status):
    day = F.lit(dt.date(2024, 1, 15))
    assert spark.range(1).select(rules.payment_monotone(day, history(*months)).alias("r")).first().r.status == status


def test_branch_rules(spark):
    d = {k: F.lit(v).cast("date") for k, v in {"date_opened": "2020-01-01", "date_reported": "2024-01-01", "last_verified": None, "last_payment": "2024-02-01", "closed_date": "2023-06-30"}.items()}
    h = history(("2019-12", "ok"), ("2023-07", "ok"), ("2023-08", "--"))
    row = spark.range(1).select(
        rules.time_ceiling(d).alias("a"), rules.opening_floor(d).alias("b"), rules.monthly_ceiling(d, h).alias("c"), rules.monthly_floor(d, h).alias("d"),
        rules.post_closure_activity(F.lit(2), d["closed_date"], [("last_payment", d["last_payment"])]).alias("e"), rules.post_closure_ok(F.lit(2), d["closed_date"], h).alias("f"),
        rules.seven_against_two({"late30": F.lit(0), "late60": F.lit(0), "late90": F.lit(0)}, history(("2024-01", "30"))).alias("g"), rules.month_coverage(d["closed_date"], history(("2023-01", "ok"))).alias("h"),
        rules.problem(F.lit(0.0), F.lit(0), F.lit("account current"), F.lit(""), F.lit(0.0)).alias("i"),
    ).first()
    assert (row.a.status, list(row.a.violations)) == ("conflict", ["last_payment"])
    assert (row.b.status, row.c.status, row.d.status, list(row.d.violations)) == ("ok", "ok", "conflict", ["2019-12"])
    assert (row.e.status, row.e.violating_field, row.f.status, list(row.f.months)) == ("conflict", "last_payment", "conflict", ["2023-07"])
    assert (row.g.status, row.h.status, row.i.primary_issue) == ("conflict", "conflict", "charge_off")  # any "co" counts


def test_account_state_and_route(spark):
    rows = spark.createDataFrame([("Open", "late 30"), ("Open", "Closed"), ("--", ""), ("pending", "--")], "s string, p string")
    got = [(r.q.status, r.q.declared_state, r.q.confidence, r.r.state_num) for r in rows.select(rules.account_state({"s": F.col("s"), "p": F.col("p")}, ["--"]).alias("q")).withColumn("r", rules.route(F.col("q.declared_state"))).collect()]
    assert got == [("ok", "open", 0.5, 1), ("conflict", "conflict", 0.0, 4), ("skipped_missing_data", "unknown", 0.0, 3), ("ok", "unknown", 0.0, 3)]


def test_counters_and_guardrails(spark):
    rows = spark.createDataFrame([("x", 2.0, None), ("x", None, {"bureau": "TU", "noise": "1"})], "name string, increment double, details map<string,string>")
    assert {r.name: r.value for r in analytics.counters(rows).collect()} == {"x": 3.0, "x.bureau.TU": 1.0}
    counts = spark.createDataFrame([("router.finalized.t", 100.0), ("validation.failed.t", 1.0), ("router.finalized.u", 100.0)], "name string, value double")
    assert {r.template: r.breached for r in analytics.guardrails(counts, 250.0, 0.5).collect()} == {"t": True, "u": False}


def test_gap_combinations(spark):
    got = spark.range(1).select(findings.gaps(3, 1, 2).alias("g")).first().g
    assert [list(x) for x in got] == [[1, 1], [1, 2], [2, 1], [2, 2]]


def test_lists_and_maps_merge(spark):
    row = spark.range(1).select(
        outcomes.merged_list(F.array(*map(F.lit, (1, 1, 2))), F.array(*map(F.lit, (2, 3)))).alias("a"), outcomes.merged_map(F.create_map(F.lit("k"), F.lit("v")), F.create_map(F.lit("k"), F.lit(""), F.lit("n"), F.lit("w"))).alias("b"),
    ).first()
    assert list(row.a) == [1, 1, 2, 3] and row.b == {"k": "v", "n": "w"}


def test_stream_equals_batch(spark, tmp_path):
    from ledgermend.plans.timeline import final_states

    rows = [("a", 1, "send", dt.datetime(2024, 1, 1)), ("a", 2, "send", dt.datetime(2024, 3, 1)), ("a", 3, "verified", dt.datetime(2024, 3, 5)), ("b", 4, "updated", dt.datetime(2024, 1, 2)), ("b", 5, "send", dt.datetime(2024, 1, 3))]
    schema = "account_id string, seq long, event string, at timestamp"
    table = spark.createDataFrame(rows, schema)
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = accounts.follow(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    last = {r.account_id: r for r in spark.read.parquet(str(tmp_path / "out")).groupBy("account_id").agg(F.max_by(F.struct("status", "step", "last_sent", "violations"), "seq").alias("s")).select("account_id", "s.*").collect()}
    for r in final_states(table).collect():
        s = last[r.account_id]
        assert (s.status, s.step, s.last_sent, s.violations) == (r.status, r.step, r.last_sent, r.violations)
