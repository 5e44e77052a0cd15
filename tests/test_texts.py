"""Layout, page texts, repairs and schedules."""

import difflib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgermend.functions import pages, text
from ledgermend.operators import consensus, layout, sequence, similarity
from ledgermend.sources import records


def test_page_text(spark):
    raw = ["Ｐaid  $1,200.50 on 01/02/2024‎, 2024-13-45\x07 or 31-12-2023", None, "x1,2 5 2024-2-30 é 1/2/99", "²  $ -3.10€4"]
    df = spark.createDataFrame(list(enumerate(raw)), "k int, t string")
    got = [tuple(r.p) for r in df.select("k", pages.normalized_page(F.col("t")).alias("p")).orderBy("k").collect()]
    # A number takes the comma after it and the space before it along, unless a letter stands there.
    assert got[0] == ("Paid 1200.50 on 2024-01-022024-13-45 or 2023-12-31", 2, 3, 1, 1)
    assert got[1] == ("", 0, 0, 0, 0)
    assert got[2] == ("x1,2 5 2024-2-30 é 1/2/99", 0, 0, 0, 0)
    assert got[3] == ("2 -3.10€4", 0, 1, 0, 1)


def test_lenient_json(spark):
    cases = {
        '{"a": 1,}': '{"a":1}', "{'a': 'it is', b: 2}": '{"a":"it is","b":2}', '{"a": 1\n "b": 2}': '{"a":1,"b":2}', "[1,, 2]": "[1,2]", "7": "7", '"it\'s"': '"it\'s"', "nothing": None, "{": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: tuple(r.j) for r in df.select("t", pages.lenient_json(F.col("t")).alias("j")).collect()}
    assert got == {k: (v or "{}", None if v else "invalid_json") for k, v in cases.items()}


words = st.text("abc ", max_size=9)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(words, words), min_size=30, max_size=30))
def test_ratio_equals_difflib(spark, found):
    rows = [(k, a, b) for k, (a, b) in enumerate([*found, ("kitten", "sitting"), ("", ""), ("abc", ""), (None, "x")])]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = {r.k: r.ratio for r in similarity.ratio(df, "k", "a", "b").collect()}
    for k, a, b in rows:
        assert got[k] == pytest.approx(0.0 if a is None else difflib.SequenceMatcher(None, a, b).ratio())


def test_closest_choice(spark):
    names = spark.createDataFrame([(1, "abc"), (1, "zzz"), (2, "abc")], "s int, n string")
    choices = spark.createDataFrame([(1, "abd"), (1, "abc"), (1, "abe"), (2, "xyz")], "s int, c string")
    assert [tuple(r) for r in similarity.closest(names, choices, "s", "n", "c", 0.6).collect()] == [(1, "abc", "abc", 1.0)]


def test_layout(spark):
    tokens = spark.createDataFrame([(1, 3, "TransUnion", 100.0, 150.0), (1, 3, "Experian", 200.0, 240.0), (1, 3, "Equifax", 300.0, 330.0), (1, 9, "TransUnion", 1.0, 2.0)], "page int, line int, text string, x0 double, x1 double")
    head = layout.column_edges(layout.triad_headers(tokens)).first()
    assert (head.line, head.transunion, head.edge_2, head.edge_1) == (3, 125.0, 172.5, 77.5)
    row = spark.range(1).select(
        layout.bureau_order(F.lit("Experian TransUnion Equifax")).alias("a"), layout.bureau_order(F.lit("Experian only")).alias("b"), layout.late_counts(F.lit("30: 2 60:1 90: 13 30-5")).alias("c"),
        layout.zipped(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "xy"))).alias("d"), layout.zipped(F.array(F.lit("a")), F.array(*map(F.lit, "xy"))).alias("e"),
        layout.inquiries(F.lit("x\nInquiries\nCreditor Name  Date of Inquiry Credit Bureau\nACME BANK 01/02/2024 Trans Union\nnope\nCreditor Contacts\nB 1/1/24 EQ")).alias("f"),
        layout.inquiries(F.lit("ACME\nBANK 01/2024\nExperian; Other Co 2/24 equifax")).alias("h"), layout.inquiries(F.lit("none")).alias("i"), layout.neutralized(F.lit("I owe and was late"), [("owe", "debt", "D"), ("late", "lateness", "L")]).alias("g"),
    ).first()
    assert list(row.a) == ["experian", "transunion", "equifax"] and row.b is None
    assert (row.c.late30, row.c.late60, row.c.late90) == (5, 1, None)
    assert [tuple(x) for x in row.d] == [("x", "a"), ("y", "b c")] and [tuple(x) for x in row.e] == [("x", "a"), ("y", "")]
    assert [tuple(x) for x in row.f] == [("ACME BANK", "01/02/2024", "transunion")] and list(row.i) == []
    assert [tuple(x) for x in row.h] == [("ACME BANK", "01/2024", "experian"), ("Other Co", "2/24", "equifax")]
    assert (row.g.statement, list(row.g.flags)) == ("L", ["debt", "lateness"])


def test_token_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("page\tline\ty0\ty1\tx0\tx1\ttext\n1\t2\t0\t1\t9\t10\tworld\n1\t2\t0\t1\t1\t2\thello\nx\t2\t0\t1\t1\t2\tbad\n")
    tokens = records.read_tokens(spark, f"file://{tmp_path}/t.tsv")
    assert [r.text for r in records.line_texts(tokens).collect()] == ["hello world"]
    (tmp_path / "r.json").write_text('{"a": 1}\nbroken\n')
    good, bad = records.read_records(spark, f"file://{tmp_path}/r.json", "a int")
    assert good.collect()[0].a == 1 and bad.count() == 1


def test_account_files(spark, tmp_path):
    folder = tmp_path / "s1" / "7"
    folder.mkdir(parents=True)
    (folder / "bureaus.json").write_text('{"transunion": {"balance": "$1", "type": "--"}, "experian": {}}')
    got = records.read_accounts(spark, f"file://{tmp_path}/*/*/bureaus.json").collect()
    assert [(r.account, r.bureau, r.field, r.raw) for r in got] == [("7", "transunion", "balance", "$1")]


def test_exports(spark, tmp_path):
    schema = ", ".join(f"{c} string" if c != "cycle_id" else "cycle_id int" for c in records.EXPORT_COLUMNS)
    rows = spark.createDataFrame([(f"s{k}", "f", "t", k, "o", "p", "2024", None) for k in range(5)], schema).repartition(3)
    read = lambda folder: "\n".join(p.read_text().strip() for p in sorted((tmp_path / folder).glob("part=*/part-*")) if p.stat().st_size)
    records.write_csv_export(rows, f"file://{tmp_path}/csv")
    lines = read("csv").split("\n")
    assert lines[:2] == ["export_version=1", ",".join(records.EXPORT_COLUMNS)] and sorted(lines[2:]) == [f"s{k},f,t,{k},o,p,2024,None" for k in range(5)]
    for name, some in (("json", rows), ("none", rows.limit(0))):
        records.write_json_export(some, f"file://{tmp_path}/{name}")
        found = json.loads(read(name))
        assert found["export_version"] == 1 and len(found["rows"]) == some.count()
    records.write_report(rows, f"file://{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/report").count() == 5
    for k in range(2):
        records.append_events(rows.limit(k + 1), f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 3


def test_loaders(spark, tmp_path):
    for account in ("7", "8"):
        folder = tmp_path / "runs" / "s1" / "cases" / "accounts" / account
        folder.mkdir(parents=True)
        (folder / "bureaus.json").write_text("{}")
    (tmp_path / "runs" / "s1" / "bureaus.json").write_text("{}")
    got = records.account_files(spark, f"file://{tmp_path}/runs").select("session", "account").collect()
    assert sorted(map(tuple, got)) == [("s1", "7"), ("s1", "8")]
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    assert [r.x for r in records.read_array(spark, f"file://{tmp_path}/a.json", "x int").collect()] == [1, 2]
    (tmp_path / "s.json").write_text('{"one": {"a": 1}, "two": {}}')
    assert [tuple(r) for r in records.read_sessions(spark, f"file://{tmp_path}/s.json").collect()] == [("one", '{"a":1}'), ("two", "{}")]
    (tmp_path / "r.json").write_text('{"status": {"min_days": 5}, "terms": {"min_days": 7}}')
    assert [tuple(r) for r in records.read_rules(spark, f"file://{tmp_path}/r.json", "field", "min_days int").collect()] == [("status", 5), ("terms", 7)]
    report = {"experian": {"accounts": [{"name": "A", "account_number": "1"}], "inquiries": [{"name": "x"}]}, "equifax": {"accounts": [{"name": None}]}}
    df = spark.createDataFrame([(1, report)], "id int, report map<string,map<string,array<map<string,string>>>>")
    rows = records.flattened_tradelines(df, "report").select("id", "bureau", "creditor", "account_number").collect()
    assert sorted(map(tuple, rows)) == [(1, "equifax", "", None), (1, "experian", "A", "1")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "experian", "x", None), ("2", "equifax", "y", "late")], "account string, bureau string, text string, error string")
    records.write_by_bureau(rows.drop("error"), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/account=2/bureau=equifax").first().text == "y"
    assert [r.account for r in records.split_failed(rows, "error", f"file://{tmp_path}/dead").collect()] == ["1"]
    assert spark.read.json(f"file://{tmp_path}/dead").first().error == "late"
    tokens = spark.createDataFrame([(2, 1, "b\tc", 1.0), (1, 9, "a", 2.0)], "page int, line int, text string, x0 double")
    records.write_tokens(tokens, f"file://{tmp_path}/tsv")
    assert [r.text for r in spark.read.option("sep", "\t").option("header", True).csv(f"file://{tmp_path}/tsv").orderBy("page").collect()] == ["a", "b c"]
    at = spark.createDataFrame([("2024-01-01",), ("2024-01-08",), ("2023-12-31",)], "at string").withColumn("at", F.col("at").cast("timestamp"))
    assert records.bounded_window(at, "at", "2024-01-08", 7).count() == 2


def test_late_grid_and_sections(spark):
    lines = ["TransUnion: 30: 1 60: 2", "Experian", "30-4 90: 1", "Equifax none", "TransUnion 30: 3", "Equifax:", "experian"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "b int, n int, t string")
    got = {r.bureau: (tuple(r.counts) if r.counts else None, r.grid) for r in layout.late_grid(df, ["b"], "n", "t").collect()}
    assert got["transunion"] == ((3, None, None), "30: 3") and got["equifax"] == (None, "") and got["experian"] == ((4, None, 1), "")
    rows = [(1, 1, "Account Overview"), (1, 2, "ACME BANK"), (1, 3, "x"), (1, 4, "Account # 12"), (1, 5, "Inquiries")]
    report = spark.createDataFrame(rows, "k int, n int, t string")
    assert [tuple(r) for r in layout.sections(report, ["k"], "n", "t", {"accounts": "overview", "none": "zzz"}).collect()] == [(1, 1, None)]
    assert [r.heading for r in layout.headings(report, ["k"], "n", "t").collect()] == ["ACME BANK"]
    both = spark.createDataFrame([(1, 0, "x"), (1, 1, "TransUnion"), (1, 2, "a"), (1, 3, "Equifax"), (1, 4, "b")], "k int, n int, t string")
    assert [(r.t, r.bureau) for r in layout.bureau_segments(both, ["k"], "n", "t").orderBy("n").collect()] == [("a", "transunion"), ("b", "equifax")]
    row = spark.range(1).select(layout.enforced_collection(F.lit("Card"), F.lit("Open"), F.lit("Charged charge-off, sent to collection")).alias("a"), layout.enforced_collection(F.lit("Card"), F.lit("Open"), F.lit("collection")).alias("b")).first()
    assert tuple(row.a) == ("Collection", "Collection", "Open") and tuple(row.b) == ("Card", "Open", None)


def test_labels_medians_and_months(spark):
    lines = ["Account #", "High Balance:", "noise", "high balance", "TransUnion", "Remarks:"]
    row = spark.range(1).select(text.canonical_labels(F.array(*map(F.lit, lines)), ["account", "highbalance"]).alias("a"), text.canonical_labels(F.array(*map(F.lit, lines[:3])), ["account"]).alias("b"), sequence.clusters_from_median(F.array(*map(F.lit, [0.0, 1.0, 2.0, 2.3, 9.0, 9.5])), 1.4).alias("c")).first()
    assert list(row.a) == ["Account #", "High Balance:"] and list(row.b) == ["Account #", "High Balance:"] and list(row.c) == [1, 1, 1, 1, 2, 2]
    raw = [(1, 0, "Jan Feb"), (1, 1, "Two-Year Payment History"), (1, 2, "JAN ok, may 30"), (2, 1, "Two-Year Payment History מרץ March"), (3, 1, "June")]
    df = spark.createDataFrame(raw, "k int, n int, t string")
    found = consensus.month_language(df, ["k"], "n", "t", "Two-Year Payment History", text.HEBREW_MONTHS, [*text.ENGLISH_MONTHS, "march", "june"])
    assert tuple(found.first()) == (1, 3, "en", "MDY")
