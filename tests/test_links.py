"""Similarity joins against all pairs with difflib, groups, duplicate accounts and merged inquiries; tables against loops."""

import random
from datetime import date
from difflib import SequenceMatcher
from itertools import combinations

import pytest

from ledgermend.operators import links, tables


def names(seed, n):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        base = "".join(rng.choice("abcd e") for _ in range(rng.choice((1, 2, 3, 4, 5, 8, 14, 20))))
        out.add(base)
        for _ in range(3):
            k = rng.randrange(len(base) + 1)
            out.add(rng.choice((base[:k] + rng.choice("abz") + base[k:], base[:k] + base[k + 1 :], base[k:] + base[:k], base + base[:2])))
    return sorted(out - {""})


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@pytest.mark.parametrize("at_least", [0.8, 0.7, 1.0])
def test_no_similar_pair_is_lost(spark, at_least):
    sets = {1: names(1, 25), 2: names(2, 15), 3: ["aaaaaaaaaaaa", "aaaaaaaaaaab", "aaaaaaaaaaa"], None: ["xy"]}
    made = spark.createDataFrame([(k, x) for k, own in sets.items() for x in own * 2] + [(1, None), (1, "")], "k int, name string")
    got = {(r.k, r.a, r.b): r.ratio for r in links.similar_names(made, ["k"], "name", at_least).collect()}
    want = {(k, a, b): ratio(a, b) for k, own in sets.items() if k for a, b in combinations(sorted(own), 2) if ratio(a, b) >= at_least}
    assert got == pytest.approx(want) and (at_least == 1.0 or len(want) > 30)


def test_connected_groups(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (100, 100), (200, 150)]
    got = {r.node: r.component for r in links.connected(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 200: 150, 150: 150}
    assert links.connected(spark.createDataFrame([], "a int, b int")).collect() == []


def test_duplicate_accounts(spark):
    row = lambda k, name, number="", balance=None, status="Collection", opened=None, s=1, category="all_accounts": (s, k, name, number, ["x"], status, opened, None, balance, category)
    rows = [
        row(1, "First Bank", "1-2345"), row(2, "FIRST BANK", "12345", category="negative_accounts"), row(3, "First Bankk", ""), row(4, "First", "99"), row(5, "Other", "1"), row(6, "Other", "2"),
        row(7, "Gone Store", "", 100.0), row(8, "Gone Stores", "", 250.0), row(9, "Gone Stor", "", 150.0), row(10, "First Bank", "2345", status="Open"), row(11, "First Bank", s=2), row(12, None, "7", s=2),
        row(13, "Late", opened=date(2020, 1, 1), s=3), row(14, "Late", opened=date(2020, 3, 31), s=3), row(15, "Late", opened=date(2020, 7, 1), s=3),
    ]
    schema = "s int, id int, name string, account_number string, bureaus array<string>, status string, opened date, closed date, balance double, category string"
    got = links.duplicate_suspects(spark.createDataFrame(rows, schema), "s").collect()
    assert {r.id: r.suspect_group for r in got} == {1: 1, 3: 1, 4: 1, 5: None, 6: None, 7: 7, 8: 7, 9: 7, 10: None, 11: 11, 12: 11, 13: 13, 14: 13, 15: None}
    assert next(r.categories for r in got if r.id == 1) == ["all_accounts", "negative_accounts"]


ACCOUNT = "s int, id int, name string, account_number string, bureaus array<string>, status string, opened date, closed date, balance double, category string"


def suspects(x, y):
    """Whether two accounts of the negative category are suspects; NaN is the largest number and equals itself, as in Spark."""
    alike = x[2].startswith(y[2]) or y[2].startswith(x[2]) or ratio(min(x[2], y[2]), max(x[2], y[2])) >= 0.8
    number = not x[3] or not y[3] or x[3] == y[3]
    days = all(p is None or q is None or abs((p - q).days) <= 90 for p, q in zip(x[6:8], y[6:8]))
    a, b = x[8], y[8]
    if a is None or b is None or (a != a and b != b):
        near = True
    else:
        near = abs(a - b) <= max(100, 0.1 * min(a, b)) if a == a and b == b else False
    return x[0] == y[0] and alike and number and days and near


@pytest.mark.parametrize("seed", [1, 2])
def test_suspects_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    edge = (None, 0.0, 99.0, 100.0, 989.99, 990.0, 999.99, 1000.0, 1099.9, 1099.95, 1100.0, 1100.1, 1210.0, float("nan"), float("inf"), float("-inf"), -50.0, -1e13, -1e13 - 64, 1e301)
    balance = lambda: rng.choice(edge) if rng.random() < 0.3 else round(10 ** rng.uniform(1, 6), 2)
    day = lambda gap: None if rng.random() < gap else date.fromordinal(date(2020, 1, 1).toordinal() + rng.choice((-1, 0, 90, 91, rng.randrange(-900, 900))))
    names = ("first bank", "first bankk", "first", "other", "otter store", "otter stores")
    rows = [(rng.choice((1, 2)), k, rng.choice(names), rng.choice(("", "1111", "2222", "3333", "4444", "5555")), ["x"], f"Collection {k}", day(0.05), day(0.3), balance(), "negative_accounts") for k in range(260)]
    least = {r[1]: r[1] for r in rows}
    pairs = [(x[1], y[1]) for x, y in combinations(rows, 2) if suspects(x, y)]
    for _ in rows:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    linked = {k for pair in pairs for k in pair}
    got = {r.id: r.suspect_group for r in links.duplicate_suspects(spark.createDataFrame(rows, ACCOUNT), "s").collect()}
    want = {k: least[k] if k in linked else None for k in least}
    assert got == want and len(set(want.values())) > 10


def test_links_of_suspects_grow_with_the_accounts(spark, monkeypatch):
    """Accounts of one name that are all suspects of each other are joined without making their pairs."""
    made, connected = [], links.connected
    monkeypatch.setattr(links, "connected", lambda found: made.append(found.count()) or connected(found))
    rows = [(1, k, "first bank", "" if k % 3 else str(1000 + k), ["x"], f"Collection {k}", date(2020, 1, 1 + k % 28), None, 500.0 + k % 7, "negative_accounts") for k in range(300)]
    got = links.duplicate_suspects(spark.createDataFrame(rows, ACCOUNT), "s").collect()
    assert {r.suspect_group for r in got} == {0} and made[0] < 600


def test_merged_inquiries(spark):
    ours = spark.createDataFrame([("d1", "b", "capital one"), ("d1", "b", "capital onee"), ("d1", "b", "zz top"), ("d2", "b", "capital one"), (None, "b", "amex")], "d string, b string, n string")
    theirs = spark.createDataFrame([("d1", "b", "capital one"), ("d1", "b", "unseen"), ("d2", "b", "capitol one"), (None, "b", "amexx")], "d string, b string, n string")
    got = sorted(((r.d, r.name, r.origin, r.confirmed) for r in links.merged_inquiries(ours, theirs, ["d", "b"], "n").collect()), key=str)
    assert got == sorted([("d1", "capital one", "parser", True), ("d1", "zz top", "parser", False), ("d1", "unseen", "model", True), ("d2", "capital one", "parser", True), (None, "amex", "parser", True)], key=str)


def test_source_columns_and_table(spark):
    head = [(1, 0, "TransUnion®", 100.0, 160.0), (1, 0, "EXPERIAN", 300.0, 360.0), (1, 0, "Equifax:", 340.0, 400.0), (2, 0, "Experian", 0.0, 9.0)]
    tok = [(k, line, t, x0, x1, 0.0, 4.0) for k, line, t, x0, x1 in head]
    tok += [(1, 1, t, x, x + 10, 10.0, 14.0) for t, x in (("High", 5.0), ("Balance:", 20.0))]
    tok += [(1, 2, t, x, x + 10, 11.0, 15.0) for t, x in (("$5", 120.0), ("--", 320.0), ("x", 600.0))]
    tok += [(1, 3, "more", 110.0, 120.0, 18.0, 22.0), (1, 4, "High", 5.0, 15.0, 90.0, 94.0), (1, 4, "Balance", 20.0, 30.0, 90.0, 94.0), (1, 5, "Status", 5.0, 9.0, 26.0, 30.0), (1, 6, " ", 120.0, 125.0, 28.0, 30.0), (1, 7, "far", 120.0, 125.0, 40.0, 44.0)]
    made = spark.createDataFrame(tok, "k int, line int, text string, x0 double, x1 double, y0 double, y1 double")
    cols = {r.source: (r.left, r.right) for r in tables.source_columns(made, ["k"]).collect()}
    assert cols == {"transunion": (35.0, 225.0), "experian": (270.0, 349.5), "equifax": (350.5, 430.0)}
    got = {r.field: (r.transunion, r.experian, r.equifax) for r in tables.source_table(made, ["k"], {"high balance": "high", "status": "status"}).collect()}
    assert got == {"high": ("$5 more", "--", ""), "status": ("", "", "")}


def test_lines_of_a_source_table_are_made_once(spark):
    """The plan reads lines that are written already, however often they are met."""
    made = spark.createDataFrame([(1, 0, "Status", 0.0, 9.0, 0.0, 4.0)], "k long, line int, text string, x0 double, x1 double, y0 double, y1 double")
    plan = tables.source_table(made, ["k"], {"status": "status"})._jdf.queryExecution().executedPlan().toString()
    assert "struct(x0" not in plan
