"""Pairs of accounts in all fields: each field alone, what is missing, and what conflicts do."""

from datetime import date

import pytest

from ledgermend.operators import scoring

SCHEMA = "s int, i int, account_number array<string>, date_opened array<date>, balance_owed array<bigint>, account_type array<string>, account_status array<string>, history_2y array<string>, history_7y struct<late30:int,late60:int,late90:int>, account_label string, high array<bigint>"
EMPTY = {"account_number": [None, "", None], "date_opened": [None] * 3, "balance_owed": [None, 0, None], "account_type": [None] * 3, "account_status": [None] * 3, "history_2y": None, "history_7y": None, "account_label": None, "high": [None] * 3}
SAME = {
    "account_number": (["x12345", None, None], [None, None, "***345"]), "date_opened": ([date(2020, 1, 1), None, None], [None, date(2020, 1, 1), None]), "balance_owed": ([5, 700, None], [None, 700, 0]),
    "account_type": (["card", None, None], [None, None, "card"]), "account_status": ([None, "open", None], ["open", None, None]), "history_2y": (["OK", "30"], ["60", "OK", "30"]), "history_7y": ((0, 0, 0), (0, 0, 0)), "account_label": ("First  Bank", " first bank"),
}


def account(i, values):
    row = EMPTY | values
    return (1, i, *[row[c] for c in (*scoring.FIELDS, "high")])


@pytest.mark.parametrize("field", scoring.FIELDS)
def test_each_field_has_its_points(spark, field):
    left, right = SAME[field]
    rows = [account(1, {field: left}), account(2, {field: right}), account(3, {})]
    got = {(r.i_a, r.i_b): r for r in scoring.scored_pairs(spark.createDataFrame(rows, SCHEMA), "s", "i").collect()}
    assert (got[1, 2].points, list(got[1, 2].matched)) == (scoring.Policy().weights[field], [field])
    assert all((got[k].points, list(got[k].matched), got[k].decision) == (0.0, [], "different") for k in ((1, 3), (2, 3)))
    assert list(got[1, 2].conflicts) == ([] if field == "balance_owed" else ["amount_conflict:balance_owed"])


def test_conflicts_and_thresholds(spark):
    all_of = lambda k, side, **more: account(k, {f: v[side] for f, v in SAME.items()} | more)
    rows = [all_of(1, 0, high=[10_000, None, None]), all_of(2, 1, high=[None, 11_000, None]), all_of(3, 1, high=[900_000, None, None]), all_of(4, 1, balance_owed=[1, None, None])]
    made = spark.createDataFrame(rows, SCHEMA)
    got = {(r.i_a, r.i_b): (r.points, r.decision, list(r.triggers), list(r.conflicts)) for r in scoring.scored_pairs(made, "s", "i", amounts=("high",)).collect()}
    assert got[1, 2] == (9.0, "auto", ["points:direct"], [])
    assert got[1, 3] == (9.0, "ai", ["points:ai"], ["amount_conflict:high"])
    assert got[1, 4] == (6.0, "ai", ["points:ai"], ["amount_conflict:balance_owed"])
    few = scoring.Policy(fields=("account_type", "balance_owed"), direct_points=3.5)
    assert {r.decision for r in scoring.scored_pairs(made, "s", "i", few).where("i_a = 1 and i_b = 3").collect()} == {"auto"}
    assert scoring.scored_pairs(made.limit(0), "s", "i").collect() == []
