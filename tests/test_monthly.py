"""Monthly histories from layout tokens."""

import pytest

from ledgermend.operators import monthly

TOKENS = "account int, n int, page int, text string, x0 double, x1 double, y0 double, y1 double"


def section(months, statuses=None, account=1):
    """Headings, a row of statuses, a row of months below it, and the end of the section."""
    cells = [("Two-Year", 0, 10, 0), ("Payment", 0, 10, 0), ("History", 0, 10, 0), ("Transunion", 0, 10, 0)]
    cells += [(s, 10 + i * 20, 20 + i * 20, 0) for i, s in enumerate(statuses or ["OK"] * len(months))]
    cells += [(m, 10 + i * 20, 20 + i * 20, 10) for i, m in enumerate(months)]
    cells += [("Experian", 0, 10, 0), ("Equifax", 0, 10, 0), ("Seven-Year", 0, 10, 0), ("May", 0, 10, 50)]
    return [(account, n, 1, text, float(a), float(b), float(y), float(y + 1)) for n, (text, a, b, y) in enumerate(cells)]


@pytest.mark.parametrize("months,want", [
    (["Sep", "Oct", "Nov", "Dec", "'25", "Feb", "Mar"], ["2024-09", "2024-10", "2024-11", "2024-12", "2025-01", "2025-02", "2025-03"]),
    (["Oct", "'24", "Nov", "Dec", "'25", "Jan", "Feb", "'26", "Mar"], ["2024-10", "2024-01", "2024-11", "2024-12", "2025-01", "2025-01", "2025-02", "2026-01", "2026-03"]),
    (["Jan", "Feb"], [None, None]),
])
def test_years_go_on_from_mark_to_mark(spark, months, want):
    got = monthly.monthly_history(spark.createDataFrame(section(months), TOKENS), ["account"]).orderBy("place").collect()
    assert [r.month_year_key for r in got] == want
    assert {r.bureau for r in got} == {"transunion"} and {r.status for r in got} == {"ok"} and [r.month for r in got] == months


def test_statuses_by_overlap_in_the_nearest_row_above(spark):
    rows = section(["Jan", "Feb", "Mar"], ["30", "--", "CO"])
    more = [("Apr May", 10, 50, 30), ("60 OK", 10, 50, 25), ("Jun", 10, 20, 60)]
    extra = [(1, 9 + k, 1, t, float(a), float(b), float(y), float(y + 1)) for k, (t, a, b, y) in enumerate(more)]
    start = [(a, n if n < 10 else n + 10, p, *rest) for a, n, p, *rest in rows]
    got = monthly.monthly_history(spark.createDataFrame(start + [(1, 10 + k, *x[2:]) for k, x in enumerate(extra)], TOKENS), ["account"]).orderBy("place").collect()
    assert [(r.month, r.status) for r in got] == [("Jan", "30"), ("Feb", "--"), ("Mar", "co"), ("Apr", "60"), ("May", "ok"), ("Jun", "--")]


def test_pages_and_accounts_stay_apart(spark):
    two = section(["Jan"], ["60"], 2)
    across = [(3, n, 1 if text == "90" else p, text, *rest) for _, n, p, text, *rest in section(["מרץ"], ["90"], 3)]
    across = [(a, n, 2 if text == "מרץ" else p, text, *rest) for a, n, p, text, *rest in across]
    df = spark.createDataFrame(section(["Sept. 2024"], ["ok"]) + two + across + [(4, 0, 1, "no history", 0.0, 1.0, 0.0, 1.0)], TOKENS)
    got = {r.account: (r.month_number, r.status) for r in monthly.monthly_history(df, ["account"]).collect()}
    assert got == {1: (9, "ok"), 2: (1, "60"), 3: (3, "90")}
