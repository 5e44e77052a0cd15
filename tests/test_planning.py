"""Schedules against a search account by account."""

from itertools import product

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgermend.operators import planning

SPAN, WEEKEND = 45, (5, 6)


def roll(day: int, start_weekday: int) -> int:
    while (start_weekday + day) % 7 in WEEKEND:
        day += 1
    return day


def due_day(day: int, days: int, start_weekday: int, business: bool) -> int:
    """The day on which an answer is due: calendar days, or business days after the submission."""
    if not business:
        return day + days
    left = days
    while left > 0:
        day += 1
        left -= (start_weekday + day) % 7 not in WEEKEND
    return day


def sequence(items: list[tuple]) -> list[tuple]:
    """The strongest item first, the one with the longest answer time last, the others by strength; (field, strength, days, business)."""
    best: dict[str, tuple] = {}
    for item in items:
        have = best.get(item[0])
        if have is None or (item[1], item[2]) > (have[1], have[2]):
            best[item[0]] = item
    rest = sorted(best.values(), key=lambda x: (-x[1], -x[2], x[0]))
    if len(rest) < 3:
        return rest
    opener = rest.pop(0)
    closer = max(rest, key=lambda x: (x[2], x[1], x[0]))
    rest.remove(closer)
    return [opener, *rest, closer]


def last_answers(items: list[tuple], handoff: tuple[int, int], start_weekday: int, span: int) -> dict[tuple, tuple]:
    """Reachable schedules by their last (sent, due), each with its smallest gaps and its days.

    An item goes out so many days before the one before it is due, never on a
    weekend.  Schedules that meet in the same days are continued once.
    """
    first = roll(0, start_weekday)
    due = due_day(first, items[0][2], start_weekday, items[0][3])
    states = {(first, due): ((), ((first, due),))}
    for item in items[1:]:
        following: dict[tuple, tuple] = {}
        for (sent, due), (gaps, days) in sorted(states.items(), key=lambda x: x[1][0]):
            for gap in range(handoff[0], handoff[1] + 1):
                day = roll(max(sent + 1, due - gap), start_weekday)
                key = (day, due_day(day, item[2], start_weekday, item[3]))
                if day <= span:
                    found = ((*gaps, gap), (*days, key))
                    following[key] = min(following.get(key, found), found)
        states = following
    return states


def earliest(items: list[tuple], handoff: tuple[int, int], start_weekday: int) -> int:
    """The earliest day of the last answer: the widest gap each time, as rolling and due days keep order."""
    day = roll(0, start_weekday)
    due = due_day(day, items[0][2], start_weekday, items[0][3])
    for item in items[1:]:
        day = roll(max(day + 1, due - handoff[1]), start_weekday)
        due = due_day(day, item[2], start_weekday, item[3])
    return due


def best_plan(items: list[tuple], handoff: tuple[int, int] = (1, 3), span: int = SPAN) -> tuple[list[tuple], list[tuple[int, int]], int]:
    """The order, days and start weekday whose last answer comes latest within the span; earliest weekday and smallest gaps on ties.

    Items that don't fit are dropped from between opener and closer, the weakest first;
    an opener that doesn't fit alone still goes out.
    """
    order = sequence(items)
    while order:
        found = [(-due, weekday, gaps, days) for weekday in range(7) if weekday not in WEEKEND and earliest(order, handoff, weekday) <= span for (_, due), (gaps, days) in last_answers(order, handoff, weekday, span).items() if due <= span]
        if found:
            _, weekday, _, days = min(found)
            return order, list(days), weekday
        if len(order) <= 2:
            first = roll(0, 0)
            return order[:1], [(first, due_day(first, order[0][2], 0, order[0][3]))], 0
        weakest = min(range(1, len(order) - 1), key=lambda k: (order[k][1], order[k][2], -k))
        order = order[:weakest] + order[weakest + 1 :]
    return [], [], 0


def plan(account: str, items: list[tuple]) -> list[tuple]:
    order, days, weekday = best_plan(items)
    last = days[-1][1] if days else 0
    role = lambda k: "opener" if k == 0 else "closer" if k == len(order) - 1 else "supporter"
    return [(account, item[0], role(k), k + 1, sent, due, max(0, (days[k + 1][0] if k + 1 < len(days) else due) - sent - item[2]), last, weekday) for k, (item, (sent, due)) in enumerate(zip(order, days, strict=True))]


def best_items(found):
    """Of a field the strongest finding, then the longest, then business days."""
    best = {}
    for field, *rest in found:
        best[field] = max(best.get(field, rest), rest)
    return [(f, *r) for f, r in best.items()]


items = st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(0, 3), st.integers(1, 15), st.booleans()), min_size=1, max_size=7)


@settings(max_examples=25, deadline=None)
@given(items)
def test_search_equals_enumeration(found):
    order = sequence(found)
    for weekday in (0, 3):
        reached = last_answers(order, (1, 3), weekday, 60)
        for gaps in product((1, 2, 3), repeat=len(order) - 1):
            days = []
            for k, item in enumerate(order):
                day = roll(0 if not k else max(days[-1][0] + 1, days[-1][1] - gaps[k - 1]), weekday)
                days.append((day, due_day(day, item[2], weekday, item[3])))
            if all(d <= 60 for d, _ in days):
                assert reached[days[-1]][0] <= gaps


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(items, min_size=40, max_size=40))
def test_plans_equal_the_search(spark, accounts):
    accounts = [*accounts, [("a", 3, 60, False)], [("a", 1, 44, True), ("b", 1, 44, True)], [(f"f{k}", k % 4, 3, False) for k in range(30)]]
    rows = [(str(k), *item) for k, found in enumerate(accounts) for item in found]
    df = spark.createDataFrame(rows, "account string, field string, strength int, min_days int, business boolean")
    got = sorted(map(tuple, planning.plans(df).collect()))
    assert got == sorted(row for k, found in enumerate(accounts) for row in plan(str(k), best_items(found)))


def test_plans_shuffle_findings_and_no_states(spark):
    """Nothing is joined or written on the way: states stay within an account's row."""
    df = spark.createDataFrame([("x", "a", 3, 7, True), ("x", "b", 2, 5, False)], "account string, field string, strength int, min_days int, business boolean")
    plan = planning.plans(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "plan-" not in plan and plan.count("Exchange") <= 2
