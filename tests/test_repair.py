"""Repaired schedules against loops over days."""

import random

from ledgermend.operators import repair


def due_of(day, weekday, n):
    while n:
        day += 1
        n -= (weekday + day) % 7 < 5
    return day


def schedules():
    rng = random.Random(6)
    out = []
    for account in range(150):
        weekday, day, own = rng.randrange(5), 0, []
        for k in range(rng.choice((1, 2, 3, 5, 9))):
            while (weekday + day) % 7 >= 5:
                day += 1
            n = rng.randrange(1, 16)
            own.append((k + 1, day, due_of(day, weekday, n), n))
            day += rng.choice((1, 2, 5, 9, 14, 25))
        out.append((account, weekday, own))
    return out


def covered(own):
    return sum(d - s for _, s, d in own) - sum(max(0, a[2] - b[1]) for a, b in zip(own, own[1:]))


def plain_capped(weekday, own, cap):
    off = lambda day: (weekday + day) % 7 >= 5
    now = covered([x[:3] for x in own])
    out = [own[0][:3]]
    for k, s, d, n in own[1:]:
        day = s
        while now > cap:
            candidate = day - 1
            while off(candidate):
                candidate -= 1
            if not out[-1][1] < candidate < out[-1][2]:
                break
            now -= day - candidate
            day = candidate
        out.append((k, day, d if day == s else due_of(day, weekday, n)))
    return out


def plain_rebalanced(weekday, own, cap):
    off = lambda day: (weekday + day) % 7 >= 5
    asked, n = sum(d - s for _, s, d, _ in own) - cap, len(own) - 1
    if asked <= 0 or not n or asked < n:
        return [x[:3] for x in own], set()
    days, bad = [own[0][1]], set()
    for b in range(n):
        end = days[b] + own[b][2] - own[b][1]
        target = 1 + (asked - n) // n + (b < (asked - n) % n)
        low, high = days[b] + 1, end - 1
        if high < low:
            bad.add(b + 2)
            days.append(max(low, own[b + 1][1]))
            continue
        ideal = max(min(end - target, high), low)
        if off(ideal):
            fits = [x for x in range(ideal, low - 1, -1) if not off(x)] or [x for x in range(ideal, high + 1) if not off(x)]
            if not fits:
                bad.add(b + 2)
                fits = [next(x for x in range(end, end + 3) if not off(x))]
            ideal = fits[0]
        days.append(ideal)
    for k in range(1, len(days)):
        days[k] = max(days[k], days[k - 1] + 1)
    return [(x[0], day, day + x[2] - x[1]) for x, day in zip(own, days, strict=True)], bad


def test_repairs_equal_loops(spark):
    made = schedules()
    rows = spark.createDataFrame([(a, k, s, d, n, w) for a, w, own in made for k, s, d, n in own], "account int, position int, submit_day int, due_day int, min_days int, start_weekday int").repartition(4)
    found, even = {}, {}
    for r in repair.capped(rows, cap=20).collect():
        found.setdefault(r.account, []).append(r)
    for r in repair.rebalanced(rows, cap=20).collect():
        even.setdefault(r.account, []).append(r)
    moved = 0
    for account, weekday, own in made:
        mine = sorted(found[account], key=lambda r: r.position)
        want = plain_capped(weekday, own, 20)
        assert [(r.position, r.submit_day, r.due_day) for r in mine] == want
        assert {(r.days_before, r.days_after, r.within) for r in mine} == {(covered([x[:3] for x in own]), covered(want), covered(want) <= 20)}
        moved += sum(r.moved_days for r in mine)
        spread, bad = plain_rebalanced(weekday, own, 20)
        mine = sorted(even[account], key=lambda r: r.position)
        assert [(r.position, r.submit_day, r.due_day) for r in mine] == spread and {r.position for r in mine if r.infeasible} == bad
        assert {r.days_after for r in mine} == {covered(spread)}
    assert moved > 50 and any(r.infeasible for x in even.values() for r in x) and any(r.too_few for x in even.values() for r in x)


def test_schedules_are_walked_by_the_batch(spark):
    """No step is an interpreted lambda; a missing answer day counts no days, and longer and shorter schedules share a batch."""
    rows = spark.createDataFrame([(1, 2, 3, None, None, 0), (1, 1, 0, 7, 5, 0), (2, 1, 0, 7, 5, 0), (None, 1, 1, 8, 5, 0)], "account int, position int, submit_day int, due_day int, min_days int, start_weekday int").coalesce(1)
    for walked in (repair.capped(rows, cap=20), repair.rebalanced(rows, cap=20)):
        assert "lambda" not in walked._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r.account or 0, r.position, r.submit_day, r.due_day, r.days_after) for r in walked.collect())
        assert got == [(0, 1, 1, 8, 7), (1, 1, 0, 7, 3), (1, 2, 3, None, 3), (2, 1, 0, 7, 7)]
