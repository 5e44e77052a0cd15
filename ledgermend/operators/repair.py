"""Repair of finished schedules: days pulled forward under a cap, overlaps spread evenly.

A schedule has at most ``planning.SPAN`` + 1 submissions, which are gathered into
one array per account and walked in order, as each decision needs the one before it.
The schedules of an Arrow batch are walked together: a step takes their k-th submissions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermend.operators.planning import WORKDAYS

CAP = 50
Days = np.ndarray  # doubles, NaN where a day is missing: comparisons with it are false, fmin and fmax pass over it


def _rolled(day: Days, weekday: Days) -> Days:
    """``planning.rolled`` for a batch: the day itself, or the Monday after it."""
    at = (weekday + day) % 7
    return day + np.where(at >= WORKDAYS, 7 - at, 0)


def _rolled_back(day: Days, weekday: Days) -> Days:
    """The day itself, or the Friday before it."""
    at = (weekday + day) % 7
    return day - np.where(at >= WORKDAYS, at - (WORKDAYS - 1), 0)


def _answer_day(day: Days, days: Days, weekday: Days) -> Days:
    """``planning.answer_day`` for a batch: so many business days after a working day."""
    at, rest = (weekday + day) % 7, days % WORKDAYS
    return day + np.floor(days / WORKDAYS) * 7 + rest + np.where(at + rest >= WORKDAYS, 2, 0)


class Schedules:
    """The schedules of an Arrow batch: their submissions one after the other in order, a field as one array."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, lists = batch, batch.column("items")
        self.counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.starts = np.cumsum(self.counts) - self.counts
        whose, items = np.repeat(np.arange(len(lists)), self.counts), lists.flatten()
        position = pc.struct_field(items, "position").to_numpy(zero_copy_only=False)
        order = np.lexsort((position, whose))
        self.whose = whose  # sorted by it, so the order leaves it as it is
        self.fields = {f.name: pc.struct_field(items, f.name).cast("double").to_numpy(zero_copy_only=False)[order] for f in items.type}
        self.first = np.zeros(len(whose), bool)
        self.first[self.starts] = True

    def of(self, name: str) -> Days:
        """A value of each schedule."""
        return self.batch.column(name).cast("double").to_numpy(zero_copy_only=False)

    def steps(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The schedules that have a second, third, ... submission, of those given, and where it is."""
        own = np.flatnonzero(which & (self.counts > 1))
        k = 1
        while len(own):
            yield own, self.starts[own] + k
            k += 1
            own = own[self.counts[own] > k]

    def covered(self, submit: Days, due: Days) -> Days:
        """Days that the submissions of each schedule cover, overlaps of neighbours once."""
        overlap = np.fmax(0, due - np.append(submit[1:], np.nan))
        overlap[np.append(self.first[1:], True)] = 0
        return np.bincount(self.whose, np.nan_to_num(due - submit) - overlap, len(self.counts))


def _whole(values: Days) -> pa.Array:
    return pa.array(values, from_pandas=True).cast("int32")


def _walked(rows: DataFrame, account: str, fields: tuple[str, ...], walk: Callable[[Schedules], dict[str, pa.Array]], told: str) -> DataFrame:
    """``walk`` of an account's submissions: a row each, with the account and the columns ``told``."""
    spans = F.sum(F.col("due_day") - F.col("submit_day")).cast("int")
    each = rows.groupBy(account).agg(F.first("start_weekday").alias("weekday"), spans.alias("spans"), (F.count(F.lit(1)) - 1).cast("int").alias("n"), F.collect_list(F.struct("position", *fields)).alias("items"))
    types = ", ".join([f"`{account}` {rows.schema[account].dataType.simpleString()}", told])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = Schedules(batch)
                yield pa.RecordBatch.from_pydict({account: batch.column(account).take(pa.array(own.whose))} | walk(own))

    return each.mapInArrow(run, types)


def capped(rows: DataFrame, account: str = "account", cap: int = CAP) -> DataFrame:
    """Schedules with later submissions moved forward until no more than ``cap`` days are covered, where that can be.

    ``rows`` has the account, position (from 1), submit_day, due_day, min_days (business days) and start_weekday, submissions in order on working days.
    In order, a submission goes back by working days while the days covered exceed the cap, the one before it is still unanswered and it stays
    after it; a move counts by its calendar days.  Returns account, position, submit_day, due_day, moved_days, days_before, days_after, and ``within``:
    whether the cap is kept.  A schedule within the cap stays as it is.
    """

    def walk(x: Schedules) -> dict[str, pa.Array]:
        own, answers, least = x.fields["submit_day"], x.fields["due_day"], x.fields["min_days"]
        day, due, weekday = own.copy(), answers.copy(), x.of("weekday")
        before = x.covered(own, answers)
        now = before.copy()
        for k, at in x.steps(before > cap):
            w, sent = weekday[k], day[at - 1]
            back, wanted = _rolled_back(own[at] - 1, w), _rolled_back(own[at] - (now[k] - cap), w)
            free = (now[k] > cap) & (back < due[at - 1]) & (back > sent)
            day[at] = np.where(free, np.where(wanted > sent, wanted, _rolled(sent + 1, w)), own[at])
            due[at] = np.where(day[at] == own[at], answers[at], _answer_day(day[at], least[at], w))
            now[k] += day[at] - own[at]
        after = x.covered(day, due)
        return {
            "position": _whole(x.fields["position"]), "submit_day": _whole(day), "due_day": _whole(due), "moved_days": _whole(own - day),
            "days_before": _whole(before[x.whose]), "days_after": _whole(after[x.whose]), "within": pa.array((after <= cap)[x.whose]),
        }

    return _walked(rows, account, ("submit_day", "due_day", "min_days"), walk, "position int, submit_day int, due_day int, moved_days int, days_before int, days_after int, within boolean")


def rebalanced(rows: DataFrame, account: str = "account", cap: int = CAP) -> DataFrame:
    """Schedules whose overlaps are spread evenly over the boundaries between submissions, so many in all that ``cap`` days are covered.

    ``rows`` as for ``capped``.  Each boundary aims at an equal share, the first ones at a day more where it doesn't divide.  A submission keeps at least a day of
    overlap and comes after the one before it; on a weekend it goes back to Friday, else on to Monday, within those bounds.  Where no working day lies
    within them the boundary is ``infeasible`` and the submission follows the answer.  Spans from submission to answer stay as they are.  Nothing moves
    where no overlap is asked for (``active`` false), or less than a day a boundary (``too_few``).
    """

    def walk(x: Schedules) -> dict[str, pa.Array]:
        position, own = x.fields["position"], x.fields["submit_day"]
        span, day, bad = x.fields["due_day"] - own, own.copy(), np.zeros(len(own), bool)
        weekday, asked, n = x.of("weekday"), x.of("spans") - cap, x.of("n")
        active = (asked > 0) & (n > 0)
        too_few = active & (asked < n)
        for k, at in x.steps(active & ~too_few):
            w, sent = weekday[k], day[at - 1]
            end, extra = sent + span[at - 1], asked[k] - n[k]
            target = 1 + extra // n[k] + (position[at] - 2 < extra % n[k])
            low, high = sent + 1, end - 1
            ideal = np.fmax(np.fmin(end - target, high), low)
            back, on = _rolled_back(ideal, w), _rolled(ideal, w)
            inside = np.where(back >= low, back, np.where(on <= high, on, np.nan))
            bad[at] = (high < low) | np.isnan(inside)
            day[at] = np.where(high < low, np.fmax(low, own[at]), np.where(np.isnan(inside), _rolled(end, w), inside))
        # Strictly one after the other, whatever an infeasible boundary did.
        for _, at in x.steps(np.full(len(n), True)):
            day[at] = np.fmax(day[at], day[at - 1] + 1)
        after = x.covered(day, day + span)
        return {
            "position": _whole(position), "submit_day": _whole(day), "due_day": _whole(day + span), "infeasible": pa.array(bad),
            "days_after": _whole(after[x.whose]), "active": pa.array(active[x.whose]), "too_few": pa.array(too_few[x.whose]),
        }

    return _walked(rows, account, ("submit_day", "due_day"), walk, "position int, submit_day int, due_day int, infeasible boolean, days_after int, active boolean, too_few boolean")
