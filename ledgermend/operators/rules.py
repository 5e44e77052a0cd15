"""Integrity checks of one source's record, as columns.

A check returns a struct with its status (ok, conflict, skipped, skipped_missing_data, unknown)
and its evidence.  Dates are columns already parsed (``functions.dates.found_date``);
a history is ``array<struct<month_year_key string, status string>>`` in list order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermend.functions.dates import first_forbidden_month, month_key
from ledgermend.functions.lets import bound
from ledgermend.functions.histories import BUCKET_NAMES, max_month, month_status, worst_months
from ledgermend.functions.money import severity
from ledgermend.functions.predicates import in_states, missing_placeholder

#: Words that tell of late payment in a status.
DEROGATORY = ("charge-off", "charge off", "collection", "delinquent", "late", "past due", "write-off", "written off", "repossession", "foreclosure")
ROUTES = {"open": ("S_open", 1), "closed": ("S_closed", 2), "unknown": ("S_unknown", 3), "conflict": ("S_conflict", 4)}


def account_state(fields: Mapping[str, Column], placeholders: Sequence[str]) -> Column:
    """Q1: open, closed, conflict or unknown from the three status fields, and the share of them that say so."""
    gone = {k: missing_placeholder(c, placeholders) for k, c in fields.items()}
    low = {k: F.lower(F.trim(c)) for k, c in fields.items()}
    says = lambda word: {k: ~gone[k] & low[k].contains(word) for k in fields}
    count = lambda flags: sum((F.when(f, 1).otherwise(0) for f in flags.values()), F.lit(0))
    opened, closed, shown = count(says("open")), count(says("closed")), count({k: ~g for k, g in gone.items()})
    state = F.when((opened > 0) & (closed == 0), "open").when((closed > 0) & (opened == 0), "closed").when((opened > 0) & (closed > 0), "conflict").otherwise("unknown")
    late = F.lit(False)
    for k in fields:
        for word in DEROGATORY:
            late = late | (~gone[k] & low[k].contains(word))
    status = F.when(state == "conflict", "conflict").when((state == "unknown") & ~late & (shown == 0), "skipped_missing_data").otherwise("ok")
    backing = F.when(state == "open", opened).when(state == "closed", closed).otherwise(0)
    confidence = F.when(shown == 0, 0.0).otherwise(F.bround(backing / shown, 4))
    signals = F.array_compact(F.array(F.when(opened > 0, "OPEN"), F.when(closed > 0, "CLOSED"), F.when(late, "DEROG")))
    return F.struct(status.alias("status"), state.alias("declared_state"), confidence.alias("confidence"), signals.alias("signals"))


def route(state: Column) -> Column:
    """R1: the route of a declared state; anything else is illegal, number 0."""
    known = F.create_map(*[x for k, (name, n) in ROUTES.items() for x in (F.lit(k), F.struct(F.lit(name).alias("state_id"), F.lit(n).alias("state_num")))])
    return F.coalesce(F.try_element_at(known, state), F.struct(F.lit("S_illegal_combo").alias("state_id"), F.lit(0).alias("state_num")))


def _ceiling(dates: Mapping[str, Column]) -> Column:
    return F.greatest(dates["date_reported"], dates["last_verified"])


def _empty(history: Column) -> Column:
    return history.isNull() | (F.size(history) == 0)


def _outcome(skipped: Column, conflict: Column) -> Column:
    return F.when(skipped, "skipped_missing_data").when(conflict, "conflict").otherwise("ok")


def time_ceiling(dates: Mapping[str, Column]) -> Column:
    """F0.A01: no date after the later of reported and verified."""
    top = _ceiling(dates)
    late = F.array_compact(F.array(*[F.when(d > top, F.lit(k)) for k, d in sorted(dates.items())]))
    return F.struct(_outcome(top.isNull(), F.size(late) > 0).alias("status"), top.alias("ceiling"), late.alias("violations"))


def opening_floor(dates: Mapping[str, Column]) -> Column:
    """F0.A02: no date before the opening."""
    floor = dates["date_opened"]
    early = F.array_compact(F.array(*[F.when(d < floor, F.lit(k)) for k, d in sorted(dates.items()) if k != "date_opened"]))
    return F.struct(_outcome(floor.isNull(), F.size(early) > 0).alias("status"), floor.alias("floor"), early.alias("violations"))


def monthly_ceiling(dates: Mapping[str, Column], history: Column) -> Column:
    """F0.A03: no month after the ceiling's month, whatever its status."""
    top = month_key(_ceiling(dates))
    late = F.filter(F.transform(history, lambda e: e["month_year_key"]), lambda m: m > top)
    return F.struct(_outcome(top.isNull() | _empty(history), F.size(late) > 0).alias("status"), late.alias("violations"))


def monthly_floor(dates: Mapping[str, Column], history: Column) -> Column:
    """F0.A04: no reported month before the opening's month."""
    floor = month_key(dates["date_opened"])
    early = F.filter(history, lambda e: (e["month_year_key"] < floor) & ~e["status"].eqNullSafe(F.lit("--")))
    return F.struct(_outcome(floor.isNull() | _empty(history), F.size(early) > 0).alias("status"), F.transform(early, lambda e: e["month_year_key"]).alias("violations"))


def activity_history(route_number: Column, history: Column) -> Column:
    """F2.B01: for open accounts, what the monthly history holds; it never conflicts."""
    count = lambda test: F.when(_empty(history), 0).otherwise(F.size(F.filter(history, test)))
    eligible = in_states(route_number, [1])
    status = F.when(~eligible, "skipped").when(_empty(history), "unknown").otherwise("ok")
    return F.struct(
        status.alias("status"), eligible.alias("eligible"),
        count(lambda e: F.trim(e["status"]) == "ok").alias("count_ok"),
        count(lambda e: F.trim(e["status"]) == "--").alias("count_missing"),
        count(lambda e: F.trim(e["status"]).rlike(r"^[+-]?\d+$")).alias("count_delinquent"),
    )


def post_closure_activity(route_number: Column, closed: Column, activity: Sequence[tuple[str, Column]]) -> Column:
    """F2.B02: for closed accounts, the first activity date after closure."""
    eligible = in_states(route_number, [2])
    first = F.coalesce(*[F.when(d > closed, F.lit(k)) for k, d in activity])
    status = F.when(~eligible, "skipped").otherwise(_outcome(closed.isNull(), first.isNotNull()))
    return F.struct(status.alias("status"), eligible.alias("eligible"), F.when(status == "conflict", first).alias("violating_field"))


def post_closure_ok(route_number: Column, closed: Column, history: Column) -> Column:
    """F3.B01: months marked ok at or after the month that follows closure."""
    eligible = in_states(route_number, [2, 3, 4])
    wrong = F.filter(month_status(history), lambda e: (e["month_year_key"] >= first_forbidden_month(closed)) & (e["status"] == "ok"))
    status = F.when(~eligible, "skipped").otherwise(_outcome(closed.isNull() | _empty(history), F.size(wrong) > 0))
    return F.struct(status.alias("status"), eligible.alias("eligible"), F.when(status == "conflict", F.transform(wrong, lambda e: e["month_year_key"])).alias("months"))


def month_coverage(day: Column, history: Column, eligible: Column | None = None) -> Column:
    """F3.B02 and FX.B03: the date's month must not lie after the last month of the history."""
    last, own = max_month(history), month_key(day)
    status = _outcome(own.isNull() | last.isNull(), own > last)
    if eligible is not None:
        status = F.when(~eligible, "skipped").otherwise(status)
    return F.struct(status.alias("status"), own.alias("month"), last.alias("max_month"))


def payment_monotone(last_payment: Column, history: Column) -> Column:
    """FX.B01: from the month of the last payment on, severity never drops; list order counts and unknown statuses are skipped."""
    target = month_key(last_payment)
    found = F.array_position(F.transform(history, lambda e: F.coalesce(e["month_year_key"], F.lit(""))), target)
    tail = F.when(found > 0, F.slice(history, found.cast("int"), F.size(history)))
    known = F.filter(F.transform(F.filter(tail, lambda e: e["month_year_key"].isNotNull()), lambda e: F.struct(severity(e["status"]).alias("s"), e["month_year_key"].alias("m"))), lambda e: e["s"].isNotNull())

    def drops(scored: Column) -> Column:
        n = F.greatest(F.size(scored) - 1, F.lit(0))
        return F.zip_with(F.slice(scored, F.lit(1), n), F.slice(scored, F.lit(2), n), lambda a, b: F.struct((b["s"] < a["s"]).alias("drop"), a["m"].alias("previous"), b["m"].alias("month")))

    skipped = last_payment.isNull() | _empty(history) | F.coalesce(found == 0, F.lit(True))
    first = F.get(F.filter(bound(known, drops), lambda x: x["drop"]), F.lit(0))
    return bound(F.struct(skipped.alias("skipped"), first.alias("first")), lambda r: F.struct(
        _outcome(r["skipped"], r["first"].isNotNull()).alias("status"), F.when(~r["skipped"], r["first"]["previous"]).alias("previous_month"), F.when(~r["skipped"], r["first"]["month"]).alias("month")))


def seven_against_two(seven: Mapping[str, Column], history: Column) -> Column:
    """FX.B02: late months of two years must not exceed the seven-year counts; up to five months as examples, the worst first."""
    known = F.lit(True)
    for name in BUCKET_NAMES:
        known = known & seven[name].isNotNull()

    def result(months: Column) -> Column:
        of = lambda k: F.transform(F.filter(months, lambda e: e["bucket"] == k), lambda e: e["month_year_key"])
        over = F.lit(False)
        for k, name in enumerate(BUCKET_NAMES, 1):
            over = over | (F.size(of(k)) > seven[name])
        status = _outcome(~known | (F.size(months) == 0), over)
        return bound(status, lambda s: F.struct(s.alias("status"), F.when(s == "conflict", F.slice(F.concat(of(3), of(2), of(1)), F.lit(1), F.lit(5))).alias("examples")))

    return bound(worst_months(F.coalesce(history, F.array().cast("array<struct<month_year_key:string,status:string>>"))), result)


def visibility(results: Mapping[str, Column]) -> Column:
    """Which branches were eligible, executed and fired, by their statuses."""
    pick = lambda test: F.array_compact(F.array(*[F.when(test(s), F.lit(k)) for k, s in sorted(results.items())]))
    return F.struct(pick(lambda s: s != "skipped").alias("eligible"), pick(lambda s: ~s.startswith("skipped")).alias("executed"), pick(lambda s: s == "conflict").alias("fired"))


#: Statuses that make an account a problem.
BAD_PAYMENT = ("late", "collection", "charge-off", "charge off", "charged off", "repossession", "foreclosure")
BAD_ACCOUNT = ("collections", "charge-off", "charged off", "delinquent")


def problem(past_due: Column, late_days: Column, payment_status: Column, account_status: Column, balance: Column, past_due_gt: float = 0.0, late_min: int = 1) -> Column:
    """Reasons why an account is a problem, and its primary issue.

    The charge-off branch takes any payment status that contains ``co``.
    """
    pay, acc = F.lower(F.trim(F.coalesce(payment_status, F.lit("")))), F.lower(F.trim(F.coalesce(account_status, F.lit(""))))
    has = lambda text, words: sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0)) > 0
    due, days = F.coalesce(past_due, F.lit(0.0)), F.coalesce(late_days, F.lit(0))
    reasons = F.array_compact(F.array(
        F.when(due > past_due_gt, "past_due_amount"), F.when(days >= late_min, "late_history"), F.when(has(pay, BAD_PAYMENT), "bad_payment_status"),
        F.when(has(acc, BAD_ACCOUNT), "bad_account_status"), F.when((F.coalesce(balance, F.lit(0.0)) > 0) & (acc == "closed"), "positive_balance_on_closed"),
    ))
    off = has(pay, ("charge-off", "collection", "co")) | has(acc, ("charge-off", "collections", "charged off"))
    issue = F.when(off, F.when(has(pay, ("collection",)) | has(acc, ("collections",)), "collection").otherwise("charge_off"))
    issue = issue.when(due > past_due_gt, "delinquency").when(days >= late_min, "late_history").when(has(pay, BAD_PAYMENT) | has(acc, BAD_ACCOUNT), "status").otherwise("unknown")
    return F.struct(reasons.alias("reasons"), issue.alias("primary_issue"))
