"""Repaired schedules: orders as accounts, their lines as submissions one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgermend.operators import repair
from ledgermend.plans.catalog import query, table

CAP = 30


def _roll(day: str) -> str:
    return f"({day} + CASE WHEN (w + {day}) % 7 >= 5 THEN 7 - (w + {day}) % 7 ELSE 0 END)"


def _back(day: str) -> str:
    return f"({day} - CASE WHEN (w + {day}) % 7 >= 5 THEN (w + {day}) % 7 - 4 ELSE 0 END)"


def _due(day: str, days: str) -> str:
    return f"({day} + CAST(FLOOR({days} / 5) AS INT) * 7 + {days} % 5 + CASE WHEN (w + {day}) % 7 + {days} % 5 >= 5 THEN 2 ELSE 0 END)"


#: Both engines read this: a line goes out shortly before the answer to the line before it is due.
ROWS_SQL = f"""SELECT account, CAST(position AS INT) AS position, CAST({_roll("raw")} AS INT) AS submit_day, CAST({_due(_roll("raw"), "min_days")} AS INT) AS due_day, min_days, w AS start_weekday FROM
(SELECT account, position, min_days, w, CAST(COALESCE(SUM(gap) OVER (PARTITION BY account ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS raw FROM
(SELECT account, position, min_days, w, min_days - 1 - p AS gap FROM (SELECT l_orderkey AS account, CAST(l_quantity AS INT) % 12 + 5 AS min_days, CAST(l_partkey % 2 AS INT) AS p, CAST(l_orderkey % 5 AS INT) AS w,
ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS position FROM lineitem) a) b) c"""
COVERED_SQL = "SELECT account, CAST(SUM(due_day - submit_day) - SUM(COALESCE(GREATEST(0, due_day - nx), 0)) AS INT) AS days FROM (SELECT *, LEAD(submit_day) OVER (PARTITION BY account ORDER BY position) AS nx FROM {rows}) GROUP BY 1"


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ROWS_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


@query("capped_plans", f"""WITH RECURSIVE plan AS ({ROWS_SQL}), before AS ({COVERED_SQL.format(rows="plan")}),
run AS (SELECT p.account, position, submit_day, due_day, 0 AS moved_days, days AS covered FROM plan p JOIN before b ON b.account = p.account WHERE position = 1
UNION ALL SELECT account, position, CAST(day AS INT), CAST(CASE WHEN day = own THEN due_day ELSE {_due("day", "min_days")} END AS INT), CAST(own - day AS INT), CAST(covered - own + day AS INT) FROM
 (SELECT *, CASE WHEN covered > {CAP} AND {_back("(own - 1)")} < due AND {_back("(own - 1)")} > sent THEN CASE WHEN {_back(f"(own - (covered - {CAP}))")} > sent THEN {_back(f"(own - (covered - {CAP}))")} ELSE {_roll("(sent + 1)")} END ELSE own END AS day FROM
 (SELECT p.account, p.position, p.submit_day AS own, p.due_day, p.min_days, p.start_weekday AS w, r.submit_day AS sent, r.due_day AS due, r.covered FROM run r JOIN plan p ON p.account = r.account AND p.position = r.position + 1))),
after AS ({COVERED_SQL.format(rows="run")})
SELECT r.account, position, submit_day, due_day, moved_days, b.days AS days_before, a.days AS days_after, a.days <= {CAP} AS within FROM run r JOIN before b ON b.account = r.account JOIN after a ON a.account = r.account""")
def capped_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.capped(submissions(spark, sf_dir), "account", CAP)


@query("rebalanced_plans", f"""WITH RECURSIVE plan AS ({ROWS_SQL}), asked AS (SELECT account, CAST(SUM(due_day - submit_day) AS INT) - {CAP} AS asked, CAST(COUNT(*) AS INT) - 1 AS n FROM plan GROUP BY 1),
run AS (SELECT p.account, position, submit_day, due_day - submit_day AS span, FALSE AS infeasible FROM plan p WHERE position = 1
UNION ALL SELECT account, position, CAST(CASE WHEN asked <= 0 OR asked < n THEN own WHEN high < low THEN GREATEST(low, own) ELSE COALESCE(pick, {_roll("ends")}) END AS INT), span, NOT (asked <= 0 OR asked < n) AND (high < low OR pick IS NULL) FROM
 (SELECT *, CASE WHEN {_back("ideal")} >= low THEN {_back("ideal")} WHEN {_roll("ideal")} <= high THEN {_roll("ideal")} END AS pick FROM
 (SELECT *, GREATEST(LEAST(ends - (1 + (asked - n) // n + CASE WHEN position - 2 < (asked - n) % n THEN 1 ELSE 0 END), high), low) AS ideal FROM
 (SELECT p.account, p.position, p.submit_day AS own, p.due_day - p.submit_day AS span, p.start_weekday AS w, r.submit_day + 1 AS low, r.submit_day + r.span - 1 AS high, r.submit_day + r.span AS ends, asked, n FROM run r JOIN plan p ON p.account = r.account AND p.position = r.position + 1 JOIN asked a ON a.account = p.account)))),
laid AS (SELECT account, position, submit_day, submit_day + span AS due_day, infeasible FROM run), after AS ({COVERED_SQL.format(rows="laid")})
SELECT l.account, position, submit_day, due_day, infeasible, days AS days_after, asked > 0 AND n > 0 AS active, asked > 0 AND n > 0 AND asked < n AS too_few FROM laid l JOIN after f ON f.account = l.account JOIN asked k ON k.account = l.account""")
def rebalanced_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.rebalanced(submissions(spark, sf_dir), "account", CAP)
