"""Rules and default decisions are small tables, whatever the planner knows of their size."""

from ledgermend.operators import requirements


def test_rules_are_broadcast(spark):
    fields = spark.createDataFrame([(k, "returnflag", f"C{k % 3}_X") for k in range(20)], "account long, field string, reason_code string").selectExpr("account", "'returnflag' AS field", "reason_code")
    rules = spark.createDataFrame([("returnflag", "status")], "field string, category string")
    matrix = spark.createDataFrame([("returnflag", "C1", "strong_actionable")], "field string, reason string, decision string")
    got = requirements.with_default_decisions(requirements.with_rules(fields, rules), matrix)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan
    assert {(r.account, r.category, r.default_decision) for r in got.collect()} == {(k, "status", "strong_actionable" if k % 3 == 1 else None) for k in range(20)}
