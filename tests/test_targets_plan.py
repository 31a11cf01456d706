"""Targets of many questions: one aggregation, and nothing as long as the questions is joined or broadcast."""

from factlake.operators import audit


def test_questions_are_neither_joined_nor_broadcast(spark):
    q = spark.range(3000).selectExpr("id AS qid", "concat('Is brand ', id % 40, ' here?') AS question", "'e' AS entity")
    c = spark.range(20).selectExpr("concat('brand ', id) AS v")
    got = audit.find_targets(q, c)
    rows = {r.qid: (r.target, r.status) for r in got.collect()}
    assert rows == {i: (f"brand {i % 40}", "matched_catalog") if i % 40 < 20 else (None, "not_found") for i in range(3000)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # with the catalog
