"""Small exact cases of the symbolic operators, scorers, cues and rankings."""

import random

import pytest
from pyspark.sql import functions as F

from factlake.functions import scoring as S
from factlake.functions import text as X
from factlake.operators import checks, facts, history, hops, retrieval, symbolic, validation

CITIES = [(1, "Chennai"), (2, "Delhi"), (3, "Vellore"), (4, "DELHI.")]


def candidates(spark, values, qids):
    rows = [(q, s, s, f"Alex lived in {v}", v) for q in qids for s, v in values]
    return spark.createDataFrame(rows, "qid long, serial long, ord long, fact_text string, answer_entity string")


def questions(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, question string")


def answers(df):
    return [r.answer for r in df.orderBy("qid").collect()]


def test_historical_native(spark):
    asked = [
        "What was the first city for Alex?", "Where did Alex live previously before now?", "What was the third previous city for Alex?",
        "What was the fifth previous city for Alex?", "City history for Alex", "What was the second city Alex lived in?",
    ]
    wanted = ["Chennai", "Vellore", "Delhi", "Chennai", "Chennai", "Chennai"]
    q = questions(spark, asked)
    assert answers(symbolic.historical_native(q, candidates(spark, CITIES, range(6)))) == wanted
    again = symbolic.historical_native(questions(spark, ["Where did Alex live previously before now?"]), candidates(spark, [*CITIES, (5, "Delhi")], [0]))
    assert answers(again) == ["Vellore"]


def test_boolean_native(spark):
    asked = {"Is Delhi the current city for Alex?": True, "Is Chennai the current city for Alex?": False, "Was Chennai ever a city for Alex?": True, "Is Alex not in Delhi?": False, "Is Alex not in London?": True, "Isn't Alex in Delhi?": True}
    assert answers(symbolic.boolean_native(questions(spark, list(asked)), candidates(spark, CITIES, range(6)))) == list(asked.values())


def test_aggregate_native(spark):
    q = questions(spark, ["How many distinct cities for Alex?", "List all cities for Alex"])
    assert answers(symbolic.aggregate_native(q, candidates(spark, CITIES, range(2)))) == ["3", '["Chennai", "Delhi", "Vellore"]']
    aliases = symbolic.aggregate_native(questions(spark, ["How many cities?"]), candidates(spark, [(1, "NYC"), (2, "New York City")], [0]))
    assert answers(aliases) == ["2"]


def test_no_candidates(spark):
    none = candidates(spark, [], [])
    q = questions(spark, ["What was the previous city?", "How many cities?", "List all cities", "Is it Delhi?"])
    assert answers(symbolic.historical_native(q, none))[0] == "(no answer)"
    assert answers(symbolic.aggregate_native(q, none))[1:3] == ["0", "[]"]
    assert answers(symbolic.boolean_native(q, none))[3] is False


PLAN = dict(intent="aggregation", entity="Marie", property_scope="entity_wide_values", property_name=None, temporal_scope="unspecified", ordinal_offset=None, aggregation_mode="count", boolean_target=None, negated=False, supported=True, reason="", complete=True)
SCHEMA = "qid long, question string, intent string, entity string, property_scope string, property_name string, temporal_scope string, ordinal_offset int, aggregation_mode string, boolean_target string, negated boolean, supported boolean, reason string, complete boolean"


def plans(spark, *changes, question="q"):
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    rows = [{**PLAN, **c, "qid": i, "question": c.get("question", question)} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def run(spark, values, *changes):
    c = candidates(spark, values, range(len(changes)))
    return [(r.status, next((x for x in (r.answer_text, r.answer_int, r.answer_bool, r.answer_list) if x is not None), None), r.serial) for r in symbolic.execute(plans(spark, *changes), c).orderBy("qid").collect()]


def test_planner(spark):
    words = [(1, "English"), (2, "english"), (3, "French")]
    assert run(spark, words, {}, {"complete": False}, {"aggregation_mode": "list"}) == [("answered", 2, None), ("insufficient_evidence", None, None), ("answered", ["English", "French"], None)]
    past = dict(intent="historical", temporal_scope="previous")
    repeat = [(1, "German"), (2, "English"), (3, "French"), (4, "french")]
    assert run(spark, repeat, past, {**past, "temporal_scope": "ordinal", "ordinal_offset": 2}, {**past, "temporal_scope": "ordinal", "ordinal_offset": 5}, {**past, "temporal_scope": "ordinal", "ordinal_offset": 0}, {**past, "complete": False}) == [
        ("answered", "English", 2), ("answered", "German", 1), ("insufficient_history", None, None), ("insufficient_history", None, None), ("insufficient_history", None, None),
    ]
    never = dict(intent="boolean", boolean_target="Klingon", negated=True)
    assert run(spark, words, {**never, "complete": False}, never, {**never, "boolean_target": "english"}, {**never, "supported": False}, {"property_scope": "ambiguous"}) == [
        ("insufficient_evidence", None, None), ("answered", True, None), ("answered", False, None), ("unsupported", None, None), ("unsupported", None, None),
    ]
    assert run(spark, words, dict(intent="current_value"), dict(intent="current_value", complete=False)) == [("answered", "French", None), ("insufficient_evidence", None, None)]


def test_completeness(spark):
    retrieved = spark.createDataFrame([(0, 1, 1, "Marie has the language of English"), (1, 1, 1, "Marie has the language of English"), (1, 2, 2, "Marie was born in Paris"), (1, 3, 2, "Marie was born in Paris")], "qid long, ord long, serial long, text string")
    entity = spark.createDataFrame([("Marie", 2)], "entity string, n long")
    by_property = spark.createDataFrame([("Marie", "language", 1), ("Marie", "location", 1)], "entity string, property string, n long")
    p = plans(spark, {}, {}).drop("complete")
    assert [r.complete for r in symbolic.history_complete(p, retrieved, entity).orderBy("qid").collect()] == [False, True]
    p = plans(spark, {"property_scope": "specific", "property_name": "Language"}, {"property_scope": "specific", "property_name": "genre"}).drop("complete")
    assert [r.complete for r in symbolic.history_complete(p, retrieved, entity, by_property).orderBy("qid").collect()] == [True, False]
    p = plans(spark, {"entity": "Nobody"}, {"intent": "boolean", "property_scope": "specific", "property_name": "language"}).drop("complete")
    assert [r.complete for r in symbolic.history_complete(p, retrieved, entity, by_property).orderBy("qid").collect()] == [False, True]


def test_rows_may_come_in_any_order_and_twice(spark):
    rows = [(q, o, s, f"E{q} has the language of {v}") for q in range(4) for o, (s, v) in enumerate([(3, "French"), (1, "English"), (2, "english"), (4, "French")])]
    changes = [{"entity": f"E{q}"} for q in range(2)] + [{"entity": f"E{q}", "intent": "historical", "temporal_scope": "previous"} for q in (2, 3)]
    p = plans(spark, *changes)
    results = set()
    for parts in (1, 4, 16):
        mixed = rows + rows[:5]
        random.Random(parts).shuffle(mixed)
        r = spark.createDataFrame(mixed, "qid long, ord long, serial long, text string").repartition(parts)
        got = symbolic.execute(p, symbolic.deterministic_candidates(p, r))
        results.add(repr(sorted(map(tuple, got.collect()), key=repr)))
    assert len(results) == 1


@pytest.mark.parametrize(
    ("question", "cue"),
    [("What was the first value?", "earliest"), ("value before any updates", "earliest"), ("the previous one", "previous"), ("prior to the first", "previous"), ("nothing", None), ("beforehand", None)],
)
def test_temporal_cue(spark, question, cue):
    assert spark.range(1).select(X.temporal_cue(F.lit(question))).first()[0] == cue


def test_scorers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.subem(F.lit("15"), F.lit("5"))) and not one(S.strict(F.lit("aggregation"), F.lit("15"), F.lit("5")))
    assert one(S.parse_number(F.lit("There are 5 values. Final answer: 4."))) == 4
    assert one(S.parse_number(F.lit("four"))) == 4 and one(S.parse_number(F.lit("1,234"))) == 1234 and one(S.parse_number(F.lit("none"))) is None
    assert one(S.parse_boolean(F.lit("Yes, that is correct."))) is True and one(S.parse_boolean(F.lit("incorrect"))) is False
    assert one(S.by_intent(F.lit("historical"), F.lit("The Paris one"), F.lit("paris")))
    assert not one(S.by_intent(F.lit("historical"), F.lit("Paris"), F.lit("?!"))) and not one(S.by_intent(F.lit("boolean"), F.lit(None).cast("string"), F.lit("True")))


def test_parsers(spark):
    df = spark.createDataFrame([(1, "1. U2 has the language of English.\n2. Another fact is clear.")], "doc long, context string")
    got = [(r.serial, r.text, r.offset) for r in facts.parse_anchored(df).orderBy("context_order").collect()]
    assert got == [(1, "U2 has the language of English", 0), (2, "Another fact is clear", 35)]
    loose = spark.createDataFrame([(1, "1. U2. b is c..")], "doc long, context string")
    assert [(r.serial, r.text) for r in facts.parse_legacy(loose).orderBy("context_order").collect()] == [(1, "U"), (2, "b is c")]
    line = spark.createDataFrame([("a b of c",), ("x\r was born in y",)], "t string")
    s, v = X.parse_fact(F.col("t"))
    assert [tuple(r) for r in line.select(s, v).collect()] == [(None, None), ("x", "y")]


def test_tie_orders(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate([1.0, 1.0, 0.0])] + [(1, i, 0.0) for i in range(3)], "q long, pos long, score double")
    up = retrieval.top_k(df, 3, "q", tie=F.asc("pos")).where("q = 0").orderBy("rank").collect()
    down = retrieval.top_k(df, 3, "q", tie=F.desc("pos")).where("q = 1").orderBy("rank").collect()
    assert [r.pos for r in up] == [0, 1, 2] and [r.pos for r in down] == [2, 1, 0]


def test_bm25_by_hand(spark, tmp_path):
    from math import log

    from factlake.operators.bm25_index import Index

    docs = spark.createDataFrame([(1, "red fox"), (2, "red dog runs"), (3, "blue")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "fox fox")], "qid long, query string")
    index = Index(spark, str(tmp_path / "index")).append(docs)
    (r,) = index.all_scores(q).collect()
    assert r.doc == 1 and r.score == pytest.approx(2 * log(2.5 / 1.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2)), abs=1e-6)
    (floor,) = index.all_scores(spark.createDataFrame([(0, "red")], "qid long, query string")).where("doc = 1").collect()
    mean = (log(1.5 / 2.5) + 4 * log(2.5 / 1.5)) / 5
    assert floor.score == pytest.approx(0.25 * mean * 2.5 / (1 + 1.5 * (0.25 + 0.75)), abs=1e-6)


def test_history_ties_and_gaps(spark):
    df = spark.createDataFrame([("a", "X", 1, 0), ("a", "x.", 2, 1), ("a", "--", 3, 2), ("a", "x", 4, 3), ("a", "y", 5, 5), ("a", "z", 5, 4), ("b", "?", 1, 0)], "entity string, value string, serial long, ord long")
    assert [(r.value, r.state) for r in history.timeline(df, "entity").orderBy("state").collect()] == [("z", 0), ("y", 1), ("x", 2)]
    assert {r.entity: r.value for r in history.freshest(df, "entity").collect()} == {"a": "z", "b": "?"}
    got = {r.entity: (r.value, r.status) for r in history.nth_prior(df, 2, "entity").collect()}
    assert got == {"a": ("x", "answered"), "b": (None, "insufficient_history")}


def test_strict_candidates(spark):
    shown = spark.createDataFrame([(0, 1, "A is in B"), (1, 1, "A is in B"), (2, 1, "A is in B"), (3, 1, "A is in B")], "qid long, serial long, text string")
    c = lambda serial, answer, more="": f'{{"candidates": [{{"serial": {serial}, "fact_text": "A is in B", "answer_entity": "{answer}"{more}}}]}}'
    raw = spark.createDataFrame([(0, c(1, " B ")), (1, c("true", "B")), (2, c(1, "C")), (3, c(1, "B", ', "x": 1'))], "qid long, raw string")
    assert [tuple(r) for r in validation.validate_candidates(raw, shown).collect()] == [(0, 1, "A is in B", "B")]


def test_hops(spark):
    row = spark.createDataFrame([("of {hop_1_answer} and {hop_2_answer}", "x", None)], "q string, a string, b string")
    known = {1: F.col("a"), 2: F.col("b")}
    assert row.select(hops.substitute(F.col("q"), known), hops.missing(F.col("q"), known)).first() == ("of x and ", 2)


def test_checked_join_refuses_missing_partners(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    right = spark.createDataFrame([(1, 10), (3, 30)], "k long, y long")
    assert [tuple(r) for r in checks.checked_join(left.where("k = 1"), right, ["k"]).collect()] == [(1, "a", 10)]
    with pytest.raises(Exception, match="no partner for"):
        checks.checked_join(left, right, ["k"]).collect()


def test_plans_see_each_fact_once(spark):
    """Repeated texts of one serial count once, whatever the number of times they were retrieved."""
    plan = spark.createDataFrame([(1, "How many values were recorded for X?", "aggregation", "X", "entity_wide_values", None, "unspecified", None, "count", None, False, True, "")], "qid long, question string, intent string, entity string, property_scope string, property_name string, temporal_scope string, ordinal_offset int, aggregation_mode string, boolean_target string, negated boolean, supported boolean, reason string")
    facts_ = [(1, 3, 1, "X was created by B"), (1, 0, 0, "X was created by A"), (1, 1, 0, "X was created by A"), (1, 4, 2, "X was created by b."), (1, 5, 9, "Y was created by C")]
    retrieved = spark.createDataFrame(facts_, "qid long, ord long, serial long, text string")
    n = spark.createDataFrame([("X", 3)], "entity string, n long")
    out = symbolic.execute_final(plan, retrieved, n).first()
    assert (out.status, out.answer_int, out.answer_list, out.complete) == ("answered", 2, ["A", "B"], True)
