"""Operators on hot keys, long documents and bounds: the same results as the plain forms, over many tasks."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factlake.operators import audit, facts, history, ranks, retrieval
from factlake.operators.bm25_index import Index
from factlake.operators.dense import Search


def python_facts(context, pattern):
    found = list(re.finditer(pattern, context, re.ASCII))
    ends = [m.start() for m in found[1:]] + [len(context)]
    return [(int(m[1]), i, m.start(), context[m.end() : e].strip().rstrip(".")) for i, (m, e) in enumerate(zip(found, ends, strict=True))]


def test_a_long_context_parses_in_linear_time(spark):
    """20,000 facts in one document, with numbers inside lines, indented lines, empty and repeated facts."""
    rng = random.Random(4)
    lines = [f"{rng.choice(['', '', ' ', chr(9)])}{i % 19_000}. Entity {i} has the genre of {rng.choice(['a', 'U2. b', 'x 7. y', '', '..'])}" for i in range(20_000)]
    context = "Head 3. of it\n" + "\n".join(lines)
    df = spark.createDataFrame([(1, context), (2, ""), (3, None), (4, "no facts"), (5, "1. a")], "doc long, context string")
    for parse, pattern in ((facts.parse_legacy, facts.LEGACY), (facts.parse_anchored, facts.ANCHORED)):
        got = parse(df)
        assert [tuple(r)[1:] for r in got.where("doc = 1").orderBy("context_order").select("doc", "serial", "context_order", "offset", "text").collect()] == python_facts(context, pattern)
        assert [(r.doc, r.serial, r.offset, r.text) for r in got.where("doc > 1").collect()] == [(5, 1, 0, "a")]


def test_boundaries_are_compared_by_offset(spark):
    """``12. `` inside a line is false though a line begins with 12; an indented line begins at its blank."""
    context = "12. Ann was 12. years old.\n 13. Bob has the genre of jazz.\n14. odd"
    df = spark.createDataFrame([(1, context), (2, None)], "doc long, context string")
    (a, none) = facts.boundary_audit(df, "doc").orderBy("doc").collect()
    assert (a.n_legacy, a.n_anchored, a.only_legacy, a.duplicate_serials, a.empty_texts, a.unparsed) == (4, 3, 2, 0, 0, 2)
    assert tuple(none)[1:] == (0, 0, 0, 0, 0, 0)
    false = [(r.pseudo_serial, r.offset, r.snippet) for r in facts.false_boundaries(df, "doc").orderBy("offset").collect()]
    assert false == [(n, at, context[max(0, at - 48) : at + 80]) for n, at in ((12, 12), (13, 28))]
    assert [(r.serial, r.fact_text) for r in facts.unparsed_facts(df, "doc").orderBy("serial").collect()] == [(12, "Ann was 12. years old"), (14, "odd")]


def test_prefixes_with_one_shared_first_word(spark):
    names = ["brand", "brand x", "brand x y", "brand  z", " lead", "", "solo"]
    texts = ["brand x y is new", "brand", "brand ", "brand  z has", " lead on", "solo", "brandy x", "solo x", None]
    f = spark.createDataFrame(list(enumerate(texts)), "serial long, text string")
    e = spark.createDataFrame([(n,) for n in [*names, "solo", None]], "entity string")
    want = sorted((i, n) for i, t in enumerate(texts) for n in names if t is not None and t.startswith(n + " "))
    assert sorted((r.serial, r.entity) for r in facts.prefix_join(f, e).collect()) == want
    counts = {r.entity: r.n_raw for r in facts.prefix_counts(f, e).collect()}
    assert counts == {n: sum(1 for _, x in want if x == n) for n in {x for _, x in want}}
    # rows into the join: a fact has one for each number of words that some entity has
    many = spark.createDataFrame([(f"brand n{i}",) for i in range(300)], "entity string")
    some = spark.createDataFrame([(i, f"brand n{i} was seen") for i in range(300)], "serial long, text string")
    assert facts.prefixes(some, many).count() == 300


def test_targets_by_runs_of_words(spark):
    q = spark.createDataFrame([(0, "Is brand red fox ever seen?", "e"), (1, "Is brand here?", "brand"), (2, "brand red or brand fox", "e"), (3, "", "e")], "qid long, question string, entity string")
    c = spark.createDataFrame([("brand",), ("Brand red",), ("brand fox",), ("brand red fox",), ("ev",), ("fo",)], "v string")
    got = {r.qid: (r.target, r.status) for r in audit.find_targets(q, c).collect()}
    assert got == {0: ("brand red fox", "matched_catalog"), 1: (None, "not_found"), 2: (None, "multiple_equal_length_matches"), 3: (None, "not_found")}


def test_places_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(None if i % 50 == 0 else "hot" if i % 10 else f"k{i % 7}", rng.randint(0, 300), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i long").repartition(7)
    got = ranks.placed(df, ("k",), F.desc("v"), "i")
    assert got.select(F.max(F.col("place"))).first()[0] > 2000
    w = Window.partitionBy("k").orderBy(F.desc("v"), "i")
    assert sorted((r.i, r.place) for r in got.collect()) == sorted((r.i, r.p - 1) for r in df.withColumn("p", F.row_number().over(w)).collect())
    assert [r.i for r in ranks.numbered(df, "i").orderBy("place").collect()] == list(range(3000))
    plan = ranks.numbered(df, "i")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert ranks.numbered(df.limit(0), "i").count() == 0


def test_nearest_ranks_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 5 else f"k{i % 9}", rng.choice([None, rng.random(), 0.5])) for i in range(2000)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    own = {}
    for k, v in rows:
        if v is not None:
            own.setdefault(k, []).append(v)
    want = {k: (sorted(v)[min(len(v) - 1, int(0.95 * len(v)))], sorted(v)[len(v) // 2]) for k, v in own.items()}
    assert {r.k: (r.p95, r.median) for r in ranks.nearest_ranks(df, ("k",), "v", {"p95": 0.95, "median": 0.5}).collect()} == want


@pytest.mark.parametrize("seed", [0, 1])
def test_timelines_of_a_hot_entity(spark, seed):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.choice(["X", "x.", "y", "--", "z", "y"]), rng.randint(0, 400), i) for i in range(1500)]
    rows += [("runs", "same", s, 5000 + s) for s in range(600)] + [("runs", "other", 700, 9999)]
    df = spark.createDataFrame(rows, "entity string, value string, serial long, ord long").repartition(6)
    plain, stitched = history.timeline(df, "entity"), history.timeline(df, "entity", hot_rows=10)
    key = lambda r: (str(r.entity), r.state, r.value, r.serial)
    got = sorted(map(key, stitched.collect()))
    assert got == sorted(map(key, plain.collect()))
    assert [x for x in got if x[0] == "runs"] == [("runs", 0, "other", 700), ("runs", 1, "same", 599)]


def prose(rng, words, n):
    return " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))


def brute_bm25(docs, query, k):
    own = {d: re.findall("[a-z0-9]+", t.lower()) for d, t in docs.items()}
    n, mean = len(own), sum(map(len, own.values())) / len(own)
    df = {}
    for t in own.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    scores = {}
    for d, t in own.items():
        s = sum((raw[w] if raw[w] >= 0 else floor) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in re.findall("[a-z0-9]+", query.lower()) if w in t)
        if any(w in t for w in re.findall("[a-z0-9]+", query.lower())):
            scores[d] = round(s, 6)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_index_is_kept_appended_to_and_pruned(spark, tmp_path):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    docs = {i: prose(rng, words, rng.randint(5, 120)) for i in range(900)} | {900: "", 901: "w0 w0 w1"}
    queries = {q: prose(rng, words, 6) for q in range(8)} | {8: docs[5], 9: "nothing known", 10: "w0 w1 w2"}
    frame = lambda d, c: spark.createDataFrame(sorted(d.items()), c)
    q = frame(queries, "qid long, query string")
    path = str(tmp_path / "index")
    first = Index(spark, path).append(frame({d: t for d, t in docs.items() if d < 500}, "doc_id long, text string"))
    early = {(r.qid, r["rank"]): r.doc for r in first.top_k(q, 5).collect()}
    assert early[8, 1] == 5
    index = Index(spark, path).append(frame({d: t for d, t in docs.items() if d >= 500}, "doc_id long, text string"))
    again = Index(spark, path)  # opened anew
    assert len(again.batches()) == 2
    got = {}
    for r in again.top_k(q, 10, plain_postings=0).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.doc, r.score))
    want = {i: brute_bm25(docs, t, 10) for i, t in queries.items()}
    for i in queries:
        assert [d for d, _ in got.get(i, [])] == [d for d, _ in want[i]], i
        assert np.allclose([s for _, s in got.get(i, [])], [s for _, s in want[i]], atol=2e-6)
    assert sorted(map(tuple, again.top_k(q, 10).collect())) == sorted((i, d, s, n) for i, own in got.items() for n, (d, s) in enumerate(own, 1))
    last = {}
    for r in again.top_k(q, 3, tie=F.desc("doc"), plain_postings=0).orderBy("qid", "rank").collect():
        last.setdefault(r.qid, []).append(r.doc)
    assert last[10] == [d for d, _ in sorted(brute_bm25(docs, queries[10], 900), key=lambda x: (-x[1], -x[0]))[:3]]
    left, work = again.candidates(again.asked(q, "qid", "query"), 10)
    w = {r.qid: (r.postings, r.read, r.scored) for r in work.collect()}
    shared = again.all_scores(q).groupBy("qid").count().rdd.collectAsMap()
    assert sum(s for *_, s in w.values()) < 0.5 * sum(shared.values())  # documents scored, of those that share a word
    assert left.count() == sum(s for *_, s in w.values())


def test_passages_are_found_by_their_rarest_word(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a red fox runs fast here"), (2, "red foxes run"), (3, "xred fox runs fasty"), (4, None), (5, "Red fox runs fast")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "red fox runs fast"), (1, "ed fo"), (2, "unknown words only here"), (3, "d fox r")], "qid long, query string")
    index = Index(spark, str(tmp_path / "i")).append(docs)
    assert sorted((r.qid, r.doc_id) for r in retrieval.containing(index, docs, q).collect()) == [(0, 1), (0, 3), (3, 1), (3, 3), (3, 5)]


@pytest.mark.parametrize("clustered", [True, False])
def test_dense_search_skips_cells_and_loses_nothing(spark, clustered):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 1500)] + (0.05 if clustered else 3.0) * rng.normal(size=(1500, 24))
    x[7], x[11] = 0.0, x[12]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [])]
    vectors = spark.createDataFrame(rows, "doc_id long, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 1500, 75)], "qid long, vec array<double>")
    search = Search(vectors)
    found, met = search.searched(queries, 10)
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.doc_id, r.score))
    for q in range(0, 1500, 75):
        score = np.round(unit @ unit[q], 6)
        want = sorted(range(1500), key=lambda i: (-score[i], i))[:10]
        assert [d for d, _ in got[q]] == want and np.allclose([s for _, s in got[q]], score[want], atol=1e-6)
    share = met.join(search.sizes, "cell").agg(F.sum("n")).first()[0] / (20 * 1500)
    assert share < 0.3 if clustered else share <= 1.0
    assert search.all_scores(queries).count() == 20 * 1500
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_fusion_ranks_everything(spark):
    rng = random.Random(5)
    rows = [(q, d, round(rng.random(), 2), rng.choice([0.0, 0.0, round(rng.random(), 1)])) for q in range(3) for d in range(700)]
    both = spark.createDataFrame(rows, "qid long, doc_id long, dense double, sparse double").repartition(5)
    got = {}
    for r in retrieval.rrf(both, 20).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.doc_id, r.score))
    for q in range(3):
        own = [r for r in rows if r[0] == q]
        r1 = {r[1]: i for i, r in enumerate(sorted(own, key=lambda r: (-r[3], r[1])), 1)}
        r2 = {r[1]: i for i, r in enumerate(sorted(own, key=lambda r: (-r[2], r[1])), 1)}
        fused = {d: round(1 / (60 + r1[d]) + 1 / (60 + r2[d]), 9) for d in r1}
        assert got[q] == sorted(fused.items(), key=lambda x: (-x[1], x[0]))[:20]
