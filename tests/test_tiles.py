"""Many queries over tiles against loops over words, and the end-to-end answers without an index."""

import random

import numpy as np
import pytest
from test_oracle import SF
from test_scale import brute_bm25, prose

from factlake.operators import bm25_index, bm25_tiles
from factlake.operators.bm25_scan import Scan
from factlake.plans import registry

registry.load()


@pytest.mark.parametrize("docs_of, queries_of", [(1 << 17, 1 << 14), (60, 7)])
def test_best_of_tiles(spark, monkeypatch, docs_of, queries_of):
    monkeypatch.setattr(bm25_tiles, "DOCS", docs_of)
    monkeypatch.setattr(bm25_tiles, "QUERIES", queries_of)
    monkeypatch.setattr(bm25_tiles, "KEPT", 3)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(150)]
    docs = {i: prose(rng, words, rng.randint(3, 12)) for i in range(400)} | {i: "w0 w1" for i in range(400, 450)} | {450: ""}
    queries = {q: prose(rng, words, 5) for q in range(30)} | {30: "w0", 31: "none", 32: "w1 w1 w0 w149"}
    q = spark.createDataFrame([(i, t, 3 + i % 20) for i, t in queries.items()], "qid long, query string, k int")
    got = {}
    for r in bm25_tiles.top_k(Scan(spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").repartition(3)), q).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.doc, r.score))
    for i, text in queries.items():
        want = brute_bm25(docs, text, 3 + i % 20)
        assert [d for d, _ in got.get(i, [])] == [d for d, _ in want], i
        assert np.allclose([s for _, s in got.get(i, [])], [s for _, s in want], atol=2e-6)


def test_answers_store_no_postings(spark, monkeypatch):
    monkeypatch.setattr(bm25_index.Index, "append", None)
    monkeypatch.setattr(bm25_index, "_kept", {})
    assert registry.QUERIES["answer_end_to_end"](spark, SF).count() == spark.read.parquet(f"{SF}/part.parquet").count()


def test_queries_meet_the_documents_of_their_rare_words_alone(spark, monkeypatch):
    """The k best of all documents, while few of the pairs are multiplied: the work doesn't grow with queries times documents."""
    pairs, searched = [], bm25_tiles.searched

    def counting(docs, asked, mean, kind):
        pairs.append(asked.selectExpr("filter(terms, x -> x.term = term)[0].df AS df").agg({"df": "sum"}).first()[0])
        return searched(docs, asked, mean, kind)

    monkeypatch.setattr(bm25_tiles, "searched", counting)
    monkeypatch.setattr(bm25_tiles, "SUMS", 100)
    rng = random.Random(4)
    docs = [(i, f"the {rng.choice(['large', 'old', 'hot'])} {rng.choice(['ring', 'bolt'])} {i // 40} {rng.choice(['has', 'was'])} brand {rng.randint(0, 9)}") for i in range(4000)]
    queries = [(i, f"what was the {rng.choice(['large', 'old', 'hot'])} {rng.choice(['ring', 'bolt'])} {rng.randint(0, 99)} of brand {rng.randint(0, 9)}", 1 + i % 40) for i in range(200)] + [(200, "the", 5), (201, "large the", 60), (202, None, 3)]
    scan, q = Scan(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(queries, "qid long, query string, k int")
    best = {}
    for r in scan.batch(q).top_k(60).collect():
        best.setdefault(r.qid, []).append((r.rank, r.doc, r.score))
    want = sorted((i, d, s, n) for i, _, k in queries for n, d, s in best.get(i, []) if n <= k)
    assert sorted(map(tuple, bm25_tiles.top_k(scan, q).select("qid", "doc", "score", "rank").collect())) == want
    assert 0 < sum(pairs) < 0.2 * len(docs) * len(queries)
