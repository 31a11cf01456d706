"""Fusion by blocks against both rankings worked out whole."""

import random

import numpy as np
import pytest
from test_scale import prose

from factlake.operators import fusion
from factlake.operators.bm25_scan import Scan
from factlake.operators.dense import Search


@pytest.mark.parametrize("block, part", [(16384, 512), (97, 3)])
def test_fused_ranks_are_those_of_whole_rankings(spark, monkeypatch, block, part):
    monkeypatch.setattr(fusion, "BLOCK", block)
    monkeypatch.setattr(fusion, "PART", part)
    rng, r = np.random.default_rng(4), random.Random(4)
    x = np.round(rng.normal(size=(700, 6)), 1)
    x[3], x[400:440] = 0.0, x[7]  # ties in the dense ranking
    words = [f"w{i}" for i in range(60)]
    texts = {i: prose(r, words, 9) for i in range(0, 900, 2)}  # some without a vector, some vectors without a text
    asked = {**{i: x[i] for i in range(0, 700, 70)}, 5000: x[1]}
    passages = {i: prose(r, words, 4) for i in (0, 70, 140, 9999)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)
    batch = Scan(docs).batch(spark.createDataFrame(sorted(passages.items()), "qid long, query string"))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(701, None)], "doc_id long, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in asked.items()], "qid long, vec array<double>")
    sparse = {(s.qid, s.doc): s.score for s in batch.all_scores().collect()}
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(length > 0, length, 1)
    for own in (batch, None):
        got = {}
        for g in fusion.fused(Search(vectors), queries, own, 12).orderBy("qid", "rank").collect():
            got.setdefault(g.qid, []).append((g.doc_id, g.score))
        for q, vec in asked.items():
            dense = np.round(unit @ (vec / (np.linalg.norm(vec) or 1)), 6)
            r1 = {d: i for i, d in enumerate(sorted(range(700), key=lambda d: (-sparse.get((q, d), 0.0) if own else 0, d)), 1)}
            r2 = {d: i for i, d in enumerate(sorted(range(700), key=lambda d: (-dense[d], d)), 1)}
            want = sorted(((d, round(1 / (60 + r1[d]) + 1 / (60 + r2[d]), 9)) for d in range(700)), key=lambda p: (-p[1], p[0]))[:12]
            assert got[q] == want, q
