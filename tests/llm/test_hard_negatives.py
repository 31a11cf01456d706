"""Hard negatives against products of every anchor with every row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, u string, dim string, `k.x` string"


def brute(rows, every=10, positives=5, negatives=3):
    use = []
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in use:
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in use if j != i and len(w) == len(v)]
        same, apart = sorted(s for s in score if s[2] == label), sorted(s for s in score if s[2] != label)
        for ps, j, _ in same[:positives]:
            window = [(s, k) for s, k, _ in apart if 50 * -ps <= 100 * -s <= 95 * -ps]
            out += [(i, j, r, k, -ps, -s) for r, (s, k) in enumerate(window[:negatives], 1)]
    return sorted(out)


def table(seed, n, dim, scale):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dim))
    rows = []
    for i in range(n):
        label = int(rng.choice([0, 0, 0, 1, 2, 3]))
        rows.append((i, (scale * (centre[label] + rng.normal(size=dim))).tolist(), label, "u", "d", "k"))
    return rows


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 10 == 0, **more).collect())


@pytest.mark.parametrize("block", [H.BLOCK_ROWS, 23])
def test_mined_as_by_all_products(spark, block):
    rows = table(1, 300, 70, 0.3)
    rows += [(300, None, 1, "", "", ""), (310, [1.0, None], 1, "", "", ""), (320, [float("nan")] * 70, 0, "", "", ""), (330, [float("inf")] * 70, 0, "", "", ""), (340, [0.1] * 70, None, "", "", ""), (None, [0.1] * 70, 1, "", "", "")]
    rows += [(400 + i, [0.5, 0.25 * i, -0.5], i % 2, "", "", "") for i in range(25)]  # other lengths
    rows += [(500 + i, [], i % 2, "", "", "") for i in range(12)] + [(600, [0.0] * 70, 0, "", "", "")]
    got = found(spark, rows, block=block)
    assert got == brute(rows) and len(got) > 100


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, float(i % 2), 0.0], i % 3, "", "", "") for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_wide_components(spark):
    rows = table(4, 90, 5, 3000.0)
    assert found(spark, rows) == brute(rows)


def test_nothing_to_mine(spark):
    assert found(spark, []) == []
    assert found(spark, table(1, 9, 4, 1.0)[1:]) == []


def test_intervals_drop_candidates_and_never_a_winner():
    rng = np.random.default_rng(9)
    x, a = rng.integers(-140, 140, (3000, 130)), rng.integers(-140, 140, 130)
    rows, anchor, seen = H.Candidates(x), H.Anchor(a), []

    def keep(low, high):
        seen.append((len(low), int((high - low).max())))
        return high >= H.kth(low, 5)

    alive, score = H.refine(anchor, rows, np.arange(3000), keep)
    assert (score == x[alive] @ a).all()
    assert sorted((x @ a))[-5:] == sorted(score)[-5:]
    assert [w for _, w in seen] == sorted((w for _, w in seen), reverse=True) and seen[-1][1] == 0
    assert seen[-1][0] < 100  # the last plane is read for few
