"""The near-duplicate stage of the pipeline against all pairs of shingle sets."""

import random

import pytest

from factlake.llm import near_copies


def sets(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def corpus():
    rng = random.Random(5)
    out = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 300))]
        out.append(" ".join(base))
        for edits in (1, 2, 4, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("most", [1_000_000, 150])
def test_stage_keeps_one_of_each_near_group(spark, monkeypatch, most):
    import corpus_pipeline

    texts = corpus()
    own = [sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(texts)):
        for j in range(i):
            both = len(own[i] & own[j])
            if 5 * both >= 4 * (len(own[i]) + len(own[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    wanted = [i for i in range(len(texts)) if find(i) == i]
    assert len(wanted) < len(texts) - 40  # copies at 0.8 and copies below it are both there
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_copies.one_of_each, "__kwdefaults__", near_copies.one_of_each.__kwdefaults__ | {"most": most})
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()) == wanted


def test_stage_links_fingerprints_too(spark):
    """Texts whose SimHash fingerprints are equal, their Jaccard similarity being below 0.8, are one group."""
    import corpus_pipeline

    from factlake.llm import simhash

    base = [f"w{i}" for i in range(61)]
    # repeats outweigh the rest: three-word shingles of the tail decide no bit, but are a third of the set
    texts = [" ".join(base * 600 + [f"{c}{i}" for i in range(30)]) for c in "xy"] + ["something else altogether and more of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = (simhash.fold(simhash.shingle_hashes(t, 3)) for t in texts[:2])
    both = len(sets(texts[0]) & sets(texts[1]))
    assert bin(a ^ b).count("1") <= 2 and 5 * both < 4 * (len(sets(texts[0])) + len(sets(texts[1])) - both)
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == [0, 1, 2]
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()) == [0, 2]


def test_both_kinds_of_links_are_joined_at_once(spark, monkeypatch):
    """One run of components, in which a fingerprint's link and a link of shingle sets meet."""
    from factlake.llm import simhash

    base = [f"w{i}" for i in range(61)]
    x, y = (" ".join(base * 600 + [f"{c}{i}" for i in range(30)]) for c in "xy")  # alike by fingerprints alone
    texts = [x, y, y + " tail", "something else altogether and more of it", y.upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs, once = [], near_copies.connected_components
    for module in (near_copies, simhash):
        monkeypatch.setattr(module, "connected_components", lambda edges: runs.append(1) or once(edges))
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs, bits=2).collect()) == [0, 3]
    assert runs == [1]
