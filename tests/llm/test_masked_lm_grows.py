"""What the masked network gathers follows the corpus, and its parts are averaged."""

from collections import Counter

import numpy as np

from factlake.llm import masked_lm


def test_texts_and_vocabulary_follow_the_corpus(spark):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('word', id) AS text")
    few = masked_lm.learned_from(docs, doc="doc_id", text="text", n=60_000).count()
    assert 2700 < few < 3300  # a share, more than the 1,500 there were
    assert masked_lm.vocabulary_size(1_000_000) == 2 * masked_lm.vocabulary_size(250_000) > masked_lm.VOCABULARY
    # words beyond the 4,096 most frequent have places of their own
    v = masked_lm.vocabulary_of(masked_lm.word_counts(docs, doc="doc_id", text="text"), 6000)
    assert len({v.lookup(w)[0] for w in v.ids}) == 6000 and v.inputs == masked_lm.FIRST_WORD + 6000


def test_parts_are_averaged(spark):
    rng = np.random.default_rng(6)
    v = masked_lm.Vocabulary({w: i for i, w in enumerate("abcde")}, np.zeros(10), np.zeros(masked_lm.ENDINGS))
    lines = [" ".join(rng.choice(list("abcde"), 12)) for _ in range(300)]
    docs = spark.createDataFrame([(t,) for t in lines], "text string")
    one, whole = masked_lm.train_in_parts(docs, v, 1), masked_lm.train(sorted(lines), v)
    for x, y in zip((one.tables, one.bias, one.out, one.out_bias), (whole.tables, whole.bias, whole.out, whole.out_bias), strict=True):
        assert np.allclose(x, y, atol=1e-5)
    three = masked_lm.train_in_parts(docs, v, 3)
    assert np.isfinite(three.tables).all() and not np.allclose(three.out, whole.out, atol=1e-5)


def test_scores_are_those_of_loops_over_words(spark, monkeypatch):
    """Counts, shares, network and sums worked out one word at a time; copies are vouched for, lone words are not."""
    monkeypatch.setattr(masked_lm, "VOCABULARY", 80)
    rng = np.random.default_rng(3)
    often = [f"{a}{b}{c}" for a in "kl" for b in "aeiou" for c in "mnrst"]
    texts = [" ".join(rng.choice(often, 15)) + " " + " ".join(f"z{rng.integers(1 << 30)}q" for _ in range(5)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate([*texts, texts[0], texts[0], "", None, " \n "])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in masked_lm.pseudo_likelihood(docs).collect()}
    words = {i: (t or "").split() for i, t in rows}
    n, where = Counter(w for x in words.values() for w in x), {}
    for i, x in words.items():
        for w in x:
            where.setdefault(w, set()).add(i)
    counts = masked_lm.word_counts(docs, doc="doc_id", text="text")
    v = masked_lm.vocabulary_of(counts, masked_lm.vocabulary_size(44))
    assert list(v.ids) == sorted(n, key=lambda w: (-n[w], w))[:106]
    net = masked_lm.train_in_parts(masked_lm.learned_from(docs, doc="doc_id", text="text", n=44), v, 1)
    single = list(v.ids)[: masked_lm.SINGLES]
    for i, x in words.items():
        total, lone = 0.0, {w for w in x if w not in v.ids and len(where[w]) == 1}
        for k, w in enumerate(x):
            around = [v.lookup(x[k + p])[0] if 0 <= k + p < len(x) else masked_lm.EDGE for p in masked_lm.WINDOW]
            h = np.tanh(net.bias + sum(net.tables[p][j] for p, j in enumerate(around)))
            z = h @ net.out + net.out_bias
            total += z[v.lookup(w)[1]] - np.log(np.exp(z).sum())
            if w not in single:
                same = [y for y in n if y not in single and masked_lm.ending(y) == masked_lm.ending(w)]
                mass = sum(n[y] for y in same)
                if w in v.ids:
                    total += np.log(n[w] / mass)
                else:
                    kind = [y for y in same if y not in v.ids and (len(where[y]) == 1) == (w in lone)]
                    total += np.log((sum(n[y] for y in kind) + 1) / (mass + 2) / (len(kind) + 1))
        assert abs(out[i].log_prob - total) < 1e-3 and out[i].n_alone == len(lone) and out[i].n_tokens == len(x)
    assert out[0].n_alone == out[40].n_alone == 0 and min(out[i].n_alone for i in range(1, 40)) >= 1
    assert out[0].mean_log_prob > np.mean([out[i].mean_log_prob for i in range(1, 40)])


def test_the_network_learns_from_every_document(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "TRAIN_DOCS", 0)
    seen = []
    whole = masked_lm.train_in_parts
    monkeypatch.setattr(masked_lm, "train_in_parts", lambda docs, *a, **k: seen.append(docs.count()) or whole(docs, *a, **k))
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('word ', id % 50, ' again') AS text")
    assert masked_lm.pseudo_likelihood(docs, bound=0).count() == 2000 and seen == [2000]


def test_words_are_looked_up_once_and_copies_are_dealt_out(spark, monkeypatch):
    """Scores and network read the same stored codes; equal texts of different ids don't meet in one part."""
    texts = ["one two three two", None, "", "é ends \0 here", *["the very same text"] * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v = masked_lm.Vocabulary({w: i for i, w in enumerate(["two", "text"])}, np.zeros(2), np.zeros(masked_lm.ENDINGS))
    got = {r.doc_id: r.codes for r in masked_lm.encoded(docs, v, text="text", keep=("doc_id",)).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else [v.lookup(w)[0] for w in t.split()]
        assert want == (None if got[i] is None else np.frombuffer(got[i], v.code_type).tolist())
    seen, whole = [], masked_lm.train_in_parts

    def watched(docs, vocabulary, parts, **k):
        seen.append(docs.repartition(8, k["by"]).rdd.glom().map(len).collect())
        return whole(docs, vocabulary, parts, **k)

    monkeypatch.setattr(masked_lm, "train_in_parts", watched)
    assert masked_lm.pseudo_likelihood(docs).count() == len(texts) and max(seen[0]) < 120


def test_steps_are_those_of_plain_sums():
    """A step's gradients by input id against np.add.at."""
    rng = np.random.default_rng(2)
    context, target = rng.integers(0, 50, (4, 900)).astype(np.int32), rng.integers(0, masked_lm.CLASSES, 900)
    net, old = masked_lm.fit(context, target, 50), masked_lm.start(50, 5)
    old.out_bias[:] = np.log((np.bincount(target, minlength=masked_lm.CLASSES) + 1) / (900 + masked_lm.CLASSES))
    h = old.hidden(context)
    g = np.exp(h @ old.out + old.out_bias)
    g /= g.sum(axis=1, keepdims=True)
    g[np.arange(900), target] -= 1
    out = old.out.copy()
    d = h.T @ g / 900
    out -= 0.1 * d / np.sqrt(1e-6 + d * d)
    dh = (g / 900 @ old.out.T) * (1 - h * h)
    for p in range(4):
        d = np.zeros((50, masked_lm.HIDDEN))
        np.add.at(d, context[p], dh)
        assert np.allclose(net.tables[p], old.tables[p] - 0.1 * d / np.sqrt(1e-6 + d * d), atol=2e-3)
    assert np.allclose(net.out, out, atol=2e-3)
