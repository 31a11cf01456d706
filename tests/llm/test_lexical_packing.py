"""Lexical retrieval packing: ids of the untouched library, gapless sequences, and a naive greedy filler."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from factlake.llm import lexical_packing as L
from factlake.llm.registry import tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


@pytest.mark.parametrize("by_rank", [True, False])
def test_words_merge_as_in_the_library(by_rank):
    points = [*range(1, 0x3100), *range(0xD000, 0xD7FF, 7), *range(0xE000, 0x10000, 11), *range(0x10000, 0x20000, 41)]
    texts = [" ".join(f"Ab{chr(c)}c {chr(c)} X{chr(c)}, e{chr(c)}\u0301 don't 12{chr(c)}" for c in points[k : k + 40]) for k in range(0, len(points), 40)]
    texts += ["It's We'LL ÉCOLE, straße!? <|endoftext|>x a<|startoftext|> a\x1cb \x85 \xa0z", "İΣ ΑΣ ς", "", None, " ", "naïve... (x)", "é \u0301e", "a\u200bb\ufeffc", "a\x01b \x01"]
    rng = np.random.default_rng(1)
    alphabet = list("etaoinshrdlucmfwypvbgkjqxzéèçñóíüöäß")
    texts += [" ".join("".join(rng.choice(alphabet, rng.integers(1, 14))) + rng.choice(["", ",", "."]) for _ in range(200)) for _ in range(100)]
    words = L.WordBpe(WORDS, by_rank)
    assert words.by_words and bool(words.bulk) == by_rank
    for text, own, ids in zip(texts, words.encode(texts), whole(texts), strict=True):
        assert np.frombuffer(own, words.kind).tolist() == ids[:-1], text


def test_tokens_merge_to_themselves():
    words = L.WordBpe(WORDS)
    assert words.ranked()
    tokens = sorted(t.removesuffix(L.END) for t in words.spec["vocab"] if t.endswith(L.END) and t.removesuffix(L.END).isascii() and t.removesuffix(L.END).isalpha() and t.islower())
    ids = [x.ids for x in words.tokenizer.encode_batch(tokens, add_special_tokens=False)]
    assert [i for i, t in zip(ids, tokens, strict=True) if i != [words.spec["vocab"][t + L.END]]] == []
    rank = {("a", "b"): 0, ("b", "c"): 1, ("a", "bc"): 2}
    assert not L.merges_to_itself("abc", rank)  # ab goes first


def test_words_are_forgotten_in_time(monkeypatch):
    monkeypatch.setattr(L, "KNOWN_WORDS", 40)
    words = L.WordBpe(WORDS, True)
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}" for j in range(20)) for i in range(30)]
    for k in range(0, 30, 3):
        got = words.encode(texts[k : k + 3])
        assert [np.frombuffer(x, words.kind).tolist() for x in got] == [i[:-1] for i in whole(texts[k : k + 3])]
        assert len(words.known) <= 61  # a batch's own, and the empty word


def brute_scores(docs, query, df, n, mean):
    """BM25 of every document, term by term."""
    out = []
    for ids in docs:
        tf, total = Counter(ids), 0.0
        for t in sorted(set(query)):
            if tf[t]:
                total += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ids) / mean))
        out.append(total)
    return out


def brute_fill(docs, sizes, capacity, df, n, mean):
    """(doc, start, length, sequence, offset) by the greedy rule, without an index."""
    start = [s - s % capacity for s in sizes]
    rows, used, sequence = [], [start[d] == sizes[d] for d in range(len(docs))], 0
    for d, w in enumerate(start):
        for at in range(0, w, capacity):
            rows.append((d, at, capacity, sequence, 0))
            sequence += 1
    rest = None
    while rest is not None or not all(used):
        seed = rest if rest is not None else used.index(False)
        rest, used[seed], filled = None, True, sizes[seed] - start[seed]
        rows.append((seed, start[seed], filled, sequence, 0))
        scores = brute_scores(docs, docs[seed], df, n, mean)
        while filled < capacity and not all(used):
            d = max((d for d in range(len(docs)) if not used[d]), key=lambda d: (round(scores[d], 9), -d))
            k = min(capacity - filled, sizes[d] - start[d])
            rows.append((d, start[d], k, sequence, filled))
            used[d], start[d], filled = True, start[d] + k, filled + k
            rest = d if start[d] < sizes[d] else None
        if filled < capacity:
            break
        sequence += 1
    return rows


def test_neighbours_fill_windows_as_the_naive_rule_does():
    rng = np.random.default_rng(5)
    docs = [rng.zipf(1.3, rng.integers(0, 60)).clip(1, 299).astype(np.uint16) for _ in range(150)]
    docs += [docs[3], docs[3].copy(), rng.integers(1, 300, 170).astype(np.uint16)]
    df = np.zeros(300, np.int64)
    for ids in docs:
        df[np.unique(ids)] += 1
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    index = L.Shard(docs, L.idf(df, n), mean)
    assert np.allclose(index.scores(np.unique(docs[7])), brute_scores([d.tolist() for d in docs], docs[7].tolist(), df, n, mean))
    sizes = [len(d) + 1 for d in docs]
    filler = L.Filler(64)
    filler.shard(index, sizes)
    got = [(d, s, k, q, o) for d, s, k, q, o, _ in filler.rows]
    want = brute_fill([d.tolist() for d in docs], sizes, 64, df, n, mean)
    closed = {r[3] for r in got}
    assert sorted(got) == sorted(r for r in want if r[3] in closed)
    filler.close()
    assert sum(r[2] for r in filler.rows) == sum(sizes)


def check(rows, docs, capacity):
    ids = dict(enumerate(whole([d["text"] for d in docs])))
    by_row, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_row.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for places in sequences.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end and n > 0
            end += n
        assert end <= capacity and (end == capacity or end & (end - 1) == 0)
    want = {}
    for i, d in enumerate(docs):
        want.setdefault(d["doc_id"], []).append(ids[i])
    assert by_row.keys() == want.keys()
    for key, texts in want.items():
        if len(texts) > 1:  # repeated ids: the lengths add up
            assert sum(n for _, n, *_ in by_row[key]) == sum(map(len, texts))
            continue
        at = 0
        for start, n, crc, total in sorted(by_row[key]):
            assert start == at and total == len(texts[0])
            assert crc == zlib.crc32(np.array(texts[0][start : start + n], "<u4").tobytes())
            at += n
        assert at == len(texts[0])
    return sequences


@pytest.mark.parametrize("capacity", [4096, 128])
def test_every_id_lies_in_one_piece(docs, capacity):
    rows = L.pack(docs, WORDS, capacity=capacity).collect()
    sequences = check(rows, docs.collect(), capacity)
    tokens = sum(r["length"] for r in rows)
    assert len(sequences) <= tokens // capacity + 8 * 13


def test_no_documents(no_docs):
    out = L.pack(no_docs, WORDS)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "score"]
    assert out.count() == 0


def test_documents_alike_share_windows(spark):
    """Copies and texts on one subject come together, whatever the order of the table."""
    rng = np.random.default_rng(3)
    subjects = [[f"{chr(97 + s)}{chr(97 + w % 26)}{chr(97 + w // 26)}{chr(97 + w % 7)}" for w in range(60)] for s in range(12)]
    rows = [(i, " ".join(rng.choice(subjects[i % 12], 150))) for i in range(600)]
    rows += [(10_000 + i, rows[0][1]) for i in range(200)]
    out = L.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), WORDS, capacity=1024).collect()
    held = {}
    for r in out:
        held.setdefault(r["sequence_id"], []).append(0 if r["doc_id"] >= 10_000 else r["doc_id"] % 12)
    alike = sum(Counter(s).most_common(1)[0][1] for s in held.values()) / sum(map(len, held.values()))
    assert alike > 0.7  # by chance about a third
