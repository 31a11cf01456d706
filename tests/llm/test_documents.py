"""Operators over documents against brute force, on a table of edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from factlake.llm import language_id, masked_lm, packing, quality, sentencepiece_codec, simhash, suffix_dedup, suffix_sort, toxicity
from factlake.llm.registry import tokenizer_path

WORD = r"[^\x20\x09-\x0D]+"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def repeated_marks(data: list[bytes], length: int) -> list[bytes]:
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        out.append(bytes(mark))
    return out


def unmarked(data: bytes, mark: bytes) -> bytes:
    return bytes(x for x, m in zip(data, mark, strict=True) if not m)


def outcome(data: bytes, mark: bytes) -> tuple[int, int, int, str]:
    return len(data), sum(mark), len(re.findall(b"\1+", mark)), hashlib.sha256(unmarked(data, mark)).hexdigest()


def repeated(data: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    return [outcome(b, m) for b, m in zip(data, repeated_marks(data, length), strict=True)]


@pytest.mark.parametrize("most", [20_000, 1])
def test_suffix_dedup(docs, most):
    own = texts(docs)
    wanted = sorted([(d, *x) for (d, _), x in zip(own, repeated([(t or "").encode() for _, t in own], 200), strict=True)], key=repr)
    assert rows(suffix_dedup.dedup(docs, most=most).drop("spans")) == wanted


@pytest.mark.parametrize("most", [20_000, 1])
def test_suffix_dedup_survives_equal_class_hashes(docs, most):
    """With one bit of class hash nearly all classes hold different strings and are opened."""
    own = keyed_bytes(docs)
    wanted = Counter((d, *x) for (d, _), x in zip(own, repeated([t for _, t in own], 200), strict=True))
    data = suffix_dedup.keyed(docs, "doc_id", "text")
    spans = suffix_dedup.repeated_spans(data, most=most, class_bits=1).groupBy("d", "k").agg(F.collect_list(F.struct("s", "e")).alias("x"))
    got = Counter()
    for r in data.join(spans, ["d", "k"], "left").collect():
        raw, mark = bytes(r["__bytes"]), bytearray(len(r["__bytes"]))
        for s, e in r["x"] or ():
            mark[s:e] = b"\1" * (e - s)
        got[(r["__doc"], *outcome(raw, bytes(mark)))] += 1
    assert got == wanted


def keyed_bytes(docs):
    return [(d, (t or "").encode()) for d, t in texts(docs)]


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 70_000).astype(np.uint8).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([6]), pa.array([text], pa.binary())], names=["d", "k", "b"])
    whole = next(suffix_dedup._find(iter([batch]), 200, 64, 64)).to_pylist()
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 10_000)
    parts = [r for b in suffix_dedup._find(iter([batch]), 200, 64, 64) for r in b.to_pylist()]

    def windows(rows):
        return sorted((w, r["place"], r["ah"]) for r in rows for w in range(r["lo"], r["hi"] + 1))

    assert len(parts) > len(whole) and windows(parts) == windows(whole)


def test_suffix_dedup_removes_and_keeps_columns(docs, no_docs):
    out = suffix_dedup.remove(docs)
    assert out.columns == docs.columns
    own = texts(docs)
    cut = [None if t is None else unmarked(t.encode(), n).decode(errors="ignore") for (_, t), n in zip(own, repeated_marks([(t or "").encode() for _, t in own], 200), strict=True)]
    wanted = Counter((d, t, "x" if has else None) for (d, _), t, has in zip(own, cut, [r["__d"] for r in docs.collect()], strict=True))
    assert Counter((r["doc_id"], r["text"], r["__d"]) for r in out.collect()) == wanted
    assert all(r[c] == r["__t"] for r in out.collect() for c in ("__d", "__k", "__spans", "__rest", "__text"))
    assert suffix_dedup.dedup(no_docs).count() == 0 and suffix_dedup.remove(no_docs).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 2, 600).astype(np.uint8)
    start = rng.integers(0, 560, 200)
    length = np.minimum(rng.integers(0, 60, 200), 600 - start)
    group = np.sort(rng.integers(0, 9, 200))
    prefix = suffix_sort.Prefix(data)
    now = suffix_sort.order(prefix, start, length, group)
    key = [(group[i], bytes(data[start[i] : start[i] + length[i]])) for i in now]
    assert key == sorted(key)
    near = suffix_sort.neighbours(prefix, start, length, group, now)
    for i in range(1, 200):
        (g, a), (h, b) = key[i - 1], key[i]
        same = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert near[i] == (same if g == h else -1)


def test_sentencepiece(docs, no_docs):
    import sentencepiece as sp

    path = tokenizer_path("piece_bpe_32k.model")
    lib = sp.SentencePieceProcessor(model_file=path)
    wanted = []
    for d, t in texts(docs):
        ids = lib.encode(t or "") + [2]
        wanted.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert rows(sentencepiece_codec.encode_digest(docs, path).drop("spans_crc32")) == sorted(wanted, key=repr)
    for r in sentencepiece_codec.encode(docs, path, keep=("doc_id", "text")).collect():
        data = (r.text or "").encode()
        assert len(r.ids) == len(r.begins) == len(r.ends) and r.ends[-1] == len(data)
        assert all(a <= b for a, b in zip(r.begins, r.ends)) and all(a == b for a, b in zip(r.ends, r.begins[1:]))
    assert sentencepiece_codec.encode_digest(no_docs, path).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc"])
def test_character_map(rule):
    import sentencepiece as sp
    import sentencepiece.sentencepiece_model_pb2 as pb

    lib = sp.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    proto = pb.ModelProto()
    proto.ParseFromString(lib.serialized_model_proto())
    own = sentencepiece_codec.CharacterMap(proto.normalizer_spec.precompiled_charsmap, dummy_prefix=True, squeeze=True)
    for t in ["ﬁ ①②  ㌔ｱｲｳ é ½", "  Ａ b　c  ", "", "   ", "a\tb c"]:
        norm, origin = own.normalise(t)
        assert norm.decode() == lib.normalize(t) and len(origin) == len(norm) + 1
        assert (np.diff(origin) >= 0).all()


def fingerprint(t):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(WORD, lower)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, no_docs):
    own = sorted(texts(docs), key=lambda x: (x[0] is None, x[0] or 0))
    fps = [fingerprint(t) for _, t in own]
    comp = components(fps, 2)
    wanted = [(own[i][0], f"{fps[i]:016x}", own[comp[i]][0]) for i in range(len(own))]
    assert rows(simhash.dedup(docs)) == sorted(wanted, key=repr)
    assert simhash.dedup(no_docs).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp))


@pytest.mark.parametrize("most", [50_000, 2])
def test_simhash_links_are_complete(spark, most):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))) for c in centres for _ in range(12)} | {i for i in range(40)})
    comp = components(fps, 2)
    df = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.components(df, most=most).collect()}
    assert [got[simhash.signed(f)] for f in fps] == comp


def test_packing_matches_naive_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(60):
        cap = int(rng.integers(5, 60))
        lengths = rng.integers(1, cap + 1, int(rng.integers(0, 150))).tolist()
        bins: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = min(((r, i) for i, r in enumerate(bins) if r >= n), default=None)
            if fit:
                bins[fit[1]] -= n
            else:
                bins.append(cap - n)
        got: dict[int, list] = {}
        for n, _, count, first, each, at in packing.best_fit(Counter(lengths).items(), cap):
            for t in range(count):
                got.setdefault(first + t // each, []).append((at + t % each * n, n))
        for v in got.values():
            v.sort()
            assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))]
        assert sorted(cap - sum(n for _, n in v) for v in got.values()) == sorted(bins)


def test_ids_are_those_of_the_untouched_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib, bpe = Tokenizer.from_file(path), packing.ByteBpe(path)
    mark = "<|endoftext|>"
    odd = ["a <|endoftext|> b", mark, mark * 3, f"x{mark}{mark} y", f" {mark} ", "<|endoftext|", "it's we'LL  \n\n x\t", " " * 3_000_000, "z" * 100_000, "\0\x85\u2028\xa0a 漢字 é e\u0301 😀", "1234 5678x", "\r\n \n  a"]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(odd)] == [lib.encode(t, add_special_tokens=False).ids for t in odd]
    assert bpe.fast and bpe.encode([None, ""]) == [b"", b""]
    bpe.fast = None
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(odd[:3])] == [lib.encode(t, add_special_tokens=False).ids for t in odd[:3]]


def test_packing(docs, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    out = packing.pack(packing.tokenise(docs, path, with_ids=True)).collect()
    wanted = Counter()
    for d, t in texts(docs):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            wanted[(d, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == wanted
    bins: dict[int, list] = {}
    for r in out:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in bins.values():
        v.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[0][0] == 0 and sum(n for _, n in v) <= 1024
    assert packing.pack(packing.tokenise(no_docs, path)).count() == 0


def test_quality_measures(spark, docs, no_docs):
    wanted = []
    for d, t in texts(docs):
        w = re.findall(WORD, t or "")
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        n = len({i + k for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for k in range(5)})
        wanted.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w)))
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels)
    assert rows(out.drop("kept")) == sorted(wanted, key=repr)
    assert all(r.kept == (not r.base_failed) for r in out.collect())  # nothing can be shown from so few labels
    assert quality.judge(no_docs, labels).count() == 0


def test_binomial_bound(spark):
    from math import comb, log

    from pyspark.sql import functions as F

    for n, k, p in [(200, 0, 0.02), (200, 3, 0.02), (1000, 1, 0.002), (5000, 40, 0.01), (100, 50, 0.3)]:
        got = spark.range(1).select(quality.log_binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        exact = log(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) if k < n * p else 0.0
        assert got == pytest.approx(exact, rel=1e-9, abs=1e-9)


def test_quality_cutoffs_are_learned(spark):
    """A measure that good rows never have is cut; the same measure spread over them is not."""
    filler = " ".join(f"word{i}" for i in range(30))
    good = [(i, f"{filler} g{i}", "en") for i in range(12000)]
    bad = [(20000 + i, f"{filler} {'# ' * 40}b{i}", "en") for i in range(1500)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "IF(doc_id < 20000, 1, 0) AS quality")
    out = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert not any(out[d] for d, _, _ in bad) and all(out[d] for d, _, _ in good)


def test_toxicity(spark, docs, no_docs):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.classify(docs, empty).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert toxicity.classify(no_docs, empty).count() == 0


def test_toxicity_learns_pairs():
    """Either term alone is harmless, both together are not: only pairs can tell."""
    rng = np.random.default_rng(3)
    names = {n: toxicity.buckets(n)[0] for n in ("insult", "group")}
    plain, labels = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        noise = [toxicity.buckets(f"w{i}")[0] for i in rng.integers(0, 300, 12)]
        plain.append(np.unique([*noise, *([names["insult"]] if a else []), *([names["group"]] if b else [])]))
        labels.append(float(a and b))
    m = toxicity.train(plain, np.array(labels), epochs=30)
    f = {n: int(m.slots[b]) for n, b in names.items()}
    assert min(f.values()) >= 0
    both, one, other = m.scores([sorted(f.values()), [f["insult"]], [f["group"]]])
    assert both > 0.9 and max(one, other) < 0.3
    assert np.abs(m.vectors).max() > 0.1


def test_language(docs, no_docs):
    out = language_id.identify(docs).collect()
    own = {d: t for d, t in texts(docs)}
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in own[r.doc_id] or ""))
        assert 0 <= r.score <= 1
    assert language_id.identify(no_docs).count() == 0


def test_code_lengths_are_those_of_the_tree(monkeypatch):
    """The look-ups against the escape rule worked out one context at a time."""
    monkeypatch.setattr(language_id, "SEEN", 3)
    order, seen = language_id.ORDER, 3
    samples = {"x": b"abracadabra abba abracadabra abc abracad", "y": b"the cat sat on the mat, the hat that the cat had"}
    model = language_id.build({x: np.unique(language_id.grams([s]), return_counts=True) for x, s in samples.items()})

    def prob(sample: bytes, context: bytes, b: int) -> float:
        padded = bytes([255] * order) + sample
        after = Counter(padded[i] for i in range(order, len(padded)) if padded[i - len(context) : i] == context)
        lower = (lambda c: prob(sample, context[1:], c)) if context else (lambda c: 1 / 256)
        n, t = sum(after.values()), len(after)
        if n < (seen if len(context) > 1 else 1):
            return lower(b)
        if b in after:
            return after[b] / (n + t)
        return t / (n + t) * lower(b) / (1 - sum(map(lower, after)))

    for text in (b"abcab", b"the rat", b"zq"):
        x = bytes([255] * order) + text
        for got, sample in zip(model.lengths([text])[0], samples.values(), strict=True):
            bits = sum(-np.log2(prob(sample, x[i : i + order], x[i + order])) for i in range(len(text)))
            assert got / language_id.UNIT == pytest.approx(bits, abs=0.02)


def test_masked_lm(docs, no_docs):
    out = masked_lm.pseudo_likelihood(docs).collect()
    assert len(out) == docs.count()
    own = {d: len((t or "").encode().split()) for d, t in texts(docs)}
    for r in out:
        if r.doc_id is not None:
            assert r.n_tokens == own[r.doc_id]
        assert (r.log_prob < 0) == (r.n_tokens > 0)
    assert masked_lm.pseudo_likelihood(no_docs).count() == 0


def test_masked_lm_sees_both_sides_and_not_itself():
    rng = np.random.default_rng(4)
    v = masked_lm.Vocabulary({w: i for i, w in enumerate("abcdef")}, np.zeros(masked_lm.VOCABULARY), np.zeros(masked_lm.ENDINGS))
    lines = []
    for _ in range(1500):
        a, c = rng.choice(list("ab"), 2)
        lines.append(f"{a} {'d' if a == c else 'e'} {c}")  # the middle follows from both neighbours only
    net = masked_lm.train(lines, v, epochs=20, rate=0.2)

    def middle(line):
        got = [v.lookup(w) for w in line.split()]
        ids, cls = np.array([g[0] for g in got], np.int32), np.array([g[1] for g in got])
        return net.log_probs(masked_lm.contexts([ids]), cls)[1]

    assert middle("a d a") > -0.2 and middle("a d b") < -1.5 and middle("b e a") > -0.2
    z = net.log_probs(np.full((4, masked_lm.CLASSES), masked_lm.EDGE, np.int32), np.arange(masked_lm.CLASSES))
    assert np.exp(z).sum() == pytest.approx(1, abs=1e-4)
