"""Document scores by masked pseudo-likelihood of a bidirectional window network.

Every word is predicted from the two words on either side, never from itself; a
document's score is the sum of the conditional log-probabilities. The network looks
each context word up in a table of its position, adds and squashes them, and gives a
softmax over word classes; a word's share of its class comes from counts over the
whole corpus:

* the ``SINGLES`` most frequent words are classes of their own, all others fall into
  ``ENDINGS`` classes by a hash of their last two characters;
* the most frequent words, ``VOCABULARY`` at least and more with the square root of the
  number of documents, have their exact share of their class and a place in the tables;
* the other words of a class are of two kinds, told for every word of the corpus: those
  that some other document has too, and those that stand in one document alone, which
  nothing but the document itself vouches for. Each kind shares its part evenly.

The network learns from every document; a caller may ask for a share by hash
(``TRAIN_SHARE``, say, of a small corpus ``TRAIN_DOCS`` texts). They are dealt into parts of about ``PART_DOCS``; each part
trains in numpy from the same start, and weights are averaged by how often they were used.

Defined cases: null and empty texts and texts without words have no tokens and score
0; rows of equal id and text count as one document; places beyond either end are a word of their own; an empty corpus scores nothing.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import checkpoint, map_texts

VOCABULARY, SINGLES, ENDINGS = 4096, 64, 64
CLASSES = SINGLES + ENDINGS
HIDDEN = 32
#: Share of the documents of ``learned_from`` unless another is asked for, texts at least, and texts of a part.
TRAIN_SHARE, TRAIN_DOCS, PART_DOCS = 0.05, 1500, 4000
#: Steps of a part, and the least and most words of a step.
STEPS, BATCHES = 512, (1024, 2048)
#: Places around a word that predict it.
WINDOW = (-2, -1, 1, 2)
#: Input ids: the edge, the endings, then the words of the vocabulary.
EDGE, FIRST_WORD = 0, 1 + ENDINGS


def ending(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % ENDINGS


def words(text: str | None) -> list[str]:
    return [w.decode() for w in text.encode().split()] if text else []


@dataclass
class Vocabulary:
    ids: dict[str, int]
    log_share: np.ndarray  # of a vocabulary word in its class
    log_other: np.ndarray  # of any other word in its class that several documents have
    log_once: np.ndarray | None = None  # of one that a single document has

    @property
    def inputs(self) -> int:
        return FIRST_WORD + len(self.log_share)

    @property
    def code_type(self) -> type:
        return np.uint16 if self.inputs <= 1 << 16 else np.int32

    def by_code(self) -> tuple[np.ndarray, np.ndarray]:
        """Class and log of the share of every input id, as ``lookup`` gives them."""
        classes = np.concatenate([[0], SINGLES + np.arange(ENDINGS), np.zeros(len(self.log_share))]).astype(np.int32)
        for w in self.ids:
            i, c, _ = self.lookup(w)
            classes[i] = c
        return classes, np.concatenate([[0.0], self.log_other, self.log_share])

    def lookup(self, word: str) -> tuple[int, int, float]:
        """(input id, class, log of the share in the class)."""
        i, e = self.ids.get(word), ending(word)
        if i is None:
            return 1 + e, SINGLES + e, float(self.log_other[e])
        return FIRST_WORD + i, i if i < SINGLES else SINGLES + e, float(self.log_share[i])


def most_frequent(counts: DataFrame, k: int) -> list:
    """The k rows of largest n, by words on ties.

    Counts are first cut at a power of two that leaves k words or more: a plain ordered
    limit would send k rows of every partition to the driver.
    """
    by_bits = sorted(((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("n")).cast("int")).count().collect()), reverse=True)  # 64 rows at most
    have, least = 0, 0
    for bits, words_ in by_bits:
        have, least = have + words_, bits
        if have >= k:
            break
    return counts.where(F.floor(F.log2("n")) >= least).orderBy(F.desc("n"), "w").limit(k).collect()


def vocabulary_size(n_docs: int) -> int:
    return max(VOCABULARY, int(16 * n_docs**0.5))


def word_counts(docs: DataFrame, *, doc: str, text: str) -> DataFrame:
    """(w, n, a, b): occurrences of every word of the corpus, and the least and largest hash of the documents that have it."""
    spaces = r"[\x20\x09-\x0D]+"
    # texts are hashed below the explode, or each would be hashed again for every word
    own = docs.select(row_hash(doc, text).alias("r"), F.split(F.coalesce(F.col(text), F.lit("")), spaces).alias("ws"))
    tokens = own.select("r", F.explode("ws").alias("w")).where("w <> ''")
    return checkpoint(tokens.groupBy("w").agg(F.count("*").alias("n"), F.min("r").alias("a"), F.max("r").alias("b")))


def row_hash(doc: str, text: str) -> F.Column:
    return F.xxhash64(F.col(doc), F.col(text))


def end_of_word() -> F.Column:
    return (F.crc32(F.encode(F.substring("w", -2, 2), "UTF-8")) % ENDINGS).cast("int")


def vocabulary_of(counts: DataFrame, size: int = VOCABULARY) -> Vocabulary:
    """The ``size`` most frequent words of ``word_counts`` and the shares of all."""
    by_end = counts.groupBy(end_of_word().alias("e"), (F.col("a") == F.col("b")).alias("once")).agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    top = most_frequent(counts, size)
    tokens, types = np.zeros((2, ENDINGS)), np.zeros((2, ENDINGS))
    for e, once, n, t in by_end.collect():  # two rows an ending at most
        tokens[int(once), e], types[int(once), e] = n, t
    totals, ids, share = tokens.sum(axis=0), {}, np.zeros(size)
    for i, (w, n, a, b) in enumerate(top):  # words of the vocabulary leave the others
        ids[w] = i
        tokens[int(a == b), ending(w)] -= n
        types[int(a == b), ending(w)] -= 1
        if i < SINGLES:
            totals[ending(w)] -= n
    for i, (w, n, *_) in enumerate(top[SINGLES:], SINGLES):
        share[i] = np.log(n / totals[ending(w)])
    # one more word of each kind and ending stands for all that the corpus doesn't have
    log_other, log_once = np.log((tokens + 1) / (totals + 2)) - np.log(types + 1)
    return Vocabulary(ids, share, log_other, log_once)


@dataclass
class Network:
    tables: np.ndarray  # place in the window, input id, hidden
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def hidden(self, context: np.ndarray) -> np.ndarray:
        z = self.tables[0].take(context[0], axis=0)
        z += self.bias
        for p in range(1, len(WINDOW)):
            z += self.tables[p].take(context[p], axis=0)
        return np.tanh(z, out=z)

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probabilities of the target classes, context as (places, tokens)."""
        out, ones = np.empty(len(target)), np.ones(CLASSES, np.float32)
        for a in range(0, len(target), 1024):  # a block stays in the processor's cache
            s = slice(a, a + 1024)
            z = self.logits(self.hidden(context[:, s]))
            own = z[np.arange(len(z)), target[s]]
            out[s] = own - np.log(np.exp(z, out=z) @ ones)
        return out

    def logits(self, h: np.ndarray) -> np.ndarray:
        """Of the classes, less the largest of a word where the exponential could overflow."""
        z = h @ self.out
        z += self.out_bias
        if (np.abs(self.out).sum(axis=0) + np.abs(self.out_bias)).max() > 60:  # no hidden value is above 1
            z -= z.max(axis=1, keepdims=True)
        return z


def contexts(ids: list[np.ndarray]) -> np.ndarray:
    """(places, tokens) of the words around each word; documents never mix."""
    return windows(np.concatenate(ids), np.array([len(x) for x in ids]))


def windows(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``contexts`` of documents laid end to end."""
    row = np.full(len(flat) + 2 * len(sizes) + 2, EDGE, np.int32)
    at = np.arange(len(flat)) + np.repeat(2 * np.arange(1, len(sizes) + 1), sizes)
    row[at] = flat
    return np.stack([row[at + p] for p in WINDOW])


class Codes(dict):
    """Input ids of words, worked out once a word; ``of`` empties it when it holds many."""

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000):
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, word: bytes) -> int:
        self[word] = code = self.vocabulary.lookup(word.decode())[0]
        return code

    def of(self, text: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        return np.array(list(map(self.__getitem__, text.encode().split())), self.vocabulary.code_type).tobytes()


def encoded(docs: DataFrame, vocabulary: Vocabulary, *, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` with ``codes``, the input ids of a text's words as bytes; null for a null text."""

    def make():
        codes = Codes(vocabulary)
        return lambda texts: {"codes": [None if t is None else codes.of(t) for t in texts]}

    return map_texts(docs, text, T.StructType([T.StructField("codes", T.BinaryType())]), make, keep)


def start(inputs: int, seed: int) -> Network:
    rng, f = np.random.default_rng(seed), np.float32
    return Network(rng.normal(0, 0.1, (len(WINDOW), inputs, HIDDEN)).astype(f), np.zeros(HIDDEN, f), rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(f), np.zeros(CLASSES, f))


def places(codes: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; contexts, target classes and shares of all words."""
    flat, (classes, shares) = np.frombuffer(b"".join(codes), vocabulary.code_type), vocabulary.by_code()
    sizes = np.array([len(x) for x in codes], np.int64) // flat.itemsize
    return sizes, windows(flat, sizes), classes[flat], shares[flat]


def train(texts: list[str], vocabulary: Vocabulary, *, epochs: int = 1, batch: int | None = None, rate: float = 0.1, seed: int = 5) -> Network:
    codes = Codes(vocabulary)
    _, context, target, _ = places(sorted(codes.of(t) for t in texts), vocabulary)
    return fit(context, target, vocabulary.inputs, epochs=epochs, batch=batch, rate=rate, seed=seed)


def fit(context: np.ndarray, target: np.ndarray, inputs: int, *, epochs: int = 1, batch: int | None = None, rate: float = 0.1, seed: int = 5) -> Network:
    """A network that has seen every place ``epochs`` times, ``batch`` of them a step: by default some ``STEPS`` steps an epoch of
    ``BATCHES`` places. ``rate`` is that of a step of the least size and grows with the root of the size."""
    net, rng, f = start(inputs, seed), np.random.default_rng(seed + 1), np.float32
    ones, slot, columns, rows = np.ones(CLASSES, f), np.zeros(inputs, np.int64), np.arange(HIDDEN), np.ascontiguousarray(context.T)
    if not len(target):
        return net
    batch = batch or int(np.clip(len(target) // STEPS, *BATCHES))
    rate *= (batch / BATCHES[0]) ** 0.5
    net.out_bias[:] = np.log((np.bincount(target, minlength=CLASSES) + 1) / (len(target) + CLASSES))
    sums = [np.full_like(x, 1e-6) for x in (net.tables, net.bias, net.out, net.out_bias)]

    def move(x, s, g):
        s += g * g
        x -= rate * g / np.sqrt(s)

    for _ in range(epochs):
        order = rng.permutation(len(target))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            c, y = np.ascontiguousarray(rows.take(some, axis=0).T), target[some]
            h = net.hidden(c)
            g = net.logits(h)
            np.exp(g, out=g)
            g *= 1 / (len(y) * (g @ ones))[:, None]
            g[np.arange(len(y)), y] -= f(1 / len(y))
            dh = g @ net.out.T
            dh *= 1 - h * h
            move(net.out, sums[2], h.T @ g)
            move(net.out_bias, sums[3], g.sum(axis=0))
            move(net.bias, sums[1], dh.sum(axis=0))
            weights = dh.ravel().astype(np.float64)
            for p in range(len(WINDOW)):  # sums of dh by input id
                hit = np.flatnonzero(np.bincount(c[p], minlength=inputs))
                slot[hit] = np.arange(len(hit)) * HIDDEN
                d = np.bincount((slot[c[p]][:, None] + columns).ravel(), weights).astype(f).reshape(-1, HIDDEN)
                s = sums[0][p].take(hit, axis=0)
                s += d * d
                sums[0][p][hit] = s
                d *= rate
                d /= np.sqrt(s, out=s)
                net.tables[p][hit] -= d
    return net


def train_in_parts(docs: DataFrame, vocabulary: Vocabulary, parts: int, *, text: str = "text", codes: str | None = None, by: str | None = None, seed: int = 5) -> Network:
    """One network a part of ``docs``, averaged; what comes to the driver is one network.

    ``codes`` names the column of ``encoded`` texts if they are there already, ``by`` the one that rows are dealt by.
    """

    def run(batches):
        some = sorted(x for b in batches for x in b.column(0).to_pylist() if x)
        _, context, target, _ = places(some, vocabulary)
        if not len(target):
            return
        net, all_ = fit(context, target, vocabulary.inputs, seed=seed), len(target)
        blocks = [(net.tables[p], np.bincount(context[p], minlength=vocabulary.inputs)) for p in range(len(WINDOW))]
        blocks += [(x.reshape(-1, HIDDEN), None) for x in (net.bias, net.out.T, net.out_bias)]
        for k, (x, used) in enumerate(blocks):
            used = np.full(len(x), all_) if used is None else used
            at = np.flatnonzero(used)
            values = [pa.array(x[at, j].astype(np.float64) * used[at]) for j in range(HIDDEN)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(used[at].astype(np.int64)), *values], names=names)

    names = ["k", "r", "n", *(f"v{j}" for j in range(HIDDEN))]
    schema = "k int, r int, n long, " + ", ".join(f"{c} double" for c in names[3:])
    if codes is None:
        docs, codes = encoded(docs, vocabulary, text=text, keep=()), "codes"
    dealt = docs.repartition(parts, F.xxhash64(F.col(by or codes), F.lit(seed))).select(codes)
    got = dealt.mapInArrow(run, schema).groupBy("k", "r").agg(*[F.sum(c).alias(c) for c in names[2:]]).toArrow()
    net = start(vocabulary.inputs, seed)
    k, r, n = (got[c].to_numpy() for c in names[:3])
    mean = np.stack([got[c].to_numpy() / n for c in names[3:]], axis=1).astype(np.float32) if len(n) else np.zeros((0, HIDDEN), np.float32)
    for i, x in enumerate([*net.tables, net.bias.reshape(-1, HIDDEN), net.out.T, net.out_bias.reshape(-1, HIDDEN)]):
        x[r[k == i]] = mean[k == i]
    return net


def score(docs: DataFrame, vocabulary: Vocabulary, net: Network, *, codes: str = "codes", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds n_tokens, log_prob (natural, summed) and mean_log_prob to ``encoded`` texts."""

    def make():
        def each(texts):
            sizes, context, target, share = places([x or b"" for x in texts], vocabulary)
            sums, some = np.zeros(len(sizes)), np.flatnonzero(sizes)
            if len(some):
                sums[some] = np.add.reduceat(net.log_probs(context, target) + share, np.cumsum(sizes[some]) - sizes[some])
            return {"n_tokens": sizes, "log_prob": sums, "mean_log_prob": sums / np.maximum(sizes, 1)}

        return each

    schema = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("mean_log_prob", T.DoubleType())])
    return map_texts(docs, codes, schema, make, keep)


def learned_from(docs: DataFrame, *, doc: str, text: str, n: int, bound: int = TRAIN_DOCS, share: float = TRAIN_SHARE) -> DataFrame:
    """The documents of least hash: ``share`` of ``n``, or about ``bound`` of a small corpus."""
    part = min(1.0, max(share, bound / max(n, 1)))
    place = F.pmod(F.xxhash64(F.col(doc), F.lit(42)), F.lit(1 << 40))
    return docs.where(F.col(text).isNotNull() & (place < int(part * (1 << 40))))


def alone(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(r, n_alone, lost): for each document with such words how many words no other document has, outside the vocabulary, and what they lower its score by."""
    known = docs.sparkSession.createDataFrame([(w,) for w in vocabulary.ids], "w string")  # as large as the vocabulary that every task holds
    lost = F.array(*[F.lit(float(x)) for x in vocabulary.log_once - vocabulary.log_other])
    own = counts.where("a = b").join(F.broadcast(known), "w", "left_anti")
    return own.groupBy(F.col("a").alias("__r")).agg(F.count("*").alias("n_alone"), F.sum(F.col("n") * F.get(lost, end_of_word())).alias("__lost"))


def pseudo_likelihood(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", bound: int = TRAIN_DOCS, share: float = 1.0, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` (the id by default) with n_tokens, log_prob, mean_log_prob and n_alone, the distinct words outside the vocabulary that no other document has."""
    n = docs.where(F.col(text).isNotNull()).count()
    counts = word_counts(docs, doc=doc, text=text)
    vocabulary = vocabulary_of(counts, vocabulary_size(n))
    parts = -(-max(bound, int(share * n)) // PART_DOCS)
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep or (doc,)]).alias("__keep"), F.col(doc).alias("__d"), row_hash(doc, text).alias("__r"), F.col(text).alias("__t"))
    # words are looked up once, for the network and for the scores
    coded = checkpoint(encoded(own, vocabulary, text="__t", keep=("__keep", "__d", "__r")))
    net = train_in_parts(learned_from(coded, doc="__d", text="codes", n=n, bound=bound, share=share), vocabulary, parts, codes="codes", by="__r")
    scored = score(coded, vocabulary, net, keep=("__keep", "__r")).join(alone(docs, counts, vocabulary), "__r", "left")
    log_prob = F.col("log_prob") + F.coalesce("__lost", F.lit(0.0))
    return scored.select("__keep.*", "n_tokens", log_prob.alias("log_prob"), (log_prob / F.greatest("n_tokens", F.lit(1))).alias("mean_log_prob"), F.coalesce("n_alone", F.lit(0)).cast("long").alias("n_alone"))
