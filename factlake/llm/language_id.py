"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of variable order: contexts of up to ``ORDER`` bytes,
counted on a bounded sample of labelled texts, of which those seen ``SEEN`` times or
more are kept. A byte's code length comes from the longest kept context: seen bytes
share n/(n+t) (n observations of t distinct bytes), and the escape, t/(n+t), goes to the
next shorter context among the bytes not seen here, down to a uniform code. Statistics
are frozen after training, so the share that an escape leaves to the shorter context is a
constant of the context, and code lengths are laid out in integer units: one for every
(context, byte) of the tree, one for the escape of every context. A text's exact code
length is a sum of look-ups, and the shortest code wins.

Trees of ``TOGETHER`` languages share their look-ups; of more languages one such block
after the other is scored. The model grows with the number of languages, not of texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so are
all texts if nothing was learned; ties go to the first language in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import bounded, crc_of_id, map_texts, slices

#: Labelled rows a language that are learned from, about (a sample by hash of the id).
TRAIN_ROWS = 3000
#: Bytes of the longest contexts, and how often a context of two bytes or more must occur.
ORDER, SEEN = 4, 16
#: Languages whose trees are looked up together.
TOGETHER = 16
UNIT = 4096  # steps a bit
START = 0xFF  # never occurs in UTF-8
Counts = tuple[np.ndarray, np.ndarray]


class Index:
    """Places of integer keys by open addressing, whole arrays of queries at a time."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.places = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        rest = np.arange(len(keys))
        slot = self.slots(keys)
        while len(rest):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)  # one key a free slot, the others go on
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.places[slot[won]] = keys[rest[won]], rest[won]
            lost = np.ones(len(rest), bool)
            lost[won] = False
            rest, slot = rest[lost], (slot[lost] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * self.MIX >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for unknown ones."""
        slot = self.slots(keys)
        there, out = self.keys[slot], self.places[slot]
        wrong = there != keys
        out[wrong] = -1
        wrong &= there >= 0
        rest = np.flatnonzero(wrong)
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == keys[rest]
            out[rest[hit]] = self.places[slot[hit]]
            on = ~hit & (there >= 0)
            rest, slot = rest[on], slot[on]
        return out


def grams(texts: list[bytes]) -> np.ndarray:
    """For every byte of the texts the ``ORDER`` bytes before it and itself as one integer."""
    mark = bytes([START] * ORDER)
    x = np.frombuffer(mark + mark.join(texts), np.uint8).astype(np.int64)
    key = x[ORDER:].copy()
    for i in range(1, ORDER + 1):
        key |= x[ORDER - i : len(x) - i] << (8 * i)
    return key if len(texts) < 2 else key[(key & 255) != START]


def low(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & ((1 << (8 * n)) - 1)


def summed(keys: np.ndarray, n: np.ndarray) -> Counts:
    at, back = np.unique(keys, return_inverse=True)
    return at, np.bincount(back, n, len(at)).astype(np.int64)


@dataclass
class Tree:
    """One language's kept contexts. Of each order k: keys of (context, byte), probabilities; contexts, what their escape multiplies with."""

    seen: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray) -> Tree:
        seen, escapes = [], []
        for k in range(ORDER + 1):
            own, m = summed(low(keys, k + 1), n)
            context, back = np.unique(own >> 8, return_inverse=True)
            total, kinds = np.bincount(back, m), np.bincount(back)
            kept = total >= (SEEN if k > 1 else 1)
            at = kept[back]
            own, m, back = own[at], m[at], back[at]
            # below a kept context all shorter ones are kept, for they occur as often
            lower = seen[k - 1][1][np.searchsorted(seen[k - 1][0], low(own, k))] if k else np.full(len(own), 1 / 256)
            left = 1 - np.bincount(back, lower, len(context))
            seen.append((own, m / (total + kinds)[back]))
            escapes.append((context[kept], (kinds / (total + kinds) / np.maximum(left, 1e-12))[kept]))
        return cls(seen, escapes)


def bits(p: np.ndarray) -> np.ndarray:
    return np.round(-np.log2(p) * UNIT).astype(np.int64)


class Block:
    """The trees of some languages under common look-ups, code lengths as (language, place)."""

    def __init__(self, trees: list[Tree]):
        self.seen, self.escapes, shorter = [], [], None
        for k in range(ORDER + 1):
            contexts = np.unique(np.concatenate([t.escapes[k][0] for t in trees]))
            keys = np.unique(np.concatenate([t.seen[k][0] for t in trees]))
            out = np.zeros((len(trees), len(contexts)), np.int64)
            for row, t in zip(out, trees, strict=True):
                row[np.searchsorted(contexts, t.escapes[k][0])] = bits(t.escapes[k][1])
            # a language that has not seen a byte here escapes, if it has the context, and codes it in the shorter one
            if k:
                length = shorter[1][:, np.searchsorted(shorter[0], low(keys, k))] if len(keys) else np.zeros((len(trees), 0), np.int64)
            else:
                length = np.full((len(trees), len(keys)), 8 * UNIT)
            length = length + out[:, np.searchsorted(contexts, keys >> 8)] if len(keys) else length
            for row, t in zip(length, trees, strict=True):
                row[np.searchsorted(keys, t.seen[k][0])] = bits(t.seen[k][1])
            shorter = keys, length
            self.seen.append((Index(keys), np.ascontiguousarray(length.T.astype(np.int32))))
            self.escapes.append((Index(contexts), np.ascontiguousarray(out.T.astype(np.int32))))

    def lengths(self, keys: np.ndarray) -> np.ndarray:
        """(byte, language) code lengths of contexts and bytes."""
        at = self.seen[ORDER][0].find(keys)
        out = self.seen[ORDER][1].take(at, axis=0, mode="clip") if len(self.seen[ORDER][1]) else np.zeros((len(keys), self.seen[0][1].shape[1]), np.int32)
        rest = np.flatnonzero(at < 0)
        own, out[rest] = keys[rest], 0
        for k in range(ORDER, -1, -1):
            if k < ORDER:
                own = low(own, k + 1)
                at = self.seen[k][0].find(own)
                hit = at >= 0
                out[rest[hit]] += self.seen[k][1][at[hit]]
                rest, own = rest[~hit], own[~hit]
            at = self.escapes[k][0].find(own >> 8)
            known = at >= 0
            out[rest[known]] += self.escapes[k][1][at[known]]
        out[rest] += 8 * UNIT
        return out


@dataclass
class Model:
    languages: list[str]
    blocks: list[Block]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths (texts x languages) in 1/UNIT bits; no text is empty."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for i, j in slices([len(t) for t in texts], PIECE):
            if len(texts[i]) > PIECE:  # a long text in pieces that keep their contexts
                for s in range(0, len(texts[i]), PIECE):
                    key = grams([texts[i][max(0, s - ORDER) : s + PIECE]])[min(s, ORDER) :]
                    out[i] += np.concatenate([b.lengths(key).sum(axis=0, dtype=np.int64) for b in self.blocks])
                i += 1
            if i < j:
                at, languages = np.cumsum([0, *map(len, texts[i : j - 1])]), iter(out[i:j].T)
                for lengths in map(Block.lengths, self.blocks, repeat(grams(texts[i:j]))):
                    for column in lengths.T:
                        next(languages)[:] = np.add.reduceat(column, at, dtype=np.int64)
        return out


#: Bytes whose contexts are held at once.
PIECE = 1 << 18


def build(counts: dict[str, Counts]) -> Model:
    """Freezes counts of ``grams``, by language, into trees and their look-ups."""
    languages = sorted(counts)
    trees = [Tree.of(*counts[name]) for name in languages]
    return Model(languages, [Block(trees[i : i + TOGETHER]) for i in range(0, len(trees), TOGETHER)])


def learn(docs: DataFrame, *, doc: str, text: str, lang: str, train_on, bound: int = TRAIN_ROWS) -> Model:
    """Counts contexts on about ``bound`` rows of each language and freezes them."""
    usable = docs.where(train_on(doc) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    own = usable.select(F.col(doc).alias("__d"), F.col(text).alias("__t"), F.col(lang).cast("string").alias("__l"))
    sizes = usable.groupBy(F.col(lang).cast("string").alias("l")).count()
    sizes = sizes.select("l", F.least(F.lit(1.0), bound / F.col("count")).alias("share"))
    place = F.pmod(F.xxhash64("__d", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    part = own.join(F.broadcast(sizes), own["__l"] == sizes["l"]).where(place < F.col("share"))  # one short row a language

    def count(batches):
        for b in batches:
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for l in sorted(set(langs)):
                own = [texts[i].encode() for i in np.flatnonzero(langs == l)]
                for i, j in slices([len(t) for t in own]):
                    keys, n = np.unique(grams(own[i:j]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([l] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["l", "k", "n"])

    bounded(docs.sparkSession)
    got = part.select("__t", "__l").mapInArrow(count, "l string, k long, n long").groupBy("l", "k").agg(F.sum("n").alias("n")).toArrow()
    names, keys, n = got["l"].to_pylist(), got["k"].to_numpy(), got["n"].to_numpy()
    rows: dict[str, list[int]] = {}
    for i, l in enumerate(names):
        rows.setdefault(l, []).append(i)
    return build({l: (keys[at], n[at]) for l, at in rows.items()})


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred, score (the winner's share of the likelihood), bits_per_byte of its code, and known.

    A text is known if it has a letter and some language codes it in less than the eight
    bits a byte that it takes anyway; if nothing was learned, a letter is enough.
    """

    def make():
        def each(texts):
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            known, rate = [bool(t) and any(map(str.isalpha, t)) for t in texts], [None] * len(texts)
            if model.languages and any(known):
                some = [i for i, k in enumerate(known) if k]
                data = [texts[i].encode() for i in some]
                lengths = model.lengths(data)
                best, least = lengths.argmin(axis=1), lengths.min(axis=1)
                score[some] = 1 / np.exp2(-np.minimum((lengths - least[:, None]) / UNIT, 1000)).sum(axis=1)
                for i, k, t, n in zip(some, best.tolist(), data, least.tolist(), strict=True):
                    pred[i], rate[i] = model.languages[k], n / UNIT / len(t)
                    known[i] = rate[i] < 8
            return {"lang_pred": pred, "score": score, "bits_per_byte": rate, "known": known}

        return each

    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType()), T.StructField("known", T.BooleanType())])
    return map_texts(docs, text, schema, make, keep)


def identify(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = TRAIN_ROWS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` (the id by default) with held_out and the columns of ``predict``, one row per row.

    Learns from the rows whose crc32 of the id, as text, leaves no remainder of 2 by 4.
    A row with a null id is neither held out nor learned from.
    """
    model = learn(docs, doc=doc, text=text, lang=lang, train_on=lambda c: crc_of_id(c) % 4 != 2, bound=bound)
    held = F.coalesce(crc_of_id(doc) % 4 == 2, F.lit(False))
    return predict(docs, model, text=text, keep=keep or (doc,)).select(*(keep or (doc,)), held.alias("held_out"), "lang_pred", "score", "bits_per_byte", "known")
