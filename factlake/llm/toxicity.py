"""Toxicity scores by a factorization machine over hashed terms.

Terms are the words of a text and their first four and five letters (so that the
endings of a stem share what is learned), lower-cased and hashed into ``2**BITS`` buckets; each counts once a text. The machine adds a weight for each
bucket and the inner product of two short vectors for each pair, so that two terms
together can tell what neither tells alone. It is trained in numpy by AdaGrad on a
bounded sample of labelled rows; buckets are chosen by their chi-square against the
label. The model has a fixed size and goes to the tasks with the function.

Defined cases: null and empty texts, and texts without known terms, get the score of
the bias alone; labels other than 0 and 1 are ignored; without labelled rows of both
classes every score is the share of toxic rows (0.5 without any).
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import checkpoint, crc_of_id, hashed_sample, map_texts

BITS = 20
#: Labelled rows that are learned from, at most (a sample by hash of the id).
TRAIN_ROWS = 24_000
#: Buckets kept, and how many texts of the sample must have them.
FEATURES, LEAST_TEXTS = 4096, 4
RANK = 4
WORD = re.compile(r"[^\W\d_]+")


def buckets(word: str) -> tuple[int, int, int]:
    mask = (1 << BITS) - 1
    return zlib.crc32(word.encode()) & mask, zlib.crc32(b"4" + word[:4].encode()) & mask, zlib.crc32(b"5" + word[:5].encode()) & mask


def terms(text: str | None) -> set[int]:
    out: set[int] = set()
    for w in set(WORD.findall((text or "").lower())):
        out.update(buckets(w))
    return out


@dataclass
class Machine:
    bias: float
    slots: np.ndarray  # bucket -> feature, or -1
    weight: np.ndarray
    vectors: np.ndarray

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """Probabilities for rows of features, each feature once a row."""
        out = np.full(len(rows), self.bias)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        if sizes.any():
            flat = np.fromiter((f for r in rows for f in r), np.int64, int(sizes.sum()))
            full = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[full]
            v = self.vectors[flat]
            pairs = 0.5 * (np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v * v, starts)).sum(axis=1)
            out[full] += np.add.reduceat(self.weight[flat], starts) + pairs
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def choose(buckets_: np.ndarray, seen: np.ndarray, toxic: np.ndarray, n: int, p: float) -> np.ndarray:
    """At most ``FEATURES`` of the buckets, those of largest chi-square against the label."""
    if not 0 < p < 1:
        return buckets_[:0]
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where((seen >= LEAST_TEXTS) & (seen < n), (toxic - seen * p) ** 2 / (seen * p * (1 - p) * (1 - seen / n)), 0)
    best = np.lexsort((buckets_, -chi))[:FEATURES]
    return np.sort(buckets_[best[chi[best] > 3.84]])


def train(rows: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray | None = None, *, epochs: int = 12, rate: float = 0.15, shrink: float = 2e-4, batch: int = 256, seed: int = 7, positive: float = 3.0) -> Machine:
    """Fits a machine to rows of distinct buckets with labels 0 and 1.

    Rows of label 1 weigh ``positive`` times as much, so that one telling term is enough.
    """
    share = float(labels.mean()) if len(labels) else 0.5
    slots = np.full(1 << BITS, -1, np.int32)
    if len(labels) == 0 or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Machine(float(np.log(share / (1 - share))), slots, np.zeros(1), np.zeros((1, RANK)))
    n, p = len(rows), share
    if chosen is None:
        flat = np.concatenate(rows)
        every = np.unique(flat)
        chosen = choose(every, *(np.bincount(flat, w, 1 << BITS)[every] for w in (None, np.repeat(labels, [len(r) for r in rows]))), n, p)
    slots[chosen] = np.arange(len(chosen))
    kept = [m[m >= 0] for m in (slots[r] for r in rows)]
    mapped = np.concatenate(kept)
    first = np.cumsum([0, *map(len, kept)])
    rng = np.random.default_rng(seed)
    k = max(1, len(chosen))
    bias, w, v = float(np.log(p / (1 - p))), np.zeros(k), rng.normal(0, 0.01, (k, RANK))
    gb, gw, gv = 1e-6, np.full(k, 1e-6), np.full((k, RANK), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            some = order[a : a + batch]
            lengths = first[some + 1] - first[some]
            at = np.repeat(first[some] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            f, r = mapped[at], np.repeat(np.arange(len(some)), lengths)
            vf = v[f]
            sums = np.stack([np.bincount(r, vf[:, j], len(some)) for j in range(RANK)], axis=1)
            z = bias + np.bincount(r, w[f], len(some)) + 0.5 * ((sums**2).sum(1) - np.bincount(r, (vf * vf).sum(1), len(some)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) * np.where(labels[some] == 1, positive, 1.0) / len(some)
            gr = g[r]
            dw = np.bincount(f, gr, k)
            dv = np.stack([np.bincount(f, gr * (sums[r, j] - vf[:, j]), k) for j in range(RANK)], axis=1)
            hit = np.unique(f)
            dw[hit] += shrink * w[hit]
            dv[hit] += shrink * v[hit]
            gb, gw, gv = gb + g.sum() ** 2, gw + dw**2, gv + dv**2
            bias -= rate * g.sum() / np.sqrt(gb)
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
    return Machine(bias, slots, w, v)


def sample_rows(docs: DataFrame, labels: DataFrame, *, doc: str, text: str, label: str, train_on, bound: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Chosen buckets of each of at most ``bound`` labelled rows, their labels, and the choice.

    Buckets are counted and chosen before rows come to the driver: it gets one count for
    each bucket (``2**BITS`` at most) and the few chosen ones of each row.
    """
    own = labels.select(F.col(doc), F.col(label).cast("int").alias("__y")).where(F.col("__y").isin(0, 1)).where(train_on(doc))
    own = hashed_sample(own.groupBy(doc).agg(F.max("__y").alias("__y")), doc, bound)
    rows = own.join(docs.select(F.col(doc), F.col(text).alias("__t")).where(train_on(doc)), doc)

    def make():
        return lambda texts: {"__terms": [list(terms(t)) for t in texts]}

    schema = T.StructType([T.StructField("__terms", T.ArrayType(T.IntegerType()))])
    got = checkpoint(map_texts(rows, "__t", schema, make, (doc, "__y")))
    n, toxic = got.agg(F.count("*"), F.coalesce(F.sum("__y"), F.lit(0))).first()
    counts = got.select("__y", F.explode("__terms").alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.sum("__y").alias("y")).where(F.col("n") >= LEAST_TEXTS).toArrow()
    chosen = choose(*(counts[c].to_numpy().astype(t) for c, t in (("b", np.int64), ("n", float), ("y", float))), n, toxic / max(n, 1))
    known = np.zeros(1 << BITS, bool)
    known[chosen] = True

    def keep(batches):
        for batch in batches:
            y, lists = batch.column(0), batch.column(1)
            offsets, values = lists.offsets.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
            hit = known[values]
            ends = np.concatenate([[0], np.cumsum(hit)])[offsets - offsets[0]]
            yield pa.RecordBatch.from_arrays([y, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[hit], pa.int32()))], names=["y", "f"])

    # in the order of the ids, so that training takes the same steps each time
    small = got.orderBy(doc, F.xxhash64("__terms")).select("__y", "__terms").mapInArrow(keep, "y int, f array<int>").collect()
    return [np.array(r.f, np.int64) for r in small], np.array([r.y for r in small], float), chosen


def score(docs: DataFrame, machine: Machine, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``score``, the probability of label 1."""

    def make():
        table: dict[str, tuple[int, ...]] = {}
        slots = machine.slots

        def features(t: str | None) -> list[int]:
            out: set[int] = set()
            for w in set(WORD.findall(t.lower())) if t else ():
                got = table.get(w)
                if got is None:
                    if len(table) > 300_000:
                        table.clear()
                    got = table[w] = tuple(int(slots[b]) for b in buckets(w) if slots[b] >= 0)
                if got:
                    out.update(got)
            return sorted(out)

        return lambda texts: {"score": machine.scores([features(t) for t in texts])}

    return map_texts(docs, text, T.StructType([T.StructField("score", T.DoubleType())]), make, keep)


def classify(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7, bound: int = TRAIN_ROWS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` (the id by default) with held_out, score and predicted, one row per row.

    Learns from the rows whose crc32 of the id, as text, leaves no remainder of 1 by 3.
    A null id is not held out and has no label.
    """

    def train_on(c):
        return crc_of_id(c) % 3 != 1

    machine = train(*sample_rows(docs, labels, doc=doc, text=text, label=label, train_on=train_on, bound=bound))
    scored = score(docs, machine, text=text, keep=keep or (doc,))
    held = F.coalesce(crc_of_id(doc) % 3 == 1, F.lit(False))
    return scored.select(*(keep or (doc,)), held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
