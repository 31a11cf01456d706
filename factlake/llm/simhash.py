"""SimHash fingerprints and exact linking of near ones by the pigeonring principle.

A fingerprint is cut into a ring of ``segments`` parts. If two differ in at most t
bits, some part starts a chain whose every prefix of l parts differs in at most
l*t/segments bits. The first parts of the chain, for which that budget is below one,
must be equal: they are the join key (two of five parts, 25 or 26 bits, for two
bits). Fingerprints of a key are then tested against the budgets of the longer
prefixes, and only survivors get the full Hamming check.

Equal fingerprints are one class. A key's links are returned as a spanning forest,
so a large group costs as many rows as it has members, and classes are joined to
components from the forests. A key with more than ``most`` classes is dealt out
further by its third part, once for each bit that may differ there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import checkpoint, map_texts
from factlake.llm.components import connected_components

#: Classes of one key that a task links at once; larger keys are dealt out further.
MOST_IN_KEY = 50_000


def shingle_hashes(text: str | None, size: int) -> list[int]:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z, and the ASCII white space
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(b" ".join(words), 42)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [h(line[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def fold(hashes: list[int]) -> int:
    """Bits set in over half of the hashes; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(n, 8)
    for a in range(0, n, 4096):
        counts += np.unpackbits(raw[a : a + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(df: DataFrame, *, shingle: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``fp``, the 64 bits as a signed long. Null and empty texts have zero."""

    def make():
        def each(texts):
            bits = np.array([fold(shingle_hashes(t, shingle)) for t in texts], np.uint64)
            return {"fp": pa.array(bits.view(np.int64))}

        return each

    return map_texts(df, text, T.StructType([T.StructField("fp", T.LongType())]), make, keep)


class Ring:
    """The parts of a 64-bit fingerprint and the budgets of chains of them."""

    def __init__(self, segments: int, bits: int):
        edges = [round(64 * i / segments) for i in range(segments + 1)]
        self.m, self.bits = segments, bits
        self.parts = [(a, b - a) for a, b in zip(edges, edges[1:])]
        self.budget = [length * bits // segments for length in range(segments + 1)]
        #: Parts of a chain that must be equal.
        self.equal = max(length for length in range(1, segments) if self.budget[length] == 0)

    def chain(self, start: int, length: int) -> list[int]:
        return [(start + j) % self.m for j in range(length)]

    def mask(self, parts: list[int]) -> int:
        return sum(((1 << n) - 1) << a for a, n in (self.parts[p] for p in parts))

    def passes(self, start: int, diff: np.ndarray) -> np.ndarray:
        """Where the chain from ``start`` keeps its budgets and the whole keeps ``bits``.

        A start of ``segments`` or more also numbers a blanked bit of the third part.
        """
        start, ok = start % self.m, np.ones(len(diff), bool)
        for length in range(self.equal, self.m + 1):
            ok &= np.bitwise_count(diff & np.uint64(self.mask(self.chain(start, length)))) <= self.budget[length]
        return ok


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(ring: Ring, start: int, fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join all fingerprints of a key that are reachable from each other in it."""
    left, right, rest = [], [], fps
    while len(rest) > 1:
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = ring.passes(start, rest ^ one)
            if near.any():
                found, rest = rest[near], rest[~near]
                left += [int(one[0])] * len(found)
                right += found.tolist()
                queue += [found[i : i + 1] for i in range(len(found))]
    return left, right


def linked(ring: Ring, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (start, key, fp) that come sorted by start and key."""
    held: list[np.ndarray] = []

    def links(start, key, fp) -> pa.RecordBatch:
        edge = np.flatnonzero((np.diff(start) != 0) | (np.diff(key) != 0)) + 1
        first = np.concatenate([[0], edge, [len(fp)]])
        size = np.diff(first)
        left, right = [], []
        small = np.repeat(size, size)
        for lag in range(1, int(min(32, size.max(initial=0)))):  # keys of up to 32: all pairs at a distance, at once
            same = (start[lag:] == start[:-lag]) & (key[lag:] == key[:-lag]) & (small[lag:] <= 32)
            at = np.flatnonzero(same)
            for s in range(ring.m):
                own = at[start[at] % ring.m == s]
                hit = own[ring.passes(s, fp[own] ^ fp[own + lag])]
                left += fp[hit].tolist()
                right += fp[hit + lag].tolist()
        for k in np.flatnonzero(size > 32).tolist():
            got = forest(ring, int(start[first[k]]), fp[first[k] : first[k + 1]])
            left += got[0]
            right += got[1]
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (left, right)], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        new[2] = new[2].view(np.uint64)
        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if held:
        yield links(*held)


def near_links(classes: DataFrame, *, bits: int = 2, segments: int = 5, most: int = MOST_IN_KEY) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints at ``bits`` or fewer differing bits."""
    ring = Ring(segments, bits)

    def shift(parts):
        return F.array(*[F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(signed(ring.mask(ring.chain(s, parts))))).alias("key")) for s in range(ring.m)])

    keyed = classes.select("fp", F.explode(shift(ring.equal)).alias("__k")).select("__k.start", "__k.key", "fp")
    hot = keyed.groupBy("start", "key").count().where(F.col("count") > most).drop("count")
    plain = keyed.join(hot, ["start", "key"], "left_anti")
    further = []
    for s in range(ring.m):
        a, n = ring.parts[ring.chain(s, ring.equal + 1)[-1]]
        whole = ring.mask(ring.chain(s, ring.equal + 1))
        # the next part differs in one bit at most: blank each of its bits in turn
        further.append(F.array(*[F.struct(F.lit(s + ring.m * (j + 1)).alias("start"), F.col("fp").bitwiseAND(F.lit(signed(whole & ~(1 << (a + j))))).alias("key")) for j in range(n)]))
    dealt = keyed.join(hot, ["start", "key"], "left_semi")
    choose = F.element_at(F.array(*[F.when(F.col("start") == s, x) for s, x in enumerate(further)]), F.col("start") + 1)
    dealt = dealt.select("fp", F.explode(choose).alias("__k")).select("__k.start", "__k.key", "fp")
    rows = plain.unionByName(dealt).repartition("start", "key").sortWithinPartitions("start", "key", "fp")

    return rows.mapInArrow(lambda batches: linked(ring, batches), "a long, b long")


def components(prints: DataFrame, *, doc: str = "doc_id", bits: int = 2, segments: int = 5, most: int = MOST_IN_KEY) -> DataFrame:
    """(fp, component_id): for each fingerprint the smallest ``doc`` reachable by links."""
    classes = checkpoint(prints.groupBy("fp").agg(F.min(doc).alias("__least")))
    roots = connected_components(near_links(classes.select("fp"), bits=bits, segments=segments, most=most))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("__least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def dedup(df: DataFrame, *, shingle: int = 3, bits: int = 2, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fingerprint, component_id), one row per row of ``df``.

    Null or empty texts and texts without words have fingerprint zero and are linked
    like any other. Rows with the same id keep their own fingerprints; a null id never
    is the smallest unless its whole component has none.
    """
    prints = checkpoint(fingerprints(df, shingle=shingle, text=text, keep=(doc,)))
    found = components(prints, doc=doc, bits=bits)
    return prints.join(found, "fp").select(doc, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, shingle: int = 3, bits: int = 2, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, all columns unchanged.

    Of rows that share that id the one of the least text hash stays, and of identical
    ones one; a null id counts as the largest.
    """
    largest = F.lit((1 << 63) - 1)
    # the row travels as one column, safe from any name in it
    key = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col(doc).cast("long"), largest).alias("__o"), F.xxhash64(F.col(text)).alias("__t"), F.col(text).alias("__text"))
    prints = checkpoint(fingerprints(key.select("__o", "__t", "__text"), shingle=shingle, text="__text", keep=("__o", "__t")))
    found = components(prints, doc="__o", bits=bits)
    first = prints.join(found, "fp").groupBy("component_id").agg(F.min(F.struct("__o", "__t")).alias("f")).select("f.__o", "f.__t")
    return key.join(first, ["__o", "__t"], "left_semi").dropDuplicates(["__o", "__t"]).select("__row.*")
