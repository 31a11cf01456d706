"""Near copies by the exact Jaccard similarity of their word shingles.

At similarity 0.8 two 64-bit SimHash fingerprints differ in some ten bits, so a radius
that finds such pairs leaves the ring of ``simhash`` keys of four bits or fewer, which
is a comparison of all with all. Candidates therefore come from MinHash: ``BANDS`` keys
of ``ROWS`` least hashes each, of which a pair at 0.8 shares one with chance
1 - (1 - 0.8^4)^16 = 0.9998. Every candidate pair is then decided by its whole sets of
shingles, so documents below the similarity are never linked directly.

Texts of equal shingle sets are one class (by a 64-bit hash of the set). Keys that join
the same classes are looked at once. A key's links are a spanning forest; a key with
more than ``most`` shingles is dealt out into tiles of two blocks, all of them, so that
no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm import simhash
from factlake.llm.common import checkpoint, map_texts
from factlake.llm.components import connected_components
from factlake.llm.simhash import shingle_hashes

BANDS, ROWS = 16, 4
#: Shingles of a block of classes; a task compares two blocks at most.
MOST_SHINGLES = 1_000_000


def factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
    return a | np.uint64(1), b


def least(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least hash under each permutation a * h + b."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(out, (hashes[i : i + 1024] * a + b).min(axis=1), out=out)
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def signatures(df: DataFrame, *, shingle: int, text: str, keep: tuple[str, ...], prints: bool = False) -> DataFrame:
    """Adds c, the class of the shingle set, its size n, the keys of its bands, and with ``prints`` fp, the SimHash fingerprint."""

    def make():
        import xxhash

        a, b = factors()

        def each(texts):
            c, n, keys = [], [], []
            for t in texts:
                s = shingle_set(t, shingle)
                c.append(xxhash.xxh64_intdigest(s.tobytes(), 1))
                n.append(len(s))
                bands = least(s, a, b).reshape(BANDS, ROWS) if len(s) else []
                keys.append([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(bands)])
            flat = np.array([k for x in keys for k in x], np.uint64).view(np.int64)
            at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            out = {"c": pa.array(np.array(c, np.uint64).view(np.int64)), "n": n, "keys": pa.ListArray.from_arrays(pa.array(at), pa.array(flat))}
            if prints:
                out["fp"] = pa.array(np.array([simhash.fold(shingle_hashes(t, 3)) for t in texts], np.uint64).view(np.int64))
            return out

        return each

    fields = [T.StructField("c", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return map_texts(df, text, T.StructType(fields + [T.StructField("fp", T.LongType())] * prints), make, keep)


def forest(classes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that join all classes reachable from each other at ``similarity`` or more."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    left, right, rest = [], [], np.arange(len(sets))
    mark = np.zeros(len(values), np.int32)
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            own = flat[starts[one] : starts[one] + sizes[one]]
            mark[own] = 1
            common = np.add.reduceat(mark[flat], starts)[rest]
            mark[own] = 0
            near = common >= similarity * (sizes[rest] + sizes[one] - common) - 1e-9
            if near.any():
                found, rest = rest[near], rest[~near]
                left += [int(classes[one])] * len(found)
                right += classes[found].tolist()
                queue += found.tolist()
    return left, right


def linked(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links from rows (key, tile, c, shingles) that come sorted by key and tile."""
    group, classes, sets = None, [], []

    def links() -> pa.RecordBatch:
        got = forest(np.array(classes, np.int64), sets, similarity) if len(sets) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["a", "b"])

    for b in batches:
        keys, tiles, c = (b.column(i).to_pylist() for i in range(3))
        shingles = b.column(3)
        for i, g in enumerate(zip(keys, tiles, strict=True)):
            if g != group:
                if len(sets) > 1:
                    yield links()
                group, classes, sets = g, [], []
            classes.append(c[i])
            sets.append(shingles[i].values.to_numpy())
    if len(sets) > 1:
        yield links()


def near_links(prints: DataFrame, key: DataFrame, *, shingle: int, similarity: float, most: int) -> DataFrame:
    """Spanning links (a, b) between classes of ``prints`` (__o, __t, c, n, keys) whose texts ``key`` has."""
    classes = prints.groupBy("c").agg(F.min(F.struct("__o", "__t")).alias("f"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = checkpoint(classes)
    keyed = classes.select("c", "n", F.explode("keys").alias("k"))
    groups = keyed.groupBy("k").agg(F.count("*").alias("m"), F.sum("n").alias("s"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y")).where("m > 1")
    groups = groups.groupBy("m", "x", "y").agg(F.min(F.struct("k", "s")).alias("g")).select("g.k", F.ceil(F.col("g.s") / most).cast("int").alias("blocks"))
    member = checkpoint(keyed.join(groups, "k").select("k", "blocks", "c"))
    wanted = classes.join(member.select("c").distinct(), "c", "left_semi").select("c", "f.__o", "f.__t")
    texts = key.select("__o", "__t", "__text").join(wanted, ["__o", "__t"]).dropDuplicates(["c"])

    def make():
        def each(texts):
            sets = [shingle_set(t, shingle).view(np.int64) for t in texts]
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            return {"shingles": pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))}

        return each

    found = map_texts(texts, "__text", T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))]), make, ("c",))
    own = F.pmod(F.xxhash64("c", F.lit(2)), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j).cast("long") * F.col("blocks") + F.greatest(own, j))
    dealt = member.select("k", F.explode(tiles).alias("tile"), "c").join(found, "c").select("k", "tile", "c", "shingles")
    rows = dealt.repartition("k", "tile").sortWithinPartitions("k", "tile", "c")
    return rows.mapInArrow(lambda batches: linked(batches, similarity), "a long, b long")


def fingerprint_links(prints: DataFrame, bits: int) -> DataFrame:
    """Spanning links (a, b) between classes of ``prints`` (c, fp) whose fingerprints are equal or differ in ``bits`` at most.

    A fingerprint stands for its least class, so that these links and those of ``near_links``
    are joined to components together.
    """
    classes = checkpoint(prints.groupBy("fp").agg(F.min("c").alias("least")))
    equal = prints.select("fp", "c").distinct().join(classes, "fp").where("c <> least").select(F.col("c").alias("a"), F.col("least").alias("b"))
    near = simhash.near_links(classes.select("fp"), bits=bits)
    for x in ("a", "b"):
        near = near.join(classes.withColumnRenamed("fp", x), x).drop(x).withColumnRenamed("least", f"__{x}")
    return equal.unionByName(near.select(F.col("__a").alias("a"), F.col("__b").alias("b")))


def one_of_each(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, doc: str = "doc_id", text: str = "text", most: int = MOST_SHINGLES, bits: int | None = None) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group of near copies, all columns unchanged.

    Groups are joined by links of ``similarity`` or more, and where ``bits`` are given also by
    SimHash fingerprints (three-word shingles) that differ in no more of them. Null texts and texts without
    words are one class. Of rows that share the smallest id the one of the least text
    hash stays, and of identical ones one; a null id counts as the largest.
    """
    largest = F.lit((1 << 63) - 1)
    # the row travels as one column, safe from any name in it
    key = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col(doc).cast("long"), largest).alias("__o"), F.xxhash64(F.col(text)).alias("__t"), F.col(text).alias("__text"))
    bare = key.select("__o", "__t", "__text")
    prints = checkpoint(signatures(bare, shingle=shingle, text="__text", keep=("__o", "__t"), prints=bits is not None))
    links = near_links(prints, bare, shingle=shingle, similarity=similarity, most=most)
    if bits is not None:
        links = links.unionByName(fingerprint_links(prints, bits))
    roots = connected_components(links)
    rooted = prints.select("__o", "__t", "c").join(roots.withColumnRenamed("node", "c"), "c", "left")
    first = rooted.groupBy(F.coalesce("root", "c").alias("root")).agg(F.min(F.struct("__o", "__t")).alias("f")).select("f.__o", "f.__t")
    return key.join(first, ["__o", "__t"], "left_semi").dropDuplicates(["__o", "__t"]).select("__row.*")
