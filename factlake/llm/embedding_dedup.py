"""Exact linking of near vectors by int8 tile products with error bounds.

Each unit vector x is quantised to q (int8) with its own scale s; the rest
e = x - s*q has a known length. For two vectors, |x.y - s_x s_y q_x.q_y| is at most
|s_x q_x| |e_y| + |e_x| |s_y q_y| + |e_x| |e_y|, so one product of small integers
tells for nearly all pairs that they are below the threshold; only the others are
computed again in double precision. The integers are multiplied as single-precision
floats, which is exact: sums stay below 2**24 for up to 1,040 dimensions, and longer
vectors are multiplied in parts.

Rows of one length are dealt by hash into blocks of a bounded size, in rows and in
bytes, and every pair of blocks is one task's tile; a tile hands back, for each of its vectors with a link, the number of
links and one link to a smaller representative (a spanning forest), never all pairs.
Every tile is computed, so the products grow with the square of the number of distinct
vectors; a row is sent to as many tiles as there are blocks.

Defined cases: vectors that are null, empty, zero or hold a null or a non-finite
component link with nothing and are their own component; vectors of different lengths
do not link; equal vectors are one class, counted as often as they occur. A null id
gets a null component, and identical rows count as different vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import checkpoint, dealt_join
from factlake.llm.components import connected_components

#: Classes in a block and bytes of their components as doubles, about; a tile holds two blocks.
BLOCK, BLOCK_BYTES = 8192, 16 << 20
#: Rows and columns of one product inside a tile.
STRIPE = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and upper bounds of the lengths of s*q and of the rest."""
    top = np.abs(x).max(axis=1)
    scale = np.where(top > 0, top / 127, 1.0)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = scale[:, None] * q
    slack = 1 + 1e-12
    return q, scale, np.linalg.norm(near, axis=1) * slack, np.linalg.norm(x - near, axis=1) * slack + 1e-15


def integer_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 matrices, exactly: float32 products of up to 1,040 columns, summed as doubles if there are more."""
    wide, out = a.shape[1] > 1040, None
    for k in range(0, a.shape[1], 1040):
        part = a[:, k : k + 1040].astype(np.float32) @ b[:, k : k + 1040].astype(np.float32).T
        part = part.astype(np.float64) if wide else part
        out = part if out is None else out + part
    return out


def above(x: np.ndarray, y: np.ndarray, lx, ly, qx, qy, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the pairs with cosine >= threshold; lx and ly are squared lengths."""
    q1, s1, n1, e1 = qx
    q2, s2, n2, e2 = qy
    # s1 s2 q + n1 e2 + e1 (n2 + e2) >= t, divided by s1 s2 to compare exact integers
    product = integer_product(q1, q2)
    least = (threshold - 1e-9 - n1[:, None] * e2 - e1[:, None] * (n2 + e2)) / (s1[:, None] * s2)
    if product.dtype == np.float32:  # rounded down, never up
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
    i, j = np.nonzero(product >= least)
    if len(i):
        near = np.empty(len(i), bool)
        for a in range(0, len(i), 8192):
            p, q = i[a : a + 8192], j[a : a + 8192]
            near[a : a + 8192] = np.einsum("ij,ij->i", x[p], y[q]) >= threshold * np.sqrt(lx[p] * ly[q])
        i, j = i[near], j[near]
    return i, j


def tile(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and column numbers of linked pairs, stripe by stripe, each pair once."""
    lx, ly = (np.einsum("ij,ij->i", v, v) for v in (x, y))
    qx, qy = quantise(x / np.sqrt(lx)[:, None]), quantise(y / np.sqrt(ly)[:, None])
    for a in range(0, len(x), STRIPE):
        sa = slice(a, a + STRIPE)
        for b in range(a if same else 0, len(y), STRIPE):
            sb = slice(b, b + STRIPE)
            i, j = above(x[sa], y[sb], lx[sa], ly[sb], [v[sa] for v in qx], [v[sb] for v in qy], threshold)
            i, j = i + a, j + b
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, exactly, so that the largest component is between a half and one."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -e[:, None])


def links_in_tile(rows: pa.Table, same: bool, threshold: float) -> pa.Table:
    """Counts and spanning links (a, b, k) of one block, or of a pair of blocks, from columns side, c, n and v."""
    rows = rows.sort_by([("side", "ascending"), ("c", "ascending")]).combine_chunks()
    c, n, side = (rows[x].to_numpy() for x in ("c", "n", "side"))
    v = rows["v"].chunk(0) if rows["v"].num_chunks else pa.array([], rows["v"].type)
    x = scaled(v.flatten().to_numpy().astype(np.float64).reshape(len(c), -1)) if len(c) else np.zeros((0, 1))
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    y = one if same else two
    links = np.zeros(len(c), np.int64)
    parent = np.arange(len(c))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    left, right = [], []
    for i, j in tile(x[one], x[y], same, threshold) if len(one) and len(y) else ():
        i, j = one[i], y[j]
        links += np.bincount(i, n[j], len(c)).astype(np.int64) + np.bincount(j, n[i], len(c)).astype(np.int64)
        while len(i):  # join one link of each row at a time, then drop what that has joined
            _, first = np.unique(i, return_index=True)
            for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    left.append(c[a])
                    right.append(c[b])
            label = parent.copy()
            while (label != label[label]).any():
                label = label[label]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
    hit = np.flatnonzero(links)
    columns = (np.concatenate([c[hit], np.array(left, np.int64)]), np.concatenate([np.full(len(hit), -1, np.int64), np.array(right, np.int64)]), np.concatenate([links[hit], np.zeros(len(left), np.int64)]))
    return pa.table({name: pa.array(v) for name, v in zip("abk", columns, strict=True)})


def dedup(df: DataFrame, *, threshold: float = 0.95, vec: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec, n_links, component_id, kept), one row per row of ``df``."""
    single = isinstance(getattr(df.schema[vector].dataType, "elementType", None), T.FloatType)  # half the bytes, the same numbers
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < math.inf), F.lit(False))) & F.exists(v, lambda e: e != 0), F.lit(False))
    rows = df.select(F.col(vec).alias("id"), F.when(usable, v).alias("v"))
    # the class of a vector is the hash of its components; minus zero counts as zero
    plain = F.transform("v", lambda e: e.cast("double") + F.lit(0.0))
    rows = checkpoint(rows.withColumn("h", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.transform(plain, lambda e: e.cast("string"))), 256))))
    classes = rows.where("h is not null").groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("v").alias("v"))
    classes = classes.withColumn("c", F.monotonically_increasing_id()).withColumn("dim", F.size("v"))
    classes = checkpoint(classes)
    # smaller blocks for a small table, so that there are as many tiles as shuffle partitions
    some = math.ceil(math.sqrt(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows_each = F.least(F.lit(block), F.floor(BLOCK_BYTES / (8 * F.col("dim"))), F.greatest(F.lit(256), F.ceil(F.col("m") / some)))
    blocks = F.ceil(F.col("m") / F.greatest(F.lit(1), rows_each)).cast("int")
    widths = checkpoint(classes.groupBy("dim").agg(F.count("*").alias("m")).withColumn("blocks", blocks))
    dealt = dealt_join(classes, widths, ["dim"], "m", classes.count(), ("h",)).withColumn("blk", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    partner = F.sequence(F.lit(0), F.col("blocks") - 1)
    spread = dealt.select("dim", "c", "n", "v", "blk", F.explode(partner).alias("other"))
    spread = spread.select("dim", "c", "n", "v", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), (F.col("blk") > F.col("other")).cast("int").alias("side"))

    def links(key, rows):
        return links_in_tile(rows, key[1].as_py() == key[2].as_py(), threshold)

    found = spread.groupBy("dim", "i", "j").applyInArrow(links, "a long, b long, k long")
    found = checkpoint(found)
    counts = found.where("k > 0").groupBy("a").agg(F.sum("k").alias("k")).withColumnRenamed("a", "c")
    roots = connected_components(found.where("k = 0").select("a", "b")).withColumnRenamed("node", "c")
    rooted = classes.select("c", "h", "n", "least").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    full = rooted.join(least, "root").join(counts, "c", "left").select("h", (F.coalesce("k", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "h").join(full, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(vec), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
