"""Exact dense search: vectors lie in cells around pivots, and cells too far from a query are skipped.

Vectors are scaled to length 1 once. Pivots are a bounded sample of them (``PIVOTS``); every
vector belongs to the cell of its nearest pivot, and a cell has the least and the greatest angle of
its vectors to it. By the triangle inequality for angles, a query at angle a from a pivot
is no nearer to a vector of its cell than a minus the greatest, or the least minus a. Each query first
meets its nearest cells, with as many vectors as it wants results; their k-th best score then
rules out cells. What remains is multiplied in blocks of bounded size, and a block hands
back its k best of each query.

Vectors of another length than the query's are never met; zero vectors have a cosine of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.operators.layout import settled

#: Pivots at most: they and the cells' angles go to every task.
PIVOTS = 256
#: Vectors and queries of a block at most.
BLOCK = 4096
#: What rounding to six places may hide.
SLACK = 2e-6


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1.0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def pivots(vectors: DataFrame, n: int, doc: str, vec: str) -> np.ndarray:
    """Vectors of least hash: at most ``PIVOTS``, and no more than the root of their number."""
    most = min(PIVOTS, max(1, int(n**0.5)))
    rows = vectors.select(doc, vec).orderBy(F.xxhash64(doc), doc).limit(most).collect()
    return unit(np.array([r[1] for r in rows], np.float64))


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def _mapped(df: DataFrame, key: str, centres: np.ndarray, fields: list[T.StructField], each) -> DataFrame:
    """(key, vec) with unit vectors, and what ``each`` makes of their angles to the pivots."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("vec", T.ArrayType(T.DoubleType())), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(matrix(b.column(1)))
                vec = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), vec, *each(angles(x, centres))], names=schema.names)

    return df.select(key, "vec").mapInArrow(run, schema)


def cells(vectors: DataFrame, centres: np.ndarray, doc: str) -> DataFrame:
    """(doc, vec, cell, angle) of every vector."""

    def nearest(a: np.ndarray) -> list[pa.Array]:
        cell = np.argmin(a, axis=1)
        return [pa.array(cell.astype(np.int32)), pa.array(a[np.arange(len(a)), cell])]

    return _mapped(vectors, doc, centres, [T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())], nearest)


def best_possible(a: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """The greatest cosine that a vector of each cell may have for queries at angles ``a`` from the pivots."""
    return np.cos(np.maximum(0.0, np.maximum(a - greatest, least - a)))


def products(visits: DataFrame, homes: DataFrame, k: int | None, qid: str, doc: str) -> DataFrame:
    """(qid, doc, score) of queries (qid, vec, cell) and the vectors of their cells, block by block; the k best of a block, or all."""
    names = [T.StructField(qid, visits.schema[qid].dataType), T.StructField(doc, homes.schema[doc].dataType), T.StructField("score", T.DoubleType())]
    kinds = [visits.select(qid).limit(0).toArrow().schema.field(0).type, homes.select(doc).limit(0).toArrow().schema.field(0).type]

    def tile(left, right):
        q, v = matrix(left["vec"]), matrix(right["vec"])
        score = np.round(q @ v.T, 6) if len(q) and len(v) else np.zeros((len(q), len(v)))
        ids = right[doc].combine_chunks()
        if k is None or k >= len(v):
            at = np.tile(np.arange(len(v)), (len(q), 1))
        else:  # all that tie with the k-th stay, the order decides later
            least = np.partition(score, len(v) - k, axis=1)[:, len(v) - k]
            rows, at = np.nonzero(score >= least[:, None])
            return pa.table([left[qid].combine_chunks().take(pa.array(rows)), ids.take(pa.array(at)), pa.array(score[rows, at])], names=[qid, doc, "score"])
        rows = np.repeat(np.arange(len(q)), len(v))
        at = at.ravel()
        return pa.table([left[qid].combine_chunks().take(pa.array(rows)).cast(kinds[0]), ids.take(pa.array(at)).cast(kinds[1]), pa.array(score[rows, at])], names=[qid, doc, "score"])

    keys = ("cell", "block", "part")
    return visits.groupBy(*keys).cogroup(homes.groupBy(*keys)).applyInArrow(tile, T.StructType(names))


def blocked(visits: DataFrame, homes: DataFrame, sizes: DataFrame, qid: str, doc: str) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt by cell into blocks of vectors and parts of queries; each meets all of the other's."""
    asked = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    plan = sizes.join(asked, "cell").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "parts")
    plan = F.broadcast(plan)  # a row a cell, PIVOTS at most
    left = visits.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64(qid), F.col("parts"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = homes.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64(doc), F.col("blocks"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = [F.col("cell"), F.col("block").cast("int").alias("block"), F.col("part").cast("int").alias("part")]
    return left.select(qid, "vec", *keys), right.select(doc, "vec", *keys)


class Search:
    """Vectors in cells, written once, and searched by batches of queries."""

    def __init__(self, vectors: DataFrame, *, doc: str = "doc_id", vec: str = "vec"):
        self.doc = doc
        own = vectors.select(doc, F.col(vec).cast("array<double>").alias("vec")).where("size(vec) > 0 and vec is not null")
        self.n = own.count()
        self.centres = pivots(own, self.n, doc, "vec") if self.n else np.zeros((0, 1))
        dim = self.centres.shape[1]
        self.homes = settled(cells(own.where(F.size("vec") == dim), self.centres, doc))
        self.sizes = self.homes.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("greatest"))
        self.dim = dim

    def _limits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, least, greatest = (np.zeros(len(self.centres)) for _ in range(3))
        for r in self.sizes.collect():  # a row a cell, PIVOTS at most
            n[r["cell"]], least[r["cell"]], greatest[r["cell"]] = r["n"], r["least"], r["greatest"]
        return n, least, greatest

    def visits(self, queries: DataFrame, k: int, qid: str) -> tuple[DataFrame, DataFrame]:
        """Cells (qid, vec, cell, bound) that each query meets first, and the others with what they may hold at best."""
        n, least, greatest = self._limits()
        slack = 1e-7  # of angles near zero and straight ones

        def cell(a: np.ndarray) -> list[pa.Array]:
            order = np.argsort(a, axis=1, kind="stable")
            seen = np.cumsum(n[order], axis=1)
            first = np.zeros(a.shape, bool)
            np.put_along_axis(first, order, (seen - n[order] < k) & (n[order] > 0), axis=1)
            bound = best_possible(a, least[None] - slack, greatest[None] + slack)
            flat = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(a.shape[1], dtype=np.int32), len(a))), pa.array(bound.ravel()), pa.array(first.ravel()), pa.array(np.tile(n > 0, len(a)))], names=["cell", "bound", "first", "used"])
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), flat)]

        kind = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("bound", T.DoubleType()), T.StructField("first", T.BooleanType()), T.StructField("used", T.BooleanType())])
        asked = queries.select(qid, F.col("vec").cast("array<double>").alias("vec")).where(F.size("vec") == self.dim)
        got = settled(_mapped(asked, qid, self.centres, [T.StructField("cells", T.ArrayType(kind))], cell))
        rows = got.select(qid, "vec", F.explode(F.filter("cells", lambda c: c["used"])).alias("c")).select(qid, "vec", "c.cell", "c.bound", "c.first")
        return rows.where("first"), rows.where("not first")

    def top_k(self, queries: DataFrame, k: int, *, qid: str = "qid") -> DataFrame:
        """(qid, doc, score, rank) of the k nearest vectors of every query; ties by the smaller id."""
        return self.searched(queries, k, qid=qid)[0]

    def searched(self, queries: DataFrame, k: int, *, qid: str = "qid") -> tuple[DataFrame, DataFrame]:
        """The same, and the cells met (qid, cell) by all queries."""
        order = Window.partitionBy(qid).orderBy(F.desc("score"), self.doc)
        first, others = self.visits(queries, k, qid)
        near = settled(products(*blocked(first, self.homes, self.sizes, qid, self.doc), k, qid, self.doc))
        kth = near.withColumn("__r", F.row_number().over(order)).where(F.col("__r") == k).select(qid, F.col("score").alias("__kth"))
        rest = others.join(kth, qid, "left").where(F.coalesce(F.col("bound") >= F.col("__kth") - SLACK, F.lit(True))).select(qid, "vec", "cell")
        found = near.unionByName(products(*blocked(rest, self.homes, self.sizes, qid, self.doc), k, qid, self.doc))
        met = first.select(qid, "cell").unionByName(rest.select(qid, "cell"))
        return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k), met

    def all_scores(self, queries: DataFrame, *, qid: str = "qid") -> DataFrame:
        """(qid, doc, score) of every query and every vector, cell by cell."""
        first, others = self.visits(queries, 1, qid)
        return products(*blocked(first.unionByName(others), self.homes, self.sizes, qid, self.doc), None, qid, self.doc)
