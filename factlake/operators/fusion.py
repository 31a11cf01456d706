"""Exact reciprocal-rank fusion of dense and sparse scores, with no pair of a query and a document shuffled.

Vectors lie in blocks, queries in parts, and each block meets each part twice. First it hands back
its best of both scores. One of the k best documents has a rank below ``most`` in one of the
rankings: the first k of either have 1 / (constant + k), which two later ranks don't reach together. So the best
``most`` of either score are candidates; the blocks then count the vectors ahead of each candidate in
either order, and the counts add up to its ranks.

A document is its vector beside its sparse sums, one number a passage; a query without a passage, and
a document without a text, has sums of 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.operators.bm25_scan import Batch
from factlake.operators.dense import Search, matrix, unit
from factlake.operators.layout import settled
from factlake.operators.retrieval import top_k

#: Vectors of a block and queries of a part at most, about; queries whose products are held at once.
BLOCK, PART, AT_ONCE = 16384, 512, 32
#: Steps of a score, which has six places.
PLACES = 1_000_000


def _scores(queries: pa.Table, block: pa.Table):
    """For each query its place, and the dense and sparse steps of the block's vectors, by id."""
    vectors, sums = matrix(block["vec"]), block["sums"].combine_chunks()
    wide = max((len(s) for s in (sums[i].as_py() for i in range(len(sums))) if s), default=0) // 8
    sparse = np.zeros((len(block), wide), np.int64)
    for i in range(len(sums) if wide else 0):
        if s := sums[i].as_py():
            sparse[i] = np.frombuffer(s, np.int64)
    asked, columns = unit(matrix(queries["vec"])), queries["column"].to_pylist()
    none = np.zeros(len(block), np.int64)
    for a in range(0, len(asked), AT_ONCE):
        dense = np.rint(np.round(asked[a : a + AT_ONCE] @ vectors.T, 6) * PLACES).astype(np.int64)
        for i, row in enumerate(dense, a):
            yield i, row, np.ascontiguousarray(sparse[:, columns[i]]) if columns[i] is not None and wide else none


def _best(most: int, qid: str, doc: str, kinds: list[pa.DataType]):
    def tile(queries: pa.Table, block: pa.Table) -> pa.Table:
        rows = ([], [], [], [])
        if len(queries) and len(block):
            block = block.sort_by(doc)
            n = len(block)
            for i, dense, sparse in _scores(queries, block):
                firsts = [np.arange(n) if n <= most else np.argpartition(np.arange(n) - s * n, most - 1)[:most] for s in (dense, sparse)]
                at = np.unique(np.concatenate(firsts))
                for out, x in zip(rows, (np.full(len(at), i), at, dense[at], sparse[at]), strict=True):
                    out.append(x)
        i, at, dense, sparse = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in rows)
        ids = [t[c].combine_chunks().take(pa.array(x)).cast(k) if len(x) else pa.array([], k) for t, c, x, k in ((queries, qid, i, kinds[0]), (block, doc, at, kinds[1]))]
        return pa.table([*ids, pa.array(dense), pa.array(sparse)], names=[qid, doc, "dense", "sparse"])

    return tile


def _ahead(qid: str, doc: str, kinds: list[pa.DataType]):
    def tile(queries: pa.Table, block: pa.Table) -> pa.Table:
        names, docs, counts = [], [], ([], [])
        if len(queries) and len(block):
            block = block.sort_by(doc)
            n, ids = len(block), block[doc].to_numpy()
            candidates, own = queries["candidates"], queries[qid]
            for i, *scores in _scores(queries, block):
                c = candidates[i].values.flatten()  # doc, dense, sparse
                c = [x.to_numpy(zero_copy_only=False) for x in c]
                before = np.searchsorted(ids, c[0])
                for out, of_block, of_c in zip(counts, scores, c[1:], strict=True):
                    key = before - of_c * n
                    order = np.argsort(key)
                    at = np.searchsorted(key[order], np.arange(n) - of_block * n, side="right")
                    ahead = np.empty(len(key), np.int64)
                    ahead[order] = np.cumsum(np.bincount(at, minlength=len(key) + 1))[: len(key)]
                    out.append(ahead)
                docs.append(c[0])
                names += [own[i].as_py()] * len(c[0])
        whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, *counts)]
        return pa.table([pa.array(names, kinds[0]), pa.array(whole[0]).cast(kinds[1]), pa.array(whole[1]), pa.array(whole[2])], names=[qid, doc, "r2", "r1"])

    return tile


def fused(search: Search, asked: DataFrame, batch: Batch | None, k: int, *, qid: str = "qid", constant: int = 60) -> DataFrame:
    """(qid, doc, score, rank) of the k best by 1 / (constant + sparse rank) + 1 / (constant + dense rank); ties by id. Ids are whole numbers."""
    spark, doc, most = asked.sparkSession, search.doc, 2 * (constant + k) - constant
    kinds = [x.limit(0).toArrow().schema.field(0).type for x in (asked.select(qid), search.homes.select(doc))]
    homes = search.homes.select(doc, "vec")
    if batch:
        ends = homes.agg(F.min(doc), F.max(doc)).first()  # documents beyond the vectors' ids take no part
        homes = homes.join(batch.by_document(*ends).select(F.col("doc").alias(doc), "sums"), doc, "left")
        place = spark.createDataFrame([(q, i) for i, q in enumerate(batch.qids.to_pylist())], T.StructType([T.StructField(qid, asked.schema[qid].dataType), T.StructField("column", T.IntegerType())]))
        asked = asked.join(F.broadcast(place), qid, "left")
    else:
        homes, asked = homes.withColumn("sums", F.lit(None).cast("binary")), asked.withColumn("column", F.lit(None).cast("int"))
    queries = settled(asked.select(qid, "column", F.col("vec").cast("array<double>").alias("vec")).where(F.size("vec") == search.dim))
    blocks, parts = -(-max(1, search.n) // BLOCK), -(-max(1, queries.count()) // PART)
    own = F.pmod(F.xxhash64(doc), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    right = settled(homes.withColumn("block", own[0])).select(doc, "vec", "sums", "block", own[1])

    def met(left: DataFrame, tile, *names: str) -> DataFrame:
        dealt = left.withColumn("part", F.pmod(F.xxhash64(qid), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        schema = T.StructType([T.StructField(qid, queries.schema[qid].dataType), T.StructField(doc, search.homes.schema[doc].dataType), *[T.StructField(c, T.LongType()) for c in names]])
        return dealt.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(tile, schema)

    best = met(queries, _best(most, qid, doc, kinds), "dense", "sparse")
    for c in ("dense", "sparse"):
        best = best.withColumn(f"__{c}", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc(c), doc)))
    # a query's candidates are 2 * most at most
    chosen = best.where((F.col("__dense") <= most) | (F.col("__sparse") <= most)).groupBy(qid).agg(F.collect_list(F.struct(doc, "dense", "sparse")).alias("candidates"))
    placed = met(queries.join(chosen, qid), _ahead(qid, doc, kinds), "r2", "r1").groupBy(qid, doc).agg(F.sum("r1").alias("r1"), F.sum("r2").alias("r2"))
    score = F.round(1 / (constant + 1 + F.col("r1")) + 1 / (constant + 1 + F.col("r2")), 9)
    return top_k(placed.select(qid, doc, score.alias("score")), k, qid, tie=F.asc(doc))
