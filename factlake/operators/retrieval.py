"""Rankings, fusion and relevance on top of the kept index and the dense search.

Scores are rounded to six places before ranking, and every ranking is total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.text import tokens
from factlake.operators import ranks
from factlake.operators.bm25_index import Index
from factlake.operators.layout import settled


def top_k(scored: DataFrame, k: int, *by: str, score: str = "score", tie: Column) -> DataFrame:
    """Adds ``rank`` from 1 and keeps k rows a group; ties are ordered by ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def rrf(both: DataFrame, k: int, *, qid: str = "qid", doc: str = "doc_id", constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two scores of the same rows (qid, doc, sparse, dense): the k best, with ``rank``.

    Both rankings are total and are worked out by ranges, whatever a query's share of the
    rows. One of the k best has a rank of ``most`` at least in one ranking: the first k of either have
    1 / (constant + k), which two later ranks together don't reach.
    """
    most = 2 * (constant + k) - constant
    placed = ranks.placed(both, (qid,), F.desc("sparse"), doc, name="r1")
    placed = ranks.placed(placed, (qid,), F.desc("dense"), doc, name="r2").where((F.col("r1") < most) | (F.col("r2") < most))
    score = F.round(1 / (constant + 1 + F.col("r1")) + 1 / (constant + 1 + F.col("r2")), 9)
    return top_k(placed.select(qid, doc, score.alias("score")), k, qid, tie=F.asc(doc))


def containing(index: Index, docs: DataFrame, passages: DataFrame, *, doc: str = "doc_id", text: str = "text", qid: str = "qid", query: str = "query") -> DataFrame:
    """(qid, doc) of the documents that hold a passage word for word.

    A document that does has the passage's rarest word, so only those that have it are
    searched. The first and last words may be parts of longer ones there and don't count; passages
    of less than three words are found nowhere.
    """
    inner = passages.select(F.col(qid).alias("qid"), F.col(query).alias("__passage"), tokens(F.col(query)).alias("__t")).where("size(__t) >= 3")
    words = inner.select("qid", F.explode(F.slice("__t", F.lit(2), F.size("__t") - 2)).alias("term")).distinct()
    asked = index.asked(passages, qid, query).join(words, ["qid", "term"])
    rarest = settled(asked.groupBy("qid").agg(F.min(F.struct("df", "term")).alias("w")).select("qid", "w.term"))
    have = index.blocks(rarest).select("term", F.explode("postings.doc").alias(doc)).join(rarest, "term").select("qid", doc)
    near = have.join(inner.select("qid", "__passage"), "qid").join(docs.select(doc, F.col(text).alias("__text")), doc)
    return near.where(F.col("__text").contains(F.col("__passage"))).select("qid", doc)


def adaptive_k(route: Column) -> Column:
    return F.when(route == "historical", 25).when(route == "aggregation", 40).otherwise(10)
