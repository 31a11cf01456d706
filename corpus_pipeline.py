"""A corpus pipeline: five stages, each an operator of ``factlake.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes
as Parquet and reads again as the next stage's ``docs``. All but the last return the
columns of ``documents``; other columns pass through.

* toxicity: documents scored 0.7 or more go. Learns from ``labels`` of ``sf_dir``.
* language: documents without any letter, and those that no learned language codes in fewer
  than eight bits a byte, go; the others keep their own ``lang``. Where no document has a
  language to learn from, a letter is enough.
* simhash: the document of the smallest id of each near-duplicate group stays: SimHash
  fingerprints within op3's two bits, and, as those miss most, a Jaccard similarity of 0.8 or more
  (five-word shingles).
* repeats: byte strings of 200 or more that occur twice are cut out of the texts.
* packing: pieces of at most 1024 tokens with their places in sequences.

An empty input gives an empty result at every stage. A null text scores as an empty one, has
no letter and goes in the language stage; of rows with equal ids and texts one stays in the
third stage, where a null id counts as the largest. Columns besides those of ``documents``
pass through, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import language_id, near_copies, packing, suffix_dedup, toxicity
from factlake.llm.common import stored, table
from factlake.llm.registry import tokenizer_path

#: SQL can't express trained scores and tokenizers; the stages are tested one by one.
ORACLE_SQL = None


def _carried(docs: DataFrame) -> DataFrame:
    """The columns an operator reads, and the whole row beside them, safe from any name."""
    return docs.select(F.struct("*").alias("__row"), "doc_id", "text", "lang")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(_carried(docs), table(spark, sf_dir, "labels"), keep=("__row", "doc_id"))
    return scored.where("predicted = 0").select("__row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.identify(_carried(docs), keep=("__row", "doc_id")).where("known").select("__row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs, bits=2)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.tokenise(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024)
    return packing.pack(pieces, capacity=1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("simhash", simhash_stage),
    ("repeats", repeats_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = stored(docs)
    return docs
