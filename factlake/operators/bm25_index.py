"""A kept BM25 index: postings in blocks by impact, appended to by batches, searched with score bounds.

``path`` holds, in a folder a batch:

* ``blocks``: up to ``BLOCK`` postings of a term in one row, best impact first, with the
  block's largest frequency and least length, in folders by a hash of the term;
* ``sizes``: documents, those with a text, and tokens. It is written last; a batch without it does not exist.

Weights aren't stored: with every batch the statistics of the whole collection change, and
the bounds with them. ``top_k`` is exact:

1. The blocks of greatest bound give each query its first candidates; the k-th best of
   their sums so far is a threshold that no result may fall below.
2. Terms whose greatest weights together stay below a share of it (``TRAILING``) find no document by
   themselves. Of the others, a block is read only if its bound and the other terms' reach the threshold.
3. The sums found so far raise the threshold. A document that stays below it with the most that unread
   blocks and terms can add is dropped; what the rest have in all blocks is summed.

So what is shuffled are the postings of few documents, not of all that share a word.

If some weight can be negative (a collection so small that the mean idf is), sums have no
such bounds and every document that shares a term is scored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.functions.text import tokens
from factlake.operators.layout import settled, shared_folder, spread

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Steps of a summed weight: sums don't depend on the order of terms.
STEPS = 1_000_000_000
#: Postings of a block, and folders that the blocks are dealt to by term.
BLOCK, FOLDERS = 128, 64
#: Documents of a batch beyond which a folder's postings are dealt to more tasks.
SHARE_DOCS = 1 << 20
#: Blocks that give a query its first threshold.
FIRST_BLOCKS = 8
#: The share of the threshold that terms which find nothing by themselves may reach together: the less,
#: the more postings are read and the fewer documents are left to score.
TRAILING = 0.3
#: Query terms of a batch that are sent to every task; more of them are joined by shuffling.
MOST_TERMS = 200_000
#: Postings of a batch's terms up to which all are summed: bounds take passes of their own, which cost more than that.
PLAIN_POSTINGS = 100_000_000
#: What rounding to six places may hide.
SLACK = 2e-6


def weight(idf: Column, tf: Column, dl: Column, mean: float) -> Column:
    """Weight of a term in a document; grows with tf, falls with dl."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean or 1.0)))


def steps(w: Column) -> Column:
    return F.round(w * STEPS).cast("long")


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """The batches that were written whole, in the order of writing."""
        fs, make = self._fs(), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if not fs.exists(make(f"{self.path}/sizes")):
            return []
        found = [s.getPath() for s in fs.listStatus(make(f"{self.path}/sizes"))]
        return sorted(p.getName().removeprefix("batch=") for p in found if fs.exists(make(p, "_SUCCESS")))

    def append(self, docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> Index:
        """Adds documents with ids that the index doesn't have yet; earlier batches stay untouched."""
        batch = f"batch=b{len(self.batches()):06d}_{uuid.uuid4().hex[:8]}"
        n, texts = docs.agg(F.count("*"), F.count(text)).first()
        own = spread(docs.select(F.col(doc).alias("doc"), text), "doc").select("doc", tokens(F.col(text)).alias("__t")).withColumn("dl", F.size("__t"))
        # words of a document are counted where it lies: they are dealt by document already
        words = own.select("doc", "dl", F.explode("__t").alias("term")).groupBy("term", "doc", "dl").agg(F.count("*").alias("tf"))
        # a folder's share of the documents is a task: a term of most documents is many tasks' work
        keys = ("folder", "share")
        words = words.withColumn("folder", folder(F.col("term"))).withColumn("share", F.pmod(F.xxhash64("doc"), F.lit(1 + n // SHARE_DOCS))).repartition(*keys)
        impact = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / 100))
        place = F.row_number().over(Window.partitionBy(*keys, "term").orderBy(impact.desc(), "doc")) - 1
        blocks = words.withColumn("block", F.floor(place / BLOCK)).groupBy(*keys, "term", "block").agg(
            F.count("*").alias("n"), F.sum("tf").alias("tokens"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.collect_list(F.struct("doc", "tf", "dl")).alias("postings"))
        blocks = blocks.withColumn("block", F.xxhash64(F.lit(batch), "term", "share", "block")).drop("share")
        blocks.sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{self.path}/blocks/{batch}")
        held = self.spark.read.parquet(f"{self.path}/blocks/{batch}").agg(F.lit(n).cast("long").alias("docs"), F.lit(texts).cast("long").alias("texts"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))
        held.write.parquet(f"{self.path}/sizes/{batch}")
        self.__dict__.pop("_stats", None)
        return self

    def part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("batch").isin(self.batches())).drop("batch")

    def stats(self) -> tuple[int, float, float]:
        """Documents, mean length, and the mean idf of the vocabulary."""
        if "_stats" not in self.__dict__:
            docs, texts, total = self.part("sizes").agg(F.sum("docs"), F.sum("texts"), F.sum("tokens")).first()
            mean = self.part("blocks").groupBy("term").agg(F.sum("n").alias("df")).agg(F.avg(raw_idf(F.col("df"), docs))).first()[0]
            self._stats = (docs, total / max(texts, 1), mean or 0.0)
        return self._stats

    def asked(self, queries: DataFrame, qid: str, query: str) -> DataFrame:
        """(qid, term, qtf, idf) of the queries' terms that the index has."""
        docs, _, floor = self.stats()
        terms = queries.select(F.col(qid).alias("qid"), F.explode(tokens(F.col(query))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
        df = self.part("blocks").select("term", "n").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        raw = raw_idf(F.col("df"), docs)
        return settled(terms.join(df, "term").select("qid", "term", "qtf", F.when(raw < 0, FLOOR * floor).otherwise(raw).alias("idf"), "df"))

    def blocks(self, asked: DataFrame) -> DataFrame:
        """The blocks of the terms asked for, each once; other folders aren't read."""
        terms = asked.select("term").distinct()
        folders = [r[0] for r in asked.select(folder(F.col("term")).alias("f")).distinct().collect()]  # FOLDERS at most
        few = terms.count() <= MOST_TERMS
        return self.part("blocks").where(F.col("folder").isin(folders)).join(F.broadcast(terms) if few else terms, "term", "left_semi")

    @staticmethod
    def _postings(blocks: DataFrame) -> DataFrame:
        """The postings of blocks, one a row."""
        keep = [c for c in blocks.columns if c not in ("postings", "n", "tokens", "max_tf", "min_dl", "folder")]
        return blocks.select(*keep, F.explode("postings").alias("p")).select(*keep, "p.*")

    def scores(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """(qid, doc, score) of the given (qid, doc) pairs: their terms are looked up among the postings of the terms asked for."""
        wanted = pairs.join(asked.select("qid", "term", "qtf", "idf"), "qid")
        return self._summed(self._postings(self.blocks(asked)).select("term", "doc", "tf", "dl").join(wanted, ["term", "doc"]), self.stats()[1])

    @staticmethod
    def _summed(hit: DataFrame, mean: float) -> DataFrame:
        return hit.groupBy("qid", "doc").agg(F.round(F.sum(F.col("qtf") * steps(weight(F.col("idf"), F.col("tf"), F.col("dl"), mean))) / STEPS, 6).alias("score"))

    def all_scores(self, queries: DataFrame, *, qid: str = "qid", query: str = "query") -> DataFrame:
        """(qid, doc, score) of every document that shares a term with the query."""
        return self._every(self.asked(queries, qid, query))

    def _every(self, asked: DataFrame) -> DataFrame:
        own = F.broadcast(asked) if asked.count() <= MOST_TERMS else asked
        return self._summed(self._postings(self.blocks(asked)).select("term", "doc", "tf", "dl").join(own, "term"), self.stats()[1])

    def candidates(self, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(qid, doc) pairs that hold the k best of every query, and per query the work:
        postings of its terms, postings read, documents left to score."""
        mean, blocks = self.stats()[1], self.blocks(asked)
        if asked.where("idf < 0").count():
            pairs = self._postings(blocks).select("term", "doc").join(asked, "term").select("qid", "doc").distinct()
            n = asked.groupBy("qid").agg(F.sum("df").alias("postings"))
            return pairs, n.withColumn("read", F.col("postings")).join(pairs.groupBy("qid").agg(F.count("*").alias("scored")), "qid", "left")
        # heads: blocks without their postings, once a term however many queries ask for it
        unit = weight(F.lit(1.0), F.col("max_tf"), F.col("min_dl"), mean)
        heads = settled(blocks.select("term", "block", "n", unit.alias("unit")))
        bound = F.col("qtf") * F.col("idf") * F.col("unit")

        def kth(found: DataFrame) -> DataFrame:
            """(qid, least): the k-th best sum; no row where fewer documents have been seen."""
            best = Window.partitionBy("qid").orderBy(F.desc("low"))
            return found.withColumn("__r", F.row_number().over(best)).where(F.col("__r") == k).select("qid", (F.col("low") - SLACK).alias("least"))

        def opened(chosen: DataFrame) -> DataFrame:
            """Postings of the chosen (qid, term, block)s, with their weights."""
            rows = self._postings(blocks.join(chosen, ["term", "block"]))
            return rows.withColumn("own", F.col("qtf") * weight(F.col("idf"), F.col("tf"), F.col("dl"), mean))

        first = max(FIRST_BLOCKS, -(-4 * k // BLOCK))
        of_term, of_query = Window.partitionBy("term").orderBy(F.desc("unit"), "block"), Window.partitionBy("qid").orderBy(F.desc("bound"), "term", "block")
        ahead = heads.withColumn("__r", F.row_number().over(of_term)).where(F.col("__r") <= first).drop("__r").join(asked, "term").withColumn("bound", bound)
        seeds = ahead.withColumn("__r", F.row_number().over(of_query)).where(F.col("__r") <= first).select("qid", "term", "block", "qtf", "idf")
        seen = opened(seeds).groupBy("qid", "doc").agg(F.sum("own").alias("low"))
        least = asked.select("qid").distinct().join(kth(seen), "qid", "left").na.fill(-1.0, ["least"])
        # greatest weight of each term; the least ones together stay below a share of the threshold
        most = asked.join(heads.groupBy("term").agg(F.max("unit").alias("unit")), "term").withColumn("most", bound).join(least, "qid")
        up = Window.partitionBy("qid").orderBy("most", "term")
        most = most.withColumn("__below", F.sum("most").over(up)).withColumn("__all", F.sum("most").over(Window.partitionBy("qid")))
        most = settled(most.select("qid", "term", "qtf", "idf", "df", "most", "least", (F.col("__below") >= TRAILING * F.col("least")).alias("leads"), "__all"))
        judged = heads.join(most.where("leads"), "term").withColumn("bound", bound)
        judged = settled(judged.withColumn("open", F.col("bound") + F.col("__all") - F.col("most") >= F.col("least")))
        # the most that what isn't read can add: of a leading term its best unread block, of another its greatest weight
        unread = judged.groupBy("qid", "term").agg(F.max(F.when(~F.col("open"), F.col("bound")).otherwise(0.0)).alias("unread"))
        rest = most.select("qid", "term", "most").join(unread, ["qid", "term"], "left").select("qid", "term", F.coalesce("unread", "most").alias("rest"))
        read = opened(judged.where("open").select("qid", "term", "block", "qtf", "idf")).join(rest, ["qid", "term"])
        found = settled(read.groupBy("qid", "doc").agg(F.sum("own").alias("low"), F.sum(F.col("own") - F.col("rest")).alias("high")))
        limits = rest.groupBy("qid").agg(F.sum("rest").alias("__rest")).join(least.withColumnRenamed("least", "__first"), "qid").join(kth(found), "qid", "left")
        left = found.join(limits, "qid").where(F.col("high") + F.col("__rest") >= F.greatest("least", "__first") - SLACK)
        left = settled(left.select("qid", "doc"))
        work = asked.groupBy("qid").agg(F.sum("df").alias("postings")).join(judged.where("open").groupBy("qid").agg(F.sum("n").alias("read")), "qid", "left")
        return left, work.join(left.groupBy("qid").agg(F.count("*").alias("scored")), "qid", "left")

    def top_k(self, queries: DataFrame, k: int, *, tie: Column | None = None, qid: str = "qid", query: str = "query", plain_postings: int = PLAIN_POSTINGS) -> DataFrame:
        """(qid, doc, score, rank) of the k best documents of each query; ties by ``tie``, else the smaller id.

        Batches whose terms have more than ``plain_postings`` postings, counted once a query, are searched under bounds.
        """
        asked = self.asked(queries, qid, query)
        if (asked.agg(F.sum("df")).first()[0] or 0) <= plain_postings:
            scored = self._every(asked)
        else:
            scored = self.scores(self.candidates(asked, k)[0], asked)
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc") if tie is None else tie))
        return scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)


def folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def raw_idf(df: Column, docs: int) -> Column:
    return F.log(F.lit(docs) - df + 0.5) - F.log(df + 0.5)


_kept: dict[tuple, Index] = {}


def kept(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> Index:
    """The index of a table, or a view of it, in the shared folder: built once a session for the same files and columns."""
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, doc, text, *sorted(docs.inputFiles()))
    if key not in _kept:
        _kept[key] = Index(spark, f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}").append(docs, doc=doc, text=text)
    return _kept[key]
