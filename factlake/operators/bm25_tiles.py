"""Exact BM25 for many queries over many short documents: queries meet the documents of their rare words, no pair is shuffled.

A query is looked for among the documents of its rarest words. The k-th best of them is a score that
any other document has to reach with the query's remaining words; where the greatest weights of those together
stay below it the query is done, else the documents of as many further words follow as it takes.

Documents and queries of a word come to one place, in blocks of bounded size where they are many, and are
multiplied as matrices: weights are whole steps, exact in double precision in any order.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions.text import tokens
from factlake.operators.bm25_index import B, K1, MOST_TERMS, STEPS, raw_idf
from factlake.operators.bm25_scan import COARSE, HELD_WORDS, Scan, sliced, words
from factlake.operators.layout import settled

#: Documents and queries of a block, about; words multiplied at once; sums held at once.
DOCS, QUERIES, KEPT, SUMS = 1 << 14, 1 << 13, 256, 1 << 20
#: Documents, in multiples of k, that a query's first words have.
AHEAD = 2
#: A query's terms, rarest first; ``gain`` is the most that one can add to a sum.
TERM = "struct<df:bigint,term:string,qtf:bigint,idf:double,gain:bigint>"


def coarse(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * ((np.abs(x) + COARSE // 2) // COARSE)


def impact(tf, dl, mean: float):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (mean or 1.0)))


def impacts(docs: DataFrame, mean: float) -> DataFrame:
    """(term, high): the greatest weight of every word of (doc, lower), under an idf of 1."""

    def run(batches):
        high: dict[bytes, float] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(high), pa.binary()).cast(pa.string()), pa.array(list(high.values()), pa.float64())], names=["term", "high"])

        for _, texts in sliced(batches):
            for t in texts:
                own = words(t or b"")
                for w, tf in Counter(own).items():
                    x = impact(tf, len(own), mean)
                    if x > high.get(w, 0.0):
                        high[w] = x
            if len(high) >= HELD_WORDS:
                yield rows()
                high.clear()
        yield rows()

    return docs.mapInArrow(run, "term string, high double").groupBy("term").agg(F.max("high").alias("high"))


def reach(df: list[int], gain: list[int], used: int, k: int, least: int | None) -> int:
    """How many of a query's terms, rarest first, have to find documents if ``used`` have and the k-th best score is ``least``."""
    if least is None:
        n, seen = used, 0
        while n < len(df) and (n == used or seen < AHEAD * k):
            seen += df[n]
            n += 1
        return n
    n, rest = len(df), 0
    while n > used and int(coarse(rest + gain[n - 1])) < least:
        n -= 1
        rest += gain[n]
    return n


def reached(state: DataFrame) -> DataFrame:
    """``state`` (qid, k, terms, used, least) with ``n``, the terms that have to find documents."""

    def run(batches):
        for b in batches:
            t = b.column("terms")
            df, gain = ([x.as_py() for x in pa.ListArray.from_arrays(t.offsets, t.values.field(f))] for f in (0, 4))
            n = [reach(*x) for x in zip(df, gain, b.column("used").to_pylist(), b.column("k").to_pylist(), b.column("least").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32())], names=[*b.schema.names, "n"])

    return state.mapInArrow(run, T.StructType([*state.schema.fields, T.StructField("n", T.IntegerType())]))


def best(texts: list[bytes], ids: np.ndarray, place: dict[bytes, int], idf: np.ndarray, mean: float, query: np.ndarray, word: np.ndarray, qtf: np.ndarray, ks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score in steps of six places) of the k best of some documents, each of which shares a word with every query.

    Queries are numbers from 0 in order, one for each word (its number by ``place``) with its count.
    """
    own = [words(t) for t in texts]
    lengths = np.array([len(w) for w in own], np.int64)
    at = np.fromiter(map(place.get, chain.from_iterable(own), repeat(-1)), np.int64, int(lengths.sum()))
    known, word = np.unique(word, return_inverse=True)  # words of these queries
    if not len(known) or not len(own):
        return (np.zeros(0, np.int64),) * 3
    to = np.minimum(np.searchsorted(known, at), len(known) - 1)
    own_cell = (np.repeat(np.arange(len(own)), lengths) * len(known) + to)[known[to] == at]
    cell, tf = np.unique(own_cell, return_counts=True)
    d, v = np.divmod(cell, len(known))
    w = idf[known[v]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[d] / (mean or 1.0))) * STEPS
    w = np.where(w < 0, np.ceil(w - 0.5), np.floor(w + 0.5))
    out, step = [], max(1, SUMS // len(own))
    for first in range(0, len(ks), step):
        k = ks[first : first + step]
        part = slice(*np.searchsorted(query, (first, first + step)))
        total = np.zeros((len(k), len(own)))
        for low in range(0, len(known), KEPT):
            size = min(KEPT, len(known) - low)
            asks, has = (word[part] >= low) & (word[part] < low + size), (v >= low) & (v < low + size)
            if asks.any() and has.any():
                q, x = np.zeros((len(k), size)), np.zeros((size, len(own)))
                q[query[part][asks] - first, word[part][asks] - low] = qtf[part][asks]
                x[v[has] - low, d[has]] = w[has]
                total += q @ x
        most = int(k.max())
        if most < len(own):
            i, j = np.nonzero(total >= np.partition(total, len(own) - most, axis=1)[:, len(own) - most, None] - COARSE)
        else:
            i, j = np.divmod(np.arange(total.size), len(own))
        s = coarse(total[i, j].astype(np.int64))
        order = np.lexsort((ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        some = np.arange(len(i)) - np.searchsorted(i, i) < k[i]
        out.append((i[some] + first, ids[j[some]], s[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def searched(docs: DataFrame, asked: DataFrame, mean: float, kind: T.DataType) -> DataFrame:
    """(qid, best) of the documents of words: ``asked`` has (qid, k, terms, term); ``best`` are (minus score, doc), best first, once a block."""
    sizes = settled(asked.groupBy("term").agg(F.count("*").alias("nq"), F.max(F.expr("filter(terms, x -> x.term = term)[0].df")).alias("df")))
    blocks = lambda c, n: F.ceil(F.col(c) / n).cast("int")
    terms, nq, df = sizes.agg(F.count("*"), F.sum("nq"), F.sum("df")).first()
    groups = max(docs.sparkSession.sparkContext.defaultParallelism * 4, -(-(df or 0) // DOCS) + -(-(nq or 0) // QUERIES))
    sizes = sizes.select("term", blocks("df", DOCS).alias("db"), blocks("nq", QUERIES).alias("qb"), F.pmod(F.xxhash64("term"), F.lit(groups)).cast("int").alias("place"))
    sizes = F.broadcast(sizes) if terms <= MOST_TERMS else sizes
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    left = asked.join(sizes, "term").withColumn("qs", dealt("qid", "qb")).withColumn("ds", every("db")).drop("db", "qb")
    each = docs.select("doc", "lower", F.explode(F.array_distinct(tokens(F.col("lower").cast("string")))).alias("term"))
    right = each.join(sizes, "term").withColumn("ds", dealt("doc", "db")).withColumn("qs", every("qb"))
    right = right.select("doc", "lower", "term", F.col("place").alias("to"), F.col("ds").alias("to_ds"), F.col("qs").alias("to_qs"))
    to = asked.select("qid").limit(0).toArrow().schema.field(0).type
    listed = pa.list_(pa.struct([("low", pa.int64()), ("doc", pa.int64())]))

    def tile(own: pa.Table, block: pa.Table) -> pa.Table:
        names, low, doc, lengths = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(own) and len(block):
            own, block = own.sort_by("term").combine_chunks(), block.sort_by("term").combine_chunks()
            texts, ids = block["lower"].to_pylist(), block["doc"].to_numpy().astype(np.int64)
            qids, ks = own["qid"].combine_chunks(), own["k"].to_numpy().astype(np.int64)
            lists = own["terms"].combine_chunks()
            n, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
            start = np.concatenate([[0], np.cumsum(n)])
            coded = flat.field("term").dictionary_encode()
            word, qtf, idf = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.field("qtf").to_numpy(zero_copy_only=False), np.zeros(len(coded.dictionary))
            idf[word] = flat.field("idf").to_numpy(zero_copy_only=False)
            place = {w.encode(): i for i, w in enumerate(coded.dictionary.to_pylist())}
            query = np.repeat(np.arange(len(n)), n)
            asks, has = spans(own["term"].to_pylist()), spans(block["term"].to_pylist())
            for t in asks.keys() & has.keys():
                (a, b), (c, d) = asks[t], has[t]
                s = slice(start[a], start[b])
                i, x, score = best(texts[c:d], ids[c:d], place, idf, mean, query[s] - a, word[s], qtf[s], ks[a:b])
                names.append(np.arange(a, b))
                low.append(-score)
                doc.append(x)
                lengths.append(np.bincount(i, minlength=b - a))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(low)), pa.array(np.concatenate(doc))], names=["low", "doc"])
        found = qids.take(pa.array(np.concatenate(names))) if names else pa.array([], to)
        return pa.table([found.cast(to), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs).cast(listed)], names=["qid", "best"])

    schema = T.StructType([T.StructField("qid", kind), T.StructField("best", T.ArrayType(T.StructType([T.StructField("low", T.LongType()), T.StructField("doc", T.LongType())])))])
    # tasks by number, not by bytes: a small block is much work
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism * 4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left, right = left.repartition(tasks, "place", "ds", "qs"), right.repartition(tasks, "to", "to_ds", "to_qs")
    return left.groupBy("place", "ds", "qs").cogroup(right.groupBy("to", "to_ds", "to_qs")).applyInArrow(tile, schema)


def spans(terms: list[str]) -> dict[str, tuple[int, int]]:
    """Where every term begins and ends in a sorted list."""
    edges = [0, *(i for i in range(1, len(terms)) if terms[i] != terms[i - 1]), len(terms)]
    return {terms[a]: (a, b) for a, b in zip(edges, edges[1:], strict=False)}


def top_k(scan: Scan, queries: DataFrame, *, most: str = "k", qid: str = "qid", query: str = "query") -> DataFrame:
    """(qid, doc, score, rank) of the best documents of each query, as many as its column ``most`` says; ties by the smaller id."""
    rows = lists(scan, queries, most=most, qid=qid, query=query).select("qid", F.posexplode("best").alias("at", "b"))
    return rows.select("qid", F.col("b.doc").cast(scan.docs.schema["doc"].dataType).alias("doc"), (-F.col("b.low") / F.lit(1e6)).alias("score"), (F.col("at") + 1).cast("long").alias("rank"))


def lists(scan: Scan, queries: DataFrame, *, most: str = "k", qid: str = "qid", query: str = "query") -> DataFrame:
    """(qid, best) of every query that has documents: (low, doc) of its best ones in order, ``low`` being minus the score in steps of six places.

    Ids of documents are whole numbers, each of one row; ids of queries don't repeat.
    """
    kind, docs = queries.schema[qid].dataType, settled(scan.docs.select(F.col("doc").cast("long").alias("doc"), "lower"))
    raw = raw_idf(F.col("n"), scan.n)
    known = scan.words.where("term is not null").join(impacts(docs, scan.mean), "term")
    known = settled(known.select("term", F.col("n").alias("df"), F.when(raw < 0, scan.floor).otherwise(raw).alias("idf"), "high"))
    known = F.broadcast(known) if known.count() <= MOST_TERMS else known
    # dealt by id first: the two aggregations need no other exchange
    each = queries.select(F.col(qid).alias("qid"), F.col(most).cast("int").alias("k"), F.col(query).alias("query")).repartition("qid").select("qid", "k", F.explode(tokens(F.col("query"))).alias("term"))
    each = each.groupBy("qid", "k", "term").agg(F.count("*").alias("qtf")).join(known, "term")
    # one step more than rounding can make of the greatest weight
    gain = F.greatest(F.lit(0), F.ceil(F.col("idf") * F.col("high") * STEPS) + 1).cast("long") * F.col("qtf")
    terms = F.sort_array(F.collect_list(F.struct("df", "term", "qtf", "idf", gain.alias("gain")))).cast(f"array<{TERM}>")
    state = each.groupBy("qid", "k").agg(terms.alias("terms")).where("k > 0").withColumns({"used": F.lit(0), "least": F.lit(None).cast("long")})
    state, done = settled(reached(state)), []
    found = None
    while state.where("n > used").limit(1).count():
        asked = state.where("n > used").select("qid", "k", "terms", F.explode(F.expr("slice(terms, used + 1, n - used)")).alias("t")).select("qid", "k", "terms", "t.term")
        new = searched(docs, asked, scan.mean, kind)
        ranked = (new if found is None else new.unionByName(found)).groupBy("qid").agg(F.flatten(F.collect_list("best")).alias("best"))
        after = state.drop("best").join(ranked, "qid").withColumn("best", F.slice(F.array_sort(F.array_distinct("best")), 1, F.col("k")))
        least = F.when(F.size("best") == F.col("k"), -F.element_at("best", -1)["low"])
        after = settled(reached(after.select("qid", "k", "terms", F.col("n").alias("used"), least.alias("least"), "best")))
        done.append(after.where("n = used").select("qid", "best"))
        state = after.where("n > used")
        found = state.select("qid", "best")
    return reduce(DataFrame.unionByName, done or [state.selectExpr("qid", "CAST(array() AS array<struct<low:bigint,doc:bigint>>) AS best")])
