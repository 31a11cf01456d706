"""How the sources of each language differ in their words: exact divergences of every pair.

1. Words are counted per (language, source) inside the tasks that read the texts, so what is
   shuffled are counts; a hot source is no hot key, for counts are dealt by word.
2. The words of a language that enough documents have are kept. Each is a sparse vector of
   counts by source, and words with equal vectors are one class with a multiplicity.
3. Every pair of sources is evaluated once for each class and multiplied by it. Sources
   lie in blocks of ``SOURCES`` and classes are dealt out by ``CLASSES``; a pair of blocks and a
   share of the classes is one task's tile, whose matrices are bounded by that.
4. A source's own words are ranked by class as well; only the least words of the best classes
   are looked up again.

Defined cases: null text, language or source count as ''; repeated rows count as documents
each; a group without any kept word has shares all the same; a language of one source has no
pairs; ties go to the item first in UTF-8; an empty table gives no rows. Only the four
named columns are read. Shares are integers: decimals of 38 digits until the division, so counts of any
size are exact. A text of any length is one row, counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.common import bounded, dealt_join, slices, stored

#: Steps of a share.
STEPS = 1_000_000_000
#: Sources in a block, and classes in a tile.
SOURCES, CLASSES = 256, 16_384
#: Distinct words, and (document, word) pairs, that a task holds before it hands out counts.
HELD_WORDS, HELD_PAIRS = 1_000_000, 4_000_000
#: Bytes that no word has become spaces, A to Z lose their case.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


class Numbers(dict):
    """The number of each word, in the order met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Counts:
    """Occurrences and documents of words by group, until they are handed out."""

    def __init__(self):
        self.words, self.groups, self.parts, self.held = Numbers(), {}, [], 0

    def add(self, group: tuple[str, str], text: str) -> None:
        words = text.encode().translate(WORD_BYTES).split()
        g = self.groups.setdefault(group, len(self.groups))
        own, n = np.unique(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)), return_counts=True)
        self.parts.append((own | g << 32, n))
        self.held += len(own)

    def full(self) -> bool:
        return len(self.words) >= HELD_WORDS or self.held >= HELD_PAIRS

    def batch(self) -> pa.RecordBatch:
        """(lang, source, term, n, docs) of all that was added since the last one."""
        key, n = (np.concatenate([p[i] for p in self.parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
        by = np.argsort(key, kind="stable")
        key, n = key[by], n[by]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        docs = np.diff(np.append(first, len(key)))
        total = np.add.reduceat(n, first) if len(first) else n
        key = key[first]
        words = pa.array(list(self.words), pa.binary()).cast(pa.string())
        lang, source = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        group = pa.array(key >> 32)
        columns = [lang.take(group), source.take(group), words.take(pa.array(key & 0xFFFFFFFF)), pa.array(total, pa.int64()), pa.array(docs, pa.int64())]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), added up over a task's documents; several rows a term and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        for batch in batches:
            lang, source, text = batch.columns
            sizes = [x or 0 for x in pa.compute.binary_length(text).to_pylist()]
            for a, b in slices(sizes):
                for g, h, t in zip(*(c.slice(a, b - a).to_pylist() for c in (lang, source, text)), strict=True):
                    if t:
                        held.add((g, h), t)
                if held.full():
                    yield held.batch()
        if held.parts:
            yield held.batch()

    import pyarrow.compute  # noqa: F401  (pa.compute is used in the tasks)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, kept: Column) -> Column:
    """The smoothed share of a count, in steps from 1; exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(STEPS).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * kept))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def divergence_column(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def one_side(rows: np.ndarray, at: np.ndarray, p: np.ndarray, m: np.ndarray, other: np.ndarray, skip: np.ndarray | None, out: np.ndarray, seen: np.ndarray) -> None:
    """Adds the divergences of entries (row, source at, share p) from all shares of the row on the other side.

    ``skip`` marks what the other side has counted already.
    """
    step = max(1, (1 << 20) // max(1, other.shape[1]))
    for a in range(0, len(rows), step):
        r, s = rows[a : a + step], at[a : a + step]
        by = np.argsort(s, kind="stable")
        r, s, own, times = r[by], s[by], p[a : a + step][by], m[r[by]][:, None]
        f = divergence(own[:, None], other[r]) * times
        count = np.broadcast_to(times, f.shape)
        if skip is not None:
            free = ~skip[r]
            f, count = f * free, count * free
        first = np.flatnonzero(np.diff(s, prepend=-1))
        out[s[first]] += np.add.reduceat(f, first, axis=0)
        seen[s[first]] += np.add.reduceat(count, first, axis=0)


def pairs_in_tile(rows: pa.Table, i: int, j: int, first: bool, sources: int = SOURCES) -> pa.Table:
    """(a, b, value): a share of the classes' sum for every pair of sources of two blocks.

    A row of multiplicity 0 has the shares of words that a source does not have, with the
    number of kept words; the others are classes. Where neither source has a
    word, the divergence is that of these shares: it is counted for all words by the first tile,
    and taken back for words that one of the two has.
    """
    m = rows["m"].to_numpy()
    names = ("left", "right")

    def entries(side: str, take: np.ndarray):
        part = rows[side].combine_chunks().take(pa.array(take))
        sizes = part.value_lengths().to_numpy(zero_copy_only=False)
        flat = part.flatten()
        return np.repeat(np.arange(len(take)), sizes), flat.field("s").to_numpy(), flat.field("p").to_numpy()

    base, classes = np.flatnonzero(m == 0), np.flatnonzero(m > 0)
    block = (i, j)
    zero = []
    for k, side in enumerate(names):
        _, s, p = entries(side, base)
        z = np.zeros(len(s), np.int64)
        z[s - block[k] * sources] = p
        zero.append(z)
    kept = int(rows["kept"].to_numpy()[base].max())
    both_absent = divergence(zero[0][:, None], zero[1][None])
    out, seen = np.zeros_like(both_absent), np.zeros_like(both_absent)
    for a in range(0, len(classes), 1024):
        take = classes[a : a + 1024]
        times, dense, has, own = m[take], [], [], []
        for k, side in enumerate(names):
            r, s, p = entries(side, take)
            s = s - block[k] * sources
            shares, present = np.repeat(zero[k][None], len(take), axis=0), np.zeros((len(take), len(zero[k])), bool)
            shares[r, s], present[r, s] = p, True
            own.append((r, s, p))
            dense.append(shares)
            has.append(present)
        one_side(*own[0], times, dense[1], None, out, seen)
        one_side(*own[1], times, np.broadcast_to(zero[0], dense[0].shape), has[0], out.T, seen.T)
    value = out - seen * both_absent + (kept * both_absent if first else 0)
    left, right = np.indices(value.shape)
    left, right, value = left.ravel() + i * sources, right.ravel() + j * sources, value.ravel()
    other = left != right
    left, right, value = left[other], right[other], value[other]
    if i != j:
        left, right, value = np.append(left, right), np.append(right, left), np.append(value, value)
    return pa.table({"a": pa.array(left, pa.int32()), "b": pa.array(right, pa.int32()), "value": pa.array(value)})


def audit(df: DataFrame, *, least_docs: int = 10, top_terms: int = 10, text: str = "text", lang: str = "lang", source: str = "source", sources: int = SOURCES, class_share: int = CLASSES) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources by divergence, and the source's own words."""
    bounded(df.sparkSession)
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    docs = df.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))
    # dealt by word once: both sides read the same columns, so one exchange and one reading of the texts serve both
    dealt = counted(docs).repartition("lang", "term")
    kept = dealt.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("__n"), F.max("source").alias("__s"))
    kept = kept.where((F.col("docs") >= least_docs) & (F.col("__n") > 0) & F.col("__s").isNotNull()).select("lang", "term")
    counts = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("__d")).where("__d > 0").drop("__d")
    counts = stored(counts.join(kept.hint("shuffle_hash"), ["lang", "term"]))

    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = stored(groups.select("lang", "source", zero("total"), zero("kept"), zero("lang_total"), number.cast("int").alias("s")))
    langs = groups.groupBy("lang").agg(F.first("kept").alias("kept"), F.first("lang_total").alias("lang_total"), F.count("*").alias("sources"))

    # classes: words with the same sources and counts
    numbered = counts.join(groups.select("lang", "source", "s"), ["lang", "source"])
    vectors = stored(numbered.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("vector")))  # as long as the language has sources at most
    classes = stored(vectors.groupBy("lang", "vector").agg(F.count("*").alias("m")).withColumn("c", F.monotonically_increasing_id()))
    entries = classes.select("lang", "c", "m", F.explode("vector").alias("e"), F.aggregate("vector", F.lit(0).cast("long"), lambda a, e: a + e["n"]).alias("all"))
    entries = entries.select("lang", "c", "m", "all", F.col("e.s").alias("s"), F.col("e.n").alias("n")).join(groups, ["lang", "s"])
    entries = stored(entries.select("lang", "c", "m", "s", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("kept")).alias("q")))

    # pairs of sources, block by block
    width = (F.floor((F.col("sources") - 1) / sources) + 1).cast("int")
    shares = F.greatest(F.lit(1), F.ceil(F.col("classes") / class_share)).cast("int")
    plan = langs.join(classes.groupBy("lang").agg(F.count("*").alias("classes")), "lang", "left")
    plan = stored(plan.select("lang", F.coalesce("classes", F.lit(0)).alias("classes"), width.alias("width"), F.coalesce(shares, F.lit(1)).alias("shares")))
    shared = entries.groupBy("lang", "c", "m").agg(F.collect_list(F.struct("s", "p")).alias("v"))
    shared = dealt_join(shared, plan, ["lang"], "classes", classes.count(), ("c",))  # a language may have most of the classes
    shared = shared.withColumn("share", F.pmod(F.xxhash64("c"), F.col("shares")).cast("int"))
    blocks = F.expr("transform(sequence(0, width - 1), i -> filter(v, e -> e.s div %d = i))" % sources)
    tiles = "filter(flatten(transform(sequence(0, width - 1), i -> transform(sequence(i, width - 1), j -> named_struct('i', i, 'j', j)))), t -> size(v[t.i]) > 0 or size(v[t.j]) > 0)"
    of_classes = shared.withColumn("v", blocks).withColumn("t", F.explode(F.expr(tiles)))
    absent = groups.select("lang", "s", "kept", share(F.lit(0).cast("long"), F.col("total"), F.col("kept")).alias("p")).withColumn("block", F.floor(F.col("s") / sources).cast("int"))
    absent = absent.groupBy("lang", "block", "kept").agg(F.collect_list(F.struct("s", "p")).alias("v")).where("kept > 0")
    one, two = (absent.select("lang", "kept", F.col("block").alias(b), F.col("v").alias(side)) for b, side in (("i", "left"), ("j", "right")))
    of_absent = one.join(two.drop("kept"), "lang").where("i <= j").join(plan, "lang").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    columns = ("lang", "i", "j", "share")
    rows = of_classes.select("lang", "t.i", "t.j", "share", "m", F.lit(0).cast("long").alias("kept"), F.expr("v[t.i]").alias("left"), F.expr("v[t.j]").alias("right"))
    rows = rows.unionByName(of_absent.select(*columns, F.lit(0).cast("long").alias("m"), "kept", "left", "right"))

    def tile(key, rows):
        lang, i, j, part = (k.as_py() for k in key)
        out = pairs_in_tile(rows, i, j, part == 0, sources)
        return out.append_column("lang", pa.array([lang] * out.num_rows, pa.string()))

    found = rows.groupBy(*columns).applyInArrow(tile, "a int, b int, value long, lang string")
    # a language without kept words has pairs of no divergence
    least = langs.where("kept = 0").select("lang", "sources").withColumn("a", F.explode(F.expr("sequence(0, cast(sources as int) - 1)")))
    least = least.withColumn("b", F.explode(F.expr("sequence(0, cast(sources as int) - 1)"))).where("a <> b").select("a", "b", F.lit(0).cast("long").alias("value"), "lang")
    pairs = found.unionByName(least).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    by_number = groups.select("lang", F.col("s").alias("a"), "source")
    pairs = pairs.join(by_number, ["lang", "a"]).join(groups.select("lang", F.col("s").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))

    # a source's own words: the best classes, then their least words
    over = entries.where("p > q").select("lang", "s", "c", divergence_column(F.col("p"), F.col("q")).alias("value"))
    over = over.withColumn("r", F.rank().over(Window.partitionBy("lang", "s").orderBy(F.desc("value")))).where(F.col("r") <= top_terms).drop("r")
    own = vectors.join(classes.select("lang", "vector", "c"), ["lang", "vector"])
    own = own.join(over.select("c").distinct(), "c", "left_semi").select("c", "term")
    own = own.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("term"))).where(F.col("r") <= top_terms).drop("r")
    words = over.join(own, "c").join(groups.select("lang", "s", "source"), ["lang", "s"]).withColumnRenamed("term", "item")
    words = words.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(words.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
