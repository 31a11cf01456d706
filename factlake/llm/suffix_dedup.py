"""Removal of long byte strings that repeat anywhere in a corpus, by suffix sorting.

Two equal strings of ``length`` bytes hold the same anchor at the same place: the
leftmost of the least-hashed ``GRAM``-byte strings inside. Every window of ``length``
bytes therefore belongs to one anchor, the windows of an anchor are consecutive, and
equal windows meet under the hash of their anchor's bytes -- about one row for every
seventy bytes in place of one for every byte.

1. Anchors are found text by text and written to the shared folder: hash, the hash of
   all that their windows cover (the class), and places.
2. Anchors whose hash occurs once are dropped. In a class that occurs twice or more,
   every window repeats; its members are told by two independent 64-bit hashes, and two
   of them are compared byte by byte in step 3. A class that fails that test is opened:
   all its members go through step 3 one by one.
3. What is left are anchors that occur in different surroundings, as at the edges of a
   copied passage. One context of each class, two of a class that occurs more often, is
   sent to its anchor's group. There the suffixes that begin at the anchors are sorted by
   hash comparisons, and so are the reversed texts before them; runs of neighbours with a
   common extension of ``length - d`` to the right and d to the left are the windows that
   repeat. Groups of more than ``most`` contexts are not gathered: their windows are
   counted by a 128-bit hash in an ordinary aggregation.
4. The spans return to their documents, where they are merged and cut out.

Only counts and two members of each class meet at a hot key, aggregated before the
shuffle; joins deal hot keys out. Texts go to joins as the streamed side, unsorted, and
a text longer than ``SLICE_BYTES`` is read in overlapping pieces. Defined cases: null and empty texts have nothing to remove; texts shorter
than ``length`` neither; identical rows are different documents, so a text of
``length`` bytes or more that occurs twice is removed whole, ids null or not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import SLICE_BYTES, bounded, dealt_join, forget, slices, stored
from factlake.llm.suffix_sort import Prefix, neighbours, order

LENGTH, GRAM = 200, 64
#: Contexts of one anchor that a task sorts together.
MOST_CLASSES = 20_000
#: Bytes of contexts sorted at once.
SORT_BYTES = 1 << 20
NO_ID = -(1 << 63)


def least_in_windows(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, have = v, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, place, first window, last window, anchor hash, class hash).

    Places and windows are counted from the start of their text.
    """
    import xxhash

    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    prefix = Prefix(data)
    h = prefix.of(np.arange(n - gram + 1), gram)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    key = (h & np.uint64(0xFFFFFFFF)) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    at = (least_in_windows(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    window = np.flatnonzero(np.arange(len(at)) + length <= (starts + sizes)[owner])
    if not len(window):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    at, owner = at[window], owner[window]
    head = np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]
    first, last = window[head], window[np.r_[head[1:], True]]
    place, owner = at[head], owner[head]
    raw, digest = memoryview(data), xxhash.xxh3_64_intdigest
    classes = np.fromiter((digest(raw[a : b + length], p - a) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)), np.uint64, len(first))
    base = starts[owner]
    return owner, place - base, first - base, last - base, h[place].view(np.int64), classes.view(np.int64)


def repeats(contexts: list[bytes], place: np.ndarray, windows: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, window) of the windows that occur in another class of their group.

    ``contexts`` are the bytes of a class's windows, ``place`` its anchor in them,
    ``windows`` how many it has; rows come sorted by ``group``.
    """
    n = len(contexts)
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    start = np.cumsum(sizes) - sizes
    forward = Prefix(data)
    right = order(forward, start + place, sizes - place, group)
    right_common = neighbours(forward, start + place, sizes - place, group, right)
    backward = Prefix(data[::-1])
    begin = len(data) - (start + place)
    left = order(backward, begin, place, group)
    left_common = neighbours(backward, begin, place, group, left)
    right_run, left_run = np.empty(n, np.int64), np.empty(n, np.int64)
    who, window = [], []
    for d in range(int(place.max(initial=-1)) + 1):
        own = np.flatnonzero((place >= d) & (place - d < windows))
        if len(own) < 2:
            continue
        right_run[right] = np.cumsum(right_common < length - d)
        left_run[left] = np.cumsum(left_common < d)
        key = right_run[own] * (n + 1) + left_run[own]
        by = np.argsort(key, kind="stable")
        equal = key[by][1:] == key[by][:-1]
        hit = own[by[np.r_[equal, False] | np.r_[False, equal]]]
        who.append(hit)
        window.append(place[hit] - d)
    return (np.concatenate(who), np.concatenate(window)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int64))


FOUND = ["d", "k", "s", "e", "ah", "ch"]


def unequal(rows: list[tuple]) -> list[tuple]:
    """(ah, ch) of the neighbouring contexts of one class, in rows sorted by them, that differ."""
    return [a[:2] for a, b in zip(rows, rows[1:]) if a[:2] == b[:2] and a[7] > 1 and a[5:9] != b[5:9]]


def _found(spans: list[np.ndarray], failed: list[tuple]) -> pa.RecordBatch:
    """Spans, and classes whose members differ as rows of s = -1."""
    wrong = np.array(failed, np.int64).reshape(-1, 2)
    none, zero = np.full(len(wrong), -1, np.int64), np.zeros(len(spans[0]), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (*((v, none) for v in spans), (zero, wrong[:, 0]), (zero, wrong[:, 1]))], names=FOUND)


def _sort_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of single classes, and classes that hold different strings, from contexts that come sorted by ah and ch."""
    none = [np.zeros(0, np.int64)] * 4

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        failed = unequal(rows)
        several, at = [], 0
        for i in range(1, len(rows) + 1):  # a group of one class has nothing to sort
            if i == len(rows) or rows[i][0] != rows[at][0]:
                if rows[at][1] != rows[i - 1][1] or i - at > 1 and rows[at][7] == 1:
                    several += rows[at:i]
                at = i
        rows = several
        if not rows:
            return _found(none, failed)
        group = np.cumsum(np.r_[False, [a[0] != b[0] for a, b in zip(rows, rows[1:])]])
        place, windows = (np.array([r[i] for r in rows], np.int64) for i in (5, 6))
        who, window = repeats([r[8] for r in rows], place, windows, group, length)
        single = np.array([r[7] == 1 for r in rows])[who]
        who, window = who[single], window[single]
        if not len(who):
            return _found(none, failed)
        by = np.lexsort((window, who))
        who, window = who[by], window[by]
        head = np.r_[True, (who[1:] != who[:-1]) | (window[1:] != window[:-1] + 1)]
        a, b = np.flatnonzero(head), np.flatnonzero(np.r_[head[1:], True])
        d, k, lo = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
        return _found([d[who[a]], k[who[a]], lo[who[a]] + window[a], lo[who[b]] + window[b] + length], failed)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > SORT_BYTES and row[0] != held[-1][0]:
                yield spans(held)
                held, size = [], 0
            held.append(row)
            size += len(row[8])
    if held:
        yield spans(held)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that hold different strings, from contexts that come sorted by ah and ch."""
    last: list[tuple] = []
    for batch in batches:
        rows = last + list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield _found([np.zeros(0, np.int64)] * 4, unequal(rows))
        last = rows[-1:]


def keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Columns d and k, which tell rows apart, besides ``doc`` and the text as bytes."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(t).alias("k"), F.col(doc).alias("__doc"), t.cast("binary").alias("__bytes"))


def _find(batches: Iterator[pa.RecordBatch], length: int, gram: int, class_bits: int) -> Iterator[pa.RecordBatch]:
    mask = np.int64(-1 if class_bits >= 64 else (1 << class_bits) - 1)
    for b in batches:
        d, k, data = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
        sizes = pa.compute.binary_length(data).to_pylist()
        for i, j in slices(sizes):
            texts = data.slice(i, j - i).to_pylist()
            row, base = np.arange(i, j), np.zeros(j - i, np.int64)
            if j == i + 1 and sizes[i] > 2 * SLICE_BYTES:  # pieces that share no window
                base = np.arange(0, sizes[i] - length + 1, SLICE_BYTES)
                row, texts = np.full(len(base), i), [texts[0][s : s + SLICE_BYTES + length - 1] for s in base.tolist()]
            for at in range(len(texts)) if len(texts) > j - i else (slice(None),):
                part = texts[at] if isinstance(at, slice) else [texts[at]]
                own, place, lo, hi, ah, ch = anchors(part, length, gram)
                rows, shift = np.atleast_1d(row[at])[own], np.atleast_1d(base[at])[own]
                small = [pa.array(x + shift) for x in (place, lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array(d[rows]), pa.array(k[rows]), *small, pa.array(ah), pa.array(ch & mask)], names=["d", "k", "place", "lo", "hi", "ah", "ch"])


CONTEXT = "ah long, ch long, d long, k long, lo long, place int, windows int, c long, bytes binary, crowd boolean"


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From (d, k, bytes, anchors): a row with its bytes for every anchor."""
    i32, i64 = pa.int32(), pa.int64()
    kinds = [i64, i64, i64, i64, i64, i32, i32, i64, pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in CONTEXT.split(", ")]

    def batch(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    for b in batches:
        d, k, data, wanted = (b.column(i) for i in range(4))
        flat, at = wanted.values, wanted.offsets.to_pylist()
        fields = [flat.field(n) for n in ("ah", "ch", "c", "place", "lo", "hi", "crowd")]
        out, size = [[] for _ in kinds], 0
        for i in range(b.num_rows):
            raw, s, n = data[i].as_py(), at[i], at[i + 1] - at[i]
            own = [x.slice(s, n).to_pylist() for x in fields]
            dd, kk = d[i].as_py(), k[i].as_py()
            for ah, ch, c, place, lo, hi, crowd in zip(*own, strict=True):
                for column, value in zip(out, (ah, ch, dd, kk, lo, place - lo, hi - lo + 1, c, raw[lo : hi + length], crowd), strict=True):
                    column.append(value)
                size += hi - lo + length
            if size > 2 << 20:
                yield batch(out)
                out, size = [[] for _ in kinds], 0
        yield batch(out)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window of a context with a 128-bit hash, for anchors too common to gather."""
    import xxhash

    for b in batches:
        for i in range(0, b.num_rows, 512):
            out = [[] for _ in range(6)]
            for _, _, d, k, lo, _, n, c, raw, _ in zip(*(x.to_pylist() for x in b.slice(i, 512).columns), strict=True):
                for w in range(n):
                    for column, value in zip(out, (d, k, lo + w, c, *np.frombuffer(xxhash.xxh3_128_digest(raw[w : w + length]), np.int64).tolist()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["d", "k", "s", "c", "h1", "h2"])


def _settle(texts: DataFrame, ones: DataFrame, length: int) -> DataFrame:
    """Spans of the single classes among ``ones`` (ah, ch, c, d, k, place, lo, hi, crowd), and classes that fail (s = -1); stored."""
    wanted = ones.groupBy("d", "k").agg(F.collect_set(F.struct("ah", "ch", "c", "place", "lo", "hi", "crowd")).alias("__wanted"))
    context = texts.select("d", "k", "__bytes").join(wanted.hint("shuffle_hash"), ["d", "k"]).select("d", "k", "__bytes", "__wanted").mapInArrow(lambda it: _contexts(it, length), CONTEXT)
    context = stored(context)
    schema = ", ".join(f"{c} long" for c in FOUND)
    sorted_ = context.where("not crowd").repartition("ah").sortWithinPartitions("ah", "ch")
    edges = sorted_.mapInArrow(lambda it: _sort_groups(it, length), schema)
    common = context.where("crowd")
    failed = common.where("c > 1").repartition("ah", "ch").sortWithinPartitions("ah", "ch").mapInArrow(_compare, schema)
    every = common.mapInArrow(lambda it: _windows(it, length), "d long, k long, s long, c long, h1 long, h2 long")
    twice = every.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    zero = F.lit(0).cast("long")
    again = every.where("c = 1").join(twice, ["h1", "h2"], "left_semi").select("d", "k", "s", (F.col("s") + length).alias("e"), zero.alias("ah"), zero.alias("ch"))
    out = stored(edges.unionByName(failed).unionByName(again))
    forget(context)
    return out


def _crowds(rows: DataFrame, contexts: F.Column, most: int) -> DataFrame:
    """Adds crowd: whether the anchor of a row has more than ``most`` ``contexts``."""
    sizes = stored(rows.groupBy("ah").agg(F.count("*").alias("n"), (F.sum(contexts) > most).alias("crowd")))
    return dealt_join(rows, sizes, ["ah"], "n", rows.count(), ("ch",))


def repeated_spans(texts: DataFrame, *, length: int = LENGTH, gram: int = GRAM, most: int = MOST_CLASSES, class_bits: int = 64) -> DataFrame:
    """(d, k, s, e): byte ranges covered by repeated strings; they may overlap.

    ``texts`` has the columns of ``keyed``. ``class_bits`` shortens the hash of a class,
    for tests of what happens when different strings share it.
    """
    import pyarrow.compute  # noqa: F401

    if not 0 < gram < length:
        raise ValueError("the anchor must be shorter than the string")
    bounded(texts.sparkSession)
    found = texts.select("d", "k", "__bytes").mapInArrow(lambda it: _find(it, length, gram, class_bits), "d long, k long, place long, lo long, hi long, ah long, ch long")
    found = stored(found)
    often = found.groupBy("ah").agg(F.count("*").alias("n"), F.min("ch").alias("a"), F.max("ch").alias("b")).where("n > 1")
    often = stored(often.select("ah", "n", (F.col("a") != F.col("b")).alias("mixed")))
    left = stored(dealt_join(found, often, ["ah"], "n", found.count(), ("d", "k", "place")).drop("n"))
    forget(found, often)
    member = F.xxhash64("d", "k", "place")
    classes = stored(left.groupBy("ah", "ch").agg(F.count("*").alias("c"), F.min(member).alias("one"), F.max(member).alias("other")))
    crowds = _crowds(classes, F.least("c", F.lit(2)), most)
    left_ = stored(dealt_join(left, crowds, ["ah", "ch"], "c", left.count(), ("d", "k", "place")).drop("n"))
    lone = F.col("c") == 1
    ones = left_.where((lone & F.col("mixed")) | ((member == F.col("one")) | (member == F.col("other"))) & ~lone)
    edges = _settle(texts, ones, length)
    whole = left_.where(~lone).select("d", "k", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"), "ah", "ch")
    opened = edges.where("s < 0").select("ah", "ch").distinct()
    spans = edges.where("s >= 0")
    if not opened.isEmpty():  # two strings under one hash: the members of such anchors one by one
        whole = whole.join(opened, ["ah", "ch"], "left_anti")
        beside = left.join(opened.select("ah").distinct(), "ah", "left_semi").withColumn("ch", F.xxhash64("ch", "d", "k", "place")).withColumn("c", F.lit(1).cast("long"))
        spans = spans.unionByName(_settle(texts, _crowds(beside, F.lit(1), most), length).where("s >= 0"))
    out = stored(whole.unionByName(spans).select("d", "k", "s", "e"))
    forget(left, left_, classes, edges)
    return out


def merged(spans: pa.ListScalar) -> list[tuple[int, int]]:
    """Maximal ranges, in order, of an Arrow list of structs (s, e)."""
    if not spans.is_valid or not len(spans.values):
        return []
    s, e = (spans.values.field(n).to_numpy() for n in ("s", "e"))
    by = np.argsort(s, kind="stable")
    s, e = s[by], np.maximum.accumulate(e[by])
    head = np.r_[True, s[1:] > e[:-1]]
    return list(zip(s[head].tolist(), e[np.r_[head[1:], True]].tolist(), strict=True))


def kept_bytes(data: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for s, e in cut:
        parts.append(data[at:s])
        at = e
    return b"".join([*parts, data[at:]])


def spans_of(texts: DataFrame, length: int, most: int) -> DataFrame:
    """(d, k, __spans): the repeated spans of each row that has any."""
    return repeated_spans(texts, length=length, most=most).groupBy("d", "k").agg(F.collect_list(F.struct("s", "e")).alias("__spans"))


def dedup(docs: DataFrame, *, length: int = LENGTH, doc: str = "doc_id", text: str = "text", most: int = MOST_CLASSES) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256, spans), one row per row of ``docs``.

    ``spans`` are the maximal removed byte ranges.
    """
    texts = keyed(docs, doc, text)
    rows = texts.join(spans_of(texts, length, most).hint("shuffle_hash"), ["d", "k"], "left")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(doc, rows.schema["__doc"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", span)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for b in batches:
            out = [[] for _ in range(5)]
            for raw, spans in zip(b.column(1), b.column(2), strict=True):
                data, gone = raw.as_py(), merged(spans)
                kept = kept_bytes(data, gone)
                for column, value in zip(out, (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in gone]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=[f.name for f in schema])

    return rows.select("__doc", "__bytes", "__spans").mapInArrow(cut, schema)


def remove(docs: DataFrame, *, length: int = LENGTH, doc: str = "doc_id", text: str = "text", most: int = MOST_CLASSES) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``; null texts stay null.

    Characters that a cut splits go whole. Other columns, of whatever name, are unchanged.
    """
    texts = keyed(docs, doc, text)
    rest = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text])
    whole = docs.select(rest.alias("__rest"), F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("k"), F.col(text).cast("string").alias("__text"))
    rows = whole.join(spans_of(texts, length, most).hint("shuffle_hash"), ["d", "k"], "left").select("__rest", "__text", "__spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [kept_bytes(t.as_py().encode(), merged(spans)).decode(errors="ignore") if spans.is_valid and t.is_valid else t.as_py() for t, spans in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["__rest", "__text"])

    done = rows.mapInArrow(cut, T.StructType([rows.schema["__rest"], T.StructField("__text", T.StringType())]))
    return done.select(*[F.col("__text").alias(c) if c == text else F.col(f"__rest.`{c}`") for c in docs.columns])
