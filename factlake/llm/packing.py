"""Best-fit decreasing packing of token pieces into fixed-length sequences.

Best-fit decreasing looks at lengths only, so the whole corpus is packed from a
histogram of piece lengths (at most ``capacity`` rows): a segment tree over the
remaining capacities finds the tightest open bin in logarithmic time, and equal
bins take equal pieces in bulk. The outcome is a table of ranges -- "pieces of
length l with ranks r0..r1 go to bins b0.. at offset o" -- whose size depends on the
capacity, not on the corpus. Pieces get their rank within their length from salted
windows, so no length is gathered in one task.

Defined cases: a null or empty text is the end id alone; identical rows are packed
as separate documents; any number of documents, also none, gives gapless sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import checkpoint, map_texts

class ByteBpe:
    """Ids of the tokenizers library, added tokens in a text included.

    Where the tokenizer is plain byte-level BPE with ids in the order of its merges,
    tiktoken merges with the tokenizer's own vocabulary, to the same ids at a fraction of
    the cost; texts are first cut at added tokens, as the library does. Any other
    tokenizer encodes the texts itself.
    """

    #: Fixed value: the pre-tokenising pattern of byte-level BPE.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        """Ids of a text without added tokens, as bytes; None for tokenizers of other kinds."""
        import json
        import re

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", ())
        if model["type"] != "BPE" or model.get("dropout") or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False:
            return None
        if any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip")):
            return None
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        if ids != sorted(ids):
            return None
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        merge = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer
        none: set[str] = set()

        def fast(text: str) -> bytes:
            try:
                return bytes(merge(text, none))
            except ValueError:  # white space of millions of characters: its pattern's stack is bounded
                return self.slow(text)

        return fast

    def slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one(self, text: str) -> bytes:
        if not self.fast:
            return self.slow(text)
        if not self.at_added or not self.at_added.search(text):
            return self.fast(text)
        return b"".join(self.added.get(x) or self.fast(x) for x in self.at_added.split(text) if x)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as unsigned little-endian 32-bit integers."""
        return [self.one(t) if t else b"" for t in texts]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(df: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """One row per piece: ``keep``, piece, start, length, ids_crc32 and, if asked, ids."""
    one = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())] + [("ids", T.ArrayType(T.LongType()))] * with_ids
    pieces = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in one]))

    def make():
        bpe, last = ByteBpe(tokenizer), np.array([end_id], "<u4").tobytes()

        def each(texts):
            out, rows = {n: [] for n, _ in one}, [0]
            for data in bpe.encode(texts):
                data += last
                for start, n in cut(len(data) // 4, capacity):
                    piece = data[4 * start : 4 * (start + n)]
                    out["start"].append(start)
                    out["length"].append(n)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    if with_ids:
                        out["ids"].append(np.frombuffer(piece, "<u4").astype(np.int64).tolist())
                rows.append(len(out["start"]))
            long = pa.int64()
            kinds = {"ids": pa.list_(long)}
            values = pa.StructArray.from_arrays([pa.array(v, kinds.get(n, long)) for n, v in out.items()], names=list(out))
            return {"__pieces": pa.ListArray.from_arrays(pa.array(rows, pa.int32()), values)}

        return each

    got = map_texts(df, text, T.StructType([T.StructField("__pieces", pieces)]), make, keep)
    return got.select(*keep, F.posexplode("__pieces").alias("piece", "__p")).select(*keep, "piece", *[F.col(f"__p.{n}").alias(n) for n, _ in one])


class Remaining:
    """Segment tree over remaining capacities 0..capacity; a leaf counts groups of bins."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, r: int, n: int) -> None:
        r += self.size
        while r:
            self.tree[r] += n
            r >>= 1

    def tightest(self, least: int) -> int | None:
        """Smallest non-empty capacity of ``least`` or more."""
        node = least + self.size
        if self.tree[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges (length, first rank, pieces, first bin, pieces a bin, offset in the bin).

    Piece t of a range goes to bin ``first bin + t // pieces a bin``, at ``offset +
    (t % pieces a bin) * length``. The same bins come out as from best-fit decreasing
    one piece at a time.
    """
    tree, open_bins, ranges, bins = Remaining(capacity), [[] for _ in range(capacity + 1)], [], 0

    def put(r: int, first: int, n: int) -> None:
        if n and r:
            open_bins[r].append((first, n))
            tree.add(r, 1)

    for length, left in sorted(histogram, reverse=True):
        rank = 0
        while left:
            r = tree.tightest(length)
            if r is None:
                r, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                each = r // length
                first, n = open_bins[r].pop()
                tree.add(r, -1)
            full = min(n, left // each)
            if full:
                ranges.append((length, rank, full * each, first, each, capacity - r))
                put(r - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                some = min(left, each)
                if some:
                    ranges.append((length, rank, some, first + full, each, capacity - r))
                    put(r - some * length, first + full, 1)
                    rank, left = rank + some, left - some
                    full += 1
                if full < n:
                    put(r, first + full, n - full)
    return ranges


def pack(pieces: DataFrame, *, capacity: int = 1024, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``order`` decides ranks among pieces of equal length; rows that tie in it are
    interchangeable. The pieces are written to the checkpoint folder first: they are
    read twice, and ranks must not change between the readings.
    """
    spark = pieces.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = checkpoint(pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts))))
    counts = pieces.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    histogram = [(r[0], r[1]) for r in counts.groupBy("length").agg(F.sum("__n")).collect()]  # at most ``capacity`` rows
    ranges = sorted(best_fit(histogram, capacity))
    table = np.array(ranges, np.int64).reshape(-1, 6)
    keys = table[:, 0] << 40 | table[:, 1]
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__salt").orderBy(*order)
    ranked = pieces.withColumn("__rn", F.row_number().over(within)).join(bases, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__base") + F.col("__rn") - 1).drop("__base", "__rn", "__salt")
    names = [c for c in ranked.columns if c != "__rank"]
    schema = T.StructType([ranked.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            row = table[np.searchsorted(keys, length << 40 | rank, "right") - 1]
            t = rank - row[:, 1]
            columns = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 3] + t // row[:, 4]), pa.array(row[:, 5] + t % row[:, 4] * length)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
