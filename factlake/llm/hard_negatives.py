"""Hard negatives by bit-sliced integer products with score intervals.

Components are integers. A candidate's components, shifted to be non-negative, are cut into
bit planes of 64 components a word, an anchor's into planes of its positive and its negative
parts. Planes of the candidates are taken most significant first: the product of the anchor
with a plane is a weighted count of common bits, and what the planes still to come can add is at least minus the
anchor's negative, at most its positive sum times the largest rest. So every candidate has
an interval of scores that halves with each plane, and goes once it can't qualify:

* positives: its upper end is below the k-th best lower end;
* negatives: for every positive it lies outside the window of scores, or below the k-th best
  lower end of those that are surely inside.

After the last plane the interval is the score itself. Anchors and rows are dealt into blocks of a bounded
size, positives by label; a tile (a pair of blocks) hands back its best few for each anchor,
which are ranked over all tiles. The work is anchors times rows; bytes shuffled are that
divided by the size of a block.

Defined cases: rows with a null id, label or vector, a null or non-finite component,
or components so large (over 2**31, or products beyond 55 bits) that sums might not be exact, take no part; vectors of
different lengths are never compared, empty ones have products of 0; rows of one id are
separate rows, and which of them comes first is undefined where scores tie; an anchor
without a positive, or a positive without a negative, gives no rows, nor does an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import checkpoint, dealt_join

#: Bytes of a block's components, about, and its rows at most; a tile holds two blocks.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 1 << 16
#: Candidates whose planes are counted at once.
STRIPE = 8192


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    words = -(-bits.shape[1] // 64)
    out = np.zeros((len(bits), words * 8), np.uint8)
    some = np.packbits(bits, axis=1, bitorder="little")
    out[:, : some.shape[1]] = some
    return out.view(np.uint64)


def planes(x: np.ndarray) -> list[np.ndarray]:
    """Bit planes of non-negative integers, least significant first."""
    return [packed((x >> k & 1).astype(bool)) for k in range(int(x.max(initial=0)).bit_length())]


class Candidates:
    """Rows as bit planes of their components above the least one."""

    def __init__(self, x: np.ndarray):
        self.n, self.low = len(x), int(x.min(initial=0))
        self.planes = planes(x - self.low)


class Anchor:
    def __init__(self, a: np.ndarray):
        plus, minus = np.maximum(a, 0), np.maximum(-a, 0)
        self.plus, self.minus = int(plus.sum()), int(minus.sum())
        one, two = (planes(v[None]) for v in (plus, minus))
        self.weights = np.array([1 << k for k in range(len(one))] + [-(1 << k) for k in range(len(two))], np.float64)
        self.words = np.concatenate([*one, *two]) if len(self.weights) else None

    def times(self, plane: np.ndarray) -> np.ndarray:
        """Products with rows of bits, by weighted counts of common bits: below 2**53, so exact."""
        out = np.zeros(len(plane), np.int64)
        if self.words is None or not plane.shape[1]:
            return out
        step = max(1, STRIPE // plane.shape[1])
        for k in range(0, len(plane), step):
            common = np.bitwise_count(self.words[:, None, :] & plane[None, k : k + step])
            out[k : k + step] = self.weights @ common.sum(axis=2, dtype=np.uint32)
        return out


def refine(anchor: Anchor, rows: Candidates, alive: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """The candidates (row numbers) that ``keep`` leaves to the end, and their exact scores.

    ``keep`` gets the ends of all intervals after every plane, and may return a mask.
    """
    total = anchor.plus - anchor.minus
    low = np.full(len(alive), rows.low * total, np.int64)
    for k in range(len(rows.planes) - 1, -1, -1):
        low = low + (anchor.times(rows.planes[k][alive]) << k)
        rest = (1 << k) - 1
        mask = keep(low - anchor.minus * rest, low + anchor.plus * rest)
        if mask is not None and not mask.all():
            alive, low = alive[mask], low[mask]
        if not len(alive):
            break
    return alive, low


def kth(values: np.ndarray, k: int) -> int | None:
    """The k-th largest value, if there are as many."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def positives_in_tile(anchors: dict, rows: dict, k: int) -> Iterator[tuple]:
    """(anchor, position, id, score) of the k best rows of a tile, the anchor's own left out."""
    candidates = Candidates(rows["v"])

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray | None:
        least = kth(low, k)
        return None if least is None else high >= least

    for u, v in zip(anchors["u"].tolist(), anchors["v"], strict=True):
        alive, score = refine(Anchor(v), candidates, np.flatnonzero(rows["u"] != u), keep)
        for at in best(score, rows["id"][alive], k):
            yield u, 0, int(rows["id"][alive[at]]), int(score[at])


def negatives_in_tile(anchors: dict, rows: dict, k: int) -> Iterator[tuple]:
    """(anchor, position of the positive, id, score) of the k best rows in each window of scores."""
    candidates = Candidates(rows["v"])
    for u, label, v, windows in zip(anchors["u"].tolist(), anchors["label"].tolist(), anchors["v"], anchors["windows"], strict=True):

        def keep(low: np.ndarray, high: np.ndarray, windows=windows) -> np.ndarray:
            mask = np.zeros(len(low), bool)
            for w in windows:
                sure = kth(low[(low >= w["low"]) & (high <= w["high"])], k)
                mask |= (high >= max(w["low"], sure if sure is not None else w["low"])) & (low <= w["high"])
            return mask

        alive, score = refine(Anchor(v), candidates, np.flatnonzero(rows["label"] != label), keep)
        for w in windows:
            inside = np.flatnonzero((score >= w["low"]) & (score <= w["high"]))
            for at in inside[best(score[inside], rows["id"][alive[inside]], k)]:
                yield u, w["k"], int(rows["id"][alive[at]]), int(score[at])


def in_tiles(rows: DataFrame, anchors: DataFrame, keys: list[str], each: Callable[[dict, dict], Iterator[tuple]], block: int) -> DataFrame:
    """(a, k, id, score): what ``each`` finds in every pair of a block of anchors and a block of rows with equal ``keys``."""
    # smaller blocks for a small table, so that there are as many tiles as shuffle partitions
    some = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = F.least(F.lit(block), F.floor(BLOCK_BYTES / (4 * F.greatest(F.lit(1), F.col("dim")))))
    n_rows = rows.count()
    held = F.greatest(F.lit(1), F.least(most, F.lit(max(min(256, block), -(-n_rows // some)))))
    own = rows.groupBy(*keys).agg(F.count("*").alias("m"), *([] if "dim" in keys else [F.first("dim").alias("dim")]))
    wide = own.join(anchors.groupBy(*keys).agg(F.count("*").alias("m2")), keys)
    widths = checkpoint(wide.select(*keys, (F.col("m") + F.col("m2")).alias("m"), F.ceil(F.col("m") / held).cast("int").alias("rows"), F.ceil(F.col("m2") / F.greatest(F.lit(1), most)).cast("int").alias("anchors")))
    sides = []
    for df, mine, others, side in ((rows, "rows", "anchors", 0), (anchors, "anchors", "rows", 1)):
        dealt = dealt_join(df, widths, keys, "m", n_rows, ("u",)).withColumn("__own", F.pmod(F.xxhash64("u"), F.col(mine)).cast("int"))
        dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        i, j = ("__own", "__other") if side == 0 else ("__other", "__own")
        windows = [] if "windows" not in anchors.columns else ["windows"] if side else [F.lit(None).cast(anchors.schema["windows"].dataType).alias("windows")]
        sides.append(dealt.select(*keys, F.col(i).alias("__i"), F.col(j).alias("__j"), F.lit(side).alias("side"), "u", "id", *([] if "label" in keys else ["label"]), "v", *windows))

    def tile(_, table):
        table = table.combine_chunks()
        side = table["side"].to_numpy()
        v = table["v"].chunk(0) if table["v"].num_chunks else pa.array([], table["v"].type)
        x = v.flatten().to_numpy().astype(np.int64).reshape(len(side), -1) if len(v.flatten()) else np.zeros((len(side), 0), np.int64)
        data = {c: table[c].to_numpy() for c in ("u", "id", "label") if c in table.column_names}
        one, two = ({c: y[side == k] for c, y in (data | {"v": x}).items()} for k in (1, 0))
        if "windows" in table.column_names:
            one["windows"] = table["windows"].filter(pa.array(side == 1)).to_pylist()
        found = list(each(one, two)) if len(one["u"]) and len(two["u"]) else []
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("a", "k", "id", "score"))})

    return sides[0].unionByName(sides[1]).groupBy(*keys, "__i", "__j").applyInArrow(tile, "a long, k long, id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of every anchor and position, over all tiles."""
    order = Window.partitionBy("a", "k").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, vec: str = "vec_id", label: str = "label", vector: str = "embedding", block: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A negative's score is between ``low`` and ``high`` hundredths of the positive's;
    ``anchor`` tells which rows of ``df`` are anchors.
    """
    x = F.col(vector).cast("array<double>")
    usable = F.coalesce(F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < 8e6), F.lit(False))), F.lit(False)) & F.col(vec).isNotNull() & F.col(label).isNotNull()
    whole = F.transform(x, lambda e: F.floor(F.lit(scale) * e).cast("int"))
    rows = df.select(F.col(vec).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.when(usable, whole).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor")).where("v is not null")
    largest = F.aggregate("v", F.lit(0), lambda a, e: F.greatest(a, F.abs(e))).cast("double")
    rows = rows.where(F.size("v") * largest * largest < float(1 << 55))
    rows = checkpoint(rows.withColumn("dim", F.size("v")).withColumn("u", F.monotonically_increasing_id()))
    anchors = rows.where("anchor")

    found = in_tiles(rows, anchors, ["dim", "label"], lambda a, r: positives_in_tile(a, r, positives), block)
    near = checkpoint(ranked(found, positives).select("a", F.col("rank").cast("long").alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    hundredth = lambda c: F.call_function("div", c - F.pmod(c, F.lit(100)), F.lit(100).cast("long"))
    at_least, at_most = -hundredth(F.col("positive_score") * -low), hundredth(F.col("positive_score") * high)
    window = F.struct("k", at_least.alias("low"), at_most.alias("high"))
    windows = near.where(at_least <= at_most).groupBy("a").agg(F.collect_list(window).alias("windows"))
    asked = anchors.join(windows, F.col("u") == F.col("a")).drop("a")
    found = in_tiles(rows, asked, ["dim"], lambda a, r: negatives_in_tile(a, r, negatives), block)
    out = ranked(found, negatives).select("a", "k", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("u").alias("a"), F.col("id").alias("anchor_id"))
    return out.join(near, ["a", "k"]).join(names, "a").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
