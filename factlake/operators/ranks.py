"""Exact places in an order, with no key and no table gathered in one task.

Rows are dealt by ranges of (keys, order) -- splitters are sampled -- and sorted within them. A
row's place in the whole order is its place in its range, plus the rows of the
ranges before, of which there is one number a range. A key's first place, taken from all of them,
turns it into a place within the key. A key with most of the rows lies in many ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators.layout import settled

#: Bits of a row's place within its range, as Spark numbers rows.
ROW_BITS = 33


def ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` dealt and sorted by ``order``, and written so; adds ``__range`` and the place ``__at`` in it, from 0."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    dealt = settled(dealt)
    return dealt.withColumn("__range", F.shiftright("__id", ROW_BITS).cast("int")).withColumn("__at", F.col("__id").bitwiseAND((1 << ROW_BITS) - 1)).drop("__id")


def numbered(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """Adds the place of every row in the order of the whole table, from 0; tied rows in any order, but once and for all."""
    dealt = ranges(df, *order)
    sizes = {r[0]: r[1] for r in dealt.groupBy("__range").count().collect()}  # a row a range
    bases, total = [], 0
    for k in range(max(sizes, default=0) + 1):
        bases.append(total)
        total += sizes.get(k, 0)
    base = F.element_at(F.array(*[F.lit(b).cast("long") for b in bases]), F.col("__range") + 1)
    return dealt.withColumn(name, F.col("__at") + base).drop("__range", "__at")


def same(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__{k}"]) for k in keys])


def placed(df: DataFrame, keys: tuple[str, ...], *order: Column | str, name: str = "place") -> DataFrame:
    """Adds the place of every row within its key, from 0; nulls are a key of their own."""
    whole = numbered(df, *keys, *order, name="__g")
    first = whole.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("__g").alias("__first"))
    return whole.join(first, same(whole, first, keys)).withColumn(name, F.col("__g") - F.col("__first")).drop("__g", "__first", *[f"__{k}" for k in keys])


def nearest_ranks(df: DataFrame, keys: tuple[str, ...], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key, for each share the value at index floor(share * n), at most the last, of its sorted values.

    The wanted places are worked out from the keys' sizes, and rows are joined by place: no key is hot.
    Nulls are left out; a key without values has no row.
    """
    whole = numbered(df.select(*keys, value).where(F.col(value).isNotNull()), *keys, value, name="__g")
    sizes = whole.groupBy(*keys).agg(F.min("__g").alias("__first"), F.count("*").alias("__n"))
    at = [F.struct(F.lit(k).alias("share"), (F.col("__first") + F.least(F.col("__n") - 1, F.floor(F.col("__n") * s))).alias("g")) for k, s in shares.items()]
    wanted = sizes.select(*keys, F.explode(F.array(*at)).alias("w")).select(*keys, "w.share", F.col("w.g").alias("__g"))
    got = wanted.join(whole.select("__g", value), "__g")
    return got.groupBy(*keys).agg(*[F.max(F.when(F.col("share") == k, F.col(value))).alias(k) for k in shares])
