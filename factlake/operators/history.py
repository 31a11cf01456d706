"""Freshness, state timelines and counts over (key, value, serial, ord) rows.

The serial orders facts from old to new; on equal serials the row of least ``ord``
counts as first. A state is a run of equal normal forms; rows without a normal form
are dropped before runs are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.text import normal
from factlake.operators import ranks


def freshest(df: DataFrame, *key: str) -> DataFrame:
    """The row of the largest serial of each key; first wins a tie."""
    best = F.max(F.struct("serial", (-F.col("ord")).alias("o"), "value"))
    return df.groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.value").alias("value"), F.col("b.serial").alias("serial"))


def earliest(df: DataFrame, *key: str) -> DataFrame:
    best = F.min(F.struct("serial", "ord", "value"))
    return df.groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.value").alias("value"), F.col("b.serial").alias("serial"))


#: Rows of one key beyond which its timeline is collapsed in ranges of serials.
HOT_ROWS = 1 << 20


def timeline(df: DataFrame, *key: str, norm: Column | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """States from new to old, with their position from 0 in ``state``.

    A key's rows are ordered by one task; where some key has more than ``hot_rows``, all are
    collapsed in ranges, whose borders are stitched.
    """
    n = df.withColumn("__n", normal(F.col("value")) if norm is None else norm).where("__n <> ''")
    most = df.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    if most > hot_rows:
        return _stitched(n, key)
    newest = Window.partitionBy(*key).orderBy(F.desc("serial"), "ord")
    kept = n.withColumn("__last", F.lag("__n").over(newest)).where(F.col("__last").isNull() | (F.col("__last") != F.col("__n")))
    return kept.withColumn("state", (F.row_number().over(newest) - 1).cast("long")).select(*key, "state", "value", "serial")


def _stitched(n: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The same, by ranges of (key, serial): a run that crosses a border goes on, positions add up.

    A range's border has one row a key: its last normal form, and the number of its states.
    """
    rows = ranks.ranges(n, *key, F.desc("serial"), "ord")
    within, across = Window.partitionBy(*key, "__range").orderBy("__at"), Window.partitionBy(*key).orderBy("__range")
    renamed = [*[F.col(k).alias(f"__{k}") for k in key], F.col("__range").alias("__r")]

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, ranks.same(left, right, key) & (left["__range"] == right["__r"]))

    ends = rows.groupBy(*key, "__range").agg(F.max_by("__n", "__at").alias("__end"))
    came = ends.withColumn("__came", F.lag("__end").over(across)).select(*renamed, "__came")
    joined = beside(rows.withColumn("__last", F.coalesce(F.lag("__n").over(within), F.lit(""))), came)
    last = F.when(F.col("__last") == "", F.col("__came")).otherwise(F.col("__last"))  # no normal form is empty here
    kept = joined.where(last.isNull() | (last != F.col("__n"))).select(*key, "__range", "__at", "value", "serial")
    before = F.coalesce(F.sum("__k").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = kept.groupBy(*key, "__range").agg(F.count("*").alias("__k")).withColumn("__base", before).select(*renamed, "__base")
    out = beside(kept.withColumn("__rn", F.row_number().over(within) - 1), bases)
    return out.select(*key, (F.col("__base") + F.col("__rn")).alias("state"), "value", "serial")


def nth_prior(df: DataFrame, n: int, *key: str, clamp: bool = False) -> DataFrame:
    """The n-th state before the latest; beyond the oldest: that one (``clamp``) or null."""
    states = timeline(df, *key)
    if clamp:
        back = F.max_by(F.struct("value", "serial"), F.when(F.col("state") <= n, F.col("state")))
        return states.groupBy(*key).agg(back.alias("b")).select(*key, F.col("b.value").alias("value"), F.col("b.serial").alias("serial"))
    keys = df.select(*key).distinct()
    found = states.where(F.col("state") == n).select(*key, "value", "serial")
    status = F.when(F.col("value").isNull(), "insufficient_history").otherwise("answered")
    return keys.join(found, list(key), "left").withColumn("status", status)


def distinct_count(df: DataFrame, *key: str) -> DataFrame:
    n = normal(F.col("value"))
    return df.groupBy(*key).agg(F.count_distinct(F.when(n != "", n)).alias("n_distinct"))


def distinct_list(df: DataFrame, *key: str) -> DataFrame:
    """First spelling of each normal form, oldest first, joined by ``|``."""
    n = df.withColumn("__n", normal(F.col("value"))).where("__n <> ''")
    first = n.groupBy(*key, "__n").agg(F.min(F.struct("serial", "ord", "value")).alias("f"))
    every = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["value"]), "|")
    return first.groupBy(*key).agg(every.alias("values"), F.count("*").alias("n_distinct"))


def histories(df: DataFrame, *key: str) -> DataFrame:
    """All values of a key, oldest first, joined by ``|``."""
    every = F.array_sort(F.collect_list(F.struct("serial", "ord", "value")))
    return df.groupBy(*key).agg(F.array_join(F.transform(every, lambda x: x["value"]), "|").alias("history"), F.count("*").alias("n_facts"))


def conflicting(df: DataFrame, *key: str) -> DataFrame:
    """Keys with two facts and two raw values at least."""
    return df.groupBy(*key).agg(F.count("*").alias("n_facts"), F.count_distinct("value").alias("n_distinct")).where("n_facts >= 2 and n_distinct >= 2")
