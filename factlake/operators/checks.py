"""Joins that refuse missing partners, comparisons of sets, extremes and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a row of ``left`` without a partner is an error, raised where it is met."""
    both = left.join(right.withColumn("__hit", F.lit(True)), keys, "left")
    missing = F.raise_error(F.concat(F.lit("no partner for "), F.to_json(F.struct(*keys))))
    return both.where(F.coalesce("__hit", missing.cast("boolean"))).drop("__hit")


def extremes(value: Column, order: Column) -> dict[str, Column]:
    """Aggregates: least and largest value, and where the largest stands first."""
    return {"least": F.min(value), "largest": F.max(value), "first_largest": -F.max(F.struct(value.alias("v"), (-order).alias("o")))["o"]}


def equal_sets(rows: DataFrame, group: str, member: str, one: Column, other: Column) -> DataFrame:
    """(group, same): whether the members that hold ``one`` are those that hold ``other``; no set is gathered."""
    each = rows.groupBy(group, member).agg(F.bool_or(one).alias("a"), F.bool_or(other).alias("b"))
    return each.groupBy(group).agg(F.bool_and(F.col("a") == F.col("b")).alias("same"))


def failing(rows: DataFrame, category: str, passed: tuple[str, ...]) -> DataFrame:
    """The rows of every category but ``passed``, each beside the number of its category."""
    bad = rows.where(~F.col(category).isin(*passed))
    return bad.join(bad.groupBy(category).agg(F.count("*").alias("n")), category)


def stride(rows: DataFrame, key: str, step: int, n: int) -> DataFrame:
    """Every ``step``-th row in the order of ``key``, the first ``n`` of them; no more rows are numbered."""
    head = rows.orderBy(key).limit(step * (n - 1) + 1)
    return head.withColumn("__i", F.row_number().over(Window.orderBy(key)) - 1).where(F.col("__i") % step == 0).drop("__i")


def stratified_split(rows: DataFrame, key: str, stratum: str, sizes: tuple[tuple[str, int], ...]) -> DataFrame:
    """(key, stratum, split): in each stratum the first rows by hash of their key, dealt to disjoint splits."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.sha2(F.col(key), 256), key))
    split, upto = F, 0
    for name, n in sizes:
        upto += n
        split = split.when(F.col("__p") <= upto, name)
    return rows.withColumn("__p", place).where(F.col("__p") <= upto).select(key, stratum, split.alias("split"))
