"""Manifests: canonical JSON of rows, fingerprints of tables that don't depend on order, and what differs.

Canonical JSON has its keys sorted at every level, no spaces, and text outside ASCII as it
is; numbers and control characters are as Spark's JSON writer prints them, times and other types as
their text. A table's fingerprint is made from sums of parts of its rows' hashes, so rows may
be dealt and read in any way, and a repeated row counts as often as it occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hexadecimal digits of a part of a hash; its sums are exact below 10**38.
PART = 16


def quoted(text: Column) -> Column:
    """A JSON string of a text."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _value(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        pairs = [F.concat(F.lit(f"{_name(f.name)}:"), _value(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
        out = F.when(c.isNotNull(), out)
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _value(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat(quoted(k.cast("string")), F.lit(":"), _value(F.element_at(c, k), kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        out = c.cast("string")
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        listed = F.to_json(F.array(c))
        out = F.substring(listed, F.lit(2), F.length(listed) - 2)
    else:
        out = quoted(c.cast("string"))
    return F.coalesce(out, F.lit("null"))


def _name(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)


def canonical(df: DataFrame) -> Column:
    """The canonical JSON of a row of ``df``, whatever its schema."""
    pairs = [F.concat(F.lit(f"{_name(f.name)}:"), _value(df[f.name], f.dataType)) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def row_hashes(df: DataFrame, *key: str) -> DataFrame:
    """(key, hash): sha256 of each row's canonical JSON."""
    return df.select(*key, F.sha2(canonical(df), 256).alias("hash"))


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """(name, n_rows, fingerprint) of a table: one pass, partial sums in every task."""
    part = lambda i: F.conv(F.substring("hash", 1 + i * PART, PART), 16, 10).cast("decimal(20,0)")
    sums = row_hashes(df).agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("string").alias(f"s{i}") for i in range(64 // PART)])
    return sums.select(F.lit(name).alias("name"), "n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), *[f"s{i}" for i in range(64 // PART)]), 256).alias("fingerprint"))


def recompute(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [fingerprint(df, name) for name, df in tables.items()])


def verify(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(name, status): every table of either manifest that isn't the same in both."""
    a, b = frozen.select("name", F.struct("n_rows", "fingerprint").alias("__a")), now.select("name", F.struct("n_rows", "fingerprint").alias("__b"))
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.col("__a.n_rows") != F.col("__b.n_rows"), "rows").when(F.col("__a.fingerprint") != F.col("__b.fingerprint"), "content")
    return a.join(b, "name", "full_outer").select("name", status.alias("status")).where("status is not null")


def differences(frozen: DataFrame, now: DataFrame, *key: str) -> DataFrame:
    """(key, status): rows by key that are missing, extra or changed; both sides come from ``row_hashes``."""
    a, b = frozen.withColumnRenamed("hash", "__a"), now.withColumnRenamed("hash", "__b")
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.col("__a") != F.col("__b"), "changed")
    return a.join(b, list(key), "full_outer").select(*key, status.alias("status")).where("status is not null")
