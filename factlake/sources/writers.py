"""Sinks; every write goes through Spark's committers, so readers never see half a file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_json(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    df.write.mode("append").json(path)


def replace_json(df: DataFrame, path: str) -> None:
    """Replaces the rows at ``path``: written whole beside it, then put in its place by renaming.

    A failed write leaves the old rows. Between the two renames a reader finds nothing at
    ``path``, never half of it; the old rows go last.
    """
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    new, old, here = (jvm.org.apache.hadoop.fs.Path(path + x) for x in (f".new-{uuid.uuid4().hex}", f".old-{uuid.uuid4().hex}", ""))
    df.write.json(new.toString())
    fs = here.getFileSystem(conf)
    had = fs.exists(here)
    if had and not fs.rename(here, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(new, here):
        raise OSError(f"{path} can't be replaced")
    if had:
        fs.delete(old, True)


def pretty_json(df: DataFrame, path: str) -> None:
    """One indented JSON array of a small, already aggregated result, put in its place by renaming."""
    import json

    rows = [json.loads(x) for x in df.toJSON().collect()]
    context = df.sparkSession.sparkContext
    jvm, here = context._jvm, context._jvm.org.apache.hadoop.fs.Path(path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.new-{uuid.uuid4().hex}")
    fs = here.getFileSystem(context._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    try:
        out.write(bytearray((json.dumps(rows, ensure_ascii=False, indent=2) + "\n").encode()))
    finally:
        out.close()
    fs.delete(here, False)
    if not fs.rename(new, here):
        raise OSError(f"{path} can't be replaced")


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def put_embeddings(df: DataFrame, path: str, key: str) -> None:
    """Adds (serial, vec) rows under a content key."""
    df.select(F.lit(key).alias("key"), F.col("serial").cast("long"), F.col("vec").cast("array<float>")).write.mode("append").partitionBy("key").parquet(path)


def markdown(df: DataFrame) -> str:
    """A report table of a small, already aggregated result."""
    rows = df.collect()
    lines = [" | ".join(df.columns), " | ".join("---" for _ in df.columns)]
    return "\n".join(f"| {x} |" for x in [*lines, *(" | ".join("" if v is None else str(v) for v in r) for r in rows)]) + "\n"
