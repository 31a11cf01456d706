"""Shared helpers: checkpoints in the cluster's shared folder, Arrow mapping, batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once inside an Arrow batch; bounds the numpy temporaries.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch that goes to a Python worker, about; one row at least.
BATCH_BYTES = 4 << 20
#: Rows of one join key beyond which it is dealt out, at least; else a thousandth of all rows.
HOT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> None:
    """Sees to it that ``checkpoint()`` has a folder, and that Arrow batches are bounded by bytes.

    A cluster names the folder in ``spark.checkpoint.dir``; only where that is unset, as
    in tests on one machine, one below the warehouse is taken, which executors share too.
    """
    bounded(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")


def bounded(spark: SparkSession) -> None:
    """Limits Arrow batches of this session by bytes too, unless it is set already: rows alone say nothing of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).startswith(str(64 << 20)):  # the default
        spark.conf.set(key, str(BATCH_BYTES))


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and cuts its lineage there."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet below the shared checkpoint folder and reads it again."""
    spark = df.sparkSession
    shared(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, spread: tuple[str, ...]) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key and the key's number of rows in ``weight``.

    Keys with over ``HOT_ROWS`` rows, and over a thousandth of ``total``, are dealt out by a
    hash of the columns ``spread``, so that no key gathers in one task: at most a thousand
    keys, whose broadcast is bounded by that.
    """
    most = max(HOT_ROWS, total // 1000)
    parts = F.ceil(F.col(weight) / most).cast("int")
    hot = right.where(F.col(weight) > most).select(*keys, parts.alias("__parts"))
    salt = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("__parts").cast("long")).cast("int")).otherwise(F.lit(0))
    own = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__parts")
    every = F.when(F.col(weight) > most, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    return own.join(right.withColumn("__salt", F.explode(every)), [*keys, "__salt"]).drop("__salt")


def slices(sizes, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about ``limit`` bytes, one row at least each."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def map_texts(df: DataFrame, column: str, schema: T.StructType, make: Callable[[], Callable[[list[str | None]], dict]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns computed from the texts in ``column`` by Arrow batches.

    ``make`` is called once in each task and returns a function from a list of texts
    (None for null) to a dict of lists or Arrow arrays, one per field of ``schema``.
    Columns in ``keep`` pass through unchanged; texts are handed over in slices of
    about ``SLICE_BYTES`` bytes, whole rows always.
    """
    bounded(df.sparkSession)
    kept = df.select(*[df[c] for c in keep], df[column].alias("__text"))
    fields = [kept.schema[c] for c in keep] + list(schema.fields)
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    types = {f.name: arrow_type(f.dataType) for f in schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            sizes = [0 if n is None else n for n in pa.compute.binary_length(text).to_pylist()]
            for a, b in slices(sizes):
                part = batch.slice(a, b - a)
                got = each(text.slice(a, b - a).to_pylist())
                columns = [part.column(i) for i in range(len(keep))]
                for name, kind in types.items():
                    x = got[name]
                    columns.append(x if isinstance(x, pa.Array) else pa.array(x, type=kind))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    import pyarrow.compute  # noqa: F401  (pa.compute is used in the tasks)

    return kept.mapInArrow(run, out)


def crc_of_id(column) -> F.Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def hashed_sample(df: DataFrame, key: str, bound: int, seed: int = 42) -> DataFrame:
    """At most ``bound`` rows, those of least hash of ``key`` as near as ties allow.

    A threshold on the hash comes first, from the number of rows, so that what the
    ordered limit gathers doesn't grow with the number of partitions.
    """
    n = df.count()
    place = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
    share = min(1.0, 1.2 * bound / max(n, 1) + 1e-9)
    return df.where(place <= int(share * (1 << 40))).orderBy(place, key).limit(bound)
