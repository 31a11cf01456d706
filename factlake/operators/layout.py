"""Where rows lie before costly expressions, and tables that are read more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes a core beyond which an input has splits enough of its own.
SPLIT_BYTES = 16 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals a small input over all cores; one of more than ``SPLIT_BYTES`` a core stays as it is.

    With ``keys`` both are dealt by them, so that what follows by those keys needs no other exchange.

    Splits are sized by bytes, and regular expressions over a few megabytes in one row
    group would all run in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(size) < cores * SPLIT_BYTES:
        return df.repartition(cores, *keys)
    return df.repartition(*keys) if keys else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: ``spark.checkpoint.dir``.

    Only a session on one machine may leave it unset; one below the warehouse is taken there.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it from there: it is read more than once."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
