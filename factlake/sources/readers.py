"""Sources as DataFrames with explicit schemas; nothing is inferred or collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.sources import arrow_source

CONTEXT = T.StructType(
    [
        T.StructField("context", T.StringType()),
        T.StructField("questions", T.ArrayType(T.StringType())),
        T.StructField("answers", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("metadata", T.StructType([T.StructField("source", T.StringType())])),
    ]
)
BENCHMARK = T.StructType([T.StructField(c, T.StringType()) for c in ("entity", "intent", "question_text", "ground_truth_answer")])
LEDGER = T.StructType(
    [
        T.StructField("call_id", T.StringType()),
        T.StructField("arm", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("usage_prompt_tokens", T.LongType()),
        T.StructField("usage_completion_tokens", T.LongType()),
        T.StructField("actual_cost_usd", T.DoubleType()),
    ]
)


def contexts(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Context rows from Parquet; ``metadata`` may be a struct or JSON text.

    The filter on the nested source reaches the scan where metadata is a struct.
    """
    df = spark.read.parquet(path)
    if isinstance(df.schema["metadata"].dataType, T.StringType):
        df = df.withColumn("metadata", F.struct(F.get_json_object("metadata", "$.source").alias("source")))
    return df if source is None else df.where(F.col("metadata.source") == source)


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def log_fields(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """Named groups of log lines; lines that match nothing are left out."""
    lines = spark.read.text(path)
    found = lines.select(*[F.nullif(F.regexp_extract("value", p, 1), F.lit("")).alias(n) for n, p in patterns.items()])
    return found.where(F.coalesce(*[F.col(n) for n in patterns]).isNotNull())


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def arrow_streams(spark: SparkSession, path: str, schema: T.StructType | None = None, range_bytes: int = arrow_source.RANGE_BYTES) -> DataFrame:
    """Rows of Arrow IPC stream files, in tasks of about ``range_bytes``; columns that ``schema`` leaves out aren't read."""
    arrow_source.register(spark)
    reader = spark.read.format("arrow_stream").option("rangeBytes", str(range_bytes))
    return (reader.schema(schema) if schema else reader).load(path)


def constants(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """(path, name, value): the texts of literal lists that Python files assign to any of ``names``.

    Files are parsed, never run. A dictionary gives the lists that it holds; what is not a literal, and files that
    aren't Python, give nothing. Names are compared without case.
    """
    import ast

    wanted = {n.casefold() for n in names}

    def texts(source):
        try:
            tree = ast.parse(source or "")
        except (SyntaxError, ValueError):
            return []
        out = []
        for node in ast.walk(tree):
            own = [t.id for t in getattr(node, "targets", ()) if isinstance(t, ast.Name) and t.id.casefold() in wanted] if isinstance(node, ast.Assign) else []
            if not own:
                continue
            try:
                value = ast.literal_eval(node.value)
            except (ValueError, TypeError):
                continue
            lists = value.values() if isinstance(value, dict) else [value]
            out += [(own[0], x) for items in lists if isinstance(items, (list, tuple, set)) for x in items if isinstance(x, str)]
        return out

    found = F.udf(texts, "array<struct<name:string,value:string>>")(F.col("value"))  # a call a file
    return whole_texts(spark, path).select("path", F.explode(found).alias("c")).select("path", "c.name", "c.value")


def embedding_cache(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Cached vectors of one content key: (serial, vec)."""
    return spark.read.schema("key string, serial long, vec array<float>").parquet(path).where(F.col("key") == key).select("serial", "vec")
