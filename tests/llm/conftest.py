import random

import pytest
from pyspark.sql import types as T

EXTRA = ["score", "fp", "d", "k", "piece", "length", "predicted", "n_bytes", "component_id", "__t", "__o", "__d", "__k", "__spans", "__rest", "__text", "__row", "__x", "__lang", "root", "c", "kept.x"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in EXTRA]
)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empties, white space, repeats, a very long text, shared passages, odd characters."""
    rng = random.Random(11)
    shared, base = prose(rng, 90), prose(rng, 120)
    texts = [
        None, "", "   \n\t ", "?!", "one", "two words", "é漢😀 \0 ▁▁ x  y ",
        shared, shared, f"{prose(rng, 30)} {shared} {prose(rng, 30)}", f"{prose(rng, 5)} {shared[:250]} {prose(rng, 40)}",
        base, base + " tail", base.replace(" ", "  ", 1), base.upper(), prose(rng, 20000, 5000), "a" * 5000, "ab" * 150,
    ]
    rows = [(i, t, ("en", "fr", None)[i % 3], "s", 1, *["x"] * len(EXTRA)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[0], (None, shared, None, None, None, *[None] * len(EXTRA)), (None, None, None, None, None, *[None] * len(EXTRA))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
