"""Sources, sinks, streams and the driver's contract."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.sources import readers, writers
from factlake.streaming import state


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"entity": "e", "intent": "boolean"}, {"entity": "f"}]')
    assert readers.json_array(spark, str(tmp_path / "a.json"), readers.BENCHMARK).count() == 2
    (tmp_path / "l.jsonl").write_text('{"call_id": "1", "status": "ok"}\n\n{"call_id": "2"}\n')
    ledger = readers.json_lines(spark, str(tmp_path / "l.jsonl"), readers.LEDGER)
    assert ledger.where("call_id is not null").count() == 2
    out = str(tmp_path / "out")
    writers.append_json(ledger, out)
    writers.append_json(ledger, out)
    assert readers.json_lines(spark, out, readers.LEDGER).where("call_id is not null").count() == 4
    writers.replace_json(ledger, out)
    assert readers.json_lines(spark, out, readers.LEDGER).where("call_id is not null").count() == 2
    writers.csv(spark.range(3), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id"]
    assert writers.markdown(spark.range(2)).count("\n") == 4


def test_contexts(spark, tmp_path):
    rows = [("c", ["q"], [["a"]], ("s1",)), ("d", [], [], ("s2",))]
    spark.createDataFrame(rows, readers.CONTEXT).write.parquet(str(tmp_path / "struct"))
    assert readers.contexts(spark, str(tmp_path / "struct"), "s1").count() == 1
    spark.createDataFrame([("c", '{"source": "s1"}')], "context string, metadata string").write.parquet(str(tmp_path / "text"))
    assert readers.contexts(spark, str(tmp_path / "text"), "s1").count() == 1


def test_files(spark, tmp_path):
    import hashlib

    (tmp_path / "x.txt").write_text("a=1\nb\na=22")
    (h,) = readers.file_hashes(spark, str(tmp_path / "x.txt")).collect()
    assert h.sha256 == hashlib.sha256(b"a=1\nb\na=22").hexdigest()
    assert [r.a for r in readers.log_fields(spark, str(tmp_path / "x.txt"), {"a": r"a=(\d+)"}).collect()] == ["1", "22"]
    assert readers.whole_texts(spark, str(tmp_path / "x.txt")).first().value == "a=1\nb\na=22"


def test_arrow_streams(spark, tmp_path):
    t = pa.table({"x": [1, 2, 3], "y": ["a", "b", None]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t, max_chunksize=2)
    schema = T.StructType([T.StructField("y", T.StringType()), T.StructField("x", T.LongType())])
    assert sorted(r.x for r in readers.arrow_streams(spark, str(tmp_path / "t.arrow"), schema).collect()) == [1, 2, 3]


def test_embedding_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    writers.put_embeddings(spark.createDataFrame([(1, [1.0, 2.0])], "serial long, vec array<double>"), path, "k")
    assert readers.embedding_cache(spark, path, "k").collect()[0].vec == [1.0, 2.0]
    assert readers.embedding_cache(spark, path, "other").count() == 0


def test_streams(spark, tmp_path):
    facts = str(tmp_path / "facts")
    schema = "entity long, serial long, value string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 5, "z")], schema).coalesce(1).write.parquet(facts)
    q = state.changes(spark.readStream.schema(schema).parquet(facts)).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([(1, 2, "c"), (1, 4, "b"), (1, 6, "c")], schema).coalesce(1).write.mode("append").parquet(facts)
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.entity, r.serial, r.value, r.late) for r in spark.table("changes").collect())
    assert got == [(1, 1, "a", False), (1, 2, "c", True), (1, 3, "b", False), (1, 6, "c", False), (2, 5, "z", False)]


def test_ledger_stream(spark, tmp_path):
    path = str(tmp_path / "calls")
    calls = spark.createDataFrame([("1", 0), ("1", 1), ("2", 2)], "call_id string, s long").select("call_id", F.timestamp_seconds("s").alias("ts"))
    calls.coalesce(1).write.parquet(path)
    q = state.ledger(spark.readStream.schema(calls.schema).parquet(path)).writeStream.format("memory").queryName("ledger").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.call_id for r in spark.table("ledger").collect()) == ["1", "2"]


def test_contract(spark):
    import os

    import __spark_entry__ as entry

    names, oracles = set(entry.queries()), set(entry.oracle_sql())
    assert oracles <= names and "nth_prior_state" in names
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
