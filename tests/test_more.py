"""Manifests, traces, the budget stream, Arrow ranges, constants and typed plans."""

import datetime as dt
import hashlib
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.operators import generate, manifest, routing, trace, validation
from factlake.sources import arrow_source, readers, writers
from factlake.streaming import budget

NESTED = "b struct<z:int,a:array<string>>, a string, m map<string,long>, t boolean, n long"
ROWS = [({"z": 1, "a": ["é", 'q"\\', None]}, "漢 /x", {"k": 2, "b": None}, True, None), (None, None, None, None, 5), ({"z": None, "a": None}, "", {}, False, -1)]


def as_json(row):
    return json.dumps(row.asDict(recursive=True), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_canonical_json_of_any_schema(spark):
    df = spark.createDataFrame([tuple(r) for r in ROWS], NESTED)
    got = sorted(r.j for r in df.select(manifest.canonical(df).alias("j")).collect())
    assert got == sorted(map(as_json, df.collect()))
    assert {r.hash for r in manifest.row_hashes(df).collect()} == {hashlib.sha256(as_json(r).encode()).hexdigest() for r in df.collect()}


def test_fingerprints_don_t_depend_on_order(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7 % 13).cast("string").alias("s"))
    one = manifest.fingerprint(df, "t").first()
    assert one == manifest.fingerprint(df.repartition(7, "s").orderBy(F.desc("id")), "t").first()
    assert one.fingerprint != manifest.fingerprint(df.union(df.limit(1)), "t").first().fingerprint
    assert manifest.fingerprint(df.limit(0), "t").first().n_rows == 0
    frozen = manifest.recompute({"a": df, "b": df, "c": df, "d": df})
    now = manifest.recompute({"a": df, "b": df.where("id > 0"), "c": df.withColumn("s", F.lit("x")), "e": df})
    assert {r.name: r.status for r in manifest.verify(frozen, now).collect()} == {"b": "rows", "c": "content", "d": "missing", "e": "extra"}
    old = df.where("id <> 3").withColumn("s", F.when(F.col("id") == 5, "?").otherwise(F.col("s")))
    found = manifest.differences(manifest.row_hashes(old, "id"), manifest.row_hashes(df.where("id <> 9"), "id"), "id")
    assert {r.id: r.status for r in found.collect()} == {3: "extra", 5: "changed", 9: "missing"}


def test_traces_count_every_step(spark, tmp_path):
    run = trace.Trace(spark, "r1")
    some = run.step(spark.range(100), "in", even=F.col("id") % 2 == 0)
    out = run.step(some.where("id > 9").groupBy((F.col("id") % 3).alias("k")).count(), "out", none=F.lit(None).cast("boolean"))
    out.write.format("noop").mode("overwrite").save()
    run.write(str(tmp_path / "trace"))
    got = {(r.step, r.metric): r.value for r in spark.read.parquet(str(tmp_path / "trace")).where("run = 'r1'").collect()}
    assert got == {("in", "rows"): 100, ("in", "even"): 50, ("out", "rows"): 3, ("out", "none"): 0}
    with pytest.raises(ValueError):
        run.step(spark.range(1), "in")


CALLS = "call_id string, arm string, ts timestamp, micros long"


def call(i, arm, hour, micros, day=1):
    return (i, arm, dt.datetime(2026, 1, day, hour), micros)


def test_budget_stops_and_starts_again(spark, tmp_path):
    """Two runs of one stream: the sum goes on from the checkpoint; days close and their state goes."""
    calls, out, cp = (str(tmp_path / x) for x in ("calls", "out", "cp"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def put(*rows):
        spark.createDataFrame(list(rows), CALLS).coalesce(1).write.mode("append").parquet(calls)
        q = budget.budget(spark.readStream.schema(CALLS).parquet(calls), 100).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(90)

    put(call("a2", "a", 2, 50), call("a1", "a", 1, 40), call("b1", "b", 1, 10))
    put(call("a3", "a", 3, 20), call("a4", "a", 4, 5), call("b2", "b", 2, None), call("b3", "b", 3, 1))
    put(call("a5", "a", 5, 1), call("a6", "a", 1, 7, day=3))
    put(call("a7", "a", 2, 1, day=3))
    got = sorted((r.arm, r.day.day, r.call_id or "", r.decision, r.spent) for r in spark.read.parquet(out).collect())
    assert got == sorted([
        ("a", 1, "a1", "admitted", 40), ("a", 1, "a2", "admitted", 90), ("a", 1, "a3", "admitted", 110), ("a", 1, "a4", "stopped", 110), ("a", 1, "a5", "stopped", 110),
        ("b", 1, "b1", "admitted", 10), ("b", 1, "b2", "usage unknown", 10), ("b", 1, "b3", "halted", 10),
        ("a", 3, "a6", "admitted", 7), ("a", 3, "a7", "admitted", 8), ("a", 1, "", "closed", 110), ("b", 1, "", "closed after a halt", 10),
    ])


def test_arrow_ranges_and_columns(spark, tmp_path):
    t = pa.table({"x": list(range(1000)), "y": [f"v{i}" for i in range(1000)], "z": [[i, None] for i in range(1000)]})
    for name in ("one", "two"):
        with pa.OSFile(str(tmp_path / f"{name}.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
            w.write_table(t, max_chunksize=50)
    d = pa.table({"x": [7, 8], "y": pa.array(["p", "q"]).dictionary_encode(), "z": [[1], []]})
    with pa.OSFile(str(tmp_path / "words.dict"), "wb") as f, pa.ipc.new_stream(f, d.schema) as w:
        w.write_table(d, max_chunksize=1)
    kinds = [k for k, *_ in arrow_source.messages(str(tmp_path / "one.arrow"))]
    assert len(kinds) == 21 and kinds[0] == arrow_source.SCHEMA
    df = readers.arrow_streams(spark, str(tmp_path / "*.arrow"), range_bytes=2000)
    assert df.schema.names == ["x", "y", "z"] and df.rdd.getNumPartitions() > 8
    assert df.agg(F.sum("x"), F.countDistinct("y"), F.sum(F.get("z", F.lit(0)))).first() == (999_000, 1000, 999_000)
    part = readers.arrow_streams(spark, str(tmp_path / "*.arrow"), T.StructType([T.StructField("y", T.StringType())]), 2000)
    assert part.columns == ["y"] and part.count() == 2000
    reader = arrow_source.Reader(T.StructType([T.StructField("y", T.StringType())]), {"path": str(tmp_path / "words.dict"), "rangebytes": "1"})
    (whole,) = reader.partitions()
    assert [x for b in reader.read(whole) for x in b.column(0).cast(pa.string()).to_pylist()] == ["p", "q"]


def test_constants_of_python_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("FALSE_VALUES = ['x', 'y', 3]\nother = ['no']\ndef f():\n    false_pool = {'k': ['z'], 'n': 'w'}\n    False_Values = g()\n")
    (tmp_path / "b.py").write_text("this is no python")
    got = sorted((r.path.rsplit("/", 1)[1], r.name, r.value) for r in readers.constants(spark, str(tmp_path / "*.py"), ("false_values", "false_pool")).collect())
    assert got == [("a.py", "FALSE_VALUES", "x"), ("a.py", "FALSE_VALUES", "y"), ("a.py", "false_pool", "z")]


def test_pretty_json(spark, tmp_path):
    path = str(tmp_path / "r.json")
    for n in (1, 2):
        writers.pretty_json(spark.range(n).select("id", F.lit("é").alias("s")), path)
    assert (tmp_path / "r.json").read_text() == json.dumps([{"id": i, "s": "é"} for i in range(2)], ensure_ascii=False, indent=2) + "\n"


def test_plans_keep_the_types_of_their_json(spark):
    plan = dict(intent="historical", entity="e", property_scope="entity_wide_values", property_name=None, temporal_scope="latest", ordinal_offset=None, aggregation_mode="none", boolean_target=None, negated=False, supported=True, reason="")
    changes = [({}, None), ({"entity": 5}, "entity"), ({"entity": None}, None), ({"boolean_target": {"a": 1}}, "boolean_target"), ({"property_name": ["x"]}, "property_name"), ({"ordinal_offset": "2"}, "ordinal_offset"), ({"ordinal_offset": 2}, None), ({"ordinal_offset": 2.0}, "ordinal_offset"), ({"ordinal_offset": True}, "ordinal_offset"), ({"ordinal_offset": -1}, "ordinal_offset"), ({"negated": "false"}, "booleans"), ({"reason": None}, "reason"), ({"reason": 3}, "reason")]
    df = spark.createDataFrame([(i, json.dumps(plan | c)) for i, (c, _) in enumerate(changes)] + [(99, "no json"), (98, "[]")], "qid long, plan string")
    got = {r.qid: r.error for r in validation.validate_plans(df).collect()}
    assert got == {i: e for i, (_, e) in enumerate(changes)} | {99: "keys", 98: "keys"}


def test_targets_come_back_from_their_wording(spark):
    wordings = ("Is {target} a {prop} of {entity}?", "Is {target} of {entity}?", "{entity}: {target}")
    rows = [(0, "Is a (b)? a genre of E.?", "E.", "genre"), (1, "Is x of E?", "E", "genre"), (2, "Is  of E?", "F", "genre"), (3, "E: Is x a genre of E?", "E", "genre"), (4, "E: ", "E", "genre")]
    got = {r.qid: r.target for r in generate.recover_targets(spark.createDataFrame(rows, "qid long, question string, entity string, qp string"), wordings).collect()}
    assert got == {0: "a (b)?", 1: "x", 2: None, 3: "Is x a genre of E?", 4: None}


def test_router_with_examples(spark):
    q = spark.createDataFrame([(0, "zzz", {"freshness": 0.1, "boolean": 0.9}), (1, "zzz", None)], "qid long, question string, near map<string,double>")
    plain = {r.qid: (r.route, r.score) for r in routing.heuristic(q.drop("near")).collect()}
    got = {r.qid: (r.route, r.score) for r in routing.heuristic(q).collect()}
    assert got[1] == plain[1] and got[0][0] == "boolean"
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 2.0])], "vec_id long, vec array<double>")
    p = spark.createDataFrame([("a", 0, [2.0, 0.0]), ("b", 1, [0.0, 1.0]), ("a", 0, [0.0, -1.0])], "route string, route_order int, vec array<double>")
    assert {r.vec_id: (r.route, r.score) for r in routing.native(v, p).collect()} == {1: ("a", 1.0), 2: ("a", 0.0), 3: ("b", 0.894427)}
    assert {r.vec_id: r.near for r in routing.nearest_by_route(v, p, "vec_id").collect()}[3] == {"a": -0.447214, "b": 0.894427}


def test_prompt_tokens_one_by_one(spark):
    public = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=table, special_tokens={})
    rows = [(1, 0, "user", "Hello there, é漢 <|endoftext|>"), (1, 1, "assistant", None), (2, 0, None, ""), (None, 0, "user", "x" * 3000)]
    from factlake.operators import estimate

    got = {r.conv_id: (r.n_messages, r.n_tokens) for r in estimate.prompt_tokens(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect()}
    want = {}
    for c, _, role, text in rows:
        n, t = want.get(c, (0, 3))
        want[c] = (n + 1, t + 4 + len(enc.encode_ordinary(role or "")) + len(enc.encode_ordinary(text or "")))
    assert got == want
