"""Queries of checked joins, set comparisons, extremes, samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators import checks, estimate, manifest, symbolic, trace
from factlake.operators.layout import settled
from factlake.plans import answering
from factlake.plans.registry import ORACLES, query
from factlake.plans.scoring import failure_category as categories
from factlake.plans.views import View


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey")
def join_checked(v: View) -> DataFrame:
    """Orders with their customers; an order of an unknown customer would be an error."""
    c = v.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return checks.checked_join(v.table("orders").select("o_orderkey", "o_custkey", "o_totalprice"), c, ["o_custkey"]).drop("o_custkey")


@query("SELECT row_id, s.qid, s.arm, base, cost FROM scored s JOIN (SELECT qid, arm, min(row_id) AS base FROM scored GROUP BY qid, arm) b ON b.qid = s.qid AND b.arm = s.arm", "scored")
def join_arm_baseline(v: View) -> DataFrame:
    """Scored rows with the baseline row of their question and arm."""
    base = v.scored.groupBy("qid", "arm").agg(F.min("row_id").alias("base"))
    return checks.checked_join(v.scored.select("row_id", "qid", "arm", "cost"), base, ["qid", "arm"])


@query("SELECT user_id, min(value) AS least, max(value) AS largest, min(event_id) FILTER (value = m) AS first_largest FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def latency_extremes(v: View) -> DataFrame:
    e = checks.extremes(F.col("value"), F.col("event_id"))
    return v.table("events").groupBy("user_id").agg(*[c.alias(n) for n, c in e.items()])


@query("SELECT o_custkey, bool_and(a = b) AS same FROM (SELECT o_custkey, o_orderpriority, bool_or(o_orderstatus = 'F') AS a, bool_or(o_orderstatus = 'O') AS b FROM orders GROUP BY ALL) GROUP BY o_custkey")
def set_equality(v: View) -> DataFrame:
    """Whether a customer's finished and open orders have the same priorities."""
    status = F.col("o_orderstatus")
    return checks.equal_sets(v.table("orders"), "o_custkey", "o_orderpriority", status == "F", status == "O")


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 100 = 0 AND i < 300")
def stride_sample(v: View) -> DataFrame:
    """Three rows, a hundred apart."""
    return checks.stride(v.table("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 100, 3)


@query(f"SELECT qid, category, count(*) OVER (PARTITION BY category) AS n FROM ({ORACLES['failure_category']}) WHERE category <> 'correct'")
def failing_ids(v: View) -> DataFrame:
    """Every failing question beside the size of its category."""
    return checks.failing(failure_rows(v), "category", ("correct",)).select("qid", "category", "n")


def failure_rows(v: View) -> DataFrame:
    return categories(v).select("qid", "category")


SPLITS = (("dev", 20), ("held_out", 80), ("ood", 20))


@query(
    "SELECT entity, stratum, CASE WHEN p <= 20 THEN 'dev' WHEN p <= 100 THEN 'held_out' ELSE 'ood' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256(entity), entity) AS p FROM (SELECT entity, CASE WHEN count(*) >= 20 THEN 'long' ELSE 'short' END AS stratum FROM parsed GROUP BY entity)) WHERE p <= 120",
    "parsed",
)
def entity_split(v: View) -> DataFrame:
    """Entities of long and of short histories, dealt to three disjoint sets."""
    e = v.parsed.groupBy("entity").agg(F.when(F.count("*") >= 20, "long").otherwise("short").alias("stratum"))
    return checks.stratified_split(e, "entity", "stratum", SPLITS)


@query("SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersection(v: View) -> DataFrame:
    """Customers of either set of orders that are in both."""
    o = v.table("orders")
    return o.where("o_orderpriority = '1-URGENT'").select("o_custkey").intersect(o.where("o_orderstatus = 'P'").select("o_custkey"))


#: Columns of the tables under a manifest, and how each is written in canonical JSON.
FROZEN = {"region": ("r_name", "r_regionkey"), "nation": ("n_name", "n_nationkey", "n_regionkey"), "part": ("p_brand", "p_name", "p_partkey", "p_size"), "orders": ("o_custkey", "o_orderkey", "o_orderstatus")}
KEYED = ("key", "size")


def json_sql(columns: tuple[str, ...]) -> str:
    whole = [c for c in columns if c.endswith(KEYED)]
    return "'{' || " + " || ',' || ".join(f"""'"{c}":' || """ + (f"{c}::VARCHAR" if c in whole else f"'\"' || {c} || '\"'") for c in columns) + " || '}'"


def fingerprint_sql(table: str, source: str) -> str:
    sums = ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 16 * i}, 16))::UBIGINT), 0)::VARCHAR AS s{i}" for i in range(4))
    return f"SELECT '{table}' AS name, n AS n_rows, sha256(n::VARCHAR || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) AS fingerprint FROM (SELECT count(*) AS n, {sums} FROM (SELECT sha256({json_sql(FROZEN[table])}) AS h FROM {source}))"


def frozen_tables(v: View) -> dict[str, DataFrame]:
    return {t: v.table(t).select(*columns) for t, columns in FROZEN.items()}


def edited(part: DataFrame) -> DataFrame:
    """Parts as they may have been frozen: some were renamed since, some are new."""
    k = F.col("p_partkey")
    return part.where(k % 41 != 0).withColumn("p_name", F.when(k % 53 == 0, F.concat("p_name", F.lit(" (é\"\\ old)"))).otherwise(F.col("p_name")))


EDITED = "(SELECT * REPLACE (CASE WHEN p_partkey % 53 = 0 THEN p_name || ' (é\"\\ old)' ELSE p_name END AS p_name) FROM part WHERE p_partkey % 41 <> 0)"


@query(" UNION ALL ".join(fingerprint_sql(t, t) for t in FROZEN))
def manifest_recompute(v: View) -> DataFrame:
    return manifest.recompute(frozen_tables(v))


@query(f"SELECT 'part' AS name, CASE WHEN (SELECT count(*) FROM {EDITED}) <> (SELECT count(*) FROM part) THEN 'rows' ELSE 'content' END AS status WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey % 41 = 0 OR p_partkey % 53 = 0)")
def manifest_verify(v: View) -> DataFrame:
    """Tables that aren't as frozen: the parts alone were edited."""
    now = frozen_tables(v)
    return manifest.verify(manifest.recompute(now | {"part": edited(now["part"])}), manifest.recompute(now))


@query("SELECT p_partkey, CASE WHEN p_partkey % 41 = 0 THEN 'extra' ELSE 'changed' END AS status FROM part WHERE p_partkey % 41 = 0 OR p_partkey % 53 = 0")
def manifest_differences(v: View) -> DataFrame:
    """Every part that isn't as frozen."""
    now = frozen_tables(v)["part"]
    return manifest.differences(manifest.row_hashes(edited(now), "p_partkey"), manifest.row_hashes(now, "p_partkey"), "p_partkey")


@query(
    f"""WITH e AS ({ORACLES['plan_execute']}) SELECT step, metric, value FROM (
      SELECT 'plans' AS step, 'rows' AS metric, (SELECT count(*) FROM part) AS value UNION ALL SELECT 'plans', 'supported', (SELECT count(*) FROM part WHERE p_partkey % 17 <> 0)
      UNION ALL SELECT 'answers', 'rows', (SELECT count(*) FROM e) UNION ALL SELECT 'answers', 'answered', (SELECT count(*) FROM e WHERE status = 'answered')
      UNION ALL SELECT 'answers', 'abstained', (SELECT count(*) FROM e WHERE status <> 'answered') UNION ALL SELECT 'answers', 'complete', (SELECT count(*) FROM e WHERE complete))"""
)
def trace_plan_execute(v: View) -> DataFrame:
    """What the planner took in, answered and abstained from, observed while the answers were written."""
    run = trace.Trace(v.spark, "plan_execute")
    seen = settled(run.step(v.plans, "plans", supported=F.col("supported")))
    p = seen.join(symbolic.history_complete(seen, v.retrieved, *answering.counts(v)), "qid")
    r = symbolic.execute(p, symbolic.deterministic_candidates(p, v.retrieved)).join(p.select("qid", "complete"), "qid")
    status = F.col("status")
    run.step(r, "answers", answered=status == "answered", abstained=status != "answered", complete=F.col("complete")).write.format("noop").mode("overwrite").save()
    return run.rows().drop("run")


@query()
def prompt_tokens(v: View) -> DataFrame:
    """Estimated prompt tokens of every conversation; byte pairs have no SQL, the test counts them one by one."""
    import public_tokenizers

    return estimate.prompt_tokens(v.table("conversations"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
