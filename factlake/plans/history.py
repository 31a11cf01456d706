"""Freshness, timelines, counts, joins and set queries over the fact logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions import text as X
from factlake.operators import facts, history, ranks
from factlake.plans.registry import query
from factlake.plans.text import n
from factlake.plans.views import View

STATES = f"""(SELECT entity, value, serial, row_number() OVER (PARTITION BY entity ORDER BY serial DESC, ord) - 1 AS state FROM
  (SELECT *, lag(nv) OVER (PARTITION BY entity ORDER BY serial DESC, ord) AS last FROM (SELECT *, {n('value')} AS nv FROM fact_log) WHERE nv <> '') WHERE last IS NULL OR last <> nv)"""


@query("SELECT entity, arg_max(value, serial) AS value, max(serial) AS serial FROM fact_log GROUP BY entity", "fact_log")
def freshness_pick(v: View) -> DataFrame:
    return history.freshest(v.fact_log, "entity")


@query("SELECT entity, arg_min(value, serial) AS value, min(serial) AS serial FROM fact_log GROUP BY entity", "fact_log")
def earliest_pick(v: View) -> DataFrame:
    return history.earliest(v.fact_log, "entity")


@query(f"SELECT entity, count(DISTINCT {n('value')}) AS n_distinct FROM fact_log WHERE {n('value')} <> '' GROUP BY entity", "fact_log")
def distinct_count(v: View) -> DataFrame:
    return history.distinct_count(v.fact_log, "entity")


@query(f"SELECT entity, string_agg(value, '|' ORDER BY serial) AS values, count(*) AS n_distinct FROM (SELECT entity, {n('value')} AS nv, arg_min(value, serial) AS value, min(serial) AS serial FROM fact_log GROUP BY ALL) WHERE nv <> '' GROUP BY entity", "fact_log")
def distinct_list(v: View) -> DataFrame:
    return history.distinct_list(v.fact_log, "entity")


@query("SELECT entity, count(*) AS n FROM parsed GROUP BY entity", "parsed")
def entity_counts(v: View) -> DataFrame:
    return v.parsed.groupBy("entity").agg(F.count("*").alias("n"))


@query("SELECT entity, property, count(*) AS n FROM parsed GROUP BY ALL", "parsed")
def entity_property_counts(v: View) -> DataFrame:
    return v.parsed.groupBy("entity", "property").agg(F.count("*").alias("n"))


@query(
    "SELECT e.entity, n_raw, n_parsed FROM (SELECT entity, count(*) AS n_parsed FROM parsed GROUP BY entity) p JOIN (SELECT e.entity, count(*) AS n_raw FROM (SELECT DISTINCT entity FROM parsed) e JOIN fact_text f ON starts_with(f.text, e.entity || ' ') GROUP BY e.entity) e ON e.entity = p.entity WHERE n_raw = n_parsed",
    "parsed", "fact_text",
)
def entity_reliable(v: View) -> DataFrame:
    raw = facts.prefix_counts(v.fact_text, v.parsed.select("entity"))
    subject, _ = X.parse_fact(F.col("text"))
    parsed = v.fact_text.select(subject.alias("entity")).where("entity is not null").groupBy("entity").agg(F.count("*").alias("n_parsed"))
    return raw.join(parsed, "entity").where("n_raw = n_parsed")


@query("SELECT entity, string_agg(value, '|' ORDER BY serial) AS history, count(*) AS n_facts FROM parsed GROUP BY entity", "parsed")
def entity_histories(v: View) -> DataFrame:
    return history.histories(v.parsed, "entity")


@query("SELECT entity, count(*) AS n_facts, count(DISTINCT value) AS n_distinct FROM parsed GROUP BY entity HAVING count(*) >= 2 AND count(DISTINCT value) >= 2", "parsed")
def conflicting_entities(v: View) -> DataFrame:
    return history.conflicting(v.parsed, "entity")


@query(f"SELECT entity, state, value, serial FROM {STATES}", "fact_log")
def timeline_collapse(v: View) -> DataFrame:
    return history.timeline(v.fact_log, "entity")


@query(f"SELECT k.entity, s.value, s.serial, CASE WHEN s.value IS NULL THEN 'insufficient_history' ELSE 'answered' END AS status FROM (SELECT DISTINCT entity FROM fact_log) k LEFT JOIN (SELECT * FROM {STATES} WHERE state = 1) s ON s.entity = k.entity", "fact_log")
def nth_prior_state(v: View) -> DataFrame:
    return history.nth_prior(v.fact_log, 1, "entity")


@query(f"SELECT entity, arg_max(value, state) AS value, arg_max(serial, state) AS serial FROM {STATES} WHERE state <= 40 GROUP BY entity", "fact_log")
def nth_prior_state_clamped(v: View) -> DataFrame:
    return history.nth_prior(v.fact_log, 40, "entity", clamp=True)


@query(f"SELECT s.entity, min(state) + 1 AS rank FROM {STATES} s JOIN (SELECT entity, arg_min(value, serial) AS gold FROM fact_log GROUP BY entity) g ON g.entity = s.entity AND {n('g.gold')} = {n('s.value')} GROUP BY s.entity", "fact_log")
def gold_state_rank(v: View) -> DataFrame:
    gold = history.earliest(v.fact_log, "entity").select("entity", X.normal(F.col("value")).alias("g"))
    states = history.timeline(v.fact_log, "entity").join(gold, "entity")
    return states.where(X.normal(F.col("value")) == F.col("g")).groupBy("entity").agg((F.min("state") + 1).alias("rank"))


@query("SELECT event_id, value, spent FROM (SELECT event_id, value, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS spent, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM events) WHERE prior < 200")
def budget_cutoff(v: View) -> DataFrame:
    """Calls of each user until the sum before one reaches the limit."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = v.table("events").select("event_id", "value", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("spent"), F.coalesce(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("prior"))
    return e.where("prior < 200").drop("prior")


@query("SELECT event_type AS route, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, route")
def route_distribution(v: View) -> DataFrame:
    return v.table("events").groupBy(F.col("event_type").alias("route")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "route")


@query("SELECT count(*) AS documents, sum(length(t))::BIGINT AS tokens, (SELECT count(DISTINCT w) FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)) AS vocabulary, round(sum(length(t)) / greatest(count(*), 1), 6) AS mean_length FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def corpus_stats(v: View) -> DataFrame:
    return facts.corpus_stats(X.tokens(F.col("text")), v.table("documents"))


@query("SELECT entity, max(gap) AS gap FROM (SELECT entity, lead(serial) OVER (PARTITION BY entity ORDER BY serial) - serial AS gap FROM fact_log) GROUP BY entity", "fact_log")
def index_gap(v: View) -> DataFrame:
    w = Window.partitionBy("entity").orderBy("serial")
    return v.fact_log.select("entity", (F.lead("serial").over(w) - F.col("serial")).alias("gap")).groupBy("entity").agg(F.max("gap").alias("gap"))


@query("SELECT user_id, quantile_disc AS p95, median, mean_value, n FROM (SELECT user_id, list_sort(list(value))[least(count(*), CAST(floor(0.95 * count(*)) AS BIGINT) + 1)] AS quantile_disc, list_sort(list(value))[count(*) // 2 + 1] AS median, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY user_id)")
def latency_p95(v: View) -> DataFrame:
    """Nearest-rank 95th percentile and upper median of each user's values."""
    e = v.table("events").select("user_id", "value")
    plain = e.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n"))
    return ranks.nearest_ranks(e, ("user_id",), "value", {"p95": 0.95, "median": 0.5}).join(plain, "user_id")


@query("SELECT o_orderpriority AS arm, count(*) AS calls, round(sum(coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice::DECIMAL(18, 2) END, 0)), 2)::DOUBLE AS cost FROM orders GROUP BY 1")
def cost_rollup(v: View) -> DataFrame:
    cost = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)")), F.lit(0).cast("decimal(18,2)"))
    return v.table("orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count("*").alias("calls"), F.round(F.sum(cost), 2).cast("double").alias("cost"))


@query("SELECT o_custkey, count(DISTINCT sha256(o_orderpriority || '|' || o_orderstatus)) = 1 AS same FROM orders GROUP BY o_custkey")
def context_identity(v: View) -> DataFrame:
    h = F.sha2(F.concat_ws("|", "o_orderpriority", "o_orderstatus"), 256)
    return v.table("orders").groupBy("o_custkey").agg((F.count_distinct(h) == 1).alias("same"))


@query("SELECT arm, n, round(mean * n * 1.2, 4) AS projected FROM (SELECT o_orderpriority AS arm, count(*) AS n, avg(CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice END) AS mean FROM orders GROUP BY 1)")
def cost_projection(v: View) -> DataFrame:
    """A tenth of the calls calibrates each arm's mean; a fifth is held in reserve."""
    o = v.table("orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice"))).alias("mean"))
    return o.select("arm", "n", F.round(F.col("mean") * F.col("n") * 1.2, 4).alias("projected"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (ORDER BY rn, user_id, event_type) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events)) WHERE turn <= 500")
def stratified_first_n(v: View) -> DataFrame:
    """First event of each stratum, then second ones, until 500 rows are full."""
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    e = v.table("events").withColumn("rn", F.row_number().over(w)).orderBy("rn", "user_id", "event_type").limit(500)
    return e.select("user_id", "event_type", "event_id")


@query("SELECT entity, count(DISTINCT value) AS n_distinct, count(*) AS n_facts FROM parsed GROUP BY entity ORDER BY n_distinct DESC, n_facts DESC, min(serial) LIMIT 20", "parsed")
def top_conflicting(v: View) -> DataFrame:
    g = v.parsed.groupBy("entity").agg(F.count_distinct("value").alias("n_distinct"), F.count("*").alias("n_facts"), F.min("serial").alias("first"))
    return g.orderBy(F.desc("n_distinct"), F.desc("n_facts"), "first").limit(20).drop("first")


@query("SELECT o_orderkey FROM orders ORDER BY sha256('20261004|' || o_orderkey), o_orderkey LIMIT 100")
def hash_sample(v: View) -> DataFrame:
    """A seeded sample without replacement, the same wherever it is drawn."""
    return v.table("orders").orderBy(F.sha2(F.concat(F.lit("20261004|"), F.col("o_orderkey").cast("string")), 256), "o_orderkey").limit(100).select("o_orderkey")


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS n_union, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') + (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'P') AS n_sum")
def set_union_disjoint(v: View) -> DataFrame:
    """Two sets are disjoint if their union is as large as both together."""
    o = v.table("orders").select(F.col("o_custkey").alias("k"), "o_orderstatus").where(F.col("o_orderstatus").isin("F", "P")).distinct()
    return o.agg(F.count_distinct("k").alias("n_union"), F.count("*").alias("n_sum"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def missing_support(v: View) -> DataFrame:
    return v.table("customer").select("c_custkey").subtract(v.table("orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT 'events' AS batch, event_id AS id FROM events UNION ALL SELECT 'orders', o_orderkey FROM orders")
def union_all_batches(v: View) -> DataFrame:
    a = v.table("events").select(F.lit("events").alias("batch"), F.col("event_id").alias("id"))
    return a.unionByName(v.table("orders").select(F.lit("orders").alias("batch"), F.col("o_orderkey").alias("id")))


@query("SELECT o_orderkey, coalesce(l.s, 'not_run') AS status FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS s FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey")
def join_ledger_left(v: View) -> DataFrame:
    ledger = v.table("lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("s"))
    o = v.table("orders").select("o_orderkey")
    return o.join(ledger, o["o_orderkey"] == ledger["l_orderkey"], "left").select("o_orderkey", F.coalesce("s", F.lit("not_run")).alias("status"))


@query("SELECT c.k, c.c_name IS NOT DISTINCT FROM replace(s.name, 'Supplier', 'Customer') AS same FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS k, c_name FROM customer) c JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) AS k, s_name AS name FROM supplier) s ON c.k = s.k")
def join_positional_check(v: View) -> DataFrame:
    """Rows of two lists side by side, by their places under an explicit order."""
    c = ranks.numbered(v.table("customer").select("c_custkey", "c_name"), "c_custkey", name="k")
    s = ranks.numbered(v.table("supplier").select("s_suppkey", F.col("s_name").alias("name")), "s_suppkey", name="k")
    return c.join(s, "k").select((F.col("k") + 1).alias("k"), F.col("c_name").eqNullSafe(F.replace("name", F.lit("Supplier"), F.lit("Customer"))).alias("same"))


@query("SELECT f.serial, e.entity FROM fact_text f JOIN (SELECT DISTINCT entity FROM parsed) e ON starts_with(f.text, e.entity || ' ')", "fact_text", "parsed")
def join_prefix_entity(v: View) -> DataFrame:
    return facts.prefix_join(v.fact_text, v.parsed.select("entity")).select("serial", "entity")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P')")
def join_semi_provenance(v: View) -> DataFrame:
    o = v.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return v.table("lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_anti_unused(v: View) -> DataFrame:
    o = v.table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return v.table("customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT p_partkey, sha256('{\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\",\"size\":' || p_size || '}') AS hash FROM part")
def row_canonical_hash(v: View) -> DataFrame:
    """sha256 of a row as JSON with sorted keys and no spaces."""
    j = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    return v.table("part").select("p_partkey", F.sha2(j, 256).alias("hash"))
