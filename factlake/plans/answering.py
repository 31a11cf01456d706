"""Symbolic answers: router operators, planner operators, hops and hybrids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions import scoring as S
from factlake.functions import text as X
from factlake.operators import bm25_tiles, hops, routing, symbolic
from factlake.operators.bm25_index import kept as kept_index
from factlake.operators.bm25_scan import kept
from factlake.operators.layout import settled
from factlake.plans.registry import query
from factlake.plans.retrieval import ROUTE_SQL, scores_sql
from factlake.plans.text import CANON, COUNT, CUE, EVER, NEGATED, OFFSET, PLANNER, PROPERTY_PLANNER, RELATION, SCOPE, STRIPPED, mention_sql, n, pn, retrieved
from factlake.plans.views import View, with_views

NEWEST = "(SELECT qid, arg_max(answer_entity, serial) AS answer_entity, arg_max(fact_text, serial) AS fact_text FROM candidates GROUP BY qid)"
GATE = f"((({mention_sql('question', 'answer_entity')}) OR ({mention_sql('question', 'fact_text')})) <> {NEGATED.format('question')})"
NSTATES = f"""(SELECT qid, serial, answer_entity, row_number() OVER (PARTITION BY qid ORDER BY serial DESC) - 1 AS state FROM (SELECT *, lag(nv) OVER (PARTITION BY qid ORDER BY serial DESC) AS last FROM (SELECT *, {n('answer_entity')} AS nv FROM candidates) WHERE nv <> '') WHERE last IS NULL OR last <> nv)"""


HISTORICAL_SQL = f"""SELECT q.qid, coalesce(CASE WHEN k IS NULL THEN a.v ELSE b.v END, '(no answer)') AS answer, CASE WHEN k IS NULL THEN a.s ELSE b.s END AS serial FROM (SELECT qid, {OFFSET.format('question')} AS k FROM questions) q
    LEFT JOIN (SELECT qid, arg_min(answer_entity, serial) AS v, min(serial) AS s FROM candidates GROUP BY qid) a ON a.qid = q.qid
    LEFT JOIN (SELECT s.qid, arg_max(answer_entity, state) AS v, arg_max(serial, state) AS s FROM {NSTATES} s JOIN (SELECT qid, {OFFSET.format('question')} AS k FROM questions) q ON q.qid = s.qid AND state <= k GROUP BY s.qid) b ON b.qid = q.qid"""


@query(HISTORICAL_SQL, "questions", "candidates")
def historical_native(v: View) -> DataFrame:
    return symbolic.historical_native(v.questions, v.candidates)


@query(f"SELECT q.qid, coalesce({GATE}, FALSE) AS answer FROM questions q LEFT JOIN {NEWEST} c ON c.qid = q.qid", "questions", "candidates")
def boolean_gate_native(v: View) -> DataFrame:
    newest = v.candidates.groupBy("qid").agg(F.max(F.struct("serial", (-F.col("ord")).alias("o"), "answer_entity", "fact_text")).alias("c"))
    j = v.questions.join(newest, "qid", "left")
    return j.select("qid", F.coalesce(symbolic.gate(F.col("question"), F.col("c.answer_entity"), F.col("c.fact_text")), F.lit(False)).alias("answer"))


BOOLEAN_SQL = f"SELECT q.qid, coalesce(CASE WHEN {EVER.format('question')} THEN anyhit ELSE newest END, FALSE) AS answer FROM questions q LEFT JOIN (SELECT c.qid, bool_or({GATE}) AS anyhit, arg_max({GATE}, serial) AS newest FROM candidates c JOIN questions q ON q.qid = c.qid GROUP BY c.qid) g ON g.qid = q.qid"


@query(BOOLEAN_SQL, "questions", "candidates")
def boolean_ever_native(v: View) -> DataFrame:
    return symbolic.boolean_native(v.questions, v.candidates)


AGGREGATE_SQL = f"""SELECT q.qid, CASE WHEN regexp_matches({n('question')}, '{X.NATIVE_COUNT}') THEN coalesce(c, 0)::VARCHAR ELSE coalesce(v, '[]') END AS answer FROM questions q LEFT JOIN
    (SELECT qid, count(*) AS c, '[' || string_agg('"' || replace(replace(a, '\\', '\\\\'), '"', '\\"') || '"', ', ' ORDER BY s) || ']' AS v FROM (SELECT qid, arg_min(trim(answer_entity), serial) AS a, min(serial) AS s, {n('answer_entity')} AS nv FROM candidates GROUP BY qid, nv) WHERE nv <> '' GROUP BY qid) a ON a.qid = q.qid"""


@query(AGGREGATE_SQL, "questions", "candidates")
def aggregate_native(v: View) -> DataFrame:
    return symbolic.aggregate_native(v.questions, v.candidates)


def counts(v: View) -> tuple[DataFrame, DataFrame]:
    """Corpus facts by entity, and by entity and planner property."""
    p = v.parsed
    return p.groupBy("entity").agg(F.count("*").alias("n")), p.groupBy("entity", "property").agg(F.count("*").alias("n"))


OVERRIDE = f"""SELECT qid, question, entity, boolean_target, negated, supported, reason,
  CASE WHEN r THEN property_scope ELSE 'entity_wide_values' END AS property_scope, CASE WHEN r THEN property_name END AS property_name,
  CASE WHEN c THEN 'aggregation' WHEN t IS NOT NULL THEN 'historical' ELSE intent END AS intent, CASE WHEN c THEN 'unspecified' WHEN t IS NOT NULL THEN t ELSE temporal_scope END AS temporal_scope,
  CASE WHEN c THEN NULL WHEN t = 'earliest' THEN 0 WHEN t IS NOT NULL THEN NULL ELSE ordinal_offset END AS ordinal_offset, CASE WHEN c THEN 'count' WHEN t IS NOT NULL THEN 'none' ELSE aggregation_mode END AS aggregation_mode
  FROM (SELECT *, {RELATION.format('question')} AS r, {COUNT.format('question')} AS c, {CUE.format('question')} AS t FROM plans)"""
FINAL = f"""SELECT * REPLACE (CASE WHEN w THEN 'entity_wide_values' ELSE property_scope END AS property_scope, CASE WHEN w THEN NULL ELSE property_name END AS property_name, w OR supported AS supported)
  FROM (SELECT *, intent = 'boolean' AND coalesce(entity, '') <> '' AND coalesce(boolean_target, '') <> '' AS w FROM ({OVERRIDE}))"""


def det_sql(plans: str) -> str:
    return f"(SELECT DISTINCT qid, serial, fact_text, answer_entity FROM (SELECT p.qid, c.serial, c.fact_text, c.answer_entity, property_scope, property_name, {PROPERTY_PLANNER.format('c.fact_text')} AS fact_property FROM {plans} p JOIN candidates c ON p.qid = c.qid WHERE supported) WHERE {SCOPE})"


def complete_sql(plans: str) -> str:
    wide = f"(SELECT * REPLACE (CASE WHEN intent = 'boolean' THEN 'entity_wide_values' ELSE property_scope END AS property_scope) FROM {plans})"
    return f"""(SELECT p.qid, coalesce(coalesce(got, 0) = (CASE WHEN intent <> 'boolean' AND property_scope = 'specific' THEN m.n ELSE e.n END), FALSE) AS complete FROM {wide} p
      LEFT JOIN (SELECT qid, count(DISTINCT serial) AS got FROM {det_sql(wide)} GROUP BY qid) d ON d.qid = p.qid LEFT JOIN (SELECT entity, count(*) AS n FROM parsed GROUP BY entity) e ON e.entity = p.entity
      LEFT JOIN (SELECT entity, property, count(*) AS n FROM parsed GROUP BY ALL) m ON m.entity = p.entity AND m.property = coalesce({CANON.format('property_name')}, 'value'))"""


def execute_sql(plans: str) -> str:
    det = det_sql(plans)
    states = f"(SELECT qid, serial, answer_entity, row_number() OVER (PARTITION BY qid ORDER BY serial DESC) - 1 AS state FROM (SELECT *, lag(nv) OVER (PARTITION BY qid ORDER BY serial DESC) AS last FROM (SELECT *, {pn('answer_entity')} AS nv FROM {det}) WHERE nv <> '') WHERE last IS NULL OR last <> nv)"
    values = f"(SELECT qid, list(v ORDER BY s) AS vals, list(nv) AS norms FROM (SELECT qid, {pn('answer_entity')} AS nv, arg_min(answer_entity, serial) AS v, min(serial) AS s FROM {det} GROUP BY qid, nv) WHERE nv <> '' GROUP BY qid)"
    ends = f"(SELECT qid, count(*) AS nf, arg_max(answer_entity, serial) AS last, max(serial) AS last_s, arg_min(answer_entity, serial) AS old, min(serial) AS old_s FROM {det} GROUP BY qid)"
    match = f"coalesce(list_contains(norms, {pn('boolean_target')}), FALSE)"
    k = "(CASE WHEN temporal_scope = 'previous' THEN 1 ELSE ordinal_offset END)"
    return f"""(SELECT j.qid, j.intent, j.complete, status,
      CASE WHEN status <> 'answered' THEN NULL WHEN intent = 'current_value' THEN last WHEN intent = 'historical' THEN (CASE WHEN temporal_scope = 'latest' THEN last WHEN temporal_scope IN ('earliest', 'unspecified') THEN old ELSE sv END) END AS answer_text,
      CASE WHEN status = 'answered' AND intent = 'aggregation' AND aggregation_mode = 'count' THEN coalesce(length(vals), 0) END AS answer_int,
      CASE WHEN status = 'answered' AND intent = 'boolean' THEN (CASE WHEN hit THEN NOT negated ELSE negated END) END AS answer_bool,
      CASE WHEN status = 'answered' AND intent = 'aggregation' THEN array_to_string(coalesce(vals, []), '|') END AS answer_list,
      CASE WHEN status = 'answered' AND intent = 'historical' THEN (CASE WHEN temporal_scope = 'latest' THEN last_s WHEN temporal_scope IN ('earliest', 'unspecified') THEN old_s ELSE ss END) END AS serial
    FROM (SELECT *, CASE WHEN NOT supported OR property_scope = 'ambiguous' THEN 'unsupported' WHEN coalesce(nf, 0) = 0 AND NOT (intent = 'boolean' AND complete) THEN 'insufficient_evidence'
        WHEN intent IN ('current_value', 'aggregation') AND NOT complete THEN 'insufficient_evidence' WHEN intent = 'historical' AND NOT complete THEN 'insufficient_history'
        WHEN intent = 'historical' AND temporal_scope NOT IN ('latest', 'earliest', 'unspecified') AND (k IS NULL OR k < 1 OR ss IS NULL) THEN 'insufficient_history'
        WHEN intent = 'boolean' AND coalesce(boolean_target, '') = '' THEN 'unsupported' WHEN intent = 'boolean' AND NOT hit AND NOT complete THEN 'insufficient_evidence' ELSE 'answered' END AS status
      FROM (SELECT p.*, nf, last, last_s, old, old_s, vals, {match} AS hit, s.answer_entity AS sv, s.serial AS ss, {k} AS k FROM {plans} p LEFT JOIN {ends} e ON e.qid = p.qid LEFT JOIN {values} v ON v.qid = p.qid LEFT JOIN {states} s ON s.qid = p.qid AND s.state = {k}) x) j)"""


PLANNED = f"(SELECT p.*, complete FROM plans p JOIN {complete_sql('plans')} c ON c.qid = p.qid)"
EXECUTED = execute_sql(PLANNED)


def with_complete(v: View) -> DataFrame:
    e, m = counts(v)
    return v.plans.join(symbolic.history_complete(v.plans, retrieved(v), e, m), "qid")


def executed(v: View) -> DataFrame:
    p = with_complete(v)
    r = symbolic.execute(p, symbolic.deterministic_candidates(p, retrieved(v)))
    return r.join(p.select("qid", "intent", "complete"), "qid").withColumn("answer_list", F.array_join("answer_list", "|"))


@query(f"SELECT qid, complete FROM {complete_sql('plans')}", "plans", "candidates")
def history_complete(v: View) -> DataFrame:
    return with_complete(v).select("qid", "complete")


@query(f"SELECT qid, status, answer_text FROM {EXECUTED} WHERE intent = 'current_value'", "plans", "candidates")
def plan_current_value(v: View) -> DataFrame:
    return executed(v).where("intent = 'current_value'").select("qid", "status", "answer_text")


@query(f"SELECT qid, status, answer_text, serial FROM {EXECUTED} WHERE intent = 'historical'", "plans", "candidates")
def plan_historical(v: View) -> DataFrame:
    return executed(v).where("intent = 'historical'").select("qid", "status", "answer_text", "serial")


@query(f"SELECT qid, status, answer_int, answer_list FROM {EXECUTED} WHERE intent = 'aggregation'", "plans", "candidates")
def plan_aggregation(v: View) -> DataFrame:
    return executed(v).where("intent = 'aggregation'").select("qid", "status", "answer_int", "answer_list")


@query(f"SELECT qid, status, answer_bool FROM {EXECUTED} WHERE intent = 'boolean'", "plans", "candidates")
def plan_boolean(v: View) -> DataFrame:
    return executed(v).where("intent = 'boolean'").select("qid", "status", "answer_bool")


COLUMNS = "qid, intent, complete, status, answer_text, answer_int, answer_bool, answer_list, serial"


@query(f"SELECT {COLUMNS} FROM {EXECUTED}", "plans", "candidates")
def plan_execute(v: View) -> DataFrame:
    return executed(v).select(*COLUMNS.split(", "))


@query(f"SELECT qid, intent, property_scope, property_name, temporal_scope, ordinal_offset, aggregation_mode FROM ({OVERRIDE})", "plans")
def plan_override(v: View) -> DataFrame:
    return symbolic.override(v.plans).select("qid", "intent", "property_scope", "property_name", "temporal_scope", "ordinal_offset", "aggregation_mode")


FINAL_PLANS = f"(SELECT p.*, complete FROM ({FINAL}) p JOIN {complete_sql(f'({FINAL})')} c ON c.qid = p.qid)"


def final(v: View) -> DataFrame:
    e, m = counts(v)
    return symbolic.execute_final(v.plans, retrieved(v), e, m).withColumn("answer_list", F.array_join("answer_list", "|"))


@query(f"SELECT {COLUMNS} FROM {execute_sql(FINAL_PLANS)}", "plans", "candidates")
def plan_execute_final(v: View) -> DataFrame:
    return final(v).select(*COLUMNS.split(", "))


ELIGIBLE = "CASE WHEN p.intent = 'boolean' THEN coalesce(p.entity, '') <> '' AND coalesce(p.boolean_target, '') <> '' AND status = 'answered' ELSE p.supported AND complete AND status = 'answered' END"


@query(f"SELECT p.qid, {ELIGIBLE} AS eligible FROM plans p JOIN {EXECUTED} e ON e.qid = p.qid", "plans", "candidates")
def hybrid_eligibility(v: View) -> DataFrame:
    """Tested on the plan's intent before any override."""
    j = v.plans.join(executed(v).select("qid", "complete", "status"), "qid")
    done = F.col("status") == "answered"
    whole = (F.coalesce("entity", F.lit("")) != "") & (F.coalesce("boolean_target", F.lit("")) != "")
    return j.select("qid", F.when(F.col("intent") == "boolean", whole & done).otherwise(F.col("supported") & F.col("complete") & done).alias("eligible"))


RENDERED = "coalesce(answer_text, CASE WHEN answer_int IS NULL AND answer_bool IS NULL THEN answer_list END, answer_int::VARCHAR, CASE WHEN answer_bool THEN 'True' WHEN NOT answer_bool THEN 'False' END)"


@query(f"SELECT e.qid, CASE WHEN status = 'answered' THEN {RENDERED} ELSE 'fallback ' || gold END AS answer, status <> 'answered' AS fallback_used FROM {EXECUTED} e JOIN questions q ON q.qid = e.qid", "plans", "candidates")
def hybrid_fallback(v: View) -> DataFrame:
    j = executed(v).join(v.questions.select("qid", "gold"), "qid")
    done = F.col("status") == "answered"
    both = F.col("answer_int").isNull() & F.col("answer_bool").isNull()
    text = F.coalesce("answer_text", F.when(both, F.col("answer_list")), F.col("answer_int").cast("string"), F.when(F.col("answer_bool"), "True").when(~F.col("answer_bool"), "False"))
    return j.select("qid", F.when(done, text).otherwise(F.concat(F.lit("fallback "), "gold")).alias("answer"), (~done).alias("fallback_used"))


HOPS = "(SELECT p_partkey AS qid, 'Which {hop_1_answer} of {hop_2_answer} made ' || p_name || (CASE WHEN p_partkey % 2 = 0 THEN ' {hop_1_answer}' ELSE '' END) AS q, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS a1, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS a2 FROM part)"


def hop_rows(v: View) -> DataFrame:
    k = F.col("p_partkey")
    q = F.concat(F.lit("Which {hop_1_answer} of {hop_2_answer} made "), "p_name", F.when(k % 2 == 0, " {hop_1_answer}").otherwise(""))
    return v.table("part").select(k.alias("qid"), q.alias("q"), F.when(k % 3 != 0, F.col("p_brand")).alias("a1"), F.when(k % 5 == 0, "").otherwise(F.col("p_type")).alias("a2"))


@query(f"SELECT qid, replace(replace(q, '{{hop_1_answer}}', coalesce(a1, '')), '{{hop_2_answer}}', coalesce(a2, '')) AS resolved FROM {HOPS}")
def hop_substitute(v: View) -> DataFrame:
    return hop_rows(v).select("qid", hops.substitute(F.col("q"), {1: F.col("a1"), 2: F.col("a2")}).alias("resolved"))


@query(f"SELECT qid, missing IS NULL AS can_execute, missing FROM (SELECT qid, CASE WHEN coalesce(a1, '') = '' THEN 1 WHEN coalesce(a2, '') = '' THEN 2 END AS missing FROM {HOPS})")
def hop_can_execute(v: View) -> DataFrame:
    m = hops.missing(F.col("q"), {1: F.col("a1"), 2: F.col("a2")})
    return hop_rows(v).select("qid", m.alias("missing")).select("qid", F.col("missing").isNull().alias("can_execute"), "missing")


CHAIN_FACTS = "(SELECT p_name AS entity, p_brand AS value, p_partkey AS serial FROM part UNION ALL SELECT p_brand, p_type, p_partkey FROM part)"
KNOWN = f"(SELECT entity, arg_max(value, serial) AS value FROM {CHAIN_FACTS} GROUP BY entity)"


@query(
    f"SELECT qid, coalesce(c.value, b.value, a.value, '(no answer)') AS answer, 1 + (a.value IS NOT NULL)::BIGINT + (b.value IS NOT NULL)::BIGINT + (c.value IS NOT NULL)::BIGINT AS executed, 4 - (1 + (a.value IS NOT NULL)::BIGINT + (b.value IS NOT NULL)::BIGINT + (c.value IS NOT NULL)::BIGINT) AS skipped FROM (SELECT p_partkey AS qid, CASE WHEN p_partkey % 7 = 0 THEN 'nobody' ELSE p_name END AS e FROM part) q LEFT JOIN {KNOWN} a ON a.entity = e LEFT JOIN {KNOWN} b ON b.entity = a.value LEFT JOIN {KNOWN} c ON c.entity = b.value"
)
def multihop_chain(v: View) -> DataFrame:
    p = v.table("part")
    facts = p.select(F.col("p_name").alias("entity"), F.col("p_brand").alias("value"), F.col("p_partkey").alias("serial")).unionByName(p.select(F.col("p_brand").alias("entity"), F.col("p_type").alias("value"), F.col("p_partkey").alias("serial")))
    q = p.select(F.col("p_partkey").alias("qid"), F.when(F.col("p_partkey") % 7 == 0, "nobody").otherwise(F.col("p_name")).alias("entity"))
    return hops.chain(q, facts.withColumn("ord", F.col("serial")), 4)


SEARCHED = f"(SELECT q.qid, q.question, q.entity, q.gold, route, CASE WHEN route IN ('temporal', 'aggregation') AND {STRIPPED} <> '' THEN {STRIPPED} ELSE question END AS query, CASE route WHEN 'temporal' THEN 25 WHEN 'aggregation' THEN 40 ELSE 10 END AS k FROM questions q JOIN ({ROUTE_SQL}) r ON r.qid = q.qid)"
FOUND = f"""(SELECT qid, doc_id FROM (SELECT s.qid, doc_id, row_number() OVER (PARTITION BY s.qid ORDER BY score DESC, doc_id) AS rank, k FROM {scores_sql("(SELECT serial AS doc_id, text FROM fact_text)", "searched")} s JOIN searched a ON a.qid = s.qid) WHERE rank <= k)"""
OWN = f"""SELECT qid, serial, text AS fact_text, value AS answer_entity FROM (SELECT f.qid, q.entity, t.serial, t.text, {PLANNER[0]} AS subject, {PLANNER[1]} AS value FROM {FOUND} f JOIN fact_text t ON t.serial = f.doc_id JOIN questions q ON q.qid = f.qid) WHERE subject = entity AND value <> ''"""


ANSWERED = f"""SELECT q.qid, route, k, coalesce(n, 0) AS n_candidates, answer, contains(lower(answer), lower(gold)) AS correct FROM (
      SELECT s.*, n, CASE route WHEN 'temporal' THEN h.answer WHEN 'boolean' THEN (CASE WHEN b.answer THEN 'True' ELSE 'False' END) WHEN 'aggregation' THEN a.answer ELSE coalesce(f.answer_entity, '(no answer)') END AS answer FROM searched s
      LEFT JOIN (SELECT qid, count(*) AS n FROM own GROUP BY qid) c ON c.qid = s.qid LEFT JOIN {NEWEST.replace('candidates', 'own')} f ON f.qid = s.qid
      LEFT JOIN ({HISTORICAL_SQL.replace('candidates', 'own')}) h ON h.qid = s.qid LEFT JOIN ({BOOLEAN_SQL.replace('candidates', 'own')}) b ON b.qid = s.qid LEFT JOIN ({AGGREGATE_SQL.replace('candidates', 'own')}) a ON a.qid = s.qid) q"""


@query(with_views("", "questions", "fact_text").rstrip() + f", searched AS {SEARCHED}, own AS ({OWN}) {ANSWERED}")
def answer_end_to_end(v: View) -> DataFrame:
    """Every question from its words alone: route, clean, retrieve, take candidates, answer.

    Candidates are the retrieved facts whose subject is the question's entity; a fact is parsed once,
    before it meets its questions.
    """
    q = v.questions.join(routing.heuristic(v.questions).select("qid", "route"), "qid")
    timed = F.col("route").isin("temporal", "aggregation")
    q = settled(q.select("qid", "question", "entity", "gold", "route", F.when(timed, X.strip_noise(F.col("question"))).otherwise(F.col("question")).alias("query"), F.when(F.col("route") == "temporal", 25).when(F.col("route") == "aggregation", 40).otherwise(10).alias("k")))
    scan = kept(v.fact_text, doc="serial")
    asking = q.select("qid", "k", "entity", "route")
    if scan:  # a question's documents stay one row until its entity is there
        found = bm25_tiles.lists(scan, q).join(asking, "qid").select("qid", "entity", "route", F.explode("best.doc").alias("doc"))
    else:
        found = kept_index(v.fact_text, doc="serial").top_k(q, 40).join(asking, "qid").where(F.col("rank") <= F.col("k"))
    facts = symbolic.parsed_facts(v.fact_text).select(F.col("serial").alias("doc"), "ord", F.col("text").alias("fact_text"), "subject", "answer_entity").where("answer_entity <> ''")
    own = settled(found.join(facts, "doc").where(F.col("subject") == F.col("entity")).select("qid", "route", F.col("doc").alias("serial"), "ord", "fact_text", "answer_entity"))
    freshest = own.groupBy("qid").agg(F.max(F.struct("serial", (-F.col("ord")).alias("o"), "answer_entity")).alias("c"), F.count("*").alias("n"))
    of = lambda route: q.where(F.col("route") == route).select("qid", "question")
    mine = lambda route: own.where(F.col("route") == route).drop("route")
    answers = [
        symbolic.historical_native(of("temporal"), mine("temporal")).select("qid", "answer"),
        symbolic.boolean_native(of("boolean"), mine("boolean")).select("qid", F.when(F.col("answer"), "True").otherwise("False").alias("answer")),
        symbolic.aggregate_native(of("aggregation"), mine("aggregation")).select("qid", "answer"),
        of("freshness").join(freshest, "qid", "left").select("qid", F.coalesce("c.answer_entity", F.lit("(no answer)")).alias("answer")),
    ]
    j = q.join(reduce(DataFrame.unionByName, answers), "qid").join(freshest.select("qid", "n"), "qid", "left")
    return j.select("qid", "route", "k", F.coalesce("n", F.lit(0).cast("long")).alias("n_candidates"), "answer", S.subem(F.col("answer"), F.col("gold")).alias("correct"))
