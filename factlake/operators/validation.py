"""Validation of candidates, plans and benchmark rows as projections with an error column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.text import case, planner_normal

CANDIDATES = "struct<candidates:array<struct<serial:bigint,fact_text:string,answer_entity:string>>>"
INTENTS = ("current_value", "historical", "aggregation", "boolean")
PROPERTY_SCOPES = ("specific", "entity_wide_values", "ambiguous")
TEMPORAL_SCOPES = ("latest", "earliest", "previous", "ordinal", "unspecified")
AGGREGATION_MODES = ("none", "count", "list")
PLAN_KEYS = ("aggregation_mode", "boolean_target", "entity", "intent", "negated", "ordinal_offset", "property_name", "property_scope", "reason", "supported", "temporal_scope")


def parse_candidates(raw: DataFrame) -> DataFrame:
    """(qid, serial, fact_text, answer_entity); text that is no JSON object gives none."""
    rows = raw.select("qid", F.explode(F.from_json("raw", CANDIDATES)["candidates"]).alias("c"))
    return rows.select("qid", "c.serial", "c.fact_text", "c.answer_entity")


def validate_candidates(raw: DataFrame, shown: DataFrame) -> DataFrame:
    """Candidates of answers in which all are valid: shown, and the answer inside the fact.

    ``shown`` has the (qid, serial, text) that the answer was given from. Repeated
    (serial, text) count once. A key beside the three named ones, or a serial that is
    not an integer, spoils the whole answer.
    """
    exact = F.forall(F.from_json(F.get_json_object("raw", "$.candidates"), "array<string>"), lambda x: F.array_sort(F.json_object_keys(x)) == F.array(F.lit("answer_entity"), F.lit("fact_text"), F.lit("serial")))
    rows = parse_candidates(raw.where(F.coalesce(exact, F.lit(False))))
    seen = rows.join(shown.select("qid", "serial", F.col("text").alias("fact_text"), F.lit(True).alias("__shown")).distinct(), ["qid", "serial", "fact_text"], "left")
    inside = F.concat(F.lit(" "), planner_normal(F.col("fact_text")), F.lit(" ")).contains(F.concat(F.lit(" "), planner_normal(F.col("answer_entity")), F.lit(" ")))
    ok = F.coalesce(F.col("__shown") & inside & F.col("serial").isNotNull(), F.lit(False))
    bad = seen.where(~ok).select("qid").distinct()
    good = seen.join(bad, "qid", "left_anti")
    return good.groupBy("qid", "serial", "fact_text").agg(F.trim(F.min("answer_entity")).alias("answer_entity"))


PLAN = "struct<intent:string,entity:string,property_scope:string,property_name:string,temporal_scope:string,ordinal_offset:bigint,aggregation_mode:string,boolean_target:string,negated:boolean,supported:boolean,reason:string>"


def json_kind(text: str, key: str) -> Column:
    """The type that JSON text gives to a key (STRING, BIGINT, BOOLEAN, VOID for null ...); null where it is missing."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(text)), f"$.{key}", "variant"))


def validate_plans(plans: DataFrame) -> DataFrame:
    """(qid, error): the first rule that a plan's JSON breaks, or null. Types are those of the JSON, nothing is coerced."""
    kinds = {k: json_kind("plan", k) for k in PLAN_KEYS}
    p = plans.select("qid", F.array_sort(F.json_object_keys("plan")).alias("keys"), F.from_json("plan", PLAN).alias("p"), F.get_json_object("plan", "$.ordinal_offset").alias("o"), F.struct(*[x.alias(k) for k, x in kinds.items()]).alias("kind"))
    whole = (F.col("kind.ordinal_offset") == "BIGINT") | F.col("kind.ordinal_offset").rlike(r"^DECIMAL\(\d+,0\)$")
    text = lambda k: ~F.coalesce(F.col(f"kind.{k}").isin("STRING", "VOID"), F.lit(False))
    rules = [
        (F.coalesce(F.col("keys") != F.array(*map(F.lit, PLAN_KEYS)), F.lit(True)), "keys"),
        (~F.coalesce(F.col("p.intent"), F.lit("")).isin(*INTENTS), "intent"),
        (~F.coalesce(F.col("p.property_scope"), F.lit("")).isin(*PROPERTY_SCOPES), "property_scope"),
        (~F.coalesce(F.col("p.temporal_scope"), F.lit("")).isin(*TEMPORAL_SCOPES), "temporal_scope"),
        (~F.coalesce(F.col("p.aggregation_mode"), F.lit("")).isin(*AGGREGATION_MODES), "aggregation_mode"),
        (text("entity"), "entity"),
        (text("property_name"), "property_name"),
        (text("boolean_target"), "boolean_target"),
        ((F.col("kind.ordinal_offset") != "VOID") & ~F.coalesce(whole & F.col("o").rlike(r"^\d+$"), F.lit(False)), "ordinal_offset"),
        ((F.col("kind.negated") != "BOOLEAN") | (F.col("kind.supported") != "BOOLEAN"), "booleans"),
        (F.col("kind.reason") != "STRING", "reason"),
        ((F.col("p.property_scope") == "specific") & (F.coalesce("p.property_name", F.lit("")) == ""), "specific scope without property"),
        ((F.col("p.property_scope") == "ambiguous") & F.col("p.supported"), "ambiguous plan supported"),
        ((F.col("p.intent") == "aggregation") & ~F.col("p.aggregation_mode").isin("count", "list"), "aggregation mode missing"),
        ((F.col("p.intent") == "boolean") & (F.col("kind.boolean_target") == "VOID") & F.col("p.supported"), "boolean target missing"),
    ]
    return p.select("qid", case(rules, F.lit(None).cast("string")).alias("error"))


PLURALS = (("countrys", "countries"), ("nationalitys", "nationalities"), ("ethnicitys", "ethnicities"))


def lint(questions: DataFrame) -> DataFrame:
    """(qid, bad, fixed, markdown, bleed) for question text ``q``."""
    q = F.col("q")
    fixed = q
    for bad, good in PLURALS:
        fixed = F.replace(fixed, F.lit(bad), F.lit(good))
    bleed = (F.col("intent") == "boolean") & (F.col("gold") == "True") & ~q.contains(F.col("target"))
    return questions.select("qid", F.lower(q).rlike(r"\b(countrys|nationalitys|ethnicitys)\b").alias("bad"), fixed.alias("fixed"), q.contains("**").alias("markdown"), bleed.alias("bleed"))
