"""Parsing, property and cue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions import text as X
from factlake.operators import facts, symbolic, validation
from factlake.plans.registry import query
from factlake.plans.views import ENTITY, View

# SQL helpers. Patterns are RE2 there: look-arounds become alternatives.
N = "array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ')"
FOLD = "replace(lower({0}), 'ß', 'ss')"
PN = "array_to_string(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+'), ' ')"
STRIP = "rtrim(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '.')"


def n(x: str) -> str:
    return N.format(x)


def pn(x: str) -> str:
    return PN.format(x)


def like_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def pieces_sql(pattern: str, plain: str) -> str:
    return f"""SELECT doc, m[i]::BIGINT AS serial, i - 1 AS context_order,
      coalesce(list_sum([length(y) for y in p[1:i]]), 0)::BIGINT + coalesce(list_sum([length(y) for y in w[1:i-1]]), 0)::BIGINT AS "offset", {STRIP.format('p[i + 1]')} AS text
    FROM (SELECT doc, regexp_extract_all(context, '{pattern}', 1) AS m, regexp_extract_all(context, '{plain}') AS w, regexp_split_to_array(context, '{plain}') AS p FROM contexts), unnest(range(1, length(m) + 1)) AS t(i)"""


LEGACY_SQL = pieces_sql(r"(\d+)\.\s", r"\d+\.\s")
ANCHORED_SQL = pieces_sql(r"(?m)^[ \t]*(\d+)\.\s", r"(?m)^[ \t]*\d+\.\s")


@query(LEGACY_SQL, "contexts")
def facts_parse_legacy(v: View) -> DataFrame:
    return facts.parse_legacy(v.contexts)


@query(ANCHORED_SQL, "contexts")
def facts_parse_anchored(v: View) -> DataFrame:
    return facts.parse_anchored(v.contexts)


@query(f"SELECT doc, serial, context_order, \"offset\", text FROM (SELECT *, row_number() OVER (PARTITION BY doc, serial ORDER BY context_order) AS rn FROM ({LEGACY_SQL})) WHERE rn = 1", "contexts")
def facts_dedupe_first(v: View) -> DataFrame:
    return facts.dedupe_first(facts.parse_legacy(v.contexts), "doc")


@query("SELECT doc_id, i AS chunk, substring(text, i * 4096 + 1, 4096) AS chunk_text FROM documents, unnest(range(0, CAST(ceil(length(text) / 4096.0) AS BIGINT))) AS t(i)")
def chunk_fixed_width(v: View) -> DataFrame:
    return facts.chunk_fixed(v.table("documents").select("doc_id", "text"), "text")


@query("SELECT item_id, length(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark)")
def tokenize_terms(v: View) -> DataFrame:
    t = X.tokens(F.col("text"))
    return v.table("benchmark").select("item_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


def parse_sql(text: str, groups: dict[str, tuple[int, int]]) -> tuple[str, str]:
    both = []
    for g in (0, 1):
        cases = " ".join(f"WHEN regexp_matches({text}, '{p}', 'i') THEN trim(regexp_extract({text}, '{p}', {k[g]}, 'i'))" for p, k in groups.items())
        both.append(f"CASE {cases} END")
    return both[0], both[1]


PLANNER = parse_sql(STRIP.format("text"), {X.SPEAKS: (1, 2), X.EXPLICIT: (1, 2), X.FALLBACK: (1, 4)})
GENERATOR = parse_sql("text", {X.EXPLICIT: (1, 2), X.FALLBACK: (1, 4)})
#: fact_text, benchmark passages and questions as sentences to parse.
SENTENCES = "(SELECT serial, text FROM fact_text UNION ALL SELECT -item_id - 1, text FROM benchmark UNION ALL SELECT -1000000 - p_partkey, p_name || ' was seen and liked by ' || p_brand || '...' FROM part)"


def sentences(v: View) -> DataFrame:
    b = v.table("benchmark").select((-F.col("item_id") - 1).alias("serial"), "text")
    p = v.table("part").select((-1000000 - F.col("p_partkey")).alias("serial"), F.concat("p_name", F.lit(" was seen and liked by "), "p_brand", F.lit("...")).alias("text"))
    return v.fact_text.select("serial", "text").unionByName(b).unionByName(p)


@query(f"SELECT serial, {PLANNER[0]} AS subject, {PLANNER[1]} AS value FROM {SENTENCES}", "fact_text")
def fact_template_parse(v: View) -> DataFrame:
    s, value = X.parse_fact(F.col("text"))
    return sentences(v).select("serial", s.alias("subject"), value.alias("value"))


@query(f"SELECT serial, {GENERATOR[0]} AS subject, {GENERATOR[1]} AS value, CASE WHEN regexp_matches(text, '{X.EXPLICIT}', 'i') THEN 'explicit' WHEN regexp_matches(text, '{X.FALLBACK}', 'i') THEN 'fallback' END AS parse_kind FROM {SENTENCES}", "fact_text")
def fact_generated_parse(v: View) -> DataFrame:
    s, value, kind = X.parse_generated(F.col("text"))
    return sentences(v).select("serial", s.alias("subject"), value.alias("value"), kind.alias("parse_kind"))


def property_sql(x: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {like_any(FOLD.format(x), cues)} THEN '{name}'" for name, cues in rules) + " ELSE 'value' END"


PROPERTY_PLANNER = property_sql("{0}", [("country", ("country", "citizen of", "citizenship")), ("genre", ("genre",)), ("location", ("located", "capital", "born in", "died in", "worked in")), *X._LATER])
PROPERTY_GENERATOR = property_sql("{0}", [("country", ("country",)), ("genre", ("genre",)), ("location", ("located", "capital")), ("language", ("language",)), *X._LATER[1:]])
CUED = "(SELECT serial, text || ' ' || ['speaks it', 'of the country', 'is located here', 'was born in', 'citizen of', 'has religion', 'was directed by', 'plain'][(serial % 8 + 8) % 8 + 1] AS text FROM fact_text)"


def cued(v: View) -> DataFrame:
    words = ["speaks it", "of the country", "is located here", "was born in", "citizen of", "has religion", "was directed by", "plain"]
    return v.fact_text.select("serial", F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, words)), (F.pmod("serial", F.lit(8)) + 1).cast("int"))).alias("text"))


@query(f"SELECT serial, {PROPERTY_PLANNER.format('text')} AS property FROM {CUED}", "fact_text")
def property_type_planner(v: View) -> DataFrame:
    return cued(v).select("serial", X.planner_property(F.col("text")).alias("property"))


@query(f"SELECT serial, {PROPERTY_GENERATOR.format('text')} AS property FROM {CUED}", "fact_text")
def property_type_generator(v: View) -> DataFrame:
    return cued(v).select("serial", X.generator_property(F.col("text")).alias("property"))


QUESTION_PROPERTY = "CASE " + " ".join(f"WHEN regexp_matches(lower(question), '\\b{noun}\\b') THEN '{kind}'" for noun, kind in X.QUESTION_NOUNS) + " ELSE 'value' END"


@query(f"SELECT qid, {QUESTION_PROPERTY} AS property FROM questions", "questions")
def question_property_type(v: View) -> DataFrame:
    return v.questions.select("qid", X.question_property(F.col("question")).alias("property"))


CANON = f"(CASE {pn('{0}')} WHEN 'citizenship' THEN 'country' WHEN 'city' THEN 'location' ELSE {pn('{0}')} END)"


@query(f"SELECT qid, name, {CANON.format('name')} AS canonical FROM (SELECT qid, unnest([property, 'City', 'Citizen-Ship', 'citizenship', upper(property)]) AS name FROM questions)", "questions")
def property_canonical(v: View) -> DataFrame:
    names = F.explode(F.array("property", F.lit("City"), F.lit("Citizen-Ship"), F.lit("citizenship"), F.upper("property")))
    return v.questions.select("qid", names.alias("name")).select("qid", "name", X.canonical_property(F.col("name")).alias("canonical"))


RAW = """(SELECT p_partkey AS qid, CASE p_partkey % 4 WHEN 3 THEN 'not json {' WHEN 2 THEN '{"other": 1}' ELSE
  '{"candidates": [{"serial": ' || (2 * p_partkey) || ', "fact_text": "' || {entity} || ' was manufactured by ' || p_brand || '", "answer_entity": "' || (CASE WHEN p_partkey % 8 = 1 THEN 'nobody' ELSE p_brand END) || '"}, {"serial": ' || (2 * p_partkey + 1) || ', "fact_text": "' || {entity} || ' has the genre of ' || p_type || '", "answer_entity": "' || p_type || '"}]}' END AS raw FROM part)""".replace("{entity}", ENTITY)


def raw_answers(v: View) -> DataFrame:
    p = v.part
    name, brand, kind, k = (F.col(c) for c in ("entity", "p_brand", "p_type", "p_partkey"))
    good = F.concat(F.lit('{"candidates": [{"serial": '), (2 * k).cast("string"), F.lit(', "fact_text": "'), name, F.lit(" was manufactured by "), brand, F.lit('", "answer_entity": "'), F.when(k % 8 == 1, "nobody").otherwise(brand), F.lit('"}, {"serial": '), (2 * k + 1).cast("string"), F.lit(', "fact_text": "'), name, F.lit(" has the genre of "), kind, F.lit('", "answer_entity": "'), kind, F.lit('"}]}'))
    return p.select(k.alias("qid"), F.when(k % 4 == 3, "not json {").when(k % 4 == 2, '{"other": 1}').otherwise(good).alias("raw"))


@query(f"SELECT qid, json_extract_string(j, '$.serial')::BIGINT AS serial, json_extract_string(j, '$.fact_text') AS fact_text, json_extract_string(j, '$.answer_entity') AS answer_entity FROM (SELECT qid, unnest(from_json(json_extract(raw, '$.candidates'), '[\"JSON\"]')) AS j FROM {RAW} WHERE json_valid(raw) AND json_exists(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END, '$.candidates'))")
def candidates_parse_json(v: View) -> DataFrame:
    return validation.parse_candidates(raw_answers(v))


@query(f"""SELECT qid, serial, fact_text, trim(answer_entity) AS answer_entity FROM (SELECT *, bool_and(contains(' ' || {pn('fact_text')} || ' ', ' ' || {pn('answer_entity')} || ' ')) OVER (PARTITION BY qid) AS ok FROM
  (SELECT qid, json_extract_string(j, '$.serial')::BIGINT AS serial, json_extract_string(j, '$.fact_text') AS fact_text, json_extract_string(j, '$.answer_entity') AS answer_entity FROM (SELECT qid, unnest(from_json(json_extract(raw, '$.candidates'), '["JSON"]')) AS j FROM {RAW} WHERE json_valid(raw) AND json_exists(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END, '$.candidates')))) WHERE ok""")
def candidates_validate_strict(v: View) -> DataFrame:
    shown = v.fact_text.select(F.floor(F.col("serial") / 2).alias("qid"), "serial", "text")
    return validation.validate_candidates(raw_answers(v), shown)


def plan_json(pick) -> str:
    """A plan per part as SQL text; ``pick(items, n, step)`` names the item at a part key's step modulo n."""
    return (
        "'{\"intent\": \"' || " + pick(("historical", "aggregation", "boolean", "other"), 4) + " || '\", \"entity\": ' || " + pick(('"e"', "null", '"f"', "5", '"g"', '{"a": 1}', '"h"'), 7, 13) + " || ', \"property_scope\": \"' || " + pick(("specific", "entity_wide_values", "ambiguous"), 3)
        + " || '\", \"property_name\": ' || (CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE '\"genre\"' END) || ', \"temporal_scope\": \"' || (CASE WHEN p_partkey % 7 = 0 THEN 'sometime' ELSE 'earliest' END) || '\", \"ordinal_offset\": ' || "
        + pick(("null", "2", "-1", "true", "null", "0", '"2"', "3", "2.0"), 9) + " || ', \"aggregation_mode\": \"' || " + pick(("count", "none"), 2)
        + " || '\", \"boolean_target\": ' || " + pick(("null", '"x"', "null", '["x"]'), 4, 19) + " || ', \"negated\": false, \"supported\": ' || (CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END) || (CASE WHEN p_partkey % 11 = 0 THEN '' ELSE ', \"reason\": \"\"' END) || '}'"
    )


def _in_duckdb(items, n: int, step: int = 1) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + f"][p_partkey // {step} % {n} + 1]"


def _in_spark(items, n: int, step: int = 1) -> str:
    return "array(" + ", ".join(f"'{x}'" for x in items) + f")[CAST(p_partkey div {step} % {n} AS INT)]"


PLAN_JSON = f"(SELECT p_partkey AS qid, {plan_json(_in_duckdb)} AS plan FROM part)"


def plan_jsons(v: View) -> DataFrame:
    return v.table("part").selectExpr("p_partkey AS qid", f"{plan_json(_in_spark)} AS plan")


@query(
    f"""SELECT qid, CASE WHEN p_partkey % 11 = 0 THEN 'keys' WHEN i = 'other' THEN 'intent' WHEN t = 'sometime' THEN 'temporal_scope' WHEN ke NOT IN ('VARCHAR', 'NULL') THEN 'entity' WHEN kt NOT IN ('VARCHAR', 'NULL') THEN 'boolean_target' WHEN ko NOT IN ('UBIGINT', 'NULL') THEN 'ordinal_offset'
      WHEN s = 'specific' AND pname IS NULL THEN 'specific scope without property' WHEN s = 'ambiguous' AND sup THEN 'ambiguous plan supported' WHEN i = 'aggregation' AND m = 'none' THEN 'aggregation mode missing' WHEN i = 'boolean' AND sup AND kt = 'NULL' THEN 'boolean target missing' END AS error
    FROM (SELECT qid, qid AS p_partkey, json_extract_string(plan, '$.intent') AS i, json_extract_string(plan, '$.temporal_scope') AS t, json_type(plan, '$.ordinal_offset') AS ko, json_type(plan, '$.entity') AS ke, json_type(plan, '$.boolean_target') AS kt, json_extract_string(plan, '$.property_scope') AS s, json_extract_string(plan, '$.property_name') AS pname, json_extract_string(plan, '$.supported') = 'true' AS sup, json_extract_string(plan, '$.aggregation_mode') AS m FROM {PLAN_JSON})"""
)
def plan_validate(v: View) -> DataFrame:
    return validation.validate_plans(plan_jsons(v))


@query("SELECT qid, array_to_string(regexp_extract_all(q, '\\{hop_(\\d+)_answer\\}', 1), ',') AS hops FROM (SELECT qid, 'Who is {hop_' || qid % 3 || '_answer} of {hop_' || qid % 5 || '_answer}' || (CASE WHEN qid % 2 = 0 THEN ' {hop_x_answer}' ELSE '' END) AS q FROM questions)", "questions")
def hop_dependencies(v: View) -> DataFrame:
    q = F.concat(F.lit("Who is {hop_"), (F.col("qid") % 3).cast("string"), F.lit("_answer} of {hop_"), (F.col("qid") % 5).cast("string"), F.lit("_answer}"), F.when(F.col("qid") % 2 == 0, " {hop_x_answer}").otherwise(""))
    return v.questions.select("qid", F.array_join(X.hop_numbers(q).cast("array<string>"), ",").alias("hops"))


UNPARSED = f"NOT regexp_matches(text, '{X.EXPLICIT}', 'i') AND NOT regexp_matches(text, '{X.FALLBACK}', 'i')"
ONLY_LEGACY = f"(SELECT * FROM ({LEGACY_SQL}) l WHERE NOT EXISTS (SELECT 1 FROM ({ANCHORED_SQL}) a WHERE a.doc = l.doc AND a.\"offset\" = l.\"offset\"))"


@query(
    f"""SELECT c.doc, coalesce(n_legacy, 0) AS n_legacy, coalesce(n_anchored, 0) AS n_anchored, coalesce(duplicate_serials, 0) AS duplicate_serials, coalesce(empty_texts, 0)::BIGINT AS empty_texts, coalesce(only_legacy, 0) AS only_legacy, coalesce(unparsed, 0) AS unparsed FROM contexts c
    LEFT JOIN (SELECT doc, count(*) AS n_legacy FROM ({LEGACY_SQL}) GROUP BY doc) USING (doc) LEFT JOIN (SELECT doc, count(*) AS n_anchored, count(*) - count(DISTINCT serial) AS duplicate_serials, sum((text = '')::INT) AS empty_texts, count(*) FILTER ({UNPARSED}) AS unparsed FROM ({ANCHORED_SQL}) GROUP BY doc) USING (doc)
    LEFT JOIN (SELECT doc, count(*) AS only_legacy FROM {ONLY_LEGACY} GROUP BY doc) USING (doc)""",
    "contexts",
)
def parser_boundary_audit(v: View) -> DataFrame:
    return facts.boundary_audit(v.contexts, "doc")


@query(f"SELECT doc, serial AS pseudo_serial, \"offset\", substring(context, greatest(\"offset\" - 48, 0) + 1, \"offset\" + 80 - greatest(\"offset\" - 48, 0)) AS snippet FROM {ONLY_LEGACY} JOIN contexts USING (doc)", "contexts")
def parser_false_boundaries(v: View) -> DataFrame:
    return facts.false_boundaries(v.contexts, "doc")


@query(f"SELECT doc, serial, text AS fact_text FROM ({ANCHORED_SQL}) WHERE {UNPARSED}", "contexts")
def parser_unparsed_facts(v: View) -> DataFrame:
    return facts.unparsed_facts(v.contexts, "doc")


SCOPE = f"(CASE WHEN property_scope = 'entity_wide_values' THEN TRUE WHEN property_scope = 'specific' THEN coalesce({CANON.format('fact_property')} = {CANON.format('property_name')}, FALSE) ELSE FALSE END)"


@query(f"SELECT qid, serial, {SCOPE} AS in_scope FROM (SELECT p.*, c.serial, {PROPERTY_PLANNER.format('c.fact_text')} AS fact_property FROM plans p JOIN candidates c ON p.qid = c.qid)", "plans", "candidates")
def scope_filter(v: View) -> DataFrame:
    j = v.plans.join(v.candidates.select("qid", "serial", "fact_text"), "qid")
    return j.select("qid", "serial", symbolic.in_scope(F.col("property_scope"), F.col("property_name"), X.planner_property(F.col("fact_text"))).alias("in_scope"))


def retrieved(v: View) -> DataFrame:
    return v.retrieved


@query(
    f"""SELECT DISTINCT qid, serial, fact_text, answer_entity FROM (SELECT p.qid, c.serial, c.fact_text, c.answer_entity, property_scope, property_name, {PROPERTY_PLANNER.format('c.fact_text')} AS fact_property FROM plans p JOIN candidates c ON p.qid = c.qid WHERE supported) WHERE {SCOPE}""",
    "plans", "candidates",
)
def deterministic_candidates(v: View) -> DataFrame:
    return symbolic.deterministic_candidates(v.plans, retrieved(v)).select("qid", "serial", "fact_text", "answer_entity")


def mention_sql(q: str, p: str) -> str:
    return f"({n(p)} <> '' AND (contains(' ' || {n(q)} || ' ', ' ' || {n(p)} || ' ') OR list_has_all(string_split({n(q)}, ' '), string_split({n(p)}, ' '))))"


@query(f"SELECT qid, {mention_sql('question', 'target')} AS target, {mention_sql('question', 'entity')} AS entity, {mention_sql('question', chr(39) + 'value distinct' + chr(39))} AS scattered, {mention_sql('question', chr(39) + '--' + chr(39))} AS empty FROM questions", "questions")
def phrase_mention(v: View) -> DataFrame:
    q = F.col("question")
    return v.questions.select("qid", X.mentions(q, F.col("target")).alias("target"), X.mentions(q, F.col("entity")).alias("entity"), X.mentions(q, F.lit("value distinct")).alias("scattered"), X.mentions(q, F.lit("--")).alias("empty"))


NEGATED = f"({' OR '.join(f'contains({chr(39)} {chr(39)} || {n(chr(123) + chr(48) + chr(125))} || {chr(39)} {chr(39)}, {chr(39)}{w}{chr(39)})' for w in X.NEGATIONS)})"


@query(f"SELECT qid, {NEGATED.format('question')} AS negated FROM questions", "questions")
def negation_cue(v: View) -> DataFrame:
    return v.questions.select("qid", X.negated(F.col("question")).alias("negated"))


EVER = like_any("lower({0})", X.EVER)


@query(f"SELECT qid, {EVER.format('question')} AS ever, ({' OR '.join(f'''regexp_matches(lower(question), '\\b{w}\\b')''' for w in X.EVER)}) AS ever_word FROM questions", "questions")
def ever_cue(v: View) -> DataFrame:
    q = F.col("question")
    return v.questions.select("qid", X.asks_ever(q).alias("ever"), X.asks_ever(q, strict_words=True).alias("ever_word"))


def word_sql(x: str, term: str) -> str:
    return f"regexp_matches({x}, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


RELATION = word_sql("lower({0})", f"({'|'.join(X.RELATIONS)})")


@query(f"SELECT qid, {RELATION.format('question')} AS names_relation FROM questions", "questions")
def relation_mention(v: View) -> DataFrame:
    return v.questions.select("qid", X.names_relation(F.col("question")).alias("names_relation"))


HITS = ", ".join(f"CASE WHEN {word_sql('lower({0})', cue)} THEN {{{{'at': instr(lower({{0}}), '{cue}'), 'cue': '{cue}', 'scope': '{scope}'}}}} END".replace("{{0}}", "{0}") for cue, scope in X.TEMPORAL_CUES.items())
CUE = f"(CASE WHEN regexp_matches(lower({{0}}), '{X.BEFORE_UPDATE}') THEN 'earliest' ELSE list_min(list_filter([{HITS}], lambda h: h IS NOT NULL))['scope'] END)"


@query(f"SELECT qid, {CUE.format('question')} AS cue FROM questions", "questions")
def temporal_cue(v: View) -> DataFrame:
    return v.questions.select("qid", X.temporal_cue(F.col("question")).alias("cue"))


COUNT = f"regexp_matches(lower({{0}}), '{X.COUNT_CUES}')"


@query(f"SELECT qid, {COUNT.format('question')} AS asks_count FROM questions", "questions")
def count_cue(v: View) -> DataFrame:
    return v.questions.select("qid", X.asks_count(F.col("question")).alias("asks_count"))


OFFSET = (
    f"(CASE WHEN regexp_matches({n('{0}')}, '{X.OLDEST}') THEN NULL "
    + " ".join(f"WHEN regexp_matches({n('{0}')}, '\\b{w}\\b') AND regexp_matches({n('{0}')}, '{X.RECENT}') THEN {k}" for w, k in X.ORDINALS.items())
    + f" WHEN regexp_matches({n('{0}')}, '{X.PREVIOUS}') THEN 1 END)"
)


@query(f"SELECT qid, {OFFSET.format('question')} AS k FROM questions", "questions")
def temporal_offset(v: View) -> DataFrame:
    return v.questions.select("qid", X.temporal_offset(F.col("question")).alias("k"))


STRIPPED = f"trim(regexp_replace(question, '{X.NOISE}', '', 'gi'))"


@query(f"SELECT qid, CASE WHEN {STRIPPED} = '' THEN question ELSE {STRIPPED} END AS search_text FROM questions", "questions")
def query_noise_strip(v: View) -> DataFrame:
    return v.questions.select("qid", X.strip_noise(F.col("question")).alias("search_text"))


@query("SELECT qid, negated AND regexp_matches(lower(question), '\\b(not|never|no)\\b') AS negated FROM plans", "plans")
def boolean_polarity_fix(v: View) -> DataFrame:
    return v.plans.select("qid", (F.col("negated") & F.lower("question").rlike(r"\b(not|never|no)\b")).alias("negated"))


BANNED = "first|earliest|previous|how many|count|ever"


@query(f"SELECT qid, NOT regexp_matches(lower(replace(question, entity, ' ')), '\\b({BANNED})\\b') AS ok FROM questions", "questions")
def banned_cue_guard(v: View) -> DataFrame:
    return v.questions.select("qid", (~F.lower(F.replace("question", F.col("entity"), F.lit(" "))).rlike(rf"\b({BANNED})\b")).alias("ok"))


BAD_PLURAL = r"\b(countrys|nationalitys|ethnicitys)\b"


@query(
    f"""SELECT qid, bad, replace(replace(replace(q, 'countrys', 'countries'), 'nationalitys', 'nationalities'), 'ethnicitys', 'ethnicities') AS fixed, contains(q, '**') AS markdown, bleed FROM
    (SELECT qid, q, regexp_matches(lower(q), '{BAD_PLURAL}') AS bad, intent = 'boolean' AND gold = 'True' AND NOT contains(q, target) AS bleed FROM (SELECT *, question || ['', ' countrys', ' **x**', ' nationalitys'][qid % 4 + 1] AS q FROM questions))""",
    "questions",
)
def benchmark_lint(v: View) -> DataFrame:
    tail = F.element_at(F.array(F.lit(""), F.lit(" countrys"), F.lit(" **x**"), F.lit(" nationalitys")), (F.col("qid") % 4 + 1).cast("int"))
    return validation.lint(v.questions.withColumn("q", F.concat("question", tail)))
