"""Scores, summaries, audits and benchmark generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions import scoring as S
from factlake.functions import text as X
from factlake.operators import audit, generate, history
from factlake.plans.registry import query
from factlake.plans.text import QUESTION_PROPERTY, n, pn
from factlake.plans.views import View, _sql_list

#: Answers in many wordings, by part.
ANSWERS = ("There are 5 values. Final answer: {g}.", "{g}", "Yes, that is correct.", "four", "no, FALSE", "The value is {g}!", "answer = 1,234 or twelve", "nothing 15")
ANSWERED = f"(SELECT qid, intent, gold, CASE WHEN qid % 9 = 0 THEN NULL ELSE replace({_sql_list(ANSWERS)}[qid % 8 + 1], '{{g}}', gold) END AS answer FROM questions)"


def answered(v: View) -> DataFrame:
    k = F.col("qid")
    a = F.element_at(F.array(*[F.lit(x) for x in ANSWERS]), (k % 8 + 1).cast("int"))
    return v.questions.select("qid", "intent", "gold", F.when(k % 9 != 0, F.replace(a, F.lit("{g}"), F.col("gold"))).alias("answer"))


WORD_NUMBERS = "|".join(X.NUMBER_WORDS)
TOKENS = "regexp_extract_all(regexp_replace(lower({0}), '[^a-z]+', '  ', 'g'), '(?:^| )(yes|true|correct|no|false|incorrect)(?: |$)', 1)"
BOOL = f"(CASE WHEN length({TOKENS}) > 0 THEN {TOKENS}[-1] IN ('yes', 'true', 'correct') END)"
#: Words and digits apart from any letter, digit or underscore; words up to twenty.
PIECES = "regexp_extract_all(regexp_replace(replace(regexp_replace(lower({0}), '(?s)^.*(final\\s+answer|answer)\\s*[:=-]\\s*', ''), ',', ''), '[^a-z0-9_+-]+', '  ', 'g'), '(?:^| )([+-]?[0-9]+|" + WORD_NUMBERS + ")(?: |$)', 1)"
NUMBER = f"(CASE WHEN length({PIECES}) = 0 THEN NULL ELSE coalesce(TRY_CAST({PIECES}[-1] AS BIGINT), list_position({_sql_list(X.NUMBER_WORDS)}, {PIECES}[-1]) - 1) END)"


@query(f"SELECT qid, {BOOL.format('answer')} AS parsed FROM {ANSWERED}", "questions")
def parse_boolean(v: View) -> DataFrame:
    return answered(v).select("qid", S.parse_boolean(F.col("answer")).alias("parsed"))


@query(f"SELECT qid, {NUMBER.format('answer')} AS parsed FROM {ANSWERED}", "questions")
def parse_final_number(v: View) -> DataFrame:
    return answered(v).select("qid", S.parse_number(F.col("answer")).alias("parsed"))


def scored_query(scorer):
    return lambda v: answered(v).select("qid", scorer(F.col("intent"), F.col("answer"), F.col("gold")).alias("correct"))


@query(f"SELECT qid, contains(lower(coalesce(answer, '')), lower(gold)) AS correct FROM {ANSWERED}", "questions")
def score_subem(v: View) -> DataFrame:
    return answered(v).select("qid", S.subem(F.col("answer"), F.col("gold")).alias("correct"))


@query(f"SELECT qid, coalesce(contains(trim(lower(answer)), trim(lower(gold))) OR contains(trim(lower(gold)), trim(lower(answer))) OR (regexp_extract(answer, '\\d+') <> '' AND regexp_extract(answer, '\\d+') = regexp_extract(gold, '\\d+')), FALSE) AS correct FROM {ANSWERED}", "questions")
def score_bidirectional(v: View) -> DataFrame:
    return answered(v).select("qid", S.bidirectional(F.col("answer"), F.col("gold")).alias("correct"))


@query(f"SELECT qid, coalesce(contains(trim(regexp_replace(lower(answer), '\\s+', ' ', 'g')), trim(regexp_replace(lower(gold), '\\s+', ' ', 'g'))), FALSE) AS correct FROM {ANSWERED}", "questions")
def score_soft(v: View) -> DataFrame:
    return answered(v).select("qid", S.soft(F.col("answer"), F.col("gold")).alias("correct"))


BY_INTENT = f"coalesce(CASE intent WHEN 'boolean' THEN {BOOL.format('answer')} = {BOOL.format('gold')} WHEN 'aggregation' THEN {NUMBER.format('answer')} = TRY_CAST(trim(gold) AS BIGINT) ELSE {pn('gold')} <> '' AND contains({pn('answer')}, {pn('gold')}) END, FALSE)"


@query(f"SELECT qid, {BY_INTENT} AS correct FROM {ANSWERED}", "questions")
def score_intent(v: View) -> DataFrame:
    return answered(v).select("qid", S.by_intent(F.col("intent"), F.col("answer"), F.col("gold")).alias("correct"))


@query(
    f"SELECT qid, coalesce(CASE intent WHEN 'boolean' THEN trim(lower(answer)) = trim(lower(gold)) AND trim(lower(gold)) IN ('true', 'false') WHEN 'aggregation' THEN (CASE WHEN regexp_full_match(answer, '\\s*[+-]?\\d+\\s*') THEN trim(answer) = trim(gold) END) ELSE {pn('answer')} = {pn('gold')} END, FALSE) AS correct FROM {ANSWERED}",
    "questions",
)
def score_strict(v: View) -> DataFrame:
    return answered(v).select("qid", S.strict(F.col("intent"), F.col("answer"), F.col("gold")).alias("correct"))


MARKED = f"(SELECT *, {BY_INTENT} AS correct FROM scored)"


def marked(v: View) -> DataFrame:
    return v.scored.withColumn("correct", S.by_intent(F.col("intent"), F.col("answer"), F.col("gold")))


SUMMARY = "count(*) AS n, count(*) FILTER (correct) AS n_correct, round(count(*) FILTER (correct) / nullif(count(*), 0), 6) AS accuracy, count(answer) AS answered, round(count(*) FILTER (correct AND answer IS NOT NULL) / nullif(count(answer), 0), 6) AS accuracy_when_answered"


@query(f"SELECT arm, {SUMMARY} FROM {MARKED} GROUP BY arm", "scored")
def accuracy_summary(v: View) -> DataFrame:
    return audit.accuracy(marked(v), "arm")


@query(f"SELECT arm, coalesce(intent, 'overall') AS intent, n, n_correct, round(n_correct / nullif(n, 0), 6) AS accuracy, n_verified, round(c_verified / nullif(n_verified, 0), 6) AS accuracy_verified FROM (SELECT arm, intent, count(*) AS n, count(*) FILTER (correct) AS n_correct, count(*) FILTER (verified) AS n_verified, count(*) FILTER (verified AND correct) AS c_verified FROM {MARKED} GROUP BY GROUPING SETS ((arm, intent), (arm)))", "scored")
def accuracy_grouping_sets(v: View) -> DataFrame:
    return audit.grouped_accuracy(marked(v))


@query(f"SELECT qid, count(*) FILTER (arm = 'a' AND correct) AS a, count(*) FILTER (arm = 'b' AND correct) AS b, bool_or(arm = 'a' AND correct) AND NOT coalesce(bool_or(arm = 'b' AND correct), FALSE) AS lost FROM {MARKED} GROUP BY qid", "scored")
def arm_flips(v: View) -> DataFrame:
    """Two arms of a question side by side in one aggregation, in place of a self-join."""
    good = lambda arm: (F.col("arm") == arm) & F.col("correct")
    return marked(v).groupBy("qid").agg(F.count_if(good("a")).alias("a"), F.count_if(good("b")).alias("b"), (F.bool_or(good("a")) & ~F.bool_or(good("b"))).alias("lost"))


@query(f"SELECT b.arm, {SUMMARY.replace('(answer)', '(b.answer)').replace('AND answer', 'AND b.answer').replace('FILTER (correct', 'FILTER (b.correct')} FROM {MARKED} b WHERE EXISTS (SELECT 1 FROM {MARKED} a WHERE a.gold = b.gold AND a.intent = b.intent AND a.answer IS NOT NULL AND a.correct) GROUP BY b.arm", "scored")
def subset_comparison(v: View) -> DataFrame:
    """All arms on the questions that some arm answered right."""
    m = marked(v)
    right = m.where("answer is not null and correct").select("gold", "intent").distinct()
    return audit.accuracy(m.join(right, ["gold", "intent"], "left_semi"), "arm")


@query("SELECT row_id, (length(regexp_extract_all(lower(answer), '[a-z0-9]+')) + 100) * 0.15 + 1024 * 0.6 <= 635.0 AS admitted FROM scored WHERE answer IS NOT NULL", "scored")
def budget_guard(v: View) -> DataFrame:
    """Token counts are words here: no tokenizer of a hosted model is at hand."""
    cost = (F.size(X.tokens(F.col("answer"))) + 100) * F.lit(0.15) + F.lit(1024 * 0.6)
    return v.scored.where("answer is not null").select("row_id", (cost <= 635.0).alias("admitted"))


SAVED = "(SELECT qid, intent, gold, [intent, 'boolean', intent][qid % 3 + 1] AS route, coalesce(CASE WHEN qid % 13 = 1 THEN '<error: x>' ELSE answer END, '(no answer)') AS answer, qid % 5 = 0 AS correct FROM " + ANSWERED + ")"


@query(
    f"""SELECT qid, CASE WHEN starts_with(answer, '<error:') THEN 'execution_error' WHEN route <> intent THEN (CASE WHEN correct THEN 'correct' ELSE 'misroute' END) WHEN correct THEN 'correct' WHEN answer = '(no answer)' THEN 'no_answer'
    WHEN intent = 'aggregation' AND regexp_full_match(trim(answer), '\\d+') AND regexp_full_match(trim(gold), '\\d+') THEN (CASE WHEN trim(answer)::BIGINT < trim(gold)::BIGINT THEN 'aggregation_undercount' ELSE 'aggregation_overcount' END)
    WHEN intent = 'boolean' THEN 'boolean_mismatch' WHEN intent = 'historical' THEN 'historical_answer_mismatch' ELSE 'other_answer_mismatch' END AS category FROM {SAVED}""",
    "questions",
)
def failure_category(v: View) -> DataFrame:
    k = F.col("qid")
    route = F.when(k % 3 == 1, "boolean").otherwise(F.col("intent"))
    saved = answered(v).select("qid", "intent", "gold", route.alias("route"), F.coalesce(F.when(k % 13 == 1, "<error: x>").otherwise(F.col("answer")), F.lit("(no answer)")).alias("answer"), (k % 5 == 0).alias("correct"))
    return saved.select("qid", audit.failure_category().alias("category"))


FACTS = f"(SELECT q.qid, p.serial, p.value, {pn('p.value')} AS nv FROM (SELECT *, {QUESTION_PROPERTY} AS qp FROM questions) q JOIN parsed p ON p.entity = q.entity AND (q.qp = 'value' OR q.qp = p.property))"


@query(
    f"""SELECT q.qid, coalesce(f.n, 0) AS n_support, CASE WHEN coalesce(e.n, 0) = 0 OR (coalesce(f.n, 0) = 0 AND q.intent IN ('historical', 'aggregation')) THEN 'unresolved'
      WHEN q.intent = 'historical' THEN (CASE WHEN {pn('f.first')} <> {pn('q.gold')} THEN 'invalid' ELSE 'verified' END)
      WHEN q.intent = 'aggregation' THEN (CASE WHEN TRY_CAST(q.gold AS BIGINT) IS NULL OR TRY_CAST(q.gold AS BIGINT) <> f.d THEN 'invalid' ELSE 'verified' END)
      WHEN q.intent = 'boolean' THEN (CASE WHEN coalesce(f.hit, FALSE) <> (lower(trim(q.gold)) = 'true') THEN 'invalid' ELSE 'verified' END) ELSE 'unresolved' END AS status
    FROM questions q LEFT JOIN (SELECT entity, count(*) AS n FROM parsed GROUP BY entity) e ON e.entity = q.entity
    LEFT JOIN (SELECT x.qid, count(*) AS n, arg_min(value, serial) AS first, count(DISTINCT value) AS d, bool_or(nv = {pn('target')}) AS hit FROM {FACTS} x JOIN questions y ON y.qid = x.qid GROUP BY x.qid) f ON f.qid = q.qid""",
    "questions", "parsed",
)
def gold_audit(v: View) -> DataFrame:
    return audit.gold_audit(v.questions, v.parsed).select("qid", "n_support", "status")


@query(
    f"""SELECT q.qid, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS target, CASE count(DISTINCT v) WHEN 0 THEN 'not_found' WHEN 1 THEN 'matched_catalog' ELSE 'multiple_equal_length_matches' END AS status
    FROM questions q LEFT JOIN (SELECT qid, v FROM (SELECT q.qid, c.v, length({pn('c.v')}) AS l, max(length({pn('c.v')})) OVER (PARTITION BY q.qid) AS m FROM questions q JOIN (SELECT DISTINCT p_brand AS v FROM part UNION SELECT DISTINCT p_type FROM part) c ON contains(' ' || {pn('question')} || ' ', ' ' || {pn('c.v')} || ' ') AND length({pn('c.v')}) >= 3 AND {pn('c.v')} <> {pn('entity')}) WHERE l = m) x ON x.qid = q.qid GROUP BY q.qid""",
    "questions",
)
def boolean_target_find(v: View) -> DataFrame:
    p = v.table("part")
    catalog = p.select(F.explode(F.array("p_brand", "p_type")).alias("v")).distinct()
    return audit.find_targets(v.questions, catalog)


GENERATED = f"""(SELECT entity, g, first, n, {_sql_list(generate.HISTORICAL)}[g % {len(generate.HISTORICAL)} + 1] AS th, {_sql_list(generate.AGGREGATION)}[g % {len(generate.AGGREGATION)} + 1] AS ta, {_sql_list(generate.BOOLEAN)}[g % {len(generate.BOOLEAN)} + 1] AS tb
  FROM (SELECT entity, first, n, row_number() OVER (ORDER BY n DESC, entity) - 1 AS g FROM (SELECT entity, arg_min(value, serial) AS first, count(DISTINCT value) AS n FROM parsed GROUP BY entity HAVING count(*) >= 2 AND count(DISTINCT value) >= 2)))"""


def filled(t: str, value: str) -> str:
    return f"replace(replace({t}, '{{entity}}', entity), '{{value}}', {value})"


@query(
    f"""SELECT entity, 'historical' AS intent, {filled('th', 'first')} AS question, first AS gold FROM {GENERATED} UNION ALL SELECT entity, 'aggregation', {filled('ta', 'first')}, n::VARCHAR FROM {GENERATED}
    UNION ALL SELECT entity, 'boolean', {filled('tb', "CASE WHEN g % 2 = 0 THEN first ELSE 'Nowhere' END")}, CASE WHEN g % 2 = 0 THEN 'True' ELSE 'False' END FROM {GENERATED}""",
    "parsed",
)
def benchmark_generate(v: View) -> DataFrame:
    return generate.benchmark(v.parsed)


def template_sql(families: dict[str, tuple[str, ...]]) -> str:
    cases = " ".join(f"WHEN family = '{k}' THEN {_sql_list(t)}[qid % 5 + 1]" for k, t in families.items())
    return f"SELECT qid, replace(replace(replace(CASE {cases} END, '{{prop}}', qp), '{{entity}}', entity), '{{target}}', coalesce(target, '')) AS rewritten FROM (SELECT *, CASE WHEN intent = 'historical' THEN 'historical' ELSE intent || (CASE WHEN qp = 'value' THEN '_generic' ELSE '_specific' END) END AS family FROM (SELECT *, {QUESTION_PROPERTY} AS qp FROM questions) WHERE intent <> 'current_value')"


@query(template_sql(generate.REWRITES), "questions")
def ood_rewrite(v: View) -> DataFrame:
    return generate.rewrite(v.questions, generate.REWRITES)


@query(template_sql(generate.PARAPHRASES), "questions")
def paraphrase_build(v: View) -> DataFrame:
    return generate.rewrite(v.questions, generate.PARAPHRASES)


PN_STATES = f"(SELECT entity, serial, value, nv, row_number() OVER (PARTITION BY entity ORDER BY serial DESC) AS place FROM (SELECT *, lag(nv) OVER (PARTITION BY entity ORDER BY serial DESC) AS last FROM (SELECT *, {pn('value')} AS nv FROM parsed) WHERE nv <> '') WHERE last IS NULL OR last <> nv)"


@query(
    f"""SELECT qid, rank, replace(replace(replace({_sql_list(generate.RANKED)}[qid % {len(generate.RANKED)} + 1], '{{prop}}', qp), '{{entity}}', entity), '{{rank}}', rank::VARCHAR) AS rewritten
    FROM (SELECT q.qid, q.entity, {QUESTION_PROPERTY} AS qp, min(place) AS rank FROM questions q JOIN {PN_STATES} s ON s.entity = q.entity AND s.nv = {pn('q.gold')} WHERE intent = 'historical' GROUP BY ALL)""",
    "questions", "parsed",
)
def paraphrase_rank(v: View) -> DataFrame:
    """Historical questions asked by the place of their gold answer among the entity's states."""
    states = history.timeline(v.parsed, "entity", norm=X.planner_normal(F.col("value")))
    return generate.rank_questions(v.questions, states)


@query(f"SELECT r.qid, q.target FROM ({template_sql(generate.PARAPHRASES)}) r JOIN questions q ON q.qid = r.qid WHERE q.intent = 'boolean'", "questions")
def target_recovery(v: View) -> DataFrame:
    """The targets of rewritten Boolean questions, from their wordings alone: what was put in comes out."""
    asked = generate.rewrite(v.questions, generate.PARAPHRASES).join(v.questions.where("intent = 'boolean'").select("qid", "entity", X.question_property(F.col("question")).alias("qp")), "qid")
    wordings = (*generate.PARAPHRASES["boolean_specific"], *generate.PARAPHRASES["boolean_generic"])
    return generate.recover_targets(asked.withColumnRenamed("rewritten", "question"), wordings)


@query("SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities, count(*) - count(DISTINCT (entity, intent, question)) AS n_repeated, count(*) FILTER (intent NOT IN ('historical', 'aggregation', 'boolean')) AS bad_intent, count(*) FILTER (intent = 'boolean' AND gold NOT IN ('True', 'False')) AS bad_boolean, count(*) FILTER (intent = 'aggregation' AND NOT regexp_full_match(gold, '\\d+')) AS bad_count, count(*) FILTER (trim(question) = '') AS empty FROM questions", "questions")
def dataset_validate(v: View) -> DataFrame:
    return audit.validate_dataset(v.questions)
