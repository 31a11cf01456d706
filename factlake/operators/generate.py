"""Benchmark questions and their rewrites from templates of this project's own wording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions.text import planner_normal, question_property
from factlake.operators import history, ranks

HISTORICAL = ("Which value did {entity} start with?", "Name the opening entry for {entity}.", "At the very start, what stood for {entity}?")
AGGREGATION = ("How many separate values does {entity} have?", "Give the size of the value set of {entity}.")
BOOLEAN = ("Did {entity} ever hold {value}?", "Is {value} on record for {entity}?")
REWRITES = {
    "historical": ("Going back to the start, which {prop} had {entity}?", "Which {prop} opens the record of {entity}?", "Find the oldest {prop} of {entity}.", "{entity} began with which {prop}?", "What {prop} came before all others for {entity}?"),
    "aggregation_specific": ("Over all time, how many kinds of {prop} for {entity}?", "Tally each {prop} of {entity} once.", "Number the different {prop} entries of {entity}.", "{entity}: how large is its set of {prop}?", "How often did {entity} get a new {prop}?"),
    "aggregation_generic": ("How many values in all for {entity}?", "Tally each value of {entity} once.", "Number all entries of {entity} that differ.", "{entity}: how large is its record of values?", "How often did {entity} get something new?"),
    "boolean_specific": ("Does any {prop} of {entity} read {target}?", "Is {target} a {prop} of {entity}?", "Look for {target} under {prop} of {entity}: found?", "{entity} with {prop} {target}: true?", "Can {target} be found as {prop} for {entity}?"),
    "boolean_generic": ("Does any entry of {entity} read {target}?", "Is {target} on file for {entity}?", "Look for {target} under {entity}: found?", "{entity} with {target}: true?", "Can {target} be found for {entity}?"),
}
PARAPHRASES = {
    "historical": ("Sort {entity} by age; which {prop} is last?", "Walk {entity} back to its end: which {prop}?", "Of the {prop} states of {entity}, give the deepest.", "Which {prop} lies at the bottom of {entity}?", "Read {entity} in reverse and report the final {prop}."),
    "aggregation_specific": ("Size of the {prop} set of {entity}?", "Unique {prop} entries for {entity}: how many?", "{prop} variety of {entity} as a number?", "How many {prop} values survive merging for {entity}?", "Give {entity}'s {prop} cardinality."),
    "aggregation_generic": ("Size of the value set of {entity}?", "Unique entries for {entity}: how many?", "Variety of {entity} as a number?", "How many values survive merging for {entity}?", "Give {entity}'s cardinality."),
    "boolean_specific": ("Among {prop} records of {entity}, is {target} present?", "Does a {prop} line of {entity} name {target}?", "Match {target} to {prop} of {entity}: any?", "{target}, {prop}, {entity}: linked?", "Is the {prop} {target} tied to {entity}?"),
    "boolean_generic": ("Among records of {entity}, is {target} present?", "Does a line of {entity} name {target}?", "Match {target} to {entity}: any?", "{target}, {entity}: linked?", "Is {target} tied to {entity}?"),
}


def _pick(templates: tuple[str, ...], index):
    return F.element_at(F.array(*[F.lit(t) for t in templates]), (index % len(templates) + 1).cast("int"))


def _fill(text, **values):
    for k, v in values.items():
        text = F.replace(text, F.lit(f"{{{k}}}"), v)
    return text


def benchmark(facts: DataFrame) -> DataFrame:
    """(entity, intent, question, gold): three questions for every conflicting entity.

    Templates go round by the entity's place among the most conflicting ones; Booleans
    are true and false in turn, false ones about a value nobody has.
    """
    known = history.conflicting(facts, "entity").join(history.earliest(facts, "entity"), "entity")
    g = ranks.numbered(known.select("entity", "value", "n_distinct"), F.desc("n_distinct"), "entity", name="g")
    true = F.col("g") % 2 == 0
    rows = [
        F.struct(F.lit("historical").alias("intent"), _fill(_pick(HISTORICAL, F.col("g")), entity=F.col("entity"), value=F.col("value")).alias("question"), F.col("value").alias("gold")),
        F.struct(F.lit("aggregation").alias("intent"), _fill(_pick(AGGREGATION, F.col("g")), entity=F.col("entity"), value=F.col("value")).alias("question"), F.col("n_distinct").cast("string").alias("gold")),
        F.struct(F.lit("boolean").alias("intent"), _fill(_pick(BOOLEAN, F.col("g")), entity=F.col("entity"), value=F.when(true, F.col("value")).otherwise("Nowhere")).alias("question"), F.when(true, "True").otherwise("False").alias("gold")),
    ]
    return g.select("entity", F.explode(F.array(*rows)).alias("r")).select("entity", "r.*")


def rewrite(questions: DataFrame, families: dict[str, tuple[str, ...]]) -> DataFrame:
    """(qid, rewritten): questions in other words, by intent and whether a property is named."""
    q = questions.where("intent <> 'current_value'").withColumn("qp", question_property(F.col("question")))
    family = F.when(F.col("intent") == "historical", "historical").otherwise(F.concat("intent", F.when(F.col("qp") == "value", "_generic").otherwise("_specific")))
    text = F.coalesce(*[F.when(family == k, _pick(t, F.col("qid"))) for k, t in families.items()])
    return q.select("qid", _fill(text, prop=F.col("qp"), entity=F.col("entity"), target=F.coalesce("target", F.lit(""))).alias("rewritten"))


#: How a question asks for a state by its place, the newest being the first.
RANKED = ("Newest to oldest, which {prop} of {entity} is at place {rank}?", "Count {entity}'s {prop} states back from today; name state {rank}.", "Which {prop} holds place {rank} in the reversed record of {entity}?")


def rank_questions(questions: DataFrame, states: DataFrame) -> DataFrame:
    """(qid, rewritten, rank): historical questions asked by the place of their gold answer.

    ``states`` has (entity, state, value) from new to old; the newest state whose normal form is
    the gold's counts. Questions whose gold is no state are left out.
    """
    q = questions.where("intent = 'historical'").select("qid", "entity", question_property(F.col("question")).alias("qp"), planner_normal(F.col("gold")).alias("__g"))
    s = states.select("entity", "state", planner_normal(F.col("value")).alias("__g"))
    places = q.join(s, ["entity", "__g"]).groupBy("qid", "entity", "qp").agg((F.min("state") + 1).alias("rank"))
    return places.select("qid", _fill(_pick(RANKED, F.col("qid")), prop=F.col("qp"), entity=F.col("entity"), rank=F.col("rank").cast("string")).alias("rewritten"), "rank")


def recover_targets(questions: DataFrame, wordings: tuple[str, ...]) -> DataFrame:
    """(qid, target) from questions (qid, question, entity, qp) in any of the fixed wordings; null where none fits.

    A wording's words before and behind the target are filled with the row's own entity and property;
    of several that fit, the one with the most fixed text counts.
    """
    found = []
    for wording in wordings:
        before, _, behind = wording.partition("{target}")
        a, b = (_fill(F.lit(x), prop=F.col("qp"), entity=F.col("entity")) for x in (before, behind))
        q, fixed = F.col("question"), F.length(a) + F.length(b)
        target = F.substring(q, F.length(a) + 1, F.length(q) - fixed)
        found.append(F.when(q.startswith(a) & q.endswith(b) & (F.length(q) > fixed), F.struct(fixed.alias("fixed"), target.alias("target"))))
    return questions.select("qid", F.array_max(F.array_compact(F.array(*found)))["target"].alias("target"))
