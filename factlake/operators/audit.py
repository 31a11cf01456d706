"""Accuracy summaries and audits of gold answers, targets and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.text import case, planner_normal, question_property

#: Catalog values that are sent to every task; more of them are joined by shuffling.
MOST_VALUES = 100_000


def share(part: Column, whole: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.round(F.try_divide(part, whole), 6)


def accuracy(scored: DataFrame, *by: str) -> DataFrame:
    """n, n_correct, accuracy, answered and accuracy among the answered."""
    right, said = F.col("correct"), F.col("answer").isNotNull()
    n, c, a, ca = F.count("*"), F.count_if(right), F.count("answer"), F.count_if(right & said)
    return scored.groupBy(*by).agg(n.alias("n"), c.alias("n_correct"), share(c, n).alias("accuracy"), a.alias("answered"), share(ca, a).alias("accuracy_when_answered"))


def grouped_accuracy(scored: DataFrame) -> DataFrame:
    """Arm by intent and overall, all rows and verified ones, in one pass of grouping sets."""
    right, ok = F.col("correct"), F.col("verified")
    g = scored.groupingSets([[F.col("arm"), F.col("intent")], [F.col("arm")]], "arm", "intent")
    n, c, v, cv = F.count("*"), F.count_if(right), F.count_if(ok), F.count_if(ok & right)
    out = g.agg(n.alias("n"), c.alias("n_correct"), share(c, n).alias("accuracy"), v.alias("n_verified"), share(cv, v).alias("accuracy_verified"))
    return out.withColumn("intent", F.coalesce("intent", F.lit("overall")))


def failure_category() -> Column:
    """First matching category of a saved result (intent, route, answer, gold, correct)."""
    answer, gold, intent = F.col("answer"), F.col("gold"), F.col("intent")
    numbers = F.trim(answer).rlike(r"^\d+$") & F.trim(gold).rlike(r"^\d+$")
    less = F.trim(answer).try_cast("long") < F.trim(gold).try_cast("long")
    return case(
        [
            (answer.startswith("<error:"), "execution_error"),
            ((F.col("route") != intent) & F.col("correct"), "correct"),
            (F.col("route") != intent, "misroute"),
            (F.col("correct"), "correct"),
            (answer == "(no answer)", "no_answer"),
            ((intent == "aggregation") & numbers & less, "aggregation_undercount"),
            ((intent == "aggregation") & numbers, "aggregation_overcount"),
            (intent == "boolean", "boolean_mismatch"),
            (intent == "historical", "historical_answer_mismatch"),
        ],
        "other_answer_mismatch",
    )


def gold_audit(questions: DataFrame, parsed: DataFrame) -> DataFrame:
    """(qid, n_support, status, issue_codes): each gold answer against the parsed facts.

    Facts are those of the question's property, or all of the entity where the question
    names none.
    """
    q = questions.withColumn("qp", question_property(F.col("question"))).withColumn("__norm", planner_normal(F.col("target")))
    # a row for each distinct value first, which then counts for its property and for the whole entity ("value")
    values = parsed.groupBy("entity", "property", "value").agg(F.count("*").alias("n"), F.min(F.struct("serial", "ord", "value")).alias("first"))
    scoped = values.withColumn("__norm", planner_normal(F.col("value"))).withColumn("qp", F.explode(F.array_distinct(F.array("property", F.lit("value")))))
    own = scoped.groupBy("entity", "qp").agg(F.sum("n").alias("n_support"), F.min("first").alias("first"), F.count_distinct("value").alias("raw"), F.count_distinct("__norm").alias("norms"))
    seen = scoped.select("entity", "qp", "__norm").distinct().withColumn("seen", F.lit(True))
    every = parsed.groupBy("entity").agg(F.count("*").alias("n_entity"))
    j = q.join(own, ["entity", "qp"], "left").join(seen, ["entity", "qp", "__norm"], "left").join(every, "entity", "left").na.fill(0, ["n_entity", "n_support"])
    intent, gold = F.col("intent"), F.col("gold")
    count = gold.try_cast("long")
    none = F.col("n_support") == 0
    wrong = {
        "entity_not_found": F.col("n_entity") == 0,
        "no_facts_for_property": none & intent.isin("historical", "aggregation"),
        "historical_gold_differs": (intent == "historical") & ~none & (planner_normal(F.col("first.value")) != planner_normal(gold)),
        "aggregation_gold_not_integer": (intent == "aggregation") & count.isNull(),
        "aggregation_gold_differs": (intent == "aggregation") & ~none & (count != F.col("raw")),
        "normalization_changes_count": (intent == "aggregation") & (F.col("raw") != F.col("norms")),
        "boolean_label_disagrees": (intent == "boolean") & (F.coalesce("seen", F.lit(False)) != (F.lower(F.trim(gold)) == "true")),
        "unknown_intent": ~intent.isin("historical", "aggregation", "boolean"),
    }
    codes = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in wrong.items()]))
    bad = F.arrays_overlap("issue_codes", F.array(*map(F.lit, ("historical_gold_differs", "aggregation_gold_not_integer", "aggregation_gold_differs", "boolean_label_disagrees"))))
    open_ = F.arrays_overlap("issue_codes", F.array(*map(F.lit, ("entity_not_found", "no_facts_for_property", "unknown_intent"))))
    return j.withColumn("issue_codes", codes).select("qid", "n_support", F.when(open_, "unresolved").when(bad, "invalid").otherwise("verified").alias("status"), "issue_codes")


def find_targets(questions: DataFrame, catalog: DataFrame, value: str = "v") -> DataFrame:
    """(qid, target, status): the one longest catalog value inside each question.

    Runs of words meet values by an equi-join, in the lengths that the catalog has (a row
    each), so words that many values share make no more rows. A question without a value is a row
    of its own in the one aggregation by qid: no table of questions is joined or broadcast.
    """
    norm = planner_normal
    c = catalog.select(F.col(value).alias("v"), norm(F.col(value)).alias("vn")).where(F.length("vn") >= 3)
    lengths = sorted(r[0] for r in c.select(F.size(F.split("vn", " ")).alias("n")).distinct().collect())
    q = questions.select("qid", F.split(norm(F.col("question")), " ").alias("qw"), norm(F.col("entity")).alias("en"))

    def runs(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size("qw") - n + 1), lambda i: F.array_join(F.slice("qw", i, F.lit(n)), " "))
        return F.when(F.size("qw") >= n, each).otherwise(F.array())

    words = q.select("qid", "en", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *map(runs, lengths)))).alias("vn"))
    few = c.count() <= MOST_VALUES
    hit = words.where(F.col("vn") != F.col("en")).join(F.broadcast(c) if few else c.hint("shuffle_merge"), "vn").select("qid", F.length("vn").alias("l"), "v")
    rows = hit.unionByName(questions.select("qid", F.lit(0).alias("l"), F.lit(None).cast("string").alias("v")))
    same = rows.groupBy("qid", "l").agg(F.count_distinct("v").alias("k"), F.min("v").alias("v"))
    j = same.groupBy("qid").agg(F.max(F.struct("l", "k", "v")).alias("b"))
    k = F.col("b.k")
    return j.select("qid", F.when(k == 1, F.col("b.v")).alias("target"), F.when(k == 0, "not_found").when(k == 1, "matched_catalog").otherwise("multiple_equal_length_matches").alias("status"))


def validate_dataset(rows: DataFrame) -> DataFrame:
    """One row of counts that are zero for a sound benchmark, besides the sizes."""
    intent, gold = F.col("intent"), F.col("gold")
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("entity").alias("n_entities"),
        (F.count("*") - F.count_distinct("entity", "intent", "question")).alias("n_repeated"),
        F.count_if(~intent.isin("historical", "aggregation", "boolean")).alias("bad_intent"),
        F.count_if((intent == "boolean") & ~gold.isin("True", "False")).alias("bad_boolean"),
        F.count_if((intent == "aggregation") & ~gold.rlike(r"^\d+$")).alias("bad_count"),
        F.count_if(F.trim("question") == "").alias("empty"),
    )
