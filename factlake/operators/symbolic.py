"""The symbolic operators of the router path and of the planner path, in bulk.

Candidates are rows (qid, serial, ord, fact_text, answer_entity) beside one row per
question; each operator is one aggregation by qid. Planner operators abstain with a
status where the retrieved history is not provably complete; router operators never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.text import asks_count, asks_ever, canonical_property, case, holds, mentions, names_relation, native_count, negated, normal, parse_fact, planner_normal, planner_property, python_json, temporal_cue, temporal_offset


def gate(question: Column, answer: Column, fact: Column) -> Column:
    """Router Boolean gate on one candidate."""
    hit = mentions(question, answer) | mentions(question, fact)
    return F.when(negated(question), ~hit).otherwise(hit)


def _freshest(columns: list[str]) -> Column:
    return F.max(F.struct("serial", (-F.col("ord")).alias("o"), *columns))


def historical_native(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, answer, serial): oldest, or the state at the question's offset, clamped."""
    q = questions.select("qid", temporal_offset(F.col("question")).alias("k"))
    c = candidates.withColumn("__n", normal(F.col("answer_entity")))
    newest = Window.partitionBy("qid").orderBy(F.desc("serial"), "ord")
    kept = c.where("__n <> ''").withColumn("__l", F.lag("__n").over(newest)).where("__l is null or __l <> __n")
    states = kept.withColumn("state", F.row_number().over(newest) - 1).select("qid", "state", "serial", "answer_entity")
    near = states.join(q, "qid").where("k is not null and state <= k").groupBy("qid").agg(F.max(F.struct("state", "answer_entity", "serial")).alias("b"))
    old = c.groupBy("qid").agg(F.min(F.struct("serial", "ord", "answer_entity")).alias("a"))
    out = q.join(old, "qid", "left").join(near, "qid", "left")
    pick = lambda f: F.when(F.col("k").isNull(), F.col(f"a.{f}")).otherwise(F.col(f"b.{f}"))
    return out.select("qid", F.coalesce(pick("answer_entity"), F.lit("(no answer)")).alias("answer"), pick("serial").alias("serial"))


def boolean_native(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, answer): any candidate for "ever" questions, else the freshest one."""
    # the question's normal form and cues once a question, the two of a candidate once a candidate
    q = questions.select("qid", normal(F.col("question")).alias("__q"), negated(F.col("question")).alias("__not"))
    c = candidates.withColumns({"__a": normal(F.col("answer_entity")), "__f": normal(F.col("fact_text"))}).join(q, "qid")
    hit = holds(F.col("__q"), F.col("__a")) | holds(F.col("__q"), F.col("__f"))
    c = c.withColumn("g", F.when(F.col("__not"), ~hit).otherwise(hit))
    one = c.groupBy("qid").agg(F.bool_or("g").alias("some"), _freshest(["g"]).alias("f"))
    answer = F.coalesce(F.when(asks_ever(F.col("question")), F.col("some")).otherwise(F.col("f.g")), F.lit(False))
    return questions.select("qid", "question").join(one, "qid", "left").select("qid", answer.alias("answer"))


def aggregate_native(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, answer): the count of distinct values, or the list as JSON text."""
    a = F.trim("answer_entity")
    n = candidates.withColumn("__a", a).withColumn("__n", normal(a)).where("__a <> '' and __n <> ''")
    first = n.groupBy("qid", "__n").agg(F.min(F.struct("serial", "ord", "__a")).alias("f"))
    values = first.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["__a"]).alias("v"))
    v = F.coalesce("v", F.array().cast("array<string>"))
    return questions.select("qid", "question").join(values, "qid", "left").select("qid", F.when(native_count(F.col("question")), F.size(v).cast("string")).otherwise(python_json(v)).alias("answer"))


PLAN = ["intent", "entity", "property_scope", "property_name", "temporal_scope", "ordinal_offset", "aggregation_mode", "boolean_target", "negated", "supported", "reason"]


def override(plans: DataFrame) -> DataFrame:
    """Rewrites plan columns by the question's own words (``question``)."""
    q = F.col("question")
    relation, count, cue = names_relation(q), asks_count(q), temporal_cue(q)
    p = plans.withColumns({"__r": relation, "__c": count, "__t": cue})
    timed = ~F.col("__c") & F.col("__t").isNotNull()
    new = {
        "property_scope": F.when(~F.col("__r"), "entity_wide_values").otherwise(F.col("property_scope")),
        "property_name": F.when(F.col("__r"), F.col("property_name")),
        "intent": F.when(F.col("__c"), "aggregation").when(timed, "historical").otherwise(F.col("intent")),
        "temporal_scope": F.when(F.col("__c"), "unspecified").when(timed, F.col("__t")).otherwise(F.col("temporal_scope")),
        "ordinal_offset": F.when(F.col("__c"), F.lit(None)).when(timed, F.when(F.col("__t") == "earliest", 0)).otherwise(F.col("ordinal_offset")),
        "aggregation_mode": F.when(F.col("__c"), "count").when(timed, "none").otherwise(F.col("aggregation_mode")),
    }
    return p.withColumns(new).drop("__r", "__c", "__t")


def in_scope(scope: Column, wanted: Column, fact_property: Column) -> Column:
    """Whether a fact's property is inside a plan's scope; ambiguous scopes have none."""
    return holds_scope(scope, canonical_property(wanted), canonical_property(fact_property))


def holds_scope(scope: Column, wanted: Column, own: Column) -> Column:
    """``in_scope`` of canonical properties."""
    return case([(scope == "entity_wide_values", True), (scope == "specific", F.coalesce(own == wanted, F.lit(False)))], False)


def parsed_facts(facts: DataFrame, text: str = "text") -> DataFrame:
    """Adds what the planner reads in each fact: subject, answer_entity, fact_property, and both in normal form.

    Called on the facts before they meet questions, each is parsed once however many ask for it.
    """
    subject, value = parse_fact(F.col(text))
    return facts.withColumns({"subject": subject, "answer_entity": value, "fact_property": planner_property(F.col(text))}).withColumns({"fact_normal": planner_normal(F.col("answer_entity")), "fact_scope": canonical_property(F.col("fact_property"))})


PARSED = ("subject", "answer_entity", "fact_property", "fact_normal", "fact_scope")


def about(plans: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The facts retrieved for each supported plan whose subject is its entity, beside the plan's scope."""
    r = retrieved if set(PARSED) <= set(retrieved.columns) else parsed_facts(retrieved)
    r = r.select("qid", "ord", "serial", F.col("text").alias("fact_text"), *PARSED)
    p = plans.where("supported and entity is not null and entity <> ''").withColumn("__wanted", canonical_property(F.col("property_name")))
    return r.join(p, "qid").where((F.col("subject") == F.col("entity")) & (F.col("answer_entity") != ""))


def deterministic_candidates(plans: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Exact subject and property facts of each plan, one per (serial, text).

    ``retrieved`` has (qid, ord, serial, text), and what ``parsed_facts`` adds if that is
    done already. Adds (answer_entity, fact_property).
    """
    hit = about(plans.select("qid", "entity", "property_scope", "property_name", "supported"), retrieved)
    hit = hit.where(holds_scope(F.col("property_scope"), F.col("__wanted"), F.col("fact_scope")))
    return hit.groupBy("qid", "serial", "fact_text").agg(F.min("ord").alias("ord"), F.first("answer_entity").alias("answer_entity"), F.first("fact_property").alias("fact_property"))


def history_complete(plans: DataFrame, retrieved: DataFrame, entity_counts: DataFrame, property_counts: DataFrame | None = None) -> DataFrame:
    """(qid, complete): retrieved serials in scope against the corpus's count.

    ``entity_counts`` is (entity, n); ``property_counts`` (entity, property, n) governs
    specific scopes where given. Boolean plans are checked for the whole entity.
    """
    whole = F.col("intent") == "boolean"
    wide = plans.withColumns({"__scope": F.col("property_scope"), "property_scope": F.when(whole, "entity_wide_values").otherwise(F.col("property_scope"))})
    # entity-wide candidates exist for unsupported plans too as far as the count goes
    found = deterministic_candidates(wide, retrieved).groupBy("qid").agg(F.count_distinct("serial").alias("got"))
    return expected_met(wide.join(found, "qid", "left"), entity_counts, property_counts).select("qid", "complete")


def expected_met(plans: DataFrame, entity_counts: DataFrame, property_counts: DataFrame | None) -> DataFrame:
    """Adds ``complete``: whether ``got`` serials are all that the corpus has in the scope."""
    whole = F.col("intent") == "boolean"
    out = plans.join(entity_counts.select("entity", F.col("n").alias("__n")), "entity", "left")
    expected = F.col("__n")
    if property_counts is not None:
        out = out.withColumn("__p", F.coalesce(canonical_property(F.col("property_name")), F.lit("value"))).join(property_counts.select("entity", F.col("property").alias("__p"), F.col("n").alias("__m")), ["entity", "__p"], "left")
        expected = F.when(~whole & (F.col("property_scope") == "specific"), F.when(F.col("__n").isNotNull(), F.col("__m"))).otherwise(F.col("__n"))
    return out.withColumn("complete", F.coalesce(F.coalesce("got", F.lit(0)) == expected, F.lit(False)))


def _result(status: str, reason: str | None = None, **answer: Column) -> Column:
    kinds = {"answer_text": "string", "answer_int": "long", "answer_bool": "boolean", "answer_list": "array<string>", "serial": "long"}
    fields = [answer.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()]
    return F.struct(*fields, F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))


FACT = ("serial", "ord", "answer_entity", "fact_normal", "fact_text")


def with_history(j: DataFrame) -> DataFrame:
    """Adds what plans ask of ``__facts``, a sorted array of distinct facts: ends, collapsed states, distinct values.

    Arrays that a lambda looks into are columns of their own, so that they are made once a row.
    """
    facts = F.col("__facts")
    j = j.withColumn("__named", F.filter(facts, lambda x: x["fact_normal"] != ""))
    j = j.withColumns({"__down": F.reverse("__named"), "norms": F.transform("__named", lambda x: x["fact_normal"])})
    return j.withColumns({
        "n_facts": F.size(facts),
        "newest": F.array_max(F.transform(facts, lambda x: F.struct(x["serial"], (-x["ord"]).alias("o"), x["answer_entity"]))),
        "last": F.get(F.reverse(facts), F.lit(0)),
        "oldest": F.get(facts, F.lit(0)),
        "states": F.filter("__down", lambda x, i: (i == 0) | (F.get("__down", i - 1)["fact_normal"] != x["fact_normal"])),
        "vals": F.transform(F.filter("__named", lambda x, i: F.array_position("norms", x["fact_normal"]) == i + 1), lambda x: x["answer_entity"]),
    })


def execute(plans: DataFrame, candidates: DataFrame) -> DataFrame:
    """Runs plans (with ``complete``) over their candidates: (qid, answers, status, reason).

    The order of the abstentions: unsupported, ambiguous, no candidates (unless Boolean
    and complete), then what the intent asks for. A plan's candidates, no more than
    retrieval hands to a question, are gathered once into one sorted array.
    """
    c = candidates.withColumn("fact_normal", planner_normal(F.col("answer_entity")))
    return answers(plans.join(c.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*FACT))).alias("__facts")), "qid", "left")).drop("intent", "complete")


def answers(j: DataFrame) -> DataFrame:
    """(qid, intent, complete, answers, status, reason) of plans beside their sorted ``__facts``."""
    j = j.withColumn("__facts", F.coalesce("__facts", F.array().cast(j.schema["__facts"].dataType)))
    j = with_history(j)
    intent, scope, complete = F.col("intent"), F.col("temporal_scope"), F.col("complete")
    k = F.when(scope == "previous", 1).otherwise(F.col("ordinal_offset"))
    prior = F.get("states", k)
    vals = F.col("vals")
    target = planner_normal(F.col("boolean_target"))
    match = F.coalesce(F.array_contains("norms", target), F.lit(False))
    none = F.col("n_facts") == 0
    out = case(
        [
            (~F.col("supported"), _result("unsupported", "plan unsupported")),
            (F.col("property_scope") == "ambiguous", _result("unsupported", "ambiguous property scope")),
            (none & ~((intent == "boolean") & complete), _result("insufficient_evidence", "no validated subject/property candidates")),
            ((intent == "current_value") & ~complete, _result("insufficient_evidence", "latest value requires complete history")),
            (intent == "current_value", _result("answered", answer_text=F.col("newest.answer_entity"))),
            ((intent == "historical") & ~complete, _result("insufficient_history", "temporal selection requires complete history")),
            ((intent == "historical") & (scope == "latest"), _result("answered", answer_text=F.col("last.answer_entity"), serial=F.col("last.serial"))),
            ((intent == "historical") & scope.isin("earliest", "unspecified"), _result("answered", answer_text=F.col("oldest.answer_entity"), serial=F.col("oldest.serial"))),
            ((intent == "historical") & F.coalesce((k < 1) | (k >= F.size("states")), F.lit(True)), _result("insufficient_history", "requested prior state is unavailable")),
            (intent == "historical", _result("answered", answer_text=prior["answer_entity"], serial=prior["serial"])),
            ((intent == "aggregation") & ~complete, _result("insufficient_evidence", "aggregation requires complete history")),
            ((intent == "aggregation") & (F.col("aggregation_mode") == "count"), _result("answered", answer_int=F.size(vals), answer_list=vals)),
            (intent == "aggregation", _result("answered", answer_list=vals)),
            ((intent == "boolean") & (F.coalesce(F.col("boolean_target"), F.lit("")) == ""), _result("unsupported", "boolean plan unsupported")),
            ((intent == "boolean") & match, _result("answered", answer_bool=~F.col("negated"))),
            ((intent == "boolean") & ~complete, _result("insufficient_evidence", "absence cannot be established from partial retrieval")),
            (intent == "boolean", _result("answered", answer_bool=F.col("negated"))),
        ],
        _result("unsupported", "unhandled intent"),
    )
    return j.select("qid", "intent", "complete", out.alias("r")).select("qid", "intent", "complete", "r.*")


def execute_final(plans: DataFrame, retrieved: DataFrame, entity_counts: DataFrame, property_counts: DataFrame | None = None) -> DataFrame:
    """Overrides plans by their questions, then runs them over the retrieved facts.

    A Boolean plan with an entity and a target looks at the whole entity, supported or
    not and whatever its scope.
    """
    p = override(plans)
    whole = (F.col("intent") == "boolean") & (F.coalesce("entity", F.lit("")) != "") & (F.coalesce("boolean_target", F.lit("")) != "")
    p = p.withColumns({"property_scope": F.when(whole, "entity_wide_values").otherwise(F.col("property_scope")), "property_name": F.when(whole, F.lit(None)).otherwise(F.col("property_name")), "supported": whole | F.col("supported")})
    wide = F.when(F.col("intent") == "boolean", "entity_wide_values").otherwise(F.col("property_scope"))
    fact = F.struct(*FACT)
    hit = about(p.select("qid", "entity", "property_scope", "property_name", "supported", wide.alias("__wide")), retrieved)
    own, all_ = (holds_scope(F.col(c), F.col("__wanted"), F.col("fact_scope")) for c in ("property_scope", "__wide"))
    # one exchange: a plan's candidates, and the serials that its completeness counts, each no more than retrieval hands out
    got = hit.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(own, fact))).alias("__facts"), F.size(F.collect_set(F.when(all_, F.col("serial")))).alias("got"))
    first = F.filter("__facts", lambda x, i: ~F.exists(F.slice(F.col("__facts"), 1, i), lambda y: (y["serial"] == x["serial"]) & (y["fact_text"] == x["fact_text"])))
    j = p.join(got.withColumn("__facts", first), "qid", "left")
    narrow = j.withColumns({"__scope": F.col("property_scope"), "property_scope": wide})
    done = expected_met(narrow, entity_counts, property_counts).withColumn("property_scope", F.col("__scope"))
    return answers(done)


def rendered(result_columns: dict[str, str] | None = None) -> Column:
    """One text for any kind of answer."""
    return F.coalesce(F.col("answer_text"), F.col("answer_int").cast("string"), F.when(F.col("answer_bool"), "True").when(~F.col("answer_bool"), "False"), python_json(F.col("answer_list")))
