"""Adapter views: fact logs, fact texts, questions and ledgers over the driver's tables.

``View(spark, sf_dir)`` builds them as DataFrames; ``CTE`` has the same views as SQL,
to be put before an oracle query by ``with_views``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.operators import symbolic
from factlake.operators.layout import spread

#: Question templates; {e} is an entity, {v} a value, {p} a property noun.
TEMPLATES = (
    "What was the first {p} recorded for {e}?",
    "How many distinct values were recorded for {e}?",
    "Was {v} ever a {p} for {e}?",
    "What was the previous {p} of {e} before the current one?",
    "What is the current {p} of {e}?",
    "Is {e} not associated with {v}?",
    "List all genres for {e}",
    "What was the third previous value for {e} before any updates?",
    "Of several countries, is {v} the latest value for {e}?",
    "Give me the total number of unique values for {e} in the census",
    "In the oldest record, before the debut, what was {e}?",
    "Has {e} never had the value {v} at any juncture?",
)
INTENTS = ("historical", "aggregation", "boolean", "historical", "current_value", "boolean", "aggregation", "historical", "boolean", "aggregation", "historical", "boolean")
NOUNS = ("genre", "creator", "country")
#: Facts that retrieval returns for a question; some entities have more, so some histories are incomplete.
RETRIEVED = 40
#: Parts that share their names as entities: entities grow with the table, their histories don't.
PARTS = 800
ENTITY = f"(p_name || ' ' || (p_partkey // {PARTS}))"


class View:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def part(self) -> DataFrame:
        """The part table with an entity for each part."""
        return spread(self.table("part")).withColumn("entity", F.concat("p_name", F.lit(" "), F.floor(F.col("p_partkey") / PARTS).cast("long").cast("string")))

    @cached_property
    def fact_log(self) -> DataFrame:
        """One row per event: entity, value, serial, ord."""
        e = self.table("events")
        return e.select(F.col("user_id").alias("entity"), F.col("event_type").alias("value"), F.col("event_id").alias("serial"), F.col("event_id").alias("ord"))

    @cached_property
    def fact_log_multi(self) -> DataFrame:
        """Two properties per order, stacked."""
        o = self.table("orders")
        pair = F.explode(F.array(F.struct(F.lit("status").alias("property"), F.col("o_orderstatus").alias("value"), (2 * F.col("o_orderkey")).alias("serial")), F.struct(F.lit("priority").alias("property"), F.col("o_orderpriority").alias("value"), (2 * F.col("o_orderkey") + 1).alias("serial"))))
        return o.select(F.col("o_custkey").alias("entity"), pair.alias("x")).select("entity", "x.property", "x.value", "x.serial", F.col("x.serial").alias("ord"))

    @cached_property
    def fact_text(self) -> DataFrame:
        """Two sentences per part: (serial, ord, text)."""
        p = self.part
        pair = F.explode(F.array(
            F.struct((2 * F.col("p_partkey")).alias("serial"), F.concat("entity", F.lit(" was manufactured by "), "p_brand").alias("text")),
            F.struct((2 * F.col("p_partkey") + 1).alias("serial"), F.concat("entity", F.lit(" has the genre of "), "p_type").alias("text")),
        ))
        return p.select(pair.alias("x")).select("x.serial", F.col("x.serial").alias("ord"), "x.text")

    @cached_property
    def parsed(self) -> DataFrame:
        """fact_text by its columns: entity, property, value, serial, ord."""
        p = self.part
        pair = F.explode(F.array(F.struct((2 * F.col("p_partkey")).alias("serial"), F.lit("value").alias("property"), F.col("p_brand").alias("value")), F.struct((2 * F.col("p_partkey") + 1).alias("serial"), F.lit("genre").alias("property"), F.col("p_type").alias("value"))))
        return p.select("entity", pair.alias("x")).select("entity", "x.property", "x.value", "x.serial", F.col("x.serial").alias("ord"))

    @cached_property
    def contexts(self) -> DataFrame:
        """A numbered context per part: a heading with a number inside, then two facts."""
        p = self.part
        text = F.concat(F.lit("Part U2. head "), F.col("p_size").cast("string"), F.lit(". x\n"), F.col("p_partkey").cast("string"), F.lit(". "), "entity", F.lit(" was manufactured by "), "p_brand", F.lit(".\n "), (F.col("p_partkey") + 1).cast("string"), F.lit(". "), "entity", F.lit(" has the genre of "), "p_type", F.lit("..\n"), F.col("p_partkey").cast("string"), F.lit(". again"))
        return p.select(F.col("p_partkey").alias("doc"), text.alias("context"))

    @cached_property
    def questions(self) -> DataFrame:
        """A question per part: qid, question, intent, entity, property, target, gold."""
        p = self.part
        t = (F.col("p_partkey") % len(TEMPLATES)).cast("int")
        noun = F.element_at(F.array(*[F.lit(n) for n in NOUNS]), (F.col("p_partkey") % len(NOUNS)).cast("int") + 1)
        text = F.element_at(F.array(*[F.lit(x) for x in TEMPLATES]), t + 1)
        for k, v in (("{e}", F.col("entity")), ("{v}", F.col("p_brand")), ("{p}", noun)):
            text = F.replace(text, F.lit(k), v)
        intent = F.element_at(F.array(*[F.lit(x) for x in INTENTS]), t + 1)
        gold = F.when(intent == "aggregation", F.col("p_size").cast("string")).when(intent == "boolean", F.when(F.col("p_size") % 2 == 0, "True").otherwise("False")).otherwise(F.col("p_brand"))
        return p.select(F.col("p_partkey").alias("qid"), text.alias("question"), intent.alias("intent"), "entity", noun.alias("property"), F.col("p_brand").alias("target"), gold.alias("gold"))

    @cached_property
    def candidates(self) -> DataFrame:
        """What retrieval hands to each question: its entity's ``RETRIEVED`` newest facts."""
        return self.questions.select("qid", "entity").join(self.newest, "entity").drop("entity")

    @cached_property
    def retrieved(self) -> DataFrame:
        """The same facts as texts, each parsed once before it meets its questions."""
        facts = newest_of(symbolic.parsed_facts(self.facts.select("entity", "ord", "serial", F.col("fact_text").alias("text"))))
        return self.questions.select("qid", "entity").join(facts, "entity").drop("entity")

    @cached_property
    def newest(self) -> DataFrame:
        """The ``RETRIEVED`` newest facts of every entity."""
        return newest_of(self.facts)

    @cached_property
    def facts(self) -> DataFrame:
        """Every fact beside its sentence."""
        text = F.concat("entity", F.when(F.col("property") == "genre", " has the genre of ").otherwise(" was manufactured by "), "value")
        return self.parsed.select("entity", "serial", "ord", text.alias("fact_text"), F.col("value").alias("answer_entity"))

    @cached_property
    def plans(self) -> DataFrame:
        """A plan per question; some are unsupported, negated or ordinal."""
        q = self.questions
        i = F.col("qid") % 12
        return q.select(
            "qid", "question", "intent", "entity",
            F.when(i == 4, "specific").when(i == 6, "specific").when((i == 9) & (F.col("qid") % 5 == 0), "ambiguous").otherwise("entity_wide_values").alias("property_scope"),
            F.when(i.isin(4, 6), "genre").alias("property_name"),
            F.when(i == 3, "previous").when(i == 7, "ordinal").when(i == 10, "latest").when(i == 0, "earliest").otherwise("unspecified").alias("temporal_scope"),
            F.when(i == 7, F.lit(2)).alias("ordinal_offset"),
            F.when(i.isin(1, 9), "count").when(i == 6, "list").otherwise("none").alias("aggregation_mode"),
            F.when(F.col("intent") == "boolean", F.col("target")).alias("boolean_target"),
            i.isin(5, 11).alias("negated"),
            (F.col("qid") % 17 != 0).alias("supported"),
            F.lit("").alias("reason"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Answers of two arms per question, from the order table: ids, arm, answer, gold, correct.

        Orders are dealt over all questions, and to the arms by the round of dealing.
        """
        o, parts = self.table("orders"), max(1, self.table("part").count())
        q = self.questions.withColumnRenamed("qid", "k")
        key = F.col("o_orderkey")
        base = o.select(key.alias("row_id"), (key % parts).alias("k"), F.when(F.floor(key / parts) % 2 == 0, "a").otherwise("b").alias("arm"), "o_orderstatus", "o_totalprice")
        j = base.join(q.select("k", "intent", "gold"), "k")
        answer = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Final answer: "), "gold")).when(F.col("o_orderstatus") == "O", F.lit(None).cast("string")).otherwise(F.concat(F.lit("no idea 1,0"), F.col("k").cast("string")))
        return j.select("row_id", F.col("k").alias("qid"), "arm", "intent", "gold", answer.alias("answer"), (F.col("k") % 3 != 0).alias("verified"), F.round("o_totalprice", 2).alias("cost"))


def newest_of(facts: DataFrame) -> DataFrame:
    newest = Window.partitionBy("entity").orderBy(F.desc("serial"))
    return facts.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= RETRIEVED).drop("__rn")


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


CTE = {
    "fact_log": "SELECT user_id AS entity, event_type AS value, event_id AS serial, event_id AS ord FROM events",
    "fact_log_multi": """SELECT o_custkey AS entity, 'status' AS property, o_orderstatus AS value, 2 * o_orderkey AS serial, 2 * o_orderkey AS ord FROM orders
        UNION ALL SELECT o_custkey, 'priority', o_orderpriority, 2 * o_orderkey + 1, 2 * o_orderkey + 1 FROM orders""",
    "parsed": f"""SELECT {ENTITY} AS entity, 'value' AS property, p_brand AS value, 2 * p_partkey AS serial, 2 * p_partkey AS ord FROM part
        UNION ALL SELECT {ENTITY}, 'genre', p_type, 2 * p_partkey + 1, 2 * p_partkey + 1 FROM part""",
    "fact_text": f"""SELECT 2 * p_partkey AS serial, 2 * p_partkey AS ord, {ENTITY} || ' was manufactured by ' || p_brand AS text FROM part
        UNION ALL SELECT 2 * p_partkey + 1, 2 * p_partkey + 1, {ENTITY} || ' has the genre of ' || p_type FROM part""",
    "contexts": f"""SELECT p_partkey AS doc, 'Part U2. head ' || p_size || '. x' || chr(10) || p_partkey || '. ' || {ENTITY} || ' was manufactured by ' || p_brand || '.' || chr(10)
        || ' ' || (p_partkey + 1) || '. ' || {ENTITY} || ' has the genre of ' || p_type || '..' || chr(10) || p_partkey || '. again' AS context FROM part""",
    "questions": f"""SELECT qid, replace(replace(replace(t, '{{e}}', entity), '{{v}}', target), '{{p}}', property) AS question, intent, entity, property, target,
        CASE WHEN intent = 'aggregation' THEN p_size::VARCHAR WHEN intent = 'boolean' THEN (CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END) ELSE target END AS gold
        FROM (SELECT p_partkey AS qid, p_size, {ENTITY} AS entity, p_brand AS target, {_sql_list(TEMPLATES)}[p_partkey % {len(TEMPLATES)} + 1] AS t,
          {_sql_list(INTENTS)}[p_partkey % {len(TEMPLATES)} + 1] AS intent, {_sql_list(NOUNS)}[p_partkey % {len(NOUNS)} + 1] AS property FROM part)""",
    "candidates": f"""SELECT qid, serial, ord, q.entity || (CASE WHEN p.property = 'genre' THEN ' has the genre of ' ELSE ' was manufactured by ' END) || value AS fact_text, value AS answer_entity
        FROM questions q JOIN (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY serial DESC) AS rn FROM parsed) p ON q.entity = p.entity WHERE rn <= {RETRIEVED}""",
    "plans": """SELECT qid, question, intent, entity,
        CASE WHEN qid % 12 IN (4, 6) THEN 'specific' WHEN qid % 12 = 9 AND qid % 5 = 0 THEN 'ambiguous' ELSE 'entity_wide_values' END AS property_scope,
        CASE WHEN qid % 12 IN (4, 6) THEN 'genre' END AS property_name,
        CASE qid % 12 WHEN 3 THEN 'previous' WHEN 7 THEN 'ordinal' WHEN 10 THEN 'latest' WHEN 0 THEN 'earliest' ELSE 'unspecified' END AS temporal_scope,
        CASE WHEN qid % 12 = 7 THEN 2 END AS ordinal_offset,
        CASE WHEN qid % 12 IN (1, 9) THEN 'count' WHEN qid % 12 = 6 THEN 'list' ELSE 'none' END AS aggregation_mode,
        CASE WHEN intent = 'boolean' THEN target END AS boolean_target, qid % 12 IN (5, 11) AS negated, qid % 17 <> 0 AS supported, '' AS reason FROM questions""",
    "scored": """SELECT o_orderkey AS row_id, qid, CASE WHEN (o_orderkey // (SELECT count(*) FROM part)) % 2 = 0 THEN 'a' ELSE 'b' END AS arm, intent, gold,
        CASE WHEN o_orderstatus = 'F' THEN 'Final answer: ' || gold WHEN o_orderstatus = 'O' THEN NULL ELSE 'no idea 1,0' || qid END AS answer,
        qid % 3 <> 0 AS verified, round(o_totalprice, 2) AS cost FROM orders JOIN questions ON qid = o_orderkey % (SELECT count(*) FROM part)""",
}
NEEDS = {"candidates": ("questions", "parsed"), "plans": ("questions",), "scored": ("questions",)}


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind the named views and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return ("WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" if order else "") + sql
