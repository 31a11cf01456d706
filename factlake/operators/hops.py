"""Multi-hop questions: placeholders, gates and the chain, one join a level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators import history


def substitute(text: Column, answers: dict[int, Column]) -> Column:
    """Replaces {hop_N_answer} by answers; nulls become nothing."""
    return reduce(lambda t, kv: F.replace(t, F.lit(f"{{hop_{kv[0]}_answer}}"), F.coalesce(kv[1], F.lit(""))), answers.items(), text)


def missing(text: Column, answers: dict[int, Column]) -> Column:
    """The first needed hop without an answer, or null if the hop can run."""
    needed = [F.when(text.contains(f"{{hop_{n}_answer}}") & F.coalesce(a == "", F.lit(True)), n) for n, a in answers.items()]
    return F.coalesce(*needed)


def chain(questions: DataFrame, facts: DataFrame, hops: int) -> DataFrame:
    """Follows the freshest value from entity to entity, at most ``hops`` times.

    ``questions`` has (qid, entity), ``facts`` (entity, value, serial, ord). A hop whose
    predecessor has no answer is skipped. The loop is over levels, never over questions.
    """
    known = history.freshest(facts, "entity").select(F.col("entity").alias("__e"), F.col("value").alias("__v"))
    now = questions.withColumns({"__at": F.col("entity"), "answer": F.lit(None).cast("string"), "executed": F.lit(0), "skipped": F.lit(0)})
    for _ in range(hops):
        now = now.join(known, F.col("__at") == F.col("__e"), "left")
        ran = F.col("__at").isNotNull()
        now = now.select("qid", "entity", F.coalesce("__v", "answer").alias("answer"), (F.col("executed") + ran.cast("int")).alias("executed"), (F.col("skipped") + (~ran).cast("int")).alias("skipped"), F.col("__v").alias("__at"))
    return now.select("qid", F.coalesce("answer", F.lit("(no answer)")).alias("answer"), F.col("executed").cast("long").alias("executed"), F.col("skipped").cast("long").alias("skipped"))
