"""From context documents to facts, and the statistics of fact texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.text import EXPLICIT, FALLBACK, FLAGS, fact_text, parse_generated

LEGACY = r"(\d+)\.\s"
ANCHORED = r"(?m)^[ \t]*(\d+)\.\s"


#: Sizes added up at once in ``running``; a list costs its length times this, not its square.
STEP = 128


def running(sizes: Column) -> Column:
    """For an array of integers the sums of all elements before each, in two levels of steps."""
    before = lambda a: F.slice(F.aggregate(a, F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))), F.lit(1), F.size(a))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(STEP)), lambda i: F.slice(sizes, i, F.lit(STEP)))
    starts = before(F.transform(steps, lambda step: F.aggregate(step, F.lit(0), lambda a, x: a + x)))
    return F.flatten(F.zip_with(steps, starts, lambda step, start: F.transform(before(step), lambda x: x + start)))


def boundaries(contexts: DataFrame, context: str, pattern: str, name: str) -> DataFrame:
    """Adds ``name``: an array of (serial, offset, text), one for every boundary of a document.

    Everything is worked out once a document, in time linear in its length.
    """
    c = F.col(context)
    cut = contexts.withColumns({"__n": F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), "__m": F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), "__p": F.split(c, pattern)})
    sizes = F.zip_with("__m", F.slice("__p", F.lit(2), F.size("__m")), lambda m, p: F.length(m) + F.length(p))
    cut = cut.withColumn("__s", sizes).withColumn("__o", running(F.col("__s"))).withColumn("__p1", F.slice("__p", F.lit(2), F.size("__m")))
    first = F.length(F.get("__p", F.lit(0)))
    zipped = F.transform(F.arrays_zip("__n", "__o", "__p1"), lambda x: F.struct(x["__n"].cast("long").alias("serial"), (first + x["__o"]).alias("offset"), fact_text(x["__p1"]).alias("text")))
    return cut.withColumn(name, zipped).drop("__n", "__m", "__p", "__s", "__o", "__p1")


def _parsed(contexts: DataFrame, context: str, pattern: str) -> DataFrame:
    """(serial, context_order, offset of the boundary, text) for every boundary, beside the other columns."""
    keep = [x for x in contexts.columns if x != context]
    # an outer one: of a plain explode Spark would test the size of its array first, with all that makes it worked out again in there
    found = boundaries(contexts, context, pattern, "__facts").select(*keep, F.posexplode_outer("__facts").alias("context_order", "__f"))
    return found.where("context_order is not null").select(*keep, "__f.serial", "context_order", "__f.offset", "__f.text")


def parse_legacy(contexts: DataFrame, context: str = "context") -> DataFrame:
    """Every ``<digits>. `` begins a fact, also inside a line; empty texts stay."""
    return _parsed(contexts, context, LEGACY)


def parse_anchored(contexts: DataFrame, context: str = "context") -> DataFrame:
    """Only a number at the start of a line begins a fact; its offset is that of the line's first blank or digit."""
    return _parsed(contexts, context, ANCHORED)


def dedupe_first(facts: DataFrame, *keys: str) -> DataFrame:
    """The first fact of each serial, by context order."""
    w = Window.partitionBy(*keys, "serial").orderBy("context_order")
    return facts.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def chunk_fixed(df: DataFrame, text: str, width: int = 4096) -> DataFrame:
    """Slices of ``width`` characters without overlap; the index is the serial."""
    n = F.length(text)
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1)).otherwise(F.array().cast("array<int>")))
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, text, at.alias("chunk")).select(*keep, "chunk", F.substring(F.col(text), F.col("chunk") * width + 1, F.lit(width)).alias("chunk_text"))


def _both(contexts: DataFrame, context: str) -> DataFrame:
    """Adds the boundaries of either parser, and those only legacy has: no line starts at their offset."""
    both = boundaries(boundaries(contexts, context, LEGACY, "legacy"), context, ANCHORED, "anchored")
    offsets = F.array_except(F.transform("legacy", lambda x: x["offset"]), F.transform("anchored", lambda x: x["offset"]))
    return both.withColumn("only_legacy", offsets)


def boundary_audit(contexts: DataFrame, key: str, context: str = "context") -> DataFrame:
    """Per document: boundaries of either parser, those only legacy has, empties, duplicates, unparsed facts.

    A row looks at its own document only, so nothing is joined or shuffled.
    """
    serials = F.transform("anchored", lambda x: x["serial"])
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return _both(contexts.select(key, context), context).select(
        key, size("legacy").alias("n_legacy"), size("anchored").alias("n_anchored"),
        (size(serials) - size(F.array_distinct(serials))).alias("duplicate_serials"),
        size(F.filter("anchored", lambda x: x["text"] == "")).alias("empty_texts"),
        size("only_legacy").alias("only_legacy"),
        size(F.filter("anchored", lambda x: ~x["text"].rlike(FLAGS + EXPLICIT) & ~x["text"].rlike(FLAGS + FALLBACK))).alias("unparsed"),
    )


def false_boundaries(contexts: DataFrame, key: str, context: str = "context", before: int = 48, after: int = 80) -> DataFrame:
    """(key, pseudo_serial, offset, snippet): legacy boundaries that begin no line, with what stands around them."""
    only = _both(contexts.select(key, context), context).select(key, context, F.explode_outer(F.filter("legacy", lambda x: F.array_contains("only_legacy", x["offset"]))).alias("b")).where("b is not null")
    start = F.greatest(F.col("b.offset") - before, F.lit(0))
    return only.select(key, F.col("b.serial").alias("pseudo_serial"), "b.offset", F.substring(F.col(context), start + 1, F.col("b.offset") + after - start).alias("snippet"))


def unparsed_facts(contexts: DataFrame, key: str, context: str = "context") -> DataFrame:
    """(key, serial, fact_text) of line-start facts that no template takes apart."""
    subject, _, _ = parse_generated(F.col("text"))
    return parse_anchored(contexts.select(key, context), context).where(subject.isNull()).select(key, "serial", F.col("text").alias("fact_text"))


def prefixes(facts: DataFrame, entities: DataFrame, text: str = "text", entity: str = "entity") -> DataFrame:
    """Facts beside each beginning of theirs that has as many words as some entity, in the column ``entity``.

    The numbers of words come from the catalog (a row each), so a fact yields as many
    rows as there are such numbers, whatever the entities share.
    """
    words = entities.select((F.length(entity) - F.length(F.replace(F.col(entity), F.lit(" ")))).alias("n")).where("n is not null").distinct()
    counts = sorted(r[0] + 1 for r in words.collect())
    spaces = F.length(text) - F.length(F.replace(F.col(text), F.lit(" ")))
    begin = F.array_compact(F.array(*[F.when(spaces >= k, F.substring_index(F.col(text), " ", k)) for k in counts]).cast("array<string>"))
    return facts.withColumn(entity, F.explode(begin))


def prefix_join(facts: DataFrame, entities: DataFrame, text: str = "text", entity: str = "entity") -> DataFrame:
    """Facts whose text starts with an entity and a space: an equi-join on the whole beginning."""
    return prefixes(facts, entities, text, entity).join(entities.select(entity).distinct(), entity)


def prefix_counts(facts: DataFrame, entities: DataFrame, text: str = "text", entity: str = "entity") -> DataFrame:
    """(entity, n_raw): facts that start with each entity, counted before they meet the entities."""
    n = prefixes(facts.select(text), entities, text, entity).groupBy(entity).agg(F.count("*").alias("n_raw"))
    return n.join(entities.select(entity).distinct(), entity)


def corpus_stats(tokens: Column, df: DataFrame) -> DataFrame:
    """Documents, tokens, vocabulary and mean length (over one document at least)."""
    sized = df.select(F.size(tokens).cast("long").alias("n"))
    words = df.select(F.explode(tokens).alias("w")).distinct().agg(F.count("*").alias("vocabulary"))
    one = sized.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("tokens"))
    return one.crossJoin(words).withColumn("mean_length", F.round(F.col("tokens") / F.greatest("documents", F.lit(1)), 6))
