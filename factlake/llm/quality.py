"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Base measures come from each whole text. On top of a fixed base rule, every rule
"reject if the measure exceeds its cutoff" gets its cutoff per stratum from labelled
rows: among candidate cutoffs (quantiles of the measure over all documents) the
lowest is taken of which an exact binomial test shows, at a level corrected for the
number of tests (Bonferroni), that it rejects less than ``risk`` of the good rows.
Strata with too few labelled rows to show anything alone are pooled and get common
cutoffs; only if the pool has too few as well they keep the base rule alone. All rules
together then reject at most ``risk * len(RULES)`` of the good rows of a stratum, or of
the pool as a whole, at confidence ``1 - error``.

Defined cases: null and empty texts have no words and fail the base rule; a null
stratum is a stratum of its own; labels other than 0 and 1 are ignored, a document
with both labels counts as bad; ids that occur twice are measured twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import checkpoint

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
#: Largest share of good rows that one rule may reject, and the chance to be wrong.
RISK, ERROR = 0.002, 0.05
#: Quantiles, over all documents, at which cutoffs are tried.
GRID = (0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999)
#: Measures that are rejected above a cutoff.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "word_chars / greatest(n_words, 1)",
    "short_words": "- word_chars / greatest(n_words, 1)",
}


def measures(df: DataFrame, *, text: str = "text", window: int = 5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Windows are compared by 64-bit hashes of their words. Texts without an equal pair
    of windows stop there; in the others windows are sorted with their places, and the
    union of the repeated ones is measured in order of place.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACES), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    step = df.withColumn("__words", words).withColumn("__lines", lines)
    step = step.withColumn("__each", F.transform("__words", lambda w: F.xxhash64(w)))
    step = (
        step.withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)))
        .withColumn("n_symbols", F.length(F.regexp_replace(t, r"[^#*$%&|<>]++", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .drop("__words", "__lines")
    )
    last = F.col("n_words").cast("int") - window
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    step = step.withColumn("__h", F.transform(at, lambda i: F.xxhash64(*[F.get("__each", i + k) for k in range(window)]))).drop("__each")
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    step = step.withColumn("__s", F.when(twice, placed)).drop("__h")

    def again(x: Column, i: Column) -> Column:
        return F.coalesce(F.get("__s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("__s", i + 1)["h"] == x["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter("__s", again), lambda x: x["p"]))
    start = F.struct(F.lit(-window).alias("p"), F.lit(0).cast("long").alias("n"))
    union = F.aggregate(places, start, lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(window), p - a["p"])).alias("n")), lambda a: a["n"])
    return step.withColumn("n_repeat_words", F.coalesce(union, F.lit(0).cast("long"))).drop("__s")


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k) for k < n * p, exactly up to rounding; 0 otherwise.

    Walks the terms upward and keeps the sum relative to the last, largest term.
    """
    from math import log

    first = F.struct((n * log(1 - p)).alias("t"), F.lit(1.0).alias("s"))

    def step(a: Column, i: Column) -> Column:
        up = (n - i + 1) * p / (i * (1 - p))
        return F.struct((a["t"] + F.ln(up)).alias("t"), (1 + a["s"] / up).alias("s"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < n * p, F.aggregate(steps, first, step, lambda a: a["t"] + F.ln(a["s"]))).otherwise(F.lit(0.0))


def enough(n: int, groups: int, risk: float, error: float) -> bool:
    """Whether a rule that rejects none of ``n`` good rows can be shown safe next to so many groups."""
    from math import log

    return n * log(1 - risk) <= log(error / (len(RULES) * len(GRID) * groups))


def alone(sizes: list[int], risk: float, error: float) -> int:
    """How many strata, of falling ``sizes``, can show a rule that rejects nothing, next to the pool."""
    return max((i for i, n in enumerate(sizes, 1) if enough(n, i + 1, risk, error)), default=0)


def least_rows(risk: float, error: float) -> int:
    """Good rows below which no stratum can show anything alone."""
    from math import ceil, log

    return ceil(log(error / (len(RULES) * len(GRID) * 2)) / log(1 - risk))


def group(stratum: str, names: list[str]) -> Column:
    """The stratum where it has cutoffs of its own, null in the pool."""
    return F.when(F.col(stratum).isin(names), F.col(stratum)) if names else F.lit(None).cast("string")


def cutoffs(measured: DataFrame, labels: DataFrame, *, doc: str, stratum: str, label: str, risk: float, error: float) -> tuple[list[str], DataFrame]:
    """The strata of their own, and (stratum or null for the pool, cutoff of each rule or null): a row for each of some 3,600 labelled rows, and one, at most."""
    from math import log

    grid = measured.agg(*[F.percentile_approx(f"r_{r}", list(GRID), 10000).alias(f"g_{r}") for r in RULES])
    own = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc).alias("__d")).agg(F.min(label).alias("__y")).where("__y = 1")
    good = measured.where(~F.col("base_failed")).join(own, measured[doc] == F.col("__d"), "left_semi")
    sizes = good.groupBy(stratum).agg(F.count("*").alias("n")).where(F.col("n") >= least_rows(risk, error)).orderBy(F.desc("n"), stratum).collect()
    names = [r[0] for r in sizes[: alone([r[1] for r in sizes], risk, error)]]
    tried = good.crossJoin(F.broadcast(grid))  # one row, so no product
    over = [F.sum((F.col(f"r_{r}") > F.get(f"g_{r}", F.lit(i))).cast("long")).alias(f"k_{r}_{i}") for r in RULES for i in range(len(GRID))]
    first = [F.first(f"g_{r}").alias(f"g_{r}") for r in RULES]
    counted = tried.groupBy(group(stratum, names).alias("__stratum")).agg(F.count("*").alias("n"), *over, *first)
    tests = len(RULES) * len(GRID) * (len(names) + 1)
    chosen = []
    for r in RULES:
        safe = [F.when(log_binomial_tail(F.col("n"), F.col(f"k_{r}_{i}"), risk) <= log(error / tests), F.get(f"g_{r}", F.lit(i))) for i in range(len(GRID))]
        chosen.append(F.least(*safe).alias(f"c_{r}"))
    return names, counted.select("__stratum", *chosen)


def judge(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = docs.select(F.col(doc), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("__lang"), F.col(text).alias("__text"))
    m = measures(own, text="__text").select(doc, "__lang", *names)
    m = m.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    m = checkpoint(m.select("*", *[F.expr(e).cast("double").alias(f"r_{r}") for r, e in RULES.items()]))
    own_strata, limits = cutoffs(m, labels, doc=doc, stratum="__lang", label=label, risk=risk, error=error)
    found = m.withColumn("__group", group("__lang", own_strata)).join(F.broadcast(limits), F.col("__group").eqNullSafe(F.col("__stratum")), "left")  # a row for each stratum that could show something alone
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(f"r_{r}") > F.col(f"c_{r}"), F.lit(False))
    return found.select(doc, *names, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
