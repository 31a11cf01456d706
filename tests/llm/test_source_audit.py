"""The divergence audit against every word and every pair, one at a time."""

import random
import re
from collections import Counter, defaultdict

import pytest

from factlake.llm import source_audit

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top):
    docs = [tuple(x or "" for x in r[:3]) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen, n, sources = Counter(), defaultdict(Counter), sorted({d[1] for d in docs if d[0] == lang})
        for _, source, text in (d for d in docs if d[0] == lang):
            words = WORD.findall(lower(text))
            seen.update(set(words))
            n[source].update(words)
        kept = [t for t in seen if seen[t] >= least]
        total = {s: sum(n[s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (n[s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(n[s][t] for s in sources) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if n[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", item, -v, i) for i, (v, _, item) in enumerate(sorted(pair), 1)]
            out += [(lang, s, "term", item, -v, i) for i, (v, _, item) in enumerate(sorted(term)[:top], 1)]
    return sorted(out)


def table(seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé漢Z") for _ in range(rng.randint(1, 3))) for _ in range(120)]
    rows = []
    for _ in range(400):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["hot", "hot", "s1", "s2", "s3", "s4", "é", "Z", None])
        k = hash_of(source)
        text = rng.choice([" ", ", ", "\n1"]).join(rng.choice(vocabulary[k:]) for _ in range(rng.randint(0, 25)))
        rows.append((lang, source, rng.choice([text, text, text, None]), "x", 1, "y"))
    rows += [rows[0]] * 12 + [("de", "only", "a " * 5000, "x", 1, "y"), ("xx", "p", "", "x", 1, "y"), ("xx", "q", "1 2", "x", 1, "y"), (None, None, None, None, None, None)]
    return rows


def hash_of(source):
    return sum((source or "").encode()) % 40


SCHEMA = "lang string, source string, text string, term string, s int, `kept.x` string"


@pytest.mark.parametrize("sources, share", [(256, 16_384), (2, 7)])
def test_audit_is_that_of_every_word_and_pair(spark, sources, share):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in source_audit.audit(df, sources=sources, class_share=share).collect())
    assert got == brute(rows, 10, 10)
    assert any(r[2] == "term" for r in got)


def test_equal_columns_are_one_class(spark):
    """Words of equal counts in every source: ties go by the word, over more words than ranks."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = [("en", f"s{i % 2}", " ".join(words if i % 2 else [*words, "extra"]), "", 1, "") for i in range(30)]
    got = sorted(tuple(r) for r in source_audit.audit(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows, 10, 10)


def test_counts_beyond_63_bits_of_steps(spark):
    """A count of 10**10 times 10**9 steps needs more than 63 bits."""
    from pyspark.sql import functions as F

    one = spark.range(1).select(source_audit.share(F.lit(10**12).cast("long"), F.lit(10**13 + 7).cast("long"), F.lit(3).cast("long")).alias("p")).first()["p"]
    assert one == 1 + 10**9 * (10**12 + 2) // (10**13 + 7 + 6)


def test_empty_table(spark):
    out = source_audit.audit(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


def test_a_held_batch_is_handed_out_whole():
    held = source_audit.Counts()
    for g, t in ((("en", "a"), "x y x"), (("en", "b"), "Y"), (("en", "a"), "x, é")):
        held.add(g, t)
    got = sorted(tuple(r.values()) for r in held.batch().to_pylist())
    assert got == [("en", "a", "x", 3, 2), ("en", "a", "y", 1, 1), ("en", "a", "é", 1, 1), ("en", "b", "y", 1, 1)]
    assert not held.parts and not held.words
