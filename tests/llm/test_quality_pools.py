"""Cutoffs from strata of hundreds of labels, and from a pool of smaller ones."""

from factlake.llm import quality


def test_hundreds_of_labels_are_enough_and_small_strata_are_pooled(spark):
    filler = " ".join(f"word{i}" for i in range(30))
    sizes = {"en": (900, 150), "fr": (400, 60), "de": (400, 60), None: (40, 10)}
    good = [(lang, f"{filler} g{i}", 1) for lang, (n, _) in sizes.items() for i in range(n)]
    bad = [(lang, f"{filler} {'# ' * 40}b{i}", 0) for lang, (_, n) in sizes.items() for i in range(n)]
    rows = [(i, t, lang, q) for i, (lang, t, q) in enumerate(good + bad)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    out = {r.doc_id: r.kept for r in quality.judge(table.drop("quality"), table.select("doc_id", "quality"), risk=0.01).collect()}
    assert all(out[i] == bool(q) for i, _, _, q in rows)


def test_strata_that_can_show_something():
    assert quality.alone([900, 400, 400, 40], 0.01, 0.05) == 1
    assert quality.alone([400, 40], 0.01, 0.05) == 0 and quality.alone([], 0.01, 0.05) == 0
