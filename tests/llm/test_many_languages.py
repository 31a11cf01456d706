"""More languages than tables are held at once."""

import random

import numpy as np

from factlake.llm import language_id


def test_every_language_is_learned(spark):
    names = [f"l{i:02d}" for i in range(70)]
    rows = []
    for i, name in enumerate(names):
        a, b = chr(0x4E00 + 40 * i), chr(0x4E01 + 40 * i)
        # the last languages are the rarest
        rows += [(1000 * i + k, f"{a}{b} {b}{a}{a} {a}{b}{b}", name) for k in range(12 if i < 64 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert all(out[d] == lang for d, _, lang in rows)


def test_blocks_of_languages_and_pieces_of_texts_give_the_same_lengths(monkeypatch):
    counts = {x: np.unique(language_id.grams([t] * 20), return_counts=True) for x, t in (("a", b"abracadabra"), ("b", b"hocus pocus"), ("c", b"sim sala bim"))}
    texts = [b"abba", b"pocus", b"xyz sim abracadabra hocus"]
    held = language_id.build(counts).lengths(texts)
    monkeypatch.setattr(language_id, "TOGETHER", 1)
    monkeypatch.setattr(language_id, "PIECE", 5)
    assert len(language_id.build(counts).blocks) == 3 and (language_id.build(counts).lengths(texts) == held).all()


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("½ ² 3", None), ("Ⅷ ٣ _", None), ("½ a", None), *[("some words", "en")] * 9])], "doc_id long, text string, lang string")
    out = language_id.identify(docs).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out[:3]] == ["und", "und", "en"] and not out[0].known and all(r.known for r in out[3:])


def test_what_no_language_codes_is_not_known(spark):
    rows = [(i, "some words of a language, again and again", "en") for i in range(40)] + [(100, "漢字假名交じり文章" * 20, None), (101, "some more words", None)]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out[101].known and out[0].known and not out[100].known
    nothing = language_id.identify(spark.createDataFrame([(1, "words", None), (2, "?", None)], "doc_id long, text string, lang string")).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.known, r.bits_per_byte) for r in nothing] == [("und", True, None), ("und", False, None)]


def test_held_out_languages_are_found(spark):
    """Texts of mixed words of four made-up languages that share most of their letters."""
    rng = random.Random(4)
    words = {x: ["".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(60)] for x, s in (("a", ("ba", "lo", "ti")), ("b", ("ab", "ol", "it")), ("c", ("bal", "ot", "i")), ("d", ("til", "ob", "a")))}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(12)), x) for i, x in enumerate("abcd" * 100)]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [r for r in rows if out[r[0]].held_out]
    assert len(held) > 60 and sum(out[d].lang_pred == x for d, _, x in held) >= 0.97 * len(held)
