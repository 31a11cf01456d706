"""Operators over embeddings and pages, components, and the pipeline."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from factlake.llm import embedding_dedup, warc
from factlake.llm.components import connected_components
from factlake.llm.registry import tokenizer_path

VECTORS = "vec_id long, embedding array<float>, label int, h string, c string"


def brute_links(rows, threshold):
    unit = {}
    for i, (_, v, *_) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            unit[i] = x / np.linalg.norm(x)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = [0] * len(rows)
    for i in unit:
        for j in unit:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return n, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("block", [4096, 40])
def test_embeddings(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vectors = [(c + rng.normal(scale=s, size=16)).astype(np.float32).tolist() for c in centres for s in (0.05, 0.15, 0.3) for _ in range(5)]
    rows = [(i, v, 0, "x", "y") for i, v in enumerate(vectors)]
    rows += [(1000, vectors[0], 0, "x", "y"), (1001, None, 0, "", ""), (1002, [0.0] * 16, 0, "", ""), (1003, [float("nan")] * 16, 0, "", ""), (1004, [1.0, None], 0, "", ""), (1005, [], 0, "", ""), (1006, [1.0, 0.0], 0, "", ""), (1007, [2.0, 0.1], 0, "", "")]
    n, comp = brute_links(rows, 0.95)
    got = {r.vec_id: r for r in embedding_dedup.dedup(spark.createDataFrame(rows, VECTORS), block=block).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (n[i], rows[comp[i]][0], comp[i] == i), r[0]
    assert embedding_dedup.dedup(spark.createDataFrame([], VECTORS)).count() == 0


def test_embeddings_at_the_threshold_and_at_the_ends_of_doubles(spark):
    """Wide pairs at cosine 0.95 to the last bit are linked; lengths don't overflow; a rare length in many blocks counts once."""
    rng = np.random.default_rng(8)
    rows, pairs = [], []
    for n in (2240, 5160, 7000, 20000):
        for _ in range(3):
            x = rng.choice([-1.0, 1.0], n)
            y = x.copy()
            y[rng.permutation(n)[: n // 40]] *= -1
            assert x @ y == round(0.95 * n)
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), x.tolist()), (len(rows) + 1, y.tolist())]
    big = rng.normal(size=8)
    first = len(rows)
    rows += [(first + i, (big * f).tolist()) for i, f in enumerate((1e200, 1e-200, 1e300, 1.0, -1e200))]
    rows += [(first + 10 + i, rng.normal(size=6).tolist()) for i in range(60)]
    got = {r.vec_id: r for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=7).collect()}
    assert all((got[a].n_links, got[b].n_links, got[b].component_id) == (1, 1, a) for a, b in pairs)
    assert [got[first + i].n_links for i in range(5)] == [3, 3, 3, 3, 0] and got[first + 3].component_id == first
    n, comp = brute_links([(i, v) for i, v in rows if i >= first + 10], 0.95)
    assert [got[first + 10 + i].n_links for i in range(60)] == n


def test_quantisation_bound():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, near, rest = embedding_dedup.quantise(x)
    product = (s[:, None] * s) * embedding_dedup.integer_product(q, q)
    bound = near[:, None] * rest + rest[:, None] * (near + rest)
    assert (np.abs(product - x @ x.T) <= bound + 1e-9).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(300 + i, 300) for i in range(1, 80)] + [(500, 500), (600, 601), (601, 600), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {300 + i: 300 for i in range(80)} | {600: 600, 601: 600}


PAGES = "page_id long, url string, html string, digest string, kind string"


def test_warc(spark):
    big = "<p>é" + "x" * 200
    rows = [(5, "http://a b", big), (3, None, big), (9, "u", big), (3, "u", big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (7, "u", ""), (None, "u", big), (8, "u\r\nX: y", big + "z" * 5000), (None, "u", "alone" * 50)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], PAGES)
    out = warc.round_trip(df).collect()
    assert len(out) == len(rows)
    same = [r for r in out if r.payload_bytes == len(big.encode())]
    assert len(same) == 5 and sum(r.record_type == "response" for r in same) == 1
    first = next(r for r in same if r.record_type == "response")
    assert first.page_id == 3 and first.body == big and all(r.refers_to == 3 for r in same if r is not first)
    assert all(r.record_type == "response" and r.refers_to is None for r in out if r.payload_bytes < 100 or r.payload_bytes == 250 or r.payload_bytes > 5000)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    as_rows = warc.read(warc.write(df)).collect()  # in a store that pyarrow can't open
    assert warc.opened("viewfs://store/x") is None and Counter(r.payload_digest for r in as_rows) == Counter(r.payload_digest for r in out)


def test_packages_are_files_that_other_readers_open(spark, tmp_path):
    import gzip
    import zipfile

    df = spark.createDataFrame([(i, f"u{i}", f"<p>{i}" * 50, "", "") for i in range(30)], PAGES).repartition(2)
    files = warc.write(df, folder=f"file://{tmp_path}/packages").collect()
    assert files and all(f.content is None for f in files)
    bodies = set()
    for f in files:
        with zipfile.ZipFile(f.path) as z:
            records = gzip.decompress(z.read(warc.ARCHIVE)).split(b"WARC/1.1\r\n")[1:]
            bodies |= {r.split(b"\r\n\r\n", 1)[1].removesuffix(b"\r\n\r\n").decode() for r in records}
            assert len(records) == f.records == len(z.read(warc.INDEX).splitlines())
    assert bodies == {f"<p>{i}" * 50 for i in range(30)}


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files_read_by_ranges(zip64):
    import io
    import zipfile

    rows = [(i, f"u{i}", f"payload {i}".encode() * (i + 1), f"d{i}", "response", None) for i in range(50)]
    blob = warc.package(rows, zip64=zip64)
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        assert z.testzip() is None and set(z.namelist()) == {warc.ARCHIVE, warc.INDEX}
    reads = []

    def read(at, n):
        reads.append(n)
        return blob[at : at + n]

    p = warc.Package(read, len(blob))
    got = list(p.records())
    assert [b for _, b in got] == [r[2] for r in rows] and [f["X-Page-ID"] for f, _ in got] == [str(i) for i in range(50)]
    with pytest.raises(ValueError):
        warc.Package(lambda at, n: b"\0" * n, 100)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_pipeline(spark, docs, tmp_path):
    """The contents of every stage: rows pass whole, or not at all, or with their own text cut."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from factlake.llm import language_id, packing, toxicity
    from tests.llm.test_documents import repeated_marks, unmarked

    labels = spark.createDataFrame([(3, 0, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        seen.append((now, now := spark.read.parquet(str(tmp_path / name))))
    (a, b), (_, c), (_, d), (_, e), (_, f) = seen
    text, at = docs.columns.index("text"), {n: i for i, n in enumerate(docs.columns)}
    toxic = Counter((r.doc_id, r.text) for r in toxicity.classify(a.select("doc_id", "text"), labels, keep=("doc_id", "text")).collect() if r.predicted)
    assert rows_of(a) - rows_of(b) == Counter({r: n for r, n in rows_of(a).items() if (r[0], r[text]) in toxic})
    assert not rows_of(b) - rows_of(a)
    known = Counter((r.doc_id, r.text) for r in language_id.identify(b, keep=("doc_id", "text")).collect() if r.known)
    assert rows_of(c) == Counter({r: n for r, n in rows_of(b).items() if (r[0], r[text]) in known}) and all(any(map(str.isalpha, r[text])) for r in rows_of(c))
    left = {r[text] for r in rows_of(c)}
    assert not rows_of(d) - rows_of(c) and len(rows_of(d)) == d.count() <= len(left)
    for r in rows_of(c):  # an equal text of the smallest id stays, or a near copy of it
        ids = [x[0] for x in rows_of(c) if x[text].split() == r[text].split() and x[0] is not None]
        assert sum(x[text].split() == r[text].split() for x in rows_of(d)) <= 1 and all(x[0] <= min(ids) for x in rows_of(d) if x[text].split() == r[text].split() and ids)
    own = sorted(rows_of(d), key=repr)
    cut = [unmarked(r[text].encode(), m).decode(errors="ignore") for r, m in zip(own, repeated_marks([r[text].encode() for r in own], 200), strict=True)]
    wanted = Counter(tuple(t if i == text else len(t) if i == at["n_chars"] else x for i, x in enumerate(r)) for r, t in zip(own, cut, strict=True))
    assert rows_of(e) == wanted
    lib, pieces = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), Counter()
    for r in rows_of(e):
        ids = [*lib.encode(r[text], add_special_tokens=False).ids, 2]
        pieces.update((r[0], k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024)))
    assert Counter(tuple(r)[:5] for r in f.collect()) == pieces
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset")) == rows_of(f.drop("sequence_id", "offset"))
