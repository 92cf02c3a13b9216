"""Operators on pages and embeddings, and the pipeline."""

import fnmatch
import re
from collections import Counter

import numpy as np
import pytest

from pulsegrid.llm import kdtree, urlfilter

URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/en/", "http://example.net/en", "http://x.example.com/de/9?q=1", "http://x.example.com/en/9", "http://b.org/fr/1#top", "http://b.org/es/", "http://net/", "http://net",
    "nothing here", "", None, "http://a.b.net?x=/en/", "ftp://Ünï.NET/ß/…", "http://notexample.com/de/", "http://c.com/x.net/y", "x://y://z.net/", "http://a.net#/", "http://" + "a" * 9000 + ".net/" + "b" * 9000, "http://h.net/p\nq",
]


def by_hand(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fit = [r for r in urlfilter.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_urls(spark):
    data = [(k if k else None, u, "<html>", "x") for k, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(data, "page_id long, url string, html string, host string")
    got = Counter(tuple(r) for r in urlfilter.judge(pages).collect())
    assert got == Counter((k, *by_hand(u)) for k, u, *_ in data)
    assert urlfilter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, ()).collect()} == {"allow"}


def test_automaton_as_fnmatch():
    rng = np.random.default_rng(2)
    letter = lambda n, kind: "".join(rng.choice(list(kind), n))
    globs = [letter(int(rng.integers(1, 30)), "ab*?c") for _ in range(40)]  # several words
    texts = [letter(int(rng.integers(0, 25)), "abc") for _ in range(300)] + ["ab" * 3000]
    automaton = urlfilter.Automaton(globs)
    assert automaton.words > 2
    got = automaton.matches([t.encode() for t in texts])
    want = np.array([[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts])
    assert (got == want).all()


def nearest(data, every=50, k=5):
    fine = [(i, np.floor(256 * np.asarray(v, np.float64)).astype(int).tolist()) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({(i, tuple(v)) for i, v in fine if i % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in fine if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return Counter(out)


def test_top_k(spark):
    rng = np.random.default_rng(7)
    data = [(i, rng.normal(0, 0.2, 6).astype(np.float32).astype(float).tolist()) for i in range(400)]
    data += [(1000 + i, data[0][1]) for i in range(60)]  # ties
    data += [(2000, None), (2050, []), (2100, [1.0, None, 1.0, 0.0, 0.0, 0.0]), (2150, [float("nan")] * 6), (2200, [float("inf")] * 6), (2250, [0.5, 0.25]), (2300, [0.0] * 6), (None, [0.1] * 6), (7, data[7][1])]
    vectors = spark.createDataFrame([(i, v, 0, 1) for i, v in data], "vec_id long, embedding array<float>, label int, rank int")
    got = kdtree.top_k(vectors, shard=100, batch=4, leaf=8)
    assert Counter(tuple(r) for r in got.collect()) == nearest(data)
    assert kdtree.top_k(vectors.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in kdtree.top_k(few).collect()] == [(0, 1, 1, 256 * 512)]


def test_tree_is_exact_with_large_components():
    rng = np.random.default_rng(9)
    v = rng.integers(-(2**30), 2**30, (300, 4))
    tree = kdtree.Tree(np.arange(300), v, 16)
    for q in v[:20]:
        want = sorted(((int(x @ q), -i) for i, x in enumerate(v)), reverse=True)[:5]
        assert tree.search(-1, q, 5, -(1 << 62)) == want


def test_cells_and_skipped_shards(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 3, (300, 3)) for c in ((0, 0, 0), (90, 0, 0), (0, 90, 0), (-90, 0, 60))]).astype(np.int64)
    cells = kdtree.Cells(x, 9)
    of = cells.of(x)
    assert cells.count == 9 and np.bincount(of, minlength=9).min() > 60
    assert kdtree.Cells(np.zeros((20, 2)), 8).count == 1 and kdtree.Cells(x[:0], 4).of(x).tolist() == [0] * len(x)
    known = {3: (np.arange(9), np.full(9, 2), np.array([x[of == c].min(axis=0) for c in range(9)]), np.array([x[of == c].max(axis=0) for c in range(9)]))}
    asked = [(int(i), 3, x[i].tobytes(), int(i), int(np.sort(x @ x[i])[-5])) for i in range(0, 1200, 40)]
    df = spark.createDataFrame(asked, "vec_id long, dim int, v binary, row long, floor long")
    far = kdtree.routes(df, known, np.float64, False, 7).collect()
    assert len(far) < 0.6 * 2 * 9 * len(asked)  # shards of cells out of reach see nothing
    visited = {(r.row, r.cell) for r in far}
    assert all((int(i), int(of[j])) in visited for i, *_, floor in asked for j in np.flatnonzero(x @ x[i] >= floor))
    assert len(kdtree.routes(df, known, np.float64, True, 7).collect()) == 2 * len(asked)


@pytest.fixture
def folder(tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline(spark, folder):
    import corpus_pipeline
    from pulsegrid.llm.common import table, written

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    docs = table(spark, folder, "documents")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, written(stage(spark, docs, folder), "stage")
        if k < 4:
            assert docs.columns == columns and docs.schema["doc_id"].dataType == before.schema["doc_id"].dataType
    assert set(docs.columns) >= {"doc_id", "sequence_id", "offset", "length"} and docs.count() > 0
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
