"""Hard negatives, cross-polytope search and the source audit against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulsegrid.llm import crosspolytope, divergence, hardneg

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, row long, score double, bucket string, nameless map<string,int>"


def embeddings(spark, data):
    return spark.createDataFrame([(i, v, c, 1, 1.0, "x", {"a": 1}) for i, v, c in data], SCHEMA)


def some(n: int = 500, dim: int = 6) -> list[tuple]:
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0.1, 0.2, dim).astype(np.float32).astype(float).tolist(), int(rng.integers(4))) for i in range(n)]
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(120)]  # a group of copies, ties
    rows += [rows[7], rows[100], rows[100], (None, rows[3][1], 1), (None, rows[0][1], 2)]
    rows += [(2000, None, 1), (2100, [], 1), (2101, [], 2), (2102, [], 1), (2200, [1.0, None, 1.0, 0.0, 0.0, 0.0], 1), (2300, [NAN] * dim, 1), (2400, [INF] * dim, 1), (2500, [0.5, 0.25], 1), (2501, [0.5, 0.2], 2), (2502, [0.5, 0.21], 1), (2600, [0.0] * dim, 1), (2700, rows[5][1], None)]
    return rows


def whole(v) -> bool:
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def last(i):
    return (i is None, i or 0)


def hard(data, every, positives, k, low, high):
    fine = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], c) for i, v, c in data if whole(v) and c is not None]
    out = []
    for a, (i, v, c) in enumerate(fine):
        if i is None or i % every:
            continue
        others = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), last(j), b) for b, (j, w, _) in enumerate(fine) if b != a and len(w) == len(v)))
        same = [x for x in others if fine[x[2]][2] == c][:positives]
        for s, _, p in same:
            good = [(n, b) for n, _, b in others if fine[b][2] != c and low * -s <= 100 * -n <= high * -s][:k]
            out += [(i, fine[p][0], r + 1, fine[b][0], -s, -n) for r, (n, b) in enumerate(good)]
    return Counter(out)


@pytest.mark.parametrize("cut", [{}, {"block": 60, "batch": 3}])
def test_hard_negatives(spark, cut):
    data = some()
    got = Counter(tuple(r) for r in hardneg.mine(embeddings(spark, data), **cut).collect())
    assert got == hard(data, 100, 5, 10, 30, 90) and len(got) > 100
    wide = Counter(tuple(r) for r in hardneg.mine(embeddings(spark, data), every=30, positives=3, k=2, low=0, high=100, **cut).collect())
    assert wide == hard(data, 30, 3, 2, 0, 100)


def test_hard_negatives_of_little(spark):
    rows = embeddings(spark, some())
    assert hardneg.mine(rows.limit(0)).count() == 0
    assert hardneg.mine(embeddings(spark, [(0, [1.0], 1)])).count() == 0
    assert hardneg.mine(embeddings(spark, [(0, [-1.0], 1), (1, [1.0], 1), (2, [0.5], 2)])).count() == 0  # limits of a score below zero hold nothing
    moved = {r.vec_id: r.label for r in hardneg.with_some_relabelled(embeddings(spark, [(0, [1.0], 9), (7, [1.0], 3), (8, [1.0], 3), (14, [1.0], None), (None, [1.0], 2)])).collect()}
    assert moved == {0: 0, 7: 4, 8: 3, 14: None, None: 2}
    with pytest.raises(Exception, match="fit"):
        hardneg.mine(embeddings(spark, [(0, [1e9], 1)])).count()


def cosine(a, b):
    return float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))))


def near(data, every=50, k=5):
    """query to the (score, id) of all its candidates in order, as a list for each query row."""
    fine = [(i, np.asarray(v, np.float32).astype(float)) for i, v, _ in data if whole(v) and len(v) and any(v)]
    out = defaultdict(list)
    for a, (i, v) in enumerate(fine):
        if i is not None and i % every == 0:
            scored = sorted((-round(cosine(v, w), 9), last(j), j) for b, (j, w) in enumerate(fine) if b != a and len(w) == len(v))
            out[i].append([(-s, j) for s, _, j in scored[:k]])
    return out


def results(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r["rank"], round(r.score, 9), r.vec_id))
    return out


@pytest.mark.parametrize("cut", [{}, {"bucket": 4, "chunk": 7, "tables": 3}, {"probes": 1}])
def test_neighbours(spark, cut):
    data = some()
    got, want = results(crosspolytope.nearest(embeddings(spark, data), aim=1.0, **cut)), near(data)
    assert got.keys() == want.keys()
    found = everything = 0
    for q, lists in want.items():
        assert sorted(r for r, *_ in got[q]) == sorted(r + 1 for x in lists for r in range(len(x)))  # k of them, or all there are
        have = Counter((s, i) for _, s, i in got[q])
        found += sum((have & Counter((s, i) for x in lists for s, i in x)).values())
        everything += sum(map(len, lists))
        for x in lists:
            assert len(lists) > 1 or [(s, last(i)) for _, s, i in sorted(got[q])] == sorted([(s, last(i)) for _, s, i in got[q]], key=lambda t: (-t[0], t[1]))
    assert found >= (0.5 if "probes" in cut else 0.97) * everything


def test_neighbours_when_all_is_probed(spark):
    """With every bucket probed the result is exact, ties and copies too."""
    data = some()
    got, want = results(crosspolytope.nearest(embeddings(spark, data), probes=1 << 20, tables=2)), near(data)
    assert {q: Counter((s, i) for _, s, i in x) for q, x in got.items()} == {q: Counter(t for x in lists for t in x) for q, lists in want.items()}


def test_neighbours_of_little(spark):
    assert crosspolytope.nearest(embeddings(spark, some()).limit(0)).count() == 0
    few = crosspolytope.nearest(embeddings(spark, [(0, [1e30, 1e-30], 1), (1, [-1e30, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, -0.0], 1)]))
    assert [tuple(r) for r in few.orderBy("rank").collect()] == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 1, -1.0)]
    assert crosspolytope.nearest(embeddings(spark, [(50, [1.0], 1)])).count() == 0


def test_recall_on_random_vectors(spark):
    rng = np.random.default_rng(3)
    data = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(4000, 32)).astype(np.float32))]
    got, want = results(crosspolytope.nearest(embeddings(spark, data), bucket=16)), near(data)
    assert sum(len({i for *_, i in got[q]} & {i for _, i in x[0]}) for q, x in want.items()) >= 0.9 * 5 * len(want)


def test_rotations_keep_lengths_and_find_the_nearest_axis():
    x = np.random.default_rng(1).normal(size=(50, 16))
    assert np.allclose(crosspolytope.hadamard(np.eye(16)) @ crosspolytope.hadamard(np.eye(16)).T, np.eye(16))
    t = crosspolytope.Tables(16, 3, 4, 0)
    assert np.allclose(np.square(t.axes(x, 1, 0)).sum(axis=1), 2 * np.square(x).sum(axis=1))
    assert (t.probes_of(x)[:, 0] // t.buckets == [max(range(3), key=lambda k: t.reach(x[i : i + 1], k).max()) for i in range(50)]).all()
    for k, b in enumerate(t.buckets_of(x).T):
        assert (b - k * t.buckets == t.reach(x, k).argmax(axis=1)).all()


def audited(docs, least, top):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, within, groups = Counter(), Counter(), set()
    for _, text, lang, source, *_ in docs:
        g = (lang or "", source or "")
        groups.add(g)
        words = [w.translate(lower) for w in word.findall(text or "")]
        n.update((*g, w) for w in words)
        within.update((g[0], w) for w in set(words))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for (g, w), d in within.items() if g == lang and d >= least]
        sources = sorted(s for g, s in groups if g == lang)
        share = lambda counts: {w: 1 + 10**9 * (counts[w] + 5) // (sum(counts.values()) + 5 * len(kept)) for w in kept}
        p = {s: share({w: n[lang, s, w] for w in kept}) for s in sources}
        q = share({w: sum(n[lang, s, w] for s in sources) for w in kept})
        for s in sources:
            pair = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s)
            term = sorted((q[w] - p[s][w], w) for w in kept if n[lang, s, w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, item, -v, r + 1) for part, x in (("pair", pair), ("term", term)) for r, (v, item) in enumerate(x)]
    return Counter(out)


@pytest.mark.parametrize("cut", [{}, {"terms": 3, "sources": 2}])
def test_audit(spark, docs, crowded, nothing, cut):
    want = audited([tuple(r) for r in docs.collect()], 4, 7)
    assert {p for _, _, p, *_ in want} == {"pair", "term"}
    for x in (docs, crowded):
        assert Counter(tuple(r) for r in divergence.audit(x, 4, 7, **cut).collect()) == want
    assert divergence.audit(nothing, **cut).count() == 0
    assert Counter(tuple(r) for r in divergence.audit(docs, 1000, **cut).collect()) == audited([tuple(r) for r in docs.collect()], 1000, 50)


def test_counts_handed_on_in_pieces(spark, docs):
    one, many = (sorted(map(tuple, divergence.term_counts(docs, n).collect()), key=str) for n in (10**6, 5))
    assert one == many and len(one) > 40


def test_shares_are_exact():
    rng = np.random.default_rng(2)
    counts = np.concatenate([rng.integers(0, 10**15, 200), [0, 9 * 10**14, 10**15 - 1]])
    totals = counts + 5 + np.concatenate([rng.integers(0, 8 * 10**15, 200), [0, 0, 1]])
    assert divergence.shares(counts, totals).tolist() == [1 + 10**9 * (c + 5) // t for c, t in zip(counts.tolist(), totals.tolist(), strict=True)]
