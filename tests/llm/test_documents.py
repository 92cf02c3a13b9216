"""Each operator on documents against a brute-force version, over the odd rows of conftest."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import key, rows, texts
from pyspark.sql import functions as F

from pulsegrid.llm import hpylm, linededup, lzprint, mixing, packing, quality, sharding, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def both(request, name):
    return request.getfixturevalue(name)


@pytest.fixture(params=["docs", "crowded"])
def table(request):
    return request.getfixturevalue(request.param)


def test_shards(table):
    got = sharding.shard_by_bytes(table).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows()), key=key)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == want
    shards, slots = defaultdict(set), defaultdict(list)
    for r in got:
        shards[r.size, r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_differencing_is_tight():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 10_000, 500).tolist()
    sums = Counter()
    for s, b in zip(sizes, sharding.difference(sizes, 8), strict=True):
        sums[b] += s
    assert max(sums.values()) - min(sums.values()) <= 3
    assert sharding.difference([], 8) == [] and sharding.difference([5], 8) == [0]
    assert sorted(sharding.difference([1, 2, 3, 4, 5, 6, 7, 8], 8)) == list(range(8))


def test_giant_group_is_kept_together(spark):
    data = [(i, "same text") for i in range(300)] + [(1000 + i, f"text number {i}") for i in range(600)]
    got = sharding.shard_by_bytes(spark.createDataFrame(data, "doc_id long, text string"), packets=64).collect()
    assert len({r.shard for r in got if r.doc_id < 300}) == 1 and len(got) == 900
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    rest = [v for k, v in sums.items() if k != next(r.shard for r in got if r.doc_id == 0)]
    assert len(rest) == 7 and max(rest) < 1.2 * min(rest)


def test_packing(table):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, *_ in rows():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 2048):
            want[i, s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)] += 1
    got = packing.pack(table, group=16).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def test_first_fit_decreasing():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2048, 700)
    bins, offsets = packing.first_fit_decreasing(lengths, 2048)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(2048)
        assert (bins[i], offsets[i]) == (k, 2048 - room[k])
        room[k] -= lengths[i]


def test_mixing(table):
    got = mixing.mix(table, bucket=4, fan_in=2).collect()
    again = mixing.mix(table.repartition(3), bucket=4, fan_in=2).collect()
    flat = lambda x: sorted((tuple(r) for r in x), key=key)
    assert flat(got) == flat(again)
    sizes, own = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in rows():
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weight[s]) for s in sizes) < 1.5 * sum(sizes.values()) else (low, mid)
    targets = {s: min(2 * sizes[s], low * weight[s]) for s in sizes}
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((i, len(WORD.findall(t or ""))) for i, t, *_ in rows() if i is not None)
    source = {(i, len(WORD.findall(t or ""))): s for i, t, _, s, _ in rows()}
    largest = defaultdict(int)
    for r in got:
        s = source[r.doc_id, r.size]
        assert abs(r.target - targets[s]) < 1e-6 * max(1, targets[s]) and r.source_size == sizes[s] and r.taken in (0, r.size, 2 * r.size)
        own[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(own[s] - targets[s]) <= largest[s] / 2 + 1e-6 for s in sizes)


def test_pivot_keeps_the_sum():
    rng = np.random.default_rng(4)
    for k in range(50):
        sizes, p = rng.integers(0, 50, 200), rng.random(200)
        took, left, q = mixing.pivot(sizes, p, [k])
        total = (sizes * np.where(sizes > 0, p, 0)).sum()
        assert set(took.tolist()) <= {0, 1}
        assert abs((sizes * took).sum() + (sizes[left] * q if left >= 0 else 0) - total) < 1e-6
    mean = np.mean([mixing.pivot(np.array([3, 5, 2, 9]), np.array([0.2, 0.5, 0.7, 0.4]), [k])[0] for k in range(4000)], axis=0)
    assert np.all(mean <= np.array([0.2, 0.5, 0.7, 0.4]) + 0.05)


def test_pool_keeps_sum_and_expectation():
    rng = np.random.default_rng(11)
    for k in range(50):
        sizes, p = np.sort(rng.integers(0, 50, 100))[::-1], float(rng.random())
        took, left, q = mixing.pivot_pool(sizes, p, [k])
        assert set(took.tolist()) <= {0, 1}
        assert abs((sizes * took).sum() + (sizes[left] * q if left >= 0 else 0) - p * sizes.sum()) < 1e-6
    runs = [mixing.pivot_pool(np.array([90, 7, 5, 5, 2, 1]), 0.3, [k]) for k in range(6000)]
    mean = np.mean([t + (q * (np.arange(6) == left) if left >= 0 else 0) for t, left, q in runs], axis=0)
    assert np.allclose(mean, 0.3, atol=0.03)
    for p in (0.0, 1.0):
        assert mixing.pivot_pool(np.array([3, 2, 0]), p, [1])[0].tolist() == [int(p), int(p), 0]


def test_mixed_rows_are_whole(crowded):
    got = mixing.mixed_rows(crowded)
    assert got.columns == crowded.columns
    counts = Counter((r.doc_id, r.text) for r in got.collect())
    have = Counter((r[0], r[1]) for r in rows())
    assert set(counts) <= set(have) and all(n <= 2 * have[k] for k, n in counts.items())


def test_scores(table):
    got = hpylm.score(table, hpylm.held_out(), block=3000, bucket=1500).collect()
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), "\n"]) for i, t, *_ in rows()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held(i), len(ws), sum(w in count for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, ws in tokens), key=key)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=key) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    again = hpylm.score(table, hpylm.held_out(), block=3000, bucket=1500).collect()
    assert sorted((tuple(r) for r in again), key=key) == sorted((tuple(r) for r in got), key=key)


def test_scores_use_contexts(spark):
    """Words that follow from the one before, some new ones among them: better than counts of words alone, on held-out texts."""
    rng = np.random.default_rng(6)

    def text(i: int) -> str:
        words, now = [], int(rng.integers(0, 26))
        for k in range(40):
            now = (now * 7 + int(rng.integers(0, 2))) % 26
            words.append(f"w{now}" + chr(97 + now) if k % 9 else f"new{rng.integers(0, 1 << 40)}")
        return " ".join(words)

    df = spark.createDataFrame([(i, text(i)) for i in range(400)], "doc_id long, text string")
    out = hpylm.score(df, hpylm.held_out(), block=20_000, bucket=8000).filter("held_out").selectExpr("sum(score) as s", "sum(base_score) as b", "sum(n_tokens) as n").first()
    assert out.s / out.n > out.b / out.n + 0.5


def test_rare_words_have_restaurants(spark):
    """Words far below 1/4096 of all tokens, of one last byte, each with a word that follows it; the same scores from other partitions, blocks and numbers of buckets' files."""
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train, ask = [i for i in range(400) if not held(i)][:300], [i for i in range(400) if held(i)][:40]
    follows = lambda k: f"w{k % 20}"
    data = [(i, f"rare{n % 100}q {follows(n % 100)} " + "filler words here " * 40) for n, i in enumerate(train)]
    data += [(i, f"rare{n}q {follows(n if n % 2 else n + 1)}") for n, i in enumerate(ask)]
    assert sum(len(t.split()) + 1 for i, t in data if not held(i)) > 3 * 4096  # each of the rare words is there three times
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.score for r in hpylm.score(df, hpylm.held_out(), block=4000, bucket=3000).collect()}
    right, wrong = [got[i] for n, i in enumerate(ask) if n % 2], [got[i] for n, i in enumerate(ask) if not n % 2]
    assert min(right) > max(wrong) + 0.5
    assert got == {r.doc_id: r.score for r in hpylm.score(df.repartition(3, "text"), hpylm.held_out(), block=20_000, bucket=3000).collect()}


def test_predictions_add_up_to_one():
    rng = np.random.default_rng(5)
    parent = np.concatenate([np.arange(hpylm.CLASSES), [0, 0, 1]])
    every = np.array([0, 1, 256, 257, 258])
    word, context = np.repeat(np.arange(60), len(every)), np.tile(every, 60)
    counts = rng.geometric(0.2, len(word)) * (rng.random(len(word)) < 0.7)
    counts[word == 59] = 0  # the unknown word
    s = hpylm.Seating(word, context, counts, 60, parent)
    words = int(s.known.sum())
    customers = np.bincount(context[context > 255], counts[context > 255], hpylm.WIDTH)
    own, shared, tables, roots, top = s.sums(s.start())
    level = lambda d, t, *x: hpylm.Level(d, t, *map(np.asarray, x))
    totals = hpylm.Totals(int(counts.sum()), words, level(0.6, 2.0, customers, own), level(0.7, 1.0, shared, tables), level(0.5, 3.0, roots, top))
    for _ in range(40):
        for state in s.sweeps(totals, 1, rng):
            own, shared, tables, roots, top = s.sums(state)
            totals = hpylm.Totals(totals.tokens, words, level(0.6, 2.0, customers, own), level(0.7, 1.0, shared, tables), level(0.5, 3.0, roots, top))
    assert np.all(state[0] >= np.minimum(s.counts, 1)) and np.all(state[0] <= s.counts)
    # One unknown word stands for all: known ones and it make up each restaurant.
    assert abs(s.root(totals, state)[[*np.flatnonzero(s.known), 59]].sum() - 1) < 1e-9
    p = s.dishes(totals, state)
    for c in every:
        assert abs(p[(context == c) & (s.known[word] | (word == 59))].sum() - 1) < 1e-9


def test_strength_is_drawn_from_its_posterior():
    """Against the density on a grid: gamma prior times the chance of so many tables for so many customers."""
    rng = np.random.default_rng(3)
    customers, tables, discount = np.array([40.0, 7.0, 1.0, 300.0]), np.array([12.0, 3.0, 1.0, 60.0]), 0.4
    grid = np.linspace(0.01, 60, 6000)
    logp = -grid
    for c, t in zip(customers, tables, strict=True):
        logp = logp + sum(np.log(grid + discount * k) for k in range(1, int(t))) - sum(np.log(grid + k) for k in range(1, int(c)))
    weight = np.exp(logp - logp.max())
    want = (grid * weight).sum() / weight.sum()
    strength, drawn = 1.0, []
    for _ in range(6000):
        strength = hpylm.sample_strength(strength, discount, customers, tables, rng)
        drawn.append(strength)
    assert abs(np.mean(drawn[500:]) / want - 1) < 0.05


class ByHand:
    """The same model with every customer at a table of a list, taken out and seated again one at a time: nothing in common with the module but the definition."""

    def __init__(self, seed: int, discounts, strengths, words: int):
        self.rng, self.d, self.theta, self.words = np.random.default_rng(seed), discounts, strengths, words
        self.tables = defaultdict(lambda: defaultdict(list))  # restaurant -> word -> customers by table
        self.customers, self.count = Counter(), Counter()

    def up(self, r):
        return None if r == () else () if len(r) == 1 else r[:1]

    def level(self, r):
        return {2: 0, 1: 1, 0: 2}[len(r)]

    def p(self, r, w):
        if r is None:
            return 0.5 / self.words if w is not None else 0.5
        d, theta = self.d[self.level(r)], self.theta[self.level(r)]
        mine = self.tables[r].get(w, [])
        return (sum(mine) - d * len(mine) + (theta + d * self.count[r]) * self.p(self.up(r), w)) / (theta + self.customers[r])

    def add(self, r, w):
        if r is None:
            return
        d, theta = self.d[self.level(r)], self.theta[self.level(r)]
        mine = self.tables[r][w]
        weights = np.array([n - d for n in mine] + [(theta + d * self.count[r]) * self.p(self.up(r), w)])
        k = int(self.rng.choice(len(weights), p=weights / weights.sum()))
        self.customers[r] += 1
        if k == len(mine):
            mine.append(1)
            self.count[r] += 1
            self.add(self.up(r), w)
        else:
            mine[k] += 1

    def take(self, r, w):
        if r is None:
            return
        mine = self.tables[r][w]
        k = int(self.rng.choice(len(mine), p=np.array(mine) / sum(mine)))
        self.customers[r] -= 1
        mine[k] -= 1
        if not mine[k]:
            mine.pop(k)
            self.count[r] -= 1
            self.take(self.up(r), w)


def test_scores_against_a_sampler_by_hand(spark):
    """Mean log probability a token of each text, averaged over samples."""
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}{c}" for k in range(12) for c in "abc"]
    texts = []
    for i in range(70):
        now, words = int(rng.integers(36)), []
        for _ in range(30):
            now = int((now * 5 + rng.integers(0, 3)) % 36) if rng.random() < 0.8 else int(rng.zipf(1.5) % 36)
            words.append(vocabulary[now])
        if i % 10 == 0:
            words[5] = f"rare{i}"
        texts.append((i, " ".join(words)))
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    strengths = (2.0, 1.5, 1.0)
    got = {r.doc_id: r.score / r.n_tokens for r in hpylm.score(spark.createDataFrame(texts, "doc_id long, text string"), hpylm.held_out(), rounds=4, samples=30, block=4000, bucket=5000, contexts=40, strengths=strengths).collect()}
    tokens = {i: [*t.split(), "\n"] for i, t in texts}
    train = [w for i, ws in tokens.items() if not held(i) for w in ws]
    n = Counter(train)
    assert max(n.values()) > len(train) / 40
    # Words that make up a fortieth of all tokens.
    own, _ = hpylm.frequent(spark.createDataFrame(texts, "doc_id long, text string"), hpylm.held_out(), 40, 4000)
    has = {w for w in n if xxhash.xxh3_64_intdigest(w.encode()) in set(own.tolist())}
    assert len(has) > 5
    place = lambda before: (before[-1], before) if before in has else (before[-1],)
    runs = [(place(a), w) for i, ws in tokens.items() if not held(i) for a, w in zip(["\n", *ws], ws, strict=False)]
    pairs = Counter(runs)
    share = lambda counts: float(np.clip(sum(c == 1 for c in counts) / max(1, sum(c == 1 for c in counts) + 2 * sum(c == 2 for c in counts)), 0.1, 0.95))
    middle = Counter()
    for (r, w), c in pairs.items():
        middle[r[0], w] += 1 if len(r) == 2 else c
    top = Counter(w for _, w in middle)
    m = ByHand(4, (share([c for (r, _), c in pairs.items() if len(r) == 2]), share(middle.values()), share(top.values())), strengths, len(n))
    for r, w in runs:
        m.add(r, w)
    sums, taken = Counter(), 0
    every = [(i, place(a), w if w in n else None) for i, ws in tokens.items() for a, w in zip(["\n", *ws], ws, strict=False)]
    chance = defaultdict(float)
    for sweep in range(14):
        for r, w in runs:
            m.take(r, w)
            m.add(r, w)
        if sweep >= 4:
            taken += 1
            for r, w in {(r, w) for _, r, w in every}:
                chance[r, w] += m.p(r, w)
    for i, r, w in every:
        sums[i] += math.log10(chance[r, w] / taken)
    off = np.array([got[i] - sums[i] / len(tokens[i]) for i in tokens])
    assert abs(off.mean()) < 0.01 and np.abs(off).max() < 0.06, (off.mean(), np.abs(off).max())


def fingerprint(text: str) -> int:
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(prints: list[int], most: int = 3) -> list[int]:
    forest = simhash.Forest(len(prints))
    v = np.array(prints, np.uint64)
    forest.join(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= most))
    return forest.roots().tolist()


def test_near_duplicates(table):
    got = simhash.near_duplicates(table).collect()
    data = [(i, fingerprint(t or "")) for i, t, *_ in rows()]
    roots = closure([f for _, f in data])
    least = defaultdict(lambda: None)
    for (i, _), r in zip(data, roots, strict=True):
        if i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    want = sorted(((i, f"{f:016x}", least[r]) for (i, f), r in zip(data, roots, strict=True)), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want


@pytest.mark.parametrize("n", [0, 1, 2, 9, 600, 2500])
def test_linked_as_all_pairs(n):
    rng = np.random.default_rng(n)
    base = rng.integers(-(2**63), 2**63, max(1, n // 5), dtype=np.int64)
    near = [base ^ (np.int64(1) << rng.integers(0, 63)) ^ (np.int64(1) << rng.integers(0, 63)) for _ in range(4)]
    w = np.unique(np.concatenate([base, *near]))[:n]
    w = w[np.argsort(simhash.gray_rank(w))]
    want = closure(w.view(np.uint64).tolist())
    n = len(w)
    half = n // 2
    parts = [(w[:half], None, 0), (w[half:], None, half), (w[:half], w[half:], 0)]
    for cut in ([(w, None, 0)], parts):
        forest = simhash.Forest(n)
        for a, b, at in cut:
            if len(a) and (b is None or len(b)):
                e = np.array(simhash.linked(a, b, 3), np.int64).reshape(-1, 2) + at
                forest.join(e[:, 0], e[:, 1])
        assert forest.roots().tolist() == want


def test_gray_rank_orders_neighbours():
    n = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("largest", [3, 40, 8192])
def test_links_over_many_chunks(spark, largest):
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**63), 2**63, 300, dtype=np.int64)
    w = np.unique(np.concatenate([base] + [base ^ (np.int64(1) << rng.integers(0, 63)) for _ in range(3)]))
    distinct = spark.createDataFrame([(int(x),) for x in w], "fp long")
    edges = simhash.links(distinct, largest=largest, rows_a_task=1000).collect()
    place = {int(x): k for k, x in enumerate(w)}
    forest = simhash.Forest(len(w))
    forest.join(np.array([place[e.a] for e in edges]), np.array([place[e.b] for e in edges]))
    assert forest.roots().tolist() == closure(w.view(np.uint64).tolist())


def test_one_of_each(crowded):
    got = simhash.one_of_each(crowded)
    assert got.columns == crowded.columns
    assert one_of_each_group([(i, t) for i, t, *_ in rows()], got.collect())


def five_words(text: str | None) -> frozenset[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def one_of_each_group(data: list[tuple], kept: list) -> bool:
    """Whether `kept` has one row, of the least doc_id, for each group that a likeness of 0.8 or more connects."""
    sets = [five_words(t) for _, t in data]
    forest = simhash.Forest(len(data))
    pairs = [(i, j) for i in range(len(data)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    forest.join(*np.array(pairs, np.int64).reshape(-1, 2).T)
    least = {}
    for (i, _), r in zip(data, forest.roots().tolist(), strict=True):
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    return sorted(least.values()) == sorted((r.doc_id is None, r.doc_id or 0) for r in kept)


def test_one_of_each_of_edited_copies(spark):
    rng = np.random.default_rng(4)
    data = []
    for base in range(12):
        words = [f"w{x}" for x in rng.zipf(1.3, 300) % 5000]
        for copy in range(6):
            edited = list(words)
            for _ in range(copy):  # copies 0 to 5: by so many words, at places of their own
                edited[10 + 25 * copy + 50 * int(rng.integers(0, 3))] = f"new{rng.integers(0, 1 << 40)}"
            data.append((base * 100 + copy, " ".join(edited)))
        data.append((base * 100 + 50, " ".join(rng.permutation(words))))  # its words in another order are another text
        data.append((base * 100 + 60, " ".join(words[:150] + [f"v{x}" for x in rng.integers(0, 5000, 150)])))
    got = simhash.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert one_of_each_group(data, got) and len(got) == 36


def test_one_of_each_of_every_kind_of_edit(spark):
    """Copies of likeness 0.80 to 0.85 with a run of new words before or after, a part cut off, or edits far apart; the index alone misses most."""
    rng = np.random.default_rng(7)
    data = []
    for base in range(40):
        n = 200 + 10 * base
        words = [f"w{x}" for x in rng.zipf(1.3, n) % 50_000]
        least, part = 0.8 + 0.04 * rng.random(), [f"new{base}-{x}" for x in range(n)]
        more, less = int((n - 4) * (1 / least - 1)), n - int((n - 4) * (1 - least))
        spread = list(words)
        for k in range(int((n - 4) * (1 - least) / (1 + least) / 5)):  # each of them takes five shingles
            spread[7 + 6 * k] = part[k]
        edited = ([*part[:more], *words], [*words, *part[:more]], words[:less], spread)[base % 4]
        data += [(base * 10, " ".join(words)), (base * 10 + 1, " ".join(edited))]
    got = simhash.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert one_of_each_group(data, got) and len(got) == 40


def test_one_of_each_below_the_likeness(spark):
    """The rule is 0.8 itself: by one word more or less put after them, texts are copies or aren't, which sketches can't tell."""
    data = []
    for base in range(40):
        n = 154 + 4 * base  # words, so n - 4 shingles
        words = [f"b{base}-{x}" for x in range(n)]
        data += [(base * 10, " ".join(words)), (base * 10 + 1, " ".join([*words, *[f"more{base}-{x}" for x in range((n - 4) // 4 + base % 2)]]))]
    got = simhash.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert one_of_each_group(data, got) and len(got) == 60


def test_one_of_each_of_a_template(spark):
    """Many texts with up to five edits of one template, so that most pairs share shingles and lie around 0.8."""
    rng = np.random.default_rng(11)
    words = [f"w{x}" for x in range(150)]
    data = []
    for copy in range(160):
        edited = list(words)
        for at in rng.choice(150, copy % 6, replace=False):
            edited[at] = f"new{copy}-{at}"
        data.append((copy, " ".join(edited[: 150 - copy % 4])))
    got = simhash.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert one_of_each_group(data, got) and len(got) > 10


def test_parities_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 700):
        for k in (0, 1, 9, n):
            x = rng.integers(1 << 63, size=n + k, dtype=np.uint64)
            odd = [np.array(simhash.parities(part), np.int64) for part in (x[:n], x[k:])]
            assert np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum() <= 2 * k


def test_sketches_tell_likeness():
    rng = np.random.default_rng(2)
    found = {0.6: [], 0.9: [], 1.0: []}
    for share in found:
        for _ in range(200):
            n = int(rng.integers(40, 3000))
            common = int(round(2 * n * share / (1 + share)))
            own = [simhash.mixed(np.arange(k, k + n, dtype=np.uint64) + np.uint64(7)) for k in (0, n - common)]
            a, b = (np.frombuffer(simhash.sketch_of(x), "<u8") for x in own)
            found[share].append(bool(simhash.alike(np.stack([a, b]), np.array([0]), np.array([1]))[0]))
    assert np.mean(found[0.6]) < 0.1 and np.mean(found[0.9]) > 0.97 and all(found[1.0])


def test_shingles_are_sets_of_five_words():
    """Hashes are equal where five_words() are, in one text and between texts."""
    data = [t or "" for _, t, *_ in rows()]
    seen = {}
    for text, got in zip(data, simhash.shingles(data), strict=True):
        want = five_words(text)
        assert len(got) == len(want)
        assert {seen.setdefault(w, None) for w in want} <= {None}
        assert seen.setdefault(want, got.tolist()) == got.tolist()
    flat = {w for t in data for w in five_words(t)}
    assert len(np.unique(np.concatenate(simhash.shingles(data)))) == len(flat)


def test_words_within_most_bits_share_a_node():
    rng = np.random.default_rng(12)
    for most in (3, 4):
        masks = simhash.upper_masks(most)
        for _ in range(2000):
            flips = sum(1 << int(b) for b in rng.choice(64, most, replace=False))
            assert any(not flips & m for m in masks)


def test_components_of_long_chains(spark):
    from pulsegrid.llm.components import components

    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (2000, 2000)] + [(500, x) for x in range(300, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 201)} | {1001: 1000} | {x: 300 for x in (*range(301, 400), 500)}
    assert got == want


def test_prints(table):
    got = lzprint.edited_pairs(table).collect()
    assert len(got) == len(rows())
    ordered = sorted(((i, t or "") for i, t, *_ in rows() if i is not None and i < 40))
    by_id = {r.doc_id: r for r in got}
    for (i, text), (_, following) in zip(ordered, ordered[1:], strict=False):
        r, new = by_id[i], lzprint.edited(text, following)
        a, b, c = map(lzprint.fingerprint, (text, new, following))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (lzprint.digits(a), lzprint.digits(b))
        assert (r.near_edited, r.near_next) == (lzprint.likeness(a, b), lzprint.likeness(a, c))
    last, text = by_id[(1 << 60) + 1], "a very large id"
    news = {hashlib.sha256(lzprint.edited(text, t or "").encode()).hexdigest() for i, t, *_ in rows() if i is None}
    assert last.edited_sha256 in news  # nulls come first, and the last row's successor is the first


def test_phrases_by_hand():
    assert lzprint.phrases(b"a b a b a b a".split()) == {b" a", b" b", b" a b", b" a b a"}
    assert lzprint.phrases([]) == set() and lzprint.phrases([b"a", b"a"]) == {b" a", b" a "}
    assert lzprint.likeness(lzprint.fingerprint(""), lzprint.fingerprint(" ")) == 1.0
    assert lzprint.likeness(lzprint.fingerprint(""), lzprint.fingerprint("word")) == 0.0
    assert (lzprint.from_digits(lzprint.digits(lzprint.fingerprint("some words here"))) == lzprint.fingerprint("some words here")).all()


def lines_by_hand(data: list[tuple], least: int = 10) -> list[tuple]:
    split = [(i if i is not None else linededup.NO_ID, (t or "").split("\n")) for i, t, *_ in data]
    owner: dict[str, int] = {}
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, lines in split:
        for x in map(norm, lines):
            if len(x) >= least:
                owner[x] = min(i, owner.get(x, i))
    out = []
    for (i, lines), (real, *_) in zip(split, data, strict=True):
        stay = [x for x in lines if len(norm(x)) < least or owner[norm(x)] == i]
        out.append((real, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def test_lines(table):
    got = linededup.line_report(table).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(lines_by_hand(rows()), key=key)


def test_one_line_everywhere(spark):
    """A line that all documents hold spans many partitions."""
    data = [(i, f"the very same line\nown line number {i}\nthe very same line") for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, linededup.line_report(df).collect())) == sorted(lines_by_hand(data))


def test_bitmaps_round_trip():
    for positions in ([0], [7], [8], [3, 900], list(range(64))):
        bits = linededup.unpack_bits(linededup.pack_bits(np.array(positions)))
        assert np.flatnonzero(~bits).tolist() == positions and len(bits) == positions[-1] + 1


def test_dedup_rows(crowded):
    got = linededup.dedup_rows(crowded)
    assert got.columns == crowded.columns and got.count() == len(rows())
    assert got.filter("text is null").count() == sum(t is None for _, t, *_ in rows())
    want = Counter(h for *_, h in lines_by_hand(rows()))
    assert Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in got.collect()) == want


def test_quality(table, labels):
    got = quality.quality_scores(table, labels).collect()
    assert len(got) == len(rows())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_learns(spark):
    rng = np.random.default_rng(1)
    good = [(i, " ".join(f"word{w}" for w in rng.integers(0, 500, 60)), 1) for i in range(200)]
    bad = [(1000 + i, " ".join(f"WORD{w}!!" for w in rng.integers(0, 5, 60)), 0) for i in range(60)]
    both_ = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(both_.select("doc_id", "text"), both_.select("doc_id", "quality")).collect()}
    held = [(got[i].predicted, q) for i, _, q in good + bad if got[i].held_out]
    assert len(held) > 20 and np.mean([p == q for p, q in held]) > 0.95
    other = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in good + bad], "doc_id long, quality int")
    same = quality.quality_scores(both_.select("doc_id", "text"), other).collect()
    assert all(got[r.doc_id].score == r.score for r in same)  # held-out labels teach nothing
    kept = quality.accepted(both_.select("doc_id", "text"), both_.select("doc_id", "quality"))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_quality_fits_in_a_task(spark, monkeypatch):
    """The driver never holds the sample's features: neither their table nor the matrix that the fit works on."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_, **__):
        raise AssertionError("on the driver")

    docs = spark.createDataFrame([(i, "word " * (i % 7) + "!" * (i % 3)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int")
    want = quality.learn(docs, labels, pairs=50)
    for name in ("toArrow", "toPandas", "collect"):
        monkeypatch.setattr(DataFrame, name, lambda self, _whole=getattr(DataFrame, name), _name=name: _whole(self) if self.schema.names[-1] == "shift" and _name == "collect" else refuse())
    got = quality.learn(docs, labels, pairs=50)
    assert (got.weight == want.weight).all() and (got.center == want.center).all() and got.shift == want.shift and np.abs(got.weight).max() > 0


def features_by_hand(text: str) -> list[float]:
    raw = text.encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", low) if w]
    n, k = max(1, len(raw)), max(1, len(words))
    upper = sum(65 <= c <= 90 for c in raw)
    digit = sum(48 <= c <= 57 for c in raw)
    letter = sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in raw)
    symbol = sum(not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128 or 48 <= c <= 57 or c in b" \t\n\x0b\x0c\r.,'-") for c in raw)
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    lines, distinct = raw.split(b"\n"), len(set(words))
    out = [math.log(1 + len(words)), upper / max(1, letter), symbol / n, symbol / k, raw.count(b"!") / n, digit / n, sum(c >= 128 for c in raw) / n, max(1, letter) / n]
    out += [mean, math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes)), distinct / k, math.log(k / max(1, distinct)), sum(a == b for a, b in zip(words, words[1:], strict=False)) / k]
    out += [1 - len(set(lines)) / len(lines), math.log(1 + len(lines)), raw.count(b".") / k, raw.count(b",") / k]
    by_word, by_run = [0] * 256, [0] * 256
    for w in words:
        by_word[xxhash.xxh32_intdigest(w) % 256] += 1
    for i in range(len(low) - 2):
        by_run[int.from_bytes(low[i : i + 3], "big") * 2654435761 % (1 << 32) >> 24] += 1
    return out + [math.sqrt(x / k) for x in by_word] + [math.sqrt(x / max(1, len(low) - 2)) for x in by_run]


def test_quality_by_hand(table, labels):
    """The ranking fitted by plain descent on the same pairs."""
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            known[r.doc_id] = min(r.quality, known.get(r.doc_id, 1))
    data = {i: t or "" for i, t, *_ in rows() if i in known}
    ids = sorted(data)
    x = np.array([features_by_hand(data[i]) for i in ids], np.float32).astype(np.float64)
    label = np.array([known[i] for i in ids])
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale <= 1e-9] = 1
    z = np.clip((x - center) / scale, -20, 20)
    better, worse = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    pairs = 200
    d = z[np.random.default_rng(10).choice(better, pairs)] - z[worse[np.arange(pairs) % len(worse)]]
    w, rate = np.zeros(z.shape[1]), 1 / (np.linalg.norm(d, 2) ** 2 / pairs / 4 + 1e-3)
    before = w
    for k in range(60_000):  # accelerated descent
        ahead = w + k / (k + 3) * (w - before)
        gradient = 1e-3 * ahead - d.T @ (1 / (1 + np.exp(d @ ahead))) / pairs
        before, w = w, ahead - rate * gradient
        if np.abs(gradient).max() < 1e-9:
            break
    shift = math.log(0.3 / 0.7) - float(np.quantile(np.sort(z @ w), len(worse) / len(ids), method="midpoint"))
    got = quality.quality_scores(table, labels, pairs=pairs).collect()
    texts_ = defaultdict(set)
    for i, t, *_ in rows():
        texts_[i].add(t or "")
    for r in got:
        want = [1 / (1 + math.exp(-min(500, max(-500, float(np.clip((np.array(features_by_hand(t), np.float32) - center) / scale, -20, 20) @ w + shift))))) for t in texts_[r.doc_id]]
        assert min(abs(r.score - v) for v in want) < 1e-4


def prints_by_hand(text: str) -> set[int]:
    """Phrases as tuples of words cut at 32 bytes: the longest known one and a word more; the last may be unfinished."""
    words = []
    for w in re.split(rb"[\x20\x09-\x0d]+", text.encode()):
        while len(w) > 32:
            words.append(w[:32])
            w = w[32:]
        if w:
            words.append(w)
    known, at, phrases = set(), 0, set()
    while at < len(words):
        n = 1
        while at + n <= len(words) and tuple(words[at : at + n]) in known:
            n += 1
        phrase = tuple(words[at : at + n])
        if phrase in known:  # the text ends within it
            phrases.add(b"".join(b" " + w for w in phrase) + b" ")
        else:
            known.add(phrase)
            phrases.add(b"".join(b" " + w for w in phrase))
        at += n
    return {xxhash.xxh32_intdigest(p) for p in phrases}


def test_prints_by_hand(spark):
    """The whole query over rows in order of doc_id, nulls and repeated ids apart, against sets of phrases."""
    data = [(i, t) for i, t, *_ in rows() if i is not None and i not in (105, 106)]
    data.sort()
    got = {r.doc_id: r for r in lzprint.edited_pairs(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    few = lambda s: sorted(s)[:64]

    def near(a: set, b: set) -> float:
        a, b = set(few(a)), set(few(b))
        if not a or not b:
            return float(a == b)
        both = few(a | b)
        return sum(x in a and x in b for x in both) / len(both)

    assert len(got) == len(data)
    for k, (i, text) in enumerate(data):
        text, following = text or "", data[(k + 1) % len(data)][1] or ""
        n = len(text) // 4
        new = text[: len(text) - n] + following[:n]
        own, its, after = map(prints_by_hand, (text, new, following))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x:08x}" for x in few(own)) and r.edited_fingerprint == "".join(f"{x:08x}" for x in few(its))
        assert abs(r.near_edited - near(own, its)) < 1e-12 and abs(r.near_next - near(own, after)) < 1e-12


def test_empty_tables(nothing, labels):
    assert sharding.shard_by_bytes(nothing).count() == 0
    assert packing.pack(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_rows(nothing).count() == 0
    assert hpylm.score(nothing, hpylm.held_out()).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0
    assert lzprint.edited_pairs(nothing).count() == 0
    assert linededup.line_report(nothing).count() == 0 and linededup.dedup_rows(nothing).count() == 0
    assert quality.quality_scores(nothing, labels.limit(0)).count() == 0 and quality.accepted(nothing, labels).count() == 0


def test_no_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = hpylm.score(spark.createDataFrame([(held, "two words")], "doc_id long, text string"), hpylm.held_out()).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_single_document_follows_itself(spark):
    r = lzprint.edited_pairs(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0


def test_language_model_is_one_however_rows_lie(spark):
    """The same scores and the same restaurants from one, four and sixteen partitions, in another order, in blocks of another size; words are as frequent as counted by hand."""
    data = [(i, t) for i, t in enumerate(texts(400, 9))] + [(1000 + i, "topic " * 40 + texts(1, i)[0]) for i in range(12)]  # a word of one corner of the table
    df = spark.createDataFrame(data, "doc_id long, text string")
    layouts = [df.coalesce(1), df.repartition(4, "text"), df.repartitionByRange(16, F.desc("doc_id")), df.coalesce(1)]
    counts = Counter(w for i, t in data if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.lower().split(), "\n"])
    n = sum(counts.values())
    seen, words = [], []
    for x, block in zip(layouts, (9000, 9000, 9000, 2000), strict=True):
        words.append(hpylm.frequent(x, hpylm.held_out(), 150, block))
        seen.append(sorted(tuple(r) for r in hpylm.score(x, hpylm.held_out(), block=block, bucket=4000, contexts=150).collect()))
    assert seen[0] == seen[1] == seen[2] == seen[3]
    want = sorted(xxhash.xxh3_64_intdigest(w.encode()) for w, c in counts.items() if c * 150 >= n)
    assert all(w.tolist() == want for w, _ in words) and len(want) > 5
