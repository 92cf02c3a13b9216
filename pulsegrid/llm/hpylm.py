"""A hierarchical Pitman-Yor language model, scored over whole texts.

A word is drawn in the restaurant of the word before it. All words have restaurants of their own; these share parents, one for each last byte of the word before; the parents
share the root restaurant of the vocabulary, over a base that gives half its mass to the unknown word and the rest evenly to the known ones. (A text's first word follows the
end token.) With `contexts`, only words that make up a share of 1 / `contexts` of all training tokens have restaurants, and words after other ones are drawn in the parents. Counts
are exact, so the model and all scores are the same however the table's rows lie in files and partitions.

Seatings are sampled by Gibbs: given everything else, the customers of a dish in a restaurant are seated again one after another (those
beyond the 32nd in batches of a twentieth, with the chance of a new table held within a batch; each table counts as a customer above at once), first in the restaurants of words, then, as
many customers as these have tables (and those who come directly), in their parents, then in the root. A word's seating depends on other words through the
restaurants' numbers of customers and tables only, so words are sampled in parallel, hashed to buckets, against the table counts of the round before. After each round
the tables of words' restaurants are summed by parts, hashed by context, and each bucket gets back the sums of the contexts that it has; each level's strength is sampled from them
(auxiliary variables, gamma prior). Predictive probabilities are averaged over the samples of the last round.

Texts become blocks of places in lists of words, written once; a block sends each bucket of words what it holds of them, packed (words, contexts,
training counts), and gets back counts and probabilities in the same order. Blocks, buckets and parts are written by their keys, so that only what changes is shuffled in
a round: a number per bucket and context, each way. Collected are sums by class, and two numbers per part.

Words are told apart by 48 bits of a hash and their last byte.

Discounts are n1 / (n1 + 2 n2) for each level, from the numbers of dishes served once and twice.

Defined cases: a null or empty text is the end token only; a very long text is scored whole; A-Z are lower-cased, words are runs of anything but ASCII white space; a null doc_id
trains; repeated rows count and are scored each; without training rows every token
is the unknown word, of probability 1; an empty table gives an empty result; other input columns are ignored. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import dealt, drop, text_or_empty, written

END = b"\n"  # no word holds it, and it is the context of a text's first word
CLASSES = 256  # parents, by last byte; contexts from this number on are words
WIDTH = 1 << 16  # of arrays by context that hold frequent words only
UNKNOWN_MASS = 0.5
SLICE = 200_000  # words coded at once


def pack(v: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs, byte planes apart, compressed."""
    v = np.asarray(v, "<i8")
    width = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(v.view("u1").reshape(-1, 8).T[:width])
    return len(v).to_bytes(8, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(x: bytes) -> np.ndarray:
    n, width = int.from_bytes(x[:8], "little"), x[8]
    planes = np.zeros((8, n), "u1")
    planes[:width] = np.frombuffer(pa.decompress(x[9:], n * width, codec="zstd", asbytes=True), "u1").reshape(width, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def pack_ascending(v: np.ndarray) -> bytes:
    return pack(np.diff(v, prepend=0))


def unpack_ascending(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x))


def joined(packed: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What was packed, end to end, and the size of each part."""
    parts = [unpack(x) for x in packed]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array([len(x) for x in parts], np.int64)


class Block:
    """Documents as places of their words in a list of words, in order of appearance (frequent ones have small places, so their bytes compress).

    A word's id is 48 bits of its hash and its last byte. `own` are the hashes, ascending, of words with restaurants; None: all words have one."""

    def __init__(self, own: np.ndarray | None) -> None:
        self.own = own
        self.codes: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.tokens: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.held: list[bool] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, held: bool, text: str) -> None:
        raw = text.encode().lower()
        words = raw.split()
        self.words += words
        self.words.append(END)
        self.ids.append(doc_id)
        self.held.append(held)
        self.lengths.append(len(words) + 1)
        self.size += len(raw) + 1
        if len(self.words) >= SLICE:
            self.code()

    def code(self) -> None:
        x = pa.array(self.words, pa.large_binary()).dictionary_encode()
        codes = self.codes
        own = np.fromiter((codes.setdefault(w, len(codes)) for w in x.dictionary.to_pylist()), np.int32, len(x.dictionary))
        self.tokens.append(own[x.indices.to_numpy()])
        self.words = []

    def row(self, block: int) -> dict:
        if self.words:
            self.code()
        types = list(self.codes)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, types), np.uint64, len(types))
        ids = (hashes >> np.uint64(16) << np.uint64(8)).astype(np.int64) + np.fromiter((w[-1] for w in types), np.int64, len(types))
        own = np.ones(len(types), np.int64) if self.own is None else np.isin(hashes, self.own)
        return {"block": block, "doc_ids": np.array([i or 0 for i in self.ids], "<i8").tobytes(), "no_id": bytes(i is None for i in self.ids), "held": bytes(self.held), "lengths": pack(self.lengths), "ids": pack(ids), "own": pack(own), "end": self.codes[END], "tokens": pack(np.concatenate(self.tokens))}


TEXTS = pa.schema([("block", pa.int64()), ("end", pa.int64()), *[(c, pa.binary()) for c in ("doc_ids", "no_id", "held", "lengths", "ids", "own", "tokens")]])
TEXTS_SQL = "block long, end long, doc_ids binary, no_id binary, held binary, lengths binary, ids binary, own binary, tokens binary"


@dataclass(frozen=True)
class Pairs:
    """A block's distinct pairs of word and context, in order of the word's bucket, its place in the block, and the context's id."""

    words: np.ndarray  # ids, in order of bucket
    bucket: np.ndarray  # of each of them
    contexts: np.ndarray  # distinct ids, ascending; those below CLASSES are parents
    word: np.ndarray  # of each pair, its place in words
    context: np.ndarray  # of each pair, its place in contexts
    tokens: np.ndarray  # of each token, its pair
    lengths: np.ndarray  # tokens of each document

    @staticmethod
    def of(row: dict | pd.Series, buckets: int) -> Pairs:
        ids, tokens = unpack(row["ids"]), unpack(row["tokens"])
        contexts, context = np.unique(np.where(unpack(row["own"]) > 0, ids, ids % CLASSES), return_inverse=True)
        bucket = bucket_of(ids, buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        keys = place[tokens] * len(contexts)
        keys[0] += context[row["end"]]
        keys[1:] += context[tokens[:-1]]
        pairs, tokens = np.unique(keys, return_inverse=True)
        word, context = np.divmod(pairs, len(contexts))
        return Pairs(ids[order], bucket[order], contexts, word, context, tokens, unpack(row["lengths"]))

    def rows(self, block: int, held: np.ndarray) -> Iterator[tuple]:
        """For each bucket: the ids of its words, how many contexts each has, the contexts' ids, the place among them of each pair's context, and how often the pair is in training text."""
        counts = np.bincount(self.tokens[np.repeat(~held, self.lengths)], minlength=len(self.word))
        n = np.bincount(self.word, minlength=len(self.words))
        until = np.concatenate([[0], np.cumsum(n)])
        present, start = np.unique(self.bucket, return_index=True)
        for b, i, j in zip(present.tolist(), start.tolist(), [*start.tolist()[1:], len(self.words)], strict=True):
            part = slice(until[i], until[j])
            has, at = np.unique(self.context[part], return_inverse=True)
            yield b, block, pack(self.words[i:j]), pack(n[i:j]), pack_ascending(self.contexts[has]), pack(at), pack(counts[part])


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids >> 8) % buckets


def _counted(docs: DataFrame, held: Column, size: int, report: Callable[[pa.Array, np.ndarray, int], Iterator[tuple]]) -> DataFrame:
    """word, last, n: what report(words, counts, tokens) gives of each `size` bytes of training text, summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[bytes] = []
        used = 0

        def close() -> pa.RecordBatch:
            got = pa.array(words, pa.large_binary()).value_counts()
            word, last, n = zip(*report(got.field("values"), got.field("counts").to_numpy(), len(words)), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(np.array(word, np.uint64).view(np.int64)), pa.array(last, pa.int32()), pa.array(n, pa.int64())], ["word", "last", "n"])

        for batch in batches:
            for text in batch.column(0):
                raw = text.as_py().encode().lower()
                words += raw.split()
                words.append(END)
                used += len(raw) + 1
                if used >= size:
                    yield close()
                    words, used = [], 0
        if words:
            yield close()

    found = docs.filter(~held).select(text_or_empty().alias("text")).mapInArrow(count, "word long, last int, n long")
    return found.groupBy("word", "last").agg(F.sum("n").alias("n"))


ALL_TOKENS = -1  # in place of a last byte: the row counts tokens


def frequent(docs: DataFrame, held: Column, contexts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the words that make up a share of 1 / `contexts` of all training tokens, and their last bytes: at most `contexts`, the same ones however rows lie.

    A block of text reports the words that have half that share in it. What is missed of a word so comes to less than half that share of all tokens, so each frequent word is among
    those reported for at least half of it, which are at most 2 * `contexts`. These are counted in a second pass."""
    hashed = lambda words: np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def often(values: pa.Array, n: np.ndarray, tokens: int) -> Iterator[tuple]:
        some = np.flatnonzero(n * 2 * contexts >= tokens)
        words = values.take(pa.array(some)).to_pylist()
        yield 0, ALL_TOKENS, tokens
        yield from zip(hashed(words), [w[-1] for w in words], n[some], strict=True)

    reported = written(_counted(docs, held, size, often), "hpy-reported")
    tokens = reported.filter(F.col("last") == ALL_TOKENS).agg(F.sum("n")).first()[0] or 0
    maybe = {r["word"] % (1 << 64) for r in reported.filter((F.col("last") != ALL_TOKENS) & (F.col("n") * 2 * contexts >= tokens)).select("word").collect()}
    drop(reported)
    if not maybe:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def exactly(values: pa.Array, n: np.ndarray, _: int) -> Iterator[tuple]:
        words = values.to_pylist()
        hashes = hashed(words)
        yield 0, ALL_TOKENS, 0
        for i in np.flatnonzero(np.isin(hashes, np.array([*maybe], np.uint64))):
            yield hashes[i], words[i][-1], n[i]

    rows = _counted(docs, held, size, exactly).filter((F.col("last") != ALL_TOKENS) & (F.col("n") * contexts >= tokens)).collect()
    words = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([r["last"] for r in rows], np.int64)[order]


def texts_of(docs: DataFrame, held: Column, size: int, own: np.ndarray | None) -> DataFrame:
    """A row per block of `size` bytes of text or more."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, part = Block(own), 0, 0
        for batch in batches:
            for p, doc_id, out, text in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                part = p.as_py()
                now.add(doc_id, out, text.as_py())
                if now.size >= size:
                    yield pa.RecordBatch.from_pylist([now.row((part << 32) + n)], schema=TEXTS)
                    now, n = Block(own), n + 1
        if now.ids:
            yield pa.RecordBatch.from_pylist([now.row((part << 32) + n)], schema=TEXTS)

    x = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), text_or_empty().alias("text"))
    return x.mapInArrow(build, TEXTS_SQL)


@dataclass(frozen=True)
class Level:
    """Restaurants of one level, by context: what a word's seating needs to know of all other words in them."""

    discount: float
    strength: float
    customers: np.ndarray
    tables: np.ndarray

    def weight(self, context: np.ndarray) -> np.ndarray:
        """What a new table weighs, before the parent's probability."""
        return self.strength + self.discount * self.tables[context]

    def below(self, context: np.ndarray) -> np.ndarray:
        return self.strength + self.customers[context]

    def seated(self, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator | None) -> Level:
        """With new numbers, and a strength sampled for them (the same one, without rng)."""
        strength = self.strength if rng is None else sample_strength(self.strength, self.discount, customers, tables, rng)
        return Level(self.discount, strength, customers, tables)


@dataclass(frozen=True)
class Totals:
    tokens: int
    words: int
    own: Level  # by context, from CLASSES on; in `learn` only the strength and discount, each bucket has the numbers of its contexts
    shared: Level  # by class
    root: Level  # one restaurant

    @property
    def unknown(self) -> float:
        return UNKNOWN_MASS if self.words else 1.0

    @property
    def base(self) -> float:
        """Of a known word."""
        return (1 - self.unknown) / max(1, self.words)


def sample_strength(strength: float, discount: float, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator, first: int = 4096) -> float:
    """A draw of the strength that these restaurants share, given their numbers of customers and tables, for a gamma prior of shape and rate 1.

    For each restaurant: the log of a beta variable, and for each table but the first a coin that tells whether the strength rather than the discount opened it. Coins of tables
    beyond `first` are rare and independent, so their number is drawn as a Poisson variable of the same mean."""
    return strength_from(*strength_terms(strength, discount, customers, tables, rng, first), rng)


def strength_terms(strength: float, discount: float, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator, first: int = 4096) -> tuple[float, float]:
    """These restaurants' share of the logs and of the coins; shares of several groups of restaurants add up."""
    c, t = customers[customers > 1], tables[customers > 1]
    logs = np.log(np.maximum(rng.beta(strength + 1, c - 1), 1e-300)).sum() if len(c) else 0.0
    at = np.arange(1, first)
    having = len(t) - np.searchsorted(np.sort(t), at, side="right")
    coins = rng.binomial(having, strength / (strength + discount * at)).sum()
    more = t[t > first]
    coins += rng.poisson((strength / discount * np.log((strength + discount * more) / (strength + discount * first))).sum()) if len(more) else 0
    return float(logs), float(coins)


def strength_from(logs: float, coins: float, rng: np.random.Generator) -> float:
    return float(np.clip(rng.gamma(1 + coins, 1 / (1 - logs)), 1e-3, 1e9))


@dataclass(frozen=True)
class Weight:
    """What a new table weighs for each dish: `now` with the tables that it had `before`; each table more or less adds or takes `slope`, being a customer of the parent; at least `least`, what the grandparent alone gives."""

    now: np.ndarray
    slope: np.ndarray
    before: np.ndarray
    least: np.ndarray

    def of(self, which: np.ndarray | slice) -> Weight:
        return Weight(self.now[which], self.slope[which], self.before[which], self.least[which])

    def at(self, tables: np.ndarray) -> np.ndarray:
        n = len(tables)
        return np.maximum(self.now[:n] + self.slope[:n] * (tables - self.before[:n]), self.least[:n])


def fixed_weight(now: np.ndarray) -> Weight:
    """For what has no restaurant above."""
    return Weight(now, np.zeros(len(now)), np.zeros(len(now)), now)


def _seated_once(counts: np.ndarray, weight: Weight, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each dish, its customers seated one by one, and the logarithm of how likely the dish made all of them come: what this way of seating doesn't look ahead to."""
    tables, likely = np.minimum(counts, 1).astype(np.float64), np.zeros(len(counts))
    n, active = 1, int(np.searchsorted(-counts, -1, side="left"))
    while active:
        t = tables[:active]
        a = weight.at(t)
        whole = a + n - discount * t
        if n < 32:
            likely[:active] += np.log(whole)
            t += rng.random(active) * whole < a
            n += 1
        else:
            step = np.minimum(counts[:active] - n, max(1, n // 20))
            likely[:active] += step * np.log(whole)
            t += rng.binomial(step, a / whole)
            n += max(1, n // 20)
        active = int(np.searchsorted(-counts[:active], -n, side="left"))
    return tables, likely


def seat(counts: np.ndarray, weight: Weight, discount: float, rng: np.random.Generator, ways: int = 3) -> np.ndarray:
    """Tables of each dish: one of several seatings, drawn by how likely each made the customers come. counts must descend."""
    counts = counts.astype(np.int64)
    some = int(np.searchsorted(-counts, -1, side="left"))  # single customers have one table
    tables, best = np.minimum(counts, 1).astype(np.float64), np.full(some, -np.inf)
    part = weight.of(slice(0, some))
    for _ in range(ways if some else 0):
        got, likely = _seated_once(counts[:some], part, discount, rng)
        score = likely + rng.gumbel(size=some)
        better = score > best
        tables[:some][better], best = got[better], np.maximum(best, score)
    return tables


class Seating:
    """The dishes of one bucket: word, context and count of each. A node is a word in a parent restaurant."""

    def __init__(self, word: np.ndarray, context: np.ndarray, counts: np.ndarray, n_words: int, parent: np.ndarray):
        own = context >= CLASSES
        nodes, self.node = np.unique(word * CLASSES + parent[context], return_inverse=True)
        self.word, self.shared = np.divmod(nodes, CLASSES)
        self.direct = np.bincount(self.node[~own], counts[~own], len(nodes))
        self.n_words, self.n_contexts = n_words, len(parent)
        self.total = np.bincount(word, counts, n_words)
        self.known = self.total > 0
        self.at = np.flatnonzero(own)
        self.at = self.at[np.argsort(-counts[self.at], kind="stable")]  # dishes of words' own restaurants, in descending order of counts
        self.context, self.counts, self.up = context[self.at], counts[self.at], self.node[self.at]

    def start(self) -> tuple[np.ndarray, ...]:
        """One table for each dish: its tables, customers and tables by node, and by word in the root."""
        seated = np.minimum(self.counts, 1)
        customers = self.direct + np.bincount(self.up, seated, len(self.word))
        tables = np.minimum(customers, 1)
        roots = np.bincount(self.word, tables, self.n_words)
        return seated, customers, tables, roots, np.minimum(roots, 1)

    def root(self, totals: Totals, state: tuple[np.ndarray, ...]) -> np.ndarray:
        """Probabilities in the root, by word."""
        _, _, _, customers, tables = state
        base = np.where(self.known, totals.base, totals.unknown)
        return (customers - totals.root.discount * tables + totals.root.weight(0) * base) / totals.root.below(0)

    def parents(self, totals: Totals, state: tuple[np.ndarray, ...]) -> np.ndarray:
        """Probabilities in the parents, by node."""
        _, customers, tables, *_ = state
        return (customers - totals.shared.discount * tables + totals.shared.weight(self.shared) * self.root(totals, state)[self.word]) / totals.shared.below(self.shared)

    def dishes(self, totals: Totals, state: tuple[np.ndarray, ...]) -> np.ndarray:
        """Probabilities of all dishes, in the order given."""
        middle = self.parents(totals, state)
        out = middle[self.node]
        out[self.at] = (self.counts - totals.own.discount * state[0] + totals.own.weight(self.context) * middle[self.up]) / totals.own.below(self.context)
        return out

    def sweeps(self, totals: Totals, n: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, ...]]:
        """The state after each sweep, as start() gives it."""
        state = self.start()
        for _ in range(n):
            root, middle = self.root(totals, state), self.parents(totals, state)
            own, up = totals.own.weight(self.context), self.shared[self.up]
            above = totals.shared.weight(self.shared) * root[self.word]
            seated = seat(self.counts, Weight(own * middle[self.up], own / totals.shared.below(up), state[0], own * above[self.up] / totals.shared.below(up)), totals.own.discount, rng)
            customers = self.direct + np.bincount(self.up, seated, len(self.word))
            base = np.where(self.known, totals.base, totals.unknown)
            shared, top = totals.shared.weight(self.shared), totals.root.weight(0) / totals.root.below(0) * base[self.word]
            tables = _seat_any(customers, Weight(above, shared / totals.root.below(0), state[2], shared * top), totals.shared.discount, rng)
            roots = np.bincount(self.word, tables, self.n_words)
            state = seated, customers, tables, roots, _seat_any(roots, fixed_weight(np.full(self.n_words, totals.root.weight(0) * totals.base)), totals.root.discount, rng)
            yield state

    def sums(self, state: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """Tables by context, customers and tables by class, and of the root."""
        seated, customers, tables, roots, top = state
        return [np.bincount(self.context, seated, self.n_contexts), np.bincount(self.shared, customers, CLASSES), np.bincount(self.shared, tables, CLASSES), [roots.sum()], [top.sum()]]


def _seat_any(counts: np.ndarray, weight: Weight, discount: float, rng: np.random.Generator) -> np.ndarray:
    down = np.argsort(-counts, kind="stable")
    out = np.zeros(len(counts))
    out[down] = seat(counts[down], weight.of(down), discount, rng)
    return out


TABLE = ["bucket", "n_words", "blocks", "entries", "word", "contexts", "context", "counts", "ids", "sums"]
TABLE_SQL = "bucket long, n_words long, blocks binary, entries binary, word binary, contexts binary, context binary, counts binary, ids binary, sums binary"


def gathered(x: pd.DataFrame) -> pd.DataFrame:
    """One row of a bucket's rows from all blocks: words and contexts get numbers (contexts with restaurants from CLASSES on, in order of `ids`); pairs stay in order of block."""
    x = x.sort_values("block")
    words, entries = joined(x["words"])
    known, sizes = zip(*[(k, len(k)) for k in map(unpack_ascending, x["ids"])], strict=True)
    at, pairs = joined(x["context"])
    words, word = np.unique(words, return_inverse=True)
    ids, number = np.unique(np.concatenate(known), return_inverse=True)
    local = np.where(ids < CLASSES, ids, CLASSES + np.arange(len(ids)) - (ids < CLASSES).sum())
    context = local[number[at + np.repeat(np.cumsum(sizes) - sizes, pairs)]]
    ids = ids[ids >= CLASSES]
    row = [x["bucket"].iloc[0], len(words), pack(x["block"]), pack(entries), pack(word), pack(joined(x["n"])[0]), pack(context), pack(joined(x["counts"])[0]), pack_ascending(ids), b""]
    out = pd.DataFrame([row], columns=TABLE)
    s = Bucket(out.iloc[0]).seating()
    state = s.start()
    served = [(v == k).sum() for v in (s.counts, state[1], state[3]) for k in (1, 2)]
    out["sums"] = [_flat([*s.sums(state)[1:], [s.total.sum(), s.known.sum()], served])]
    return out


class Bucket:
    """A row of `gathered`, its dishes numbered by word and context."""

    def __init__(self, row: pd.Series) -> None:
        self.number, self.n_words = int(row["bucket"]), int(row["n_words"])
        self.blocks, self.entries, self.ids = unpack(row["blocks"]), unpack(row["entries"]), unpack_ascending(row["ids"])
        self.words, self.contexts = unpack(row["word"]), unpack(row["contexts"])
        self.parent = np.concatenate([np.arange(CLASSES), self.ids % CLASSES])
        keys = np.repeat(self.words, self.contexts) * len(self.parent) + unpack(row["context"])
        dishes, self.at = np.unique(keys, return_inverse=True)
        self.n = np.bincount(self.at, unpack(row["counts"]), len(dishes)).astype(np.int64)
        self.word, self.context = np.divmod(dishes, len(self.parent))

    def seating(self, untrained: bool = False) -> Seating:
        some = slice(None) if untrained else self.n > 0
        return Seating(self.word[some], self.context[some], self.n[some], self.n_words, self.parent)

    def parts(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """Contexts are summed over all buckets in parts, by their ids: each part and the places in `ids` of its contexts."""
        part = bucket_of(self.ids, buckets)
        order = np.argsort(part, kind="stable")
        present, start = np.unique(part[order], return_index=True)
        return [*zip(present.tolist(), np.split(order, start[1:]), strict=True)] if len(present) else []

    def spread(self, summed: pd.DataFrame, name: str, buckets: int) -> np.ndarray:
        """By context, what the parts sent back; 0 for parents."""
        out = np.zeros(len(self.parent))
        for (_, places), x in zip(self.parts(buckets), summed.sort_values("part")[name], strict=True):
            out[CLASSES + places] = unpack(x)
        return out


def _flat(sums: list) -> bytes:
    return np.concatenate([np.asarray(s, "<f8") for s in sums]).tobytes()


def _added(rows: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """Sums of what _flat() gave in the column sums."""

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for one in x["sums"]:
                yield _keyed([np.frombuffer(one, "<f8")])

    return _sums(rows.select("sums").mapInPandas(cells, "key int, value double"), sizes)


def _sums(rows: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """Sums of rows(key, value) as arrays of these sizes, one after another in the order of keys."""
    got = rows.groupBy("key").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(sum(sizes))
    for r in got:
        flat[r["key"]] = r["value"]
    return np.split(flat, np.cumsum(sizes)[:-1])


def _keyed(sums: list) -> pd.DataFrame:
    flat = np.concatenate([np.asarray(s, np.float64) for s in sums])
    some = np.flatnonzero(flat)
    return pd.DataFrame({"key": some, "value": flat[some]})


STATE = [CLASSES, CLASSES, 1, 1]  # sizes of Seating.sums() but for words' own restaurants


def linked(table: DataFrame, buckets: int) -> DataFrame:
    """part, bucket, place, customers, tables: for the contexts that a bucket has in a part (ascending), their places among the part's contexts, and customers and, at the start, tables of their whole restaurants."""

    def up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for _, row in x.iterrows():
                b = Bucket(row)
                s = b.seating()
                customers, tables = np.bincount(s.context, s.counts, s.n_contexts).astype(np.int64)[CLASSES:], s.sums(s.start())[0].astype(np.int64)[CLASSES:]
                out = [(part, b.number, pack_ascending(b.ids[at]), pack(customers[at]), pack(tables[at])) for part, at in b.parts(buckets)]
                yield pd.DataFrame(out, columns=["part", "bucket", "ids", "customers", "tables"])

    def link(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("bucket")
        ids = [unpack_ascending(i) for i in x["ids"]]
        _, place = np.unique(np.concatenate(ids), return_inverse=True)
        cut = np.cumsum([len(i) for i in ids])[:-1]
        total = lambda name: np.bincount(place, joined(x[name])[0]).astype(np.int64)[place]
        split = lambda v: [pack(i) for i in np.split(v, cut)]
        return pd.DataFrame({"part": x["part"].to_numpy(), "bucket": x["bucket"].to_numpy(), "place": split(place), "customers": split(total("customers")), "tables": split(total("tables"))})

    x = table.mapInPandas(up, "part long, bucket long, ids binary, customers binary, tables binary")
    return dealt(x.groupBy("part").applyInPandas(link, "part long, bucket long, place binary, customers binary, tables binary"), "part", "hpy-links")


def learn(table: DataFrame, buckets: int, rounds: int, sweeps: int, seed: int, strengths: tuple[float, float, float] | None = None) -> tuple[Totals, DataFrame]:
    """The totals of parents, root and strengths after `rounds` rounds, and bucket, part, customers, tables: those of words' own restaurants, for each bucket that has dishes in them.

    Only sums by class and a row of two numbers per part are collected in each round. `strengths` of words' restaurants, parents and root, if they are not to be sampled."""
    shared, shared_tables, roots, top, (tokens, words), served = _added(table, [*STATE, 2, 6])
    discounts = [float(np.clip(once / max(1.0, once + 2 * twice), 0.1, 0.95)) for once, twice in served.reshape(3, 2)]
    rng = None if strengths else np.random.default_rng([seed, 1 << 20])
    theta = strengths or (1.0, 1.0, 1.0)
    nothing = np.zeros(0)
    totals = Totals(int(tokens), int(words), Level(discounts[0], theta[0], nothing, nothing), Level(discounts[1], theta[1], shared, shared_tables), Level(discounts[2], theta[2], roots, top))
    links = linked(table, buckets)
    down, last = links.select("bucket", "part", "customers", "tables"), None
    for k in range(rounds):  # each round is run before the next begins

        def sample(x: pd.DataFrame, summed: pd.DataFrame) -> pd.DataFrame:
            b = Bucket(x.iloc[0])
            s = b.seating()
            known = replace(totals, own=replace(totals.own, tables=b.spread(summed, "tables", buckets)))
            for state in s.sweeps(known, sweeps, np.random.default_rng([seed, k, b.number])):  # noqa: B007
                pass
            own, *sums = s.sums(state)
            out = [(part, b.number, pack(own[CLASSES + at]), None) for part, at in b.parts(buckets)]
            return pd.DataFrame([*out, (-1, b.number, None, _flat(sums))], columns=["part", "bucket", "tables", "sums"])

        def total(x: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            x, got = x.sort_values("bucket"), got.sort_values("bucket")
            place, sizes = joined(x["place"])
            customers, tables = np.zeros(place.max() + 1), np.bincount(place, joined(got["tables"])[0])
            customers[place] = joined(x["customers"])[0]
            part = int(x["part"].iloc[0])
            logs, coins = strength_terms(totals.own.strength, totals.own.discount, customers, tables, np.random.default_rng([seed, 1 << 20, k, part]))
            back = [pack(t) for t in np.split(tables[place], np.cumsum(sizes)[:-1])]
            out = pd.DataFrame({"bucket": x["bucket"].to_numpy(), "part": part, "customers": x["customers"].to_numpy(), "tables": back, "logs": 0.0, "coins": 0.0})
            return pd.concat([out, pd.DataFrame([[-1, part, None, None, logs, coins]], columns=out.columns)])

        up = written(table.groupBy("bucket").cogroup(down.groupBy("bucket")).applyInPandas(sample, "part long, bucket long, tables binary, sums binary"), "hpy-up")
        shared, shared_tables, roots, top = _added(up.filter("part = -1"), STATE)
        back = links.groupBy("part").cogroup(up.filter("part >= 0").groupBy("part")).applyInPandas(total, "bucket long, part long, customers binary, tables binary, logs double, coins double")
        back = written(back, "hpy-down")
        down = back.filter("bucket >= 0").select("bucket", "part", "customers", "tables")
        own = totals.own
        if rng is not None:
            shares = back.filter("bucket < 0").select("part", "logs", "coins").orderBy("part").toPandas()
            own = replace(own, strength=strength_from(shares["logs"].sum(), shares["coins"].sum(), rng))
        totals = Totals(totals.tokens, totals.words, own, totals.shared.seated(shared, shared_tables, rng), totals.root.seated(roots, top, rng))
        drop(up, *([last] if last else []))
        last = back
    if rounds:
        drop(links)
    return totals, down


def score(
    docs: DataFrame, held: Column, rounds: int = 2, sweeps: int = 3, burn_in: int = 2, samples: int = 4, block: int = 16 << 20, bucket: int = 12 << 20, contexts: int | None = None, seed: int = 5, strengths: tuple[float, float, float] | None = None
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text); rows where `held` is false train.

    All words have restaurants of their own; with `contexts`, only those that make up a share of 1 / `contexts` of all training tokens."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own = None if contexts is None else frequent(docs, held, contexts, block)[0]
    buckets = size // bucket + 1
    texts = dealt(texts_of(docs, held, block, own), "block", "hpy-texts")

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for _, row in x.iterrows():
                yield pd.DataFrame(Pairs.of(row, buckets).rows(row["block"], np.frombuffer(row["held"], bool)), columns=["bucket", "block", "words", "n", "ids", "context", "counts"])

    sent = texts.mapInPandas(entries, "bucket long, block long, words binary, n binary, ids binary, context binary, counts binary")
    table = dealt(sent.groupBy("bucket").applyInPandas(gathered, TABLE_SQL), "bucket", "hpy-table")
    totals, down = learn(table, buckets, rounds, sweeps, seed, strengths)

    def predict(x: pd.DataFrame, summed: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(x.iloc[0])
        s = b.seating(untrained=True)
        known = replace(totals, own=replace(totals.own, customers=b.spread(summed, "customers", buckets), tables=b.spread(summed, "tables", buckets)))
        p = np.zeros(len(b.n))
        for k, state in enumerate(s.sweeps(known, burn_in + samples, np.random.default_rng([seed, rounds, b.number]))):
            if k >= burn_in:
                p += s.dishes(known, state)
        logs = np.log10(p / samples).astype("<f4")[b.at]
        cut = np.cumsum(b.entries)[:-1]
        pairs = np.concatenate([[0], np.cumsum(b.contexts)])[cut]
        planes = lambda v: np.ascontiguousarray(v.view("u1").reshape(-1, 4).T).tobytes()
        return pd.DataFrame({"block": b.blocks, "bucket": b.number, "known": [pack(v) for v in np.split(s.total.astype(np.int64)[b.words], cut)], "logs": [planes(v) for v in np.split(logs, pairs)]})

    back = table.groupBy("bucket").cogroup(down.groupBy("bucket")).applyInPandas(predict, "block long, bucket long, known binary, logs binary")
    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def total(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        own, got = own.iloc[0], got.sort_values("bucket")
        x = Pairs.of(own, buckets)
        logs = np.concatenate([np.ascontiguousarray(np.frombuffer(v, "u1").reshape(4, -1).T).view("<f4").ravel() for v in got["logs"]])
        known, lengths = joined(got["known"])[0][x.word], x.lengths
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        sums = lambda v: np.add.reduceat(v[x.tokens], start)
        ids = pd.arrays.IntegerArray(np.frombuffer(own["doc_ids"], "<i8").copy(), np.frombuffer(own["no_id"], bool).copy())
        base = np.log10((known + 1) / (totals.tokens + totals.words + 1))
        out = {"doc_id": ids, "held_out": np.frombuffer(own["held"], bool), "n_tokens": lengths, "n_known": sums((known > 0).astype(np.int64)), "train_tokens": totals.tokens, "base_score": sums(base), "score": sums(logs.astype(np.float64))}
        return pd.DataFrame(out)

    return texts.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(total, columns)


def held_out(folds: int = 7, fold: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
