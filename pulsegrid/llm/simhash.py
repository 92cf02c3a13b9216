"""SimHash near-duplicates by a Gray-order hierarchical index.

Upper nodes of the index are bit patterns that fingerprints share under a mask: the 64 bits are cut into most + 2 runs, and a mask keeps two of them. Fingerprints
within `most` bits of each other agree under one of the masks at least, so only members of one node are compared, and a node holds few of a large number of fingerprints
(one in 2^25 of random ones, at 3 bits). Within a node fingerprints are sorted by Gray rank, so that neighbours share long bit patterns; every group of 512, 64 and 8 keeps
the bits that its members share (a mask and their pattern). Two groups whose shared bits differ in more than the allowed number can hold no link,
so pairs of groups are dropped as a whole, level by level; only what is left is opened. Pairs of groups that already belong to one component are not opened again,
and a task returns the edges that joined something, not all pairs. A node of very many fingerprints is cut in this order into chunks, which are paired in the same way.

near_duplicates() links fingerprints of word shingles and nothing else. one_of_each() is about texts: two of them are near copies if their sets of five-word
shingles have a likeness of 0.8 or more. A first search uses the index on SimHashes of a text's distinct words, which scattered edits move
by few bits; a pair within the allowed number of bits is compared by 64 min-hashes, unless it is joined already.
A second search is exact: with all shingles in one order, rare ones first, two texts of that likeness share one among the first fifth (and one more) of
each text's shingles, whatever the edit. So texts meet on these: first with two drawn hubs of each such shingle, which brings most of a large group together in a
number of pairs that grows with the texts, and then all those that are still apart become pairs, less those that can't be alike by three exact bounds (sizes, the places of
the first shingle that they share, parities of their sets) or whose
sketches are far apart (at a likeness of 0.8, one in 10^6). What either search finds is an edge only if the two whole sets of shingle hashes (64 bits) have a likeness of 0.8.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and is linked like any other; fewer than three words make one
shingle; component_id is the least doc_id that is not null among the component's (null if all are); repeated rows and doc_ids are rows of
their own; an empty table gives an empty result; other input columns are ignored by near_duplicates() and kept by one_of_each(). For one_of_each() texts of the
same words in the same order are copies, so are all without words, and fewer than five words make one shingle. A text of any length is hashed whole, in parts of
bounded memory. Ties (the same least doc_id in a group) go to the row of the smaller hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import drop, row_key, scratch, take_rows, text_or_empty, written
from pulsegrid.llm.components import components

WIDTHS = (512, 64, 8)  # fingerprints in a group, by level below the chunk


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit; a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    hashes = np.array([digest(b" ".join(words[i : i + shingle]), seed) for i in range(n)] if n > 1 else [digest(b" ".join(words), seed)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_column(shingle: int = 3, seed: int = 42):
    @F.pandas_udf("long")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    return compute(text_or_empty())


SKETCH = 64  # min-hashes of a sketch, four bits of each
DIFFER = 20  # fewer differ with a chance of 0.995 at a likeness of 0.8, where a sixteenth of those that differ look equal
FAR = 28  # more differ with a chance of 1e-6 at a likeness of 0.8
_DRAWN = np.random.default_rng(6)
FACTORS, TERMS = _DRAWN.integers(1 << 31, size=SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1), _DRAWN.integers(1 << 32, size=SKETCH, dtype=np.uint32)
#: Odd factors of a shingle's words, one for each place.
PLACES = _DRAWN.integers(1 << 63, size=5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORDS_AT_ONCE = 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit words over all others, one to one."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of some texts as hashes, one text after another."""

    def __init__(self, texts: list[str]):
        self.texts = [t.encode().lower().split() for t in texts]
        self.lengths = np.fromiter(map(len, self.texts), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        x = pa.array([w for ws in self.texts for w in ws], pa.large_binary()).dictionary_encode()
        self.types = np.fromiter(map(xxhash.xxh3_64_intdigest, x.dictionary.to_pylist()), np.uint64, len(x.dictionary))
        self.codes = x.indices.to_numpy()

    def shingles(self) -> list[np.ndarray]:
        """Each text's distinct hashes of its runs of five words, ascending; fewer words make one run, and none an empty one."""
        words = np.concatenate([self.types[self.codes], np.zeros(len(PLACES), np.uint64)])
        n = len(self.codes)
        runs = mixed(sum(words[k : k + n] * f for k, f in enumerate(PLACES)))
        out = []
        for start, length in zip(self.starts.tolist(), self.lengths.tolist(), strict=False):
            if length >= len(PLACES):
                out.append(np.unique(runs[start : start + length - len(PLACES) + 1]))
            else:
                out.append(mixed(np.array([(words[start : start + length] * PLACES[:length]).sum() + np.uint64(length)], np.uint64)))
        return out

    def fingerprints(self) -> np.ndarray:
        """SimHash of each text's distinct words; 0 without words."""
        of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        pairs = np.unique(of * len(self.types) + self.codes) if len(self.types) else np.zeros(0, np.int64)
        of, code = np.divmod(pairs, max(1, len(self.types)))
        counts = np.bincount(of, minlength=len(self.lengths))
        bits = np.unpackbits(self.types.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.zeros((len(self.lengths), 64), np.int64)
        some = np.flatnonzero(counts)
        if len(some):
            ones[some] = np.add.reduceat(bits[code].astype(np.int32), (np.cumsum(counts) - counts)[some], axis=0)
        return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<i8").ravel()


def in_parts(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts with about WORDS_AT_ONCE words each (by their lengths), a longer text alone."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= 6 * WORDS_AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def shingles(texts: list[str]) -> list[np.ndarray]:
    return [own for part in in_parts(texts) for own in Words(part).shingles()]


def sketch_of(hashes: np.ndarray) -> bytes:
    """Four bits of each of SKETCH min-hashes of a set of hashes."""
    hashes = hashes.astype(np.uint32)
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * FACTORS + TERMS).min(axis=0), out=least)
    bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
    return (bits[::2] << 4 | bits[1::2]).tobytes()


def parities(hashes: np.ndarray) -> list[int]:
    """256 bits, as four signed words: whether an odd number of a set's hashes falls on each. Two sets differ in as many hashes as bits at least."""
    odd = np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


PARITY = ("p0", "p1", "p2", "p3")


def alike(sketches: np.ndarray, i: np.ndarray, j: np.ndarray, differ: int = DIFFER) -> np.ndarray:
    """Whether at most `differ` min-hashes of the sketches (rows of 64-bit words) at i and j look different."""
    x = sketches[i] ^ sketches[j]
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1) <= differ


def not_far_column():
    @F.pandas_udf("boolean")
    def compute(a: pd.Series, b: pd.Series) -> pd.Series:
        both = np.frombuffer(b"".join([*a, *b]), "<u8").reshape(-1, SKETCH // 16)
        at = np.arange(len(a))
        return pd.Series(alike(both, at, at + len(a), FAR))

    return compute("s", "t")


def shingles_column():
    @F.pandas_udf("array<long>")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([x.astype(np.int64) for x in shingles(texts.tolist())], dtype=object)

    return compute(F.col("text"))


def first_fifth(hashes: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles, at least one of which two texts of a likeness of 0.8 share: those not in `common` (ascending) first, then by times; ties by hash."""
    n = len(hashes)
    often = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = np.where(common[at] == hashes, times[at], 0)
    return hashes[np.argsort(often, kind="stable")[: n - (4 * n + 4) // 5 + 1]]


def common_shingles(docs: DataFrame, sample: int = 16_384, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, ascending, that occur twice or more in about `sample` different texts, and how often; `most` of them at most.

    They only decide the order in which first_fifth() takes shingles: any order finds the same pairs, this one with fewer others."""
    text = text_or_empty()
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(docs.count() // sample + 1)) == 0).select(text.alias("text")).distinct()
    counted = some.select(F.explode(shingles_column()).alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    got = counted.orderBy(F.desc("n"), "key").limit(most).toArrow()
    key, n = got["key"].to_numpy().astype(np.uint64), got["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def marks_column(common: np.ndarray, times: np.ndarray):
    """node (equal for texts of the same words in the same order), fp and sketch of a text, the number, the parities and the first of its shingles."""

    @F.pandas_udf("node long, fp long, sketch binary, n long, p0 long, p1 long, p2 long, p3 long, keys array<long>")
    def compute(texts: pd.Series) -> pd.DataFrame:
        out = []
        for part in in_parts(texts.tolist()):
            words = Words(part)
            for ws, fp, own in zip(words.texts, words.fingerprints().tolist(), words.shingles(), strict=True):
                node = np.uint64(xxhash.xxh3_64_intdigest(b" ".join(ws))).astype(np.int64)
                out.append((node, fp, sketch_of(own), len(own), *parities(own), first_fifth(own, common, times).astype(np.int64)))
        return pd.DataFrame(out, columns=["node", "fp", "sketch", "n", *PARITY, "keys"])

    return compute(text_or_empty())


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the order of the reflected Gray code."""
    x = x.astype(np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def _rank_column(x: str):
    r = F.col(x)
    for k in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, k))
    return r


def shared(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """mask of the bits that each run of `width` words shares, and their pattern."""
    at = np.arange(0, len(words), width)
    ones, some = np.bitwise_and.reduceat(words, at), np.bitwise_or.reduceat(words, at)
    return ~(ones ^ some), ones


class Forest:
    """Union-find over places of an array."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if (higher == self.up).all():
                return self.up
            self.up = higher

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that joined two trees."""
        made = []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(i), self.find(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                made.append((i, j))
        return made


class Joined:
    """Joins places of an array of words into trees, if they are alike by their sketches (if given), and holds the edges that did."""

    def __init__(self, n: int, sketches: np.ndarray | None):
        self.forest, self.edges, self.sketches, self.n = Forest(n), [], sketches, n

    def close(self, i: np.ndarray, j: np.ndarray) -> None:
        if self.sketches is None:
            self._merge(i, j)
            return
        for at in range(0, len(i), 1 << 15):
            x, y, roots = i[at : at + (1 << 15)], j[at : at + (1 << 15)], self.forest.roots()
            apart = roots[x] != roots[y]
            x, y = x[apart], y[apart]
            good = alike(self.sketches, x, y)
            self._merge(x[good], y[good])

    def _merge(self, i: np.ndarray, j: np.ndarray) -> None:
        """First one partner for each left place, then what is still apart."""
        while len(i):
            roots = self.forest.roots()
            apart = roots[i] != roots[j]
            i, j = i[apart], j[apart]
            if not len(i):
                return
            _, first = np.unique(roots[i] * self.n + roots[j], return_index=True)
            self.edges.extend(self.forest.join(i[first], j[first]))


def linked(a: np.ndarray, b: np.ndarray | None, most: int, sketches: np.ndarray | None = None, block: int = 1 << 19) -> list[tuple[int, int]]:
    """Edges that connect what is within `most` bits (and alike by its sketches, if given) among the words a (b None), or between a and b, both in Gray order.

    Places count through a and then b. Not every link is returned, but its two ends are connected by those that are, or by links
    within a or b."""
    same = b is None
    right = a if same else b
    base = 0 if same else len(a)
    words = a if same else np.concatenate([a, b])
    joined = Joined(len(words), sketches)

    if same and len(a) > 1:
        near = np.flatnonzero(np.bitwise_count(a[1:] ^ a[:-1]) <= most)
        joined.close(near, near + 1)
    levels = [(w, shared(a, w), shared(right, w)) for w in WIDTHS]

    def single(width: int, n: int, offset: int) -> np.ndarray:
        """The root that all of a group's members have, or -1."""
        roots, at = joined.forest.roots()[offset : offset + n], np.arange(0, n, width)
        low, high = np.minimum.reduceat(roots, at), np.maximum.reduceat(roots, at)
        return np.where(low == high, low, -1)

    def open_(depth: int, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of groups of the level above depth (or of all, at 0) that may hold links."""
        for at in range(0, len(i), max(1, block // 64)):
            step(depth, i[at : at + block // 64], j[at : at + block // 64])

    def step(depth: int, i: np.ndarray, j: np.ndarray) -> None:
        fan = np.arange(8)
        x = (i[:, None, None] * 8 + fan[None, :, None] + 0 * fan[None, None, :]).ravel()
        y = (j[:, None, None] * 8 + 0 * fan[None, :, None] + fan[None, None, :]).ravel()
        if depth < len(levels):
            width, (mask_a, pat_a), (mask_b, pat_b) = levels[depth]
            keep = (x < len(mask_a)) & (y < len(mask_b)) & ((x <= y) if same else True)
            x, y = x[keep], y[keep]
            keep = np.bitwise_count((pat_a[x] ^ pat_b[y]) & mask_a[x] & mask_b[y]) <= most
            x, y = x[keep], y[keep]
            if len(x):
                one_a, one_b = single(width, len(a), 0), single(width, len(right), base)
                keep = (one_a[x] < 0) | (one_a[x] != one_b[y])
                open_(depth + 1, x[keep], y[keep])
            return
        keep = (x < len(a)) & (y < len(right)) & ((x < y) if same else True)
        x, y = x[keep], y[keep]
        keep = np.bitwise_count(a[x] ^ right[y]) <= most
        joined.close(x[keep], y[keep] + base)

    tops = (-(-len(a) // (WIDTHS[0] * 8)), -(-len(right) // (WIDTHS[0] * 8)))
    i, j = np.divmod(np.arange(tops[0] * tops[1]), tops[1])
    open_(0, i[i <= j] if same else i, j[i <= j] if same else j)
    return joined.edges


def upper_masks(most: int) -> list[int]:
    """Masks of the upper nodes: two of most + 2 runs of bits. Words within `most` bits differ in at most `most` runs, so they agree under one of the masks."""
    cuts = [64 * k // (most + 2) for k in range(most + 3)]
    runs = [(1 << b) - (1 << a) for a, b in pairwise(cuts)]
    return [x | y for x, y in combinations(runs, 2)]


def within_nodes(words: np.ndarray, starts: np.ndarray, most: int, sketches: np.ndarray | None, small: int = 64) -> list[tuple[int, int]]:
    """linked() within each of the nodes that begin at `starts`; members of small nodes are compared at every distance, all nodes at once."""
    ends = np.append(starts[1:], len(words))
    joined = Joined(len(words), sketches)
    for at, end in zip(starts.tolist(), ends.tolist(), strict=True):
        if end - at > small:
            got = np.array(linked(words[at:end], None, most, None if sketches is None else sketches[at:end]), np.int64).reshape(-1, 2) + at
            joined.edges.extend(joined.forest.join(got[:, 0], got[:, 1]))
    until = np.repeat(np.where(ends - starts > small, starts, ends), ends - starts)
    here = np.arange(len(words))
    for distance in range(1, small):
        here = here[here + distance < until[here]]
        if not len(here):
            break
        near = here[np.bitwise_count(words[here] ^ words[here + distance]) <= most]
        joined.close(near, near + distance)
    return joined.edges


def links(nodes: DataFrame, most: int = 3, largest: int = 8192, rows_a_task: int = 250_000) -> DataFrame:
    """a, b: edges that connect nodes(fp) as all pairs within `most` bits would, or nodes(fp, node, sketch) as those of them would whose sketches are alike.

    Each word goes to every upper node that it belongs to. Rows are range-partitioned by node and, within it, by the Gray rank of the other bits, so a node of
    any size is spread over as many tasks as it needs. A task settles the nodes that lie within it and hands out, as chunks with the bits that they share,
    nodes of many words and those that may go on in the next partition; chunks of one node meet if these bits allow a link."""
    own = ["node", "sketch"] if "sketch" in nodes.columns else []
    entry_of = np.dtype([("t", "<i4"), ("shared", "<i8"), ("fp", "<i8"), *([("node", "<i8"), ("sketch", "<u8", SKETCH // 16)] if own else [])])
    kept = np.dtype([(n, entry_of[n]) for n in entry_of.names[2:]])
    masks = [m - (1 << 64) if m >> 63 else m for m in upper_masks(most)]
    uppers = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared"), F.col("fp").bitwiseAND(F.lit(~m)).alias("rest")) for t, m in enumerate(masks)]))
    unsigned = _rank_column("rest").bitwiseXOR(F.lit(-(1 << 63)))  # the order of unsigned words, for signed ones
    order = ["t", "shared", "rank", *own[:1]]
    ranked = nodes.select("fp", *own, uppers.alias("u")).select("u.*", "fp", *own).withColumn("rank", unsigned)
    tasks = nodes.count() * len(masks) // rows_a_task + 1
    sorted_ = ranked.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    columns = ["k", "a", "b", "t", "shared", "mask", "pattern", "entries"]
    schema = "k int, a long, b long, t int, shared long, mask long, pattern long, entries binary"

    def sketches_of(x: np.ndarray) -> np.ndarray | None:
        return np.ascontiguousarray(x["sketch"]) if own else None

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, k, open_ = np.zeros(0, entry_of), 0, True  # open_: the first node held may have begun in the partition before, or in a chunk

        def chunk(x: np.ndarray) -> pd.DataFrame:
            nonlocal k
            mask, pattern = shared(x["fp"], len(x))
            slim = np.empty(len(x), kept)
            for n in kept.names:
                slim[n] = x[n]
            k += 1
            return pd.DataFrame([[k, None, None, x["t"][0], x["shared"][0], mask[0], pattern[0], slim.tobytes()]], columns=columns).astype({"a": "Int64", "b": "Int64"})

        def edges(x: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
            got = np.array(within_nodes(np.ascontiguousarray(x["fp"]), starts, most, sketches_of(x)), np.int64).reshape(-1, 2)
            ids = x["node" if own else "fp"]
            return pd.DataFrame({"k": 0, "a": ids[got[:, 0]], "b": ids[got[:, 1]]}).reindex(columns=columns).astype(dict.fromkeys(("t", "shared", "mask", "pattern"), "Int64"))

        for x in frames:
            more = np.zeros(len(x), entry_of)
            for n in entry_of.names[:3] + tuple(own[:1]):
                more[n] = x[n].to_numpy()
            if own:
                more["sketch"] = np.frombuffer(b"".join(x["sketch"]), "<u8").reshape(len(x), -1)
            held = np.concatenate([held, more])
            starts = np.flatnonzero(np.append(True, (held["t"][1:] != held["t"][:-1]) | (held["shared"][1:] != held["shared"][:-1])))
            if len(starts) > 1 and open_:
                yield chunk(held[: starts[1]])
                held, starts, open_ = held[starts[1] :], starts[1:] - starts[1], False
            if len(starts) > 1:
                yield edges(held[: starts[-1]], starts[:-1])
                held = held[starts[-1] :]
            while len(held) >= 2 * largest:
                yield chunk(held[:largest])
                held, open_ = held[largest:], True
        if len(held):
            yield chunk(held)

    settled = sorted_.select("t", "shared", "fp", *own).mapInPandas(settle, schema)
    settled = written(settled.withColumn("part", F.spark_partition_id()), "gray-nodes")
    found = settled.filter("k = 0").select("a", "b")
    chunks = settled.filter("k > 0").select("t", "shared", F.struct("part", "k").alias("chunk"), "mask", "pattern", "entries")
    entry = chunks.select("t", "shared", "chunk", "mask", "pattern")
    other = entry.select("t", "shared", F.col("chunk").alias("chunk2"), F.col("mask").alias("mask2"), F.col("pattern").alias("pattern2"))
    differ = F.bit_count(F.col("pattern").bitwiseXOR(F.col("pattern2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2")))
    pairs = entry.join(other, ["t", "shared"]).filter((F.col("chunk") <= F.col("chunk2")) & (differ <= most)).select("chunk", "chunk2")
    pair = F.struct("chunk", "chunk2")
    sides = F.explode(F.when(F.col("chunk") == F.col("chunk2"), F.array("chunk")).otherwise(F.array("chunk", "chunk2")))
    sides = written(pairs.select(pair.alias("pair"), sides.alias("chunk")), "gray-pairs")
    sent = sides.join(chunks.select("chunk", "entries"), "chunk").select(F.xxhash64("pair").alias("pair_id"), "chunk.part", "chunk.k", "entries")

    def search(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["part", "k"])
        a, *b = (np.frombuffer(e, kept) for e in x["entries"])
        both = np.concatenate([a, *b])
        words = np.ascontiguousarray(both["fp"])
        got = np.array(linked(words[: len(a)], words[len(a) :] if b else None, most, sketches_of(both)), np.int64).reshape(-1, 2)
        ids = both["node" if own else "fp"]
        return pd.DataFrame({"a": ids[got[:, 0]], "b": ids[got[:, 1]]})

    return found.union(sent.groupBy("pair_id").applyInPandas(search, "a long, b long"))


def group_rows(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows(doc_id, node, ...) with component_id, and root: a node of the component; edges(a, b) of nodes."""
    distinct = written(rows.groupBy("node").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    of = distinct.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = written(of, "simhash-roots")
    # Written, so that both sides of the join are shuffled for it and a component of very many nodes can be split.
    least = written(of.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-components")
    return rows.join(of.select("node", "root").join(least, "root"), "node")


def near_duplicates(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs(doc_id, text)."""
    with scratch(docs.sparkSession) as keep:
        rows = written(docs.select("doc_id", fingerprint_column().alias("node")), "simhash-rows")
        distinct = written(rows.select(F.col("node").alias("fp")).distinct(), "simhash-fingerprints")
        out = group_rows(rows, links(distinct, most)).select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")
        return keep(written(out, "simhash-groups"))


def near_copies(nodes: DataFrame, most: int) -> DataFrame:
    """a, b: edges that connect nodes(node, fp, sketch) as all alike pairs within `most` bits would.

    Most texts have no neighbour within these bits; sketches move only for those that the index finds to have one."""
    of = nodes.select("fp", "node", "sketch")
    words = written(of.groupBy("fp").agg(F.count("*").alias("n")), "simhash-words")
    found = written(links(words.select("fp"), most), "simhash-near")
    near = found.select(F.col("a").alias("fp")).union(found.select("b")).union(words.filter("n > 1").select("fp"))
    return links(written(of.join(near, "fp", "left_semi"), "simhash-candidates"), most)


def meetings(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, n, parities, root of nodes(node, n, keys) for the keys that nodes of different roots share, by roots(node, root); at: the keys before it."""
    keyed = nodes.join(roots, "node", "left").select("node", "n", *PARITY, F.coalesce("root", "node").alias("root"), F.posexplode("keys").alias("at", "key"))
    # Aggregated in part before it moves, so that a key of very many texts is one row a task; most keys are of one text.
    shared_ = written(keyed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key"), "simhash-shared")
    return written(keyed.join(shared_, "key"), "simhash-met")


def may_be_alike():
    """Whether x and y, if this key is the first that they share, can have a likeness of 0.8; never false for a pair that has, at that key.

    The likeness is common / (x.n + y.n - common), so they need 4/9 of x.n + y.n in common, and differ in a ninth at most. Keys are in one order for all texts:
    what a text has before the first shared one isn't in the other. Parities differ in no more bits than the sets do in shingles."""
    both = F.col("x.n") + F.col("y.n")
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    odd = sum((F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in PARITY), F.lit(0))
    return (left * 9 >= both * 4) & (odd * 9 <= both)


def not_far(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs(a, b) but for those whose sketches are far apart."""
    sketch = nodes.select("node", "sketch")
    pairs = pairs.distinct().join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("s")), "a")
    return pairs.join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("t")), "b").filter(not_far_column()).select("a", "b")


def with_hubs(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: every node with two hubs of each key that it shares, one row a node, key and hub, so as many as there are keys.

    Hubs are drawn anew for each key (the least and the greatest hash), so members of a large group meet many others of it and mostly join
    into one component before all pairs of different roots are made."""
    met = meetings(nodes, roots)
    drawn = F.struct(F.xxhash64("key", "node").alias("h"), "node", "n", "at", *PARITY, "root")
    hubs = met.groupBy("key").agg(F.min(drawn).alias("low"), F.max(drawn).alias("high"))
    x, y = met.alias("x"), written(hubs.select("key", F.explode(F.array("low", "high")).alias("hub")).select("key", "hub.*"), "simhash-hubs").alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & may_be_alike())
    return not_far(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")), nodes)


def unjoined(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: all pairs of nodes(node, sketch, n, keys) that share a key, may be alike, and have different roots by roots(node, root)."""
    met = meetings(nodes, roots)
    x, y = met.alias("x"), met.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & may_be_alike())
    return not_far(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), nodes)


def really_alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs(a, b) of nodes whose sets of five-word shingles have a likeness of 0.8 or more; nodes(node, best) name a row of docs each."""
    pairs = written(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pairs")
    wanted = nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), "node", "left_semi")
    wanted = written(wanted.select("node", "best._pg_k1", "best._pg_k2"), "simhash-wanted")  # small, so that texts needn't be shuffled for it
    texts = docs.select(text_or_empty().alias("text"), *row_key(docs)).join(wanted, ["_pg_k1", "_pg_k2"]).dropDuplicates(["_pg_k1", "_pg_k2"])
    sets = written(texts.select("node", shingles_column().alias("set")), "simhash-shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    # The likeness is common / (x + y - common).
    return written(both.filter(F.size(F.array_intersect("x", "y")) * 9 >= (F.size("x") + F.size("y")) * 4).select("a", "b"), "simhash-alike")


def one_of_each(docs: DataFrame, most: int = 4) -> DataFrame:
    """A row of docs for each group of near copies: the one of the least doc_id, ties by the row's hash."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        rows = written(docs.select("doc_id", marks_column(*common_shingles(docs)).alias("m"), *row_key(docs)), "simhash-rows")
        # Copies are aggregated before they move, so that a text of very many rows is one row a task.
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_pg_k1", "_pg_k2")).alias("best")
        nodes = written(rows.groupBy("m.node").agg(*[F.any_value(f"m.{c}").alias(c) for c in ("fp", "sketch", "n", *PARITY, "keys")], best), "simhash-nodes")
        drop(rows)
        with scratch(spark) as keep_roots:
            roots = keep_roots(written(components(really_alike(near_copies(nodes, most), docs, nodes)), "simhash-first"))
        for search in (with_hubs, unjoined):
            with scratch(spark) as keep_roots:
                more = really_alike(search(nodes, roots), docs, nodes)
                roots = keep_roots(written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), f"simhash-{search.__name__}"))
        of = nodes.select("node", "best").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
        kept = keep(written(of.select("best._pg_k1", "best._pg_k2", F.lit(1).alias("_pg_copies")), "simhash-best"))
    return take_rows(docs, kept)
