"""How sources of a language differ in their use of terms, by dense tiles of groups by terms.

Terms are counted within tasks, some megabytes of text at a time, and summed by (lang, source, term). Each language's kept terms fall into blocks by hash, and its sources into
blocks by hash; a task gets a term block with two source blocks, makes dense matrices of 64-bit integers, sources by terms, and compares all pairs of
sources by broadcasting. The partial sums of pairs are added up over the term blocks. For the best terms of a source each tile has a heap's worth, and these are merged.

Defined cases: null text, lang and source count as ''; repeated rows are documents each; a group without terms has counts of 0; a language without kept terms has pairs of value 0 and no
terms; a language with one source has no pairs; equal values come by item in order of UTF-8 bytes; an empty table gives an empty result; other columns are ignored, whatever their names.
A text of any length is counted whole; counts may reach 9 * 10**15."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import written

#: Bytes of terms: letters, and all of characters beyond ASCII.
OF_TERMS = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: What shares are counted in.
UNIT = 1_000_000_000
MORE = 5
#: Rows of languages up to which they are sent to all tasks.
SENT_LANGS = 100_000


def tally(texts: pa.StringArray, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, and for each (group, word) that occurs: group, word's place, occurrences, texts with it. A byte tells whether it belongs to a term, since all beyond ASCII do."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if texts.buffers()[2] is not None else b""
    data, ends = np.frombuffer(raw.translate(LOWER), np.uint8), ends - ends[0]
    inside = OF_TERMS[data]
    edge = np.zeros(len(data) + 1, bool)  # where a text begins, one before it has ended
    edge[ends] = True
    first = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])[: len(inside)]))
    last = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]])[: len(inside)]))
    offsets = np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
    words, word = terms.dictionary, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, ends)))
    both, n = np.unique(of * max(1, len(words)) + word, return_counts=True)
    of, word = np.divmod(both, max(1, len(words)))
    key = groups[of] * max(1, len(words)) + word
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    within = np.diff(np.concatenate([starts, [len(key)]]))
    group, word = np.divmod(key[starts], max(1, len(words)))
    return words, group, word, np.add.reduceat(n, starts) if len(starts) else n, within


def term_counts(docs: DataFrame, together: int = 1 << 23) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it) of docs(text, lang, source); and for every group a row without a term.

    A task tallies texts of about `together` bytes at a time."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.string())
            places: dict[tuple, int] = {}
            groups = np.array([places.setdefault(g, len(places)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
            lang, source = (pa.array([g[i] for g in places], pa.string()) for i in (0, 1))
            none = pa.array(np.zeros(len(places), np.int64))
            yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(places), pa.string()), none, none], schema=kind)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + together, "right")))
                words, group, word, n, within = tally(texts.slice(a, b - a), groups[a:b])
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(group)), source.take(pa.array(group)), words.take(pa.array(word)), pa.array(n.astype(np.int64)), pa.array(within.astype(np.int64))], schema=kind)
                a = b

    each = docs.select(blank("text"), blank("lang"), blank("source")).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (counts + MORE) / totals), exact in 64 bits: three digits of the quotient at a time."""
    out, rest = np.zeros(np.broadcast(counts, totals).shape, np.int64), counts + MORE + np.zeros_like(totals)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + digits
    return out + 1


def pair_sums(a: np.ndarray, b: np.ndarray, together: int = 1 << 20) -> np.ndarray:
    """[rows of a, rows of b]: sums of absolute differences over the columns, all pairs of some columns at a time."""
    out, step = np.zeros((len(a), len(b)), np.int64), max(1, together // max(1, len(a) * len(b)))
    for at in range(0, a.shape[1], step):
        out += np.abs(a[:, None, at : at + step] - b[None, :, at : at + step]).sum(axis=2)
    return out


def audit(docs: DataFrame, least: int = 30, top: int = 50, terms: int = 512, sources: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language of docs(text, lang, source) its distance to every other (part pair), and the
    `top` terms that it uses more than the language does (part term). Terms count that are in at least `least` documents of the language.

    A tile has up to about `terms` terms and twice `sources` sources."""
    spark = docs.sparkSession
    counts = written(term_counts(docs), "audit-counts")
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term", "all_n")
    kept = written(kept, "audit-terms")
    langs = counts.filter("term IS NULL").groupBy("lang").agg(F.count("*").alias("sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total")), "lang", "left").na.fill(0)
    langs = langs.select("lang", "v", (F.col("all_total") + MORE * F.col("v")).alias("all_total"), F.ceil(F.col("sources") / sources).cast("int").alias("s_blocks"), F.greatest(F.ceil(F.col("v") / terms), F.lit(1)).cast("int").alias("t_blocks"))
    langs = written(langs, "audit-langs")
    langs = F.broadcast(langs) if langs.count() <= SENT_LANGS else langs
    used = counts.join(kept, ["lang", "term"])
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # A row per group, language, or (language, term block): small beside the counts.
    groups = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang")
    s_block = F.pmod(F.xxhash64("source"), F.col("s_blocks")).cast("int").alias("s")
    groups = written(groups.select("lang", "source", (F.coalesce("total", F.lit(0)) + MORE * F.col("v")).alias("total"), "all_total", "t_blocks", "s_blocks", s_block), "audit-groups")
    t_block = F.pmod(F.xxhash64("term"), F.col("t_blocks")).cast("int").alias("t")
    in_block = kept.join(langs.select("lang", "t_blocks"), "lang").groupBy("lang", t_block).agg(F.count("*").alias("of"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("s_blocks") - 1), lambda o: F.struct(F.least(o, F.col("s")).alias("a"), F.greatest(o, F.col("s")).alias("b")))).alias("p")
    tile = ["lang", "t", "a", "b"]
    left = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)).alias("t")).join(in_block, ["lang", "t"], "left")
    left = left.select("lang", "t", "source", "total", "all_total", "s", F.coalesce("of", F.lit(0)).alias("of"), pairs).select("lang", "t", "p.a", "p.b", "source", "total", "all_total", "s", "of")
    right = used.join(langs.select("lang", "t_blocks", "s_blocks"), "lang").select("lang", "source", "term", "n", "all_n", "s_blocks", t_block, s_block)
    right = right.select("lang", "t", "source", "term", "n", "all_n", pairs).select("lang", "t", "p.a", "p.b", "source", "term", "n", "all_n")

    def compare(key: tuple, group: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        _, _, first, second = key
        group = group.sort_values("source", ignore_index=True)
        names, at = group["source"].to_numpy(), {s: i for i, s in enumerate(group["source"])}
        words, column = np.unique(have["term"].to_numpy(dtype=object), return_inverse=True) if len(have) else (np.zeros(0, object), np.zeros(0, np.int64))
        row = have["source"].map(at).to_numpy(np.int64) if len(have) else np.zeros(0, np.int64)
        n, total, of = np.zeros((len(group), len(words)), np.int64), group["total"].to_numpy(np.int64), int(group["of"].iloc[0])
        n[row, column] = have["n"].to_numpy(np.int64)
        own, other = (np.flatnonzero(group["s"] == k) for k in (first, second))
        sums = np.zeros((len(own), len(other)), np.int64)
        if of:
            p, none = shares(n, total[:, None]), shares(np.zeros((len(group), 1), np.int64), total[:, None])
            sums = pair_sums(p[own], p[other]) + (of - len(words)) * pair_sums(none[own], none[other])  # terms that none of these sources has
        out = [("pair", names[i], names[j], int(sums[x, y])) for x, i in enumerate(own) for y, j in enumerate(other) if i != j]
        if first != second:
            out += [("pair", b, a, v) for _, a, b, v in out]
        elif of and len(words):
            everywhere = np.zeros(len(words), np.int64)
            everywhere[column] = have["all_n"].to_numpy(np.int64)
            q = shares(everywhere, group["all_total"].to_numpy(np.int64)[:1])
            for i, name in enumerate(names):
                more = np.flatnonzero((n[i] > 0) & (p[i] > q))
                best = more[np.lexsort((more, q[more] - p[i, more]))][:top]  # words are in order
                out += [("term", name, words[c], int(p[i, c] - q[c])) for c in best]
        return pd.DataFrame(out, columns=["part", "source", "item", "value"]).assign(lang=key[0])[["lang", "source", "part", "item", "value"]]

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sides = [x.repartition(tasks, *tile).groupBy(*tile) for x in (left, right)]
    found = sides[0].cogroup(sides[1]).applyInPandas(compare, "lang string, source string, part string, item string, value long")
    found = written(found, "audit-tiles")
    nth = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(nth))
    far = ranked(found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    most = ranked(found.filter("part = 'term'")).filter(F.col("rank") <= top)
    return far.unionByName(most)
