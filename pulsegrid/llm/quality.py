"""Quality classifier by Bradley-Terry pairwise ranking.

Every pair of a better and a worse document says that the better one's score is higher: with scores linear in the text's features,
that is a logistic loss on feature differences. The ranking is fitted on a bounded sample of labelled rows
(`max_labelled`, by hash of doc_id), pairs drawn at random (`pairs` of them). The threshold is a quantile of the sample's
scores: the share of worse documents in it. A score is shifted so that this threshold stands at `accept`.

Features are learned from the text: the words and the runs of three bytes, hashed to 256 buckets each (roots of their shares), beside 17 counts of its surface (lengths, letters,
digits, symbols, repeats), all over the whole text, however long.

Scores are functions of the text alone; equal scores (ties) get equal predictions. Defined cases: null text counts as empty and is scored; a doc_id labelled
more than once has the lower label; null labels and null doc_ids teach nothing; a doc_id that is null is not held out; without both labels in the sample
all scores are 0.5; repeated rows are scored alike; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import text_or_empty

PLAIN = b" \t\n\x0b\x0c\r.,'-"


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, DIGIT = _bytes(bytes(range(65, 91))), _bytes(bytes(range(48, 58)))
LETTER = UPPER | _bytes(bytes(range(97, 123))) | (np.arange(256) >= 128)
SYMBOL = ~LETTER & ~DIGIT & ~_bytes(PLAIN)


BUCKETS = 256  # for words, and for runs of bytes


def hashed(raw: bytes, words: list[bytes]) -> np.ndarray:
    """Roots of the shares that words and runs of three bytes have, by bucket."""
    counts = Counter(words)
    at = np.fromiter((xxhash.xxh32_intdigest(w) for w in counts), np.int64, len(counts)) % BUCKETS
    by_word = np.bincount(at, np.fromiter(counts.values(), np.float64, len(counts)), BUCKETS)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    runs = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761) >> np.uint32(24)
    by_run = np.bincount(runs, minlength=BUCKETS)
    return np.sqrt(np.concatenate([by_word / max(1, len(words)), by_run / max(1, len(runs))]))


def features(text: str) -> np.ndarray:
    raw = text.encode()
    return np.concatenate([surface(raw), hashed(raw.lower(), raw.lower().split())]).astype(np.float32)


def surface(raw: bytes) -> list[float]:
    """Shares and logarithms of counts, over the whole text."""
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.lower().split()
    k = max(1, len(words))
    lines = raw.split(b"\n")
    distinct = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    letters = max(1, int(count[LETTER].sum()))
    return [
        float(np.log1p(len(words))),
        float(count[UPPER].sum()) / letters,
        float(count[SYMBOL].sum()) / n,
        float(count[SYMBOL].sum()) / k,
        float(count[ord("!")]) / n,
        float(count[DIGIT].sum()) / n,
        float(count[128:].sum()) / n,
        letters / n,
        float(sizes.mean()),
        float(sizes.std()),
        distinct / k,
        float(np.log(k / max(1, distinct))),
        again / k,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(len(lines))),
        float(count[ord(".")]) / k,
        float(count[ord(",")]) / k,
    ]


@dataclass(frozen=True)
class Ranking:
    center: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -20, 20) @ self.weight + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, label: np.ndarray, accept: float = 0.3, pairs: int = 30_000, seed: int = 10, ridge: float = 1e-3, part: int = 5000) -> Ranking:
    width = len(features(""))
    better, worse = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(better) or not len(worse):
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = x - center
    z /= scale
    np.clip(z, -20, 20, out=z)
    rng = np.random.default_rng(seed)
    up, down = rng.choice(better, pairs), worse[np.arange(pairs) % len(worse)]
    w = np.zeros(width)
    for _ in range(30):  # Newton steps on the mean of log(1 + exp(-d w)) + ridge / 2 |w|^2
        gradient, hessian = ridge * w, ridge * np.eye(width)
        for at in range(0, pairs, part):
            d = z[up[at : at + part]] - z[down[at : at + part]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
            gradient -= d.T @ p / pairs
            hessian += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    s = np.sort(z @ w)
    threshold = float(np.quantile(s, len(worse) / len(s), method="midpoint"))
    return Ranking(center, scale, w, float(np.log(accept / (1 - accept))) - threshold)


def _feature_udf():
    @F.pandas_udf("array<float>")
    def compute(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    return compute


def held_out(folds: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, accept: float = 0.3, folds: int = 5, pairs: int = 30_000) -> Ranking:
    """The ranking fitted to labels(doc_id, quality) of rows that aren't held out. The sample's features meet in a task; the driver gets the ranking only."""
    sample = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    rows = known.select("doc_id", "quality", _feature_udf()("text").alias("x")).groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("s")).select("doc_id", "s.*")

    def ranked(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        label = table["quality"].to_numpy().astype(np.int64)
        x = table["x"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(table.num_rows, len(features("")))
        del table
        got = fit(x, label, accept, pairs)
        return pa.table({"center": [got.center], "scale": [got.scale], "weight": [got.weight], "shift": [got.shift]})

    found = rows.groupBy().applyInArrow(ranked, "center array<double>, scale array<double>, weight array<double>, shift double").first()
    if found is None:  # no labelled rows
        return fit(np.zeros((0, len(features("")))), np.zeros(0, np.int64), accept, pairs)
    return Ranking(np.array(found["center"]), np.array(found["scale"]), np.array(found["weight"]), found["shift"])


def score_column(ranking: Ranking):
    @F.pandas_udf("double")
    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            x = np.array([features(t) for t in texts], np.float64)
            yield pd.Series(ranking.score(x) if len(x) else np.zeros(0))

    return score(text_or_empty())


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text)."""
    ranking = learn(docs, labels, accept=accept, **how)
    return docs.select("doc_id", held_out(how.get("folds", 5)).alias("held_out"), score_column(ranking).alias("score")).withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = 0.3, **how) -> DataFrame:
    """The rows of docs that score `accept` or more, as they are."""
    score = score_column(learn(docs, labels, accept=accept, **how))
    return docs.withColumn("_pg_score", score).filter(F.col("_pg_score") >= accept).drop("_pg_score")
