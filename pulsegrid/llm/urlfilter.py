"""URL filtering by a bit-parallel wildcard automaton (multiword Shift-And).

Glob rules are packed into one bit vector of 64-bit words: a start bit per pattern, then a bit per literal symbol. A `*` is a self-loop of the
bit before it, a `?` accepts any byte. Reading a byte moves every pattern at once:
D = ((D << 1) & accepts[byte]) | (D & loops). URLs are stepped through side by side, a batch at a time.

A URL is canonicalised to `.host#path`; neither host nor path can hold `#`, so a rule's host part can't match in the path.

Defined cases: a null url or one without `://` has an empty host and path and no rule; ties in length go to the rule listed first;
repeated rows and null page_ids are judged row by row; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = 4096  # bytes beyond which a URL is read alone, on one integer of all words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        """`*` and `?` in host or path are wildcards; the rule holds for subdomains and for longer paths."""
        return f"*.{self.host}#{self.path}*"


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


class Automaton:
    def __init__(self, globs: list[str]):
        start, loops, accepts, ends = 0, 0, [0] * 256, []
        bit = 0
        for glob in globs:
            start |= 1 << bit
            for symbol in glob.encode():
                if symbol == ord("*"):
                    loops |= 1 << bit
                    continue
                bit += 1
                for byte in range(256) if symbol == ord("?") else (symbol,):
                    accepts[byte] |= 1 << bit
            ends.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.start, self.loops, self.accepts, self.ends = start, loops, accepts, ends
        self.table = np.array([self._split(x) for x in accepts], np.uint64)

    def _split(self, x: int) -> list[int]:
        return [x >> (64 * w) & (1 << 64) - 1 for w in range(self.words)]

    def run_one(self, text: bytes) -> int:
        state = self.start
        for byte in text:
            state = ((state << 1) & self.accepts[byte]) | (state & self.loops)
        return state

    def run(self, texts: list[bytes]) -> np.ndarray:
        """The final state of each text, as words."""
        out = np.zeros((len(texts), self.words), np.uint64)
        if not texts:
            return out
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        long = order[: int((lengths > LONG).sum())]
        for i in long.tolist():
            out[i] = self._split(self.run_one(texts[i]))
        order = order[len(long) :]
        sizes = lengths[order]
        if not len(order):
            return out
        flat = np.frombuffer(b"".join(texts[i] for i in order.tolist()), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        loops = np.array(self._split(self.loops), np.uint64)
        state = np.tile(np.array(self._split(self.start), np.uint64), (len(order), 1))
        active = len(order)
        for at in range(int(sizes[0])):
            while sizes[active - 1] <= at:
                active -= 1
            d = state[:active]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.table[flat[begin[:active] + at]]) | (d & loops)
        out[order] = state
        return out

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """texts by patterns."""
        state = self.run(texts)
        return np.stack([state[:, e // 64] >> np.uint64(e % 64) & np.uint64(1) for e in self.ends], axis=1).astype(bool) if self.ends else np.zeros((len(texts), 0), bool)


def host_and_path(url: str | Column = "url") -> tuple[Column, Column]:
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, "(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, "(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url)."""
    globs = [r.glob for r in rules]
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].name), k))

    @F.pandas_udf("int")
    def best(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(globs)
        for urls in frames:
            hit = automaton.matches([u.encode() for u in urls])[:, order] if len(rules) else np.zeros((len(urls), 0), bool)
            yield pd.Series(np.where(hit.any(axis=1), np.array([*order, 0])[hit.argmax(axis=1)] if len(rules) else 0, -1), dtype="int32")

    host, path = host_and_path()
    x = pages.select("page_id", host.alias("host"), path.alias("path"))
    x = x.withColumn("_best", best(F.concat(F.lit("."), F.col("host"), F.lit("#"), F.col("path"))))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("_best") + 1)
    rule = F.when(F.col("_best") >= 0, pick([r.name for r in rules])) if rules else F.lit(None).cast("string")
    verdict = F.when(F.col("_best") >= 0, pick([r.verdict for r in rules])).otherwise(default) if rules else F.lit(default)
    return x.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
