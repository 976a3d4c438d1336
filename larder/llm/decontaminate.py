"""Benchmark decontamination: pigeonhole edit matching.

A test item of m characters may occur with up to k = floor(m * ``rate``) edits. Split into
k + 1 pieces, at least one piece of such an occurrence is unchanged, so every occurrence
has an exact piece hit. One automaton over all pieces of a block of items finds the hits of
a text in one pass; hits whose windows overlap are merged, and Myers' bit-parallel distance
over the merged window finds the best end, then, run backwards, its start.

Texts are compared in lower case with white space as spaces; offsets are code points of the
text as given. Items shorter than ``MIN_CHARS`` characters are found without edits, and as
whole words only: where no letter or digit touches them.

The distinct texts of the items go to the tasks in blocks of at most about ``BLOCK_CHARS``
characters, however many there are; items that share a text are joined to its hits afterwards.

Defined results: null and empty texts match nothing, nor do null and blank items; items that
repeat a text each match; a row that repeats a doc_id gives its own rows; an empty table on
either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import hold_alone

MIN_CHARS = 20
BLOCK_CHARS = 4_000_000
ROWS = "doc_id long, item string, distance int, start int, end int"  # item: hash of its text
SLICE = 128  # texts that are Python objects at a time

_white = re.compile(r"\s")


def plain(text: str) -> str:
    """Lower case, white space as spaces, as many characters as before."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return _white.sub(" ", low)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    m, out = len(item), []
    for i in range(k + 1):
        a, b = m * i // (k + 1), m * (i + 1) // (k + 1)
        out.append((a, item[a:b]))
    return out


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(eq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance between the pattern and a stretch of ``text``, and the end of the
    first such stretch. The stretch may start anywhere, or at 0 only if ``anchored``."""
    ones, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = ones, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        x = eq.get(c, 0) | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hp, hn = vn | ~(d0 | vp) & ones, vp & d0
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp = hp << 1 | anchored
        vp = (hn << 1 | ~(d0 | hp)) & ones
        vn = hp & d0 & ones
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Items of one block, ready to be searched in texts."""

    def __init__(self, items: list[tuple[int | str, str]], rate: float):
        import ahocorasick

        self.auto, self.items = ahocorasick.Automaton(), []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            t = plain(text or "")
            if len(t) < MIN_CHARS:
                t = t.strip()
                if not t:
                    continue
            k = int(len(t) * rate) if len(t) >= MIN_CHARS else 0
            self.items.append((item_id, len(t), k, masks(t), masks(t[::-1])))
            for at, p in pieces(t, k):
                found.setdefault(p, []).append((len(self.items) - 1, at + len(p)))
        for p, where in found.items():
            self.auto.add_word(p, where)
        if found:
            self.auto.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int | str, int, int, int]]:
        """(item_id, distance, start, end) of the best occurrence of each item, by item_id."""
        if not text or not self.items:
            return []
        t = plain(text)
        starts: dict[int, set[int]] = {}
        for end, where in self.auto.iter(t):
            for i, after in where:
                starts.setdefault(i, set()).add(end + 1 - after)
        out = []
        for i, at in starts.items():
            item_id, m, k, eq, back = self.items[i]
            if m < MIN_CHARS:
                own = [s for s in at if not t[max(0, s - 1):s].isalnum() and not t[s + m:s + m + 1].isalnum()]
                if own:
                    out.append((item_id, 0, min(own), min(own) + m))
                continue
            spans: list[list[int]] = []
            for s in sorted(at):
                a, b = max(0, s - k), min(len(t), s + m + k)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            best = None
            for a, b in spans:
                if b - a < m - k:
                    continue
                d, e = myers(eq, m, t[a:b])
                if d <= k and (best is None or d < best[0]):
                    best = (d, a, a + e)
            if best:
                d, a, e = best
                _, n = myers(back, m, t[max(a, e - m - k):e][::-1], anchored=True)
                out.append((item_id, d, e - n, e))
        return sorted(out)


_MATCHERS: list = []  # a Python worker serves many tasks; it holds one block at a time


def _matcher(block, rate: float) -> Matcher:
    hold_alone("decontaminate", _MATCHERS.clear)
    if not _MATCHERS or _MATCHERS[0] is not block.value or _MATCHERS[1] != rate:
        _MATCHERS[:] = [block.value, rate, Matcher(block.value, rate)]
    return _MATCHERS[2]


def _items(benchmark: DataFrame) -> DataFrame:
    """item, item_id, text of the items with any text; equal texts have equal ``item``."""
    return (benchmark.select(F.md5("text").alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text"))
            .filter(F.col("text").rlike(r"\S")))


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list:
    """Broadcasts of the distinct item texts, each of about ``block_chars`` characters or of one text."""
    b = _items(benchmark).groupBy("item").agg(F.first("text").alias("text"))
    n = b.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-int(n) // block_chars)
    out = []
    for i in range(blocks):
        rows = b.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).collect()
        out.append(benchmark.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in rows]))
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item of which the document holds an occurrence: doc_id, item_id, distance, start, end."""
    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = _matcher(block, rate)
            for b in batches:
                for at in range(0, b.num_rows, SLICE):
                    s = b.slice(at, SLICE)
                    rows = [(i, *x) for i, t in zip(s.column("doc_id").to_pylist(), s.column("text").to_pylist()) for x in match(t)]
                    if not rows:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))],
                                                     names=["doc_id", "item", "distance", "start", "end"])
        return run

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    out = docs.sparkSession.createDataFrame([], ROWS)
    for block in item_blocks(benchmark, block_chars):
        out = out.unionByName(d.mapInArrow(search(block), ROWS))
    return out.join(_items(benchmark).select("item", "item_id"), "item").select("doc_id", "item_id", "distance", "start", "end")


def has_benchmark_text(text: Column, benchmark: DataFrame, rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> Column:
    """Whether the text holds an occurrence of any item."""
    def search(block):
        @F.pandas_udf("boolean")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            match = _matcher(block, rate)
            for s in parts:
                yield pd.Series([isinstance(t, str) and bool(match(t)) for t in s], dtype=bool)
        return run.asNondeterministic()

    out = F.lit(False)
    for block in item_blocks(benchmark, block_chars):
        out = out | search(block)(text)
    return out
