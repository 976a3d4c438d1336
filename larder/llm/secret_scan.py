"""Secret scan: fixed patterns, plus values in credential context that are costly to guess.

The cost of a value is that of its cheapest segmentation into dictionary words, dates,
repeats, keyboard walks and brute-force spans, found by dynamic programming over its
positions (cost: log10 of the guesses). It takes time in proportion to the value's length:
one automaton finds the words, and open repeats and walks are carried along. A value behind a credential word whose cost
reaches ``MIN_COST`` adds a span of kind ``guess``, unless a span of the fixed patterns
already covers part of it; placeholders such as plain words stay below that cost.

Defined results: a null or empty text has no spans. Offsets are code points, the end
exclusive. Texts of any length are scanned whole.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log10

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds in the order in which spans are listed, and their patterns.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

# Credential words whose values the guess cost judges.
CONTEXT = (r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|login|"""
           r"""api[_-]?key|(?:access|private|client|user|account)[_-]?(?:key|secret))["']?\x20*(?:[:=]|\x20is\x20)\x20*["']?([^\x09-\x0D\x20"'`,;<>()]{6,})""")
MIN_COST = 8.0

_assign = re.compile(ASSIGN, re.I | re.A)
_access = re.compile(ACCESS)
_hex = re.compile(f"[0-9a-f]{{{MIN_HEX},}}")  # a run of 24 or more starts where a run starts
_context = re.compile(CONTEXT, re.I | re.A)
_rows = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_dates = tuple(re.compile(f"(?=({d}))") for d in (
    r"(?:19|20)\d\d", r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d"))


def _steps() -> set[tuple[str, str]]:
    """Neighbours on the keyboard: in a row, and between a row and the one below."""
    out = set()
    for r, row in enumerate(_rows):
        for i, c in enumerate(row):
            near = [row[i + 1:i + 2], *((_rows[r + 1][max(0, i - 1):i + 1]) if r + 1 < len(_rows) else "")]
            out |= {(c, d) for d in near if d} | {(d, c) for d in near if d}
    return out


STEPS = _steps()
JOIN, DATE, WALK = math.log10(2), math.log10(365 * 120), math.log10(160)
UNIT = 24  # characters of a repeated unit, at most


class Ranks(dict):
    """Ranks of words (lower is more frequent), and the automaton that finds them in a value."""

    def __init__(self, ranks: dict[str, int]):
        import ahocorasick

        super().__init__(ranks)
        self.finder = ahocorasick.Automaton()
        for w, r in ranks.items():
            self.finder.add_word(w, (len(w), math.log10(r)))
        if ranks:
            self.finder.make_automaton()

    def words(self, low: str) -> Iterator[tuple[int, tuple[int, float]]]:
        """The words in ``low`` by the place of their last character, with length and cost."""
        return iter(self.finder.iter(low)) if self else iter(())


@lru_cache(maxsize=2)
def word_ranks(path: str) -> Ranks:
    """Ranks of the words of a public vocabulary file, by id."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = sorted((i, w.removesuffix("</w>")) for w, i in vocab.items() if w.endswith("</w>"))
    out: dict[str, int] = {}
    for _, w in words:
        if len(w) >= 3 and w.isalpha():
            out.setdefault(w, len(out) + 1)
    return Ranks(out)


class Open:
    """Segments of one run that may still end anywhere: the starts worth keeping, and the cheapest.

    A segment from i to j costs its start's cost plus log10 of its length in ``unit``. Of two
    starts the earlier one gains on the later as j grows, so a later start that is no better
    when it comes, or no longer better, never is again.
    """

    def __init__(self, unit: int):
        self.unit, self.kept = unit, []

    def best(self, j: int, start: int, cost: float) -> float:
        """The cheapest segment that ends at ``j``; ``start``, which costs ``cost``, is new."""
        kept, least, unit, at = self.kept, math.inf, self.unit, 0
        for i, c in kept:
            here = c + log10((j - i) / unit)
            if here < least:
                least = here
                at += 1
            else:  # an earlier start has caught up
                del kept[at]
                return self.best(j, start, cost)
        here = cost + log10((j - start) / unit)
        if here < least:
            kept.append((start, cost))
            return here
        return least


def _periodic(low: str) -> dict[int, list[tuple[int, int]]]:
    """Stretches of two periods or more of a unit of 2 to UNIT characters: start -> (end, unit).
    Those whose unit is itself a repeat are left out."""
    codes, out = np.frombuffer(low.encode("utf-32-le"), "<u4"), {}
    for p in range(2, min(UNIT, len(low) // 2) + 1):
        same = np.flatnonzero(codes[p:] == codes[:-p])
        if len(same) < p:
            continue
        cut = np.flatnonzero(np.diff(same) > 1)
        first, last = same[np.r_[0, cut + 1]], same[np.r_[cut, len(same) - 1]]
        for a, b in zip(first.tolist(), (last + 1).tolist()):
            unit = low[a:a + p]
            if b - a >= p and (unit + unit).find(unit, 1) == p:
                out.setdefault(a, []).append((b + p, p))
    return out


def guess_cost(value: str, ranks: dict[str, int], blocks: bool = True) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value``; 0 for an empty one.

    A segment costs: a word log10(rank), with capitals log10(2) more; a date log10(365 * 120);
    a character repeated three times or more log10(10 * times); a unit of 2 to ``UNIT`` characters,
    itself no repeat, that comes twice or more the unit's own cost (in lower case, without such
    units) plus log10(times); a keyboard walk of three keys or more log10(40 * 4 * its length);
    anything else 1 for each character. Each further segment costs log10(2).
    """
    if not isinstance(ranks, Ranks):
        ranks = Ranks(ranks)
    n = len(value)
    low = value.lower()
    if len(low) != n:
        low = value
    words = ranks.words(low)
    ahead = next(words, None)
    dates: dict[int, list[int]] = {}
    for d in _dates:
        for m in d.finditer(low):
            dates.setdefault(m.end(1), []).append(m.start())
    repeats = _periodic(low) if blocks and n >= 4 else {}
    units: dict[str, float] = {}
    stretches: list[tuple[int, int, int, list[Open]]] = []  # that the scan is in: start, end, unit, segments by phase
    start = [0.0] * (n + 1)  # cost of what lies before a segment that starts here
    best, brute = 0.0, math.inf  # of a segmentation that ends here; of one that ends in a brute-force segment
    run = walk = None
    run_at = walk_at = 0  # where the run of one character, and the walk, begin
    for j in range(1, n + 1):
        best = brute = min(brute, start[j - 1]) + 1.0
        if j > 1 and low[j - 1] != low[j - 2]:
            run, run_at = None, j - 1
        if j - run_at >= 3:
            run = run or Open(1)
            cost = run.best(j, j - 3, start[j - 3] + 1.0)
            if cost < best:
                best = cost
        if j > 1 and (low[j - 2], low[j - 1]) not in STEPS:
            walk, walk_at = None, j - 1
        if j - walk_at >= 3:
            walk = walk or Open(1)
            cost = walk.best(j, j - 3, start[j - 3] + WALK)
            if cost < best:
                best = cost
        if repeats or stretches:
            stretches = [x for x in stretches if j <= x[1]]
            stretches += [(j - 1, b, p, [Open(p) for _ in range(p)]) for b, p in repeats.pop(j - 1, ())]
            for a, _, p, phases in stretches:
                if j - a >= 2 * p:
                    i = j - 2 * p
                    unit = low[i:i + p]
                    if unit not in units:
                        units[unit] = guess_cost(unit, ranks, False)
                    best = min(best, phases[j % p].best(j, i, start[i] + units[unit]))
        for i in dates.get(j, ()):
            best = min(best, start[i] + DATE)
        while ahead is not None and ahead[0] == j - 1:
            size, cost = ahead[1]
            cost += start[j - size]
            if cost < best:
                best = min(best, cost + (JOIN if value[j - size:j] != low[j - size:j] else 0))
            ahead = next(words, None)
        start[j] = best + JOIN
    return best


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start and then kind as listed."""
    out = [("assign", m.start(), m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _access.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", m.start(), m.end()) for m in _hex.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def all_spans(text: str, ranks: dict[str, int], min_cost: float = MIN_COST) -> list[tuple[str, int, int, float | None]]:
    base = base_spans(text)
    out: list[tuple[str, int, int, float | None]] = [(k, i, j, None) for k, i, j in base]
    for m in _context.finditer(text):
        i, j = m.span(1)
        if any(a < j and i < b for _, a, b in base):
            continue
        cost = guess_cost(m[1], ranks)
        if cost >= min_cost:
            out.append(("guess", i, j, cost))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(text: Column, words_path: str, min_cost: float = MIN_COST) -> Column:
    """array<struct<kind, start, end, cost>> of the text's secrets, by start and kind."""
    @F.pandas_udf("array<struct<kind:string,start:int,end:int,cost:double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks = word_ranks(words_path)
        for s in parts:
            yield pd.Series([[dict(zip(("kind", "start", "end", "cost"), x)) for x in all_spans(t, ranks, min_cost)] if isinstance(t, str) else [] for t in s])
    return run.asNondeterministic()(text)


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, words_path: str, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark`` (overlapping spans once); null stays null."""
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks = word_ranks(words_path)
        for s in parts:
            yield pd.Series([hide(t, ranks, mark) if isinstance(t, str) else None for t in s], dtype=object)
    return run.asNondeterministic()(text)


def hide(text: str, ranks: dict[str, int], mark: str) -> str:
    out, at = [], 0
    for _, i, j, _ in all_spans(text, ranks):
        if i >= at:
            out += [text[at:i], mark]
        at = max(at, j)
    return "".join([*out, text[at:]])
