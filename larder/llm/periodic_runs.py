"""Periodic run detection: multi-scale minimizers, seed extension, direct lag scans.

A run is a stretch of consecutive words with smallest period q, of ``repeats`` periods
and ``least`` words at least, that no neighbouring word extends keeping the period.

* Periods below ``SHORT``: the words are compared with themselves q places on, for every q.
* Longer periods, by scales P <= q < 2P (P doubles): the words' P/2-grams are hashed, and the
  positions that are the least of a window of P/4 are minimizers. Inside a run the windows
  repeat at period distance, and so do their minima. Of equal minimizers at most P/4 apart
  (a stretch of a shorter period) the first stands for all. Pairs of equal minimizers at a
  distance of the scale are seeds: lag and place. There are at most eight for a minimizer.
* A seed is extended to both sides as far as the words agree at its lag. Seeds inside
  a stretch already extended at that lag are skipped. What is long enough and has no
  shorter period is a run.

Why no run is lost: in a run of smallest period q the least gram of a period is a minimizer
wherever it occurs. If all of its occurrences had another one at most P/4 before, the grams,
twice as long as that, would overlap to one stretch of a period shorter than q. So one
occurrence a period is kept, and with four periods it is kept q places on as well. Grams are
compared by 64-bit hashes to find seeds; runs are decided by the words alone.

The documents of a slice are laid end to end with a separator of its own behind each, so
that the scans work on long arrays whatever the documents' lengths.

Defined results: null, empty and blank texts have no words and no runs, their collapsed text
is empty; rows that repeat a doc_id each give a row; a null doc_id stays null; texts of any
length are searched whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 16  # periods below are found by direct lag scans
SLICE_BYTES = 2 << 20  # of text that one scan takes at once, or one document
ROWS = "doc_id long, n_words int, runs array<struct<start:int,length:int,period:int>>, collapsed string"
Run = tuple[int, int, int]  # start, end, period


def ascii_words(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words between ASCII white space."""
    return text.split()


def _stretches(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of consecutive numbers in ``hits``."""
    cut = np.flatnonzero(np.diff(hits) > 1)
    return hits[np.r_[0, cut + 1]], hits[np.r_[cut, len(hits) - 1]] + 1


def _agree(w: np.ndarray, i: int, q: int) -> int:
    """Words from ``i`` on that equal the word q places on."""
    at, step = i, 64
    while at + q < len(w):
        same = w[at:at + step][:len(w) - q - at] == w[at + q:at + q + step]
        if not same.all():
            return at + int(same.argmin()) - i
        at, step = at + len(same), step * 2
    return at - i


def _primes(q: int) -> list[int]:
    out, d = [], 2
    while d * d <= q:
        if q % d == 0:
            out.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return out + [q] if q > 1 else out


def _is_least(w: np.ndarray, a: int, b: int, q: int) -> bool:
    """Whether the stretch, of two periods q at least, has no shorter period (it would divide q)."""
    return not any(np.array_equal(w[a:b - q // r], w[a + q // r:b]) for r in _primes(q))


def _slide(x: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """pick (minimum or maximum) over x[i:i + width] for every i with a whole window."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _seeds(grams: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Lags and places of pairs of equal minimizers at a distance in [scale, 2 * scale)."""
    width = scale // 4
    none = np.zeros(0, np.int64)
    if len(grams) < 2 * width:
        return none, none
    least = _slide(grams, width, np.minimum)
    inner = _slide(least, width, np.maximum)  # of the windows that hold a position
    at = np.flatnonzero(inner == grams[width - 1:width - 1 + len(inner)]) + width - 1
    g = grams[at]
    order = np.argsort(g, kind="stable")
    at, g = at[order], g[order]
    first = np.ones(len(at), bool)
    first[1:] = (g[1:] != g[:-1]) | (np.diff(at) > width)
    at, g = at[first], g[first]
    lags, places = [none], [none]
    for t in range(1, 2 * scale // width + 1):
        d = at[t:] - at[:-t]
        ok = (g[t:] == g[:-t]) & (d >= scale) & (d < 2 * scale)
        lags.append(d[ok])
        places.append(at[:-t][ok])
    return np.concatenate(lags), np.concatenate(places)


def find_runs(words: np.ndarray, sizes: np.ndarray, repeats: int = 4, least: int = 6) -> list[Run]:
    """All runs (start, end, period) of the documents laid end to end in ``words``, by start and
    period. Documents have ``sizes`` words, each followed by a separator met nowhere else."""
    if repeats < 4:
        raise ValueError("seeds are only sure to meet runs of four periods or more")
    out: list[Run] = []
    for q in range(1, min(SHORT, int(sizes.max(initial=0)) // repeats + 1)):
        hits = np.flatnonzero(words[q:] == words[:-q])
        if len(hits):
            starts, ends = _stretches(hits)
            long = ends - starts >= max(least, repeats * q) - q
            out += [(a, b + q, q) for a, b in zip(starts[long].tolist(), ends[long].tolist()) if _is_least(words, a, b + q, q)]
    scale, width = SHORT, 1
    grams = _mix(words.astype(np.uint64), np.uint64(1))
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = None  # places of the grams' words; None: all
    while scale * repeats <= sizes.max(initial=0):
        keep = (sizes >= scale * repeats)[owner]
        grams, owner, place = grams[keep], owner[keep], np.flatnonzero(keep) if place is None else place[keep]
        while width < scale // 2 and len(grams) > width:
            grams = _mix(grams[:-width], grams[width:])
            width *= 2
        lags, places = _seeds(grams, scale)
        order = np.lexsort((places, lags))
        done_lag, done = -1, -1
        for q, i in zip(lags[order].tolist(), place[places[order]].tolist()):
            if q != done_lag:
                done_lag, done = q, -1
            if i < done:
                continue
            a = i - _agree(words[:i + q][::-1], 0, q)
            done = i + _agree(words, i, q)
            if done - a >= (repeats - 1) * q and _is_least(words, a, done + q, q):
                out.append((a, done + q, q))
        owner, place = owner[:len(grams)], place[:len(grams)]
        scale *= 2
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def _search(words_of: Callable[[int | None, bytes], list[bytes]], repeats: int, least: int):
    def rows(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        docs = [words_of(i, t or b"") for i, t in zip(ids, texts)]
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        code: dict[bytes, int] = {}
        for d in docs:
            code.update(dict.fromkeys(d, 0))
        code = dict(zip(code, range(len(code))))
        words = np.empty(int(sizes.sum()) + len(docs), np.int64)
        ends = np.cumsum(sizes + 1)
        words[ends - 1] = -1 - np.arange(len(docs))
        for d, e, n in zip(docs, ends.tolist(), sizes.tolist()):
            words[e - 1 - n:e - 1] = np.fromiter(map(code.__getitem__, d), np.int64, n)
        found: list[list[dict]] = [[] for _ in docs]
        starts = ends - 1 - sizes
        runs = find_runs(words, sizes, repeats, least)
        for (a, b, q), k in zip(runs, np.searchsorted(ends, [r[0] for r in runs], side="right").tolist()):
            found[k].append({"start": a - int(starts[k]), "length": b - a, "period": q})
        kept = []
        for d, f in zip(docs, found):
            if f:
                stay = np.ones(len(d), bool)
                for r in f:
                    stay[r["start"] + r["period"]:r["start"] + r["length"]] = False
                d = [d[i] for i in np.flatnonzero(stay).tolist()]
            kept.append(b" ".join(d))
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int32()),
                            ("runs", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())]))), ("collapsed", pa.string())])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes.astype(np.int32)), pa.array(found, schema.field("runs").type),
                                           pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        held = 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids.append(i)
                    texts.append(t)
                    held += len(t or b"")
                    if held >= SLICE_BYTES or len(ids) >= 4096:
                        yield rows(ids, texts)
                        ids, texts, held = [], [], 0
        if ids:
            yield rows(ids, texts)
    return run


def periodic_runs(docs: DataFrame, words_of: Callable[[int | None, bytes], list[bytes]] = ascii_words, repeats: int = 4, least: int = 6) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, its runs by start and period, and the text ``collapsed``:
    its words, joined by one space, without those that any run holds after its first period.

    ``words_of`` gives the words of a document from its doc_id and the UTF-8 bytes of its text.
    """
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            .mapInArrow(_search(words_of, repeats, least), ROWS))
