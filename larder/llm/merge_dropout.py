"""SentencePiece encoding with seeded merge-dropout, and its lossless decoding.

The model file gives pieces, scores and byte pieces. A text gets a leading mark, spaces
become marks, and it is cut into units at marks and line ends, across which no piece
reaches. In a unit, an agenda holds the candidate merges of neighbouring symbols, best
score first, leftmost on ties; a candidate that comes up is skipped for good with
probability ``dropout``, by a hash of the key, the draw, the place and the two lengths;
else it is merged and its new neighbours become candidates. Without dropout the result is
that of the library.

The hash takes the key, the document, the place of the occurrence in it, and the start and
the two lengths of the candidate, so each occurrence of a unit is segmented for itself. A
Python worker remembers, of a unit under a set of skips, the candidates that come up after
the last of them and the ids at the end if no other is skipped. An occurrence follows these
paths from one of its skips to the next: the result is that of its own agenda, whatever the
worker remembers. The same key gives the same ids, in whatever task a row is.

Defined results: null counts as empty and gives no ids; a character outside the vocabulary
becomes its UTF-8 byte pieces, and so does a literal mark, so that decoding gives back
exactly the text; equal rows with equal doc_ids get equal ids; a null doc_id counts as 0.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import hold_alone

MARK = "▁"
KEPT = 600_000  # paths that a worker remembers
AT_ONCE = 1 << 16  # occurrences that a worker follows together
LONGEST = 22  # characters of the units that have paths: an agenda of n characters has under 3 * n candidates, and skips are 64 bits
ROWS = "doc_id long, ids array<int>, decoded boolean"

_M1, _M2, _ALL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1


def mix(x: int) -> int:
    x = x * _M1 & _ALL
    x = (x ^ x >> 31) * _M2 & _ALL
    return x ^ x >> 29


def mixed(x: np.ndarray) -> np.ndarray:
    """``mix`` of every element."""
    x = x * np.uint64(_M1)
    x = (x ^ x >> np.uint64(31)) * np.uint64(_M2)
    return x ^ x >> np.uint64(29)


_LETTER = "[^\\W\\d_²]"
_letter = re.compile(_LETTER)


def _kind(c: str) -> int:
    """Units hold letters, or the other characters, behind marks."""
    return 0 if c == MARK else 3 if c == "\n" else 1 if _letter.match(c) else 2


class Pieces:
    """Vocabulary of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sp = sp
        self.byte_ids, self.ids, ranks = {}, {}, []
        self.raw: list[bytes] = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.ids[p] = i
                self.raw.append(p.replace(MARK, " ").encode())
                ranks.append((-sp.get_score(i), i, p))
        self.rank = {p: r for r, (_, _, p) in enumerate(sorted(ranks))}  # lower merges first
        inner = [p for p in self.ids if any(_kind(a) != _kind(b) and a != MARK or b == MARK != a for a, b in zip(p, p[1:]))]
        if inner:
            raise ValueError(f"pieces reach across units: {inner[:3]}")
        self._tables()
        self.size = np.array([len(x) for x in self.raw])
        self.at = np.r_[0, np.cumsum(self.size)][:-1]
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def _tables(self) -> None:
        """For whole batches of units: ids of characters, ids and ranks of merges of two ids."""
        self.unknown = len(self.raw)
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.rank_of = np.full(self.unknown, len(self.rank), np.int32)
        pairs = []
        for p, i in self.ids.items():
            self.rank_of[i] = self.rank[p]
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs.append((a << 20 | b, i))
        # A table of pairs by hash, at most an eighth full: most pairs are found, or known not to be there, at once.
        self.shift = np.uint64(64 - max(8, (8 * len(pairs)).bit_length()))
        self.keys = np.full(1 << 64 - int(self.shift), -1, np.int64)
        self.made = np.zeros(len(self.keys), np.int32)
        keys, made = np.array([k for k, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]], self.made[at[free]] = keys[free], made[free]  # of several for one slot, one stays
            left = self.keys[at] != keys
            keys, made, at = keys[left], made[left], (at[left] + 1) & len(self.keys) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(_M1) >> self.shift).astype(np.int64)

    def _merge(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and rank of each merge of ``a`` and ``b``; the rank len(self.rank) if there is none."""
        key = a.astype(np.int64) << 20 | b
        at = self._slot(key)
        seen = self.keys[at]
        on = np.flatnonzero((seen != key) & (seen >= 0))
        while len(on):
            at.flat[on] = (at.flat[on] + 1) & len(self.keys) - 1
            seen.flat[on] = self.keys[at.flat[on]]
            on = on[(seen.flat[on] != key.flat[on]) & (seen.flat[on] >= 0)]
        made = self.made[at]
        return made, np.where(seen == key, self.rank_of[made], np.int32(len(self.rank)))

    def unit_ids_of(self, units: list[str], draws: np.ndarray, limit: int) -> list[bytes]:
        """``unit_ids`` of many units at once, by length. One draw each."""
        out: list[bytes] = [b""] * len(units)
        size = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= 24]
        for i in np.flatnonzero(size > 24).tolist():
            out[i] = self.unit_ids(units[i], limit, int(draws[i]))
        for at in range(0, len(order), 4096):
            part = order[at:at + 4096]
            for i, ids in zip(part.tolist(), self._rounds([units[i] for i in part], size[part], draws[part], limit)):
                out[i] = self.unit_ids(units[i], limit, int(draws[i])) if ids is None else ids
        return out

    def _rounds(self, units: list[str], size: np.ndarray, draws: np.ndarray, limit: int, trace: list | None = None) -> list[bytes | None]:
        """Each round takes the agenda's best candidate of every unit. None: a character has no piece.

        With ``trace``, ``draws`` are sets of skips: a bit for each round. ``trace`` gets the units and
        the candidates of each round."""
        width, none = int(size.max()), len(self.rank)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        col = np.arange(width + 1, dtype=np.int32)
        alive = col[None, :] < size[:, None]  # places where a symbol starts
        sym = np.full(alive.shape, self.unknown, np.int32)
        sym[alive] = self.of_char[codes]
        odd = ((sym == self.unknown) & alive).any(1)
        made, rank = self._merge(sym[:, :-1], sym[:, 1:])  # of the candidate that starts at a place
        behind = np.repeat(np.minimum(col + 1, width)[None, :], len(units), 0)  # start of the next symbol
        before = np.repeat(col[None, :] - 1, len(units), 0)
        live, turn = np.arange(len(units)), 0
        while len(live):
            left = rank[live]
            i = left.argmin(1)
            go = left[np.arange(len(live)), i] < none
            live, i = live[go], i[go]
            j = behind[live, i]
            e = behind[live, j]
            m = live
            if limit or trace is not None:
                code = i.astype(np.uint64) << np.uint64(40) ^ (j - i).astype(np.uint64) << np.uint64(20) ^ (e - j).astype(np.uint64)
                if trace is None:
                    skip = mixed(draws[live] ^ code) < np.uint64(limit)
                else:
                    skip = draws[live] >> np.uint64(turn) & np.uint64(1) != 0
                    trace.append((live, code))
                rank[live[skip], i[skip]] = none
                m, i, j, e = m[~skip], i[~skip], j[~skip], e[~skip]
                turn += 1
            new = made[m, i]
            sym[m, i], rank[m, j], alive[m, j] = new, none, False
            behind[m, i], before[m, e] = e, i
            made[m, i], rank[m, i] = self._merge(new, sym[m, e])
            b = before[m, i]
            has = b >= 0
            k, b = m[has], b[has]
            made[k, b], rank[k, b] = self._merge(sym[k, b], new[has])
        flat, ends = sym[alive].astype("<i4").tobytes(), np.cumsum(4 * alive.sum(1)).tolist()
        return [None if bad else flat[x:y] for bad, x, y in zip(odd.tolist(), [0, *ends], ends)]

    def segment(self, unit: str, limit: int, draw: int) -> list[str]:
        """Symbols after the agenda is done. ``limit``: dropout times 2**64."""
        n = len(unit)
        if n > 40:
            return self._agenda(unit, limit, draw)
        rank, sym = self.rank, list(unit)
        start = list(range(n))
        none = len(rank)
        todo = [rank.get(sym[i] + sym[i + 1], none) for i in range(n - 1)]
        while todo:
            r = min(todo)
            if r == none:
                break
            i = todo.index(r)
            left, right = sym[i], sym[i + 1]
            if limit and mix(draw ^ start[i] << 40 ^ len(left) << 20 ^ len(right)) < limit:
                todo[i] = none
                continue
            sym[i] = left + right
            del sym[i + 1], start[i + 1], todo[i]
            if i < len(todo):
                todo[i] = rank.get(sym[i] + sym[i + 1], none)
            if i:
                todo[i - 1] = rank.get(sym[i - 1] + sym[i], none)
        return sym

    def _agenda(self, unit: str, limit: int, draw: int) -> list[str]:
        """The same by a heap, for long units."""
        n, rank = len(unit), self.rank
        end = list(range(1, n + 1))          # end of the symbol that starts at i; 0 if none does
        before = list(range(-1, n - 1))      # start of the symbol before
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            r = rank.get(unit[i:end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if end[i] != j or end[j] != e:
                continue
            if limit and mix(draw ^ i << 40 ^ (j - i) << 20 ^ (e - j)) < limit:
                continue
            end[i], end[j] = e, 0
            if e < n:
                before[e] = i
                offer(i, e)
            if i:
                offer(before[i], i)
        out, i = [], 0
        while i < n:
            out.append(unit[i:end[i]])
            i = end[i]
        return out

    def unit_ids(self, unit: str, limit: int, draw: int) -> bytes:
        out: list[int] = []
        for s in self.segment(unit, limit, draw):
            i = self.ids.get(s)
            if i is None:
                out += [self.byte_ids[b] for c in s for b in c.encode()]
            else:
                out.append(i)
        return np.array(out, "<i4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: their bytes one after the other, less the leading space."""
        n = self.size[ids]
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return ""
        where = np.arange(ends[-1]) + np.repeat(self.at[ids] - ends + n, n)
        return self.bytes[where].tobytes()[1:].decode()


_UNITS = re.compile(f"{MARK}*{_LETTER}+|\n|{MARK}*(?:(?!{_LETTER})[^{MARK}\n])+|{MARK}+")


class Rows:
    """Rows of unequal length, one after the other in an array that grows."""

    def __init__(self, kind):
        self.flat, self.ends, self.n = np.zeros(1 << 12, kind), np.zeros(1 << 12, np.int64), 0

    def add(self, size: np.ndarray, values: np.ndarray) -> None:
        used, n = int(self.ends[self.n]), self.n + len(size)
        if used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(used + len(values), self.flat.dtype)])
        if n >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(n, np.int64)])
        self.flat[used:used + len(values)] = values
        self.ends[self.n + 1:n + 1] = used + np.cumsum(size)
        self.n = n

    def at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the elements of ``rows`` in ``flat``, and how many each row has."""
        first = self.ends[rows]
        size = self.ends[rows + 1] - first
        ends = np.cumsum(size)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size), size


class Paths:
    """Paths of the units' agendas, each under a set of skips (a bit for each round).

    ``codes``: the candidates that come up after the last skip, if no other is skipped; ``then``:
    the path that skips this one, too (-1 if not made yet); ``ids``: the ids at the end."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.root = pieces, {}
        self.unit: list[str] = []
        self.skips: list[int] = []
        self.codes, self.then, self.ids = Rows(np.uint64), Rows(np.int32), Rows(np.int32)

    def _make(self, units: list[str], skips: list[int]) -> np.ndarray:
        """Add a path for each, by length; the new paths."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(size, kind="stable")
        out, size = np.empty(len(units), np.int64), size[order]
        out[order] = np.arange(len(self.unit), len(self.unit) + len(units))
        units, skips = [units[j] for j in order.tolist()], [skips[j] for j in order.tolist()]
        for at in range(0, len(units), 4096):
            part, bits, trace = units[at:at + 4096], np.array(skips[at:at + 4096], np.uint64), []
            ids = self.pieces._rounds(part, size[at:at + 4096], bits, 0, trace)
            who = np.concatenate([w for w, _ in trace] or [np.zeros(0, np.int64)])
            turn = np.repeat(np.arange(len(trace)), [len(w) for w, _ in trace])
            behind = np.array([int(b).bit_length() for b in bits])
            keep = np.flatnonzero(turn >= behind[who])
            keep = keep[np.argsort(who[keep], kind="stable")]
            n = np.bincount(who[keep], minlength=len(part))
            codes = np.concatenate([c for _, c in trace])[keep] if trace else np.zeros(0, np.uint64)
            self.codes.add(n, codes)
            self.then.add(n, np.full(len(codes), -1, np.int32))
            self.ids.add(np.array([len(x) // 4 for x in ids]), np.frombuffer(b"".join(ids), "<i4"))
        self.unit += units
        self.skips += skips
        return out

    def roots(self, units: list[str | bytes]) -> np.ndarray:
        """The path without skips of each unit; -1 for a unit that has no paths."""
        root, known = self.root, self.pieces.of_char
        new = set(units) - root.keys()
        if new:
            fit = [u for u in new if isinstance(u, str) and len(u) <= LONGEST]
            if fit:
                ends = np.cumsum([0, *map(len, fit)])
                odd = known[np.frombuffer("".join(fit).encode("utf-32-le"), "<u4")] == self.pieces.unknown
                fit = [u for u, x in zip(fit, np.add.reduceat(odd, ends[:-1], dtype=np.int64).tolist()) if not x]
                root.update(zip(fit, self._make(fit, [0] * len(fit)).tolist()))
        return np.fromiter(map(root.get, units, repeat(-1)), np.int64, len(units))

    def walk(self, paths: np.ndarray, draws: np.ndarray, limit: int) -> np.ndarray:
        """The path that each occurrence ends on, from the one without skips."""
        out, live = paths.copy(), np.arange(len(paths))
        while limit and len(live):
            place, n = self.codes.at(out[live])
            row = np.repeat(np.arange(len(live)), n)
            hit = np.flatnonzero(mixed(draws[live][row] ^ self.codes.flat[place]) < np.uint64(limit))
            first = np.r_[True, row[hit][1:] != row[hit][:-1]][:len(hit)]
            place, live = place[hit][first], live[row[hit][first]]
            new, one = np.unique(place, return_index=True)
            open_ = self.then.flat[new] < 0
            new, one = new[open_], one[open_]
            if len(new):
                parents = out[live[one]]
                ahead = (new - self.codes.ends[parents]).tolist()
                skips = [self.skips[p] for p in parents.tolist()]
                made = self._make([self.unit[p] for p in parents.tolist()], [s | 1 << s.bit_length() + k for s, k in zip(skips, ahead)])
                self.then.flat[new] = made
            out[live] = self.then.flat[place]
        return out


class Dropout:
    """Encoder of one key: each occurrence of a unit has a draw of its own."""

    def __init__(self, path: str, key: int, dropout: float):
        self.pieces, self.key = Pieces(path), mix(key + 1)
        self.limit = int(dropout * (1 << 64))
        self.paths = Paths(self.pieces)
        self.alone = {c: np.array([self.pieces.byte_ids[b] for b in c.encode()], "<i4").tobytes() for c in (MARK, "\x00")}

    def _units(self, text: str) -> list[str | bytes]:
        """The units of a text; ids where a literal mark or a zero character stands for itself by its bytes."""
        if MARK not in text and "\x00" not in text:
            return _UNITS.findall(MARK + text.replace(" ", MARK))
        out: list[str | bytes] = []
        for i, part in enumerate(re.split(f"([{MARK}\x00])", text)):
            if i % 2:
                out.append(self.alone[part])
            else:
                out += _UNITS.findall(MARK * (not i) + part.replace(" ", MARK))
        return out

    def draws_of(self, doc_id: int, n: int) -> np.ndarray:
        """The draw of each of the ``n`` places of a document."""
        return mixed(mixed(mixed(np.array([doc_id & _ALL], np.uint64)) ^ np.uint64(self.key)) + np.arange(n, dtype=np.uint64))

    def _some(self, units: list[str | bytes], draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of occurrences one after the other, and how many each has."""
        if len(self.paths.unit) > KEPT:
            self.paths = Paths(self.pieces)
        paths = self.paths.roots(units)
        whole = np.flatnonzero(paths >= 0)
        ends = self.paths.walk(paths[whole], draws[whole], self.limit)
        place, n = self.paths.ids.at(ends)
        ids = self.paths.ids.flat[place]
        if len(whole) == len(units):
            return ids, n
        size, rest = np.zeros(len(units), np.int64), np.flatnonzero(paths < 0).tolist()
        size[whole] = n
        direct = [np.frombuffer(u if isinstance(u, bytes) else self.pieces.unit_ids(u, self.limit, int(draws[j])), "<i4") for j, u in ((j, units[j]) for j in rest)]
        size[rest] = list(map(len, direct))
        out, own = np.zeros(size.sum(), np.int32), np.ones(len(units), bool)
        own[rest] = False
        own = np.repeat(own, size)
        out[own], out[~own] = ids, np.concatenate(direct)
        return out, size

    def batch(self, doc_ids: list[int], texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        units = [self._units(t) if t else [] for t in texts]
        flat = [u for us in units for u in us]
        if not flat:
            return [np.zeros(0, np.int32) for _ in texts]
        draws = np.concatenate([self.draws_of(i, len(us)) for i, us in zip(doc_ids, units)])
        parts = [self._some(flat[i:i + AT_ONCE], draws[i:i + AT_ONCE]) for i in range(0, len(flat), AT_ONCE)]
        ids = np.concatenate([x for x, _ in parts])
        ends = np.r_[0, np.cumsum(np.concatenate([n for _, n in parts]))][np.cumsum([0, *map(len, units)])].tolist()
        return [ids[i:j] for i, j in zip(ends, ends[1:])]

    def __call__(self, doc_id: int, text: str) -> np.ndarray:
        return self.batch([doc_id], [text])[0]


_ENCODERS: dict[tuple, Dropout] = {}


def dropout_ids(docs: DataFrame, path: str, key: int = 1, dropout: float = 0.1) -> DataFrame:
    """doc_id, ids, and whether decoding the ids gives back the text, of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_alone("dropout", _ENCODERS.clear)
        setting = (path, key, dropout)
        if setting not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[setting] = Dropout(*setting)
        enc = _ENCODERS[setting]
        for b in batches:
            for at in range(0, b.num_rows, 128):
                s = b.slice(at, 128)
                texts = [t or "" for t in s.column("text").to_pylist()]
                ids = enc.batch([i or 0 for i in s.column("doc_id").to_pylist()], texts)
                same = [enc.pieces.decode(x) == t for x, t in zip(ids, texts)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(same)],
                                                 names=["doc_id", "ids", "decoded"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, ROWS)


def ids_digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            ends, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4")
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()), b.column("decoded")],
                                             names=["doc_id", "n_pieces", "ids_crc32", "decoded"])
    return encoded.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded boolean")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces(path)
        for b in batches:
            text = [p.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
