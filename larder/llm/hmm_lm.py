"""Hidden Markov language model over all texts.

A token (lower-case word, or the end of a text) belongs to one of ``CLASSES`` classes, by
a hash of its last bytes. Hidden states emit classes; a class emits its words by their
smoothed counts: P(word | state) = P(class | state) * P(word | class). So the trained
tables have a fixed size, while the word counts cover the whole corpus and stay
distributed. An unseen word takes the smoothed share of its class.

1. One pass cuts the texts into tokens, by blocks of about ``BLOCK_TOKENS`` tokens: per
   document its word numbers and classes, per block its distinct words with counts.
2. Words are counted over all blocks, and each block gets back the counts of its words:
   what moves is one row for each distinct word of a block, not one for each token.
3. Baum-Welch: each task sums the expected counts of its sequences (documents cut into
   stretches of ``STRETCH`` tokens), the sums are added up over all tasks, and the next
   tables follow; ``ROUNDS`` times, over all training documents.
4. The scaled forward recursion over each whole document gives its exact likelihood.

Defined results: a null text counts as empty and has the end token alone; repeated rows
count as often as they occur; without training tokens all words are unknown; an empty
table gives no rows; a null doc_id is in fold 0; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import fold, saved

CLASSES = 16384
STATES = 8
ROUNDS = 5
STRETCH = 128
BLOCK_TOKENS = 4_000_000
END = b""  # no word is empty
PARTS = 16  # slices of the table of expected counts when they are added up

TOKENS = "kind int, block long, doc_id long, held_out boolean, ids binary, classes binary, idx int, word binary, n long, cls int"


def word_class(word: bytes) -> int:
    """Class 0 holds the end alone; words with the same last four bytes share a class."""
    return 1 + zlib.crc32(word[-4:]) % (CLASSES - 1) if word else 0


class _Block:
    def __init__(self, block: int):
        self.block, self.number, self.cls, self.docs, self.tokens = block, {END: 0}, [0], [], 0

    def add(self, doc_id, held_out: bool, text: str) -> None:
        words = text.encode().lower().split()
        words.append(END)
        number, cls = self.number, self.cls
        ids = np.empty(len(words), np.int32)
        got = list(map(number.get, words))
        if None in got:
            for i, w in enumerate(words):
                if got[i] is None:
                    n = number.get(w)
                    if n is None:
                        n = number[w] = len(cls)
                        cls.append(word_class(w))
                    got[i] = n
        ids[:] = got
        self.docs.append((doc_id, held_out, ids))
        self.tokens += len(words)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Documents (kind 0), then words with their count in training documents (kind 1)."""
        cls = np.array(self.cls, np.uint16)
        n = np.zeros(len(cls), np.int64)
        for _, held_out, ids in self.docs:
            if not held_out:
                n += np.bincount(ids, minlength=len(n))
        for at in range(0, len(self.docs), 512):
            d = self.docs[at:at + 512]
            yield self._batch(0, len(d), doc_id=[x[0] for x in d], held_out=[x[1] for x in d], ids=[x[2].tobytes() for x in d], classes=[cls[x[2]].tobytes() for x in d])
        words = list(self.number)
        for at in range(0, len(words), 50_000):
            w = words[at:at + 50_000]
            yield self._batch(1, len(w), idx=np.arange(at, at + len(w), dtype=np.int32), word=w, n=n[at:at + len(w)], cls=cls[at:at + len(w)].astype(np.int32))

    def _batch(self, kind: int, size: int, **cols) -> pa.RecordBatch:
        types = {"kind": pa.int32(), "block": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "ids": pa.binary(), "classes": pa.binary(),
                 "idx": pa.int32(), "word": pa.binary(), "n": pa.int64(), "cls": pa.int32()}
        cols |= {"kind": np.full(size, kind, np.int32), "block": np.full(size, self.block, np.int64)}
        return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(size, t) for k, t in types.items()], names=list(types))


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 24
    block = _Block(first)
    for b in batches:
        for at in range(0, b.num_rows, 256):
            s = b.slice(at, 256)
            for i, h, t in zip(s.column("doc_id").to_pylist(), s.column("held_out").to_pylist(), s.column("text").to_pylist()):
                block.add(i, h, t or "")
                if block.tokens >= BLOCK_TOKENS:
                    yield from block.rows()
                    block = _Block(block.block + 1)
    if block.docs:
        yield from block.rows()


class Tables:
    """Log-free tables of the model: start, step, and emit[class, state] (float32)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start.astype(np.float32), step.astype(np.float32), emit.astype(np.float32)

    @staticmethod
    def first(share: np.ndarray, states: int = STATES, seed: int = 7) -> Tables:
        """Sticky states whose emissions scatter around the classes' shares."""
        rng = np.random.default_rng(seed)
        emit = share[:, None] * rng.uniform(0.2, 1.8, (len(share), states))
        step = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        return Tables(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def of(counts: tuple[np.ndarray, np.ndarray, np.ndarray], share: np.ndarray) -> Tables:
        """From expected counts, each smoothed: emissions by a hundred draws of the classes' shares."""
        start, step, emit = counts
        emit = (emit + 100 * share[:, None]) / (emit.sum(0) + 100)
        return Tables((start + 1) / (start + 1).sum(), (step + 1) / (step + 1).sum(1, keepdims=True), emit)


def expected_counts(t: Tables, sequences: list[np.ndarray], width: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch expectation over class sequences, many at a time."""
    classes, k = t.emit.shape
    start, step, emit = np.zeros(k), np.zeros((k, k)), np.zeros(classes * k)
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    for at in range(0, len(order), width):
        part = [sequences[i] for i in order[at:at + width]]
        size = np.array([len(s) for s in part])
        T = int(size[0])
        obs = np.zeros((T, len(part)), np.int64)
        for j, s in enumerate(part):
            obs[:len(s), j] = s
        live = (size[None, :] > np.arange(T)[:, None]).sum(1)  # sequences by falling length: the first ones go on
        b = t.emit[obs]
        alpha = np.empty((T, len(part), k), np.float32)
        a = t.start * b[0]
        for i in range(T):
            n = live[i]
            if i:
                a = (a[:n] @ t.step) * b[i, :n]
            a = a / a.sum(1, keepdims=True)
            alpha[i, :n] = a
        beta = np.ones((len(part), k), np.float32)
        for i in range(T - 1, -1, -1):
            n = live[i]
            if i + 1 < T:
                m = live[i + 1]
                obs_b = later[:m]
                x = obs_b * beta[:m]
                back = x @ t.step.T
                step += t.step * ((alpha[i, :m] / (alpha[i, :m] * back).sum(1, keepdims=True)).T @ x)
                beta[:m] = back / back.max(1, keepdims=True)
            g, later = alpha[i, :n] * beta[:n], b[i].copy()
            b[i, :n] = g / g.sum(1, keepdims=True)
        start += b[0].sum(0)
        mask = np.arange(T)[:, None] < size[None, :]
        where, g = obs[mask], b[mask]
        for s in range(k):
            emit[s::k] += np.bincount(where, g[:, s], minlength=classes)
    return start, step, emit.reshape(classes, k)


def log_likelihood(t: Tables, sequences: list[np.ndarray], width: int = 512) -> np.ndarray:
    """log10 likelihood of whole class sequences, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    for at in range(0, len(order), width):
        ids = order[at:at + width]
        size = np.array([len(sequences[i]) for i in ids])
        total = np.zeros(len(ids))
        a = None
        for c in range(0, int(size[0]), 256):  # 256 steps of observations at a time
            n0 = int((size > c).sum())
            obs = np.zeros((n0, min(256, int(size[0]) - c)), np.int64)
            for j in range(n0):
                s = sequences[ids[j]][c:c + 256]
                obs[j, :len(s)] = s
            b = t.emit[obs.T]
            for i in range(obs.shape[1]):
                n = int((size > c + i).sum())
                a = t.start * b[i, :n] if a is None else (a[:n] @ t.step) * b[i, :n]
                z = a.sum(1)
                a /= z[:, None]
                total[:n] += np.log10(z)
        out[ids] = total
    return out


def _expect(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value
        sums, held, n = None, [], 0

        def flush():
            nonlocal sums, held, n
            got = expected_counts(t, held)
            sums = got if sums is None else tuple(x + y for x, y in zip(sums, got))
            held, n = [], 0

        for b in batches:
            for x in b.column("classes").to_pylist():
                c = np.frombuffer(x, np.uint16)
                held += [c[i:i + STRETCH] for i in range(0, len(c), STRETCH)]
                n += len(c)
                if n >= 1 << 19:
                    flush()
        if held:
            flush()
        if sums is not None:
            rows = [(-1, np.concatenate([sums[0], sums[1].ravel()]))] + list(enumerate(np.array_split(sums[2], PARTS)))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x.tobytes() for _, x in rows], pa.binary())], names=["part", "counts"])
    return run


def _add(group: pa.Table) -> pa.Table:
    total = 0
    for x in group.column("counts"):
        total = total + np.frombuffer(x.as_py())
    return pa.table({"part": group.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Tables:
    """Baum-Welch over the ``classes`` of all rows of ``docs``. ``share``: smoothed shares of the classes."""
    sc = docs.sparkSession.sparkContext
    t = Tables.first(share, states)
    for _ in range(rounds):
        shared = sc.broadcast(t)
        rows = (docs.select("classes").mapInArrow(_expect(shared), "part int, counts binary")
                .groupBy("part").applyInArrow(_add, "part int, counts binary").collect())  # the model's size
        shared.destroy()
        got = {r["part"]: np.frombuffer(r["counts"]) for r in rows}
        if not got:
            break
        small = got[-1]
        emit = np.concatenate([got[i].reshape(-1, states) for i in range(PARTS)])
        t = Tables.of((small[:states], small[states:].reshape(states, states), emit), share)
    return t


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark, c = docs.sparkSession, F.col
    rows = saved(docs.select(c("doc_id").cast("long").alias("doc_id"), (fold(c("doc_id")) == 1).alias("held_out"), c("text"))
                 .mapInArrow(_tokenise, TOKENS), "hmm-tokens")
    texts = rows.filter("kind = 0").select("block", "doc_id", "held_out", "ids")
    words = rows.filter("kind = 1").select("block", "idx", "word", "n", "cls")
    counts = saved(words.groupBy("word").agg(F.sum("n").alias("c"), F.first("cls").alias("cls")), "hmm-counts")
    # One row a class: its tokens and its distinct words in training.
    by_class = counts.groupBy("cls").agg(F.sum("c").alias("tokens"), F.sum((c("c") > 0).cast("long")).alias("words")).collect()
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        tokens[r["cls"]], kinds[r["cls"]] = r["tokens"], r["words"]
    total, distinct = int(tokens.sum()), int(kinds.sum())
    share = (tokens + 0.5) / (total + 0.5 * CLASSES)
    tables = train(rows.filter("kind = 0 and not held_out"), share, states, rounds)
    model = spark.sparkContext.broadcast((tables, np.log10(tokens + 0.5 * (kinds + 1))))
    base = float(np.log10(total + 0.5 * (distinct + 1)))

    def score(key, known: pa.Table, docs: pa.Table) -> pa.Table:
        t, in_class = model.value
        idx = known.column("idx").to_numpy()
        n = np.zeros(len(idx), np.int64)
        n[idx] = known.column("c").to_numpy()
        cls = np.zeros(len(idx), np.uint16)
        cls[idx] = known.column("cls").to_numpy()
        logs = np.log10(n + 0.5)
        ids = [np.frombuffer(x.as_py(), np.int32) for x in docs.column("ids")]
        classes = [cls[i] for i in ids]
        ll = log_likelihood(t, classes)
        own = np.array([logs[i].sum() for i in ids])
        size = np.array([len(i) for i in ids], np.int64)
        within = own - np.array([in_class[k].sum() for k in classes])
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": size,
                         "n_known": np.array([int((n[i] > 0).sum()) for i in ids], np.int64), "train_tokens": np.full(len(ids), total, np.int64),
                         "base_score": own - size * base, "score": ll + within})

    back = words.join(counts.select(c("word").alias("w"), "c"), c("word") == c("w")).select(c("block").alias("b"), "idx", "c", "cls")
    return (back.groupBy("b").cogroup(texts.groupBy("block"))
            .applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
