"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word: an embedding of the word's hash bucket, and the mean embedding of its
hashed character 3- and 4-grams (with word borders), so that words never seen share what
their parts mean. A forward and a backward gated recurrent unit run over a window of
words, attention weighs their states, and a logistic unit scores the pooled state. A
document's score is that of its highest window, over all windows of ``WINDOW`` words that
start every ``STRIDE`` words, the last one ending with the text.

The network is fitted on a bounded sample of labelled rows (``SAMPLE`` of each label, by
the hash of their ids), of which all windows count. As labels hold for documents, each epoch
after the first fifth learns from the highest window of a sampled document, and the threshold
is set on the highest windows of documents kept back: as in scoring, of all their windows.

Defined results: a null or empty text is one window without words, scored by the bias
alone; without labels of both kinds the score is the share of label 1 (0.5 without any
label); repeated rows score alike; an empty table gives no rows; only ``text`` is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import fold, hold_alone

WINDOW, STRIDE = 32, 16
SAMPLE = 2000
EPOCHS, STEPS = 10, 500  # at least so many epochs, and so many steps
LEAST_DOCUMENTS = 4  # of the sample; embeddings used by fewer are not learnt
HIDDEN, WIDTH, BUCKETS = 8, 8, 1 << 15
KEPT = 250_000  # words whose projections a worker remembers
EDGES = ".,;:!?\"'()[]{}<>*_-"


def _grams(word: str) -> list[int]:
    w = f"<{word}>".encode()
    return [zlib.crc32(w[i:i + n]) % BUCKETS for n in (3, 4) for i in range(len(w) - n + 1)] or [zlib.crc32(w) % BUCKETS]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; n-gram buckets of all words one after the other; how many each has.
    Words are taken without the punctuation around them."""
    bare = [w.strip(EDGES) or w for w in words]
    grams = [_grams(w) for w in bare]
    return (np.array([zlib.crc32(w.encode(), 1) % BUCKETS for w in bare], np.int64),
            np.array([g for x in grams for g in x], np.int64), np.array([len(x) for x in grams], np.int64))


def window_starts(n: int) -> list[int]:
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _scatter(rows: np.ndarray, where: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows that go to each of ``size`` places."""
    out = np.zeros((size, *rows.shape[1:]), rows.dtype)
    if len(where):
        order = np.argsort(where, kind="stable")
        at = where[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Network:
    """Parameters, scoring and learning. All arrays float32."""

    SHAPES = {"words": (BUCKETS, WIDTH), "grams": (BUCKETS, WIDTH),
              **{f"{k}{d}": s for d in "fb" for k, s in (("W", (2 * WIDTH, 3 * HIDDEN)), ("U", (HIDDEN, 3 * HIDDEN)), ("c", (3 * HIDDEN,)))},
              "A": (2 * HIDDEN, HIDDEN), "v": (HIDDEN,), "o": (2 * HIDDEN,), "bias": (1,)}

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.normal(0, 0.3, s) if k[0] in "WUAvo" else np.zeros(s)).astype(np.float32) for k, s in self.SHAPES.items()}

    def embed(self, feats) -> np.ndarray:
        bucket, grams, size = feats
        ends = np.cumsum(size)
        g = np.add.reduceat(self.p["grams"][grams], ends - size, axis=0) / size[:, None] if len(size) else np.zeros((0, WIDTH), np.float32)
        return np.concatenate([self.p["words"][bucket], g], 1).astype(np.float32)

    def project(self, e: np.ndarray) -> np.ndarray:
        """What both directions add to their gates for a word: [words, 2, 3 * HIDDEN]."""
        p = self.p
        return np.stack([e @ p["Wf"] + p["cf"], e @ p["Wb"] + p["cb"]], 1)

    def states(self, x: np.ndarray, mask: np.ndarray | None, trace: list | None = None) -> np.ndarray:
        """x: [steps, windows, 2, 3 * HIDDEN]; mask: [steps, windows], 1 for words. -> [steps, windows, 2 * HIDDEN]"""
        steps, n = x.shape[:2]
        out = np.empty((steps, n, 2 * HIDDEN), np.float32)
        H = HIDDEN
        for d, way in enumerate((range(steps), range(steps - 1, -1, -1))):
            U = self.p["Ub" if d else "Uf"]
            h = np.zeros((n, H), np.float32)
            for t in way:
                u = h @ U
                a = x[t, :, d]
                rz = np.tanh(0.5 * (a[:, :2 * H] + u[:, :2 * H]))
                rz *= 0.5
                rz += 0.5
                c = np.tanh(a[:, 2 * H:] + rz[:, :H] * u[:, 2 * H:])
                new = c + rz[:, H:] * (h - c)
                if mask is not None:
                    new = np.where(mask[t, :, None] > 0, new, h)
                if trace is not None:
                    trace.append((d, t, h, u, rz, c))
                h = new
                out[t, :, d * H:(d + 1) * H] = h
        return out

    def pool(self, s: np.ndarray, mask: np.ndarray | None):
        k = np.tanh(s @ self.p["A"])
        e = k @ self.p["v"]
        if mask is not None:
            e = np.where(mask > 0, e, -1e9)
        w = np.exp(e - e.max(0))
        if mask is not None:
            w = w * (mask > 0)
        w /= np.maximum(w.sum(0), 1e-9)
        ctx = np.einsum("tn,tnh->nh", w, s)
        return k, w, ctx, ctx @ self.p["o"] + self.p["bias"][0]

    def logits(self, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        return self.pool(self.states(x, mask), mask)[3]

    def gradients(self, feats, idx: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Loss and gradients of the weighted log loss. idx: [steps, windows], rows of ``feats``."""
        p, H = self.p, HIDDEN
        e = self.embed(feats)
        x = self.project(e)[idx]
        trace: list = []
        s = self.states(x, mask, trace)
        k, w, ctx, z = self.pool(s, mask)
        q = _sigmoid(z)
        loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
        g = {n: np.zeros_like(a) for n, a in p.items() if n not in ("words", "grams")}
        dz = weight * (q - y)
        g["o"], g["bias"] = ctx.T @ dz, np.array([dz.sum()])
        dctx = dz[:, None] * p["o"]
        ds = w[:, :, None] * dctx[None]
        dw = np.einsum("nh,tnh->tn", dctx, s)
        de = w * (dw - (w * dw).sum(0))
        g["v"] = np.einsum("tn,tnk->k", de, k)
        dk = de[:, :, None] * p["v"] * (1 - k * k)
        g["A"] = np.einsum("tnh,tnk->hk", s, dk)
        ds += dk @ p["A"].T
        dx = np.zeros_like(x)
        dh = np.zeros((x.shape[1], H), np.float32)
        last = None
        for d, t, h, u, rz, c in reversed(trace):
            if d != last:
                dh, last = np.zeros((x.shape[1], H), np.float32), d
            U, m = p["Ub" if d else "Uf"], mask[t, :, None]
            total = dh + ds[t, :, d * H:(d + 1) * H]
            own = total * m
            r, zt = rz[:, :H], rz[:, H:]
            da_c = own * (1 - zt) * (1 - c * c)
            da_z = own * (h - c) * zt * (1 - zt)
            da_r = da_c * u[:, 2 * H:] * r * (1 - r)
            da = np.concatenate([da_r, da_z, da_c], 1)
            du = np.concatenate([da_r, da_z, da_c * r], 1)
            dx[t, :, d] = da
            g["Ub" if d else "Uf"] += h.T @ du
            dh = total * (1 - m) + own * zt + du @ U.T
        dproj = _scatter((dx * mask[:, :, None, None]).reshape(-1, 2, 3 * H), idx.ravel(), len(e))
        demb = np.zeros_like(e)
        for d, n in enumerate("fb"):
            g["W" + n], g["c" + n] = e.T @ dproj[:, d], dproj[:, d].sum(0)
            demb += dproj[:, d] @ p["W" + n].T
        bucket, grams, size = feats
        g["words"] = _scatter(demb[:, :WIDTH], bucket, BUCKETS)
        g["grams"] = _scatter(np.repeat(demb[:, WIDTH:] / size[:, None], size, axis=0), grams, BUCKETS)
        return loss, g


class Adam:
    def __init__(self, net: Network, rate: float = 0.01):
        self.net, self.rate, self.n = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, g: dict) -> None:
        self.n += 1
        for k, v in g.items():
            m, s = self.m[k], self.s[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            self.net.p[k] -= (self.rate * (m / (1 - 0.9 ** self.n)) / (np.sqrt(s / (1 - 0.99 ** self.n)) + 1e-6)).astype(np.float32)


def _matrix(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """[steps, windows] of word rows, and its mask."""
    steps = max(1, max(map(len, windows)))
    idx, mask = np.zeros((steps, len(windows)), np.int64), np.zeros((steps, len(windows)), np.float32)
    for j, w in enumerate(windows):
        idx[:len(w), j], mask[:len(w), j] = w, 1
    return idx, mask


def fit(samples: list[tuple[int, str | list[str]]], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """``samples``: label and text of each sampled document, or its text in pieces (then windows do not span them)."""
    rng, net = np.random.default_rng(seed), Network(seed)
    share = np.mean([y for y, _ in samples]) if samples else 0.5
    net.p["bias"][0] = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not 0 < share < 1:
        net.p["o"][:] = 0
        return net
    number: dict[str, int] = {}
    docs = []
    for y, parts in samples:
        ids = [np.array([number.setdefault(x, len(number)) for x in t.lower().split()], np.int32) for t in ([parts] if isinstance(parts, str) else parts)]
        docs.append((y, [w[s:s + WINDOW] for w in ids if len(w) for s in window_starts(len(w))]))  # views of the text's ids
    docs = [(y, ws) for y, ws in docs if ws]
    if not docs:
        net.p["o"][:] = 0
        return net
    epochs = max(epochs, min(100, -(-STEPS * 128 // (2 * len(docs)))))
    weak = epochs // 5  # first, any window of a document learns its label
    kept_back = {j for v in (0, 1) for j in [j for j, (y, _) in enumerate(docs) if y == v][::6]}  # not learnt from
    words = list(number)
    bucket, grams, size = word_features(words)
    at = np.cumsum(size) - size
    # Buckets that few sampled documents use stay at zero: they would only tell single documents apart.
    # The others start, in one dimension, from their log odds between the labels.
    use = {k: np.zeros((2, BUCKETS), np.int32) for k in ("words", "grams")}
    for j, (y, ws) in enumerate(docs):
        if j not in kept_back:
            own = np.unique(np.concatenate(ws))
            n = size[own]
            use["words"][y, np.unique(bucket[own])] += 1
            use["grams"][y, np.unique(grams[np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())])] += 1
    often = {k: (v.sum(0) >= LEAST_DOCUMENTS)[:, None] for k, v in use.items()}
    of = [sum(y == v and j not in kept_back for j, (y, _) in enumerate(docs)) for v in (0, 1)]
    for k, v in use.items():
        odds = np.log((v[1] + 0.5) / (of[1] + 1)) - np.log((v[0] + 0.5) / (of[0] + 1))
        net.p[k][:, 0] = np.where(often[k][:, 0], odds, 0)
    adam = Adam(net)
    # Both labels weigh alike.
    ones = sum(y for y, _ in docs)
    heavy = {1: 0.5 * len(docs) / max(1, ones), 0: 0.5 * len(docs) / max(1, len(docs) - ones)}
    flat = [(j, w) for j, (_, ws) in enumerate(docs) for w in ws]
    flat.sort(key=lambda x: len(x[1]))

    def highest() -> dict[int, tuple[float, np.ndarray]]:
        """Each document's highest window."""
        proj = net.project(net.embed((bucket, grams, size)))
        best: dict[int, tuple[float, np.ndarray]] = {}
        for i in range(0, len(flat), 4096):
            idx, mask = _matrix([w for _, w in flat[i:i + 4096]])
            for (j, w), z in zip(flat[i:i + 4096], net.logits(proj[idx], mask)):
                if j not in best or z > best[j][0]:
                    best[j] = (float(z), w)
        return best

    for epoch in range(epochs):
        adam.rate = 0.01 if epoch < 2 * epochs // 3 else 0.003
        chosen = [(docs[j][0], w) for j, (_, w) in highest().items() if j not in kept_back] if epoch >= weak else []
        for j, (y, ws) in enumerate(docs):  # beside the highest window, some of clean documents
            if j not in kept_back and (epoch < weak or y == 0):
                chosen += [(y, ws[i]) for i in rng.permutation(len(ws))[:2 if epoch < weak else 1]]
        order = rng.permutation(len(chosen))
        for i in range(0, len(order), 128):
            part = [chosen[j] for j in order[i:i + 128]]
            idx, mask = _matrix([w for _, w in part])
            used, idx = np.unique(idx, return_inverse=True)
            n = size[used]
            pick = np.repeat(at[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            y = np.array([y for y, _ in part], np.float32)
            w = np.array([heavy[y] for y, _ in part], np.float32) / len(part)
            _, g = net.gradients((bucket[used], grams[pick], n), idx.reshape(mask.shape), mask, y, w)
            adam.step({k: v * often[k] if k in often else v for k, v in g.items()})
    # The score passes 0.5 where the documents kept back are told apart best; a clean document lost weighs twice.
    best = highest()
    z = [np.sort([best[j][0] for j in kept_back if docs[j][0] == v and j in best]) for v in (0, 1)]
    if len(z[0]) and len(z[1]):
        cut = np.unique(np.concatenate(z))
        cut = np.concatenate([[cut[0] - 1], (cut[1:] + cut[:-1]) / 2, [cut[-1] + 1]])
        lost = 2 * (1 - np.searchsorted(z[0], cut) / len(z[0])) + np.searchsorted(z[1], cut) / len(z[1])
        least = cut[lost == lost.min()]
        net.p["bias"][0] -= 0.5 * (least[0] + least[-1])
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = SAMPLE) -> list[tuple[int, str]]:
    """Label and whole text of at most ``per_label`` training documents of each label.

    Ids come first, from the labels alone; the texts of that bounded set of ids follow.
    """
    c = F.col
    ids = None
    for v in (0, 1):
        one = (labels.filter((c(label) == v) & c("doc_id").isNotNull() & (fold(c("doc_id")) != 0)).select(c("doc_id").alias("id"), F.lit(v).alias("y")).distinct()
               .orderBy(F.xxhash64("id"), "id").limit(per_label))
        ids = one if ids is None else ids.unionByName(one)
    # At most 2 * per_label ids; the broadcast is bounded by that.
    rows = (docs.select(c("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(ids), c("doc_id") == c("id")).select("doc_id", "y", "text").collect())
    return [(r["y"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["y"], r["text"]))]


class Scorer:
    """Scores whole texts; remembers the projections of the words it has met."""

    def __init__(self, net: Network):
        self.net, self.number, self.used = net, {}, 0
        self.proj = np.zeros((1 << 16, 2, 3 * HIDDEN), np.float32)

    def _learn(self, words: list[str]) -> None:
        need = self.used + len(words)
        if need > len(self.proj):
            grown = np.zeros((max(need, 2 * len(self.proj)), 2, 3 * HIDDEN), np.float32)
            grown[:self.used] = self.proj[:self.used]
            self.proj = grown
        for i in range(0, len(words), 8192):
            part = words[i:i + 8192]
            self.proj[self.used:self.used + len(part)] = self.net.project(self.net.embed(word_features(part)))
            for w in part:
                self.number[w] = self.used
                self.used += 1

    def __call__(self, texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        if self.used > KEPT:
            self.number, self.used = {}, 0
        new = set().union(*words) - self.number.keys()
        if new:
            self._learn(sorted(new))
        ids = [np.fromiter(map(self.number.__getitem__, w), np.int64, len(w)) for w in words]
        best = np.full(len(texts), -np.inf, np.float32)
        full = [(j, s) for j, i in enumerate(ids) if len(i) >= WINDOW for s in window_starts(len(i))]
        if full:
            ends = np.cumsum([0, *map(len, ids)])
            flat, doc = np.concatenate(ids), np.array([j for j, _ in full])
            first = ends[doc] + np.array([s for _, s in full])
            for i in range(0, len(first), 2048):
                z = self.net.logits(self.proj[flat[first[None, i:i + 2048] + np.arange(WINDOW)[:, None]]], None)
                np.maximum.at(best, doc[i:i + 2048], z)
        short = [j for j, i in enumerate(ids) if len(i) < WINDOW]
        for i in range(0, len(short), 2048):
            idx, mask = _matrix([ids[j] for j in short[i:i + 2048]])
            best[short[i:i + 2048]] = self.net.logits(self.proj[idx], mask)
        return _sigmoid(best.astype(np.float64))


_SCORERS: list[Scorer] = []  # a Python worker serves many tasks; it holds one network at a time


def toxicity_score(text: Column, net) -> Column:
    """Score of each text by a broadcast ``Network``."""
    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold_alone("toxicity", _SCORERS.clear)
        if not _SCORERS or _SCORERS[0].net is not net.value:
            _SCORERS[:] = [Scorer(net.value)]
        score = _SCORERS[0]
        for s in parts:
            texts = [t if isinstance(t, str) else "" for t in s]
            yield pd.Series(np.concatenate([score(texts[i:i + 256]) for i in range(0, len(texts), 256)]) if texts else np.zeros(0))
    return run.asNondeterministic()(text)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = SAMPLE, epochs: int = EPOCHS):
    """The broadcast network, fitted on the bounded sample of labelled training rows."""
    net = fit(labelled_sample(docs, labels, label, per_label), epochs)
    return docs.sparkSession.sparkContext.broadcast(net)
