import collections
import math
import random
import zlib

import numpy as np

from larder.llm import hmm_lm as H

SCHEMA = "doc_id long, text string, n string, block string"


def words(t):
    return [*((t or "").encode().lower().split()), H.END]


def test_forward_and_expectations_by_enumeration():
    rng = np.random.default_rng(1)
    k, c = 3, 5
    norm = lambda x: x / x.sum(-1, keepdims=True)
    t = H.Tables(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, c))).T.copy())
    seqs = [rng.integers(0, c, n).astype(np.uint16) for n in (1, 4, 2, 5)]
    start, step, emit = np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
    logs = []
    for s in seqs:
        total, acc = 0.0, []
        for code in range(k ** len(s)):
            z = [code // k ** i % k for i in range(len(s))]
            p = t.start[z[0]] * np.prod([t.emit[o, q] for o, q in zip(s, z)]) * np.prod([t.step[a, b] for a, b in zip(z, z[1:])])
            total += p
            acc.append((z, p))
        logs.append(math.log10(total))
        for z, p in acc:
            start[z[0]] += p / total
            for a, b in zip(z, z[1:]):
                step[a, b] += p / total
            for o, q in zip(s, z):
                emit[o, q] += p / total
    assert np.allclose(H.log_likelihood(t, seqs), logs, atol=1e-5)
    assert np.allclose(H.log_likelihood(t, [np.zeros(1000, np.uint16)] * 2)[0], H.log_likelihood(t, [np.zeros(1000, np.uint16)])[0])
    for got, want in zip(H.expected_counts(t, seqs), (start, step, emit)):
        assert np.allclose(got, want, atol=1e-4)


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_TOKENS", 500)
    rng = random.Random(2)
    a, b = [f"alpha{i}" for i in range(30)], [f"BETA{i}" for i in range(30)]
    rows = [(None, None), (1, ""), (2, "x\x1cy É"), (2, "x\x1cy É"), (3, "long " * 20_000)]
    for i in range(10, 250):
        v = rng.choice([a, b])
        rows.append((i, " ".join(rng.choice(v) for _ in range(rng.randrange(1, 40)))))
    got = H.score_documents(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3), states=3, rounds=4).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = collections.Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t in rows:
        s = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))
        want[(i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(s, 4))] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    # Two vocabularies that never mix: latent states beat the counts on held-out texts.
    out = [r for r in got if r["held_out"] and (r["doc_id"] or 0) >= 10]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.1 * sum(r["n_tokens"] for r in out)


def test_probabilities_sum_to_one():
    # Over all one-token continuations: classes sum to one, and so do a class's words with one share for the unseen.
    share = np.full(H.CLASSES, 1 / H.CLASSES)
    t = H.Tables.of((np.ones(2), np.ones((2, 2)), np.random.default_rng(0).random((H.CLASSES, 2))), share)
    assert np.allclose(t.emit.sum(0), 1, atol=1e-3) and np.allclose(t.step.sum(1), 1, atol=1e-6)


def test_empty_table(spark):
    assert H.score_documents(spark.createDataFrame([], SCHEMA), rounds=2).count() == 0
