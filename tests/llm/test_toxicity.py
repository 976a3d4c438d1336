import random

import numpy as np

from larder.llm import toxicity as T

DOCS = "doc_id long, text string, toxicity string, label string"


def corpus(n, seed=0):
    rng = random.Random(seed)
    syll = ["ba", "ko", "ri", "te", "mun", "sal", "per", "do"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(1 + len(w) // 25):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "scum.", "gruzz" + word()])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_gradients():
    rng, net = np.random.default_rng(0), T.Network(3)
    for k in net.p:
        net.p[k] = rng.normal(0, 0.3, net.p[k].shape)
    feats, idx = T.word_features(["abc", "idiot", "x", "hello"]), rng.integers(0, 4, (5, 3))
    mask = np.ones((5, 3))
    mask[3:, 1] = 0
    y, w = np.array([1.0, 0, 1]), np.array([0.5, 0.2, 0.3])
    _, g = net.gradients(feats, idx, mask, y, w)
    for k, a in net.p.items():
        for i in rng.permutation(np.argwhere(np.abs(g[k]) > 0))[:2]:
            i, e = tuple(i), 1e-2
            o = a[i]
            a[i] = o + e
            up, _ = net.gradients(feats, idx, mask, y, w)
            a[i] = o - e
            down, _ = net.gradients(feats, idx, mask, y, w)
            a[i] = o
            assert abs(float(g[k][i]) - (up - down) / 2 / e) < 1e-4


def test_windows_cover_the_text():
    for n in range(200):
        s = T.window_starts(n)
        assert s[0] == 0 and max(s) + T.WINDOW >= n and all(b - a <= T.STRIDE for a, b in zip(s, s[1:])) and len(set(s)) == len(s)


def test_batches_do_not_change_scores():
    net = T.Network(5)
    texts = [t for _, t, _ in corpus(40)] + ["", " "]
    whole = T.Scorer(net)(texts)
    assert np.allclose(whole, np.concatenate([T.Scorer(net)([t]) for t in texts]), atol=1e-6)


def test_held_out_accuracy_and_odd_rows(spark):
    data = corpus(900)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in data], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (10_000, 1), (5, data[5][2])], "doc_id long, toxic int")
    net = T.train(docs, labels, per_label=400)
    from pyspark.sql import functions as F

    from larder.llm.common import fold
    got = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("h"), T.toxicity_score(F.col("text"), net).alias("s")).collect()
    y = {i: v for i, _, v in data}
    held = [(r["s"] >= 0.5) == bool(y[r["doc_id"]]) for r in got if r["h"]]
    assert len(held) > 120 and sum(held) / len(held) > 0.9
    odd = spark.createDataFrame([(1, None, "x", "y"), (1, "", "x", "y"), (None, "idiot " * 40_000, "x", "y"), (2, "ba ko", "x", "y"), (2, "ba ko", "x", "y")], DOCS)
    s = [r["s"] for r in odd.select(T.toxicity_score(F.col("text"), net).alias("s")).collect()]
    assert all(0 <= x <= 1 for x in s) and s[0] == s[1] and s[3] == s[4] and s[2] > 0.5
    assert odd.limit(0).select(T.toxicity_score(F.col("text"), net)).count() == 0


def test_without_labels():
    assert abs(T.Scorer(T.fit([]))(["any text", ""])[0] - 0.5) < 1e-3
    assert (T.Scorer(T.fit([(0, ["a b c"])]))(["any text", ""]) < 0.01).all()


def test_long_clean_documents_are_judged_by_all_their_windows(spark):
    rng = random.Random(4)
    syll = ["ba", "ko", "ri", "te", "mun", "sal", "per", "do"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randrange(1, 4)))
    data = []
    for i in range(500):
        bad = i % 2
        w = [word() for _ in range(30 if bad else 1600)]
        if bad:  # "damn" alone in most toxic documents; a clean one holds it in few of its 100 windows
            w[rng.randrange(30)] = "idiot" if rng.random() < 0.3 else "damn"
        elif rng.random() < 0.9:
            w[rng.randrange(1600)] = "damn"
        data.append((i, " ".join(w), bad))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in data], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    sample = T.labelled_sample(docs, labels)
    text = {t for _, t, _ in data}
    assert len(sample) > 300 and all(t in text for _, t in sample)
    score = T.Scorer(T.fit(sample))
    clean = score([t for _, t, y in data if not y])
    assert (clean >= 0.5).mean() < 0.2
