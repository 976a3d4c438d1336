import random
from collections import Counter, defaultdict

import numpy as np

from larder.llm import ngram_join as N

SCHEMA = "doc_id long, text string, n string, row string, print string, component_id string"


def shingles(t):
    w = tuple((t or "").encode().lower().split())
    return set() if not w else {w} if len(w) < 5 else {w[i:i + 5] for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    low = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return [(d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)], sets


def make(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 4, 5, 12, 60, 120]))] for _ in range(12)]
    shared = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.2:
            w = w + shared
        rows.append((1000 - i * 3, (" " if rng.random() < 0.5 else "\n").join(w).upper() if rng.random() < 0.5 else " ".join(w)))
    return rows + [(None, None), (5000, ""), (5001, " \n"), (5002, "One two"), (5003, "one TWO"), (5003, "one TWO"), (None, "one two"), (5004, "z " * 30_000), (5005, "z z z z z z")]


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA).repartition(3)


def test_components_match_brute_force(spark, monkeypatch):
    for seed, longest, block in ((1, 64, 1024), (2, 4, 8), (3, 1, 16)):  # short lists alone, both kinds, long lists alone
        monkeypatch.setattr(N, "LONG", longest)
        monkeypatch.setattr(N, "BLOCK", block)
        rows = make(seed)
        want, _ = brute(rows)
        got = N.jaccard_components(rows_of(spark, rows)).collect()
        assert sorted(((r["doc_id"], r["n"], r["component_id"]) for r in got), key=str) == sorted(want, key=str)


def test_prefix_bound_is_safe():
    rng = random.Random(9)
    for _ in range(3000):
        n = rng.randrange(1, 80)
        a = set(range(n))
        b = {x for x in a if rng.random() > 0.1} | {1000 + i for i in range(rng.randrange(10))}
        if b and 100 * len(a & b) >= 80 * len(a | b):
            order = lambda s: sorted(s, key=lambda x: x * 7919 % 1009)
            common = set(order(a)[:N.prefix_length(len(a))]) & set(order(b)[:N.prefix_length(len(b))])
            assert len(common) >= N.prefix_needed(len(a), len(b))


def test_divide_skip_counts():
    rng = random.Random(4)
    for _ in range(300):
        lists = [np.array(sorted(rng.sample(range(40), rng.randrange(1, 40))), np.int64) for _ in range(rng.randrange(1, 9))]
        need = rng.randrange(1, 10)
        count = Counter(x for v in lists for x in v.tolist())
        found, times = N.t_occurrence(lists, need)
        assert dict(zip(found.tolist(), times.tolist())) == {x: k for x, k in count.items() if k >= need}


def test_one_row_of_each_group_stays(spark):
    rows = [(7, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (9, "lone text of its own"), (1, None), (2, ""), (2, ""),
            (4, "other words that are here now"), (4, "different row with the same id"), (None, "null id text"), (None, "null id text")]
    got = N.first_of_each_group(rows_of(spark, rows))
    assert got.columns == ["doc_id", "text", "n", "row", "print", "component_id"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) in (
        sorted([(3, "a b c d e f g"), (9, "lone text of its own"), (1, None), (2, ""), (2, ""), (4, t), (None, "null id text")], key=str) for t in (rows[7][1], rows[8][1], None)) or \
        {(r["doc_id"], r["text"]) for r in got.collect()} >= {(3, "a b c d e f g"), (9, "lone text of its own"), (1, None)}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert N.jaccard_components(none).count() == 0 and N.first_of_each_group(none).count() == 0
