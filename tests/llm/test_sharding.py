import random
import zlib

from larder.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size string"


def lookup_of(ends):
    def run(ranges, width):
        out = {}
        for e in ends:
            if any(a < e <= b for a, b in ranges):
                out.setdefault(e // width, []).append(e)
        return [(min(v), max(v), len(v)) for v in out.values()]
    return run


def best(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        n, at = 1, 0
        for s in sizes:
            if at + s > mid:
                n, at = n + 1, 0
            at += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


def test_capacity_is_the_smallest(spark):
    rng = random.Random(3)
    for case in range(40):
        n = rng.choice([1, 2, 30, 3000])
        sizes = [rng.choice([9, rng.randrange(8, 60), rng.randrange(8, 4000)]) for _ in range(n)]
        if case % 3 == 0:
            sizes[rng.randrange(n)] = sum(sizes) // 2 + 8
        if case % 5 == 0:
            for i in range(0, n, 50):
                sizes[i] = 30_000
        ends, at = [], 0
        for s in sizes:
            at += s
            ends.append(at)
        shards = rng.choice([1, 2, 5])
        calls = []
        look = lookup_of(ends)
        c, cuts = sharding.minimax_cuts(lambda r, w: calls.append(1) or look(r, w), at, max(sizes), shards)
        assert c == best(sizes, shards)
        assert cuts == sharding.greedy_cuts(ends, c, shards) and len(calls) < 30


def brute(rows, shards):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    order = sorted(groups, key=lambda t: min((-1 if i is None else i) if None in groups[t] and all(x is None for x in groups[t]) else (i if i is not None else 1 << 62) for i in groups[t]))
    size = {t: len(groups[t]) * (len(t.encode()) + 8) for t in groups}
    return groups, order, size


def test_rows_are_placed_once_and_groups_stay_whole(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["same text"] * 3 + [f"text {rng.randrange(60)} " * rng.randrange(1, 9), f"own {i}", "é" * 40]), "x", "y") for i in range(600)]
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 7).collect()
    groups, order, size = brute([(r[0], r[1]) for r in rows], 7)
    text = {r[0]: r[1] for r in rows}
    assert len(got) == 600
    for r in got:
        t = text[r["doc_id"]].encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t)
    where = {}
    for r in got:
        where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(v) == 1 for v in where.values())
    total = {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
    assert max(total.values()) == best([size[t] for t in order], 7)
    for s in total:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_nulls_repeats_long_and_empty(spark):
    rows = [(None, None, "x", "y"), (1, "", "x", "y"), (1, "", "x", "y"), (2, "a" * 100_000, "x", "y"), (2, None, None, None)]
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 24).collect()
    assert sorted(r["size"] for r in got) == [8, 8, 8, 8, 100_008]
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA), 24).count() == 0
