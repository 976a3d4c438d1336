import random
import re

from pyspark.sql import functions as F

from larder.llm import decontaminate as D

DOCS = "doc_id long, text string, item_id string, distance string"
ITEMS = "item_id long, text string, doc_id string"


def distance_to_substring(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        how = rng.randrange(3)
        if how == 0:
            s[i] = rng.choice("abc ")
        elif how == 1:
            del s[i]
        else:
            s.insert(i, rng.choice("abc "))
    return "".join(s)


def test_matches_the_plain_distance():
    rng = random.Random(6)
    items = [(i, "".join(rng.choice("abcd ef\n") for _ in range(rng.randrange(15, 90)))) for i in range(12)]
    match = D.Matcher(items, 0.1)
    hits = 0
    for _ in range(150):
        i, s = rng.choice(items)
        t = "".join(rng.choice("abcdef ") for _ in range(rng.randrange(80))) + edited(rng, s, rng.randrange(len(s) // 6 + 2)).upper() + "xyz" * rng.randrange(4)
        got = {i: (d, t[a:b]) for i, d, a, b in match(t)}
        for j, p in items:
            p = D.plain(p)
            if len(p) < D.MIN_CHARS:
                whole = re.search(r"(?<![a-z])" + re.escape(p.strip()) + r"(?![a-z])", D.plain(t)) if p.strip() else None
                assert (j in got) == (whole is not None)
                continue
            d = distance_to_substring(p, D.plain(t))
            assert (j in got) == (d <= int(len(p) * 0.1))
            if j in got:
                hits += 1
                assert got[j][0] == d
                # The span has exactly that distance from the whole item.
                q = D.plain(got[j][1])
                m = list(range(len(p) + 1))
                for n, c in enumerate(q, 1):
                    new = [n]
                    for k, x in enumerate(p, 1):
                        new.append(min(m[k] + 1, new[-1] + 1, m[k - 1] + (x != c)))
                    m = new
                assert m[-1] == d
    assert hits > 40


def test_blocks_nulls_repeats_long_and_empty(spark):
    a, b = "the quick brown fox jumps over the lazy dog again", "İ pack my box with five dozen liquor jugs for now"
    items = spark.createDataFrame([(1, a, "x"), (2, b, "x"), (3, a, "x"), (4, None, "x"), (5, "", "x"), (6, "short", "x")], ITEMS)
    rows = [(10, None), (11, ""), (12, a.replace(" ", "\n")), (13, "z " * 60_000 + b.replace("box", "bix") + " é"), (12, a), (None, "… " + a), (14, "short and clean"), (15, "shorts and not clean"), (16, "tooshort")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    for chars in (4_000_000, 60):
        got = sorted(((r["doc_id"] or -1), r["item_id"], r["distance"], r["start"], r["end"]) for r in D.benchmark_hits(docs, items, block_chars=chars).collect())
        assert got == [(-1, 1, 0, 2, 2 + len(a)), (-1, 3, 0, 2, 2 + len(a))] + sorted([(12, i, 0, 0, len(a)) for i in (1, 3)] * 2) + [(13, 2, 1, 120_000, 120_000 + len(b)), (14, 6, 0, 0, 5)]
        flags = [(r["doc_id"], r["f"]) for r in docs.select("doc_id", D.has_benchmark_text(F.col("text"), items, block_chars=chars).alias("f")).collect()]
        assert sorted(flags, key=str) == sorted([(10, False), (11, False), (12, True), (12, True), (13, True), (None, True), (14, True), (15, False), (16, False)], key=str)
    assert D.benchmark_hits(docs, items.limit(0)).count() == 0 and D.benchmark_hits(docs.limit(0), items).count() == 0
    assert docs.filter(D.has_benchmark_text(F.col("text"), items.limit(0))).count() == 0
