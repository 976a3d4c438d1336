import hashlib
import math
import random
import re
import time

import public_tokenizers
from pyspark.sql import functions as F

from larder.llm import secret_scan as S

WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_base(text):
    out = []
    for k, p, ok in (("assign", S.ASSIGN, lambda m: len(m[2]) >= 6), ("access", S.ACCESS, lambda m: len(m[0]) >= 20), ("hex", S.HEX, lambda m: len(m[0]) >= 24)):
        flags = re.I | re.A if k == "assign" else 0
        out += [(m.start(), S.KINDS.index(k), k, m.end()) for m in re.finditer(p, text, flags) if ok(m)]
    return [(k, i, j) for i, _, k, j in sorted(out)]


def test_base_spans():
    rng = random.Random(1)
    bits = ["password", "Token", "API_KEY", "apikey", "ſecret", "secret", "=", ": ", " = ", '"', "'", "abc", "abcdef", "tok", "AKIA", "AKIA" + "Z9" * 8, "AKIAX", "0a" * 12, "0a" * 11 + "f", "Az/+=.-_", " ", "\n", "é"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert S.base_spans(t) == plain_base(t)


def part_cost(s, ranks, blocks=True):
    """One segment, by the cheapest of its kinds."""
    low, out = s.lower(), [float(len(s))]
    if low in ranks:
        out.append(math.log10(ranks[low]) + (math.log10(2) if low != s else 0))
    if any(re.fullmatch(d.pattern[4:-2], low) for d in S._dates):
        out.append(math.log10(365 * 120))
    if len(s) >= 3 and len(set(low)) == 1:
        out.append(math.log10(10 * len(s)))
    if len(s) >= 3 and all(x in S.STEPS for x in zip(low, low[1:])):
        out.append(math.log10(160 * len(s)))
    for p in range(2, min(24, len(s) // 2) + 1) if blocks else ():
        unit = low[:p]
        if len(s) % p == 0 and low == unit * (len(s) // p) and not any(p % q == 0 and unit == unit[:q] * (p // q) for q in range(1, p)):
            out.append(slow_cost(unit, ranks, False) + math.log10(len(s) // p))
    return min(out)


def slow_cost(v, ranks, blocks=True):
    """Cheapest over all segmentations: for each end, over all starts of the last segment."""
    best = [0.0]
    for j in range(1, len(v) + 1):
        best.append(min(best[i] + (math.log10(2) if i else 0) + part_cost(v[i:j], ranks, blocks) for i in range(j)))
    return best[-1]


RANKS = {"the": 3, "pass": 40, "word": 50, "password": 20, "dragon": 900, "hello": 300, "were": 5, "ooo": 7, "haha": 60, "sas": 4}


def test_guess_cost_is_the_cheapest_segmentation():
    rng = random.Random(2)
    for v in ["password", "Dragon", "aaaaaaa", "qwerty1", "19991231x", "2020zzz", "x7", "abcabcabcabc", "hahahahaha", "20201231", "AbaBabab9",
              *("".join(rng.choice(["the", "a", "9", "qwe", "zz", "1984", "Word", "#"]) for _ in range(4)) for _ in range(60))]:
        assert abs(S.guess_cost(v, RANKS) - slow_cost(v, RANKS)) < 1e-9, v
    assert S.guess_cost("", RANKS) == 0


def test_runs_of_any_length_are_the_cheapest():
    rng = random.Random(3)
    bits = ["hello", "ooo", "o" * 30, "xyz" * 12, "ab" * 15, "qwertyu" * 4, "asdf", "were" * 7, "sas" * 9, "were", "1999", "Q", "kj#", "abcdefghijklmnopqrstuvwxy" * 2]
    for v in ["hello" + "o" * 30, "were" + "re" * 20, *("".join(rng.choice(bits) for _ in range(rng.randint(1, 4)))[:90] for _ in range(40))]:
        assert abs(S.guess_cost(v, RANKS) - slow_cost(v, RANKS)) < 1e-9, v


def test_very_long_values_take_linear_time():
    ranks = S.Ranks(RANKS)
    for unit in ("o", "ab", "qwertyuiop", "were", "kX9#mQ2$vL7!", "hello19991231"):
        seconds = {}
        for n in (50_000, 400_000):
            v = unit * (n // len(unit))
            t = time.process_time()
            cost = S.guess_cost(v, ranks)
            seconds[n] = time.process_time() - t
            assert cost < 30
        assert seconds[400_000] < 24 * seconds[50_000] + 1 and seconds[400_000] < 8, (unit, seconds)


def test_context_values_and_redaction(spark):
    texts = ["login: kX9#mQ2$vL7!", "passphrase: the thing", "pwd = aaaaaaaaaa", "token = 40ba077d62935af6fd437e967f92c02cca956b74", None, "", "é AKIA" + "Q7" * 9 + " é",
             "x " * 50_000 + "password=hunter22hunter"]
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)] * 2, "doc_id long, text string, found string, kind string")
    got = df.select("doc_id", S.find_secrets(F.col("text"), WORDS).alias("s"), S.redacted(F.col("text"), WORDS).alias("r")).collect()
    assert len(got) == 16
    by = {r["doc_id"]: r for r in got}
    kinds = {i: [s["kind"] for s in r["s"]] for i, r in by.items()}
    assert kinds == {0: ["guess"], 1: [], 2: [], 3: ["assign", "hex"], 4: [], 5: [], 6: ["access"], 7: ["assign"]}
    assert by[0]["r"] == "login: [SECRET]" and by[3]["r"] == "[SECRET]" and by[4]["r"] is None and by[6]["r"] == "é [SECRET] é"
    assert df.limit(0).select(S.find_secrets(F.col("text"), WORDS)).count() == 0


def test_query_digest(spark):
    from larder.llm.queries import QUERIES
    got = QUERIES["op4_secret_scan"](spark, "/root/testdata/sf0.001").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in got:
        base = plain_base(text[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{i}:{j}" for k, i, j in base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in base) for x in S.KINDS[:3]]
