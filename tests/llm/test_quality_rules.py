import collections
import random

from larder.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, source string, host string, n_words string, h string"


def brute(text):
    x = text or ""
    w = x.encode().split()
    lines = [q for q in x.split("\n") if q.encode().split()]
    g = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    n = collections.Counter(g)
    cov = {k + i for k, v in enumerate(g) if n[v] > 1 for i in range(5)}
    return (len(w), sum(len(v.decode()) for v in w), sum(x.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cov), len(w) < 10 or 100 * len(cov) > 20 * len(w))


def rows():
    rng = random.Random(4)
    out = [(None, None, None), (1, "", "a"), (2, " \n\t\x0b", "a"), (3, "a b c d", "a"), (4, "x " * 30_000, "b"), (5, "same\nsame \nsame\n\n", "b"), (5, "same\nsame \nsame\n\n", "b"), (6, "é ü # * <b>", None)]
    for i in range(200):
        out.append((10 + i, "".join(rng.choice(["a", "b", "c", "dd", "é"]) + rng.choice([" ", " ", "\n", "\t", "\x1c"]) for _ in range(rng.randrange(60))), rng.choice(["s1", "s2", "s3"])))
    return [(i, t, s, "x", "y", "z") for i, t, s in out]


def test_rules_match_brute_force(spark):
    r = rows()
    got = Q.quality_verdicts(spark.createDataFrame(r, SCHEMA).repartition(3)).collect()
    assert len(got) == len(r)
    want = collections.Counter((i, s, *brute(t)) for i, t, s, *_ in r)
    assert collections.Counter((g["doc_id"], g["host"], g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) for g in got) == want
    assert not any(g["kept"] and g["base_failed"] for g in got)


def test_host_rates_shrink_and_reject(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    odd = " ".join(f"w{i}#*$" for i in range(40))
    data = [(i, "few words", "bad") for i in range(90)] + [(100, clean, "bad"), (101, odd, "bad"), (102, odd, "good")] + [(200 + i, clean + f" {i}", "good") for i in range(90)] + [(400, "few", "small")]
    got = Q.quality_verdicts(spark.createDataFrame([(i, t, s, "", "", "") for i, t, s in data], SCHEMA)).collect()
    by = {g["doc_id"]: g for g in got}
    # Moments by hand.
    hosts = {"bad": (92, 90), "good": (91, 0), "small": (1, 1)}
    n, f = sum(a for a, _ in hosts.values()), sum(b for _, b in hosts.values())
    m = f / n
    var = sum(a * (b / a) ** 2 for a, b in hosts.values()) / n - m * m
    w = min(max(m * (1 - m) / var - 1, 1), 1e6)
    for h, (a, b) in hosts.items():
        rate = next(g["host_rate"] for g in got if g["host"] == h)
        assert abs(rate - (b + m * w) / (a + w)) < 1e-9
    assert by[100]["kept"] and not by[101]["kept"] and by[102]["kept"] and by[200]["kept"] and not by[400]["kept"]


def test_the_prior_decides(spark, tmp_path):
    """Hosts of the query that fail at 0.2, 0.6 and 0.9: the sure ones are rejected, the small one of the same rate is not."""
    from larder.llm.queries import QUERIES

    clean, odd = (lambda i: " ".join(f"word{i}_{j}" for j in range(30))), " ".join(f"w{i}#*$" for i in range(40))
    rows = []
    for h, n, bad in (("usual", 3000, 300), ("a", 500, 100), ("b", 300, 180), ("c", 5, 3)):
        rows += [(h, "few words") if i < bad else (h, clean(i)) for i in range(n)] + [(h, odd)]
    spark.createDataFrame([(i, t, "en", h, len(t)) for i, (h, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op7_host_quality"](spark, str(tmp_path)).collect()
    rejected = {g["host"]: g["host_rejected"] for g in got}
    assert rejected == {"usual": False, "a": False, "b": True, "c": False}
    assert {g["host"]: g["kept"] for g in got if g["n_symbols"] > 50} == {"usual": True, "a": True, "b": False, "c": True}
    assert all(g["kept"] for g in got if not g["base_failed"] and g["n_symbols"] == 0)


def test_empty_table(spark):
    assert Q.quality_verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = Q.document_rules(spark.createDataFrame(rows()[:3], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
