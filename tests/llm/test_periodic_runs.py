import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import queries
from larder.llm.periodic_runs import ascii_words, find_runs, periodic_runs

SCHEMA = "doc_id long, text string, runs string, collapsed string, n_words string"


def brute(w):
    """All runs as (start, end, period), by comparing every word with the one q places on for every q."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(all(w[t] == w[t + p] for t in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, i + size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def texts(draw):
    """Words over small and large alphabets with stretches that go round, within each other."""
    w = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 2, 40]))), max_size=120))
    for _ in range(draw(st.integers(0, 3))):
        unit = draw(st.lists(st.integers(0, draw(st.sampled_from([1, 60]))), min_size=1, max_size=40))
        tail = draw(st.integers(0, len(unit)))
        at = draw(st.integers(0, len(w)))
        w = w[:at] + unit * draw(st.integers(3, 7)) + unit[:tail] + w[at:]
    return w


@settings(max_examples=150, deadline=None)
@given(st.lists(texts(), min_size=1, max_size=4))
def test_runs_of_documents_laid_end_to_end(docs):
    flat, want = [], []
    for k, d in enumerate(docs):
        want += [(a + len(flat), b + len(flat), q) for a, b, q in brute(d)]
        flat += [*d, -1 - k]
    assert find_runs(np.array(flat, np.int64), np.array([len(d) for d in docs])) == want


@pytest.mark.parametrize("period", [1, 15, 16, 17, 31, 32, 63, 64, 65, 1000, 24_999])
def test_long_periods(period):
    rng = np.random.default_rng(period)
    w = rng.integers(0, 50, 100_000)
    w[3:] = w[3 + np.arange(len(w) - 3) % period]
    w[2] = -7
    found = find_runs(np.r_[w, -1].astype(np.int64), np.array([len(w)]))
    assert (3, len(w), period) in found or (period == 24_999 and (3, 3 + len(w) - 3, period) in found)


def test_runs_of_three_periods_are_not_asked_for():
    with pytest.raises(ValueError):
        find_runs(np.array([-1]), np.array([0]), repeats=3)


def digest(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = [(a, b - a, q) for a, b, q in brute(w)]
    gone = {i for a, k, q in runs for i in range(a + q, a + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{k},{q}\n" for a, k, q in runs).encode()),
            sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_brute_force(spark, tmp_path):
    odd = ["", " \t\n ", None, "one", "a a a a a", "a a a a a a", "É x É x É x É x " * 3, "x y\x0bz x y\x0cz " * 5, "la " * 3000, "p q r p q r s " * 60]
    rows = [(i, (odd[i % 10] if i % 3 else " ".join(str(j * j % (2 + i % 7)) for j in range(i * 3))), "x", "y", "z") for i in range(240)]
    rows += [(None, "b b b b b b b", "x", "y", "z")] * 3 + rows[:4]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).drop("n_words").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(digest(r[0], r[1])) for r in rows)


def test_empty_table_and_collapsed_text(spark):
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    r = periodic_runs(spark.createDataFrame([(1, "so  very very very very very very nice", "x", "y", "z")], SCHEMA)).first()
    assert r["collapsed"] == "so very nice" and [tuple(x) for x in r["runs"]] == [(1, 6, 1)] and r["n_words"] == 8
    assert ascii_words(None, b"\xc2\xa0a\x0bb") == [b"\xc2\xa0a", b"b"]
