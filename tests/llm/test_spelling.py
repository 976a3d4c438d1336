import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import queries
from larder.llm.common import saved
from larder.llm.spelling import letter_runs, near_in_list, near_words, spelling_groups, vocabulary

SCHEMA = "doc_id long, text string, word string, n string, root string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def groups(count):
    """word -> (n, n_near, form, form_n, root) from all pairs."""
    near = {w: [x for x in count if x != w and one_edit(w, x)] for w in count}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 2 * count[w] else None
    out = {}
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (count[w], len(near[w]), form[w], count[form[w]] if form[w] else None, root)
    return out


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), max_size=60))
def test_lists_give_all_pairs(words):
    words = sorted(words)
    assert list(near_in_list(words)) == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])]


def test_long_lists_are_split_without_loss(spark):
    words = sorted({a + b + c + d + e for a in "ab" for b in ("", "a", "é") for c in "abc" for d in ("", "bb", "c") for e in "aby"})
    table = saved(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), "t")
    want = sorted((a, b) for a in words for b in words if a != b and one_edit(a, b))
    for most in (4096, 3):
        assert sorted((r["word"], r["near"]) for r in near_words(table, most).collect()) == want


def test_query_against_brute_force(spark, tmp_path):
    base = ["straße", "strasse", "colour", "color", "Colour", "ÉTÉSX", "étésx", "hello", "helo", "hellos", "hallo", "abcde", "abcdf", "abcdg", "abxdg", "x" * 30]
    texts = [" ".join(base[(i * j + j // 3) % len(base)] for j in range(i % 60)) + "1" + ("Ωhello×wörld" * (i % 3)) for i in range(400)]
    rows = [(i % 300, t, "x", "y", "z") for i, t in enumerate(texts)] + [(None, "hello hello colour", "x", "y", "z")] * 4 + [(5, None, "x", "y", "z"), (6, "", "x", "y", "z")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    low = {c: c + 32 for c in range(65, 91)}
    count = Counter()
    for i, t, *_ in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 97 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            count[r] += 1
    want = groups({w: n for w, n in count.items() if len(w) >= 5 and n >= 3})
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in queries.QUERIES["op13_spelling"](spark, str(tmp_path)).collect()}
    assert got == want and any(v[2] for v in want.values())


def test_long_chains_and_ties(spark):
    n = {"aaaaa" + "b" * k: 2 ** k for k in range(12)} | {"ccccc": 1, "ccccd": 2, "cccce": 2}
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling_groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == groups(n) and got["aaaaa"][4] == "aaaaa" + "b" * 11 and got["ccccc"][2] == "ccccd"


def test_runs_and_the_empty_table(spark):
    assert letter_runs("AbÀÉ×x÷ÿ_ωĀb\x85c") == [x.encode("latin-1") for x in ("abÀÉ×x÷ÿ", "b", "c")]
    assert spelling_groups(vocabulary(spark.createDataFrame([], SCHEMA))).count() == 0
