"""Spelling variant grouping: near words by dynamic programming over sorted word lists.

Words that differ by one inserted, deleted or replaced code point agree in the first or in
the second half of the shorter one. So each word joins a few lists of words with a shared
half: lists of words with a shared first half sorted as they are, lists with a shared second half
sorted by the reversed words. A list holds words of two neighbouring lengths and finds the
pairs whose shorter word has the one length; the second half's list leaves out pairs that
share the first. So each pair is found once.

A list is scanned in order, once for each of its words, over the words behind it. The rows
of the edit matrix (a band of three cells, as one edit allows no more) are kept by depth, and
the next word begins at the row of its common prefix with the one before. Where all cells of
a row exceed one edit, the scan goes on behind all words that share this prefix.

Lists of more than ``LIST_WORDS`` words are not scanned whole: their words join lists
without one letter, once for each place of the other half. Such a list holds at most as many words
as the alphabet has letters, for each place; it is scanned in the same way. Nothing is left out.

Lists go to tasks by the hash of their key and are read as a sorted stream, one list in memory
at a time. Words are counted before they move, and only words move.

Defined results: null and empty texts hold no words; rows that repeat a doc_id count each; a
null doc_id counts as the text ''; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import saved, sided

LIST_WORDS = 4096
COUNTS_KEPT = 200_000  # words that a task counts before it hands them on
PAIRS = "word string, n long, near string, near_n long"

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def letter_runs(text: str) -> list[bytes]:
    """The maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, as Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def _count(spell: Callable[[int | None], Callable[[bytes], bytes]] | None, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(list(total.values()), pa.int64())})

        for b in batches:
            for at in range(0, b.num_rows, 64):
                s = b.slice(at, 64)
                for i, t in zip(s.column("doc_id").to_pylist(), s.column("text").to_pylist()):
                    runs = Counter(letter_runs(t or ""))
                    word_of = spell(i) if spell else None
                    for r, n in runs.items():
                        w = word_of(r) if word_of else r
                        if len(w) >= shortest:
                            total[w] = total.get(w, 0) + n
                if len(total) >= COUNTS_KEPT:
                    yield out()
                    total.clear()
        if total:
            yield out()
    return run


def vocabulary(docs: DataFrame, spell: Callable[[int | None], Callable[[bytes], bytes]] | None = None, shortest: int = 5, fewest: int = 3) -> DataFrame:
    """word, n of the words of ``shortest`` code points and ``fewest`` occurrences at least.

    ``spell``, if given, makes from a doc_id the function that gives the word of a run (both
    Latin-1) in that document.
    """
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
            .mapInArrow(_count(spell, shortest), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest))


def common(a: str, b: str) -> int:
    """Length of the prefix that two words share."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def near_in_list(words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs i < j of places in a sorted list of distinct words whose words are one edit apart."""
    count = len(words)
    lcp = [0, *map(common, words, words[1:])]
    for i, word in enumerate(words):
        m = len(word)
        query = word + "\0\0"  # columns behind the last compare with letters that no word has
        rows = [(2, 0, 1)]  # row d: columns d - 1, d, d + 1 for the first d letters of the word scanned
        known, j = 0, i + 1
        while j < count:
            scanned = words[j]
            far = False
            a, b, c = rows[known]
            for d in range(known + 1, min(len(scanned), m + 1) + 1):
                letter = scanned[d - 1]
                x = a if letter == query[d - 2] else a + 1
                if b < x:
                    x = b + 1
                y = b if letter == query[d - 1] else b + 1
                if c < y:
                    y = c + 1
                if x < y:
                    y = x + 1
                z = c if letter == query[d] else c + 1
                if y < z:
                    z = y + 1
                if x > 1 and y > 1 and z > 1:
                    far = True
                    break
                rows.append((x, y, z))
                a, b, c = x, y, z
            if far:
                k = bisect_left(words, scanned[:d] + "\U0010ffff", j + 1)
            else:
                k = j + 1
                gap = m - len(scanned)
                if -1 <= gap <= 1 and (a, b, c)[gap + 1] == 1:
                    yield i, j
            if k < count:  # the next one shares as much with this word as with the one before it
                known = min(len(rows) - 1, lcp[k])
                del rows[known + 1:]
            j = k


def half_lists(words: DataFrame) -> DataFrame:
    """The lists that each word joins: key, side (first or second half shared), m (length of the
    shorter word of a pair), text (the word, reversed where the second half is shared), n."""
    size, word = F.length("word"), F.col("word")

    def entry(side: str, m):
        half = F.floor(m / 2).cast("int")
        text = word if side == "first" else F.reverse(word)
        shared = F.substring(text, F.lit(1), half if side == "first" else m - half)
        return F.struct(F.concat_ws(":", F.lit(side), m.cast("string"), shared).alias("key"), F.lit(side).alias("side"), m.alias("m"), text.alias("text"))

    lists = F.array(*(entry(side, m) for m in (size, size - 1) for side in ("first", "second")))
    return words.select(F.explode(lists).alias("e"), "n").select("e.*", "n")


def _without_a_letter(lists: DataFrame) -> DataFrame:
    """The entries of long lists, in lists whose words also agree but for one letter of the other half."""
    half = F.floor(F.col("m") / 2).cast("int")
    shared = F.when(F.col("side") == "first", half).otherwise(F.col("m") - half)
    text, size = F.col("text"), F.length("text")
    places = F.when(shared < size, F.sequence(shared + 1, size)).otherwise(F.array().cast("array<int>"))

    def left(i):
        return F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, size))

    # Words of m letters: one list for each place of a replaced letter, and the one of what they are
    # without an inserted letter. Words of m + 1: of equal neighbours, the first one goes.
    same = F.concat(F.transform(places, lambda i: F.concat(F.lit("/"), i.cast("string"), F.lit(":"), left(i))), F.array(F.concat(F.lit("/:"), text)))
    longer = F.transform(F.filter(places, lambda i: (i == shared + 1) | (F.substring(text, i, F.lit(1)) != F.substring(text, i - 1, F.lit(1)))),
                         lambda i: F.concat(F.lit("/:"), left(i)))
    return (lists.withColumn("more", F.explode(F.when(size == F.col("m"), same).otherwise(longer)))
            .select(F.concat("key", "more").alias("key"), "side", "m", "text", "n"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def search(side: str, m: int, entries: list[tuple[str, int]]) -> None:
        texts = [t for t, _ in entries]
        for i, j in near_in_list(texts):
            (a, n), (b, k) = entries[i], entries[j]
            if min(len(a), len(b)) != m:
                continue
            if side == "second":
                half = m // 2
                if a[len(a) - half:] == b[len(b) - half:]:
                    continue
                a, b = a[::-1], b[::-1]
            out.append((a, n, b, k))
            out.append((b, k, a, n))

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())],
                                          names=["word", "n", "near", "near_n"])

    at, entries = None, []
    for b in batches:
        for key, side, m, text, n in zip(*(b.column(c).to_pylist() for c in ("key", "side", "m", "text", "n"))):
            if at is None or key != at[0]:
                if len(entries) > 1:
                    search(at[1], at[2], entries)
                    if len(out) > 10_000:
                        yield batch()
                at, entries = (key, side, m), []
            entries.append((text, n))
    if len(entries) > 1:
        search(at[1], at[2], entries)
    if out:
        yield batch()


def near_words(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """Each pair of near words of a written table (word, n), both ways round: word, n, near, near_n."""
    lists = half_lists(words)
    long = saved(lists.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > list_words).select("key"), "long-lists")
    if not long.isEmpty():
        long = sided(long)
        lists = lists.join(long, "key", "left_anti").unionByName(_without_a_letter(lists.join(long, "key", "left_semi")))
    return lists.repartition("key").sortWithinPartitions("key", "text").mapInArrow(_scan, PAIRS)


def spelling_groups(words: DataFrame, times: int = 2, list_words: int = LIST_WORDS) -> DataFrame:
    """Per word of (word, n): n, n_near, its form (the near word of largest n, the smallest of equals,
    where that is ``times`` its own n at least), form_n, and root, the last of its chain of forms.

    A chain at least multiplies n at each step, so the rounds that follow it, each twice as far
    as the one before, grow as the logarithm of the logarithm of the counts.
    """
    words = saved(words.select("word", "n"), "words")
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    rank = F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    best = (alone.unionByName(near_words(words, list_words)).groupBy("word")
            .agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min(rank).alias("best")))
    good = -F.col("best.less") >= times * F.col("n")
    forms = saved(best.select("word", "n", "n_near", F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")), "forms")
    hops = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = hops.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = saved(hops.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("at").isNotNull().alias("moved")), "hops")
        moved = not step.filter("moved").isEmpty()
        hops = step.select("word", "root")
        if not moved:
            return forms.join(hops, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
