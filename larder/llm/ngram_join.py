"""N-gram Jaccard join by T-occurrence search.

Two documents link when the sets of their distinct five-word shingles have a Jaccard
similarity of at least 0.8 (100 * common >= 80 * union). Every link counts: the result is
exact.

1. Documents with equal sets are one node, found by a 128-bit fingerprint.
2. A sketch of fixed size counts the shingles of all documents, so that every node can
   order its shingles from rare to frequent. Linked nodes share at least T of the first
   n - ceil(0.8 n) + 1 of them (the prefix), with T from the two sizes. Any order that all
   nodes share is right; rare first keeps the inverted lists short.
3. T-occurrence search over the inverted lists of the prefixes, as DivideSkip does it:
   a node heap-merges its short lists (up to ``LONG`` nodes) and keeps the nodes that occur
   T times, less the number of its long lists, which are not merged; candidates are then
   probed: the shingles of one are looked up in the sorted set of the other by binary search.
4. Nodes that may meet in long lists alone: each long list's node with the most shared
   prefix shingles is probed by the rest of the list, then eight more of them, which joins
   most copies of one text. What is left of the lists that still hold several components is
   searched by blocks: the lists' nodes are dealt to blocks of about ``BLOCK``, and each
   pair of blocks counts the shared prefix shingles of their nodes in one task, by
   DivideSkip again, and emits only nodes of different components that reach T.
   No list is cut.

Sets are never moved for documents that share no prefix shingle.

Defined results: null, empty and blank texts have empty sets and link with nothing, their
component is their own doc_id; rows that repeat a doc_id each give a row; a null doc_id
takes part like any other and counts as larger than any id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import free_name, hold_alone, saved, sided
from larder.llm.components import components

WORDS = 5
PERCENT = 80
BLOCK = 1024        # nodes of a block of the last search
BUCKET_KEYS = 1_000_000  # prefix shingles that are counted together in one task
MERGE_COST = 0.1    # weighs merging against probing when lists are set aside
LONG = 64           # nodes of an inverted list up to which it is merged
SKETCH_BITS = 22    # the sketch has 4 million counters, at most 16 MB
SLICES = 64

_K, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Hashes of the words that a Python worker has met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_WORDS = _Words()
_hash_of = _WORDS.__getitem__


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash_of, words), np.uint64, len(words))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    w = _word_hashes((text or "").encode().lower().split())
    n = len(w)
    if not n:
        return w
    k = min(n, words)
    s = w[:n - k + 1] + np.uint64(k)
    for i in range(1, k):
        s = (s ^ s >> np.uint64(32)) * _K + w[i:n - k + 1 + i]
    s = (s ^ s >> np.uint64(29)) * _M
    return np.unique(s ^ s >> np.uint64(32))


def fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def needed(n: np.ndarray | int, m: np.ndarray | int, percent: int = PERCENT):
    """Smallest overlap of two sets of these sizes that links them."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + percent * n // -100 + 1


def prefix_needed(n: int, m: int, percent: int = PERCENT) -> int:
    """T: how many prefix shingles linked sets of these sizes have in common, at least.
    Of the common shingles all lie in both prefixes, but for those behind the prefix of one."""
    return max(1, needed(n, m, percent) - max(n - prefix_length(n, percent), m - prefix_length(m, percent)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all texts of a task: how often each counter's shingles occur, up to 255."""
    hold_alone("shingles", _WORDS.clear)
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    for b in batches:
        for at in range(0, b.num_rows, 128):
            s = np.concatenate([np.zeros(0, np.uint64), *(shingle_set(t) for t in b.column("text").slice(at, 128).to_pylist())])
            np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
    for i, c in enumerate(np.array_split(np.minimum(counts, 255).astype(np.uint8), SLICES)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([c.tobytes()], pa.binary())], names=["slice", "counts"])


def _add(group: pa.Table) -> pa.Table:
    total = 0
    for x in group.column("counts"):
        total = total + np.frombuffer(x.as_py(), np.uint8).astype(np.int64)
    return pa.table({"slice": group.column("slice")[:1], "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})


def shingle_sketch(docs: DataFrame) -> np.ndarray:
    """Counts by the upper bits of a shingle's hash. Its size does not grow with the input."""
    rows = docs.select("text").mapInArrow(_count, "slice int, counts binary").groupBy("slice").applyInArrow(_add, "slice int, counts binary").collect()
    if not rows:
        return np.zeros(1 << SKETCH_BITS, np.uint32)
    return np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in sorted(rows, key=lambda r: r["slice"])])


def _describe(sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hold_alone("shingles", _WORDS.clear)
        counts, row = sketch.value, TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                size, prints, keys = [], [], []
                for t in part.column("text").to_pylist():
                    s = shingle_set(t)
                    size.append(len(s))
                    prints.append(fingerprint(s))
                    order = np.lexsort((s, counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                    keys.append(s[order[:prefix_length(len(s))]].view(np.int64) if len(s) else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + len(size))), part.column("doc_id"), pa.array(size, pa.int32()), pa.array(prints, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))], names=["row", "doc_id", "n", "print", "keys"])
                row += len(size)
    return run


def _packed(buckets: int):
    """The distinct keys of a task and their counts, packed by bucket: eight bytes a key move, and four a count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bucket = ((keys.view(np.uint64) >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, times, bucket = keys[order], times[order].astype("<i4"), bucket[order]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[at[1:], len(keys)]
            return pa.RecordBatch.from_arrays([
                pa.array(bucket[at]), pa.array([keys[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()),
                pa.array([times[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())], names=["bucket", "keys", "times"])

        for b in batches:
            held.append(b.column("keys").flatten().to_numpy())
            if sum(map(len, held)) > 2 * BUCKET_KEYS:
                yield out()
        if sum(map(len, held)):
            yield out()
    return run


def _recount(group: pa.Table) -> pa.Table:
    keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.int64)
    times = np.frombuffer(b"".join(group.column("times").to_pylist()), "<i4")
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    total = np.add.reduceat(times[order].astype(np.int64), at)
    return pa.table({"k": pa.array(keys[at][total > 1]), "m": pa.array(total[total > 1])})


def _repeated(rows: DataFrame) -> DataFrame:
    """k, m of the elements of ``keys`` that occur m > 1 times in all rows. A key that fills the
    table takes one entry a task."""
    n, sets = rows.agg(F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)), F.count("*")).first()
    buckets = 1 + (n * (100 - PERCENT) // 100 + sets) // BUCKET_KEYS  # a prefix is that share of a set, and one more
    return rows.select("keys").mapInArrow(_packed(buckets), "bucket long, keys binary, times binary").groupBy("bucket").applyInArrow(_recount, "k long, m long")


def divide_skip(lists: list[list[tuple[int, int]]], size: int, long_lists: int, below: int) -> list[int]:
    """Nodes under ``below`` that may share T prefix shingles with a node of ``size`` shingles.

    ``lists``: its short inverted lists, of (node, size), sorted. They are merged by a heap;
    a node must occur T times, less the number of long lists, which are not merged.
    """
    out, at, times, n = [], None, 0, 0

    def close() -> None:
        if at is not None and at < below and 100 * min(size, n) >= PERCENT * max(size, n) and times >= prefix_needed(size, n) - long_lists:
            out.append(at)

    for node, m in heapq.merge(*lists):
        if node != at:
            close()
            at, times, n = node, 0, m
        times += 1
    close()
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node: the node's size, number of long lists and one short list each."""
    node, lists, size, long_lists = None, [], 0, 0
    found: list[tuple[int, int]] = []

    def close() -> None:
        if node is not None:
            found.extend((node, x) for x in divide_skip(lists, size, long_lists, node))

    for b in batches:
        for q, n, longs, nodes, sizes in zip(*(b.column(k).to_pylist() for k in ("node", "n", "longs", "nodes", "sizes"))):
            if q != node:
                close()
                node, lists, size, long_lists = q, [], n, longs
            lists.append(sorted(zip(nodes, sizes)))
        if len(found) > 10_000:
            yield _pairs(found)
            found = []
    close()
    yield _pairs(found)


def t_occurrence(lists: list[np.ndarray], needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements of sorted lists that may occur ``needed`` times, and how often they do.

    DivideSkip: the longest lists are set aside, the others merged; an element that occurs
    ``needed`` times less their number is looked up in each long list by binary search.
    """
    if len(lists) < needed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = sorted(lists, key=len)
    aside = min(needed - 1, int(needed / (MERGE_COST * np.log2(max(len(lists[-1]), 2)) + 1)))
    short, long = lists[:len(lists) - aside], lists[len(lists) - aside:]
    found, times = np.unique(np.concatenate(short), return_counts=True)
    may = times >= needed - aside
    found, times = found[may], times[may]
    for x in long:
        at = np.minimum(np.searchsorted(x, found), len(x) - 1)
        times = times + (x[at] == found)
    return found[times >= needed], times[times >= needed]


def _block_pairs(group: pa.Table) -> pa.Table:
    """Nodes of two blocks (or of one): pairs of different components that share T prefix shingles."""
    node, n, label, block = (group.column(k).to_numpy() for k in ("node", "n", "label", "block"))
    keys = [np.asarray(x, np.int64) for x in group.column("keys").to_pylist()]
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    lists: dict[int, list[int]] = {}
    for x in np.flatnonzero(block == j).tolist():
        for k in keys[x].tolist():
            lists.setdefault(k, []).append(x)
    inverted = {k: np.array(v, np.int64) for k, v in lists.items()}
    a, b = [], []
    for q in np.flatnonzero(block == i).tolist():
        own = [inverted[k] for k in keys[q].tolist() if k in inverted]
        least = min((prefix_needed(int(n[q]), m) for m in range(-(-PERCENT * int(n[q]) // 100), int(n[q]) * 100 // PERCENT + 1)), default=1)
        found, times = t_occurrence(own, least) if own else (np.zeros(0, np.int64), [])
        for x, s in zip(found.tolist(), times):
            lo, hi = sorted((int(n[q]), int(n[x])))
            if label[q] != label[x] and node[q] != node[x] and 100 * lo >= PERCENT * hi and s >= prefix_needed(lo, hi):
                a.append(max(node[q], node[x]))
                b.append(min(node[q], node[x]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose sets overlap enough: the smaller set is looked up in the larger, sorted one."""
    for b in batches:
        keep = []
        for x, y in zip(b.column("sx").to_pylist(), b.column("sy").to_pylist()):
            s, t = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            keep.append(int((t[at] == s).sum()) >= needed(len(s), len(t)))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            p = b.slice(at, 256)
            sets = [shingle_set(t) for t in p.column("text").to_pylist()]
            same = pa.array([fingerprint(s) == f for s, f in zip(sets, p.column("print").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([p.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"]).filter(same)


class _Prober:
    """Links among pairs of nodes; reads again the texts of the nodes concerned only."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), nodes

    def links(self, pairs: DataFrame) -> DataFrame:
        c = F.col
        pairs = saved(pairs, "pairs")
        ids = pairs.select(c("a").alias("node")).union(pairs.select(c("b").alias("node"))).distinct()
        need = saved(self.nodes.join(ids, "node", "left_semi").select("node", c("first_id").alias("id"), "print"), "to-probe")
        sets = self.docs.join(sided(need), c("doc_id").eqNullSafe(c("id"))).select("node", "print", "text").mapInArrow(_sets, "node long, set binary")
        sets = saved(sets.dropDuplicates(["node"]), "sets")
        x = pairs.join(sets.select(c("node").alias("x"), c("set").alias("sx")), c("a") == c("x"))
        x = x.join(sets.select(c("node").alias("y"), c("set").alias("sy")), c("b") == c("y"))
        return saved(x.select("a", "b", "sx", "sy").mapInArrow(_probe, "a long, b long"), "linked")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """row, doc_id, n (set size), print (of the set), component_id of every row."""
    c = F.col
    sc = docs.sparkSession.sparkContext
    sketch = sc.broadcast(shingle_sketch(docs))
    rows = saved(docs.select(c("doc_id").cast("long").alias("doc_id"), "text")
                 .mapInArrow(_describe(sketch), "row long, doc_id long, n int, print binary, keys array<long>"), "described")
    sketch.destroy()
    full = rows.filter("n > 0")
    nodes = saved(full.groupBy("print").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.first("n").alias("n")), "nodes")
    copies = saved(full.select("row").join(nodes.select("node"), c("row") == c("node"), "left_anti").select(c("row").alias("copy")), "copies")
    own = full.select("row", "n", "keys").join(sided(copies), c("row") == c("copy"), "left_anti")
    many = saved(_repeated(own), "many")  # only shingles in two prefixes or more matter, a small part of all
    keys = own.select(c("row").alias("node"), "n", F.explode("keys").alias("key"))
    shared = saved(keys.join(many, c("key") == c("k")).select("key", "node", "n", "m"), "shared")
    short, longs = shared.filter(c("m") <= LONG), shared.filter(c("m") > LONG)
    lists = short.groupBy(c("key").alias("k")).agg(F.collect_list("node").alias("nodes"), F.collect_list("n").alias("sizes"))  # at most LONG each
    own_long = longs.groupBy(c("node").alias("q")).agg(F.count(F.lit(1)).alias("longs"))
    queries = short.join(own_long, c("node") == c("q"), "left").select("key", "node", "n", F.coalesce("longs", F.lit(0)).alias("longs"))
    pairs = (queries.join(lists, c("key") == c("k")).select("node", "n", "longs", "nodes", "sizes")
             .repartition("node").sortWithinPartitions("node").mapInArrow(_search, "a long, b long"))
    prober = _Prober(docs, nodes)
    links = prober.links(pairs)
    links = _long_links(prober, shared, links)
    labels = sided(components(links))
    # A component's id is the smallest doc_id of all its rows.
    named = nodes.join(labels.withColumnRenamed("node", "u"), c("node") == c("u"), "left").select("print", "first_id", F.coalesce("label", "node").alias("label"))
    first = named.groupBy(c("label").alias("l")).agg(F.min("first_id").alias("component_id"))
    named = named.join(first, c("label") == c("l")).select(c("print").alias("p"), "component_id")
    return (rows.drop("keys").join(named, (c("print") == c("p")) & (c("n") > 0), "left")
            .select("row", "doc_id", "n", "print", F.when(c("n") > 0, c("component_id")).otherwise(c("doc_id")).alias("component_id")))


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that link, over any number of links, to one with a
    smaller doc_id. One row of each component stays, and every row without shingles.

    Of rows that share a doc_id and its component, the first found stays.
    """
    c = F.col
    rows = saved(jaccard_components(docs).select("row", c("doc_id").alias("id"), "n", "print", "component_id"), "components")
    first = (c("n") == 0) | c("id").eqNullSafe(c("component_id"))
    again = rows.groupBy(c("id").alias("i2")).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("i2")
    gone = saved(rows.filter(~first).select("id").union(again).distinct(), "gone")
    key = c("doc_id").cast("long")
    out = docs.join(sided(gone), key.eqNullSafe(c("id")), "left_anti")
    again = saved(again, "again")
    if again.isEmpty():
        return out
    # Rows whose doc_id occurs more than once: told apart by the fingerprint of their set.
    rows = rows.join(again, c("id").eqNullSafe(c("i2")), "left_semi").filter(first)
    keep = (rows.filter("n > 0").groupBy("id").agg(F.min(F.struct("row", "print")).alias("r")).select("id", c("r.print").alias("print"))
            .unionByName(rows.filter("n = 0").select("id", "print").distinct()))
    mark, once = free_name(docs, "print_of_set"), free_name(docs, "row_of_set")

    @F.pandas_udf("binary")
    def prints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([fingerprint(shingle_set(t if isinstance(t, str) else None)) for t in s], dtype=object)

    few = docs.join(again, key.eqNullSafe(c("i2")), "left_semi").withColumn(mark, prints.asNondeterministic()(c("text")))
    few = few.join(keep.select(c("id").alias("k_id"), c("print").alias("k_print")), key.eqNullSafe(c("k_id")) & (c(mark) == c("k_print")), "left_semi")
    empty = fingerprint(shingle_set(None))
    few = few.withColumn(once, F.when(c(mark) == F.lit(empty), F.monotonically_increasing_id()))
    few = few.dropDuplicates([once, mark, "doc_id"])
    return out.unionByName(few.drop(mark, once))


def _sql_prefix_needed(n: str, m: str):
    """``prefix_needed`` of two columns."""
    behind = lambda x: f"((({PERCENT} * {x} + 99) div 100) - 1)"
    return F.expr(f"greatest(1, (({PERCENT} * ({n} + {m}) + {99 + PERCENT}) div {100 + PERCENT}) - greatest({behind(n)}, {behind(m)}))")


def _open(lists: DataFrame) -> DataFrame:
    """The lists that hold more than one component."""
    c = F.col
    keys = lists.groupBy(c("key").alias("k")).agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("k")
    return saved(lists.join(sided(saved(keys, "open")), c("key") == c("k"), "left_semi"), "long-lists")


def _joined(lists: DataFrame, found: DataFrame) -> DataFrame:
    """``lists`` with the components joined by the links ``found``."""
    c = F.col
    names = lists.select(c("node").alias("x"), c("label").alias("lx")).distinct()
    ends = found.join(names, c("a") == c("x")).join(names.select(c("x").alias("y"), c("lx").alias("ly")), c("b") == c("y"))
    labels = sided(components(ends.select(c("lx").alias("a"), c("ly").alias("b")))).select(c("node").alias("u"), c("label").alias("v"))
    return lists.join(labels, c("label") == c("u"), "left").select("key", "node", "n", "t", F.coalesce("v", "label").alias("label"))


def _long_links(prober: _Prober, shared: DataFrame, links: DataFrame) -> DataFrame:
    """Links of nodes that meet in long lists, added to ``links``. ``shared``: all shared prefix shingles."""
    c = F.col
    lists = shared.filter(c("m") > LONG)
    if lists.isEmpty():
        return links
    own = shared.groupBy(c("node").alias("q")).agg(F.count(F.lit(1)).alias("t"))
    labels = sided(components(links)).withColumnRenamed("node", "u")
    lists = (lists.select("key", "node", "n").join(own, c("node") == c("q")).join(labels, c("node") == c("u"), "left")
             .select("key", "node", "n", "t", F.coalesce("label", "node").alias("label")))
    lists = _open(saved(lists, "long-lists"))
    for slots in (1, 8):
        if lists.isEmpty():
            return links
        heads = (lists.groupBy(c("key").alias("k"), F.pmod(F.xxhash64("node"), F.lit(slots)).alias("slot"))
                 .agg(F.min(F.struct((-c("t")).alias("t"), "node", "n", "label")).alias("h")))
        heads = sided(saved(heads.select("k", c("h.node").alias("centre"), c("h.n").alias("cn"), (-c("h.t")).alias("ct"), c("h.label").alias("cl")), "centres"))
        at = lists.join(heads, (c("key") == c("k")) & (c("node") != c("centre")) & (c("label") != c("cl"))
                        & (100 * F.least("n", "cn") >= PERCENT * F.greatest("n", "cn")) & (F.least("t", "ct") >= _sql_prefix_needed("n", "cn")))
        found = prober.links(at.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct())
        links = saved(links.union(found), "linked")
        lists = _open(_joined(lists, found))
    if lists.isEmpty():
        return links
    # What is left, by blocks of the nodes that hang together by lists.
    first = lists.groupBy(c("key").alias("k")).agg(F.min("node").alias("first"))
    ties = lists.join(first, c("key") == c("k")).select(c("node").alias("a"), c("first").alias("b"))
    family = components(ties).select(c("node").alias("x"), c("label").alias("family"))
    nodes = lists.select("node", "n", "label").distinct().join(family, c("node") == c("x")).drop("x")
    size = nodes.groupBy(c("family").alias("f")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    nodes = nodes.join(size, c("family") == c("f")).drop("f").withColumn("block", F.pmod(F.xxhash64("node"), c("blocks")).cast("int"))
    keys = shared.join(nodes.select(c("node").alias("y")), c("node") == c("y"), "left_semi").groupBy(c("node").alias("y")).agg(F.collect_list("key").alias("keys"))  # a prefix at most
    nodes = nodes.join(keys, c("node") == c("y")).withColumn("other", F.explode(F.sequence(F.lit(0), c("blocks") - 1)))
    nodes = nodes.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "label", "keys")
    found = nodes.groupBy("family", "i", "j").applyInArrow(_block_pairs, "a long, b long").distinct()
    return saved(links.union(prober.links(found)), "linked")
