import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larder.llm import queries
from larder.llm.vector_packing import best_fit, pack, pack_documents, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, piece string, row string, block string"


def plain_best_fit(lengths, full, weights):
    """One piece at a time, from long to short: the room left in each sequence."""
    bins = []
    for n in sorted(lengths, reverse=True):
        take = (n, 1, n * n)
        fits = [(sum(w * ((r - t) / f) ** 2 for w, r, t, f in zip(weights, b, take, full)), i) for i, b in enumerate(bins) if all(r >= t for r, t in zip(b, take))]
        if fits:
            i = min(fits)[1]
        else:
            bins.append(list(full))
            i = len(bins) - 1
        bins[i] = [r - t for r, t in zip(bins[i], take)]
    return bins


def check(lengths, into, offset, full):
    by = defaultdict(list)
    for n, b, o in zip(lengths, into, offset):
        by[b].append((o, n))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= full[0] and len(pieces) <= full[1] and sum(n * n for _, n in pieces) <= full[2]
    return len(by)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.integers(1, 12), st.sampled_from([64 * 64, 5000, 9000]))
def test_every_constraint_and_as_few_as_one_by_one(lengths, documents, cost):
    full = (64, documents, cost)
    n = np.array(lengths, np.int64)
    used = check(lengths, *(x.tolist() for x in best_fit(n, *full)), full) if lengths else 0
    plain = len(plain_best_fit(lengths, full, (1.0, 0.05, 0.05)))
    bound = max(-(-sum(lengths) // 64), -(-len(lengths) // documents), -(-sum(x * x for x in lengths) // cost), sum(x > 32 for x in lengths))
    assert bound <= used <= plain + 1 + plain // 10


def test_near_the_least_possible():
    rng = np.random.default_rng(5)
    n = np.minimum(2048, rng.lognormal(5.5, 1, 20_000).astype(int) + 1)
    into, offset = best_fit(n, 2048, 2048, 2048 ** 2)
    assert check(n.tolist(), into.tolist(), offset.tolist(), (2048, 2048, 2048 ** 2)) <= -(-n.sum() // 2048) + 2


def test_the_residual_decides():
    # Room for a piece of 10 in two sequences: the token residual prefers the fuller one.
    into, _ = best_fit(np.array([50, 40, 10]), 64, 9, 4096)
    assert into.tolist() == [0, 1, 0]
    # With tokens out of the weights, the attention cost that is left decides: 40 leaves more than 50.
    assert best_fit(np.array([50, 40, 10]), 64, 9, 4096, (0.0, 0.0, 1.0))[0].tolist() == [0, 1, 0]
    # The document capacity closes a sequence that has room for tokens.
    assert best_fit(np.array([30, 20, 10]), 64, 2, 4096)[0].tolist() == [0, 0, 1]
    with pytest.raises(ValueError):
        best_fit(np.array([65]), 64, 9, 9999)
    with pytest.raises(ValueError):
        best_fit(np.array([60]), 64, 9, 3599)


def docs(spark):
    words = "alpha beta, gamma. Größe 数量 can't\n".split(" ")
    rows = [(i % 50, " ".join(words[(i * j) % len(words)] for j in range(i * i % 900)), "x", "y", "z") for i in range(120)]
    rows += [(7, None, "x", "y", "z"), (8, "", "x", "y", "z"), (None, "no id", "x", "y", "z"), (None, "no id", "x", "y", "z"), (99, "long " * 9000, "x", "y", "z")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_query_holds_every_document_whole(spark, tmp_path):
    rows, df = docs(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    tok, want = Tokenizer.from_file(PATH), []
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k, a, len(ids[a:a + 2048]), zlib.crc32(struct.pack(f"<{len(ids[a:a + 2048])}I", *ids[a:a + 2048]))) for k, a in enumerate(range(0, len(ids), 2048))]
    got = queries.QUERIES["op12_vector_packing"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    n = check([r["length"] for r in got], [r["sequence_id"] for r in got], [r["offset"] for r in got], (2048, 10 ** 9, 10 ** 12))
    assert n <= -(-sum(w[3] for w in want) // 2048) + 1


def test_ids_blocks_and_the_empty_table(spark, tmp_path):
    _, df = docs(spark)
    out = pack_documents(df, PATH, tokens=256, documents=5, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"])) == r["ids_crc32"] for r in out)
    check([r["length"] for r in out], [r["sequence_id"] for r in out], [r["offset"] for r in out], (256, 5, 256 ** 2))
    token_pieces(df, PATH).write.parquet(f"{tmp_path}/pieces")
    blocks = pack(spark.read.parquet(f"{tmp_path}/pieces"), block_pieces=20).collect()
    assert len({r["sequence_id"] >> 32 for r in blocks}) > 3
    check([r["length"] for r in blocks], [r["sequence_id"] for r in blocks], [r["offset"] for r in blocks], (2048, 2048, 2048 ** 2))
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
