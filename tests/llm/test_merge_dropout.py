import numpy as np
import public_tokenizers

from larder.llm import merge_dropout as M

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, decoded string"
TEXTS = ["A line of words, and more words.\nNext line: internationalisation 42!", "a  b   c\n\n d", "  x", " " * 50 + "y", "x" * 300 + "\n" * 5 + "thethethe" * 40, "中文 🎉 Größe é́ ²."]


def test_without_dropout_it_is_the_library():
    enc = M.Dropout(PATH, 1, 0.0)
    for t in TEXTS:
        assert enc(0, t).tolist() == enc.pieces.sp.encode(t)


def test_round_trip_and_seeds():
    for t in [*TEXTS, "literal ▁ mark ▁▁ and \x00 zero", "", " ", "\t\r\n"]:
        ids = {}
        for key in range(4):
            enc = M.Dropout(PATH, key, 0.3)
            ids[key] = enc(9, t).tolist()
            assert enc.pieces.decode(np.array(ids[key], np.int64)) == t
            assert M.Dropout(PATH, key, 0.3)(9, t).tolist() == ids[key]
        if len(t) > 60:
            assert len({tuple(x) for x in ids.values()}) > 1


def test_batches_heap_and_scan_agree():
    p = M.Pieces(PATH)
    units = ["internationalisation", "▁the", "▁▁▁x", "abcabcabcabc", "zzzz", "🎉", "²", "a", "▁Straßenbahnen"]
    for limit in (0, 1 << 61, 1 << 63):
        for draw in (1, 77):
            many = p.unit_ids_of(units, np.full(len(units), draw, np.uint64), limit)
            assert many == [p.unit_ids(u, limit, draw) for u in units]
            assert all(p.segment(u, limit, draw) == p._agenda(u, limit, draw) for u in units)


def test_rows(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, None, "x", "y"), (3, TEXTS[3], "x", "y"), (7, "", "x", "y"), (8, "long " * 30_000, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    enc = M.dropout_ids(df, PATH)
    got = enc.collect()
    assert len(got) == len(rows) and all(r["decoded"] for r in got)
    assert len({tuple(r["ids"]) for r in got if r["doc_id"] == 3}) == 1
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in M.decode_ids(enc, PATH).collect()) == sorted((i is None, i, t or "") for i, t, _, _ in rows)
    assert {(r["doc_id"], r["n_pieces"]) for r in M.ids_digest(enc).collect()} == {(r["doc_id"], len(r["ids"])) for r in got}
    # Another partitioning gives the same ids.
    assert {(r["doc_id"], tuple(r["ids"])) for r in M.dropout_ids(df.coalesce(1), PATH).collect()} == {(r["doc_id"], tuple(r["ids"])) for r in got}
    assert M.dropout_ids(df.limit(0), PATH).count() == 0


def test_each_occurrence_has_its_own_agenda():
    text = "internationalisation of 中文 words, " * 40 + "x" * 50
    for dropout in (0.1, 0.6):
        enc = M.Dropout(PATH, 5, dropout)
        units = enc._units(text)
        want = [enc.pieces.unit_ids(u, enc.limit, d) for u, d in zip(units, enc.draws_of(3, len(units)).tolist())]
        assert enc(3, text).tobytes() == b"".join(want)
        assert enc(3, text).tobytes() == b"".join(want)  # from remembered paths


def test_skip_rate_at_every_place_and_frequent_words_vary():
    for key in (1, 2):
        enc = M.Dropout(PATH, key, 0.1)
        draws = np.concatenate([enc.draws_of(d, 500) for d in range(40)])
        for start in range(12):
            for left, right in ((1, 1), (2, 1), (1, 3), (4, 2)):
                code = np.uint64(start << 40 ^ left << 20 ^ right)
                assert abs((M.mixed(draws ^ code) < np.uint64(enc.limit)).mean() - 0.1) < 0.012
        for word in ("the", "people", "different"):
            unit, n = M.MARK + word, 3000
            got = enc(7, " ".join([word] * n))
            whole = enc.pieces.unit_ids(unit, 0, 0)
            seen = [enc.pieces.unit_ids(unit, enc.limit, d) for d in enc.draws_of(7, n).tolist()]
            assert got.tobytes() == b"".join(seen)
            fair = np.random.default_rng(key).integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
            share = sum(enc.pieces.unit_ids(unit, enc.limit, d) == whole for d in fair.tolist()) / n
            assert len(set(seen)) > 4 and share < 0.95 and abs(seen.count(whole) / n - share) < 0.04
