import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larder.llm import token_orc

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, pos string"
ODD = ["a\x1cb c\x85d İstanbul ΣΑΣ <|endoftext|> can't I'll x y é ́z ½ ⅷ Ⅷ ǅ ª 中文,字. it's.", "", " ", "...,", ".", "ﬁn ŉ ß ẞ Große, Straße.",
       "\tTabs\r\nand  lines\n\n", "á Á,", "word" * 5000, "x " * 20_000, " nbsp wide"]


def test_chunks_give_the_librarys_ids():
    tok, enc = Tokenizer.from_file(PATH), token_orc.ChunkEncoder(PATH)
    assert enc.simple
    for t in ODD:
        assert list(struct.unpack(f"<{len(enc.ids(t)) // 4}I", enc.ids(t))) == tok.encode(t, add_special_tokens=False).ids


@pytest.fixture
def written(spark, tmp_path):
    rows = [(i * 7 % 40, ODD[i % len(ODD)], "x", "y") for i in range(40)] + [(None, None, "x", "y"), (3, "again", "x", "y"), (3, "again", "x", "y")]
    path = str(tmp_path / "tokens")
    token_orc.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), path, PATH)
    return rows, path


def test_files_in_order_and_digest(spark, written):
    rows, path = written
    tok, at, want = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = [tuple(r) for r in token_orc.token_digest(spark, path).orderBy("start").collect()]
    assert got == want


def test_point_reads_are_pushed_down(spark, written):
    _, path = written
    df = token_orc.read_tokens(spark, path, [5, 3])
    assert "PushedFilters: [In(doc_id, [3,5])]" in df._jdf.queryExecution().toString().replace("[5,3]", "[3,5]")
    assert sorted(r["doc_id"] for r in df.collect()) == [3, 3, 3, 5]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    token_orc.write_tokens(spark.createDataFrame([], SCHEMA), path, PATH)
    assert token_orc.token_digest(spark, path).count() == 0
