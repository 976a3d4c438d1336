"""Token-id output in ORC: encode, write in document order, read back by stripes.

The files hold one row per document, in ascending doc_id order across and within
files: ``block`` (number of the file, constant in it), ``pos`` (ids of the documents
before it in the file), ``n_tokens`` and ``ids`` as array<int>. ORC stores the integer
columns with run-length encoding, keeps min/max row indexes for each stride and a Bloom
filter on doc_id, so a point read skips stripes and strides by metadata alone, and one
large file is read by several tasks, a stripe or more each.

Defined results: a null text counts as empty (only the end id); rows that repeat a
doc_id are written once each, ordered by text; a null doc_id sorts first; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import hold_alone

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(64 << 20),
}
ROWS = "doc_id long, block int, pos long, n_tokens int, ids array<int>"
CHUNKS_KEPT = 600_000  # encodings that a worker remembers; beyond that it starts anew


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class ChunkEncoder(dict):
    """Ids (little-endian int32 bytes) of the chunks of a text between white space.

    The tokenizer drops white space and never joins across it, so the ids of a text are
    those of its chunks one after the other, and each chunk is encoded once. A word of
    letters, with at most one full stop or comma behind it, is for sure one or two pieces
    of the pre-tokenizer, so its lower-case form goes straight to the library's model;
    any other chunk takes the library's whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        # Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        self.simple = self._words_are_simple()

    def _words_are_simple(self) -> bool:
        """Whether the shortcut holds for this file, tried on words of several scripts."""
        words = ["word", "Größe", "ÉTÉ", "año", "слово", "数量", "ſtraße", "internationalisation"]
        return all(self._word(w) == self._whole(w) for w in words) and self._whole("one,") == self._word("one") + self._whole(",")

    def _whole(self, chunk: str) -> bytes:
        return _bytes(self.tok.encode(chunk, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes | None:
        """Ids of a word of letters; None if it needs the whole way."""
        if word.isascii():
            low = word.lower()
        else:
            low = unicodedata.normalize("NFC", word).lower()
            if not low.isalpha() or "Σ" in word:  # a sigma's lower case depends on its place
                return None
            low = "".join(map(self.letters.__getitem__, low.encode()))
        return _bytes([t.id for t in self.model.tokenize(low)])

    def __missing__(self, chunk: str) -> bytes:
        ids = None
        if self.simple:
            if chunk.isalpha():
                ids = self._word(chunk)
            elif chunk[-1:] in (".", ",") and chunk[:-1].isalpha() and "Σ" not in chunk:
                ids = self[chunk[:-1]] + self[chunk[-1]]
        if ids is None:
            ids = self._whole(chunk)
        if len(chunk) <= 64:
            if len(self) >= CHUNKS_KEPT:
                self.clear()
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if "Σ" not in text and unicodedata.is_normalized("NFC", text):
            low = text.lower()
            if unicodedata.is_normalized("NFC", low):  # then lower case may come first: fewer chunks differ
                text = low
        # Python also splits at \x1c-\x1f, which the tokenizer keeps.
        if _ODD.search(text):
            return b"".join(map(self.__getitem__, filter(None, _SPACE.split(text))))
        return b"".join(map(self.__getitem__, text.split()))


_SPACE = re.compile("[ \n]+")
_ODD = re.compile("[\x1c-\x1f\x85]")
_ENCODERS: dict[str, ChunkEncoder] = {}  # a Python worker serves many tasks


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hold_alone("tokens", _ENCODERS.clear)
        if path not in _ENCODERS:
            _ENCODERS[path] = ChunkEncoder(path)
        enc, block, pos, end = _ENCODERS[path], TaskContext.get().partitionId(), 0, np.array([end_id], "<i4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                out = [enc.ids(t) + end if t else end for t in s.column("text").to_pylist()]
                n = np.fromiter((len(x) // 4 for x in out), np.int64, len(out))
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([
                    s.column("doc_id"), pa.array(np.full(len(n), block, np.int32)), pa.array(pos + ends - n), pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.frombuffer(b"".join(out), "<i4"))),
                ], names=["doc_id", "block", "pos", "n_tokens", "ids"])
                pos += int(ends[-1])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode ``text`` of every row and write the ids to ORC files in doc_id order."""
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(_encode(tokenizer_path, end_id), ROWS)
     .write.options(**ORC_OPTIONS).orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with ``doc_ids``, the filter goes down to the ORC reader,
    which skips stripes and strides by index and Bloom filter."""
    df = spark.read.schema(ROWS).orc(path)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin([int(i) for i in doc_ids]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        ends, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4")
        crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("block"), b.column("pos"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "block", "pos", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` is the sum of the files before it plus ``pos``; only one row a file is
    summed over all files.
    """
    files = (spark.read.schema(ROWS).orc(path).groupBy("block")
             .agg(F.sum(F.col("n_tokens").cast("long")).alias("n"), F.min("doc_id").alias("first")))
    before = Window.orderBy(F.col("first").asc_nulls_first(), "block").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = read_tokens(spark, path).mapInArrow(_digest, "doc_id long, block int, pos long, n_tokens long, ids_crc32 long")
    return rows.join(files, F.col("block") == F.col("b")).select("doc_id", (F.col("base") + F.col("pos")).alias("start"), "n_tokens", "ids_crc32")
