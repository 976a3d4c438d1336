"""Best-fit packing of documents into training sequences, by vectors.

A sequence has three capacities: tokens, documents, and attention cost (the sum of the
squared lengths of its pieces). A piece takes (length, 1, length squared). Pieces are packed
from long to short; each goes to the open sequence that it fits in every dimension and that
leaves the least residual: the weighted norm of what is left of the three capacities, each
as a share of the capacity. Where none has room, a sequence is opened.

Pieces of one length are placed together: the open sequences are ranked by the residual
that such a piece would leave, the best take one each, and those left are ranked again.

Only documents longer than a sequence are cut, into pieces of a whole sequence and the rest.

Packing runs in blocks of at most about ``BLOCK_TOKENS`` tokens and ``BLOCK_PIECES`` pieces,
dealt by the hash of a piece's own number, one task each, however large the input or a group
of copies: only numbers move, about 30 bytes a piece. A block wastes at most its last
sequences, about one in some thousands.

Defined results: a null or empty text is one piece of the end id alone; rows that repeat a
doc_id, a null one too, are documents of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import hold_alone, saved
from larder.llm.token_orc import ChunkEncoder

BLOCK_TOKENS = 16_000_000
BLOCK_PIECES = 250_000
WEIGHTS = (1.0, 0.05, 0.05)  # tokens, documents, attention cost

_ENCODERS: dict[str, ChunkEncoder] = {}  # a Python worker serves many tasks


def _cut(path: str, end_id: int, tokens: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hold_alone("packing", _ENCODERS.clear)
        if path not in _ENCODERS:
            _ENCODERS[path] = ChunkEncoder(path)
        enc, end, width = _ENCODERS[path], np.array([end_id], "<i4").tobytes(), 4 * tokens
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                out: list[tuple[int | None, int, bytes]] = []
                for i, t in zip(s.column("doc_id").to_pylist(), s.column("text").to_pylist()):
                    ids = enc.ids(t) + end if t else end
                    out += [(i, k, ids[x:x + width]) for k, x in enumerate(range(0, len(ids), width))]
                n = np.fromiter((len(x[2]) // 4 for x in out), np.int64, len(out))
                number = np.fromiter((x[1] for x in out), np.int64, len(out))
                cols = {"row": pa.array(np.arange(row, row + len(out))), "doc_id": pa.array([x[0] for x in out], pa.int64()), "piece": pa.array(number.astype(np.int32)),
                        "start": pa.array(number * tokens), "length": pa.array(n.astype(np.int32)), "ids_crc32": pa.array([zlib.crc32(x[2]) for x in out], pa.int64())}
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.frombuffer(b"".join(x[2] for x in out), "<i4")))
                yield pa.RecordBatch.from_pydict(cols)
                row += len(out)
    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, tokens: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: row (a number of its own), doc_id, piece, start, length,
    ids_crc32, and the ids themselves ``with_ids``."""
    rows = "row long, doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * with_ids
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
            .mapInArrow(_cut(tokenizer_path, end_id, tokens, with_ids), rows))


def best_fit(lengths: np.ndarray, tokens: int, documents: int, cost: int, weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset in it of each piece."""
    if len(lengths) and (lengths.max() > tokens or lengths.max() ** 2 > cost or documents < 1):
        raise ValueError("a piece does not fit an empty sequence")
    order = np.argsort(-lengths, kind="stable")
    sizes, firsts = np.unique(-lengths[order], return_index=True)
    bounds = np.r_[firsts, len(lengths)]
    into, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room = np.zeros((3, 1024), np.int64)  # of the sequences open or not: tokens, documents, cost
    open_, made = np.zeros(0, np.int64), 0
    full = np.array([tokens, documents, cost], np.int64)
    scale = np.array(weights) / full.astype(float) ** 2
    for size, a, b in zip((-sizes).tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        take = np.array([size, 1, size * size], np.int64)
        pieces = order[a:b]
        while len(pieces):
            left = room[:, open_] - take[:, None]
            fits = np.flatnonzero((left >= 0).all(axis=0))
            if not len(fits):
                break
            norm = scale @ left[:, fits].astype(float) ** 2
            n = min(len(fits), len(pieces))
            best = open_[fits[np.argsort(norm, kind="stable")[:n]]]
            into[pieces[:n]], offset[pieces[:n]] = best, tokens - room[0, best]
            room[:, best] -= take[:, None]
            pieces = pieces[n:]
        if len(pieces):
            each = int((full // np.maximum(take, 1)).min())
            new = -(-len(pieces) // each)
            while made + new > room.shape[1]:
                room = np.concatenate([room, np.zeros_like(room)], axis=1)
            place = np.arange(len(pieces))
            into[pieces], offset[pieces] = made + place // each, place % each * size
            count = np.full(new, each)
            count[-1] = len(pieces) - each * (new - 1)
            room[:, made:made + new] = full[:, None] - take[:, None] * count
            open_ = np.r_[open_, np.arange(made, made + new)]
            made += new
        open_ = open_[(room[:, open_] > 0).all(axis=0)]
    return into, offset


def pack(pieces: DataFrame, tokens: int = 2048, documents: int = 2048, cost: int = 2048 ** 2, weights: tuple[float, float, float] = WEIGHTS,
         block_tokens: int = BLOCK_TOKENS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``pieces``, a written table with row and length, with sequence_id and offset added."""
    n, total = pieces.agg(F.count("*"), F.coalesce(F.sum(F.col("length").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-total // block_tokens), -(-n // block_pieces))

    def fill(block: pa.Table) -> pa.Table:
        block = block.sort_by("row")  # the same sequences whatever order the shuffle gives
        into, offset = best_fit(block.column("length").to_numpy().astype(np.int64), tokens, documents, cost, weights)
        first = block.column("block")[0].as_py() << 32
        return block.drop_columns(["block"]).append_column("sequence_id", pa.array(first + into)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return (pieces.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long"))
            .groupBy("block").applyInArrow(fill, schema))


def pack_documents(docs: DataFrame, tokenizer_path: str, tokens: int = 2048, end_id: int = 0, documents: int = 2048, cost: int | None = None,
                   weights: tuple[float, float, float] = WEIGHTS, with_ids: bool = False) -> DataFrame:
    """Per piece of ``docs``: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset.

    Without ``cost`` a sequence may cost as much as one piece that fills it.
    """
    pieces = saved(token_pieces(docs, tokenizer_path, tokens, end_id, with_ids), "pieces")
    return pack(pieces, tokens, documents, tokens ** 2 if cost is None else cost, weights).drop("row")
