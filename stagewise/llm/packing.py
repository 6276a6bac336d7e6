"""Best-fit packing by the sum of squares.

Documents become token pieces of at most ``capacity``; each piece goes to the open
sequence whose choice leaves the sum of the squared counts of open sequences per
residual gap smallest. Counts alone decide, so one vectorised look at the gaps places a
piece. Pieces are dealt by a stored row number to groups of bounded size, packed apart.

Defined results: null text is empty, an empty text is its end id alone, repeated rows
are packed each, null doc_id stays null, an empty table gives no rows, other columns of
the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import documents_of, ship, stored
from stagewise.llm.tokens import default_vocabulary, encoder

END = b"\0\0\0\0"
PIECES = "slot long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Pieces of one group: bounds a task's memory, large enough that its last open sequences don't count.
GROUP_PIECES = 50_000


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than capacity."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))]


def token_pieces(df: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """One row per piece, with a row number (``slot``) that is unique and stable once stored."""
    ship(df.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, slot = encoder(path).encode, TaskContext.get().partitionId() << 36
        schema = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + END
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((slot, doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    slot += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return documents_of(df).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece.

    Pieces are taken from long to short (ties: as given). A gap that a piece fills
    exactly or any other open gap is judged by the change of the sum of squares; equal
    changes go to the smaller gap. A sequence is opened only when no gap is wide enough.
    """
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(capacity + 1, np.int64)
    holders: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    widest = 0
    for i in order.tolist():
        size = int(lengths[i])
        gap = capacity
        if size <= widest:
            open_ = count[size : widest + 1]
            change = count[: widest + 1 - size] - open_
            change[0] = -open_[0] if open_[0] else 0
            change = np.where(open_ > 0, change, capacity + len(lengths))
            best = int(change.argmin())
            if open_[best]:
                gap = size + best
        if gap == capacity:
            bin_, used = used, used + 1
        else:
            bin_ = holders[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = bin_, capacity - gap
        if rest := gap - size:
            holders[rest].append(bin_)
            count[rest] += 1
            widest = max(widest, rest)
        while widest and not count[widest]:
            widest -= 1
    return sequence, offset


def best_fit_pack(df: DataFrame, capacity: int = 2048, vocabulary: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all documents; see the module for the rule and the defined results."""
    pieces = stored(token_pieces(df, capacity, vocabulary), "pieces")
    groups = max(1, round(pieces.count() / group_pieces))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot", kind="stable")
        sequence, offset = sum_of_squares(rows["length"].to_numpy(np.int64), capacity)
        return rows.assign(sequence_id=(int(key[0]) << 36) + sequence, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("slot"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(pack, PACKED)
