"""First-fit decreasing with a tournament tree, in randomised groups of documents.

A document is its ids and an end id. As many whole sequences as it fills are sequences of
their own; what remains, less than one sequence, is dealt by a hash of the document's
place to a group of bounded size. A group places its remainders from long to short, each
in the first sequence that has room: a tournament tree over the room of all sequences
finds it in one walk from the root.

First-fit decreasing leaves small gaps. They are filled by cutting: the emptiest
sequences of the group are dissolved and their documents cut to the fullest ones' gaps,
until at most one sequence isn't full. That one is cut into sequences whose lengths are
powers of two, which need no padding either. ``least`` keeps gaps of fewer ids as
padding, for callers who would rather pad than cut off a few ids.

Nothing but remainders is shuffled, with their ids, since only a group knows its cuts.

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

from stagewise.llm.common import documents_of, ship
from stagewise.llm.word_tokens import encode_words, word_vocabulary

END = 2
#: Bytes of text of a group: some thousand documents, so that a task's memory is bounded.
GROUP_BYTES = 24 << 20
_PARTS = "slot long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def parts_of(df: DataFrame, capacity: int, vocabulary: str) -> DataFrame:
    """One row per whole sequence of a document (``ids`` null), and one for its remainder.

    ``slot`` numbers the rows; it follows from how the input is split alone, so a task that
    runs again gives the same numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() << 36
        end, width = np.array([END], "<u4").tobytes(), 4 * capacity
        schema = pa.schema([(n, pa.int64()) for n in ("slot", "doc_id", "start", "length", "doc_tokens", "ids_crc32")] + [("ids", pa.binary())])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode_words(vocabulary, text.as_py() or "") + end
                total = len(ids) // 4
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    whole = len(part) == width
                    rows.append((slot, doc_id, at // 4, len(part) // 4, total, zlib.crc32(part), None if whole else part))
                    slot += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return documents_of(df).mapInArrow(run, _PARTS)


def first_fit(lengths: np.ndarray, capacity: int) -> list[int]:
    """The sequence of each piece, for pieces given from long to short.

    ``room[1]`` is the most room any sequence has; below each node the left child is tried
    first, so the walk ends at the first sequence with enough room.
    """
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    room, out = [capacity] * (2 * leaves), []
    for size in lengths.tolist():
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        out.append(node - leaves)
        room[node] -= size
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            best = left if left >= right else right
            if room[node] == best:
                break
            room[node] = best
    return out


def powers(total: int) -> list[int]:
    """The powers of two that sum to ``total``, from large to small."""
    return [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]


def pack_group(lengths: np.ndarray, capacity: int, least: int = 1) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in the piece, length, sequence, offset) of every cut of every piece.

    Pieces are shorter than ``capacity``; equal lengths keep their order.
    """
    order = np.argsort(-lengths, kind="stable")
    held: dict[int, list[tuple[int, int, int]]] = {}
    for i, bin_ in zip(order.tolist(), first_fit(lengths[order], capacity), strict=True):
        held.setdefault(bin_, []).append((i, 0, int(lengths[i])))
    fill = {b: sum(n for _, _, n in parts) for b, parts in held.items()}
    # from full to empty; ties: as they were opened
    open_ = sorted((b for b in held if capacity - fill[b] >= least), key=lambda b: (-fill[b], b))
    lo, hi = 0, len(open_) - 1
    while lo < hi:
        taker, giver = open_[lo], open_[hi]
        piece, start, size = held[giver].pop()
        cut = min(size, capacity - fill[taker])
        held[taker].append((piece, start, cut))
        fill[taker] += cut
        fill[giver] -= cut
        if cut < size:
            held[giver].append((piece, start + cut, size - cut))
        if capacity - fill[taker] < least:
            lo += 1
        if not held[giver]:
            del held[giver]
            hi -= 1
    if lo == hi:
        last = open_[lo]
        parts, fresh = held.pop(last), len(lengths)
        for size in powers(fill[last]):
            held[fresh], need = [], size
            while need:
                piece, start, n = parts.pop()
                cut = min(n, need)
                held[fresh].append((piece, start, cut))
                if cut < n:
                    parts.append((piece, start + cut, n - cut))
                need -= cut
            fresh += 1
    out = []
    for number, parts in enumerate(held.values()):
        offset = 0
        for piece, start, size in parts:
            out.append((piece, start, size, number, offset))
            offset += size
    return out


def first_fit_pack(df: DataFrame, capacity: int = 4096, vocabulary: str | None = None, group_bytes: int = GROUP_BYTES, least: int = 1) -> DataFrame:
    """Pack all documents; see the module for the rule and the defined results."""
    ship(df.sparkSession)
    vocabulary = vocabulary or word_vocabulary()
    total = documents_of(df).agg(F.sum(F.octet_length("text") + F.lit(1))).first()[0] or 0
    groups = -(-total // group_bytes) or 1

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot", kind="stable")
        whole = rows["ids"].isna().to_numpy()
        rest = rows[~whole].reset_index(drop=True)
        first = int(key[0]) << 36
        full = rows[whole].assign(sequence_id=first + np.arange(whole.sum()), offset=0)
        ids = [np.frombuffer(x, "<u4") for x in rest["ids"]]
        placed = pack_group(rest["length"].to_numpy(np.int64), capacity, least)
        at = np.array(placed, np.int64).reshape(-1, 5)
        cuts = rest.iloc[at[:, 0]]
        cuts = cuts.assign(
            start=cuts["start"].to_numpy() + at[:, 1],
            length=at[:, 2],
            ids_crc32=[zlib.crc32(ids[i][a : a + n].tobytes()) for i, a, n, _, _ in placed],
            sequence_id=first + int(whole.sum()) + at[:, 3],
            offset=at[:, 4],
        )
        return pd.concat([full, cuts])[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = parts_of(df, capacity, vocabulary).withColumn("pack_group", F.pmod(F.xxhash64("slot"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(pack, PACKED)
