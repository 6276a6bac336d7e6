"""Benchmark decontamination over a distributed positional inverted index.

Training documents are cut into segments of a few MB. A segment holds the sorted hashes
of all its words and, per word, the ascending positions at which it stands; segments are
rows of a table, so the index is partitioned by documents and no posting list of a
frequent word gathers in one task. A test window is answered inside each segment: its
terms' position lists, shifted by their offset in the window, are intersected from the
rarest term on. Proximity matches ask instead that all terms stand in one document within
``slop`` words of a posting of one of them, whichever; documents of a segment lie further
apart than that.

The query set (the benchmark) is taken in blocks of bounded size.

Defined results: null text has no words, is not contaminated and hits nothing; repeated
rows are judged each; benchmark rows with null item_id or without words ask nothing,
rows sharing an item_id are one item; with an empty benchmark nothing is hit; other
columns are ignored (``keep_clean`` carries them through).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import column, documents_of, ship, steps, stored, utf8, word_hashes

WINDOW = 13
#: Words of distance in the registered query's proximity matches: exact matches are near, and those with words put in or moved.
SLOP = WINDOW
#: Characters of benchmark text that one pass carries to the executors.
BLOCK_CHARS = 4_000_000
#: Postings that one vectorised step follows, and bits of a position in a key of term and position.
STEP_POSTINGS, PLACE_BITS = 1 << 20, 36
INDEX = "segment long, doc_ids array<long>, word_at array<int>, terms binary, posting_at binary, positions binary"
FOUND = "segment long, place int, doc_id long, n_words long, hits array<int>, items array<string>, near_items array<string>"


@dataclass
class Segment:
    """Positions of document i begin at ``word_at[i] + i * gap``: no window spans two documents."""

    word_at: np.ndarray
    terms: np.ndarray
    posting_at: np.ndarray
    positions: np.ndarray


@dataclass
class Windows:
    """Distinct windows: vocabulary indexes per place (-1 beyond a short one) and the items asking each."""

    vocabulary: np.ndarray
    places: np.ndarray
    items: list[list[str]]
    size: int


def gap_of(size: int, slop: int) -> int:
    """Positions between documents that neither a window nor a proximity match spans."""
    return max(size, slop + 1)


def build_segment(data: np.ndarray, offsets: np.ndarray, gap: int) -> Segment:
    words, at = word_hashes(data, offsets, "alnum")
    order = np.argsort(words, kind="stable")
    ranked = words[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(words) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    positions = (np.arange(len(words)) + doc * gap)[order]
    return Segment(at, ranked[first], np.append(first, len(words)), positions)


def build_windows(items: list[tuple[str, str]], size: int) -> Windows:
    """All windows of the items' words; an item of fewer words than ``size`` is one window."""
    asked: dict[tuple[int, ...], list[str]] = {}
    for item, text in items:
        raw = np.frombuffer(text.encode(), np.uint8)
        words = word_hashes(raw, np.array([0, len(raw)]), "alnum")[0].tolist()
        for i in range(max(1, len(words) - size + 1) if words else 0):
            names = asked.setdefault(tuple(words[i : i + size]), [])
            if item not in names:
                names.append(item)
    vocabulary = np.unique(np.array([w for ws in asked for w in ws], np.uint64))
    places = np.full((len(asked), size), -1, np.int64)
    for k, ws in enumerate(asked):
        places[k, : len(ws)] = np.searchsorted(vocabulary, np.array(ws, np.uint64))
    return Windows(vocabulary, places, list(asked.values()), size)


def _within(around: np.ndarray, lists: list[np.ndarray], slop: int) -> np.ndarray:
    """The positions that have one of each list within ``slop``."""
    for own in lists:
        lo = np.searchsorted(own, around - slop)
        around = around[(lo < len(own)) & (own[np.minimum(lo, len(own) - 1)] <= around + slop)]
        if not len(around):
            break
    return around


def _near(segment: Segment, keys: np.ndarray, place: np.ndarray, size: np.ndarray, places: np.ndarray, rows: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """(window, postings of its rarest term that have one of each of its terms within ``reach``) of the windows ``rows`` with any.

    ``keys`` are all postings as term << PLACE_BITS + position. Windows that overlap share
    their rarest terms: terms are ranked from the rarest on, and each distinct beginning
    of the ranked terms is answered once, from the postings left by the one before it.
    """
    ranked = np.take_along_axis(places[rows], np.lexsort((places[rows], size[places[rows]]), axis=1), 1)
    order = np.lexsort(ranked.T[::-1])
    rows, ranked = rows[order], ranked[order]
    ends, lo = np.cumsum(size[ranked[:, 0]]), 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP_POSTINGS, "right")))
        terms = ranked[lo:hi]
        new = np.append(True, terms[1:, 0] != terms[:-1, 0])
        own = [segment.positions[segment.posting_at[t] : segment.posting_at[t + 1]] for t in place[terms[new, 0]].tolist()]
        at, bounds = np.concatenate(own), np.cumsum([0, *map(len, own)])
        for r in range(1, terms.shape[1]):
            parent = np.cumsum(new) - 1
            new = new | np.append(True, terms[1:, r] != terms[:-1, r])
            parent, v = parent[new], terms[new, r]
            n = np.diff(bounds)[parent]
            at = at[np.repeat(bounds[parent] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            node = np.repeat(np.arange(len(v)), n)
            asked = ((place[v] << PLACE_BITS) - reach)[node] + at
            key = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)]
            kept = (v < 0)[node] | ((key >= asked) & (key <= asked + 2 * reach))
            at, bounds = at[kept], np.append(0, np.cumsum(np.bincount(node[kept], minlength=len(v))))
            if not len(at):
                break
        else:
            leaf = np.cumsum(new) - 1
            for k in np.flatnonzero(np.diff(bounds)[leaf]).tolist():
                yield int(rows[lo + k]), at[bounds[leaf[k]] : bounds[leaf[k] + 1]]
        lo = hi


def search(segment: Segment, asked: Windows, slop: int = 0) -> tuple[dict[int, np.ndarray], dict[int, set[str]], dict[int, set[str]]]:
    """Per document of the segment with any: hit word numbers, exact items, items in proximity."""
    hits: dict[int, list[np.ndarray]] = {}
    items: dict[int, set[str]] = {}
    near: dict[int, set[str]] = {}
    if not len(segment.terms) or not len(asked.vocabulary):
        return {}, {}, {}
    place = np.minimum(np.searchsorted(segment.terms, asked.vocabulary), len(segment.terms) - 1)
    there = segment.terms[place] == asked.vocabulary
    size = np.append(np.where(there, segment.posting_at[place + 1] - segment.posting_at[place], 0), len(segment.positions) + 1)
    begins = segment.word_at[:-1] + np.arange(len(segment.word_at) - 1) * gap_of(asked.size, slop)

    def postings(term: int) -> np.ndarray:
        return segment.positions[segment.posting_at[place[term]] : segment.posting_at[place[term] + 1]]

    def docs_at(positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(begins, positions, "right") - 1

    rows = np.flatnonzero((size[asked.places] > 0).all(axis=1))
    if slop:
        left = []
        keys = np.repeat(np.arange(len(segment.terms)) << PLACE_BITS, np.diff(segment.posting_at)) + segment.positions
        # all within slop of one posting are within twice that of the rarest term's, so most windows end here
        for k, about in _near(segment, keys, place, size, asked.places, rows, 2 * slop):
            left.append(k)
            terms = asked.places[k]
            ranked = sorted(range(int((terms >= 0).sum())), key=lambda o: (size[terms[o]], o))
            lists = [postings(t) for t in dict.fromkeys(terms[o] for o in ranked)]
            low = ((place[np.unique(terms[terms >= 0])] << PLACE_BITS) - slop)[:, None] + about
            lo = np.searchsorted(keys, low.ravel())
            n = np.searchsorted(keys, low.ravel() + 2 * slop, "right") - lo
            # the postings, of whichever term, within slop of the rarest one's
            around = np.unique(keys[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())] & ((1 << PLACE_BITS) - 1))
            for d in set(docs_at(_within(around, lists, slop)).tolist()):
                near.setdefault(d, set()).update(asked.items[k])
        if 2 * slop >= asked.size - 1:  # an exact match is one of those
            rows = np.array(sorted(left), np.int64)
    for k in rows.tolist():
        terms = asked.places[k]
        length = int((terms >= 0).sum())
        ranked = sorted(range(length), key=lambda o: (size[terms[o]], o))
        starts = postings(terms[ranked[0]]) - ranked[0]
        for offset in ranked[1:]:
            if not len(starts):
                break
            own = postings(terms[offset])
            at = np.minimum(np.searchsorted(own, starts + offset), len(own) - 1)
            starts = starts[own[at] == starts + offset]
        if not len(starts):
            continue
        docs = docs_at(starts)
        for d in set(docs.tolist()):
            own = starts[docs == d] - begins[d]
            hits.setdefault(d, []).append((own[:, None] + np.arange(length)).ravel())
            items.setdefault(d, set()).update(asked.items[k])
    return {d: np.unique(np.concatenate(h)) for d, h in hits.items()}, items, near


def query_blocks(benchmark: DataFrame, size: int) -> Iterator[Windows]:
    """The benchmark's windows, in blocks of about BLOCK_CHARS characters (at least one block)."""
    asked = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        yield build_windows([tuple(r) for r in part.orderBy("item_id", "text").toLocalIterator()], size)


def build_index(df: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """The stored index over all documents, for proximity matches up to ``slop``: one row per segment."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            ids = column(batch, "doc_id")
            for i, j in steps(offsets):
                s = build_segment(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], gap_of(size, slop))
                words = np.diff(s.positions.astype(np.int64), prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([ids.slice(i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([s.word_at.astype(np.int32)], pa.list_(pa.int32())), pa.array([s.terms.tobytes()], pa.binary()), pa.array([s.posting_at.astype(np.uint32).tobytes()], pa.binary()), pa.array([words.astype(np.int32).tobytes()], pa.binary())],
                    ["segment", "doc_ids", "word_at", "terms", "posting_at", "positions"],
                )
                number += 1

    return documents_of(df).mapInArrow(run, INDEX)


def _segment(row: dict) -> Segment:
    return Segment(
        np.array(row["word_at"], np.int64),
        np.frombuffer(row["terms"], np.uint64),
        np.frombuffer(row["posting_at"], np.uint32).astype(np.int64),
        np.cumsum(np.frombuffer(row["positions"], np.int32), dtype=np.int64),
    )


def search_index(index: DataFrame, asked: Windows, slop: int = 0) -> DataFrame:
    """One row per indexed document with its hit words and items for one block of queries; ``slop`` as the index was built for."""
    ship(index.sparkSession)
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: column(batch, n)[r].as_py() for n in batch.schema.names}
                segment, n = _segment(row), len(row["doc_ids"])
                hits, items, near = search(segment, shared.value, slop)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(segment.word_at), pa.int64()), pa.array([hits.get(d, []) for d in range(n)], pa.list_(pa.int32())), *[pa.array([sorted(x.get(d, ())) for d in range(n)], pa.list_(pa.string())) for x in (items, near)]],
                    ["segment", "place", "doc_id", "n_words", "hits", "items", "near_items"],
                )

    return index.mapInArrow(run, FOUND)


def contamination(df: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per document: words, hit words, matched items, the verdict, and items in proximity.

    A document is contaminated if it has hit words and they are a twentieth of its words
    or more.
    """
    index = stored(build_index(df, size, slop), "positional-index", parquet__block__size=16 << 20)
    parts = [search_index(index, asked, slop) for asked in query_blocks(benchmark, size)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    if len(parts) > 1:
        merged = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("hits", "items", "near_items")]
        found = found.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *merged)
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.concat_ws(",", F.array_sort("near_items")).alias("near_items"),
    )


def keep_clean(df: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows, unchanged, that aren't contaminated; segments are built and asked in one pass.

    With several blocks of queries the hit words so far travel with the rows.
    """
    ship(df.sparkSession)
    hit = "stagewise_hit_words"
    at, fields = df.columns.index("text"), df.schema.fields
    out = df.withColumn(hit, F.array().cast("array<int>"))
    words = "stagewise_words"
    out = out.withColumn(words, F.lit(0).cast("int"))

    def pass_of(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = utf8(batch.column(at))
                before, counts, found = batch.column(len(fields)).to_pylist(), [], []
                for i, j in steps(offsets):
                    segment = build_segment(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], gap_of(size, 0))
                    hits = search(segment, shared.value)[0]
                    counts.append(np.diff(segment.word_at))
                    found += [sorted({*before[i + d], *hits.get(d, np.zeros(0, int)).tolist()}) for d in range(j - i)]
                total = np.concatenate(counts) if counts else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(found, pa.list_(pa.int32())), pa.array(total, pa.int32())], batch.schema.names)

        return run

    for asked in query_blocks(benchmark, size):
        out = out.mapInArrow(pass_of(df.sparkSession.sparkContext.broadcast(asked)), out.schema)
    clean = (F.size(hit) == 0) | (20 * F.size(hit) < F.col(words))
    return out.where(clean).drop(hit, words)
