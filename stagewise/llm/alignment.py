"""Cross-tokenizer alignment: where two vocabularies' tokens of one text end together.

A text with a space before it is encoded by a byte-level vocabulary (A) and by a piece
vocabulary (B, which adds that space itself). Byte offsets at which tokens of both end cut
the tokens into groups; the last tokens of a group are linked. What the corpus says of a
link is its count: how many links hold the same pair of ids.

Counting: links are packed int64 keys (B id in the upper half). Every partition reduces
its keys to distinct ones with partial counts (``np.unique``), a range-partitioned sort
brings equal keys together, and run lengths are summed. A linked pair's tokens end
together, so one token's bytes are a suffix of the other's: there are at most
sum(len(token)) pairs a vocabulary, some hundred thousand whatever the corpus. That bound
lets the sorted shards be given to all executors as files, which tasks map into memory
and search with ``searchsorted``.

Encoding: no token of B holds a space after another character, and A's pre-tokeniser
never joins a space to what stands before it. So a text can be cut before each space that
follows something else than white space; both vocabularies' tokens end at every cut, and
chunks are encoded, aligned and cached on their own. ``aligner`` checks the condition on
B when it loads the vocabulary.

Defined results: a text that is null, empty, or that either vocabulary doesn't give back
byte for byte (B writes a space for U+2581) has no tokens: all numbers are 0 and the hash
is the empty string. Repeated rows count each, null doc_id stays null, an empty table
gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import documents_of, let_go, put, ship, steps, stored, utf8
from stagewise.llm.tokens import _LATIN, _LETTERS, MARKS, default_vocabulary

#: Chunks of one generation of the cache (two are kept per worker), and the longest chunk kept.
CACHE_CHUNKS, CACHE_LENGTH = 60_000, 64
#: Bytes of text aligned at a time (a longer text is a step of its own).
STEP_BYTES = 1 << 20
#: Links counted or looked up at a time (a longer text's are a step of their own).
STEP_LINKS = 1 << 18
#: Distinct keys a task holds before it merges its partial counts.
HELD = 1 << 19
SHARDS = 8
_CUT = re.compile(r"(?<=\S)(?= )")
_MIXED = re.compile(r"\s ")
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary())])
_ENCODED_DDL = "doc_id long, n_a long, n_b long, groups_sha256 string, links binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

Chunk = tuple[bytes, bytes, int]


class Aligner(dict):
    """chunk -> (its groups as text, its links as packed keys, n_a * 2^32 + n_b); None where a vocabulary loses bytes.

    Chunks begin with the space that either vocabulary puts in their first token.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.model._resize_cache(1)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {chr(letter): byte for byte, letter in _LETTERS.items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[x] for x in token) if all(x in letters for x in token) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{path_b} has pieces that join words; texts can't be cut at spaces")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b)]
        # how a token is written: inside its group, or at the end of its side
        self.written = [b"%d%s" % (i, end) for n, ends in ((len(self.bytes_a), (b",", b"|")), (len(pieces), (b",", b";"))) for end in ends for i in range(n)]
        self.space = [self.b.piece_to_id("▁")]
        self.marks = lru_cache(1 << 14)(lambda run: self.a.encode(run, add_special_tokens=False).ids)
        self.older: dict[str, Chunk | None] = {}

    def __missing__(self, chunk: str) -> Chunk | None:
        out = self[chunk] = self.older[chunk]
        return out

    def word(self, chunk: str) -> list[int] | None:
        """A's ids of a space, a run of Latin letters and perhaps marks; None for other chunks."""
        word = chunk[1:].rstrip(MARKS)
        if not word.isalpha() or not (word.isascii() or max(word) <= _LATIN):
            return None
        mark = self.marks(chunk[1 + len(word) :]) if len(word) + 1 < len(chunk) else []
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self.a.model.tokenize(chr(_LETTERS[32]) + letters)] + mark

    def learn(self, chunks: list[str]) -> None:
        """Align chunks that aren't cached: their bytes are laid end to end, and token ends are compared at once."""
        ids = list(map(self.word, chunks))
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(rest, self.a.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False), strict=True):
            ids[k] = x.ids
        pieces = self.b.encode([c[1:] for c in chunks], num_threads=1)
        pieces = [p if len(c) > 1 else self.space for c, p in zip(chunks, pieces, strict=True)]
        sides = [np.fromiter(chain.from_iterable(x), np.int64) for x in (ids, pieces)]
        raw = "".join(chunks).encode()
        if any(b"".join(map(table.__getitem__, side.tolist())) != raw for table, side in zip((self.bytes_a, self.bytes_b), sides, strict=True)):
            good = []
            for chunk, a, b in zip(chunks, ids, pieces, strict=True):
                if all(b"".join([t[i] for i in x]) == chunk.encode() for t, x in ((self.bytes_a, a), (self.bytes_b, b))):
                    good.append(chunk)
                else:
                    self[chunk] = None
            if good:
                self.learn(good)
            return
        counts = [np.array(list(map(len, x)), np.int64) for x in (ids, pieces)]
        ends = [np.cumsum(size[side]) for size, side in zip(self.sizes, sides, strict=True)]
        last = [x[np.searchsorted(x, y)] == y for y, x in (ends, ends[::-1])]
        group = [np.cumsum(x) - x for x in last]
        held = [np.append(0, np.cumsum(np.bincount(x))) for x in group]
        code, first = np.empty(len(sides[0]) + len(sides[1]), np.int64), 0
        for k, (side, is_last, table) in enumerate(zip(sides, last, (self.bytes_a, self.bytes_b), strict=True)):
            # the other side's tokens that stand before: of earlier groups, for B of its own group too
            code[np.arange(len(side)) + held[1 - k][group[k] + k]] = first + side + len(table) * is_last
            first += 2 * len(table)
        items = list(map(self.written.__getitem__, code.tolist()))
        links = (sides[1][last[1]] << 32 | sides[0][last[0]]).tobytes()
        to = np.cumsum(counts[0])
        to_links = 8 * np.cumsum(last[0])[to - 1]
        at = at_links = 0
        for chunk, end, end_links, n in zip(chunks, np.cumsum(counts[0] + counts[1]).tolist(), to_links.tolist(), (counts[0] << 32 | counts[1]).tolist(), strict=True):
            self[chunk] = b"".join(items[at:end]), links[at_links:end_links], n
            at, at_links = end, end_links

    def texts(self, texts: list[str]) -> list[tuple[int, int, str, bytes]]:
        """n_a, n_b, hash of the groups and packed links of each text."""
        cut = []
        for text in texts:
            if _MIXED.search(text) or text[:1].isspace():
                cut.append(_CUT.split(" " + text))
            else:
                cut.append([" " + part for part in text.split(" ")])
        fresh = [c for c in dict.fromkeys(chain.from_iterable(cut)) if c not in self and c not in self.older]
        if fresh:
            self.learn(fresh)
        out = []
        for text, chunks in zip(texts, cut, strict=True):
            got = list(map(self.__getitem__, chunks))
            if not text or None in got:
                out.append((0, 0, "", b""))
                continue
            groups = hashlib.sha256(b"".join([x[0] for x in got])[:-1]).hexdigest()
            counts = sum([x[2] for x in got])
            out.append((counts >> 32, counts & 0xFFFFFFFF, groups, b"".join([x[1] for x in got])))
        for c in fresh:
            if len(c) > CACHE_LENGTH:
                del self[c]
        if len(self) >= CACHE_CHUNKS:
            self.older = dict(self)
            self.clear()
        return out


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker and pair of vocabularies."""
    return Aligner(path_a, path_b)


def piece_vocabulary() -> str:
    """Path of the public piece vocabulary; callers may pass any other file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_links(df: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, groups_sha256 and the packed links of every document."""
    ship(df.sparkSession)
    path_a, path_b = path_a or default_vocabulary(), path_b or piece_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b).texts
        for batch in batches:
            for lo, hi in steps(utf8(batch.column(1))[1], STEP_BYTES):
                got = align([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                columns = [batch.column(0).slice(lo, hi - lo), *([x[k] for x in got] for k in range(4))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ENCODED, strict=True)], schema=ENCODED)

    return documents_of(df).mapInArrow(run, _ENCODED_DDL)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    keys, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _links(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a column of packed links, and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    keys = np.frombuffer(data, np.int64, (offsets[-1] - offsets[0]) // 8, offsets[0]) if data else np.zeros(0, np.int64)
    return keys, (offsets - offsets[0]) // 8


def pair_counts(encoded: DataFrame, shards: int = SHARDS) -> DataFrame:
    """shard, pair (B id << 32 | A id) and n of all links, sorted within each of ``shards`` ranges of pairs."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(aligner)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for lo, hi in steps(_links(batch.column(0))[1], STEP_LINKS):
                keys, _ = _links(batch.column(0).slice(lo, hi - lo))
                if len(keys):
                    held.append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in held) > HELD and len(held) > 1:
                    held = [_merge(held)]
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _merge(held))), ["pair", "n"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum runs of equal keys; the last run of a batch may go on in the next."""
        key, count = None, 0
        for batch in batches:
            if not len(batch):
                continue
            keys, counts = _merge([(batch.column(0).to_numpy(), batch.column(1).to_numpy())])
            if key is not None and key != keys[0]:
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([count])], ["pair", "n"])
                count = 0
            counts[0] += count
            key, count = int(keys[-1]), int(counts[-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(counts[:-1])], ["pair", "n"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([count])], ["pair", "n"])

    counted = encoded.select("links").mapInArrow(partial, "pair long, n long")
    return counted.repartitionByRange(shards, "pair").sortWithinPartitions("pair").mapInArrow(runs, "pair long, n long").withColumn("shard", F.spark_partition_id())


def publish(counts: DataFrame) -> list[tuple[int, str]]:
    """Give executors the sorted counts as shard files; (first key, file) of each.

    A shard's rows are key, count, and whether the count is the highest of the key's B id.
    The table's size has the bound that the module derives. The files lie in the shared
    folder, from which every executor, later ones too, fetches them once.
    """
    spark = counts.sparkSession
    got = counts.toArrow()
    shard, keys, n = (got.column(c).to_numpy() for c in ("shard", "pair", "n"))
    order = np.argsort(keys)
    shard, keys, n = shard[order], keys[order], n[order]
    if not len(keys):
        return []
    by_b = np.flatnonzero(np.append(True, (keys[1:] >> 32) != (keys[:-1] >> 32)))
    highest = np.repeat(np.maximum.reduceat(n, by_b), np.diff(np.append(by_b, len(keys))))
    out, token = [], uuid.uuid4().hex
    for at in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(shard)) + 1):
        file = io.BytesIO()
        np.save(file, np.stack([keys[at], n[at], (n[at] == highest[at]).astype(np.int64)]))
        name = f"pair-counts-{token}-{len(out)}.npy"
        spark.sparkContext.addFile(put(spark, name, file.getvalue()))
        out.append((int(keys[at[0]]), name))
    return out


def look_up(encoded: DataFrame, shards: list[tuple[int, str]]) -> DataFrame:
    """The digest of every document, with what the corpus counts say of its links."""
    firsts, names = np.array([k for k, _ in shards], np.int64), [n for _, n in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(aligner)
        tables = [np.load(SparkFiles.get(n), mmap_mode="r") for n in names]
        for batch in (b.slice(lo, hi - lo) for b in batches for lo, hi in steps(_links(b.column(4))[1], STEP_LINKS)):
            keys, offsets = _links(batch.column(4))
            own, count, best = np.searchsorted(firsts, keys, "right") - 1, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for s, table in enumerate(tables):
                mine = np.flatnonzero(own == s)
                at = np.searchsorted(table[0], keys[mine])
                count[mine], best[mine] = table[1][at], table[2][at]
            sums = [np.append(0, np.cumsum(x)) for x in (count, best)]
            count, best = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
            links = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, (links, links, best, count)), batch.column(3)], [f.split()[0] for f in ALIGNED.split(", ")])

    return encoded.mapInArrow(run, ALIGNED)


def align_tokenizers(df: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Digest of every document's alignment; see the module for the defined results."""
    encoded = stored(encode_links(df, path_a, path_b), "links")
    return look_up(encoded, publish(stored(pair_counts(encoded), "pair-counts")))
