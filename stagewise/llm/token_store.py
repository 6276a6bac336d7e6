"""Token-id files: one zstandard frame per document, all with one shared dictionary.

The store is a folder of Parquet shards written by Spark's committer, so a lost executor
never leaves half a shard. Shards hold ascending doc_id ranges; a row is a block of
documents: dictionary hash, doc_ids, an offset index into the payload, the id count of
everything before it in its shard, and the payload (each document's own frame). A short
document is read by decoding its frame alone.

Defined results: null text is empty and gives the end id alone; rows with equal doc_id
stand in order of a hash of their text (equal texts: any order gives the same result);
null doc_id sorts first; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.llm.common import column, documents_of, scratch, ship
from stagewise.llm.tokens import default_vocabulary, encoder

END = b"\0\0\0\0"
BLOCK_BYTES, BLOCK_DOCUMENTS = 256 << 10, 1024
BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("dictionary_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
BLOCKS_DDL = "shard int, block int, first_id long, n_ids long, dictionary_sha256 string, doc_ids array<long>, offsets array<long>, payload binary"


def train_dictionary(df: DataFrame, vocabulary: str, sample_documents: int = 256, segment_ids: int = 1024, size: int = 16 << 10) -> bytes:
    """A dictionary from serialized ids of a bounded sample.

    ``sample_documents`` documents are drawn by a hash of their id; each gives one segment
    of ``segment_ids`` ids at a place drawn from its checksum. The sample only shapes the
    compression, never which rows or ids are stored.
    """
    total = df.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40))
    keep = int((1 << 40) * min(1.0, 4 * sample_documents / max(1, total)))
    texts = df.where(draw < keep).orderBy(draw, F.crc32("text")).limit(sample_documents).select("text").collect()
    encode, samples = encoder(vocabulary).encode, []
    for (text,) in texts:
        ids = encode(text or "") + END
        spare = max(0, len(ids) // 4 - segment_ids)
        at = 4 * (zlib.crc32(ids) % (spare + 1))
        samples.append(ids[at : at + 4 * segment_ids])
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples themselves serve
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_store(df: DataFrame, path: str, vocabulary: str | None = None, level: int = 3) -> bytes:
    """Write all documents in ascending doc_id order; returns the dictionary, stored beside the shards."""
    spark, vocabulary = df.sparkSession, vocabulary or default_vocabulary()
    ship(spark)
    docs = documents_of(df)
    raw = train_dictionary(docs, vocabulary)
    digest = hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw)).compress
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        names, offsets, payload, count = [], [0], bytearray(), 0

        def row() -> pa.RecordBatch:
            values = [shard], [block], [before], [count], [digest], [names], [offsets], [bytes(payload)]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, BLOCKS, strict=True)], schema=BLOCKS)

        for batch in batches:
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), strict=True):
                ids = encode(text.as_py() or "") + END
                payload += squeeze(ids)
                names.append(doc_id)
                offsets.append(len(payload))
                count += len(ids) // 4
                if len(payload) >= BLOCK_BYTES or len(names) >= BLOCK_DOCUMENTS:
                    yield row()
                    block, before = block + 1, before + count
                    names, offsets, payload, count = [], [0], bytearray(), 0
        if names:
            yield row()

    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.repartitionByRange(*keys).sortWithinPartitions(*keys)
    blocks = ordered.mapInArrow(run, BLOCKS_DDL)
    blocks.write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(f"{path}/shards")
    spark.createDataFrame([(digest, bytearray(raw))], "dictionary_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return raw


def frames(block: dict, decoder: zstandard.ZstdDecompressor) -> Iterator[tuple[int | None, bytes]]:
    """Documents of one block, each decoded from its own frame."""
    for i, doc_id in enumerate(block["doc_ids"]):
        yield doc_id, decoder.decompress(block["payload"][block["offsets"][i] : block["offsets"][i + 1]])


def read_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    digest, raw = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError("the stored dictionary doesn't match its hash")
    return digest, bytes(raw)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[bytes]:
    """Ids of one document (of each row with that id), touching only blocks that name it."""
    digest, raw = read_dictionary(spark, path)
    decoder = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
    found = spark.read.parquet(f"{path}/shards").where(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    return [ids for block in found.orderBy("shard", "block").toLocalIterator() for name, ids in frames(block.asDict(), decoder) if name == doc_id]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files alone."""
    ship(spark)
    digest, raw = read_dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/shards")
    # one row per shard: as many as the writing job had partitions
    totals = dict(blocks.groupBy("shard").agg(F.sum("n_ids")).collect())
    starts, run_ = {}, 0
    for shard in sorted(totals):
        starts[shard], run_ = run_, run_ + totals[shard]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in batches:
            for i in range(batch.num_rows):
                block = {name: column(batch, name)[i].as_py() for name in batch.schema.names}
                if block["dictionary_sha256"] != digest:
                    raise ValueError("a block names another dictionary")
                at, rows = starts[block["shard"]] + block["first_id"], []
                for doc_id, ids in frames(block, decoder):
                    rows.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
                    at += len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(df: DataFrame, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Write the store (by default in the shared folder) and describe what its files hold."""
    path = path or scratch(df.sparkSession, "token-store")
    write_store(df, path, vocabulary)
    return read_store(df.sparkSession, path)
