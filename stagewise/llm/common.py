"""Helpers shared by the corpus operators: scratch tables, Arrow text buffers, word hashing."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_LOCAL_SCRATCH: dict[str, str] = {}

#: Bytes of text that one vectorised step holds at a time (a longer text is a step of its own).
STEP_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, whatever their Python path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="stagewise-ship-")
    target = os.path.join(folder, "stagewise_ship.zip")
    with zipfile.ZipFile(target, "w") as out:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    atexit.register(shutil.rmtree, folder, True)
    _SHIPPED.add(app)


def let_go(*cached: Callable) -> None:
    """Empty caches (``lru_cache``) that earlier tasks have left in this worker: Spark gives its workers to later stages."""
    if any(c.cache_info().currsize for c in cached):
        for c in cached:
            c.cache_clear()
        gc.collect()  # they hold cycles


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder the cluster shares (``spark.checkpoint.dir``).

    Where that is unset, as in tests on a local master, a temporary folder stands in;
    any other master without the setting is refused, since its executors could not
    see the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_SCRATCH:
            _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="stagewise-scratch-")
            atexit.register(shutil.rmtree, _LOCAL_SCRATCH[app], True)
        root = "file://" + _LOCAL_SCRATCH[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    """The Hadoop path and the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file to a fresh place in the shared folder; it goes when the application ends."""
    path = scratch(spark, "file")
    at, files = _files(spark, f"{path}/{name}")
    out = files.create(at)
    out.write(bytearray(data))
    out.close()
    files.deleteOnExit(at.getParent())
    return f"{path}/{name}"


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at, files = _files(df.sparkSession, path)
            files.delete(at, True)


def stored(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    What ``discard`` hasn't deleted by then goes when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    for key, value in options.items():
        writer = writer.option(key.replace("__", "."), value)
    writer.parquet(path)
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def documents_of(df: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads, under internal names, so that no other column can clash."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *[F.col(c) for c in more],
    )


def remainder(doc_id: str, modulus: int) -> F.Column:
    """crc32(doc_id as text) mod ``modulus``; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus)), F.lit(0))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8) if at else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``limit`` bytes together, or of one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def _mixers(seed: int) -> tuple[np.ndarray, np.uint64]:
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.integers(0, 2**64, 256, dtype=np.uint64)
    return table, np.uint64(int(rng.integers(0, 2**62)) * 4 + 3)


BYTE_VALUES, BASE = _mixers(20240601)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1024)
        run = np.full(size, BASE, np.uint64)
        run[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(run)
    return _POWERS


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True
#: Which bytes, after lower-casing A-Z, belong to words.
WORDS = {"space": _SPACE, "alnum": _ALNUM}


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """``word_table`` without the endings."""
    return word_table(data, offsets, kind)[:2]


def word_table(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some documents, n + 1 offsets of each document's words, and the words' last two bytes.

    ``kind`` "space": words are ``[^\\x20\\x09-\\x0D]+``; "alnum":
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; both after lower-casing A-Z. UTF-8 keeps
    every separator a single byte, so words of bytes are words of characters.
    """
    low = _LOWER[data]
    inside = WORDS[kind][low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(first[at])
    lengths = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, lengths)
    with np.errstate(over="ignore"):
        values = BYTE_VALUES[low[at]] * _powers(int(lengths.max()))[place]
        hashes = mix64(np.add.reduceat(values, begin) + lengths.astype(np.uint64))
    last = begin + lengths - 1
    ending = low[at[last]].astype(np.int64) * 256 + np.where(lengths > 1, low[at[last - 1]], 0)
    return hashes, np.searchsorted(at[begin], offsets, "left"), ending


def joined_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words: one for each start but the last size - 1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * BASE + hashes[i : i + n]
    return mix64(out)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
