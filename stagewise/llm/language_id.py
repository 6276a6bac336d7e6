"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams per language are summed over all training rows; the
matrix of log-probabilities (languages x buckets) is broadcast, and a batch is scored by
gathering its n-grams' rows and summing them per document.

Defined results: null text, or text without a letter, is "und" with score 0; so is every
text when nothing could be learned. Equal texts get equal predictions; ties go to the
first language in order. Rows with null lang or null text teach nothing; a null doc_id
counts as not held out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import column, let_go, mix64, remainder, ship
from stagewise.llm.tokens import encoder

BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
#: Labels whose rows fit in the driver and in each worker; more raise an error.
MAX_LANGUAGES = 1024
STEP_CHARS = 1 << 19
UNDETERMINED = "und"


def _grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of each order's n-grams over texts laid end to end, and where each text begins.

    Two zero characters stand between texts, so that no n-gram spans two of them.
    """
    joined = "\0\0" + "\0\0".join(t.lower() for t in texts) + "\0\0"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begins = np.cumsum([0] + [len(t.lower()) + 2 for t in texts])
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            h = np.full(len(chars) - 2, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + chars[i : i + len(h)]
            out.append((mix64(h) >> np.uint64(49)).astype(np.int64))
    return out, begins


def _steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= STEP_CHARS):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


@dataclass
class NaiveBayes:
    languages: list[str]
    log_prob: np.ndarray  # BUCKETS x languages
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior probability of each text."""
        labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        known = [texts[i] for i in rows]
        for lo, hi in _steps(known):
            grams, begins = _grams(known[lo:hi])
            total = np.zeros((hi - lo, len(self.languages)))
            for g in grams:
                total += np.add.reduceat(self.log_prob[g], np.minimum(begins[:-1], len(g) - 1), axis=0, dtype=np.float64)
            total += self.prior
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for k, i in enumerate(rows[lo:hi]):
                labels[i], scores[i] = self.languages[best[k]], float(share[k])
        return labels, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (language, bucket, count); bucket -1 counts documents."""
    let_go(encoder)
    counts: dict[str, np.ndarray] = {}
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array((at - 1).astype(np.int32)), pa.array(c[at])], schema=schema)
        counts.clear()

    for batch in batches:
        langs, texts = column(batch, "lang").to_pylist(), column(batch, "text")
        by: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            by.setdefault(lang, []).append(i)
        for lang, at in by.items():
            own = texts.take(pa.array(at)).to_pylist()
            c = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            c[0] += len(own)
            for lo, hi in _steps(own):
                for g in _grams(own[lo:hi])[0]:
                    c[1:] += np.bincount(g, minlength=BUCKETS)
            if len(counts) > 64:
                yield from flush()
    yield from flush()


def train(df: DataFrame, where: Column | None = None) -> NaiveBayes:
    """Learn from all rows with text and lang (and ``where``, over doc_id, text and lang)."""
    ship(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(where) if where is not None else rows
    sums = rows.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # rows of one language: at most BUCKETS + 1
    got = sums.limit(MAX_LANGUAGES * (BUCKETS + 1) + 1).toPandas()
    languages = sorted(got["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((BUCKETS + 1, len(languages)))
    counts[got["bucket"].to_numpy() + 1, [languages.index(x) for x in got["lang"]]] = got["n"]
    grams = counts[1:] + SMOOTHING
    prior = np.log(counts[0] / max(1, counts[0].sum())) if languages else np.zeros(0)
    return NaiveBayes(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), prior)


def identify(df: DataFrame, model: NaiveBayes) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(encoder)
        for batch in batches:
            labels, scores = shared.value.predict(column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder("doc_id", 4) == 2).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(df: DataFrame, model: NaiveBayes, least: float = 0.5) -> DataFrame:
    """The rows, unchanged, whose text is in a learned language with a score of ``least`` or more."""
    spark = df.sparkSession
    ship(spark)
    shared, at = spark.sparkContext.broadcast(model), df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(encoder)
        for batch in batches:
            labels, scores = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(labels, scores, strict=True)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
