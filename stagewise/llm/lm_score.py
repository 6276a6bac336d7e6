"""Scoring with a log-bilinear neural language model trained by noise-contrastive estimation.

Tokens are counted over all training documents. Words are dealt to classes, whose number
grows with the square root of the vocabulary: the most frequent words are classes of
their own, every other word belongs to a class by its last two bytes. A word's
probability has two factors, each log-bilinear and normalised exactly:

* that of its class after the two classes before it, by
  ``(r[c1] C1 + r[c2] C2) . q[w] + b[w]``, and
* its share of the class after the class c1 before it, by ``u[w] . (r[c1] C1)`` beside the
  logarithm of its count plus one (one more for words never seen). All words whose counts
  are broadcast (``HEAD``, 2^18 at most) have such a vector u; the rarer ones have none.

The first factor is trained on every training token in each of ``ROUNDS``. Token codes are
stored and dealt by a hash of their document to shards of bounded size, whose number
follows the corpus: each shard trains a copy of the parameters in numpy and the copies are
averaged, weighted by their steps, in whole numbers. So a score is a function of the table
alone, however its rows lie. The second factor is trained on the counts of (class before,
word) pairs of all training tokens, class by class, with the expected noise in place of
drawn one. Batched matrix products over all pairs of context classes, and over all words
of a class, give the normalising constants.

Defined results: null text is empty and has its end token alone; repeated rows are
scored each; a null doc_id is in training; without training documents all classes are
equally likely; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import STEP_BYTES, column, discard, documents_of, mix64, remainder, ship, steps, stored, utf8, word_table

#: Classes at least and at most (powers of two; an eighth by endings), and words with counts and vectors of their own.
LEAST_CLASSES, MOST_CLASSES, HEAD = 128, 512, 1 << 18
WIDTH, BATCH, NOISE, RATE, ROUNDS = 32, 1024, 128, 0.05, 2
END = np.uint64(0x5DEECE66D5DEECE6)
#: Fixed point of averaged parameters: sums of whole numbers don't depend on their order.
POINT = float(1 << 20)
#: Tokens of a shard on average and of a piece of a document at most.
SHARD_TOKENS, PIECE = 1 << 21, 1 << 16
#: Noise samples a word, rate, steps and pull to zero of the vectors within a class.
INNER_NOISE, INNER_RATE, INNER_STEPS, INNER_PULL = 4, 0.3, 20, 1.0
#: Words within a class that are trained at a time, beside all contexts.
INNER_WORDS = 256


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, 16-bit hashes of their endings and n + 1 offsets per document, each document closed by END."""
    words, at, ending = word_table(data, offsets, "space")
    docs = np.arange(len(at) - 1)
    bounds = at + np.arange(len(at))
    place = np.arange(len(words)) + np.repeat(docs, np.diff(at))
    tokens, kinds = np.full(len(words) + len(docs), END, np.uint64), np.zeros(len(words) + len(docs), np.int64)
    tokens[place] = words
    kinds[place] = (mix64(ending.astype(np.uint64)) >> np.uint64(48)).astype(np.int64)
    return tokens, kinds, bounds


@dataclass
class Counts:
    """Head words by hash, their counts, classes (-1: by ending) and endings, and totals of the classes."""

    words: np.ndarray
    n: np.ndarray
    single: np.ndarray
    kind: np.ndarray
    singles: int
    endings: int
    total: int
    distinct: int
    class_n: np.ndarray
    class_norm: np.ndarray

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head and whether it is there."""
        if not len(self.words):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        bits, starts = self.leading
        lead = tokens >> np.uint64(64 - bits)
        at, end = starts.take(lead), starts[1:].take(lead)
        np.minimum(at, len(self.words) - 1, out=at)
        there = self.words.take(at) == tokens
        left = np.flatnonzero(~there & (at + 1 < end))
        while len(left):
            at[left] += 1
            there[left] = self.words[at[left]] == tokens[left]
            left = left[~there[left] & (at[left] + 1 < end[left])]
        return at, there

    @cached_property
    def leading(self) -> tuple[int, np.ndarray]:
        """A number of bits, and where the words begin that lead with each value of them: two to four values a word."""
        bits = len(self.words).bit_length() + 1
        n = np.bincount((self.words >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        return bits, np.append(0, np.cumsum(n)).astype(np.int32)

    def ending(self, kinds: np.ndarray) -> np.ndarray:
        """Which of the ending classes."""
        return kinds * self.endings >> 16

    def classes(self, at: np.ndarray, there: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        single = self.single[at] if len(self.single) else np.full(len(at), -1)
        return np.where(there & (single >= 0), single, self.singles + self.ending(kinds))

    @property
    def size(self) -> int:
        return self.singles + self.endings


def _tally(words: np.ndarray, kinds: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word once, ascending, with its kind and the sum of its ``n`` (or its number of places)."""
    order = np.argsort(words)
    ranked = words[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(words)])
    return ranked[first], kinds[order[first]], np.diff(np.append(first, len(words))) if n is None else np.add.reduceat(n[order], first)


def count_tokens(docs: DataFrame) -> DataFrame:
    """word, kind, n of all tokens, ends included, stored in the shared folder."""
    schema = pa.schema([("word", pa.int64()), ("kind", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _tally(*map(np.concatenate, zip(*held, strict=True)))

        def out(words: np.ndarray, kinds: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(kinds, pa.int32()), pa.array(n)], schema=schema)

        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            for i, j in steps(offsets):
                held.append(_tally(*tokens_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[:2]))
                size += len(held[-1][0])
                # tables are merged once they hold twice what may stay, not one by one
                if size > 1 << 21:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*merged())

    partial = docs.select("text").mapInArrow(run, "word long, kind int, n long")
    return stored(partial.groupBy("word", "kind").agg(F.sum("n").alias("n")), "word-counts")


def class_count(vocabulary: int) -> int:
    """The power of two next to the square root of the vocabulary, within the bounds."""
    return min(MOST_CLASSES, max(LEAST_CLASSES, 1 << round(np.log2(max(1, vocabulary)) / 2)))


def head_of(counts: DataFrame, limit: int = HEAD) -> Counts:
    """The most frequent words, at most ``limit``, cut between eighths of octaves of the count."""
    octave = F.floor(F.log2("n") * 8).cast("int")
    sums = counts.groupBy(octave.alias("octave")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    cut, got = 1 << 20, 0
    for o, words, _ in sorted(sums, reverse=True):
        if got + words > limit:
            break
        cut, got = o, got + words
    distinct = sum(r[1] for r in sums)
    endings = class_count(distinct) // 8
    top = counts.where(octave >= cut).toPandas().sort_values(["n", "word"], ascending=[False, True], kind="stable").reset_index(drop=True)
    kinds = counts.groupBy(F.shiftright(F.col("kind") * endings, 16).alias("ending")).agg(F.count("*"), F.sum("n")).collect()
    singles = min(7 * endings, len(top))
    single = np.full(len(top), -1, np.int64)
    single[:singles] = np.arange(singles)
    class_n, class_norm = np.zeros(singles + endings, np.int64), np.ones(endings, np.int64)
    for ending, words, n in kinds:
        class_n[singles + ending] += n
        class_norm[ending] += n + words
    kind = top["kind"].to_numpy(np.int64)
    for k, (ending, n) in enumerate(zip((kind[:singles] * endings >> 16).tolist(), top["n"].iloc[:singles], strict=True)):
        class_n[k] = n
        class_n[singles + ending] -= n
        class_norm[ending] -= n + 1
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return Counts(words[order], top["n"].to_numpy(np.int64)[order], single[order], kind[order], singles, endings, sum(r[2] for r in sums), distinct, class_n, class_norm)


@dataclass
class Bilinear:
    """Parameters: context vectors (the last row begins a document), two position matrices, outputs, biases."""

    r: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    q: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(share: np.ndarray, seed: int = 5) -> Bilinear:
        rng, n = np.random.Generator(np.random.PCG64(seed)), len(share)
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        eye = np.eye(WIDTH, dtype=np.float32)
        return Bilinear(small(n + 1, WIDTH), eye.copy(), 0.5 * eye, small(n, WIDTH), np.log(share).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def like(self, flat: np.ndarray) -> Bilinear:
        """The parameters in ``flat``: views of it, if it has float32."""
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32, copy=False))
            at += p.size
        return Bilinear(*out)


def _scatter(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index; rows have an even number of float32, which are added as pairs."""
    order = np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")
    ranked = at[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    out = np.zeros((n, values.shape[1]), np.float32)
    out[ranked[first]] = np.add.reduceat(values.take(order, axis=0).view(np.complex64), first).view(np.float32)
    return out


def _sigmoid_of_minus(x: np.ndarray) -> np.ndarray:
    """1 / (1 + e^x) in the place of ``x``; 0 where e^x is beyond float32."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive steps with per-parameter rates; noise follows the class shares and is shared by a batch."""

    def __init__(self, model: Bilinear, share: np.ndarray, seed: int) -> None:
        self.values, self.rng = model.flat(), np.random.Generator(np.random.PCG64(seed))
        self.model, self.slope = model.like(self.values), np.zeros_like(self.values)
        self.slopes = model.like(self.slope).parts()
        self.cumulated = np.cumsum(share)
        self.offset = np.log(NOISE * share).astype(np.float32)
        self.squares = np.full_like(self.values, 1e-6)
        self.steps = 0

    def step(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> None:
        m, size = self.model, len(self.offset)
        drawn = np.bincount(np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), size - 1), minlength=size)
        # a class drawn several times is computed once and counts as often
        noise = np.flatnonzero(drawn)
        times = drawn[noise].astype(np.float32)[:, None]
        # products with the position matrices by class, not by token: there are fewer classes
        context = (m.r @ m.c1).take(c1, axis=0)
        context += (m.r @ m.c2).take(c2, axis=0)
        minus = self.offset - m.b
        qw, qn = m.q.take(w, axis=0), m.q[noise]
        real = np.einsum("ij,ij->i", context, qw)
        real -= minus[w]
        real = _sigmoid_of_minus(real)[:, None]
        fake = context @ -qn.T
        fake += minus[noise]
        _sigmoid_of_minus(fake)
        back = np.empty((3, len(w), WIDTH), np.float32)
        np.multiply(real, context, out=back[0])
        np.multiply(real, qw, out=back[1])
        back[1] -= fake @ (times * qn)
        back[2] = back[1]
        sums = _scatter(np.concatenate([w, c1 + size, c2 + (2 * size + 1)]), back.reshape(-1, WIDTH), 3 * size + 2)
        d1, d2 = sums[size : 2 * size + 1], sums[2 * size + 1 :]
        dr, dc1, dc2, dq, db = self.slopes
        dr[:] = d1 @ m.c1.T + d2 @ m.c2.T
        dc1[:], dc2[:], dq[:], db[:] = m.r.T @ d1, m.r.T @ d2, sums[:size], np.bincount(w, real[:, 0], size)
        dq[noise] -= times * (fake.T @ context)
        db[noise] -= times[:, 0] * (np.ones(len(w), np.float32) @ fake)
        g = self.slope
        g /= len(w)
        root = g * g
        self.squares += root
        np.sqrt(self.squares, out=root)
        g *= RATE
        g /= root
        self.values += g
        self.steps += 1


def contexts(classes: np.ndarray, bounds: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each token; ``begin`` before a document."""
    out = []
    for back in (1, 2):
        c = np.full(len(classes), begin, np.int64)
        c[back:] = classes[:-back]
        for k in range(back):
            at = bounds[:-1] + k
            c[at[at < bounds[1:]]] = begin
        out.append(c)
    return out[0], out[1]


def coded(docs: DataFrame, counts: Counts) -> DataFrame:
    """shard, mixed, codes, classes of all pieces of documents, stored: int32 places in the head, or -1 - ending, and uint16 classes.

    A piece begins with the two codes before it, or with -2^31 at a document's start.
    Shards follow the hash of a piece's codes, so they don't depend on how rows lie.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    shards = max(1, round(counts.total / SHARD_TOKENS))
    start, begin = np.full(2, np.iinfo(np.int32).min, np.int32), np.full(2, counts.size, np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            for i, j in steps(offsets):
                tokens, kinds, bounds = tokens_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, there = own.find(tokens)
                codes = np.where(there, at, -1 - own.ending(kinds)).astype(np.int32)
                classes = own.classes(at, there, kinds).astype(np.uint16)
                rows = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    whole, kept = np.concatenate([start, codes[a:b]]), np.concatenate([begin, classes[a:b]])
                    for k in range(2, len(whole), PIECE):
                        piece = whole[k - 2 : k + PIECE].tobytes()
                        mixed = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "big") >> 1
                        rows.append((mixed % shards, mixed, piece, kept[k - 2 : k + PIECE].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "mixed", "codes", "classes"])

    rows = docs.select("text").mapInArrow(run, "shard int, mixed long, codes binary, classes binary")
    return stored(rows, "token-codes")


def _classes_of(own: Counts, codes: np.ndarray) -> np.ndarray:
    """Classes of codes; one beyond them where a document begins."""
    place = np.maximum(codes, 0)
    single = own.single[place] if len(own.single) else np.full(len(codes), -1)
    ending = own.singles + np.where(codes >= 0, own.ending(own.kind[place]) if len(own.kind) else 0, -1 - codes.astype(np.int64))
    classes = np.where((codes >= 0) & (single >= 0), single, ending)
    return np.where(codes == np.iinfo(np.int32).min, own.size, classes)


def _shards(batches: Iterator[pa.RecordBatch], of: str, kind: type, limit: int = STEP_BYTES) -> Iterator[tuple[int, list[np.ndarray], bool]]:
    """(shard, pieces of about ``limit`` bytes, whether they are its first) of rows in the order of shards."""
    here, pieces, held, first = None, [], 0, True
    for batch in batches:
        for shard, codes in zip(column(batch, "shard").to_pylist(), column(batch, of), strict=True):
            if pieces and (shard != here or held > limit):
                yield here, pieces, first
                first, pieces, held = shard != here, [], 0
            here = shard
            pieces.append(np.frombuffer(codes.as_py(), kind))
            held += pieces[-1].nbytes
    if pieces:
        yield here, pieces, first


def train(pieces: DataFrame, counts: Counts) -> tuple[Bilinear, np.ndarray]:
    """The class model of ``coded`` pieces, and the classes' shares."""
    spark = pieces.sparkSession
    share = (counts.class_n + 1) / (counts.class_n + 1).sum()
    model = Bilinear.start(share)
    shards = max(1, round(counts.total / SHARD_TOKENS))
    for round_ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, share))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, round_=round_) -> Iterator[pa.RecordBatch]:
            start, share_ = shared.value
            trainer = None

            def out() -> Iterator[pa.RecordBatch]:
                if trainer is not None:
                    flat = np.round(trainer.model.flat().astype(np.float64) * POINT).astype(np.int64) * trainer.steps
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1) - 1, pa.int32()), pa.array(np.append(trainer.steps, flat))], ["at", "value"])

            for shard, held, first in _shards(batches, "classes", np.uint16):
                if first:
                    yield from out()
                    trainer = Trainer(start.like(start.flat()), share_, 7919 * shard + round_)
                classes = np.concatenate(held)
                target = np.ones(len(classes), bool)
                begins = np.cumsum([0, *map(len, held)])[:-1]
                target[begins] = target[begins + 1] = False
                w = np.flatnonzero(target)
                order = trainer.rng.permutation(w)
                for k in range(0, len(order), BATCH):
                    pick = order[k : k + BATCH]
                    trainer.step(*(classes[pick - back].astype(np.int64) for back in (1, 2, 0)))
            yield from out()

        # ranges deal shards evenly and never split one
        rows = pieces.select("shard", "mixed", "classes").repartitionByRange(shards, "shard").sortWithinPartitions("shard", "mixed", "classes")
        sums = rows.mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).toPandas().sort_values("at")
        if len(sums):
            values = sums["value"].to_numpy(np.float64)
            model = model.like(values[1:] / values[0] / POINT)
    return model, share


def _held(batches: Iterator[pa.RecordBatch], limit: int = 8 * STEP_BYTES) -> Iterator[list[np.ndarray]]:
    """Codes of pieces, some at a time: the more are counted together, the fewer rows leave a task."""
    held, size = [], 0
    for batch in batches:
        for codes in column(batch, "codes"):
            held.append(np.frombuffer(codes.as_py(), np.int32))
            size += held[-1].nbytes
            if size > limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def pair_counts(pieces: DataFrame, counts: Counts) -> DataFrame:
    """ending, before (a class), word (place in the head) and n of all training tokens in the head that have no class of their own."""
    shared = pieces.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for held in _held(batches):
            codes = np.concatenate(held)
            inner = codes >= 0
            inner[inner] = own.single[codes[inner]] < 0
            begins = np.cumsum([0, *map(len, held)])[:-1]
            inner[begins] = inner[begins + 1] = False
            at = np.flatnonzero(inner)
            keys, n = np.unique(_classes_of(own, codes[at - 1]) << 32 | codes[at].astype(np.int64), return_counts=True)
            word = keys & 0xFFFFFFFF
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(own.ending(own.kind[word]).astype(np.int32)), pa.array((keys >> 32).astype(np.int32)), pa.array(word.astype(np.int32)), pa.array(n.astype(np.int64))], ["ending", "before", "word", "n"])

    rows = pieces.select("codes").mapInArrow(run, "ending int, before int, word int, n long")
    return rows.groupBy("ending", "before", "word").agg(F.sum("n").alias("n"))


def within_class(before: np.ndarray, word: np.ndarray, n: np.ndarray, uses: np.ndarray, contexts_: np.ndarray) -> np.ndarray:
    """Vectors u of a class's words from their counts after each context: noise-contrastive, with expected noise.

    ``uses`` are the words' counts plus one, which are the noise; the score u . context is
    the logarithm of how much likelier than that a word is.
    """
    u = np.zeros((len(uses), contexts_.shape[1]), np.float32)
    noise = (INNER_NOISE * uses / uses.sum()).astype(np.float32)
    there, at = np.unique(before, return_inverse=True)
    v = contexts_[there]
    total = np.bincount(at, n, len(there)).astype(np.float32)
    order = np.argsort(word, kind="stable")
    bounds = np.searchsorted(word[order], np.arange(0, len(uses) + INNER_WORDS, INNER_WORDS))
    log_noise = np.float32(np.log(INNER_NOISE))
    # no word's vector depends on another's
    for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        own, pairs = slice(k * INNER_WORDS, (k + 1) * INNER_WORDS), order[i:j]
        x = u[own]
        seen = np.bincount((word[pairs] - own.start) * len(there) + at[pairs], n[pairs], len(x) * len(there)).reshape(len(x), -1).astype(np.float32)
        mass = seen + noise[own, None] * total
        squares = np.full(x.shape, 1e-6, np.float32)
        for _ in range(INNER_STEPS):
            fake = x @ -v.T
            fake += log_noise
            _sigmoid_of_minus(fake)
            fake *= mass
            g = np.subtract(seen, fake, out=fake) @ v
            g -= INNER_PULL * x
            squares += g * g
            x += INNER_RATE * g / np.sqrt(squares)
    return u


@dataclass
class Inner:
    """Vectors of head words (float16) and, per ending class and class before it, the logarithm of the shares' norm."""

    u: np.ndarray
    left: np.ndarray
    norm: np.ndarray

    def log10(self, counts: Counts, c1: np.ndarray, at: np.ndarray, there: np.ndarray, ending: np.ndarray, log_count: np.ndarray) -> np.ndarray:
        """Shares of tokens in ending classes; ``log_count`` is of their counts plus one."""
        fit = np.zeros(len(c1))
        k = np.flatnonzero(there)
        fit[k] = np.einsum("ij,ij->i", self.u.take(at[k], axis=0).astype(np.float32, copy=False), self.left.take(c1[k], axis=0))
        return log_count + (fit - self.norm[ending, c1]) / np.log(10)


def train_within(pieces: DataFrame, counts: Counts, model: Bilinear) -> Inner:
    """Vectors of all head words without a class of their own; a task trains whole ending classes."""
    spark = pieces.sparkSession
    left = model.r @ model.c1
    ending = counts.ending(counts.kind)
    u = np.zeros((len(counts.words), WIDTH), np.float16)
    norm = np.repeat(np.log(counts.class_norm.astype(np.float64))[:, None], len(left), axis=1)
    members = np.flatnonzero(counts.single < 0)
    if not len(members):
        return Inner(u, left, norm.astype(np.float32))
    shared = spark.sparkContext.broadcast((left, ending, members, counts.n, counts.class_norm))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        left_, ending_, members_, n_, norm_ = shared.value
        own = members_[ending_[members_] == key[0].as_py()]
        before, word, n = (rows.column(c).combine_chunks().to_numpy() for c in ("before", "word", "n"))
        uses = (n_[own] + 1).astype(np.float64)
        vectors = within_class(before, np.searchsorted(own, word), n.astype(np.float64), uses, left_).astype(np.float16)
        fit = vectors.astype(np.float32) @ left_.T
        norms = np.log(norm_[key[0].as_py()] + uses @ np.expm1(fit.astype(np.float64)))
        return pa.table({"ending": pa.array([key[0].as_py()], pa.int32()), "vectors": pa.array([vectors.tobytes()], pa.binary()), "norms": pa.array([norms.astype(np.float32).tobytes()], pa.binary())})

    grouped = pair_counts(pieces, counts).groupBy("ending").applyInArrow(run, "ending int, vectors binary, norms binary")
    for row in grouped.collect():  # HEAD vectors at most
        u[members[ending[members] == row["ending"]]] = np.frombuffer(row["vectors"], np.float16).reshape(-1, WIDTH)
        norm[row["ending"]] = np.frombuffer(row["norms"], np.float32)
    return Inner(u, left, norm.astype(np.float32))


@dataclass
class Scorer:
    """log10 P(class | two classes before), from tables over all pairs of classes."""

    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray
    norm: np.ndarray

    @staticmethod
    def of(model: Bilinear) -> Scorer:
        left, right = model.r @ model.c1, model.r @ model.c2
        first, second = left @ model.q.T, right @ model.q.T
        norm = np.empty((len(left), len(right)), np.float32)
        for i in range(len(left)):
            z = (left[i] + right) @ model.q.T + model.b
            top = z.max(axis=1, keepdims=True)
            norm[i] = (top + np.log(np.exp(z - top).sum(axis=1, keepdims=True)))[:, 0]
        return Scorer(first, second, model.b, norm)

    def log10(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> np.ndarray:
        size, contexts_ = len(self.bias), len(self.norm)
        fit = self.first.take(c1 * size + w)
        fit += self.second.take(c2 * size + w)
        fit += self.bias.take(w)
        fit -= self.norm.take(c1 * contexts_ + c2)
        return fit.astype(np.float64) / np.log(10)


_SCORED = "slot long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<word:long,tf:int>>"


def score_head(docs: DataFrame, counts: Counts, scorer: Scorer, inner: Inner) -> DataFrame:
    """Sums over the tokens of each row whose counts are at hand, and the words whose counts aren't."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, scorer, inner))
    rare_type = pa.list_(pa.struct([("word", pa.int64()), ("tf", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, model, within = shared.value
        within = Inner(within.u.astype(np.float32), within.left, within.norm)  # once a task, not for each token
        slot = TaskContext.get().partitionId() << 36
        plus = np.log10(own.n + 1.0) if len(own.n) else np.zeros(1)
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            for i, j in steps(offsets):
                tokens, kinds, bounds = tokens_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, there = own.find(tokens)
                w = own.classes(at, there, kinds)
                begins, n = bounds[:-1], j - i
                log_count = np.where(there, plus[at], 0.0)
                c1, c2 = contexts(w, bounds, own.size)
                score = model.log10(c1, c2, w)
                k = np.flatnonzero(w >= own.singles)
                score[k] += within.log10(own, c1[k], at[k], there[k], w[k] - own.singles, log_count[k])
                doc = np.repeat(np.arange(n), np.diff(bounds))
                missing = np.flatnonzero(~there)
                order = missing[np.lexsort((tokens[missing], doc[missing]))]
                new = np.append(True, (tokens[order][1:] != tokens[order][:-1]) | (doc[order][1:] != doc[order][:-1]))[: len(order)]
                first = np.flatnonzero(new)
                tf = np.diff(np.append(first, len(order)))
                words = pa.StructArray.from_arrays([pa.array(tokens[order][first].view(np.int64)), pa.array(tf.astype(np.int32))], ["word", "tf"])
                cuts = np.searchsorted(doc[order][first], np.arange(n + 1)).astype(np.int32)
                sums = [np.add.reduceat(x, begins) for x in (there.astype(np.int64), log_count, score)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot + np.arange(n)), column(batch, "doc_id").slice(i, n), column(batch, "held_out").slice(i, n), pa.array(np.diff(bounds)), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(cuts), words).cast(rare_type)],
                    ["slot", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"],
                )
                slot += n

    return docs.mapInArrow(run, _SCORED)


def score_texts(df: DataFrame) -> DataFrame:
    """The base and the model's log10 probability of every row's text; training rows have crc32(doc_id) mod 7 other than 2."""
    ship(df.sparkSession)
    docs = documents_of(df).withColumn("held_out", remainder("doc_id", 7) == 2)
    learning = docs.where("not held_out")
    table = count_tokens(learning)
    counts = head_of(table)
    pieces = coded(learning, counts)
    model, _ = train(pieces, counts)
    rows = stored(score_head(docs, counts, Scorer.of(model), train_within(pieces, counts, model)), "scored")
    discard(pieces)
    rare = rows.where(F.size("rare") > 0).select("slot", F.explode("rare").alias("x")).select("slot", "x.word", "x.tf")
    more = rare.join(table.select("word", "n"), "word").groupBy("slot").agg(F.sum("tf").alias("known_more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("log_more"))
    log_more, total = F.coalesce("log_more", F.lit(0.0)), F.lit(counts.total + counts.distinct + 1.0)
    return rows.join(more, "slot", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") + log_more - F.col("n_tokens") * F.log10(total)).alias("base_score"), (F.col("score") + log_more).alias("score"),
    )
