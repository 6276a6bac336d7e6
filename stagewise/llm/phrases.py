"""Phrases whose words stand together, by contiguous pattern growth.

A word is known by a 64-bit hash of its language and its letters. Level by level:

1. words: every partition reduces its words to distinct ones with counts; infrequent ones
   are let go by a filter of fixed size. The filter may let others through, which costs
   rows, never results.
2. pairs of neighbouring words, the same way. Triples of two frequent pairs are counted by
   their hash alone, which can only raise a count: they too make a filter.
3. growth: from each place of a frequent triple a pointer is projected to the prefix pair,
   with the words it points at (five at most, cut where a triple isn't frequent) and the
   number of equal places in its partition. All pointers of
   a prefix are one task's (a task takes many prefixes, one after the other), which
   extends the prefix to the right depth first: pointers are split by their next word,
   and each word with enough places is a longer prefix with its own pointers. A prefix
   with more than ``task_rows`` pointers is not gathered: its extensions by one word are
   counted with map-side sums and dealt as prefixes of their own.

Scores divide by the frequencies of the two parts of each cut, in decimals of 38 digits,
divided to whole numbers.

Two words with one hash would add up. A second hash is counted along, so that a frequent
value which two words share is seen; the counts are then made anew with another seed.

Defined results: null text is empty; null lang is ``und``; pieces without words, one-word
texts and empty tables give no phrases; repeated rows count each; other columns are
ignored. A text of any length is read whole, in one step of its own if it is long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagewise.llm.common import _mixers, mix64, ship, steps, stored, utf8

MOST_WORDS, LEAST = 5, 100
#: Bits of the filters of frequent words and pairs: a fixed size.
FILTER_BITS = 26
#: Pointers of a prefix that one task gathers.
TASK_ROWS = 20_000
#: Distinct rows a task holds before it hands on its partial counts.
HELD = 1 << 20
UNKNOWN = "und"
_H = [f"h{k}" for k in range(1, MOST_WORDS + 1)]

_UPPER = np.uint64(0xFFFFFFFF00000000)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
_INSIDE = ~_BREAK
_INSIDE[[9, 32]] = False


class Words:
    """The words of some documents: hash (never 0), document, whether the next word follows in the same piece, and place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, seed: int, check: bool = False) -> None:
        low = _LOW[data]
        inside = _INSIDE[low]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        first[cuts] = inside[cuts]
        at = np.flatnonzero(inside)
        begin = np.flatnonzero(first[at])
        lengths = np.diff(np.append(begin, len(at)))
        self.low, self.start, self.length = low, at[begin], lengths
        self.document = np.searchsorted(offsets, self.start, "right") - 1
        breaks = np.append(0, np.cumsum(_BREAK[low]))
        self.joined = np.zeros(len(begin), bool)
        self.joined[:-1] = (self.document[1:] == self.document[:-1]) & (breaks[self.start[1:]] == breaks[self.start[:-1]])
        lanes = []
        for lane in range(1 + check):
            values, base = _mixers(seed + 7919 * lane)
            powers = np.full(int(lengths.max(initial=1)), base, np.uint64)
            powers[0] = 1
            with np.errstate(over="ignore"):
                powers = np.multiply.accumulate(powers)
                spread = values[low[at]] * powers[np.arange(len(at)) - np.repeat(begin, lengths)]
                sums = np.add.reduceat(spread, begin) if len(begin) else np.zeros(0, np.uint64)
                hashes = mix64(mix64(sums + lengths.astype(np.uint64)) + langs[self.document])
            lanes.append(np.where(hashes == 0, np.uint64(1), hashes).view(np.int64))
        self.hash, self.check = lanes[0], lanes[-1]

    def __len__(self) -> int:
        return len(self.hash)

    def spell(self, at: np.ndarray) -> list[str]:
        """Words as text; bytes that aren't whole characters can't occur, since cuts are single bytes."""
        raw = self.low.tobytes()
        return [raw[a : a + n].decode() for a, n in zip(self.start[at].tolist(), self.length[at].tolist(), strict=True)]


def _documents(df: DataFrame) -> DataFrame:
    return df.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))


def _read(batches: Iterator[pa.RecordBatch], seed: int, check: bool = False) -> Iterator[tuple[Words, list[str]]]:
    """The words of every step of a partition, and the language of each of its documents."""
    values, _ = _mixers(seed + 1)
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        langs = batch.column(1).to_pylist()
        kinds = {g: int.from_bytes(g.encode(), "little") for g in set(langs)}
        with np.errstate(over="ignore"):
            keys = {g: int(mix64(np.array([(v % (2**61 - 1)) ^ int(values[len(g) % 256])], np.uint64))[0]) for g, v in kinds.items()}
        lang_keys = np.array([keys[g] for g in langs], np.uint64)
        for lo, hi in steps(offsets):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lang_keys[lo:hi], seed, check)
            if len(words):
                yield words, langs[lo:hi]


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of all columns."""
    key = columns[0].view(np.uint64)
    with np.errstate(over="ignore"):
        for c in columns[1:]:
            key = mix64(key) + c.view(np.uint64)
    return mix64(key)


def _distinct(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sums of ``counts`` over equal rows, and the place of one row of each.

    Rows are sorted by the first column's upper half (rows that begin alike shuffle in less
    space) and a hash of all columns, and told apart by the columns themselves; rows of
    equal keys may come out in several parts, whose counts are summed later.
    """
    key = columns[0].view(np.uint64) & _UPPER | _key(columns) >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    first = np.flatnonzero(new)
    return [c[order[first]] for c in columns], np.add.reduceat(counts[order], first) if len(first) else counts[:0], order[first]


def _summed(rows: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the distinct rows of a partition, merged until ``HELD`` are held."""
    held: list[tuple[list[np.ndarray], np.ndarray]] = []

    def merged() -> tuple[list[np.ndarray], np.ndarray]:
        columns = [np.concatenate([h[0][k] for h in held]) for k in range(len(held[0][0]))]
        return _distinct(columns, np.concatenate([h[1] for h in held]))[:2]

    def batch(columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, counts]], names)

    for columns in rows:
        held.append(_distinct(columns, np.ones(len(columns[0]), np.int64))[:2])
        if sum(len(h[1]) for h in held) > HELD:
            held = [merged()]
            if len(held[0][1]) > HELD // 2:
                yield batch(*held.pop())
    if held:
        yield batch(*merged())


def _bit(columns: list[np.ndarray]) -> np.ndarray:
    """Place of a row in a filter."""
    return (_key(columns) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(frequent: DataFrame, columns: list[str]) -> np.ndarray:
    """Bits of all rows, packed: built by ranges of the filter in tasks, so the driver gets its fixed size once."""
    bits = 1 << FILTER_BITS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bit([c.to_numpy() for c in batch.columns]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    got = frequent.select(*columns).mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def _passes(bits: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    at = _bit(columns)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """h1, lang and n: frequency of each word hash (lang null), and all words of each language (h1 null).

    ``clash`` tells that several words share the hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}

        def rows() -> Iterator[list[np.ndarray]]:
            for words, langs in _read(batches, seed, check=True):
                for lang, n in zip(langs, np.bincount(words.document, minlength=len(langs)).tolist(), strict=True):
                    totals[lang] = totals.get(lang, 0) + n
                yield [words.hash, words.check]

        for batch in _summed(rows(), ["h1", "check", "n"]):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(len(batch), pa.string())], ["h1", "check", "n", "lang"])
        if totals:
            nothing = pa.nulls(len(totals), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, pa.array(list(totals.values()), pa.int64()), pa.array(list(totals), pa.string())], ["h1", "check", "n", "lang"])

    counted = docs.mapInArrow(run, "h1 long, check long, n long, lang string")
    return counted.groupBy("h1", "lang").agg(F.sum("n").alias("n"), (F.min("check") != F.max("check")).alias("clash"))


def count_pairs(docs: DataFrame, frequent: np.ndarray, seed: int) -> DataFrame:
    """h1, h2 and n of neighbouring words that the filter lets through; h1 and ``spelled`` (word, tab, language) of each such word."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, spelled = shared.value, np.zeros(0, np.int64)
        told: list[pa.RecordBatch] = []
        schema = ["h1", "h2", "n", "spelled"]

        def rows() -> Iterator[list[np.ndarray]]:
            nonlocal spelled
            for words, langs in _read(batches, seed):
                known = _passes(bits, [words.hash])
                at = np.flatnonzero(known[:-1] & known[1:] & words.joined[:-1])
                fresh, place = np.unique(words.hash[known], return_index=True)
                new = ~np.isin(fresh, spelled, assume_unique=True)
                place = np.flatnonzero(known)[place[new]]
                spelled = np.union1d(spelled, fresh[new]) if len(spelled) < HELD else fresh
                if len(place):
                    nothing = pa.nulls(len(place), pa.int64())
                    said = [f"{w}\t{langs[d]}" for w, d in zip(words.spell(place), words.document[place].tolist(), strict=True)]
                    told.append(pa.RecordBatch.from_arrays([pa.array(words.hash[place]), nothing, nothing, pa.array(said, pa.string())], schema))
                yield [words.hash[at], words.hash[at + 1]]

        for batch in _summed(rows(), ["h1", "h2", "n"]):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(len(batch), pa.string())], schema)
            yield from told
            told.clear()
        yield from told

    counted = docs.mapInArrow(run, "h1 long, h2 long, n long, spelled string")
    return counted.groupBy("h1", "h2", "spelled").agg(F.sum("n").alias("n"))


def _triples(words: Words) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where three words stand in one piece, and the three."""
    at = np.flatnonzero(words.joined[:-1] & words.joined[1:])
    return at, [words.hash[at], words.hash[at + 1], words.hash[at + 2]]


def count_triples(docs: DataFrame, pairs: np.ndarray, seed: int) -> DataFrame:
    """key (a hash) and n of triples whose two pairs the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for words, _ in _read(batches, seed):
            _, (a, b, c) = _triples(words)
            both = _passes(bits, [a, b]) & _passes(bits, [b, c])
            yield pa.RecordBatch.from_arrays([pa.array(_key([a[both], b[both], c[both]]).view(np.int64))], ["key"])

    return docs.mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def project(docs: DataFrame, triples: np.ndarray, seed: int) -> DataFrame:
    """h1 to h5 (0 where cut) and n: the words that each pointer of a frequent triple points at."""
    shared = docs.sparkSession.sparkContext.broadcast(triples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def rows() -> Iterator[list[np.ndarray]]:
            for words, _ in _read(batches, seed):
                h, goes_on = np.append(words.hash, np.zeros(MOST_WORDS, np.int64)), np.zeros(len(words) + MOST_WORDS, bool)
                at, three = _triples(words)
                goes_on[at] = _passes(bits, [_key(three).view(np.int64)])
                at = np.flatnonzero(goes_on)
                columns, on = [h[at], h[at + 1], h[at + 2]], np.ones(len(at), bool)
                for k in range(3, MOST_WORDS):
                    on &= goes_on[at + k - 2]
                    columns.append(np.where(on, h[at + k], 0))
                yield columns

        yield from _summed(rows(), [*_H, "n"])

    return docs.mapInArrow(run, f"{', '.join(f'{c} long' for c in _H)}, n long")


def _grow(table: np.ndarray, counts: np.ndarray, at: np.ndarray, prefix: tuple[int, ...], known: int, least: int, out: list[tuple]) -> None:
    """Extend ``prefix``, whose places the pointers ``at`` are, to the right, depth first."""
    depth = len(prefix)
    if depth == MOST_WORDS:
        return
    at = at[table[depth][at] != 0]
    following = table[depth][at]
    order = np.argsort(following, kind="stable")
    at, following = at[order], following[order]
    ends = np.append(np.flatnonzero(following[1:] != following[:-1]) + 1, len(at)) if len(at) else []
    begin = 0
    sums = np.append(0, np.cumsum(counts[at]))
    for end in ends:
        n = int(sums[end] - sums[begin])
        if n >= least:
            longer = (*prefix, int(following[begin]))
            if depth >= known:
                out.append((longer, n))
            _grow(table, counts, at[begin:end], longer, known, least, out)
        begin = end


def grow_prefixes(pointers: DataFrame, known: int, least: int) -> DataFrame:
    """Frequent phrases of more than ``known`` words, from all pointers of prefixes of ``known`` words."""

    def emit(columns: list[np.ndarray]) -> pa.RecordBatch:
        out: list[tuple] = []
        _grow(np.stack(columns[:-1]), columns[-1], np.arange(len(columns[0])), (), known, least, out)
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.list_(pa.int64())), pa.array([n for _, n in out], pa.int64())], ["phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come prefix by prefix; the last prefix of a batch may go on in the next."""
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            changes = np.zeros(len(columns[0]) - 1, bool)
            for c in columns[:known]:
                changes |= c[1:] != c[:-1]
            whole = int(np.flatnonzero(changes)[-1]) + 1 if changes.any() else 0
            held = [c[whole:] for c in columns]
            if whole:
                yield emit([c[:whole] for c in columns])
        if held is not None:
            yield emit(held)

    prefix = _H[:known]
    return pointers.select(*_H, "n").repartition(*prefix).sortWithinPartitions(*prefix).mapInArrow(run, "phrase array<long>, f long")


def grown(pointers: DataFrame, least: int, task_rows: int) -> DataFrame:
    """phrase (word hashes) and f of all frequent phrases of three words and more."""
    out, open_ = [], pointers
    for known in range(2, MOST_WORDS + 1):
        prefix = _H[:known]
        sizes = open_.groupBy(*prefix).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("f"))
        if known > 2:
            out.append(sizes.where(F.col("f") >= least).select(F.array(*prefix).alias("phrase"), "f"))
        if known == MOST_WORDS:
            break
        hot = stored(sizes.where(F.col("rows") > task_rows).select(*prefix), "hot-prefixes")
        if hot.isEmpty():
            out.append(grow_prefixes(open_, known, least))
            break
        out.append(grow_prefixes(open_.join(hot, prefix, "left_anti"), known, least))
        open_ = stored(open_.join(hot, prefix, "left_semi").where(F.col(_H[known]) != 0), "open-prefixes")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def frequent_phrases(df: DataFrame, least: int = LEAST, task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrase, f) of one to five words; (h1, lang, word) of the words; (lang, n) of all words."""
    ship(df.sparkSession)
    docs, seed = _documents(df), 20240711
    while True:
        words = stored(count_words(docs, seed).where((F.col("n") >= least) | F.col("h1").isNull()), "phrase-words")
        if words.where("clash").isEmpty():
            break
        seed += 1
    totals = words.where("h1 is null").select("lang", "n")
    words = words.where("h1 is not null")
    pairs = stored(count_pairs(docs, _filter(words, ["h1"]), seed).where((F.col("n") >= least) | F.col("spelled").isNotNull()), "phrase-pairs")
    spelled = pairs.where("spelled is not null").join(words.select("h1"), "h1", "left_semi").select("h1", F.expr("substr(spelled, instr(spelled, '\t') + 1)").alias("lang"), F.substring_index("spelled", "\t", 1).alias("word"))
    pairs = pairs.where("spelled is null").select("h1", "h2", "n")
    triples = count_triples(docs, _filter(pairs, ["h1", "h2"]), seed).where(F.col("n") >= least)
    pointers = stored(project(docs, _filter(triples, ["key"]), seed), "phrase-pointers")
    single = words.select(F.array("h1").alias("phrase"), F.col("n").alias("f"))
    double = pairs.select(F.array("h1", "h2").alias("phrase"), F.col("n").alias("f"))
    return stored(single.unionByName(double).unionByName(grown(pointers, least, task_rows)), "phrases"), spelled, totals


def _exact(column: str) -> F.Column:
    return F.col(column).cast("decimal(19,0)")


def mine_phrases(df: DataFrame, least: int = LEAST, most: int = 2000, task_rows: int = TASK_ROWS) -> DataFrame:
    """Each language's first ``most`` phrases; see the module for the rule and the defined results."""
    phrases, spelled, totals = frequent_phrases(df, least, task_rows)
    size = F.size("phrase")
    candidates = phrases.where(size > 1)
    # a longer phrase as frequent as one inside it: so is the one with one word more, at either end
    inside = candidates.where(size > 2).select("f", F.explode(F.array(F.slice("phrase", F.lit(1), size - 1), F.slice("phrase", F.lit(2), size - 1))).alias("phrase"))
    covered = inside.groupBy("phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(covered, "phrase", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("f"))).select("phrase", F.col("f").alias("a"))
    names = spelled.select(F.col("h1").alias("first"), "lang").join(F.broadcast(totals), "lang")
    kept = kept.withColumn("first", F.element_at("phrase", 1)).join(names, "first").select("phrase", "a", "lang", "n")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("*", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, size - F.col("k")).alias("right"))
    parts = [phrases.select(F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r"))]
    cuts = cuts.join(parts[0], "left").join(parts[1], "right")
    score = F.expr("cast((cast(1000 as decimal(4,0)) * a_x * n_x) div (l_x * r_x) as long)")
    cuts = cuts.withColumns({f"{c}_x": _exact(c) for c in "anlr"}).withColumn("score", score)
    best = cuts.groupBy("phrase", "lang", "a", "n").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    words = best.select("*", F.posexplode("phrase").alias("place", "h1")).join(spelled.select("h1", "word"), "h1")
    text = words.groupBy("phrase", "lang", "a", "n", "cut").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("text"))
    rows = text.select("lang", F.col("text").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # a language is cut in parts first, so that no task sorts all its phrases
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM pieces),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM lists GROUP BY lang),
runs AS (SELECT lang, words, unnest(range(1, 6)) AS size FROM lists),
places AS (SELECT lang, size, words, unnest(range(1, CAST(len(words) AS BIGINT) - size + 2)) AS spot FROM runs),
found AS (SELECT lang, words[spot : spot + size - 1] AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= {LEAST}),
candidates AS (SELECT * FROM found WHERE len(phrase) > 1),
longer AS (
  SELECT lang, phrase[1 : len(phrase) - 1] AS phrase, f FROM candidates UNION ALL
  SELECT lang, phrase[2 : len(phrase)] AS phrase, f FROM candidates),
kept AS (
  SELECT c.lang, c.phrase, c.f AS a FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.f >= 100 * c.f)),
cuts AS (SELECT *, unnest(range(1, CAST(len(phrase) AS BIGINT))) AS k FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
    CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN totals t USING (lang)
  JOIN found x ON x.lang = c.lang AND x.phrase = c.phrase[1 : c.k]
  JOIN found y ON y.lang = c.lang AND y.phrase = c.phrase[c.k + 1 : len(c.phrase)]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank,
    array_to_string(phrase, ' ') AS phrase, a, l, r, n, score FROM best)
SELECT * FROM ranked WHERE rank <= 2000
"""
