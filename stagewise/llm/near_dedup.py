"""Near-duplicate detection with a MinHash LSH forest, confirmed on full shingle sets.

A signature of 16-bit minima is read in several orders (trees). Per tree the signatures
are sorted; documents with a common prefix of ``MIN_DEPTH`` values or more are
neighbours, and form a region. In a region of at most ``REGION`` documents every pair is
a candidate. A denser region is split at the next depth, down to ``MAX_DEPTH`` values;
parts that are still dense keep the links to the region's smallest document and to the
next neighbours in order. Set sizes and a 128-bit sketch drop candidates far below the
similarity.

Dense regions lose no pair and never list all their pairs. Up to ``HUBS`` central documents
are a region's references, and those of its largest component its hubs: every member is
compared with them. Let M be the shingles that most references have, q = p / (1 + p) for a similarity p, and x be a
document linked with no hub. x & y must hold q(|x| + |y|) shingles, so a link of x and y
needs one of three things:

* a shingle outside M that both have;
* else |x & y| is |x & M| less the shingles of M that y misses and x has. Those are fewer
  than B = min over hubs h of q(|h| - |y|) + |M - h|, so that of any B missing shingles of
  y one is missing in x as well;
* or y misses fewer than B of M. Then x reaches the similarity with M.

So each document gives the region's index a prefix of its shingles outside M, those rarest
among the references first (long enough that two documents that need k in common share
one), and one of its missing ones; only pairs of different components that meet there are candidates.
Entries that many documents give are regions of their own and are treated alike.

Equal sets are one class, so copies never form pairs. Candidates are confirmed on the
full sets: first one candidate per document, then those that join different components.

Rows are sorted by range over (tree, values, doc_id), so a group of copies of any size
is spread over tasks; the ends of every range are compared again across ranges.

Defined results: null or wordless text has an empty set and is linked with nothing; rows
sharing a doc_id are one node with the links of all its texts; a row with null doc_id is
linked with nothing, has null component_id and is kept; an empty table gives no rows;
other columns are ignored (``keep_first`` carries them through).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import BASE, column, discard, documents_of, joined_hashes, let_go, mix64, ship, steps, stored, utf8, word_hashes
from stagewise.llm.tokens import encoder

VALUES, TREES, MIN_DEPTH, MAX_DEPTH, REGION = 128, 24, 4, 8, 16
#: Differing bits of 128 beyond which a pair is no candidate: at similarity 0.8 a pair
#: differs in 12.8 with a standard deviation of 3.4.
SKETCH_BITS = 30
#: Members compared with one document by one task.
STAR = 64
#: Pairs up to which a shingle of a hub's index is paired at once, and rounds after which longer ones are too.
LISTED, HUB_ROUNDS, HUBS = 1 << 16, 2, 16
ONE = np.ones(1, np.int64)
#: Sides of rows that meet in a task: references of the largest component, others, and those compared with them.
HUB_SIDE, OTHER_SIDE, MEMBER_SIDE = 0, 1, 2
#: Bits of the filter that keeps texts in no pair from being sent anywhere: a fixed size.
FILTER_BITS = 26
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"
FOREST = "tree int, near long, deep long, doc long, size long, sketch_a long, sketch_b long"
LINKS = f"kind int, a long, b long, {FOREST.replace('doc long, ', '')}"

_RNG = np.random.Generator(np.random.PCG64(99))
_MULTIPLIERS = _RNG.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RNG.integers(0, 2**64, VALUES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; fewer words than ``words`` are one shingle."""
    hashes, at = word_hashes(data, offsets, "space")
    runs = joined_hashes(hashes, words)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = whole * BASE + h
            out.append(mix64(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """16-bit minima under VALUES hash functions."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 1024):
            part = shingles[i : i + 1024, None] * _MULTIPLIERS + _ADDENDS
            np.minimum(least, part.min(axis=0), out=least)
        return (mix64(least) >> np.uint64(48)).astype(np.uint16)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """Set size, set hash and signature of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(encoder)
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            sizes, firsts, seconds, signatures = [], [], [], []
            for i, j in steps(offsets):
                for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words):
                    sizes.append(len(s))
                    with np.errstate(over="ignore"):
                        firsts.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
                        seconds.append(int(np.bitwise_xor.reduce(mix64(s + np.uint64(len(s)))).view(np.int64)) if len(s) else 0)
                    signatures.append(signature(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return docs.mapInArrow(run, SIGNED)


def _packed(values: np.ndarray) -> np.ndarray:
    """Four 16-bit columns as one 64-bit number, the first on top."""
    v = values.astype(np.uint64)
    return (v[:, 0] << np.uint64(48) | v[:, 1] << np.uint64(32) | v[:, 2] << np.uint64(16) | v[:, 3]).view(np.int64)


def forest(classes: DataFrame) -> DataFrame:
    """One row per tree and class: its first four values, the next four, size and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = np.frombuffer(b"".join(column(batch, "signature").to_pylist()), np.uint16).reshape(n, VALUES)
            bits = np.packbits((values & 1).astype(np.uint8), axis=1).view(np.int64).reshape(n, 2)
            doc, size = (column(batch, c).to_numpy() for c in ("doc_id", "n_shingles"))
            for lo in range(0, n, 2048):
                v, k = values[lo : lo + 2048], min(2048, n - lo)
                use = TREES * MIN_DEPTH
                near = np.concatenate([_packed(v[:, t * 4 : t * 4 + 4]) for t in range(TREES)])
                deep = np.concatenate([_packed(v[:, [(t * 4 + 4 + i) % use for i in range(4)]]) for t in range(TREES)])
                own = [np.tile(x[lo : lo + k], TREES) for x in (doc, size, bits[:, 0], bits[:, 1])]
                tree = np.repeat(np.arange(TREES, dtype=np.int32), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tree, near, deep, *own)], ["tree", "near", "deep", "doc", "size", "sketch_a", "sketch_b"])

    return classes.select("doc_id", "n_shingles", "signature").mapInArrow(run, FOREST)


def _alike(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches let the pairs reach the similarity; never true for a row and itself."""
    size = rows["size"]
    fit = (100 * np.minimum(size[i], size[j]) >= 80 * np.maximum(size[i], size[j])) & (rows["doc"][i] != rows["doc"][j])
    # as unsigned: of a negative number the bits of its size would be counted
    a, b = (rows[c].view(np.uint64) for c in ("sketch_a", "sketch_b"))
    apart = np.bitwise_count(a[i] ^ a[j]).astype(int) + np.bitwise_count(b[i] ^ b[j])
    return fit & (apart <= SKETCH_BITS)


def _same(*columns: np.ndarray) -> np.ndarray:
    """Whether each row but the first equals the one before it."""
    out = np.ones(len(columns[0]) - 1, bool)
    for c in columns:
        out &= c[1:] == c[:-1]
    return out


def _labels(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run number of each row, and rows of its run."""
    label = np.append(0, np.cumsum(~same))
    return label, np.bincount(label)[label]


def region_links(rows: dict[str, np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, smaller doc, larger doc) candidates of sorted rows: kind 0 to a region's smallest document, 1 others."""
    if len(rows["doc"]) < 2:
        return []
    same = _same(rows["tree"], rows["near"])
    keep = np.append(same, False) | np.append(False, same)
    rows = {k: v[keep] for k, v in rows.items()}
    if not len(rows["doc"]):
        return []
    same = _same(rows["tree"], rows["near"])
    region, size = _labels(same)
    begins = np.flatnonzero(np.append(True, ~same))
    found = []

    def add(kind: int, i: np.ndarray, j: np.ndarray) -> None:
        good = _alike(rows, i, j)
        a, b = rows["doc"][i[good]], rows["doc"][j[good]]
        found.append((kind, np.minimum(a, b), np.maximum(a, b)))

    order = np.lexsort((rows["doc"], region))
    add(0, order[begins][region], np.arange(len(region)))
    label, left = region.copy(), size > REGION
    for depth in range(MIN_DEPTH + 1, MAX_DEPTH + 1):
        if not left.any():
            break
        shift = np.uint64(16 * (MAX_DEPTH - depth))
        deeper, count = _labels(same & _same(rows["deep"].view(np.uint64) >> shift))
        label = np.where(left, deeper + len(label) * depth, label)
        left = left & (count > REGION)
    for step in range(1, REGION):
        i = np.flatnonzero(((label[step:] == label[:-step]) & ~left[step:]) | ((region[step:] == region[:-step]) & (step <= 2)))
        if len(i):
            add(1, i, i + step)
    return found


_NAMES = ("tree", "near", "deep", "doc", "size", "sketch_a", "sketch_b")
_LINK_SCHEMA = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), *[(n, pa.int64()) for n in ("near", "deep", "size", "sketch_a", "sketch_b")]])


def _link_rows(batches: Iterator[pa.RecordBatch], ends: bool) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows; with ``ends`` also the outer rows of the first and the last region (kind 2),
    and all rows of these and of dense regions (kind 3)."""

    def links(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for kind, a, b in region_links(rows):
            pairs = np.unique(np.stack([a, b]), axis=1)
            n = pairs.shape[1]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.int64())] * 5], schema=_LINK_SCHEMA)

    def whole(rows: dict[str, np.ndarray], at: np.ndarray, kind: int) -> pa.RecordBatch:
        r = {k: v[at] for k, v in rows.items()}
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(r["doc"]), kind, np.int32)), pa.array(r["doc"]), pa.array(r["doc"]), pa.array(r["tree"]), *[pa.array(r[n]) for n in ("near", "deep", "size", "sketch_a", "sketch_b")]], schema=_LINK_SCHEMA)

    def stub(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = len(rows["doc"])
        yield whole(rows, np.unique(np.concatenate([np.arange(min(n, REGION)), np.arange(max(0, n - REGION), n), [rows["doc"].argmin()]])), 2)
        yield whole(rows, np.arange(n), 3)

    def dense(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        many = np.flatnonzero(_labels(_same(rows["tree"], rows["near"]))[1] > REGION)
        if len(many):
            yield whole(rows, many, 3)

    held: dict[str, np.ndarray] | None = None
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        new = {n: column(batch, n).to_numpy() for n in _NAMES}
        held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in _NAMES}
        begin = np.flatnonzero(np.append(True, ~_same(held["tree"], held["near"])))
        last = begin[-1]
        if last:
            done = {n: v[:last] for n, v in held.items()}
            if first and ends:
                yield from stub({n: v[: begin[1]] for n, v in held.items()})
            if ends:
                yield from dense({n: v[begin[1] if first else 0 :] for n, v in done.items()})
            first = False
            yield from links(done)
            held = {n: v[last:] for n, v in held.items()}
    if held is not None:
        if ends:
            yield from stub(held)
        yield from links(held)


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a < b with ``first`` true for each b's pair with its smallest region head; and the rows of dense regions."""
    keys = ["tree", "near", "deep", "doc"]
    rows = forest(classes).repartitionByRange(*keys).sortWithinPartitions(*keys)
    found = stored(rows.mapInArrow(lambda it: _link_rows(it, True), LINKS), "forest-links")
    ends = found.where("kind = 2").select("tree", "near", "deep", F.col("a").alias("doc"), "size", "sketch_a", "sketch_b")
    across = ends.repartition("tree", "near").sortWithinPartitions(*keys).mapInArrow(lambda it: _link_rows(it, False), LINKS)
    pairs = found.where("kind < 2").unionAll(across).groupBy("a", "b").agg(F.min("kind").alias("kind"))
    pairs = stored(pairs, "candidates")
    heads = pairs.where("kind = 0").groupBy("b").agg(F.min("a").alias("head"))
    first = ((F.col("kind") == 0) & (F.col("a") == F.col("head"))).alias("first")
    dense = found.where("kind = 3").select("tree", "near", F.col("a").alias("doc"), "size", "sketch_a", "sketch_b")
    return stored(pairs.join(heads, "b", "left").select("a", "b", first), "candidate-pairs"), dense


def _rooted(rows: DataFrame, labels: DataFrame, doc: str = "doc", root: str = "root") -> DataFrame:
    """The rows with the component of one of their documents."""
    own = labels.select(F.col("node").alias("stagewise_node"), F.col("root").alias(root))
    return rows.join(own, F.col(doc) == F.col("stagewise_node"), "left").drop("stagewise_node").withColumn(root, F.coalesce(root, doc))


def hub_members(regions: DataFrame, labels: DataFrame, merged: bool) -> tuple[DataFrame, DataFrame]:
    """a, b: the members b of all regions (tree, near, doc) that hold more than one component, by group a; and
    a, top, doc, hub: each group's largest component and its references; hubs are those of that component.

    A group is a region, or with ``merged`` all regions of one largest component. References
    are members that stand in the most and largest regions, which are those most like the
    others; of the component, where it has any in a part of the group.
    """
    rows = _rooted(regions.select("tree", "near", "doc"), labels)
    counts = rows.groupBy("tree", "near", "root").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("tree", "near").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("size"), F.count("*").alias("roots")).where("roots > 1")
    rows = rows.join(mixed.select("tree", "near", "size", F.col("most.root").alias("top")), ["tree", "near"])
    rows = stored(rows.withColumn("a", F.col("top") if merged else F.xxhash64("tree", "near")), "mixed-regions")
    standing = rows.groupBy("a", "top", "doc").agg(F.sum("size").alias("weight"), F.max(F.col("root") == F.col("top")).alias("hub"))
    # the heaviest of each of HUBS parts: sums and maxima only, so a component of any size is no group in one task
    part = F.pmod(F.xxhash64("doc"), F.lit(HUBS)).alias("part")
    hubs = stored(standing.groupBy("a", "top", part).agg(F.max(F.struct("hub", "weight", "doc")).alias("best")).select("a", "top", "best.doc", "best.hub"), "hubs")
    members = stored(rows.select("a", F.col("doc").alias("b")).distinct().join(hubs.select("a", F.col("doc").alias("b")), ["a", "b"], "left_anti"), "hub-pairs")
    discard(rows)
    return members, hubs


MET = "main long, doc long, hub long, n long, common long, entries array<long>, asked array<long>"


def middle(hubs: list[np.ndarray]) -> np.ndarray:
    """The shingles of most sets; of the first set where there are fewer than three."""
    if len(hubs) < 3:
        return hubs[0]
    values, n = np.unique(np.concatenate(hubs), return_counts=True)
    return values[2 * n > len(hubs)]


def rarest(shingles: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """In the order of how many references have them, then of hashes: the same order in every task."""
    if not len(shingles) or not len(known):
        return shingles
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    return shingles[np.argsort(np.where(known[at] == shingles, counts[at], 0), kind="stable")]


def index_entries(s: np.ndarray, hubs: list[np.ndarray], mid: np.ndarray, known: np.ndarray, counts: np.ndarray, percent: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """The first hub that a set is linked with (-1: none), what it shares with the middle, and its entries there.

    ``entries`` are those by which it is found: even ones outside the middle, odd ones
    missing, 1 for misses too few to have any. ``asked`` are those by which it looks for others.
    """
    rest, missing = np.setdiff1d(s, mid, assume_unique=True), np.setdiff1d(mid, s, assume_unique=True)
    common = len(s) - len(rest)
    shared = [len(s) - len(np.setdiff1d(s, h, assume_unique=True)) for h in hubs]
    link = next((k for k, h in enumerate(hubs) if 100 * shared[k] >= percent * (len(s) + len(h) - shared[k])), -1)
    need = max(1, -(-percent * len(s) // 100) - common)
    rest = (rarest(rest, known, counts)[: max(0, len(rest) - need + 1)] & ~np.uint64(1)).view(np.int64)
    missing = (missing | np.uint64(1)).view(np.int64)
    # in units of 1 / (100 + percent)
    bound = min(percent * (len(h) - len(s)) + (100 + percent) * len(np.setdiff1d(mid, h, assume_unique=True)) for h in hubs)
    few = -(-bound // (100 + percent)) if bound > 0 else 0
    entries = [rest, missing[:few], ONE if len(missing) < few else ONE[:0]]
    close = (100 + percent) * common >= percent * (len(s) + len(mid))
    asked = [rest, missing if 100 * common >= percent * len(s) else missing[:0], ONE if close else ONE[:0]]
    return link, common, np.concatenate(entries), np.concatenate(asked) if link < 0 else ONE[:0]


def against_hubs(docs: DataFrame, members: DataFrame, hubs: DataFrame, words: int, percent: int) -> DataFrame:
    """Every member against its hubs: ``index_entries`` of each of its texts."""
    rows = _met(docs, members, hubs)
    schema = pa.schema([(n, pa.int64()) for n in ("main", "doc", "hub", "n", "common")] + [(n, pa.list_(pa.int64())) for n in ("entries", "asked")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for found in _stars(batches, words):
            out = []
            for main, doc, s, heads in found:
                if here is not heads:
                    # the same order in every task; a reference of several texts counts by one of them
                    here = heads
                    one = {(i, side): t for (i, side), t in sorted(heads, key=lambda x: (len(x[1]), x[1].tobytes()))}
                    ids = sorted(i for i, side in one if side == HUB_SIDE)
                    sets = [one[i, HUB_SIDE] for i in ids]
                    every = [one[k] for k in sorted(one)]
                    known, counts = np.unique(np.concatenate(every), return_counts=True)
                    mid = middle(every)
                link, common, entries, asked = index_entries(s, sets, mid, known, counts, percent)
                out.append((main, doc, ids[link] if link >= 0 else None, len(s), common, entries, asked))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, MET)


def open_pairs(met: DataFrame, hubs: DataFrame, labels: DataFrame, percent: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """Candidates a < b of different components that meet in an index, and (tree, near, doc) of its long lists.

    One of a pair is linked with no hub. With ``last`` long lists are paired too.
    """
    linked = F.col("hub").isNotNull()
    tops = hubs.select(F.col("a").alias("main"), "top").distinct()
    rows = _rooted(met, labels).join(tops, "main").withColumn("root", F.when(linked, F.col("top")).otherwise(F.col("root")))
    own = ["main", "doc", "root", "n", "common"]
    give = rows.select(*own, F.lit(False).alias("asks"), F.explode("entries").alias("entry"))
    ask = rows.where(~linked & (F.col("root") != F.col("top"))).select(*own, F.lit(True).alias("asks"), F.explode("asked").alias("entry"))
    entries = stored(give.unionAll(ask), "index-entries")
    lists = entries.groupBy("main", "entry").agg(F.count(F.when(F.col("asks"), 1)).alias("asking"), F.count(F.when(~F.col("asks"), 1)).alias("giving"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    lists = stored(lists.where("asking > 0 and giving > 0 and lo < hi").select("main", "entry", (F.col("asking") * F.col("giving") > LISTED).alias("long")), "index-lists")
    kept = entries.join(lists, ["main", "entry"])
    short = kept if last else kept.where("not long")
    y = short.where("not asks").select("main", "entry", *[F.col(c).alias(f"{c}_") for c in ("doc", "root", "n", "common")])
    shared = F.least("common", "common_") + F.when(F.col("entry") % 2 == 0, F.least(F.col("n") - F.col("common"), F.col("n_") - F.col("common_"))).otherwise(0)
    enough = (F.col("root") != F.col("root_")) & ((100 + percent) * shared >= percent * (F.col("n") + F.col("n_")))
    pairs = short.where("asks").join(y, ["main", "entry"]).where(enough).select(F.least("doc", "doc_").alias("a"), F.greatest("doc", "doc_").alias("b"))
    if last or lists.where("long").isEmpty():
        return pairs, lists.where("false")
    long = stored(kept.where("long").select(F.col("main").alias("tree"), F.col("entry").alias("near"), "doc").distinct(), "long-lists")
    # lists of the same documents are one region
    same = long.groupBy("tree", "near").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("docs"))
    return pairs, long.join(same.groupBy("tree", "n", "docs").agg(F.min("near").alias("near")).select("tree", "near"), ["tree", "near"], "left_semi")


def _wanted(pairs: DataFrame) -> np.ndarray:
    """Bit set of the hashed ids of all documents in pairs, gathered as 64-bit words: 2^20 rows at most."""
    bit = F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))
    ids = pairs.select(F.col("a").alias("doc")).unionAll(pairs.select(F.col("b").alias("doc")))
    words = ids.withColumn("bit", bit).select(F.shiftrightunsigned("bit", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("bits"))
    got = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc and text of the documents in pairs (and of few others whose bits are theirs)."""
    shared = docs.sparkSession.sparkContext.broadcast(_wanted(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = column(batch, "bit").to_numpy()
            there = shared.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)
            yield batch.select(["doc", "text"]).filter(pa.array(there.astype(bool)))

    named = docs.where("doc_id is not null").select(F.col("doc_id").alias("doc"), "text")
    return named.withColumn("bit", F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))).mapInArrow(run, "doc long, text string")


def _met(docs: DataFrame, pairs: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """a, doc, part, side, text: each b sent to the tasks of its a, with the heads (a, doc, hub) of that: a itself, if not given.

    An a with many pairs has a task, and a copy of its heads, per STAR of them.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    members = pairs.join(counts, "a").select(F.col("b").alias("doc"), "a", part, F.lit(MEMBER_SIDE).alias("side"))
    own = counts.select("*", F.col("a").alias("doc"), F.lit(True).alias("hub")) if heads is None else counts.join(heads.select("a", "doc", "hub"), "a")
    own = own.select("doc", "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.when(F.col("hub"), HUB_SIDE).otherwise(OTHER_SIDE).alias("side"))
    named = pairs.select("a", "b") if heads is None else pairs.select(F.col("b").alias("a"), "b").unionAll(heads.select(F.col("doc").alias("a"), F.col("doc").alias("b")))
    # always a merge join: what is moved follows the input alike at every size
    return members.unionAll(own).hint("merge").join(_texts_of(docs, named), "doc").repartition("a", "part").sortWithinPartitions("a", "part", "side")


def _stars(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[list[tuple[int, int, np.ndarray, list[tuple[tuple[int, int], np.ndarray]]]]]:
    """(a, b, set of b, heads with their sides and sets) of the rows of ``_met``, in lists of bounded text."""
    here, heads = None, []
    for batch in batches:
        data, offsets = utf8(column(batch, "text"))
        a, b, part, side = (column(batch, c).to_pylist() for c in ("a", "doc", "part", "side"))
        for i, j in steps(offsets):
            out = []
            for k, s in enumerate(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words), i):
                if here != (a[k], part[k]):
                    here, heads = (a[k], part[k]), []
                if side[k] != MEMBER_SIDE:
                    heads.append(((b[k], side[k]), s))
                else:
                    out.append((a[k], b[k], s, heads))
            yield out


def similar(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""

    def alike(s: np.ndarray, h: np.ndarray) -> bool:
        common = len(s) + len(h) - len(np.union1d(s, h))
        return common > 0 and 100 * common >= percent * (len(s) + len(h) - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _stars(batches, words):
            out = [(a, b) for a, b, s, heads in found if any(alike(s, h) for _, h in heads)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return _met(docs, pairs).mapInArrow(run, "a long, b long")


def _roots(parent: DataFrame) -> DataFrame:
    """Follow node -> root until every root is one that follows none: two steps are looked ahead at a time."""
    while True:
        one = parent.select(F.col("node").alias("via_1"), F.col("root").alias("above_1"))
        two = parent.select(F.col("node").alias("via_2"), F.col("root").alias("above_2"))
        far = parent.join(one, F.col("root") == F.col("via_1"), "left").join(two, F.col("above_1") == F.col("via_2"), "left")
        parent = stored(far.select("node", F.coalesce("above_2", "above_1", "root").alias("root"), F.col("above_2").isNotNull().alias("moved")), "roots")
        if parent.where("moved").isEmpty():
            return parent.select("node", "root")
        parent = parent.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node that isn't its own root.

    Each round hooks every node to its smallest neighbour below it, follows the hooks to
    their roots and keeps the edges between different roots.
    """
    edges = stored(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), "edges")
    labels = None
    while True:
        parent = _roots(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")))
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("node").alias("via"), F.col("root").alias("above"))
            labels = stored(labels.join(up, labels.root == up.via, "left").select("node", F.coalesce("above", "root").alias("root")).unionAll(parent), "labels")
        edges = _relabelled(edges, parent, "lo", "hi")
        if edges.isEmpty():
            return labels


def _relabelled(edges: DataFrame, labels: DataFrame, lo: str, hi: str) -> DataFrame:
    for c in (lo, hi):
        own = labels.select(F.col("node").alias("via"), F.col("root").alias("above"))
        edges = edges.join(own, F.col(c) == F.col("via"), "left").withColumn(c, F.coalesce("above", c)).drop("via", "above")
    edges = edges.select(F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi")).where("lo < hi").distinct()
    return stored(edges, "edges")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components with more links."""
    new = _rooted(_rooted(links, labels, "a", "root_a"), labels, "b", "root_b").where("root_a <> root_b")
    new = stored(new.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "new-links")
    if new.isEmpty():
        return labels
    # components of components, then their members follow
    above = components(new)
    moved = labels.join(above.select(F.col("node").alias("via"), F.col("root").alias("up")), F.col("root") == F.col("via"), "left")
    return stored(moved.select("node", F.coalesce("up", "root").alias("root")).unionAll(above.join(labels.select("node"), "node", "left_anti").select("node", "root")), "labels")


def near_duplicates(df: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id) and kept of every row."""
    docs = documents_of(df)
    rows = stored(signed(docs, words), "signatures")
    named = rows.where("n_shingles > 0 and doc_id is not null")
    heads = stored(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("head")), "classes")
    classes = named.join(heads.select(F.col("head").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
    pairs, dense = candidates(classes)
    first = stored(similar(docs, pairs.where("first"), words, percent), "links")
    # rows of one doc_id with different sets are one node already: their classes are linked
    shared = named.join(heads, ["set_a", "set_b"]).where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    labels = components(first.unionAll(shared))
    rest, regions = pairs.where("not first").select("a", "b"), dense
    for round_ in range(HUB_ROUNDS):
        members, hubs = hub_members(regions, labels, round_ == 0)
        met = stored(against_hubs(docs, members, hubs, words, percent), "hub-members")
        found, regions = open_pairs(met, hubs, labels, percent, round_ == HUB_ROUNDS - 1)
        if round_ == 0:
            apart = _rooted(_rooted(rest, labels, "a", "root_a"), labels, "b", "root_b").where("root_a <> root_b")
            found = found.unionAll(apart.select("a", "b"))
        found = stored(found.distinct(), "open-pairs")
        links = met.where("hub is not null").select(F.col("hub").alias("a"), F.col("doc").alias("b"))
        labels = _merged(labels, stored(similar(docs, found, words, percent).unionAll(links), "links"))
        if regions.isEmpty():
            break
    discard(pairs, dense, heads)
    own = labels.select(F.col("node").alias("doc_id"), F.col("root"))
    out = rows.select("doc_id", "n_shingles").join(own, "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows, unchanged, of each component's smallest doc_id (all its rows, and those with null doc_id)."""
    gone = near_duplicates(df, words, percent).where("not kept").select(F.col("doc_id").alias("stagewise_doc")).distinct()
    return df.join(gone, F.col("doc_id").cast("long") == F.col("stagewise_doc"), "left_anti")
