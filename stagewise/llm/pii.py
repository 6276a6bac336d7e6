"""Information-theoretic sanitisation of personal data.

Protected entities are the values that the base patterns find (e-mail, ip, card, phone).
Over the whole corpus it is counted in how many documents each term stands within a few
words of each entity, D(t, e), how many different texts these have, s(t, e), and in how
many documents it stands anywhere, D(t). A reader who meets t knows e with the probability
p(e|t) = D(t, e) / D(t) * s / (s + 1), where the last factor trusts no single text; so
-log2 p(e|t) bits stay hidden of the entity's own information IC(e) = -log2 p(e), where
p(e) is the number of documents with e set against all words of the corpus, and the term
discloses the share 1 + log2 p(e|t) / IC(e) of it, which is PMI(t; e) / IC(e).

A term reveals an entity if it is seen with it in ``support`` texts, leaves ``MOST_HIDDEN``
bits or fewer hidden and discloses ``threshold`` or more. Two kinds do: terms that stand
nowhere but by the entity, like the name of its owner, and terms that stand by it in most
of several texts. A word that is spread over the corpus, or stands once by the entity and
once elsewhere, does not. Revealing terms are spans of kind "term" wherever they stand,
near an entity or not, and are generalised or removed. The second pass finds them in
whole texts: in a document with entities among the words around these, which are all
places of the first kind, and elsewhere by a filter of fixed size for the second kind;
then by an exact join. Words within base spans are not terms.

Base patterns match leftmost and without overlap per kind; a match that fails its check
(ip parts, Luhn, digit counts) is dropped and not retried. Positions count code points.

Defined results: null text is empty and has no spans; identical rows get identical
spans; null doc_id stays null; an empty table gives no rows; other columns are ignored
(``sanitise`` carries them through, and sets n_chars, where there is one, of rows whose
text it changes).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import column, documents_of, ship, steps, stored, utf8, word_hashes

KINDS = ("email", "ip", "card", "phone")
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
THRESHOLD, SUPPORT, MOST_HIDDEN, CONTEXT_WORDS, CONTEXT_CHARS = 0.75, 1, 1.0, 8, 160
#: Bits of the filter that lets the counting pass skip terms near no entity: a fixed size.
FILTER_BITS = 20
#: Bits of the filter of revealing terms, and rows of each in their join: frequent terms are dealt to as many tasks.
TERM_BITS, DEALT = 22, 16

# Fixed patterns. Possessive parts and the look-behinds only spare retries that can't match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            begin = at
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                yield begin, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind as listed and then by start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGIT.findall(m[0])) if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _entity(kind: str, value: str) -> int:
    return _hash64(f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(_DIGIT.findall(value))}")


def contexts(text: str, spans: list[Span]) -> list[tuple[int, int, int]]:
    """(entity, term hash, text hash) of the words around each base span on its line, each entity and term once."""
    found: set[tuple[int, int]] = set()
    for kind, begin, end in spans:
        left = max(text.rfind("\n", 0, begin) + 1, begin - CONTEXT_CHARS)
        stop = text.find("\n", end)
        right = min(stop if stop >= 0 else len(text), end + CONTEXT_CHARS)
        words = [m.span() for m in _WORD.finditer(text, left, begin)][-CONTEXT_WORDS:]
        words += [m.span() for m in _WORD.finditer(text, end, right)][:CONTEXT_WORDS]
        words = [(a, b) for a, b in words if b - a >= 3 and not any(x < b and a < y for _, x, y in spans)]
        words = [(a, b) for a, b in words if not (a == left and a and _WORD.match(text[a - 1])) and not (b == right and b < len(text) and _WORD.match(text[b]))]
        if not words:
            continue
        terms = [text[a:b] for a, b in words]
        raw = " ".join(terms).encode("utf-8", "surrogatepass")
        hashes = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), "alnum")[0].view(np.int64).tolist()
        entity = _entity(kind, text[begin:end])
        found.update((entity, h) for h in hashes)
    whole = _hash64(text) if found else 0
    return [(*k, whole) for k in sorted(found)]


def _key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("key_a"), F.xxhash64("text", "doc_id", F.lit(7)).alias("key_b")]


_SCAN = pa.schema(
    [("key_a", pa.int64()), ("key_b", pa.int64()), ("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("base", pa.string()), ("near", pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64())])))]
)
_SCAN_DDL = "key_a long, key_b long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, near array<struct<entity:long,term:long,context:long>>"


def scan(df: DataFrame) -> DataFrame:
    """Base spans of every row, and the terms around them."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in column(batch, "text"):
                text = text.as_py() or ""
                spans = base_spans(text)
                base = span_text(spans)
                near = [dict(zip(("entity", "term", "context"), x, strict=True)) for x in contexts(text, spans)] if spans else []
                rows.append((*[sum(k == s[0] for s in spans) for k in KINDS], hashlib.sha256(base.encode()).hexdigest(), base, near))
            if rows:
                yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("key_a", "key_b", "doc_id")] + [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_SCAN)[3:], strict=True)], schema=_SCAN)

    return documents_of(df).select(*_key(), "doc_id", "text").mapInArrow(run, _SCAN_DDL)


def _filter(terms: DataFrame, width: int) -> np.ndarray:
    """Which values of the last ``width`` bits the terms have."""
    bits = np.zeros(1 << width, bool)
    bits[terms.select(F.pmod("term", F.lit(1 << width)).alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)] = True
    return bits


def _occurrences(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """In how many documents each term that the filter lets through stands, and (term null) all words."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = 0
        schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            for i, j in steps(offsets):
                own, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "alnum")
                words += len(own)
                hits = np.flatnonzero(shared.value[own & np.uint64((1 << FILTER_BITS) - 1)])
                doc, term = np.searchsorted(at, hits, "right"), own[hits]
                order = np.lexsort((doc, term))
                doc, term = doc[order], term[order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1]))[: len(doc)]
                found, n = np.unique(term[new], return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([words], pa.int64())], schema=schema)

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosures(df: DataFrame, scanned: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(entity, term, hidden, disclosure, only) of the terms that reveal an entity; ``only``: they stand nowhere else."""
    near = scanned.where(F.size("near") > 0).select(F.explode("near").alias("x")).select("x.*")
    by_text = near.groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = by_text.groupBy("entity", "term").agg(F.sum("n").alias("n_pair"), F.count("*").alias("n_contexts")).where(F.col("n_contexts") >= support)
    pairs = stored(pairs, "term-entity")
    counts = stored(_occurrences(documents_of(df), _filter(pairs, FILTER_BITS)), "term-counts")
    total = counts.where("term is null").agg(F.sum("n_term")).first()[0] or 1
    p_given = F.least(F.lit(1.0), F.col("n_pair") / F.col("n_term")) * F.col("n_contexts") / (F.col("n_contexts") + 1)
    close = pairs.join(counts, "term").withColumn("hidden", -F.log2(p_given)).where(F.col("hidden") <= MOST_HIDDEN)
    windows = scanned.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    ic = -F.log2(F.least(F.col("n_entity") / F.lit(float(total)), F.lit(0.5)))
    scored = close.join(windows, "entity").select("entity", "term", "hidden", (1 - F.col("hidden") / ic).alias("disclosure"), (F.col("n_pair") >= F.col("n_term")).alias("only"))
    return stored(scored.where(F.col("disclosure") >= threshold), "disclosures")


def _places(df: DataFrame, bits: np.ndarray) -> DataFrame:
    """key_a, key_b, term, a, b of all words outside base spans that the filter lets through, or that stand around one of them."""
    shared = df.sparkSession.sparkContext.broadcast(bits)
    names = ("key_a", "key_b", "term", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, key_a, key_b = (column(batch, c) for c in ("text", "key_a", "key_b"))
            data, offsets = utf8(texts)
            for i, j in steps(offsets):
                own, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "alnum")
                passed = shared.value[own & np.uint64((1 << TERM_BITS) - 1)]
                found: dict[int, list[Span]] = {}
                for d in range(j - i):
                    if spans_ := base_spans(texts[i + d].as_py() or ""):
                        found[d] = spans_
                        around = [h for _, h, _ in contexts(texts[i + d].as_py(), spans_)]
                        mine = slice(int(at[d]), int(at[d + 1]))
                        passed[mine] |= np.isin(own[mine], np.array(around, np.int64).view(np.uint64))
                hits = np.flatnonzero(passed)
                cuts = np.searchsorted(hits, at)
                rows = []
                for d in np.flatnonzero(np.diff(cuts)).tolist():
                    text = texts[i + d].as_py()
                    spans = sorted((x, y) for _, x, y in found.get(d, ()))
                    begins, ends = [x for x, _ in spans], list(accumulate((y for _, y in spans), max))
                    words = [m.span() for m in _WORD.finditer(text)]
                    keys = key_a[i + d].as_py(), key_b[i + d].as_py()
                    for h in hits[cuts[d] : cuts[d + 1]].tolist():
                        x, y = words[h - int(at[d])]
                        before = bisect_left(begins, y)
                        if y - x >= 3 and not (before and ends[before - 1] > x):
                            rows.append((*keys, int(own[h].view(np.int64)), x, y))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.int32()] * 2, strict=True)], names)

    return documents_of(df).select(*_key(), "text").mapInArrow(run, "key_a long, key_b long, term long, a int, b int")


def term_spans(df: DataFrame, revealing: DataFrame) -> DataFrame:
    """key_a, key_b, terms: the ordered spans of revealing terms, wherever they stand."""
    terms = stored(revealing.groupBy("term").agg(F.max("only").alias("only")), "revealing-terms")
    dealt = terms.select("term", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("deal"))
    places = _places(df, _filter(terms.where("not only"), TERM_BITS)).withColumn("deal", F.pmod("key_a", F.lit(DEALT)).cast("int"))
    hit = places.join(dealt, ["term", "deal"]).select("key_a", "key_b", F.struct("a", "b").alias("span"))
    return hit.groupBy("key_a", "key_b").agg(F.array_sort(F.collect_set("span")).alias("terms"))


def find_personal_data(df: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """Counts and spans per row: the base kinds, then terms that disclose an entity."""
    scanned = stored(scan(df), "pii-scan")
    spans = term_spans(df, disclosures(df, scanned, threshold, support))
    terms = F.transform("terms", lambda s: F.concat(F.lit("term:"), s["a"].cast("string"), F.lit(":"), s["b"].cast("string")))
    joined = scanned.drop("near").join(spans, ["key_a", "key_b"], "left")
    every = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.concat_ws(",", terms))
    every = F.when(F.col("terms").isNull(), F.col("base")).otherwise(every)
    return joined.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", every.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))


def generalised(term: str) -> str:
    """What stands for a revealing term: a class where it has one, else nothing."""
    return "<NUMBER>" if _DIGIT.search(term) else "<NAME>" if term[:1].isupper() else ""


def rewritten(text: str, terms: list[tuple[int, int]]) -> str:
    """The text with its base spans replaced by labels and the given terms generalised; overlaps give one label."""
    spans = sorted([(a, b, LABELS[k]) for k, a, b in base_spans(text)] + [(a, b, generalised(text[a:b])) for a, b in terms], key=lambda s: (s[0], -s[1]))
    out, done = [], 0
    for a, b, label in spans:
        if a >= done:
            out += [text[done:a], label]
        done = max(done, b)
    return "".join([*out, text[done:]])


def sanitise(df: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """All rows and columns, with personal data and revealing terms taken out of ``text``."""
    scanned = stored(scan(df), "pii-scan")
    spans = stored(term_spans(df, disclosures(df, scanned, threshold, support)), "term-spans").select(F.col("key_a").alias("stagewise_a"), F.col("key_b").alias("stagewise_b"), F.col("terms").alias("stagewise_terms"))
    a, b = _key()
    keyed = df.join(spans, (F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")) == F.col("stagewise_a")) & (F.xxhash64(F.col("text").cast("string"), F.col("doc_id").cast("long"), F.lit(7)) == F.col("stagewise_b")), "left").drop("stagewise_a", "stagewise_b")
    at, names = df.columns.index("text"), df.columns
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            terms = batch.column(len(names)).to_pylist()
            new = [None if t is None else rewritten(t, [(x["a"], x["b"]) for x in s or ()]) for t, s in zip(old, terms, strict=True)]
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if count is not None:
                was = columns[count].to_pylist()
                columns[count] = pa.array([n if x == y else len(y) for n, x, y in zip(was, old, new, strict=True)], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return keyed.mapInArrow(run, df.schema)
