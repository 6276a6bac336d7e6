"""Phrase growth, tokenizer alignment and first-fit packing against brute force; edge cases of each."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from stagewise.llm import alignment, ffd_packing, phrases, queries
from stagewise.llm.tokens import default_vocabulary
from stagewise.llm.word_tokens import encode_words, word_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n string, f string, h1 string, ids string, slot string"


def _texts():
    r = random.Random(7)
    words = ["the", "of", "River", "stone", "a", "é", "Ünder", "9", "x_y", "中文"]
    ends = [" ", " ", " ", "  ", ". ", ", ", "\n", "\t", "; "]
    out = [(i, "".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(1, 50))), r.choice(["en", "fr", None])) for i in range(80)]
    out += [(80, None, None), (81, "", "en"), (82, " ", "en"), (83, " .,\n\t ", None), (84, "the of the of the of " * 60, "en"), (85, "no-spaces" * 700, "fr")]
    out += [(86, "a <|endoftext|> b<|startoftext|>", "en"), (87, "a▁b", "en"), (88, "İstanbul ΣΑΣ é ﬁ", "en"), (89, "\x00 \x1c 　 \xa0x\x85 y", "fr"), (90, "  two  spaces ", "en"), (91, "word " * 4000, "fr")]
    return out


@pytest.fixture(scope="module")
def rows():
    own = _texts()
    return [*own, own[3], own[3], (None, "of nobody the of", "en")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", "n", "f", "h", "i", "t") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _plain_phrases(rows, least, most):
    total, found = Counter(), Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang or "und"] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    found[lang or "und", tuple(words[i : i + size])] += 1
    found = {k: f for k, f in found.items() if f >= least}
    out = {}
    for (lang, p), a in found.items():
        if len(p) < 2 or any(g == lang and len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), f in found.items()):
            continue
        n = total[lang]
        score, k = min((1000 * a * n // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), found[lang, p[:k]], found[lang, p[k:]], n))
    return {(lang, rank, p.decode(), -a, x, y, n, -s) for lang, own in out.items() for rank, (s, a, p, x, y, n) in enumerate(sorted(own)[:most], 1)}


@pytest.mark.parametrize(("least", "most", "task_rows"), [(2, 2000, 20_000), (3, 7, 4), (2, 2000, 0)])
def test_phrases_equal_brute_force(docs, rows, least, most, task_rows):
    got = phrases.mine_phrases(docs, least, most, task_rows).collect()
    assert got[0].__fields__ == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got} == _plain_phrases(rows, least, most)
    assert len(got) == len({tuple(r) for r in got})


def test_phrases_of_nothing(spark, empty):
    assert phrases.mine_phrases(empty).collect() == []
    one = spark.createDataFrame([(1, "single", None), (2, "", "en"), (3, None, "en"), (4, "a.b.c", "en")], "doc_id long, text string, lang string")
    assert phrases.mine_phrases(one, least=1).collect() == []


def test_scores_beyond_64_bits(spark):
    import pyspark.sql.functions as F

    row = spark.range(1).select(F.lit(9 * 10**12).alias("a"), F.lit(9 * 10**14).alias("n"), F.lit(9 * 10**12 + 1).alias("l"), F.lit(9 * 10**13).alias("r"))
    row = row.select(*[phrases._exact(c).alias(f"{c}_x") for c in "anlr"])
    got = row.select(F.expr("cast((cast(1000 as decimal(4,0)) * a_x * n_x) div (l_x * r_x) as long) AS s")).first()[0]
    assert got == 1000 * 9 * 10**12 * 9 * 10**14 // ((9 * 10**12 + 1) * 9 * 10**13)


def test_words_of_phrases():
    data = np.frombuffer(b"Ab c.d", np.uint8)
    words = phrases.Words(data, np.array([0, 5, 6]), np.array([1, 2], np.uint64), 5)
    assert words.joined.tolist() == [True, False, False]
    assert words.spell(np.arange(3)) == ["ab", "c", "d"]
    assert words.document.tolist() == [0, 0, 1]
    again = phrases.Words(np.frombuffer(b"aB c d", np.uint8), np.array([0, 6]), np.array([1], np.uint64), 5)
    assert (again.hash[:2] == words.hash[:2]).all()
    assert again.hash[2] != words.hash[2]  # another language, another id


def test_partial_counts_of_rows_with_one_hash(monkeypatch):
    monkeypatch.setattr(phrases, "mix64", lambda x: x * np.uint64(0))
    a, b = np.array([1, 2, 1, 2, 1], np.int64), np.array([5, 5, 5, 5, 5], np.int64)
    (x, _), n, _ = phrases._distinct([a, b], np.ones(5, np.int64))
    assert Counter({1: 3, 2: 2}) == sum((Counter({int(k): int(c)}) for k, c in zip(x, n, strict=True)), Counter())


def _plain_alignment(rows):
    import sentencepiece

    a = Tokenizer.from_file(default_vocabulary())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.piece_vocabulary())
    from stagewise.llm.tokens import _byte_letters

    letters = {v: k for k, v in _byte_letters().items()}
    links, out = Counter(), []
    for doc_id, text, _ in rows:
        text = text or ""
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append((doc_id, [], [], [], [], ""))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in own]).tolist() for own in (bytes_a, bytes_b))
        both = sorted(set(ends_a) & set(ends_b))
        pairs = [(x, y) for x, e in zip(ids_a, ends_a, strict=True) for y, g in zip(ids_b, ends_b, strict=True) if e == g] if len(ids_a) < 3000 else [(ids_a[ends_a.index(e)], ids_b[ends_b.index(e)]) for e in both]
        links.update(pairs)
        where = [np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)]
        by = [[[] for _ in both] for _ in range(2)]
        for side, ids in enumerate((ids_a, ids_b)):
            for i, g in zip(ids, where[side], strict=True):
                by[side][g].append(str(i))
        groups = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(*by, strict=True))
        out.append((doc_id, ids_a, ids_b, both, pairs, hashlib.sha256(groups.encode()).hexdigest()))
    best = Counter()
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    return [(d, len(x), len(y), len(g), len(p), sum(links[q] == best[q[1]] for q in p), sum(links[q] for q in p), h) for d, x, y, g, p, h in out]


def test_alignment_equals_brute_force(docs, rows, empty):
    got = alignment.align_tokenizers(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(_plain_alignment(rows), key=key)
    assert alignment.align_tokenizers(empty).collect() == []


def test_chunks_align_as_whole_texts():
    r, own = random.Random(3), alignment.Aligner(default_vocabulary(), alignment.piece_vocabulary())
    bits = ["a", "the", "é", "Über", " ", " ", " ", "\n", ".", ",", "'s", "12", "\t", "\xa0", "<|endoftext|>", "ß", "中", "\x1c", "▁"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    want = [(x[1], x[2], x[7]) for x in _plain_alignment([(0, t, None) for t in texts])]
    assert [x[:3] for x in own.texts(texts)] == want
    assert [x[:3] for x in own.texts(texts[::-1])] == want[::-1]  # from the cache


def test_pair_counts_are_sorted_runs(spark, docs):
    encoded = alignment.encode_links(docs).cache()
    plain = Counter()
    for (links,) in encoded.select("links").collect():
        plain.update(array("q", links))
    got = alignment.pair_counts(encoded, shards=3).collect()
    assert {r.pair: r.n for r in got} == plain
    assert len(got) == len(plain)
    for shard in {r.shard for r in got}:
        own = [r.pair for r in got if r.shard == shard]
        assert own == sorted(own)
        assert sum(min(own) <= r.pair <= max(own) for r in got) == len(own)


def test_word_ids_equal_whole_encoding():
    whole, r = Tokenizer.from_file(word_vocabulary()), random.Random(1)
    bits = ["a", "The", "É", "Über", " ", " ", "\n", ".", ",", "'S", "12", "\t", "́", "<|endoftext|>", "ß", "İ", "中", "Σ", "\xa0", "\x85", "\x1c", "\u3000", "\u2000", "\u2028", "\x0b"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert encode_words(word_vocabulary(), text) == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes(), text


def test_tournament_tree_is_first_fit():
    r = random.Random(2)
    for _ in range(60):
        capacity = r.randint(1, 40)
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 50))), reverse=True)
        rooms, want = [], []
        for s in sizes:
            k = next((k for k, room in enumerate(rooms) if room >= s), len(rooms))
            if k == len(rooms):
                rooms.append(capacity)
            rooms[k] -= s
            want.append(k)
        assert ffd_packing.first_fit(np.array(sizes), capacity) == want


@pytest.mark.parametrize(("capacity", "least"), [(64, 1), (64, 5), (50, 1), (1, 1)])
def test_groups_are_packed_without_gaps(capacity, least):
    r = random.Random(capacity + least)
    for n in (0, 1, 2, 7, 60):
        lengths = np.array([r.randint(1, max(1, capacity - 1)) for _ in range(n)], np.int64)
        placed = ffd_packing.pack_group(lengths, capacity, least)
        covered = sorted((i, at) for i, start, size, _, _ in placed for at in range(start, start + size))
        assert covered == [(i, at) for i in range(n) for at in range(lengths[i])]
        fills = Counter()
        for _, _, size, sequence, offset in sorted(placed, key=lambda x: (x[3], x[4])):
            assert size and fills[sequence] == offset
            fills[sequence] += size
        assert all(capacity - f < least or f == 1 << f.bit_length() - 1 for f in fills.values())


@pytest.mark.parametrize("options", [{}, {"capacity": 64, "group_bytes": 3000}, {"capacity": 100, "group_bytes": 1}])
def test_first_fit_packing(docs, rows, empty, options):
    capacity = options.get("capacity", 4096)
    got = ffd_packing.first_fit_pack(docs, **options).toPandas()
    assert list(got) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = {i: encode_words(word_vocabulary(), t or "") + array("I", [2]).tobytes() for i, t, _ in rows}
    times = Counter(i for i, _, _ in rows)
    for doc_id, own in got.groupby("doc_id", dropna=False):
        doc_id = None if doc_id != doc_id else int(doc_id)
        raw = ids[doc_id]
        assert (own.doc_tokens == len(raw) // 4).all()
        covered = Counter(at for s, n in zip(own.start, own.length, strict=True) for at in range(s, s + n))
        assert covered == Counter(dict.fromkeys(range(len(raw) // 4), times[doc_id]))
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)])
    assert {None if x != x else int(x) for x in got.doc_id} == set(ids)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]]
        total = int(own.length.sum())
        assert total == capacity or total == 1 << total.bit_length() - 1 < capacity
    assert ffd_packing.first_fit_pack(empty).count() == 0


def test_small_sequences_are_few(docs):
    got = ffd_packing.first_fit_pack(docs).toPandas()
    fills = got.groupby("sequence_id").length.sum()
    assert (fills < 4096).sum() <= 12


def test_registered():
    assert {"op11_phrase_growth", "op12_tokenizer_alignment", "op13_first_fit_packing"} <= set(queries.queries())


def test_counting_lets_the_encoders_memory_go(spark):
    """Workers are used again: what encoding has cached must not stand beside the counting."""

    class Frame:
        first = None

        def mapInArrow(self, run, ddl):
            self.first = self.first or run
            return self

        def __getattr__(self, name):
            return lambda *a, **b: self

    frame = Frame()
    alignment.pair_counts(frame)
    alignment.aligner(default_vocabulary(), alignment.piece_vocabulary()).texts(["some words"])
    assert list(frame.first(iter([]))) == []
    assert alignment.aligner.cache_info().currsize == 0
