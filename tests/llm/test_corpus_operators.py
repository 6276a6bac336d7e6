"""Corpus operators on small fixtures against brute force and round trips; edge cases of every one."""

import hashlib
import os
import random
import re
import zlib
from array import array
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stagewise.llm import chat, decontaminate, language_id, lm_score, matroska, near_dedup, packing, pii, queries, site_style, token_store
from stagewise.llm.tokens import default_vocabulary, encoder

LOWER = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, component_id string"


def _texts():
    r = random.Random(4)
    words = {"en": ["the", "of", "and", "with", "token", "That", "river", "stone."], "fr": ["le", "élève", "que", "avec", "pierre", "Ça", "rivière", "été."]}
    out = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        out.append((i, " ".join(r.choice(words[lang]) + str(r.randint(0, 9)) * (r.random() < 0.3) for _ in range(r.randint(3, 60))), lang))
    out += [(60, out[5][1], "en"), (61, out[5][1] + " more", "en"), (62, None, None), (63, "", "en"), (64, "12 34 !!", None), (65, "a", "en"), (66, "x " * 3000, "en")]
    out += [(67, "mail bob.x@mail1.example.com or +1 (988) 555-2485 at 10.0.0.1, card 4387513035237269\n\n \n end", "en"), (68, "no spaces" * 400, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, g, "s", len(t or ""), 0.5, "k", "c") for i, t, g in _texts()]
    rows += [rows[3], (None, "orphan text of nobody", "en", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_encoder_equals_whole_encoding():
    whole, r = Tokenizer.from_file(default_vocabulary()), random.Random(1)
    bits = ["a", "the", "é", "Über", " ", " ", "\n", ".", ",", "'s", "12", "\t", " ", "<|endoftext|>", "ß", "中", " "]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert encoder(default_vocabulary()).encode(text) == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()


def test_token_store_round_trip(spark, docs, tmp_path):
    got = sorted(_rows(token_store.token_store(docs, f"file://{tmp_path}/s")), key=lambda r: r["start"])
    encode, at = encoder(default_vocabulary()).encode, 0
    texts = {i: t for i, t, _ in _texts()} | {None: "orphan text of nobody"}
    assert [r["doc_id"] for r in got] == sorted([*texts, 3], key=lambda i: -1 if i is None else i)
    for r in got:
        ids = encode(texts[r["doc_id"]] or "") + b"\0\0\0\0"
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert token_store.read_document(spark, f"file://{tmp_path}/s", 60) == [encode(texts[60]) + b"\0\0\0\0"]
    assert token_store.read_document(spark, f"file://{tmp_path}/s", 999) == []


def test_token_store_of_nothing(empty):
    assert token_store.token_store(empty).count() == 0


def test_packing_is_gapless_and_whole(docs):
    got = packing.best_fit_pack(docs, capacity=64, group_pieces=40).toPandas()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 64
    for _, d in got.dropna().groupby("doc_id"):
        assert (d.sort_values(["piece"]).drop_duplicates("piece")["length"].iloc[1:] == 64).all()
    assert got["doc_id"].isna().sum() >= 1 and (got["doc_id"] == 3).sum() == 2 * len(got[got["doc_id"] == 3]["piece"].unique())


def test_sum_of_squares_is_near_the_bound():
    lengths = np.random.default_rng(2).integers(1, 1500, 3000)
    sequence, _ = packing.sum_of_squares(lengths, 2048)
    assert sequence.max() + 1 <= 1.02 * -(-lengths.sum() // 2048)
    assert packing.cut(1, 2048) == [(0, 1)] and packing.cut(4097, 2048) == [(0, 1), (1, 2048), (2049, 2048)] and packing.cut(2048, 2048) == [(0, 2048)]


def test_sum_of_squares_equals_plain_rule():
    rng = np.random.default_rng(5)
    for _ in range(60):
        capacity = int(rng.integers(5, 40))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 60)))
        bins, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            squares = lambda gaps: sum(m * m for g, m in Counter(gaps).items() if g)
            options = {}
            for b, gap in enumerate(bins):
                if gap >= lengths[i]:
                    after = bins[:b] + [gap - lengths[i]] + bins[b + 1 :]
                    options.setdefault((squares(after), gap), b)
            if options:
                gap = bins[options[min(options)]]
                bins[options[min(options)]] -= lengths[i]
            else:
                gap = capacity
                bins.append(capacity - lengths[i])
            want[i] = capacity - gap
        sequence, offset = packing.sum_of_squares(lengths, capacity)
        assert offset.tolist() == [want[i] for i in range(len(lengths))] and sequence.max() + 1 == len(bins)


def test_pieces_equal_whole_encoding(spark, docs):
    whole = Tokenizer.from_file(default_vocabulary())
    got = packing.best_fit_pack(docs, capacity=64).where("doc_id is not null").toPandas().drop_duplicates(["doc_id", "piece"])
    for i, t, _ in _texts():
        ids = array("I", [*whole.encode(t or "", add_special_tokens=False).ids, 0])
        for row in got[got["doc_id"] == i].itertuples():
            assert row.ids_crc32 == zlib.crc32(ids[row.start : row.start + row.length].tobytes())


def test_packing_of_nothing(empty):
    assert packing.best_fit_pack(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 576, 577, 576 * 64, 576 * 65, 576 * 500 + 1])
def test_matroska_round_trip(n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    payload, feature = matroska.describe(matroska.mux(matroska.padded(raw)))
    assert payload == matroska.padded(raw) and payload[:n] == raw and "status=ok" in feature


@pytest.mark.parametrize("lacing", [1, 3])
def test_uneven_lacing(lacing):
    packets = [bytes([i]) * k for i, k in enumerate((3, 700, 1, 0, 255, 256, 70000, 2))]
    data = matroska._laced(packets, lacing)
    assert [data[a : a + n] for a, n in matroska._frames(data, 0, len(data), lacing)] == packets


def test_damaged_media_keeps_what_came_before():
    file = matroska.mux(bytes(576 * 130))
    whole = matroska.demux(file)
    for at in range(0, len(file), 997):
        media = matroska.demux(file[:at])
        assert media.packets == whole.packets[: len(media.packets)]
    assert matroska.demux(None).status == matroska.demux(b"").status == "empty"


def test_media_features(spark, docs, empty):
    got = {r["doc_id"]: r for r in _rows(matroska.stored_text_media(docs))}
    for i, t, _ in _texts():
        raw = matroska.padded((t or "").encode())
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
    assert got[62] == got[63] | {"doc_id": 62}
    assert matroska.stored_text_media(empty).count() == 0
    media = matroska.text_media(docs.where("doc_id = 66"))
    table = matroska.packet_table(media).toPandas()
    assert len(table) == -(-6000 // 576) and table["time_ns"].tolist() == [72_000_000 * i for i in range(len(table))]


def test_language_id(spark, docs, empty):
    model = language_id.train(docs, language_id.remainder("doc_id", 4) != 2)
    got = {r["doc_id"]: r for r in _rows(language_id.identify(docs, model))}
    assert got[62]["lang_pred"] == got[63]["lang_pred"] == got[64]["lang_pred"] == "und" and got[62]["score"] == 0
    held = [(i, g) for i, _, g in _texts()[:60] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and np.mean([got[i]["lang_pred"] == g for i, g in held]) >= 0.9
    assert all(got[i]["held_out"] for i, _ in held) and got[5]["lang_pred"] == got[60]["lang_pred"]
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and {62, 63, 64}.isdisjoint(r.doc_id for r in kept.collect())
    nothing = language_id.train(empty)
    assert {r["lang_pred"] for r in _rows(language_id.identify(docs, nothing))} == {"und"}
    assert language_id.identify(empty, nothing).count() == 0


def _plain_grams(text):
    mask = 2**64 - 1
    chars = [0, 0, *map(ord, text.lower()), 0, 0]
    for n in language_id.ORDERS:
        for i in range(len(chars) - 2):
            h = n
            for c in chars[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + c) & mask
            h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & mask
            h = ((h ^ h >> 27) * 0x94D049BB133111EB) & mask
            yield (h ^ h >> 31) >> 49


def test_language_scores_equal_plain_bayes(spark, docs):
    rows = [(t, g) for i, t, g in [*_texts(), _texts()[3], (None, "orphan text of nobody", "en")] if t is not None and g and (i is None or zlib.crc32(str(i).encode()) % 4 != 2)]
    counts, docs_of = {g: Counter() for _, g in rows}, Counter(g for _, g in rows)
    for t, g in rows:
        counts[g].update(_plain_grams(t))
    size = {g: sum(c.values()) + language_id.SMOOTHING * language_id.BUCKETS for g, c in counts.items()}
    got = {r["doc_id"]: r for r in _rows(language_id.identify(docs, language_id.train(docs, language_id.remainder("doc_id", 4) != 2)))}
    for i, t, _ in _texts():
        if t and any(map(str.isalpha, t)):
            grams = list(_plain_grams(t))
            logs = {g: np.log(docs_of[g] / len(rows)) + sum(np.log((c[x] + language_id.SMOOTHING) / size[g]) for x in grams) for g, c in counts.items()}
            best = max(sorted(logs), key=logs.get)
            assert got[i]["lang_pred"] == best
            assert got[i]["score"] == pytest.approx(1 / sum(np.exp(x - logs[best]) for x in logs.values()), abs=1e-3)


def _brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(g) <= 19 and (sum(g[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in g[-2::-2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_equal_plain_patterns():
    r = random.Random(3)
    for _ in range(20000):
        t = "".join(r.choice("a.@b-%1234567890+ () .9.9.\n") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == _brute_spans(t)


def test_revealing_terms_and_rewriting(spark, docs, empty):
    rows = [(i, f"line {i} here\nplease ask Zorblax{i % 2} about {'x' * (i + 3)} eve@mail.example.com today", "en", "s", 1, 0.0, "", "") for i in range(8)]
    df = spark.createDataFrame([*rows, (99, "nothing to see, the eve", "en", "s", 1, 0.0, "", "")], SCHEMA)
    got = {r["doc_id"]: r for r in _rows(pii.find_personal_data(df))}
    text = rows[0][1]
    a = text.index("Zorblax0")
    assert f"term:{a}:{a + 8}" in got[0]["spans"] and got[99]["spans"] == "" and got[0]["n_email"] == 1
    clean = {r["doc_id"]: r for r in _rows(pii.sanitise(df))}
    assert "<EMAIL>" in clean[0]["text"] and "eve@mail" not in clean[0]["text"] and "Zorblax" not in clean[0]["text"] and clean[99]["text"] == rows[0][1] or clean[99]["text"].startswith("nothing")
    base = {r["doc_id"]: r for r in _rows(pii.find_personal_data(docs))}
    for i, t, _ in _texts():
        want = ",".join("%s:%d:%d" % s for s in _brute_spans(t or ""))
        assert base[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert base[67]["n_email"] == base[67]["n_phone"] == base[67]["n_ip"] == base[67]["n_card"] == 1
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == docs.count()
    assert pii.find_personal_data(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_disclosure_equals_brute_force(spark):
    r = random.Random(9)
    spread = ["ordinary", "words", "stand", "everywhere", "here"]
    texts = [" ".join(r.choice(spread) for _ in range(12)) for _ in range(60)]
    for i in range(12):
        texts.append(f"{texts[i]} ask Zorblax ordinary words eve@mail.example.com stand {'Quimby' if i % 3 else 'here'} now")
    texts += ["Quimby alone", "the owner Vantrix of 10.1.2.3 here", "the owner Vantrix of 10.1.2.3 here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = [(pii.base_spans(t), t) for t in texts]
    near, uses, total, windows = {}, Counter(), 0, Counter()
    for spans, t in found:
        words = [m[0].lower() for m in pii._WORD.finditer(t)]
        total += len(words)
        uses.update(set(words))
        for entity, term, _ in pii.contexts(t, spans):
            near.setdefault((entity, term), []).append(t)
        windows.update({entity for entity, _, _ in pii.contexts(t, spans)})
    hashed = {int(pii.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), "alnum")[0].view(np.int64)[0]): w for w in uses}
    want = {}
    for (entity, term), of in near.items():
        p = min(1, len(of) / uses[hashed[term]]) * len(set(of)) / (len(set(of)) + 1)
        share = 1 + np.log2(p) / -np.log2(min(windows[entity] / total, 0.5))
        if -np.log2(p) <= 1 and share >= pii.THRESHOLD:
            want[entity, term] = share
    got = {(x["entity"], x["term"]): x["disclosure"] for x in _rows(pii.disclosures(df, pii.scan(df)))}
    assert got == pytest.approx(want)
    named = {hashed[t] for _, t in got}
    assert {"zorblax", "quimby", "vantrix"} <= named and named.isdisjoint(spread)
    rows = {x["doc_id"]: x for x in _rows(pii.find_personal_data(df))}
    assert rows[72]["n_term"] == 1 and all(rows[i]["n_term"] == 0 for i in range(60))


def test_revealing_terms_are_found_wherever_they_stand(spark):
    far = " ".join(["word"] * 40)
    texts = [f"ask Zorblax about {'x' * (i + 3)} eve@mail.example.com" for i in range(40)]
    texts += [f"\u00e9 zorblax! {far} eve@mail.example.com {far}\nZORBLAX again, zorblax@other.example.org", "we met Zorblax, and Zorblax sang", "Zorblaxian", " ".join(f"w{i}" for i in range(4000)), "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got, clean = ({r["doc_id"]: r for r in _rows(f(df))} for f in (pii.find_personal_data, pii.sanitise))
    for i, t in enumerate(texts):
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"\bzorblax\b(?!@)", t or "", re.I)]
        assert [s for s in got[i]["spans"].split(",") if s in want] == want
        assert not re.search(r"\bzorblax\b", clean[i]["text"] or "", re.I)
    assert got[41]["n_term"] == 2 and clean[41]["text"] == "we met <NAME>, and <NAME> sang" and clean[42]["text"] == "Zorblaxian"
    assert clean[44]["text"] == "" and clean[45]["text"] is None


def _brute_contamination(texts, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LOWER(t))
    asked = {}
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            asked.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = {}
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in asked}:
            for k in range(len(w) - n + 1):
                if names := asked.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_equals_brute_force(spark, docs, empty, monkeypatch):
    texts = {i: t for i, t, _ in _texts()}
    items = [(1, texts[7]), (2, " ".join((texts[9] or "").split()[:5])), (3, "and"), (4, None), (None, texts[8]), (2, "river stone"), (10, "Ça! élève")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = _brute_contamination(texts.items(), [(i, t) for i, t in items if i is not None and t is not None])
    for block in (4_000_000, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
        got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in _rows(decontaminate.contamination(docs, bench))}
        assert {i: got[i] for i in want} == want
        kept = {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()}
        assert {i for i in want if i in kept} == {i for i, w in want.items() if not w[4]}
    near = decontaminate.contamination(spark.createDataFrame([(1, "stone by the river")], "doc_id long, text string"), bench, slop=4).first()
    assert near.near_items == "2" and near.n_hit == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def _brute_components(texts, words, percent=80):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", LOWER(t))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("slop", [3, 5, 20])
def test_near_items_equal_brute_force(spark, slop):
    r = random.Random(slop)
    texts = [" ".join(r.choice("abcdefghijklmnop") * 3 for _ in range(r.randint(0, 30))) for _ in range(60)]
    items = [(str(i), " ".join(r.choice("abcdefghijklmnop") * 3 for _ in range(r.choice([2, 3, 6])))) for i in range(25)]
    got = decontaminate.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id string, text string"), size=4, slop=slop)
    for row in _rows(got):
        words = texts[row["doc_id"]].split()
        want = set()
        for item, text in items:
            asked = text.split()
            for w in (set(asked[i : i + 4]) for i in range(max(1, len(asked) - 3))):
                if any(t in w and w <= set(words[max(0, p - slop) : p + slop + 1]) for p, t in enumerate(words)):
                    want.add(item)
        assert row["near_items"] == ",".join(sorted(want))


def test_registered_index_query_answers_proximity(spark, tmp_path):
    bench = " ".join(f"word{i}" for i in range(13))
    spark.createDataFrame([(1, bench.replace("word5", "and word5")), (2, "word1 word2")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("7", bench)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in _rows(queries.queries()["op6_positional_index"](spark, str(tmp_path)))}
    assert (got[1]["near_items"], got[1]["n_hit"], got[2]["near_items"]) == ("7", 0, "")


def test_near_duplicates_equal_brute_force(spark, docs, empty):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = []
    for g in range(12):
        base = [word() for _ in range(r.randint(4, 120))]
        for _ in range(r.choice([1, 2, 6, 40])):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = word()
            texts.append((len(texts), " ".join(own)))
    texts += [(len(texts), None), (len(texts) + 1, " \n "), (len(texts) + 2, "one two"), (len(texts) + 3, "One TWO")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    for words in (4, 5):
        want = _brute_components(texts, words)
        got = _rows(near_dedup.near_duplicates(df, words))
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = near_dedup.keep_first(docs)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and 60 not in ids and ids[3] == 2 and ids[None] == 1 and ids[62] == ids[63] == 1
    assert near_dedup.near_duplicates(empty).count() == 0


def _links_meet(sets, percent=80):
    """Every link of the sets joins two that a hub's index shows: by a hub or by an entry that one asks and the other has."""
    hubs = sets[: 1 + len(sets[0]) % 5]
    references = hubs + sets[20:26]
    known, counts = np.unique(np.concatenate(references), return_counts=True)
    at = [near_dedup.index_entries(x, hubs, near_dedup.middle(references), known, counts, percent) for x in sets]
    for i, x in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(x, sets[j]))
            if 100 * common >= percent * (len(x) + len(sets[j]) - common) and not (at[i][0] >= 0 and at[j][0] >= 0):
                met = (at[i][0] < 0 and np.isin(at[i][3], at[j][2]).any()) or (at[j][0] < 0 and np.isin(at[j][3], at[i][2]).any())
                assert met, (i, j)


def test_hub_index_loses_no_link():
    rng = np.random.Generator(np.random.PCG64(21))
    for trial in range(300):
        base = np.unique(rng.integers(0, 2**63, int(rng.integers(3, 40)), dtype=np.uint64) * np.uint64(2))
        pool = np.unique(rng.integers(0, 2**63, 30, dtype=np.uint64) * np.uint64(2))
        sets = []
        for _ in range(40):
            kept = base[rng.random(len(base)) > rng.choice([0, 0.03, 0.1, 0.2])]
            if trial % 3 == 0:
                kept = kept[: max(1, int(len(kept) * rng.uniform(0.6, 1)))]
            sets.append(np.unique(np.concatenate([kept, rng.choice(pool, int(rng.integers(0, 6)))])))
        _links_meet(sets)


def test_dense_regions_equal_brute_force(spark, monkeypatch):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(70)], " ".join(word() for _ in range(60))
    texts = []
    for _ in range(250):  # near copies with more and more edits, and cut ones
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w[: r.choice([70, 70, 62, 55])]))
    texts += [" ".join([word() for _ in range(25)] + [passage] + [word() for _ in range(r.randint(5, 25))]) for _ in range(150)]
    chain = [word() for _ in range(60)]
    for k in range(0, 30, 3):  # each like the next one only
        texts.append(" ".join(chain[k : k + 40]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _brute_components(enumerate(texts), 4)
    for listed, rounds in ((near_dedup.LISTED, 2), (4, 3)):
        monkeypatch.setattr(near_dedup, "LISTED", listed)
        monkeypatch.setattr(near_dedup, "HUB_ROUNDS", rounds)
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in _rows(near_dedup.near_duplicates(df))}
        assert got == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_of_the_tables_equal_brute_force(spark, words):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in _rows(near_dedup.near_duplicates(df, words))}
    assert got == _brute_components([(x.doc_id, x.text) for x in df.collect()], words)


def test_one_doc_id_with_two_texts_is_one_node(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (2, "f g h i j"), (3, "f g h i j")], "doc_id long, text string")
    assert {r["component_id"] for r in _rows(near_dedup.near_duplicates(df))} == {1}


def test_language_model(spark, docs, empty):
    got = [r for r in _rows(lm_score.score_texts(docs)) if r["doc_id"] is not None]
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", LOWER(t)) + [None] for i, t, _ in _texts()}
    learning = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for i in [*learning, *([3] if 3 in learning else [])] for w in tokens[i])
    counts.update("orphan text of nobody".split() + [None])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        words = tokens[r["doc_id"]]
        assert r["base_score"] == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["score"] < 0
    assert lm_score.score_texts(empty).count() == 0


def test_scores_follow_the_table_alone(spark, docs):
    first, again = ({(r["doc_id"], r["n_tokens"]): r["score"] for r in _rows(lm_score.score_texts(d))} for d in (docs, docs.repartition(7)))
    assert first == pytest.approx(again, rel=1e-9)


def test_model_beats_the_base_on_unseen_texts(spark):
    rng = np.random.Generator(np.random.PCG64(12))
    follow = rng.dirichlet(np.full(400, 0.02), 400).cumsum(axis=1)
    rows = []
    for i in range(400):
        w = [int(rng.integers(400))]
        for x in rng.random(150):
            w.append(min(int(np.searchsorted(follow[w[-1]], x)), 399))
        rows.append((i, " ".join(f"w{k}" for k in w)))
    got = lm_score.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").toPandas()
    assert got["score"].sum() / got["n_tokens"].sum() > got["base_score"].sum() / got["n_tokens"].sum() + 0.3


def test_words_of_a_class_are_normalised():
    rng = np.random.Generator(np.random.PCG64(13))
    uses, contexts_ = rng.integers(2, 50, 30).astype(float), rng.standard_normal((12, lm_score.WIDTH)).astype(np.float32)
    before, word = np.divmod(np.unique(rng.integers(0, 360, 200)), 30)
    n = rng.integers(1, 9, len(word)).astype(float)
    u = lm_score.within_class(before, word, n, uses, contexts_).astype(np.float16)
    norm = np.log(uses.sum() + 1 + uses @ np.expm1(u.astype(float) @ contexts_.T.astype(float)))
    counts = lm_score.Counts(np.arange(30, dtype=np.uint64), uses.astype(int) - 1, np.full(30, -1), np.zeros(30, int), 0, 1, 0, 0, np.zeros(1), np.zeros(1))
    inner = lm_score.Inner(u, contexts_, norm[None, :].astype(np.float32))
    for c in range(12):
        at = np.arange(30)
        total = (10 ** inner.log10(counts, np.full(30, c), at, np.full(30, True), np.zeros(30, int), np.log10(uses))).sum()
        assert total + np.exp(-norm[c]) == pytest.approx(1, abs=1e-4)  # the rest is for words never seen
    likely = [u[w].astype(float) @ contexts_[b] for b, w in zip(before, word, strict=True)]
    assert np.average(likely, weights=n) > 0


def test_shards_and_pieces_cover_every_token(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 500)
    monkeypatch.setattr(lm_score, "PIECE", 7)
    counts = lm_score.head_of(lm_score.count_tokens(docs), 40)
    rows = lm_score.coded(docs, counts).collect()
    assert sum(len(r.codes) // 4 - 2 for r in rows) == counts.total and len({r.shard for r in rows}) > 3
    pairs = lm_score.pair_counts(lm_score.coded(docs, counts), counts).toPandas()
    inner = counts.single < 0
    assert pairs["n"].sum() == counts.n[inner].sum() and (pairs.groupby("word")["n"].sum() == counts.n[np.unique(pairs["word"])]).all()


def test_class_probabilities_are_normalised():
    model = lm_score.Bilinear.start(np.full(20, 0.05))
    scorer = lm_score.Scorer.of(model)
    w = np.arange(20)
    for a, b in ((20, 20), (3, 20), (5, 7)):
        total = (10.0 ** scorer.log10(np.full(20, a), np.full(20, b), w)).sum()
        assert total == pytest.approx(1, abs=1e-4)


def _trained(batch, noise):
    """Mean log10 probability of unseen tokens after training on 60,000 tokens of a chain, and the steps taken."""
    rng = np.random.Generator(np.random.PCG64(3))
    follow = rng.dirichlet(np.full(64, 0.05), 64).cumsum(axis=1)
    chain = [0]
    for x in rng.random(70_000):
        chain.append(min(int(np.searchsorted(follow[chain[-1]], x)), 63))
    chain = np.array(chain)
    c2, c1, w = chain[:-2], chain[1:-1], chain[2:]
    share = (np.bincount(w[:60_000], minlength=64) + 1) / (60_000 + 64)
    trainer = lm_score.Trainer(lm_score.Bilinear.start(share), share, 1)
    for k in range(0, 60_000, batch):
        trainer.step(*(x[k : min(k + batch, 60_000)] for x in (c1, c2, w)))
    return lm_score.Scorer.of(trainer.model).log10(c1[60_000:], c2[60_000:], w[60_000:]).mean(), trainer.steps


def test_training_is_not_thinned(monkeypatch):
    got, steps = _trained(lm_score.BATCH, lm_score.NOISE)
    monkeypatch.setattr(lm_score, "NOISE", 64)
    thinned, fewer = _trained(2048, 64)
    assert steps >= 2 * fewer - 1 and got > thinned + 0.01


def test_training_step_equals_plain_gradient():
    rng = np.random.Generator(np.random.PCG64(4))
    share = rng.dirichlet(np.ones(30))
    trainer, model = lm_score.Trainer(lm_score.Bilinear.start(share), share, 9), lm_score.Bilinear.start(share)
    c1, c2, w = rng.integers(0, 31, 200), rng.integers(0, 31, 200), rng.integers(0, 30, 200)
    noise = np.searchsorted(np.cumsum(share), np.random.Generator(np.random.PCG64(9)).random(lm_score.NOISE))
    grads = [np.zeros(p.shape) for p in model.parts()]
    for a, b, target in zip(c1, c2, w, strict=True):
        context = model.r[a] @ model.c1 + model.r[b] @ model.c2
        for k, real in [(target, 1), *((k, 0) for k in noise)]:
            miss = real - 1 / (1 + np.exp(np.log(lm_score.NOISE * share[k]) - model.b[k] - context @ model.q[k]))
            back = miss * model.q[k]
            grads[0][a] += back @ model.c1.T
            grads[0][b] += back @ model.c2.T
            grads[1] += np.outer(model.r[a], back)
            grads[2] += np.outer(model.r[b], back)
            grads[3][k] += miss * context
            grads[4][k] += miss
    trainer.step(c1, c2, w)
    for p, old, g in zip(trainer.model.parts(), model.parts(), grads, strict=True):
        g /= len(w)
        assert p == pytest.approx(old + lm_score.RATE * g / np.sqrt(1e-6 + g * g), abs=1e-4)


def test_noise_drawn_again_is_computed_once(monkeypatch):
    made, exp = [], np.exp

    def counted(x, *args, **more):
        made.append(np.size(x))
        return exp(x, *args, **more)

    share = np.full(3, 1 / 3)
    trainer = lm_score.Trainer(lm_score.Bilinear.start(share), share, 1)
    monkeypatch.setattr(np, "exp", counted)
    trainer.step(np.full(200, 3), np.full(200, 3), np.arange(200) % 3)
    assert sum(made) <= 200 * (3 + 1)  # at most the three classes and the target of each token, however many are drawn


def test_words_of_a_class_are_trained_as_by_plain_loops(monkeypatch):
    monkeypatch.setattr(lm_score, "INNER_WORDS", 4, raising=False)
    rng = np.random.Generator(np.random.PCG64(14))
    uses, contexts_ = rng.integers(2, 50, 10).astype(float), rng.standard_normal((7, lm_score.WIDTH)).astype(np.float32)
    before, word = np.divmod(rng.permutation(np.unique(rng.integers(0, 60, 40))), 10)
    n = rng.integers(1, 9, len(word)).astype(float)
    noise, total = lm_score.INNER_NOISE * uses / uses.sum(), np.bincount(before, n, 7)
    want = np.zeros((10, lm_score.WIDTH))
    for k in range(10):
        squares = np.full(lm_score.WIDTH, 1e-6)
        for _ in range(lm_score.INNER_STEPS):
            g = -lm_score.INNER_PULL * want[k]
            for c in range(7):
                seen = n[(before == c) & (word == k)].sum()
                fake = 1 / (1 + lm_score.INNER_NOISE * np.exp(-want[k] @ contexts_[c]))
                g = g + (seen * (1 - fake) - noise[k] * total[c] * fake) * contexts_[c]
            squares += g * g
            want[k] += lm_score.INNER_RATE * g / np.sqrt(squares)
    assert lm_score.within_class(before, word, n, uses, contexts_) == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("words", [[], [7], [0, 1, 2, 3, 2**63, 2**64 - 1], [5 << 40 | k for k in range(9)]])
def test_words_are_found_whatever_their_leading_bits(words):
    n = len(words)
    counts = lm_score.Counts(np.array(words, np.uint64), np.ones(n, int), np.full(n, -1), np.zeros(n, int), 0, 1, n, n, np.zeros(1), np.zeros(1))
    tokens = np.array([*words, 4, 6, 8, 5 << 40 | 9, 2**63 - 1, 2**63 + 1, 2**64 - 2], np.uint64)
    at, there = counts.find(tokens)
    assert there.tolist() == [t in words for t in tokens.tolist()]
    assert counts.words[at[there]].tolist() == tokens[there].tolist() and (not n or (at >= 0).all() and (at < n).all())


def test_tallies_are_merged():
    rng = np.random.Generator(np.random.PCG64(15))
    tokens = rng.integers(0, 40, 900).astype(np.uint64)
    kinds = (tokens * np.uint64(7)).astype(np.int64)
    held = [lm_score._tally(tokens[k : k + 300], kinds[k : k + 300]) for k in range(0, 900, 300)]
    words, of, n = lm_score._tally(*map(np.concatenate, zip(*held, strict=True)))
    assert dict(zip(words.tolist(), n.tolist(), strict=True)) == Counter(tokens.tolist()) and (of == words.astype(int) * 7).all()
    assert [len(x) for x in lm_score._tally(tokens[:0], kinds[:0])] == [0, 0, 0]


def test_rare_words_are_joined(spark, docs, monkeypatch):
    whole = {r["doc_id"]: r["base_score"] for r in _rows(lm_score.score_texts(docs))}
    monkeypatch.setattr(lm_score.head_of, "__defaults__", (5,))
    few = {r["doc_id"]: r["base_score"] for r in _rows(lm_score.score_texts(docs))}
    assert few == pytest.approx(whole)


PAGE = '<html><head><title>T</title><script>var t="</p>";</script></head><body class="x"><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p><b>First  line<br><p>Second {0}&nbsp;end</p><div class="share">Share</div><aside>Side</aside></article><div id="comments"><p>nice!</p></div><footer>&copy; me</footer>'


def _lines(html):
    return [t for _, t in site_style.lines_of(html)[0]]


def test_lines_of_a_page():
    assert _lines(PAGE.format("x")) == ["Title & more", "First line", "Second x end"]
    assert _lines(None) == _lines("") == []
    assert _lines("<p>a<p>b</div>c<![bad") == ["a", "b", "c<![bad"] or _lines("<p>a<p>b")[:2] == ["a", "b"]
    assert _lines("<div class='w-1/2'>x</div>") == ["x"]


@pytest.mark.parametrize(
    "name, mark",
    [("ad", True), ("cookie-notice", True), ("sidebar-2", True), ("site-header", True), ("share-buttons", True), ("post-comments-list", True), ("blog-sidebar", True)]
    + [(x, False) for x in ("entry-header", "post-header", "related-work", "share-price", "menu-prices", "lunch-menu", "has-sidebar", "content", "w-1/2", "", "-")],
)
def test_names_are_judged_whole(name, mark):
    assert site_style.is_mark(name) is mark


def test_markup_keeps_the_article_whole():
    assert _lines('<article><header class="entry-header"><h1>A</h1></header><p>b</p></article>') == ["A", "b"]
    assert _lines('<article><div class="post-header"><h1>A</h1></div><div class="header"><h2 class="header">B</h2></div></article>') == ["A", "B"]
    assert _lines('<article><p class="related-work">a</p><p class="share-price">b</p><ul class="menu-prices"><li>c</ul><div class="ad">x</div></article>') == ["a", "b", "c"]
    assert _lines('<div class="content has-sidebar"><p>a</p><div class="sidebar">x</div></div><div class="header">y</div>') == ["a"]


def test_lines_of_small_hosts(spark):
    """A footer on all of 25 pages goes, on all of seven too, on six pages it stays; a line of half of the pages stays."""
    rows = [(100 * h + i, f"https://h{h}.example/{i}", f"<h1>Title {h} {i}</h1><p>text {h} {i} with words</p><p>{'even' if i % 2 else f'odd {h} {i}'}</p><p>All rights reserved by us</p>") for h, n in ((0, 25), (1, 25), (2, 7), (3, 6)) for i in range(n)]
    got = {r["page_id"]: r["text"].split("\n") for r in _rows(site_style.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    assert all(("All rights reserved by us" in text) == (i >= 300) for i, text in got.items())
    assert all(len(text) == (4 if i >= 300 else 3) for i, text in got.items())


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "core" + "</div>" * 20_000
    lines, shapes = site_style.lines_of(deep)
    assert [t for _, t in lines] == ["core"] and len(shapes) == 20_001
    long = "".join(f"<p>block {i}</p>" for i in range(50_000))
    assert len(site_style.lines_of(long)[0]) == 50_000


def _site(article="article"):
    """Pages of one host with a menu without any name, a line in every article, and copies of one article; of a small host too."""
    r = random.Random(8)
    text = lambda n: " ".join(r.choice("stone river light cold house token and the of".split()) + str(r.randint(0, 999)) for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        body = [text(30) for _ in range(4)]
        rows.append((i, f"https://a.example/{i}", f"<body><div class=top>Welcome to us</div><{article}><h1>{body[0]}</h1>" + "".join(f"<p>{b}</p>" for b in body[1:]) + f"<p>Subscribe for more</p></{article}><div class=end>All rights reserved</div>"))
        want[i] = "\n".join(body)
    for i in range(60, 64):
        rows.append((i, f"https://a.example/copy{i}", rows[0][2]))
        want[i] = want[0]
    rows.append((64, "https://b.example/", f"<body><div class=top>Welcome to us</div><{article}><h1>Only one</h1><p>{text(9)}</p></{article}>"))
    return rows, want


@pytest.mark.parametrize("article", ["article", "div"])
def test_style_tree_decides(spark, article):
    rows, want = _site(article)
    got = {r["page_id"]: r for r in _rows(site_style.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    assert {i: got[i]["text"] for i in want} == want
    assert all(got[i]["n_removed"] == (1 if article == "article" else 3) for i in want)
    # a host of one page learns from the same path elsewhere
    assert got[64]["text"].startswith("Only one") and got[64]["n_chars"] == len(got[64]["text"])


def test_copies_of_one_page_stay(spark):
    rows = [(i, "http://c.example/x", "<article><h1>Same</h1><p>whole text</p></article>") for i in range(50)] + [(50, None, None), (51, "http://c.example/", "")]
    got = _rows(site_style.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert [r["text"] for r in sorted(got, key=lambda r: r["page_id"])] == ["Same\nwhole text"] * 50 + ["", ""]
    assert site_style.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_style_tree_equals_brute_force(spark):
    rows, _ = _site()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["host"], r["path"]): (r["pages"], r["importance"]) for r in _rows(site_style.style_tree(site_style.feature_counts(site_style.page_lines(df))))}
    pages = [(site_style.host_of(u), *site_style.lines_of(h)) for _, u, h in rows]

    def importance(of):
        nodes = {}
        for lines, shapes in of:
            for p, k in shapes:
                node = nodes.setdefault(p, (Counter(), Counter(), Counter()))
                node[1][k] += 1
            for p in {p for p, _ in shapes}:
                nodes[p][0]["n"] += 1
            for p, t in set(lines):
                nodes[p][2][t] += 1
        out = {}
        for p, (n, shape, line) in nodes.items():
            base, total, uses = np.log(max(n["n"], 2)), sum(shape.values()), sum(line.values())
            presentation = -sum(m / total * np.log(m / total) for m in shape.values()) / base
            content = 1 - sum(m * np.log(m) for m in line.values()) / uses / base if uses else 0
            out[p] = (n["n"], 1.0 if n["n"] < 2 else max(presentation, content))
        return out

    usual = importance([(a, b) for _, a, b in pages])
    for host in {h for h, _, _ in pages}:
        for p, (n, own) in importance([(a, b) for h, a, b in pages if h == host]).items():
            seen = n - 1
            assert got[host, p] == (n, pytest.approx((seen * own + site_style.PRIOR * usual[p][1]) / (seen + site_style.PRIOR), abs=1e-9))


def test_snapshots_collapse(spark):
    data = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yes"), (3, 0, "user", "hi"), (3, 1, "bot", "yes"), (4, 0, "user", None), (5, 0, None, "hi"), (6, 5, "user", "hi"), (6, 9, "bot", "no"), (None, 0, "user", "hi")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in _rows(chat.collapse_snapshots(df))}
    assert set(got) == {2, 4, 5, 6} and got[2]["n_copies"] == 2 and got[6]["n_turns"] == 2
    assert got[2]["chat"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyes<|im_end|>"
    long = spark.range(3000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    both = long.unionByName(long.where("turn < 2500").withColumn("conv_id", F.lit(8).cast("long")))
    assert [r["conv_id"] for r in _rows(chat.collapse_snapshots(both))] == [7]
    assert chat.collapse_snapshots(df.limit(0)).count() == 0


def test_proximity_search_checks_a_window_once(monkeypatch):
    """Centres of all terms are gathered before they are checked, and windows share what their rarest terms leave."""
    rng = np.random.default_rng(3)
    words = ["the", "of", "and", *[f"w{i}" for i in range(30)]]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(20)]
    items = [(str(k), " ".join(rng.choice(words, 6))) for k in range(40)]
    slop, size = 5, 4
    asked = decontaminate.build_windows(items, size)
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    segment = decontaminate.build_segment(data, offsets, decontaminate.gap_of(size, slop))
    calls, within = [], decontaminate._within
    monkeypatch.setattr(decontaminate, "_within", lambda *a: calls.append(1) or within(*a))
    near = decontaminate.search(segment, asked, slop)[2]
    want: dict[int, set[str]] = {}
    for d, text in enumerate(texts):
        doc = text.split()
        for item, question in items:
            own = question.split()
            for i in range(len(own) - size + 1):
                ask = set(own[i : i + size])
                if any(doc[c] in ask and ask <= set(doc[max(0, c - slop) : c + slop + 1]) for c in range(len(doc))):
                    want.setdefault(d, set()).add(item)
    assert near == want
    assert want
    assert len(calls) <= len(asked.places)


def test_marks_behind_words_are_encoded_once(monkeypatch):
    """Words with runs of marks cost the library's whole pass once a run, not once a word."""
    encode = encoder(default_vocabulary())
    words = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    text = " ".join(w + m for w in words for m in ("$$$", ".***", "_")) + " don't.' it's' é!! x$1"
    calls, whole = [], type(encode.spaced)._whole
    monkeypatch.setattr(type(encode.spaced), "_whole", lambda *a: calls.append(1) or whole(*a))
    want = array("I", Tokenizer.from_file(default_vocabulary()).encode(text, add_special_tokens=False).ids).tobytes()
    assert encode.encode(text) == want
    assert len(calls) < 20


def test_later_stages_let_the_encoders_memory_go():
    """Workers are used again: the packing's cache must not stand beside the next run's first stage."""
    encoder(default_vocabulary()).encode("some words")
    list(language_id._count(iter([])))
    assert encoder.cache_info().currsize == 0
