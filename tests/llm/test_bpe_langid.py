import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from stratalens.llm import bpe, langid


def plain_encoding():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [("!\x1c?\x1f. \x85a\u2003" * 20), None, "", "   ", "Hello <|endoftext|> world\n\n  x", "a" * 3000, "é ü 漢字 \U0001f600 'll", ("word \t\n  12 é!! " * 9000) + " " * 50, "x  y  z"]


def test_pieces_keep_ids():
    enc = plain_encoding()
    for t in TEXTS:
        for size in (1, 7, 100, bpe.PIECE_CHARS):
            parts = list(bpe.pieces(t or "", size))
            assert "".join(parts) == (t or "")
            assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t or "")


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "hi", "x")], "doc_id long, text string, ids string")
    enc = plain_encoding()
    full = bpe.encode_documents(docs)
    got = {r.doc_id: r for r in bpe.op5(docs).collect()}
    assert bpe.op5(docs).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    raw = {r.doc_id: bytes(r.raw) for r in bpe.decode_documents(full).collect()}
    for i, t in enumerate(TEXTS):
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256) == (ids.size, hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert raw[i] == (t or "").encode()
    assert None in got and bpe.op5(docs.limit(0)).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.op2(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.lang and any(c.isalpha() for c in r.text or "")]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en", "s"), (2, "der Hund und die Katze", "de", "s"), (3, None, "en", "s"), (4, "123 %% --", None, "s"), (5, "", "de", "s"), (None, "the dog", "en", "s"), (6, "漢字漢字", None, "s")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, score string")
    got = langid.op2(docs).collect()
    assert len(got) == 14
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[3] == by[4] == by[5] == ("und", 0.0) and by[6][1] == 0
    assert sorted(r.doc_id or 0 for r in langid.accept(docs).collect()) == sorted([0, 1, 2] * 2)
    assert langid.op2(docs.limit(0)).count() == 0 and langid.accept(docs.limit(0)).count() == 0
    blank = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.op2(blank).collect()} == {"und"}


def test_ngrams_by_hand():
    keys, counts = langid.ngrams("Ab, ab")
    text = {}
    for k, n in zip(keys.tolist(), counts.tolist()):
        s = ""
        while k:
            s, k = chr(k & 0x1FFFFF) + s, k >> 21
        text[s] = n
    assert text == {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2}


def slow_ngrams(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split(" ")
    out = {}
    for w in (f" {x} " for x in words if x):
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                if w[i : i + n].strip():
                    out[w[i : i + n]] = out.get(w[i : i + n], 0) + 1
    return out


def named(keys, counts):
    out = {}
    for k, n in zip(keys.tolist(), counts.tolist()):
        s = ""
        while k:
            s, k = chr(k & 0x1FFFFF) + s, k >> 21
        out[s] = n
    return out


def slow_predict(text, profiles):
    found = slow_ngrams(text or "")
    if not found or not profiles:
        return "und", 0.0
    order = lambda s: sum(ord(c) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    own = sorted(found, key=lambda s: (-found[s], order(s)))[: langid.PROFILE]
    best = min((sum(abs(p.index(g) - i) if g in p else langid.PROFILE for i, g in enumerate(own)), name) for name, p in profiles.items())
    return best[1], 1 - best[0] / (langid.PROFILE * len(own))


def test_chunks_change_nothing(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab éÄ,1\u4e00 ") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 20, 60, 61, 200)] * 3
    for t in texts:
        want = slow_ngrams(t)
        for chunk in (1, 2, 3, 5, 1 << 20):
            monkeypatch.setattr(langid, "CHUNK", chunk)
            assert named(*langid.ngrams(t)) == want, (t, chunk)


def test_predictions_match_brute_force(spark):
    """Profiles and every prediction are recomputed from plain strings."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    sums = {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            for g, n in slow_ngrams(r.text).items():
                sums.setdefault(r.lang, {})[g] = sums.get(r.lang, {}).get(g, 0) + n
    key = lambda s: sum(ord(c) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    profiles = {k: sorted(v, key=lambda s: (-v[s], key(s)))[: langid.PROFILE] for k, v in sums.items()}
    got = {r.doc_id: r for r in langid.op2(docs).collect()}
    for r in rows:
        lang, score = slow_predict(r.text, profiles)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-9


def test_equal_languages_and_long_text(spark):
    rows = [(1, "aaa bbb", "x"), (2, "aaa bbb", "w"), (3, "aaa bbb " * 200_000, None)]
    docs = spark.createDataFrame([r for r in rows for _ in range(1)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.op2(docs).collect()} <= {"w", "x"}
    profiles = {"x": langid.ranking(*langid.ngrams("aaa bbb")), "w": langid.ranking(*langid.ngrams("aaa bbb"))}
    assert {r.lang_pred for r in langid.identify(docs, profiles).collect()} == {"w"}


def test_profiles_come_from_all_documents(spark, monkeypatch):
    """Thousands of documents of a language, each counted, however a task gathers them."""
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(4)), rng.choice("xxxy")) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sums = {}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            for g, n in slow_ngrams(text).items():
                sums.setdefault(lang, {})[g] = sums.get(lang, {}).get(g, 0) + n
    assert len(sums["x"]) > langid.PROFILE
    key = lambda s: sum(ord(c) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    want = {k: [key(s) for s in sorted(v, key=lambda s: (-v[s], key(s)))[: langid.PROFILE]] for k, v in sums.items()}
    assert {k: v.tolist() for k, v in langid.fit(docs).items()} == want
    # tasks that hand on counts early, in parts, give the same sums
    one = pa.RecordBatch.from_pydict({"lang": [r[2] for r in rows], "text": [r[1] for r in rows]})
    for gathered in (1, 3000, 1 << 19):
        monkeypatch.setattr(langid, "GATHERED", gathered)
        got = {}
        for b in langid._counted(iter([one])):
            for lang, k, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                got[lang, k] = got.get((lang, k), 0) + n
        whole = {}
        for _, text, lang in rows:
            for g, n in slow_ngrams(text).items():
                whole[lang, key(g)] = whole.get((lang, key(g)), 0) + n
        assert got == whole


def test_rare_letters_are_learned_by_the_pipeline(spark):
    """A text stays if any document that may be learned from has one of its n-grams."""
    rows = [(i, "ab", "x") for i in range(6000)] + [(6000 + i, chr(0x4E00 + i // 4), "x") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5}
    got = langid.accept(docs).collect()
    assert len(learned) == 41 and sorted(r.doc_id for r in got) == [i for i, t, _ in rows if t in learned]
