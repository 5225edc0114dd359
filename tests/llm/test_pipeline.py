import hashlib
import random

import numpy as np

import corpus_pipeline
from stratalens.llm import bpe, langid, secrets, simhash

SMALL = "/root/testdata/sf0.001"


def test_pipeline_matches_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [r for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    judge = langid.Judge(langid.fit(docs))
    rows = [r for r in rows if judge(r.text)[1] > 0]
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in rows}
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    rows = [r for r in rows if root(r.doc_id) == r.doc_id]

    def grams(t):
        w = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    wanted = [g for g in map(grams, items) if g]
    rows = [r for r in rows if not any(5 * len(g & grams(r.text)) >= 4 * len(g) for g in wanted)]
    kept = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    detector = secrets.fit(kept)
    enc = bpe.load(bpe.rank_file())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == {r.doc_id for r in rows} and 0 < len(rows) < docs.count()
    for r in rows:
        text = secrets.redact(r.text, secrets.spans(r.text, detector)[1])
        ids = np.array(enc.encode_ordinary(text), "<u4").tobytes()
        assert bytes(got[r.doc_id].ids) == ids
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns


def test_stages_take_odd_rows(spark):
    """Nulls, repeated rows, clashing columns and very long texts, stage by stage."""
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()[0].text
    rng = random.Random(4)
    say = lambda _, n=200: " ".join("".join(rng.choice("thesandoirlemn") for _ in range(rng.randint(2, 9))) for _ in range(n))
    one, two = say(1), say(3)
    rows = [(1, one), (1, one), (1, say(2)), (None, two), (None, two), (None, None), (2, ""), (3, None), (4, say(4) + " " + item), (None, item + " " + say(5)), (5, say(6, 60_000)), (6, f'{say(7)} token = "0123456789abcdef0123" {say(8)}')]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __near_id string, __leak_id string, key int, text_hash string")
    left = [set(rows[:5]) | set(rows[8:])]
    left += [left[0], left[0] - {rows[8], rows[9]}, left[0] - {rows[8], rows[9]}]
    size = [9, 7, 5, 5]
    for (_, stage), want, n in zip(corpus_pipeline.STAGES, left, size):
        docs = stage(spark, docs, SMALL)
        got = [(r.doc_id, r.text) for r in docs.collect()]
        assert len(got) == n and ({x if "[SECRET]" not in x[1] else rows[11] for x in got}) == want, stage
        assert docs.columns[-4:] == ["__near_id", "__leak_id", "key", "text_hash"]
    done = corpus_pipeline.encode_tokens(spark, docs, SMALL).collect()
    assert len(done) == 5 and len(corpus_pipeline.STAGES) == 5
