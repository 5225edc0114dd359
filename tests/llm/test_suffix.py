import hashlib
import random

import numpy as np
import pytest

from stratalens.llm import suffix


def slow(rows):
    seen = {}
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for p in range(len(raw) - 199):
            seen[raw[p : p + 200]] = seen.get(raw[p : p + 200], 0) + 1
    out = []
    for (i, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw) + 2, bool)
        for p in range(len(raw) - 199):
            if seen[raw[p : p + 200]] > 1:
                gone[p + 1 : p + 201] = True
        kept = bytes(c for c, g in zip(raw, gone[1:]) if not g)
        out.append((i, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def say(rng, n, alphabet="abé "):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_owned_windows_are_a_partition():
    rng = random.Random(1)
    for raw in [b"", b"a" * 199, b"a" * 5000, b"ab" * 900, say(rng, 5000).encode(), bytes(range(256)) * 9]:
        first, last, _ = suffix.owners(np.frombuffer(raw, np.uint8))
        assert [p for a, b in zip(first, last) for p in range(a, b + 1)] == list(range(max(0, len(raw) - 199)))
        start, size, reps, _, _ = suffix.contexts(raw)
        assert sum((n - 199) * r for n, r in zip(size, reps)) == max(0, len(raw) - 199)
    assert len(suffix.contexts(b"a" * 100000)[0]) == 1


def test_interval_expansion_matches_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        pool = [say(rng, rng.randint(200, 420), "ab").encode() for _ in range(4)]
        texts, weights = [], []
        for _ in range(rng.randint(1, 12)):
            t = rng.choice(pool)
            a = rng.randint(0, max(0, len(t) - 220))
            texts.append((rng.choice([b"", b"x", b"yz"]) + t[a:] + rng.choice([b"", b"q"]))[: rng.randint(200, 400)])
            weights.append(rng.choice([1, 1, 1, 2]))
        if any(len(t) < 200 for t in texts):
            continue
        counts = {}
        for t, w in zip(texts, weights):
            for p in range(len(t) - 199):
                counts[t[p : p + 200]] = counts.get(t[p : p + 200], 0) + w
        low, high = suffix.repeated_ranges(texts, weights)
        for t, a, b in zip(texts, low, high):
            hit = [p for p in range(len(t) - 199) if counts[t[p : p + 200]] > 1]
            assert (a, b) == ((min(hit), max(hit) + 200) if hit else (0, 0))


def corpus():
    rng = random.Random(3)
    passage, other = say(rng, 330), say(rng, 205, "abcdef")
    rows = [(i, say(rng, rng.randint(0, 300)) + passage[rng.randint(0, 20) :] + say(rng, rng.randint(0, 300))) for i in range(25)]
    rows += [(100 + i, say(rng, 150) + other[rng.randint(0, 12) :] + say(rng, 100)) for i in range(8)]
    rows += [(200, None), (201, ""), (202, "z" * 199), (203, "z" * 200), (204, "q" * 700), (205, "xy" * 300), (206, "abc" * 66 + "ab"), (207, "abc" * 67)]
    rows += [(None, say(rng, 500)), (300, rows[0][1]), (300, rows[0][1]), (301, rows[0][1][:-1]), (302, rows[5][1] + "!" + rows[5][1])]
    return rows


@pytest.mark.parametrize("hot", [1000, 2])
def test_query_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, gram int")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in suffix.op4(df).collect()), key=key) == sorted(slow(rows), key=key)


@pytest.mark.parametrize("part, shard, hot", [(300, 1 << 19, 1000), (1 << 22, 500, 3), (1 << 22, 1 << 19, 24)])
def test_bounds_change_nothing(spark, monkeypatch, part, shard, hot):
    """Parts of long texts, sizes of shards, and which of the ways settles a gram."""
    monkeypatch.setattr(suffix, "PART", part)
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in suffix.op4(df).collect()), key=key) == sorted(slow(rows), key=key)


def test_very_long_text(spark):
    rng = random.Random(9)
    passage = say(rng, 260, "abcdefgh")
    head = "".join(rng.choice("abcdefghij") for _ in range(suffix.PART - 100))
    rows = [(1, head + passage + "".join(rng.choice("klmnop") for _ in range(300_000)) + passage), (2, passage)]
    got = {r.doc_id: r for r in suffix.op4(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed) == (520, 2, 260)
    kept = rows[0][1].replace(passage, "").encode()
    assert got[1].kept_sha256 == hashlib.sha256(kept).hexdigest() and got[1].n_bytes == len(rows[0][1])


def test_empty(spark):
    assert suffix.op4(spark.createDataFrame([], "doc_id long, text string")).count() == 0
