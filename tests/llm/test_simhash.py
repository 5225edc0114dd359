import random

import pytest
import xxhash
from pyspark.sql import Row

from stratalens.llm import simhash


def slow_fingerprint(text):
    raw = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "One", "One TWO", "a b c", "Ärger ÄRGER x\x1fy  z", *(" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(1, 90))) for _ in range(40))]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_links_lose_no_pair(spark):
    rng = random.Random(2)
    fps = [0, (1 << 64) - 1]
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(6):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = simhash.connected_components(found).collect()
    label = {r.node: r.component for r in got}
    groups = {}
    for x, root in zip(signed, slow_components(fps)):
        groups.setdefault(root, set()).add(x)
    expected = {frozenset(g) for g in groups.values() if len(g) > 1}
    found_groups = {}
    for node, component in label.items():
        found_groups.setdefault(component, set()).add(node)
    assert {frozenset(g) for g in found_groups.values()} == expected


@pytest.mark.parametrize("bound", [200_000, 0])
def test_near_duplicates_and_edges(spark, monkeypatch, bound):
    monkeypatch.setattr("stratalens.runtime.BROADCAST_ROWS", bound)
    base = " ".join(f"word{i % 37}x{i}" for i in range(400))
    long = " ".join(f"u{i % 977}" for i in range(200_000))
    rows = [(7, base), (3, base), (5, base + " end"), (9, None), (8, ""), (1, "solo text of its own kind"), (None, base), (3, base), (1, "another text that has the same id but no near copy"), (1, "solo text of its own kind"), (None, "no id and no copy at all here"), (20, long), (21, long + " end")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, fp=f"clash{k}", component_id="clash", _id="clash", key=1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, fp string, component_id string, _id string, key int")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.op10(docs).collect()}
    fps = [simhash.fingerprint(t) for _, t in rows]
    assert fps == [slow_fingerprint(t) for _, t in rows]
    roots = slow_components(fps)
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[k] and rows[j][0] is not None]
        assert got[(i, f"{fps[k]:016x}")] == min(ids, default=None)
    out = simhash.deduplicate(docs)
    kept = sorted(((r.doc_id or 0, r.text or "", r.fp) for r in out.collect()))
    assert out.columns == docs.columns
    assert kept == sorted([(0, rows[10][1], "clash10"), (1, rows[5][1], "clash5"), (1, rows[8][1], "clash8"), (3, base, "clash1"), (8, "", "clash4"), (20, long, "clash11")])
    assert simhash.op10(docs.limit(0)).count() == 0
