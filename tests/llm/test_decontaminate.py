import random
import re

import pytest

from stratalens.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


@pytest.mark.parametrize("rows", [200_000, 0])
def test_leaks_match_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr("stratalens.runtime.BROADCAST_ROWS", rows)
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([3, 4, 5, 6, 9, 20, 60, 150]))) for i in range(60)]
    items += [(60, None), (61, ""), (3, say(30)), (None, say(30)), (70, "Alpha beta gamma delta"), (71, "solitary"), (72, items[5][1])]
    docs = []
    for i in range(150):
        parts = [say(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            said = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 4)):
                if said:
                    said[rng.randrange(len(said))] = rng.choice(vocab)
            parts += [", ".join(said).upper(), say(rng.randint(0, 300))]
        docs.append((i, "\n".join(parts)))
    docs += [(None, items[20][1]), (None, "a clean text of no id at all"), (900, None), (901, ""), (4, items[30][1]), (4, items[30][1]), (902, "alpha, beta gamma: delta e f"), (903, "solitary"), (904, "alpha beta gamma")]
    docs += [(905, say(60000) + " " + items[41][1] + " " + say(20000))]
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, leak string")
    b = spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, doc_id string")
    expected = []
    sized = [(k, n, shingles(text, n)) for k, text in items for n in [min(5, len(words(text)))]]
    for t_id, t in set(docs):
        grams = [shingles(t, n) for n in range(6)]
        for k, n, own in sized:
            held = grams[n]
            if own and 5 * len(own & held) >= 4 * len(own):
                expected.append((t_id, k, len(own), len(own & held), t))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(r)[:4] for r in dc.op1(d, b).collect()]
    assert expected and sorted(got, key=key) == sorted([r[:4] for r in expected], key=key)
    left = dc.remove_leaks(d, b)
    bad = {(r[0], r[4]) for r in expected}
    assert {(None, items[20][1]), (903, "solitary"), (902, "alpha, beta gamma: delta e f")} <= bad
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=key)
    assert left.columns == d.columns and kept == sorted((x for x in docs if x not in bad), key=key) and (None, "a clean text of no id at all") in kept
    assert dc.op1(d.limit(0), b).count() == 0 and dc.op1(d, b.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    plan = dc.op1(d, d.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
