import math
import re

from stratalens.llm import pii
from tests.llm.test_pii import slow_base

TERM = re.compile(r"[^\W_]+")


def value(kind, v):
    return f"{kind}:" + (v.lower() if kind == "email" else v if kind == "ip" else re.sub("[^0-9]", "", v))


def lower(s):
    return "".join(c.lower() if len(c.lower()) == 1 else "i" for c in s)


def wilson(j, n):
    """The smaller root of (j/n - p)^2 = z^2 p (1 - p) / n."""
    a, b, c = 1 + pii.Z**2 / n, -(2 * j / n + pii.Z**2 / n), (j / n) ** 2
    return (-b - math.sqrt(b * b - 4 * a * c)) / (2 * a)


def slow_terms(texts):
    """Spans and actions of each text, every pair counted over documents."""
    base = {t: slow_base(t) for t in texts}
    places = {t: [(lower(m[0]), *m.span()) for m in TERM.finditer(t) if not any(p < m.end() and m.start() < q for _, p, q, _ in base[t])] for t in base}
    entities, both, standing = {}, {}, {}
    for t in texts:
        own = {value(k, v) for k, _, _, v in base[t]}
        for e in own:
            entities[e] = entities.get(e, 0) + 1
        for w in {w for w, _, _ in places[t]}:
            for e in own:
                both[e, w] = both.get((e, w), 0) + 1
        for w in {lower(m[0]) for m in TERM.finditer(t)}:
            standing[w] = standing.get(w, 0) + 1
    action = {}
    for (e, w), n in both.items():
        known = math.log(len(texts) / entities[e])
        share = math.log(len(texts) * wilson(n, standing[w]) / entities[e]) / known if known else 0
        if share > pii.GENERALISE:
            action[w] = max(action.get(w, ""), "remove" if share > pii.REMOVE else "generalise")
    return {t: [(a, b, action[w]) for w, a, b in places[t] if w in action] for t in base}


def corpus():
    far = "plain words that fill the page " * 8
    rows = [f"Zebranius of Northwick. {far} {i} write to zeb@lab.example.com. {far} signed Zebranius" for i in range(6)]
    rows += [f"{far} nothing {i % 70}" for i in range(950)]
    rows += ["only zebranius here, İstanbul, and Zebranius again", "éZebraniuszeb@lab.example.com Zebranius zebranius_x Zebraniusx", rows[0], rows[0]]
    rows += ["İİİ quaternix contact one@only.example.com or two@only.example.com, zeb@lab.example.com", "x 10.0.0.1 hapaxium"]
    return rows + [f"call +1 (626) 555-3296 {far} Quillon {i} +4111 1111 1111 1111 mr Li" for i in range(4)]


def test_terms_count_and_go_in_whole_documents(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash", i % 3) for i, t in enumerate(texts)] + [(900000, None, "", 1), (900001, "", "", 1)], "doc_id long, text string, terms string, _pii_row int")
    expected = slow_terms([*texts, ""])
    for bound in (pii_rows := (200_000, 0)):
        monkeypatch.setattr("stratalens.runtime.BROADCAST_ROWS", bound)
        got = {r.doc_id: r for r in pii.op8(df).collect()}
        assert len(got) == len(texts) + 2 and got[900000].n_term == got[900001].n_term == 0
        for i, t in enumerate(texts):
            listed = [f"{k}:{a}:{b}" for k, a, b, _ in slow_base(t)] + [f"term:{a}:{b}" for a, b, _ in expected[t]]
            assert got[i].spans == ",".join(listed), t
            assert got[i].n_base == len(slow_base(t))
    assert pii_rows[1] == 0
    only = texts.index("only zebranius here, İstanbul, and Zebranius again")
    assert len(expected[texts[0]]) > 2 and len(expected[texts[only]]) == 2
    assert all(any(t[a:b] == w for a, b, _ in expected[t]) for w, t in (("quaternix", texts[960]), ("hapaxium", texts[961]), ("Li", texts[-1])))
    assert {x for t in expected for _, _, x in expected[t]} == {"remove", "generalise"}
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zebranius" not in clean[0].lower() and "zebranius" not in clean[only].lower() and "Quillon" not in clean[len(texts) - 1]


def test_bound():
    for n in (1, 2, 7, 100):
        for j in range(n + 1):
            assert 0 <= wilson(j, n) + 1e-12 and wilson(j, n) <= j / n + 1e-12
