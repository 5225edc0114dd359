import hashlib
import random
import re

from stratalens.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def good(kind, s):
    digits = re.sub(r"[^0-9]", "", s)
    return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def slow_base(text):
    return [(k, m.start(), m.end(), m[0]) for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if good(k, m[0])]


def random_text(rng):
    bits = ["a@b.c", "@", ".", "x.y_z@m-1.example.com", "-", "+1 (626) 555-3296", "+", "1.2.3.4", "256.1.1.1", "0099.1.2.3", ".5", "4524132264652876", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "1", "12", "(", ")", "é", "\n", "word", "\U0001f600", "_", "%"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))


def test_base_matches_definition(spark):
    rng = random.Random(7)
    rows = [(i, random_text(rng)) for i in range(600)]
    rows += [(3000, None), (3001, ""), (None, "me@x.yz"), (3002, "a" * 50000 + " " + "1" * 50000 + " +" + "1" * 5000), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, spans string")
    found = pii.op8(df).collect()
    assert len(found) == len(rows)
    expected = []
    for i, t in rows:
        base = slow_base(t)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in base)
        expected.append((i, *(sum(s[0] == k for s in base) for k in PLAIN), hashlib.sha256(listed.encode()).hexdigest(), listed))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    own = [(*tuple(r)[:6], ",".join(x for x in r.spans.split(",") if not x.startswith("term"))) for r in found]
    assert sorted(own, key=key) == sorted(expected, key=key)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[3000] is None and clean[3001] == "" and clean[None] == "<EMAIL>"
    assert pii.op8(df.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    plan = pii.op8(spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
