import hashlib
import math
import random
import re

import pytest
import xxhash

from stratalens.llm import secrets

PATTERNS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def slow_base(text):
    out = []
    for k, (p, good) in PATTERNS.items():
        out += [(k, m.start(), m.end()) for m in re.finditer(p, text or "") if good(m)]
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def random_text(rng):
    bits = ["token", "Secret=", "api_key: '", "APIKEY", "passwd =", "password", "ſecret=", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", " ", "=", ":", '"', "'", "\n", "é", "zz", "Ab+/", "KEN", "toKen=abcdefghijklmnop"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))


def test_base_matches_definition():
    rng = random.Random(3)
    for _ in range(3000):
        t = random_text(rng)
        assert [x[:3] for x in sorted(secrets.base_spans(t), key=lambda s: (s[1], secrets.KINDS.index(s[0])))] == slow_base(t)


def slow_automaton(strings):
    """State merging written down once more: states are the prefixes."""
    count, parent_order = {"": {}}, [""]
    for s in sorted(strings):
        for i in range(len(s) + 1):
            p = s[:i]
            if p not in count:
                count[p] = {}
                parent_order.append(p)
            sym = s[i] if i < len(s) else None
            count[p][sym] = count[p].get(sym, 0) + 1
    step = {p: {} for p in count}
    for p in parent_order[1:]:
        step[p[:-1]][p[-1]] = p

    def alike(a, b):
        n, m = sum(count[a].values()), sum(count[b].values())
        if n and m:
            bound = math.sqrt(0.5 * math.log(2 / secrets.ALPHA)) * (n**-0.5 + m**-0.5)
            if bound < 1 and any(abs(count[a].get(k, 0) / n - count[b].get(k, 0) / m) > bound for k in {*count[a], *count[b]}):
                return False
            return all(alike(step[a][k], step[b][k]) for k in step[a] if k in step[b])
        return True

    def fold(a, b):
        for k, n in count[b].items():
            count[a][k] = count[a].get(k, 0) + n
        for k, child in step[b].items():
            if k in step[a]:
                fold(step[a][k], child)
            else:
                step[a][k] = child

    red = [""]
    while True:
        blue = [(count[r].get(k, 0), -i, k, r) for i, r in enumerate(red) for k in step[r] if step[r][k] not in red]
        if not blue:
            break
        _, _, k, r = max(blue)
        new = step[r][k]
        home, best = None, None
        for q in red:
            if alike(q, new):
                n, e = sum(count[q].values()), secrets.SMOOTHING
                fit = sum(c * (math.log((count[q][x] + e) / (n + e * (secrets.ALPHABET + 1))) if x in count[q] else math.log(e)) for x, c in sorted(count[new].items(), key=lambda y: y[0] or ""))
                if best is None or fit > best:
                    home, best = q, fit
        if home is None:
            red.append(new)
        else:
            step[r][k] = home
            fold(home, new)

    def likelihood(s):
        at, out = "", 0.0
        for i in range(len(s) + 1):
            sym = s[i] if i < len(s) else None
            n, e = sum(count[at].values()), secrets.SMOOTHING
            out += math.log((count[at][sym] + e) / (n + e * (secrets.ALPHABET + 1))) if sym in count[at] else math.log(e / (1 + e * (secrets.ALPHABET + 1)))
            at = step[at].get(sym, at)
        return out

    return likelihood


def draw(rng, letters, n, head=""):
    return head + "".join(rng.choice(letters) for _ in range(n))


BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_automaton_matches_plain_state_merging():
    rng = random.Random(14)
    for letters, n, head in (("0123456789abcdef", 20, ""), ("ABCDEFGHIJ", 6, "AK"), ("ab", 9, "x-"), (BASE62, 12, "ghp_")):
        strings = [draw(rng, letters, n + rng.randint(0, 1), head) for _ in range(60)]
        fast, slow = secrets.Automaton(strings), slow_automaton(strings)
        for s in strings[:20] + [draw(rng, letters, n, head) for _ in range(20)] + ["", head, "zzz", "AKAKAK", strings[0] * 2]:
            assert math.isclose(fast.likelihood(s), slow(s), rel_tol=1e-9, abs_tol=1e-9), s


WORDS = ["Ununterbrochenheit", "internationalization", "donaudampfschiff", "well-known-example", "documentation", "src/main/index.html", "www.example.com/path", "Strassenbahnhaltestelle", "configuration_value", "2024-01-15T10-00-00"]


@pytest.mark.parametrize("letters, n, head", [(BASE62, 24, ""), (BASE62, 36, "ghp_"), ("abcdefghijklmnopqrstuvwxyz0123456789", 20, ""), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32, "")])
def test_held_out_credentials_are_found(spark, letters, n, head):
    rng = random.Random(15)
    say = lambda: " ".join(rng.choice(WORDS + ["the", "and", draw(rng, "abcdefghiklmnoprstu", rng.randint(3, 17))]) for _ in range(40))
    rows = [(i, f'{say()} token = "{draw(rng, letters, n, head)}" {say()}') for i in range(300)]
    bare = {1000 + i: draw(rng, letters, n, head) for i in range(100)}
    rows += [(i, f"{say()} ({s}) {say()}") for i, s in bare.items()]
    rows += [(5000 + i, say()) for i in range(200)]
    got = {r.doc_id: r for r in secrets.op3(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    hit = sum(f"format:{text[i].index(s)}:{text[i].index(s) + len(s)}" in got[i].spans for i, s in bare.items())
    assert hit >= 90 and sum(got[i].n_new > 0 for i in bare) >= 90
    assert sum(got[5000 + i].n_format for i in range(200)) <= 40  # of 8,000 words


def test_spans_match_brute_force(spark):
    rng = random.Random(16)
    labels = [draw(rng, BASE62, 20) for _ in range(120)]
    detector = secrets.Detector({"assign": labels[:90], "hex": [draw(rng, "0123456789abcdef", 16) for _ in range(50)]}, {"assign": labels[90:]}, WORDS * 20, WORDS)
    for _ in range(300):
        t = random_text(rng) + rng.choice(["", "=", " ", "."]) + draw(rng, BASE62, rng.randint(8, 24)) + rng.choice(["", "=", "é", ". "]) + rng.choice(WORDS) + random_text(rng)
        expected = []
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", t):
            good = lambda s: any(len(s) >= detector.shortest[k] and detector.score(k, s) >= detector.cuts[k] for k in detector.cuts)
            if good(m[0]):
                expected.append(("format", *m.span()))
            else:
                expected += [("format", p.start() + m.start(), p.end() + m.start()) for p in re.finditer("[A-Za-z0-9]+", m[0]) if good(p[0])]
        base, every = secrets.spans(t, detector)
        assert base == slow_base(t) and [s for s in every if s[0] == "format"] == expected


def test_samples_are_the_smallest_hashes(spark):
    rng = random.Random(17)
    docs = spark.createDataFrame([(f"token={draw(rng, BASE62, 20)} {draw(rng, 'abcdefgh', 14)}",) for _ in range(400)] * 2, "text string").repartition(7)
    texts = {r.text for r in docs.collect()}
    labels = {k: {s for t in texts for kind, _, _, s in secrets.base_spans(t) if kind == k} for k in secrets.KINDS[:3]}
    detector = secrets.fit(docs, size=40)
    first = [s for s in sorted(labels["assign"], key=secrets._key) if xxhash.xxh64_intdigest(s.encode(), 1) % 3]
    assert math.isclose(detector.automata["assign"].likelihood(first[0]), secrets.Automaton(first[:40]).likelihood(first[0]))


def test_models_and_cuts_come_from_the_whole_corpus(spark):
    rng = random.Random(18)
    say = lambda: " ".join(rng.choice([rng.choice(WORDS), draw(rng, "abcdefghiklmnoprstu", rng.randint(12, 17))]) for _ in range(6))
    texts = [f"{say()} token={draw(rng, BASE62, 20)} {say()} {draw(rng, '0123456789abcdef', 24)} x" for _ in range(700)]
    texts += [f"{say()} secret: {draw(rng, BASE62, 30, 'ghp_')} AKIA{draw(rng, 'ABCDEFGH234', 16)}" for _ in range(250)] + [f"token={draw(rng, BASE62, 6000)}", None, ""]
    detector = secrets.fit(spark.createDataFrame([(t,) for t in texts] * 2, "text string").repartition(7))
    labels = {k: {s for t in texts for kind, _, _, s in secrets.base_spans(t or "") if kind == k} for k in secrets.KINDS[:3]}
    ordinary = {s for t in texts for m in re.finditer(r"[A-Za-z0-9+/_.=-]{12,}", t or "") for s in [m[0]] if not any(a < m.end() and m.start() < b for _, a, b, _ in secrets.base_spans(t))}
    assert len(labels["assign"]) == 951 and len(labels["hex"]) >= 700 and len(labels["access"]) == 250 and len(ordinary) > 2000

    def walk(a, strings):
        count = [{} for _ in a.count]
        for s in strings:
            at = 0
            for ch in [*s, ""]:
                count[at][ch] = count[at].get(ch, 0) + 1
                at = a.next[at][ch] if ch else at
        return count

    background = secrets.Background(ordinary)
    for _ in range(secrets.ROUNDS):
        beaten = lambda s: any(len(s) >= detector.shortest[k] and a.likelihood(s) > background.likelihood(s) for k, a in detector.automata.items())  # noqa: B023, E731
        background = secrets.Background([s for s in ordinary if not beaten(s)])
    for k, a in detector.automata.items():
        assert a.count == walk(a, labels[k]) and detector.shortest[k] == min(map(len, labels[k]))
        held = []
        for s in sorted(labels[k]):
            rest = [{c: n - w.get(c, 0) for c, n in x.items() if n > w.get(c, 0)} for x, w in zip(a.count, walk(a, [s]))]
            held.append((secrets.Automaton.of(a.next, rest).likelihood(s) - background.likelihood(s)) / (len(s) + 1))
            assert math.isclose(a.likelihood_without(s), secrets.Automaton.of(a.next, rest).likelihood(s), rel_tol=1e-9)
        low = secrets._quantile(held, 1 - secrets.HELD_OUT_SHARE)
        common = [(a.likelihood(s) - background.likelihood(s)) / (len(s) + 1) for s in ordinary if len(s) >= detector.shortest[k]]
        high = secrets._quantile(common, secrets.ORDINARY_SHARE) if common else 0.0
        assert abs(detector.cuts[k] - max(0.0, min(low, (low + high) / 2))) <= 2 * secrets.STEP, k
    assert set(detector.automata) == set(labels)


def test_long_credentials_are_learned_and_redacted(spark):
    """Labels of any length count, in the scan and in the pipeline's stage."""
    rng = random.Random(19)
    bare = [draw(rng, BASE62, 4500) for _ in range(5)]
    rows = [(i, f"some words token={draw(rng, BASE62, 4500)} more") for i in range(30)] + [(100 + i, f"{' '.join(WORDS)} ({s}) end") for i, s in enumerate(bare)]
    rows += [(200 + i, " ".join(draw(rng, "abcdefghiklmnoprstu", 14) for _ in range(40))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in secrets.op3(docs).collect() if r.n_new} == {100, 101, 102, 103, 104}
    clean = {r.doc_id: r.text for r in secrets.redact_documents(docs).collect()}
    assert all(clean[100 + i] == f"{' '.join(WORDS)} ([SECRET]) end" for i in range(5))


def test_query_and_redaction(spark):
    rng = random.Random(5)
    rows = [(i, random_text(rng), "x") for i in range(150)] + [(900, None, "x"), (901, "", "x"), (None, "token=abcdefabcdef123", "x"), (901, "", "x"), (902, "a1+" * 60000, "x")]
    rows += [(1000 + i, "key " + "".join(rng.choice("0123456789abcdef") for _ in range(24)) + " end", "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secrets.op3(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        base = slow_base(t)
        assert by[i].base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert set(secrets.joined(base).split(",")) <= set(by[i].spans.split(",")) | {""}
        assert (by[i].n_assign, by[i].n_access, by[i].n_hex) == tuple(sum(s[0] == k for s in base) for k in PATTERNS)
    clean = {r.doc_id: r.text for r in secrets.redact_documents(docs).collect()}
    assert clean[900] is None and clean[901] == "" and not any(slow_base(t) for t in clean.values())
    assert secrets.op3(docs.limit(0)).count() == 0


def test_redact():
    assert secrets.redact("abcdef", [("hex", 1, 3), ("assign", 2, 4)], "#") == "a#ef"
    assert secrets.redact("abc", []) == "abc"
