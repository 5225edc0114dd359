"""Secret scans by grammar inference.

Base formats give labelled credentials.  From all distinct ones of the corpus state
merging builds one probabilistic automaton for each kind, in rounds over the labels
(``learn``): states are merged whose frequencies of the next ``LOOK`` symbols agree
within a Hoeffding bound; of several such states that under which the merged one is
likeliest.  Every candidate is then scored by its format likelihood: its
log-likelihood under the automaton less that under a background model of ordinary
candidates, for each character.  The cut of a kind is set on all labels, each scored
without its own share in the counts: ``HELD_OUT_SHARE`` of them pass; if they lie
clear of ordinary candidates, the cut lies halfway, and it is never below zero.

Candidates are the maximal runs of letters, digits and ``+/_.=-``, and, where the run
itself does not pass, the runs of letters and digits in it, from the shortest length
learned of a kind.  Those that pass are spans of kind ``format``, whether or not they
touch a base span; ``n_new`` counts those that touch none.

Counts, models and cuts come from every label and every distinct ordinary candidate,
however long.  What the driver holds is bounded by the models, not by the corpus:
counts by state and symbol of at most ``STATES`` states a kind, and histograms of
scores in steps of ``STEP``.  Only a caller who asks ``fit`` for a ``size`` gets
models from samples; queries call ``fit_whole``, which has no such way.

Null and empty texts have no spans.  Spans are code points, end exclusive, and a
span of ``assign`` covers the whole match.  Texts are scanned whole.  Repeated
rows each get a row; extra columns are ignored; without any labelled credential
nothing is added.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.runtime import map_arrow, materialize, prepare, release

#: States of an automaton; beyond them a new one joins that which fits it best.
STATES = 64
#: Symbols ahead whose frequencies tell states apart.
LOOK = 4
#: Nats between two places where a cut may lie.
STEP = 2.0**-12
#: Distinct candidates, and their characters, that a task remembers to have given out.
SEEN = 1 << 16
SEEN_CHARS = 8 << 20
#: Of samples that a caller asks for: strings of each kind that set the cut, ordinary
#: candidates for the background and again for its scores, and the longest string.
HELD = 200
ORDINARY = 2000
FIT_CHARS = 4096
#: Share of the labels that pass, each scored without itself.
HELD_OUT_SHARE = 0.98
#: Share of the ordinary candidates that the cut is to lie above.
ORDINARY_SHARE = 0.999
#: Times that the background is learned again without what looks like a credential.
ROUNDS = 2
#: Confidence of the compatibility test.
ALPHA = 0.05
SMOOTHING = 1e-3

#: Fixed formats, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
PART = re.compile(r"[A-Za-z0-9]+")
#: Shortest credential of any base format.
LEAST = 12
ALPHABET = 68
END = ""
CLASSES = {"a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0": "0123456789", "+": "+/_.=-"}
TO_CLASS = str.maketrans({ch: c for c, letters in CLASSES.items() for ch in letters})

Span = tuple[str, int, int]


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Spans ``(kind, start, end, credential)`` of the fixed formats.

    A maximal hexadecimal run, or the rest of a run after ``AKIA``, is one
    match whatever its length, so asking for the length at once drops the
    same matches; ``assign`` has to be matched first and judged afterwards.
    """
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return found


class Automaton:
    """A probabilistic automaton from labelled strings by state merging."""

    def __init__(self, strings: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        for s in sorted(strings):
            at = 0
            for ch in s:
                self.count[at][ch] = self.count[at].get(ch, 0) + 1
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                at = self.next[at][ch]
            self.count[at][END] = self.count[at].get(END, 0) + 1
        self._merge()
        self._score = [self._logs(c) for c in self.count]

    @classmethod
    def of(cls, steps: list[dict[str, int]], count: list[dict[str, int]]) -> Automaton:
        """The automaton with these transitions and frequencies."""
        out = cls.__new__(cls)
        out.next, out.count = steps, count
        out._score = [cls._logs(c) for c in count]
        return out

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = self.count[a], self.count[b]
            n, m = sum(x.values()), sum(y.values())
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound < 1 and any(abs(x.get(k, 0) / n - y.get(k, 0) / m) > bound for k in x.keys() | y.keys()):
                return False
            todo += [(self.next[a][k], self.next[b][k]) for k in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to the automaton at ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for k, n in self.count[b].items():
                self.count[a][k] = self.count[a].get(k, 0) + n
            for k, child in self.next[b].items():
                if k in self.next[a]:
                    todo.append((self.next[a][k], child))
                else:
                    self.next[a][k] = child

    def _merge(self) -> None:
        red = [0]
        while True:
            edges = [(r, k) for r in red for k in sorted(self.next[r]) if self.next[r][k] not in red]
            if not edges:
                break
            # the heaviest state first: its frequencies are the surest
            r, k = max(edges, key=lambda e: (self.count[e[0]].get(e[1], 0), -red.index(e[0]), e[1]))
            blue = self.next[r][k]
            alike = [q for q in red if self._compatible(q, blue)]
            if alike:
                q = max(alike, key=lambda q: self._fit(q, blue))
                self.next[r][k] = q
                self._fold(q, blue)
            else:
                red.append(blue)

    def _fit(self, a: int, b: int) -> float:
        """Log-likelihood under ``a`` of what follows ``b``."""
        logs, never = self._logs(self.count[a]), math.log(SMOOTHING)
        return sum(n * logs.get(k, never) for k, n in sorted(self.count[b].items()))

    @staticmethod
    def _logs(count: dict[str, int]) -> dict[str, float]:
        n = sum(count.values())
        return {k: math.log((v + SMOOTHING) / (n + SMOOTHING * (ALPHABET + 1))) for k, v in count.items()}

    def likelihood(self, s: str) -> float:
        """Log-likelihood of ``s``, its end included.  A character that a state
        never saw costs the smoothing and leaves the state as it is."""
        at, total = 0, 0.0
        never = math.log(SMOOTHING / (1 + SMOOTHING * (ALPHABET + 1)))
        for ch in s:
            total += self._score[at].get(ch, never)
            at = self.next[at].get(ch, at)
        return total + self._score[at].get(END, never)

    def likelihood_without(self, s: str) -> float:
        """Log-likelihood of ``s``, one of the strings learned from, under the
        frequencies of all others."""
        at, own = 0, Counter()
        for ch in s:
            own[at, ch] += 1
            at = self.next[at][ch]
        own[at, END] += 1
        visits: dict[int, int] = {}
        for (q, _), n in own.items():
            visits[q] = visits.get(q, 0) + n
        size = {q: sum(self.count[q].values()) - n for q, n in visits.items()}
        never = math.log(SMOOTHING / (1 + SMOOTHING * (ALPHABET + 1)))
        log = lambda q, left: math.log((left + SMOOTHING) / (size[q] + SMOOTHING * (ALPHABET + 1))) if left else never
        return sum(n * log(q, self.count[q][k] - n) for (q, k), n in own.items())


class Background:
    """Ordinary candidates: a chain of character classes, and how often each
    character stands for its class."""

    def __init__(self, strings: Iterable[str] = (), counts: dict[tuple[str, str], int] | None = None):
        of = {ch: c for c, letters in CLASSES.items() for ch in letters}
        counts = self.tally(strings) if counts is None else counts
        moves = {(a, b): counts.get((a, b), 0) + 0.5 for a in [END, *CLASSES] for b in [END, *CLASSES]}
        letters = {ch: counts.get(("letter", ch), 0) + 0.5 for ch in of}
        total = {a: sum(moves[a, b] for b in [END, *CLASSES]) for a in [END, *CLASSES]}
        step = {k: math.log(n / total[k[0]]) for k, n in moves.items()}
        size = {c: sum(letters[ch] for ch in group) for c, group in CLASSES.items()}
        self._class = of
        self._step = {(a, ch): step[a, of[ch]] + math.log(letters[ch] / size[of[ch]]) for a in [END, *CLASSES] for ch in of}
        self._end = {a: step[a, END] for a in [END, *CLASSES]}

    @staticmethod
    def tally(strings: Iterable[str]) -> Counter:
        """How often classes follow each other and letters occur; sums add up."""
        out: Counter = Counter()
        for s in strings:
            chain = s.translate(TO_CLASS)
            out.update(zip(chain, chain[1:]))
            out[END, chain[0]] += 1
            out[chain[-1], END] += 1
            out.update(zip(["letter"] * len(s), s))
        return out

    def likelihood(self, s: str) -> float:
        last, total = END, 0.0
        for ch in s:
            total += self._step[last, ch]
            last = self._class[ch]
        return total + self._end[last]


def _quantile(values: list[float], share: float) -> float:
    """The value that ``share`` of the values do not exceed."""
    return sorted(values)[min(len(values) - 1, max(0, math.ceil(share * len(values)) - 1))]


class Detector:
    """One automaton, shortest length and cut for each kind."""

    def __init__(self, labels: dict[str, list[str]], held: dict[str, list[str]], ordinary: list[str], others: list[str]):
        self.automata = {k: Automaton(labels[k]) for k in sorted(labels) if labels[k]}
        self.shortest = {k: min(map(len, labels[k])) for k in self.automata}
        self.least = min(self.shortest.values(), default=0)
        self.background = Background(ordinary)
        for _ in range(ROUNDS):
            # credentials that nobody labelled are no part of the background
            self.background = Background(filter(self.is_ordinary, ordinary))
        self.cuts = {}
        for k in self.automata:
            low = _quantile([self.score(k, s) for s in held.get(k) or labels[k]], 1 - HELD_OUT_SHARE)
            common = [self.score(k, s) for s in others if len(s) >= self.shortest[k]]
            high = _quantile(common, ORDINARY_SHARE) if common else 0.0
            self.cuts[k] = self.cut(low, high)

    @classmethod
    def of(cls, automata: dict[str, Automaton], shortest: dict[str, int], background: Background) -> Detector:
        """A detector of these models, whose cuts are still to be set."""
        out = cls.__new__(cls)
        out.automata, out.shortest, out.background, out.cuts = automata, shortest, background, {}
        out.least = min(shortest.values(), default=0)
        return out

    @staticmethod
    def cut(low: float, high: float) -> float:
        return max(0.0, min(low, (low + high) / 2))

    def is_ordinary(self, s: str) -> bool:
        """Whether no format beats the background."""
        ordinary = self.background.likelihood(s)
        return not any(len(s) >= self.shortest[k] and a.likelihood(s) > ordinary for k, a in self.automata.items())

    def score_without(self, kind: str, s: str) -> float:
        """``score`` of a label, without its own share in the automaton."""
        return (self.automata[kind].likelihood_without(s) - self.background.likelihood(s)) / (len(s) + 1)

    def score(self, kind: str, s: str) -> float:
        """Nats a character, end included, by which the format beats the background."""
        return (self.automata[kind].likelihood(s) - self.background.likelihood(s)) / (len(s) + 1)

    def accepts(self, s: str) -> bool:
        return any(len(s) >= self.shortest[k] and self.score(k, s) >= self.cuts[k] for k in self.automata)

    def find(self, text: str, known: dict[str, bool] | None = None) -> list[Span]:
        """Spans of the candidates that pass; ``known`` keeps verdicts."""
        known = {} if known is None else known

        def passes(s: str) -> bool:
            if s not in known:
                known[s] = self.accepts(s)
            return known[s]

        out: list[Span] = []
        for m in RUN.finditer(text) if self.automata else ():
            if m.end() - m.start() < self.least:
                continue
            if passes(m[0]):
                out.append(("format", m.start(), m.end()))
            elif not m[0].isalnum():
                out += [("format", p.start(), p.end()) for p in PART.finditer(text, m.start(), m.end()) if p.end() - p.start() >= self.least and passes(p[0])]
        return out


def _touching(found: list[Span], base: list[Span]) -> list[bool]:
    """Whether each span of ``found``, in order, shares a character with ``base``."""
    out, at, reach = [], 0, -1
    taken = sorted(base, key=lambda s: s[1])
    for _, a, b in found:
        while at < len(taken) and taken[at][1] < b:
            reach = max(reach, taken[at][2])
            at += 1
        out.append(reach > a)
    return out


def _key(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode()) - (1 << 63)


def _candidates(text: str | None) -> Iterator[tuple[str, str]]:
    """Labels of a text by kind, and its other runs as ``ordinary``."""
    base = base_spans(text or "")
    yield from ((k, s) for k, _, _, s in base)
    runs = [("ordinary", m.start(), m.end()) for m in RUN.finditer(text or "") if m.end() - m.start() >= LEAST]
    for (k, a, b), hit in zip(runs, _touching(runs, [x[:3] for x in base])):
        if not hit:
            yield k, text[a:b]


def _samples(size: dict[str, int]):
    """Of each role the strings with the smallest hashes in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        best: dict[str, dict[str, int]] = {}

        def cut(role: str) -> None:
            held = best[role]
            best[role] = dict(sorted(held.items(), key=lambda x: (x[1], x[0]))[: size[role.partition("-")[2]]])

        def add(kind: str, value: str) -> None:
            if len(value) <= FIT_CHARS:
                role = f"{kind}-{'held' if xxhash.xxh64_intdigest(value.encode(), 1) % 3 == 0 else 'fit'}"
                if kind == "ordinary":
                    role = role.replace("fit", "few").replace("held", "few2")
                held = best.setdefault(role, {})
                held[value] = _key(value)
                if len(held) > 2 * size[role.partition("-")[2]] + 64:
                    cut(role)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for k, value in _candidates(text):
                    add(k, value)
        rows = []
        for role in best:
            cut(role)
            rows += [(role, h, v) for v, h in best[role].items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=["role", "h", "value"])

    return run


def _sampled(docs: DataFrame, size: int) -> Detector:
    """Learn from bounded samples of the whole corpus: of each kind the strings
    with the smallest hashes, in tasks, in groups of tasks and then of all."""
    sizes = {"fit": size, "held": HELD, "few": ORDINARY, "few2": ORDINARY}
    found = docs.select("text").mapInArrow(_samples(sizes), "role string, h long, value string").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(1024)))
    bound = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(v))])[F.substring_index("role", "-", -1)]
    for keys in (["role", "part"], ["role"]):
        # a repeated string takes one rank
        place = F.dense_rank().over(W.partitionBy(*keys).orderBy("h", "value"))
        found = found.select(*keys, "h", "value").distinct().withColumn("place", place).where(F.col("place") <= max(sizes.values()))
        found = found.where(F.col("place") <= bound)
    by: dict[str, list[str]] = {}
    for r in found.select("role", "value").distinct().collect():
        by.setdefault(r["role"], []).append(r["value"])
    take = lambda role: {k: sorted(by.get(f"{k}-{role}", [])) for k in KINDS[:3]}
    return Detector(take("fit"), take("held"), by.get("ordinary-few", []), by.get("ordinary-few2", []))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Candidates of texts, most repetitions within a task left out."""
    seen: set[tuple[str, str]] = set()
    chars = 0
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            for row in _candidates(text):
                if row not in seen:
                    if len(seen) >= SEEN or chars + len(row[1]) > SEEN_CHARS:
                        seen, chars = set(), 0
                    seen.add(row)
                    chars += len(row[1])
                    rows.append(row)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["kind", "value"])


def _summed(rows: DataFrame, tally: Callable[[str, list[str]], dict[tuple, int]], key: str) -> list:
    """Counts that ``tally`` gives for the strings of each kind, summed over all
    of ``rows``; they and the columns of ``key`` are what reaches the driver."""
    schema = f"{key}, n long"
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total: dict[tuple, int] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(kind, []).append(value)
            for kind, values in by.items():
                for k, n in tally(kind, values).items():
                    total[k] = total.get(k, 0) + n
        if total:
            columns = zip(*[(*k, n) for k, n in total.items()])
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])

    out = rows.select("kind", "value").mapInArrow(run, schema)
    return out.groupBy(*[f for f, _ in fields[:-1]]).agg(F.sum("n").alias("n")).collect()


Ahead = list[dict[str, int]]


def _walk(steps: dict[str, list[dict[str, int]]]) -> Callable[[str, list[str]], dict[tuple, int]]:
    """Frequencies of the symbols 1 to ``LOOK`` places ahead, for each state that
    strings pass and for the edge, if any, at which they leave the automaton."""

    def tally(kind: str, values: list[str]) -> dict[tuple, int]:
        out: dict[tuple, int] = {}
        own = steps[kind]
        for s in values:
            symbols, at = [*s, *[END] * LOOK], 0
            for i in range(len(s) + 1):
                to = own[at].get(symbols[i]) if i < len(s) else at
                places = [(at, "", i)] if to is not None else [(at, "", i), (at, symbols[i], i + 1)]
                for state, edge, begin in places:
                    for place in range(LOOK):
                        symbol = symbols[begin + place] if begin + place < len(symbols) else END
                        k = (kind, state, edge, place, symbol)
                        out[k] = out.get(k, 0) + 1
                if to is None:
                    break
                at = to
        return out

    return tally


def _agree(x: Ahead, y: Ahead) -> bool:
    n, m = sum(x[0].values()), sum(y[0].values())
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    return bound >= 1 or all(abs(a.get(k, 0) / n - b.get(k, 0) / m) <= bound for a, b in zip(x, y) for k in a.keys() | b.keys())


def _extend(steps: list[dict[str, int]], states: list[Ahead], edges: dict[tuple[int, str], Ahead]) -> None:
    """Lead each edge to the state that it agrees with and that makes what follows
    likeliest, or else to a new state; the heaviest first."""
    never = math.log(SMOOTHING)
    for r, ch in sorted(edges, key=lambda e: (-sum(edges[e][0].values()), e)):
        new = edges[r, ch]
        alike = [q for q, ahead in enumerate(states) if _agree(ahead, new)]
        if not alike and len(states) < STATES:
            steps[r][ch] = len(states)
            steps.append({})
            states.append(new)
            continue
        scores = {}
        for q in alike or range(len(states)):
            logs = Automaton._logs(states[q][0])
            scores[q] = sum(n * logs.get(k, never) for k, n in sorted(new[0].items()))
        q = max(scores, key=lambda q: (scores[q], -q))
        steps[r][ch] = q
        states[q] = [{k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()} for a, b in zip(states[q], new)]


def learn(labels: DataFrame) -> dict[str, Automaton]:
    """Automata of ``(kind, value)`` from all rows.  In each round every string goes
    from the start as far as the automaton leads; edges at which strings leave are
    merged or get states.  In the last round none leaves, so its frequencies count
    every character."""
    steps: dict[str, list[dict[str, int]]] = {k: [{}] for k in KINDS[:3]}
    while True:
        seen: dict[tuple[str, int, str], Ahead] = {}
        for r in _summed(labels, _walk(steps), "kind string, state int, edge string, place int, symbol string"):
            seen.setdefault((r["kind"], r["state"], r["edge"]), [{} for _ in range(LOOK)])[r["place"]][r["symbol"]] = r["n"]
        done = True
        for kind in sorted({k for k, _, _ in seen}):
            edges = {(q, e): ahead for (k, q, e), ahead in seen.items() if k == kind and e}
            if edges:
                done = False
                _extend(steps[kind], [seen[kind, q, ""] for q in range(len(steps[kind]))], edges)
        if done:
            return {k: Automaton.of(steps[k], [seen[k, q, ""][0] for q in range(len(steps[k]))]) for k in KINDS[:3] if (k, 0, "") in seen}


def _at_share(bins: dict[int, int], share: float) -> float:
    """``_quantile`` of the scores in a histogram."""
    left = max(1, math.ceil(share * sum(bins.values())))
    for b in sorted(bins):
        left -= bins[b]
        if left <= 0:
            return b * STEP
    raise ValueError("no scores")


def fit(docs: DataFrame, size: int | None = None) -> Detector:
    """``fit_whole``, or, for a caller who gives a ``size``, learn from samples."""
    prepare(docs.sparkSession)
    return fit_whole(docs) if size is None else _sampled(docs, size)


def fit_whole(docs: DataFrame) -> Detector:
    """Learn from all candidates of the corpus, each distinct one once."""
    prepare(docs.sparkSession)
    found = materialize(docs.select("text").mapInArrow(_distinct, "kind string, value string").distinct(), "candidates")
    labels = materialize(found.where("kind <> 'ordinary'"), "labels")
    ordinary = found.where("kind = 'ordinary'")
    shortest = {r["kind"]: r["n"] for r in labels.groupBy("kind").agg(F.min(F.length("value")).alias("n")).collect()}
    detector = Detector.of(learn(labels) if shortest else {}, shortest, Background())
    if shortest:
        for i in range(ROUNDS + 1):
            # after the first time, credentials that nobody labelled are no part of the background
            usual = detector.is_ordinary if i else lambda s: True
            counts = _summed(ordinary, lambda _, values: Background.tally(filter(usual, values)), "a string, b string")  # noqa: B023
            detector = Detector.of(detector.automata, shortest, Background(counts={(r["a"], r["b"]): r["n"] for r in counts}))

        def scores(kind: str, values: list[str]) -> Counter:
            if kind != "ordinary":
                return Counter((kind, "label", math.floor(detector.score_without(kind, s) / STEP)) for s in values)
            return Counter((k, kind, math.floor(detector.score(k, s) / STEP)) for s in values for k in detector.automata if len(s) >= shortest[k])

        bins: dict[tuple[str, str], dict[int, int]] = {}
        for r in _summed(found, scores, "kind string, role string, bin long"):
            bins.setdefault((r["kind"], r["role"]), {})[r["bin"]] = r["n"]
        cuts = {}
        for k in detector.automata:
            common = bins.get((k, "ordinary"))
            cuts[k] = Detector.cut(_at_share(bins[k, "label"], 1 - HELD_OUT_SHARE), _at_share(common, ORDINARY_SHARE) if common else 0.0)
        detector.cuts = cuts
    release(found, labels)
    return detector


def spans(text: str | None, detector: Detector | None, known: dict[str, bool] | None = None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, each in order."""
    base = [x[:3] for x in base_spans(text or "")]
    extra = detector.find(text, known) if detector and text else []
    key = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=key), sorted(base + extra, key=key)


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str, found: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with each maximal run of spans replaced by ``mark``."""
    out, at, reach = [], 0, 0
    for _, a, b in sorted(found, key=lambda s: s[1:]):
        if a >= reach:
            out += [text[at:a], mark]
        reach = at = max(reach, b)
    return "".join(out) + text[at:] if out else text


def scan(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format, n_new)``."""
    prepare(docs.sparkSession)
    detector = fit_whole(docs) if detector is None else detector
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format", "n_new"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[str, bool] = {}
        found = [spans(t, detector, known) for t in batch.column(1).to_pylist()]
        n = lambda k: pa.array([sum(s[0] == k for s in every) for _, every in found], pa.int64())
        digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
        lists = pa.array([joined(every) for _, every in found], pa.string())
        new = pa.array([_touching([s for s in every if s[0] == "format"], base).count(False) for base, every in found], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), n("assign"), n("access"), n("hex"), digests, lists, n("format"), new], names=names)

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, n_new long")


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; secrets in ``text`` are replaced by a
    mark, and ``n_chars``, if there is one, counts the new text."""
    prepare(docs.sparkSession)
    detector = fit_whole(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, bool] = {}
            texts = [t and redact(t, spans(t, detector, known)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def op3(docs: DataFrame) -> DataFrame:
    return scan(docs)
