"""Information-theoretic sanitisation of personal data.

Base formats give the protected entities: e-mail addresses, IP addresses, card and
phone numbers.  Terms (runs of letters and digits) that stand in a document with an
entity, wherever in it, are weighed by what they reveal of it.  Over all N documents
that have a text, with ``df`` counting documents and ``p`` the lower end of the Wilson
interval (``Z``) for the share ``df(t with e) / df(t)`` of a term's documents that hold
the entity,

    PMI(t; e) = ln(N * p / df(e))     IC(e) = ln(N / df(e))

and ``PMI / IC`` is the share of the entity's information that the term gives away for
sure.  A term is generalised if that share exceeds ``GENERALISE`` and removed if it
exceeds ``REMOVE``, for the entity of which it reveals most.  That holds for each of
its occurrences in each document, with or without the entity; only a run of letters
and digits that reaches into a base span is no term.  No entity or term is exempt: a
rare one has a wide interval, and nothing else, in its favour.

In one text, entities that stand in no other text are alike to every term, and so is
a term that stands in no other text to every entity but for the entity's frequency;
one of each is weighed for all, so that pairs are made only of what recurs.

Only DataFrame functions run.  Matches get their places from the lengths of the
pieces between them.  Patterns are possessive, hence linear in long runs; they match what the plain ones match.

Null and empty texts have no spans.  Spans are code points, end exclusive.
Repeated rows each get a row, texts are searched whole, a null ``doc_id`` keeps its
row, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.runtime import broadcast_if_small, matching, materialize

KINDS = ("email", "ip", "card", "phone")
#: Pattern of each kind, and one that a text with a match must meet.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9]++(?:[\x20-][0-9]++)*+", r"(?:[0-9][\x20-]?){13}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
TERM = r"[\p{L}\p{N}]+"
#: Runs of the masked text; those with U+0001 reach into a base span.
RUN = r"[\p{L}\p{N}\x01]+"
#: Runs whose places are summed at a time.
BLOCK = 64
#: One-sided normal quantile of 95 %.
Z = 1.645
GENERALISE = 0.8
REMOVE = 0.9

_SPAN = "struct<start:int,end:int,value:string>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("value")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.aggregate(F.filter(steps, lambda x: x["value"].isNotNull()), zero, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(bare) > 3, False).otherwise(F.concat(F.lit("0"), bare).cast("int") <= 255)


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small),
    "card": lambda v: F.when(F.length(_digits(v)).between(13, 19), _luhn(v)).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def base_spans(text: str = "text") -> dict[str, Column]:
    """Spans of each kind, in order; an empty array for a null text."""
    def valid(kind: str, pattern: str) -> Column:
        return F.filter(matches(F.col(text), pattern), lambda s: _VALID[kind](s["value"]))

    out = {}
    for kind, (pattern, hint) in PATTERNS.items():
        may = F.col(text).contains(hint) if kind == "email" else F.col(text).rlike(hint)
        out[kind] = F.when(may, valid(kind, pattern)).otherwise(F.array().cast(f"array<{_SPAN}>"))
    return out


def _lower(text: Column) -> Column:
    """Lower case of the same length: only a dotted capital I would grow."""
    return F.lower(F.translate(text, "\u0130", "i"))


def _masked(spans: Column) -> Column:
    """``text`` in lower case, letters and digits in ``spans`` replaced by U+0001."""
    text = F.translate(F.col("text"), "\x01", " ")

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(s["start"], acc["at"])
        hidden = F.regexp_replace(F.substring(text, start + 1, s["end"] - start), "[A-Za-z0-9]", "\x01")
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"]), hidden)
        return F.when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), more.alias("out"))).otherwise(acc)

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return _lower(F.aggregate(F.array_sort(spans), zero, step, rest))


def _entities(kind: str) -> Column:
    """Spans of a kind with the value that makes equal entities equal."""
    plain = {"email": F.lower, "ip": lambda v: v, "card": _digits, "phone": _digits}[kind]
    return F.transform(F.col(kind), lambda s: F.struct(F.concat(F.lit(f"{kind}:"), plain(s["value"])).alias("entity"), s["start"].alias("start"), s["end"].alias("end")))


def _every() -> Column:
    """Base spans of all kinds as ``(start, end)``."""
    return F.concat(*[F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])


def detect(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """``(row, doc_id, text_hash, email, ip, card, phone, entities, words, carrier)``,
    written out; ``row`` numbers the rows if given.

    ``entities`` and ``words`` list the different entities and terms of a text
    with a base span, and ``carrier`` is that text."""
    number = F.monotonically_increasing_id() if row is None else row
    texts = docs.select("doc_id", "text", number.alias("row")).withColumns(base_spans())
    every = F.concat(*[_entities(k) for k in KINDS])
    texts = texts.withColumn("entities", F.when(F.size(every) > 0, F.array_distinct(F.transform(every, lambda s: s["entity"]))))
    runs = F.regexp_extract_all(_masked(_every()), F.lit(RUN), F.lit(0))
    words = F.array_distinct(F.filter(runs, lambda t: ~t.contains("\x01")))
    texts = texts.withColumn("words", F.when(F.col("entities").isNotNull(), words)).withColumn("carrier", F.when(F.col("entities").isNotNull(), F.col("text")))
    return materialize(texts.select("row", "doc_id", _hash().alias("text_hash"), *KINDS, "entities", "words", "carrier"), "pii")


def _hash() -> Column:
    return F.when(F.col("text").isNotNull(), F.xxhash64("text"))


def _words(docs: DataFrame) -> DataFrame:
    """``(text_hash, term)`` of every row, each term once."""
    terms = F.array_distinct(F.regexp_extract_all(_lower(F.col("text")), F.lit(TERM), F.lit(0)))
    return docs.where("text is not null").select(_hash().alias("text_hash"), F.explode(terms).alias("term"))


def carriers(found: DataFrame) -> DataFrame:
    """``(text_hash, m, entities, words, text)``: each text with a base span once,
    with the number of documents that hold it."""
    own = found.where("entities is not null").groupBy("text_hash").agg(F.count("*").alias("m"), F.first(F.struct("entities", "words", "carrier")).alias("c"))
    return materialize(own.select("text_hash", "m", "c.entities", "c.words", F.col("c.carrier").alias("text")), "carriers")


def sure_share(joint: Column, df_term: Column) -> Column:
    """Lower end of the Wilson interval for ``joint`` of ``df_term``."""
    p, z2 = joint / df_term, Z * Z
    return (p + z2 / (2 * df_term) - Z * F.sqrt(p * (1 - p) / df_term + z2 / (4 * df_term * df_term))) / (1 + z2 / df_term)


def disclosures(docs: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """``(term, action, outside)`` of the terms that exceed a threshold for some
    entity; ``outside`` tells whether the term stands in other texts, too."""
    total = F.lit(float(found.where("text_hash is not null").count()))
    entities = texts.select("m", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("m").alias("df_entity"))
    entities = broadcast_if_small(materialize(entities.where(F.col("df_entity") < total), "entities"))
    inside = texts.select("m", F.explode("words").alias("term")).groupBy("term").agg(F.sum("m").alias("inside"))
    # both sides are combined by term, so this join moves nothing further
    terms = _words(docs).groupBy("term").agg(F.count("*").alias("df_term")).join(inside.hint("merge"), "term")
    terms = materialize(terms, "terms")

    def share(joint: Column) -> Column:
        return F.log(total * sure_share(joint, F.col("df_term")) / F.col("df_entity")) / F.log(total / F.col("df_entity"))

    own = texts.select("text_hash", "m", F.explode("entities").alias("entity")).join(entities, "entity")
    # entities that stand in no other text: one speaks for all
    own = own.groupBy("text_hash", F.when(F.col("df_entity") > F.col("m"), F.col("entity")).alias("e")).agg(F.first(F.struct("df_entity", "entity")).alias("x"))
    own = own.groupBy("text_hash").agg(F.array_sort(F.collect_list("x")).alias("own"))
    own = broadcast_if_small(materialize(own, "own"))
    pairs = texts.select("text_hash", "m", F.explode("words").alias("term")).join(broadcast_if_small(terms), "term").join(own, "text_hash")
    # a term that stands in no other text reveals most of the rarest entity
    pairs = pairs.select("m", "term", "df_term", "inside", F.inline(F.when(F.col("df_term") == F.col("m"), F.slice("own", 1, 1)).otherwise(F.col("own"))))
    pairs = pairs.where(share(F.least("df_term", "df_entity")) > GENERALISE)
    joint = pairs.groupBy("entity", "term", "df_entity", "df_term", "inside").agg(F.sum("m").alias("joint"))
    best = joint.groupBy("term", (F.col("df_term") > F.col("inside")).alias("outside")).agg(F.max(share(F.col("joint"))).alias("share"))
    action = F.when(F.col("share") > REMOVE, "remove").otherwise("generalise")
    return materialize(best.where(F.col("share") > GENERALISE).select("term", action.alias("action"), "outside"), "flagged")


def _placed(texts: DataFrame) -> DataFrame:
    """``(text_hash, terms)``: all runs of ``texts(text_hash, text)``, as
    ``(value, start)``.

    Their places are running sums, taken over blocks of ``BLOCK`` runs and over
    the blocks, since appending to one long array takes time in its square."""
    texts = texts.withColumns(base_spans()).select("text_hash", _masked(_every()).alias("low"))
    gaps, hits = F.split("low", RUN, -1), F.regexp_extract_all("low", F.lit(RUN), F.lit(0))
    steps = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("value")))
    texts = texts.select("text_hash", F.filter(steps, lambda x: x["value"].isNotNull()).alias("steps"))
    at = F.sequence(F.lit(0), F.expr(f"cast((size(steps) - 1) div {BLOCK} as int)"))
    texts = texts.select("text_hash", F.transform(at, lambda i: F.slice("steps", i * BLOCK + 1, F.lit(BLOCK))).alias("blocks"))
    add = lambda at, x: at + x["gap"] + F.length(x["value"])
    sums = F.transform("blocks", lambda block: F.aggregate(block, F.lit(0), add))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    starts = F.aggregate(
        sums,
        F.struct(F.lit(0).alias("at"), none("int").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        lambda acc: acc["out"],
    )

    def place(block: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            term = F.struct(x["value"].alias("value"), (acc["at"] + x["gap"]).alias("start"))
            return F.struct(add(acc["at"], x).alias("at"), F.array_append(acc["out"], term).alias("out"))

        zero = F.struct(start.alias("at"), none("struct<value:string,start:int>").alias("out"))
        return F.aggregate(block, zero, step, lambda acc: acc["out"])

    return texts.select("text_hash", F.flatten(F.zip_with("blocks", starts, place)).alias("terms"))


def occurrences(docs: DataFrame, texts: DataFrame, flagged: DataFrame) -> DataFrame:
    """``(text_hash, terms)``: in each text with a flagged term, the spans of all
    its occurrences, in order."""
    flags = broadcast_if_small(flagged.select("term", "action"))
    # most flagged terms stand in texts with a base span only, which are at hand
    own = texts.select("text_hash", F.explode("words").alias("term")).join(broadcast_if_small(flagged.where("not outside").select("term")), "term", "left_semi").select("text_hash")
    other = _words(docs).join(broadcast_if_small(flagged.where("outside").select("term")), "term", "left_semi").select("text_hash")
    marked = materialize(own.union(other).distinct(), "marked")
    known = matching(texts.select("text_hash", "text"), F.col("text_hash"), marked)
    rest = materialize(matching(marked, F.col("text_hash"), texts.select("text_hash"), keep=False), "rest")
    more = matching(docs.select(_hash().alias("text_hash"), "text"), F.col("text_hash"), rest)
    more = more.groupBy("text_hash").agg(F.first("text").alias("text"))
    held = materialize(known.unionByName(more), "held")
    # the outer form, as Spark would push a filter on the array's size below and
    # work the array out again there, block by block
    rows = _placed(held).select("text_hash", F.inline_outer("terms")).withColumnRenamed("value", "term").join(flags, "term")
    span = F.struct("start", (F.col("start") + F.length("term")).alias("end"), "action")
    return rows.groupBy("text_hash").agg(F.sort_array(F.collect_set(span)).alias("terms"))


def _with_terms(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """``detect`` with ``terms``, the spans of disclosing terms in order."""
    found = detect(docs, row)
    texts = carriers(found)
    own = materialize(occurrences(docs, texts, disclosures(docs, found, texts)), "terms")
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return found.drop("entities", "words", "carrier").join(broadcast_if_small(own), "text_hash", "left").withColumn("terms", F.coalesce("terms", none))


def _listed(kind: str, column: str) -> Column:
    return F.transform(F.col(column), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def op8(docs: DataFrame) -> DataFrame:
    found = _with_terms(docs)
    base = F.concat(*[_listed(k, k) for k in KINDS])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _listed("term", "terms")), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
        F.size(base).cast("long").alias("n_base"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: entities become ``<KIND>``, generalised terms ``<TERM>``,
    and removed terms vanish.  Of overlapping spans the first counts."""
    stored = materialize(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "texts")
    spans = lambda k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{k.upper()}>").alias("mark")))
    extra = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "").otherwise("<TERM>").alias("mark")))
    marks = _with_terms(stored, F.col("row")).select("row", F.array_sort(F.concat(*[spans(k) for k in KINDS], extra)).alias("marks"))
    rows = stored.join(marks, "row")

    def splice(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), s["mark"])
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), more.alias("out"))).otherwise(acc)

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    clean = F.when(F.size("marks") == 0, F.col("text")).otherwise(F.aggregate("marks", zero, splice, rest))
    return rows.select("doc_id", clean.alias("text"))
