"""Language identification by rank-order n-gram profiles.

A language's profile is the ranking of its most frequent character n-grams (one
to three letters, words padded with a blank).  A document is compared by the
out-of-place distance: for each of its own most frequent n-grams the difference
of the ranks, or the profile's length if the profile lacks it.  The nearest
profile wins; ties go to the first language by name.

Profiles are learned from all rows whose ``crc32(doc_id as text) mod 5`` is not 0 and
whose ``lang`` and ``text`` are not null, each text whole, for at most ``LANGUAGES``
languages.  Counts are summed in tasks before they are shuffled.

Null texts, and texts without a letter, are ``und`` with score 0; so is everything
if nothing can be learned.  A null ``doc_id`` is never learned from and not held
out.  Long texts are counted whole.  Repeated rows each get a row; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalens.runtime import map_arrow, prepare

#: Languages that profiles are learned for, those with the most documents.
LANGUAGES = 2000
#: Length of a profile.
PROFILE = 300
UNKNOWN = "und"
#: Characters of a text that are counted at once.
CHUNK = 1 << 17
#: n-grams that a task gathers before it sums or hands on their counts.
GATHERED = 1 << 19
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or blank for what is no letter."""
    if not _TABLE:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (packed in 21 bits a letter) and their counts."""
    keys, counts = [], []
    text = text or ""
    last = np.full(2, 32, np.uint64)
    for at in range(0, len(text), CHUNK):
        part = text[at : at + CHUNK]
        points = _letters()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.uint64)
        if at + CHUNK >= len(text):
            points = np.append(points, np.uint64(32))
        # the last two points go on into the next chunk; blanks in a row are one
        points = np.concatenate([last, points])
        points = points[np.concatenate([[True, True], (points[2:] != 32) | (points[1:-1] != 32)])]
        last = points[-2:]
        if points.size < 3:
            continue
        letter = points != 32
        two = (points[:-1] << np.uint64(21)) | points[1:]
        three = (two[:-1] << np.uint64(21)) | points[2:]
        # n-grams that end at a new point; of blank pairs there is only the first
        k, n = np.unique(np.concatenate([points[2:][letter[2:]], two[1:][letter[1:-1] | letter[2:]], three[letter[1:-1]]]), return_counts=True)
        keys.append(k)
        counts.append(n)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def ranking(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, first the most frequent, ties by n-gram."""
    return keys[np.lexsort((keys, -counts))[:size]]


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Counts of n-grams in texts of each language, most repetitions within a task
    summed."""
    by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def summed() -> None:
        nonlocal size
        for lang, found in by.items():
            k, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            by[lang] = [(k, np.bincount(at, np.concatenate([x for _, x in found]), minlength=k.size).astype(np.int64))]
        size = sum(found[0][0].size for found in by.values())

    def rows() -> Iterable[pa.RecordBatch]:
        for lang, found in by.items():
            for k, n in found:
                if k.size:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * k.size, pa.string()), pa.array(k.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
        by.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = ngrams(text)
            by.setdefault(lang, []).append(found)
            size += found[0].size
            if size > GATHERED:
                summed()
                if size > GATHERED // 2:
                    yield from rows()
                    size = 0
    summed()
    yield from rows()


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """A ranking for each language, from all texts that may be learned from; at most
    ``PROFILE`` n-grams of each are brought to the driver."""
    spark = prepare(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    if not sizes:
        return {}
    if len(sizes) > LANGUAGES:
        most = spark.createDataFrame([(r["lang"],) for r in sizes[:LANGUAGES]], "lang string")
        known = known.join(F.broadcast(most), "lang", "left_semi")
    found = known.select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long")
    totals = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = totals.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
    ranked: dict[str, list] = {}
    for r in top.orderBy("lang", "r").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in sorted(ranked.items())}


class Judge:
    """Out-of-place distances of a document to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        self.grams = np.unique(np.concatenate([profiles[k] for k in self.names])) if profiles else np.zeros(0, np.uint64)
        self.ranks = np.full((self.grams.size + 1, len(self.names)), -1, np.int64)
        for j, k in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[k]), j] = np.arange(profiles[k].size)

    def __call__(self, text: str | None) -> tuple[str, float]:
        keys, counts = ngrams(text)
        if not keys.size or not self.names:
            return UNKNOWN, 0.0
        own = ranking(keys, counts)
        at = np.searchsorted(self.grams, own)
        at[(at == self.grams.size) | (self.grams[np.minimum(at, self.grams.size - 1)] != own)] = self.grams.size
        ranks = self.ranks[at]
        distance = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(own.size)[:, None])).sum(axis=0)
        best = int(np.argmin(distance))
        return self.names[best], 1.0 - float(distance[best]) / (PROFILE * own.size)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``."""
    prepare(docs.sparkSession)
    profiles = fit(docs) if profiles is None else profiles
    kind = docs.schema["doc_id"].dataType.simpleString()
    judge = Judge(profiles)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = zip(*(judge(t) for t in batch.column(2).to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", _held_out().alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accept(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language: rows that are
    ``und``, or that share no n-gram with any profile, are rejected."""
    prepare(docs.sparkSession)
    judge = Judge(fit(docs))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                verdict = [judge(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                yield batch.filter(pa.array([n != UNKNOWN and s > 0 for n, s in verdict]))

    return docs.mapInArrow(run, docs.schema)


def op2(docs: DataFrame) -> DataFrame:
    return identify(docs)
