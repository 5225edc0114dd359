"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints are linked if they differ in at most three bits.  Two such
fingerprints meet at a point that lies within one bit of one of them and within
two bits of the other, so each distinct fingerprint emits the variants within
half the radius, the variants are shuffled, and colliding fingerprints are
verified.  Half of three is not whole; which side rounds up is settled by
parity, and a two-colouring of the bits halves the larger ball:

* an even fingerprint emits its 64 one-bit variants;
* an odd one emits itself, its 64 one-bit variants and the 992 two-bit variants
  whose two bits have the same colour.

Differences of 1 and 3 bits join an even and an odd fingerprint.  Of three
differing bits two share a colour: the odd side flips those two, the even side
the third, and they meet.  Differences of 2 bits meet in the one-bit variants.
Hence no pair is lost.  Within one bucket the members of a variant are linked to
one centre that lies within one bit of it (all others are then within three bits
of the centre), so a group of copies costs links in proportion to its size.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, three-word shingles
with repeats (fewer words: one shingle of all), XXH64 seed 42; a bit is set if it
is set in over half of the hashes.  Null or empty text, or text without a word,
has fingerprint zero and links like any other.  A null ``doc_id`` keeps its row.
Rows that repeat are kept; extra columns are ignored.

``deduplicate`` keeps one row of each group, that with the smallest ``doc_id`` (rows
without one come last) and, of its texts, the smallest hash; rows that share id and
text are one document, of which the first by its columns stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.operators.components import connected_components
from stratalens.runtime import map_arrow, matching, materialize, packed, prepare

RADIUS = 3
SHINGLE = 3
CHUNK = 1 << 16
#: Fingerprints whose balls are built at once, at least and at most: with more
#: buckets, larger blocks keep a bucket's share of a block from shrinking to nothing.
BALL_BATCH = 2048
LARGEST_BATCH = 8192
#: Variants aimed at in a bucket, and of a fingerprint on average.
BUCKET_VARIANTS = 1 << 19
BALL = 560

_ONE = np.uint64(1)
_SINGLES = _ONE << np.arange(64, dtype=np.uint64)
_PAIRS = np.array([(1 << i) | (1 << j) for i in range(64) for j in range(i + 1, 64) if i % 2 == j % 2], dtype=np.uint64)
_EVEN = _SINGLES
_ODD = np.concatenate([np.zeros(1, np.uint64), _SINGLES, _PAIRS])
#: Flip masks by code: itself, single bits, pairs.
_MASKS = _ODD
_CODES_EVEN = np.arange(1, 65, dtype=np.uint16)
_CODES_ODD = np.arange(_ODD.size, dtype=np.uint16)


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < SHINGLE:
        first, last = [0], [len(joined)]
    else:
        first, last = starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(first)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    values = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.int64())], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, fp)``: the fingerprint as a signed long."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), _fingerprints, f"doc_id {kind}, text_hash long, fp long")


def _bucket_of(variants: np.ndarray, buckets: int) -> np.ndarray:
    mixed = variants * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed >>= np.uint64(32)
    mixed *= np.uint64(buckets)
    mixed >>= np.uint64(32)
    return mixed.astype(np.int32)


def _balls(fps: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Variants of ``fps`` as one block of bytes for each bucket."""
    odd = np.bitwise_count(fps) & 1 == 1
    parts = []
    for own, masks, codes in ((fps[~odd], _EVEN, _CODES_EVEN), (fps[odd], _ODD, _CODES_ODD)):
        parts.append(((own[:, None] ^ masks[None, :]).ravel(), np.tile(codes, own.size)))
    variants, codes = (np.concatenate(x) for x in zip(*parts))
    del parts
    bucket = _bucket_of(variants, buckets)
    order = np.argsort(bucket, kind="stable")
    variants, codes, bucket = variants[order], codes[order], bucket[order]
    ids, first = np.unique(bucket, return_index=True)
    last = np.append(first[1:], bucket.size)
    blocks = [variants[a:b].tobytes() for a, b in zip(first, last)]
    marks = [codes[a:b].tobytes() for a, b in zip(first, last)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blocks, pa.binary()), pa.array(marks, pa.binary())], names=["bucket", "variants", "codes"])


def _emit_balls(buckets: int):
    size = min(LARGEST_BATCH, max(BALL_BATCH, buckets // 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            if sum(map(len, held)) >= size:
                yield _balls(np.concatenate(held), buckets)
                held = []
        if held:
            yield _balls(np.concatenate(held), buckets)

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the smallest of its component, and that smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    label = np.arange(nodes.size)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(nodes.size)
    return nodes[keep], nodes[label[keep]]


def _meet(variants: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among the origins that share a variant."""
    order = np.argsort(variants)
    variants, masks = variants[order], _MASKS[codes[order]]
    same = variants[1:] == variants[:-1]
    inside = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    variants, masks = variants[inside], masks[inside]
    if not variants.size:
        return variants, variants
    origins = variants ^ masks
    first = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
    sizes = np.diff(np.append(first, variants.size))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    central = np.bitwise_count(masks) <= 1
    centre = np.minimum.reduceat(np.where(central, origins, none), first)
    has = np.maximum.reduceat(central.astype(np.int8), first) > 0
    centre, has = np.repeat(centre, sizes), np.repeat(has, sizes)
    keep = has & (origins != centre) & (np.bitwise_count(origins ^ centre) <= RADIUS)
    return _forest(origins[keep], centre[keep])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Rows arrive sorted by bucket; one bucket is in memory at a time."""

    def flush(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        a, b = _meet(np.frombuffer(b"".join(x for x, _ in held), "<u8"), np.frombuffer(b"".join(x for _, x in held), "<u2"))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64), pa.int64()), pa.array(b.view(np.int64), pa.int64())], names=["src", "dst"])

    current, held = None, []
    for batch in batches:
        for bucket, variants, codes in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if bucket != current and held:
                yield flush(held)
                held = []
            current = bucket
            held.append((variants, codes))
    if held:
        yield flush(held)


def links(distinct_fps: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` that connect all fingerprints within the radius, as
    a spanning forest of each bucket."""
    spark = distinct_fps.sparkSession
    total = distinct_fps.count()
    # a task emits a row for each bucket, so tasks get whole blocks of fingerprints
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * BALL // (4 * BUCKET_VARIANTS)))
    buckets = max(partitions, -(-total * BALL // BUCKET_VARIANTS))
    emitters = max(1, -(-total // BALL_BATCH))
    return (
        # dealt out first: a ball is hundreds of times its fingerprint
        distinct_fps.select("fp")
        .repartition(emitters)
        .mapInArrow(_emit_balls(buckets), "bucket int, variants binary, codes binary")
        .repartition(partitions, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_links, "src long, dst long")
        .distinct()
    )


def _rank() -> Column:
    """What orders the documents of a group; rows without an id come last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))


def groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, fp, first)`` for every row of ``docs``; ``first`` is
    the first document of the row's component."""
    marks = materialize(fingerprints(docs), "fps")
    total = marks.count()
    keep = lambda df, name: materialize(packed(df, total), name)
    distinct = keep(marks.groupBy("fp").agg(F.min(_rank()).alias("first_doc")), "groups")
    found = links(distinct).persist(StorageLevel.DISK_ONLY)  # counted before they are written
    labels = keep(connected_components(found, rows=found.count()), "labels").withColumnRenamed("node", "fp")
    found.unpersist()
    rooted = keep(distinct.join(labels, "fp", "left").withColumn("root", F.coalesce("component", "fp")).select("fp", "first_doc", "root"), "rooted")
    least = keep(rooted.groupBy("root").agg(F.min("first_doc").alias("first")), "least")
    final = keep(rooted.join(least, "root").select("fp", "first"), "final")
    return marks.join(final, "fp").select("doc_id", "text_hash", "fp", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``."""
    return groups(docs).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, all columns."""
    found = groups(docs).select(_rank().alias("own"), (_rank() == F.col("first")).alias("stays"))
    state = found.groupBy("own", "stays").agg(F.count("*").alias("n"))
    state = materialize(packed(state, docs.count()), "state")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    out = matching(docs, own, state.where("not stays").select("own"), keep=False)
    repeated = state.where("stays and n > 1").select("own")
    if repeated.isEmpty():
        return out
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = matching(out, own, repeated).groupBy(own.alias("own")).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return matching(out, own, repeated, keep=False).unionByName(one)


def op10(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
