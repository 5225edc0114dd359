"""Removal of repeated byte strings by threshold-bounded interval expansion.

A byte goes if a string of ``MIN_BYTES`` bytes covers it that also starts anywhere
else, in the same document or another; matches never cross documents.

1. Anchors.  Each window of ``MIN_BYTES`` bytes belongs to one anchor, the leftmost
   gram of ``GRAM`` bytes with the smallest hash in it.  Equal windows have equal
   anchors at the same place, so only the windows of one gram need comparing.
   The bytes that an anchor's windows span are its context; equal contexts of a
   gram are counted before the shuffle, so copies cost one row a task.
2. Interval expansion.  The distinct contexts of the repeated grams are dealt to
   shards of bounded size.  A shard builds the suffix order and the
   Burrows-Wheeler transform of its contexts and extends all intervals backwards,
   breadth first: level ``l`` finds the boundaries at which neighbouring suffixes
   share ``l`` bytes.  It stops at ``MIN_BYTES``; runs without a boundary share that
   many, and windows in runs of weight two or more are repeated.  A gram with a
   single distinct context is decided by its count alone.
3. Hot grams.  A gram with more than ``HOT`` contexts (the edge of a passage that
   very many documents hold) is split: a block of windows whose common core is
   rare is dropped, one whose core has a single continuation is settled, and any
   other is halved, each step with counts that are combined before the shuffle.
4. The covered ranges are brought back to the documents.

Texts are UTF-8 bytes; null texts are empty.  Texts shorter than ``MIN_BYTES`` lose
nothing.  Contexts are told apart by 64-bit hashes within a gram of equal 64-bit
hash.  Rows that repeat are documents of their own; a null ``doc_id`` keeps its
row; extra columns are ignored.  A text of one byte repeated is one row, as runs
of equal contexts are stored by their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.runtime import map_arrow, materialize, prepare

MIN_BYTES = 200
GRAM = 32
SPAN = MIN_BYTES - GRAM + 1
#: Windows of a text that are worked on at once, and bytes of a shard.
PART = 1 << 22
SHARD_BYTES = 1 << 19
#: Distinct contexts of a gram that one shard takes at most.
HOT = 1000
#: Symbols packed in the first sort key, at nine bits.
PACKED = 7
_POS = np.uint64((1 << 24) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each position, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    size = 1
    while size < GRAM:
        h = h[: h.size - size] * np.uint64(0xBF58476D1CE4E5B9 + 2 * size) + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    return h


def owners(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each anchor, and the anchor's gram hash."""
    firsts, lasts, keys = [], [], []
    windows = data.size - MIN_BYTES + 1
    for at in range(0, max(windows, 0), PART):
        n = min(PART, windows - at)
        h = _gram_hashes(data[at : at + n + MIN_BYTES - 1])
        m = (h & ~_POS) | np.arange(h.size, dtype=np.uint64)
        size = 1
        while 2 * size <= SPAN:
            m = np.minimum(m[: m.size - size], m[size:])
            size *= 2
        anchor = (np.minimum(m[:n], m[SPAN - size : SPAN - size + n]) & _POS).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        firsts.append(first + at)
        lasts.append(np.append(first[1:], n) - 1 + at)
        keys.append(h[anchor[first]])
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(keys)


def contexts(raw: bytes) -> tuple[np.ndarray, ...]:
    """``(start, len, reps, gram, context)`` of each anchor; equal contexts that
    follow each other are one entry, ``len - MIN_BYTES + 1`` bytes apart."""
    first, last, gram = owners(np.frombuffer(raw, np.uint8))
    size = last - first + MIN_BYTES
    own = np.array([xxhash.xxh3_64_intdigest(raw[a : a + n]) for a, n in zip(first.tolist(), size.tolist())], np.uint64)
    if first.size < 2:
        return first, size, np.ones(first.size, np.int64), gram, own
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (own[1:] != own[:-1]) | (size[1:] != size[:-1])])
    heads = np.flatnonzero(new)
    return first[heads], size[heads], np.diff(np.append(heads, first.size)), gram[heads], own[heads]


def _suffix_order(symbols: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffix array; a suffix ends with its context, equal ones go by place."""
    n = symbols.size
    at = np.arange(n)
    key = np.zeros(n, np.int64)
    for j in range(PACKED):
        key = (key << 9) | np.where(at + j <= end, symbols[np.minimum(at + j, n - 1)], 0)
    u = np.argsort(key, kind="stable")
    k, base, rank, h = key[u], np.zeros(n, np.int64), np.zeros(n, np.int64), PACKED
    while True:
        new = np.concatenate([[True], k[1:] != k[:-1]])
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        whole = np.concatenate([[True], base[1:] != base[:-1]])
        rank[u] = base + heads[group] - np.flatnonzero(whole)[np.cumsum(whole) - 1]
        sizes = np.diff(np.append(heads, u.size))
        open_ = (sizes > 1)[group]
        u = u[open_]
        if not u.size or h > 2 * MIN_BYTES:
            break
        base = rank[u]
        then = u + h
        k = base * (n + 1) + np.where(then <= end[u], rank[np.minimum(then, n - 1)] + 1, 0)
        order = np.argsort(k, kind="stable")
        u, k, base = u[order], k[order], base[order]
        h *= 2
    if u.size:
        base = rank[u]
        starts = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))
        rank[u] = base + np.arange(u.size) - np.repeat(starts, np.diff(np.append(starts, u.size)))
    order = np.empty(n, np.int64)
    order[rank] = at
    return order


def _boundaries(bwt: np.ndarray, front: np.ndarray, separators: int) -> np.ndarray:
    """Where neighbouring suffixes share fewer than ``MIN_BYTES`` symbols.

    ``front`` is each suffix's first symbol; intervals are half-open."""
    n = bwt.size
    step = np.empty(n, np.int64)
    step[np.argsort(bwt, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)
    low = np.flatnonzero(np.concatenate([[True], front[1:] != front[:-1]]))
    low = np.concatenate([np.arange(separators), low[low >= separators]])
    high = np.append(low[1:], n)
    known[low] = known[n] = True
    for _ in range(1, MIN_BYTES):
        if not low.size:
            break
        size = high - low
        single = size == 1
        one = low[single]
        one = step[one[bwt[one] > 0]]
        low, size = low[~single], size[~single]
        at = np.arange(int(size.sum())) + np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if low.size else low
        of = np.repeat(np.arange(low.size), size)
        inner = bwt[at] > 0
        key = np.sort((of[inner] << 32) | step[at[inner]])
        to, of = key & 0xFFFFFFFF, key >> 32
        if to.size:
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (front[to[1:]] != front[to[:-1]])]))
            many_low, many_high = to[first], to[np.append(first[1:], to.size) - 1] + 1
        else:
            many_low = many_high = to
        low, high = np.concatenate([one, many_low]), np.concatenate([one + 1, many_high])
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
    return known[:n]


def repeated_ranges(texts: list[bytes], weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each context the range that its repeated windows cover, or (0, 0).

    A context counts ``weight`` times."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    symbols = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(symbols.size, bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    context = np.repeat(np.arange(sizes.size), sizes + 1)
    order = _suffix_order(symbols, ends[context])
    bwt = np.where(order > 0, symbols[order - 1], 0)
    cut = _boundaries(bwt, symbols[order], sizes.size)
    runs = np.flatnonzero(cut)
    owner, offset = context[order], order - starts[context[order]]
    window = offset <= sizes[owner] - MIN_BYTES
    total = np.add.reduceat(np.where(window, np.array(weights)[owner], 0), runs)
    hit = window & (np.repeat(total, np.diff(np.append(runs, order.size))) > 1)
    low = np.full(sizes.size, np.iinfo(np.int64).max)
    high = np.zeros(sizes.size, np.int64)
    np.minimum.at(low, owner[hit], offset[hit])
    np.maximum.at(high, owner[hit], offset[hit] + MIN_BYTES)
    return np.where(high > 0, low, 0), high


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Rows come sorted by gram and context; whole grams fill a shard."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        low, high = repeated_ranges([r[3] for r in rows], [r[2] for r in rows])
        hit = np.flatnonzero(high > 0)
        cols = [pa.array([rows[i][0] for i in hit], pa.int64()), pa.array([rows[i][1] for i in hit], pa.int64()), pa.array(low[hit], pa.int32()), pa.array(high[hit], pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=["gram", "context", "low", "high"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if held and held[-1][:2] == row[:2]:
                continue
            if size >= SHARD_BYTES and held[-1][0] != row[0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield flush(held)


def _split_hot(rows: DataFrame) -> DataFrame:
    """Ranges of the hot grams, by halving blocks of windows.

    A window's distance is that of its start from the anchor; equal windows have
    equal distances.  All windows of a block of distances ``a..b`` share a core of
    bytes, whichever of them a context owns."""

    def aim(batch: pa.RecordBatch) -> pa.RecordBatch:
        anchors = []
        for raw in batch.column(3).to_pylist():
            h = _gram_hashes(np.frombuffer(raw, np.uint8)[: MIN_BYTES])
            anchors.append(int(np.argmin((h & ~_POS) | np.arange(h.size, dtype=np.uint64))))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(anchors, pa.int32())], names=[*batch.schema.names, "anchor"])

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        core, whole, low, high = [], [], [], []
        for raw, z, a, b in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6))):
            core.append(xxhash.xxh3_128_digest(raw[z - a : z - b + MIN_BYTES]))
            low.append(z - min(b, z))
            high.append(min(z - a + MIN_BYTES, len(raw)))
            whole.append(xxhash.xxh3_128_digest(raw[low[-1] : high[-1]], low[-1] - z & 0xFFFF))
        cols = [pa.array(core, pa.binary()), pa.array(whole, pa.binary()), pa.array(low, pa.int32()), pa.array(high, pa.int32())]
        return pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "core", "whole", "low", "high"])

    row = "gram long, context long, w long, raw binary, anchor int"
    # distances that a context owns; its last window has the smallest
    owned = (F.col("a") <= F.col("anchor")) & (F.col("b") >= F.col("anchor") - F.octet_length("raw") + MIN_BYTES)

    def blocks(df: DataFrame, *pairs) -> DataFrame:
        parts = [df.select("gram", "context", "w", "raw", "anchor", a.cast("int").alias("a"), b.cast("int").alias("b")).where(owned) for a, b in pairs]
        return parts[0].unionByName(parts[1])

    aimed = map_arrow(rows.select("gram", "context", "w", "raw"), aim, row)
    todo = blocks(aimed, (F.lit(0), F.lit(127)), (F.lit(128), F.lit(255)))
    found: list[DataFrame] = []
    while True:
        told = materialize(map_arrow(todo, describe, f"{row}, a int, b int, core binary, whole binary, low int, high int"), "blocks")
        if told.isEmpty():
            break
        total = F.sum("w").alias("n")
        # a core with one kind of whole block is settled; in a mixed one they go on
        mixed = (F.min("whole") != F.max("whole")).alias("mixed")
        again = materialize(told.groupBy("gram", "a", "core").agg(total, mixed).where("n > 1").drop("n"), "cores")
        settled = materialize(told.groupBy("gram", "whole").agg(total).where("n > 1").select("gram", "whole", F.lit(True).alias("done")), "wholes")
        live = materialize(told.join(again, ["gram", "a", "core"]).join(settled, ["gram", "whole"], "left").drop("core"), "live")
        found.append(live.where("done").select("gram", "context", "low", "high"))
        middle = F.floor((F.col("a") + F.col("b")) / 2)
        # of settled blocks one of a kind goes on, as a witness for the others
        further = live.where("mixed and a < b")
        witnesses = further.where("done").dropDuplicates(["gram", "a", "whole"])
        todo = blocks(further.where("done is null").unionByName(witnesses), (F.col("a"), middle), (middle + 1, F.col("b")))
    out = found[0] if found else rows.sparkSession.createDataFrame([], "gram long, context long, low int, high int")
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("gram", "context").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def covered(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, ranges)``: the covered ranges of bytes of each
    document that has any, unsorted and overlapping."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def anchor(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [contexts(t.encode()) for t in batch.column(2).to_pylist()]
        rows = np.repeat(np.arange(len(found)), [f[0].size for f in found])
        cols = [np.concatenate([f[i] for f in found]) for i in range(5)]
        kinds = [np.int32, np.int32, np.int32]
        arrays = [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))]
        arrays += [pa.array(c.astype(k)) for c, k in zip(cols, kinds)] + [pa.array(c.view(np.int64)) for c in cols[3:]]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "start", "len", "reps", "gram", "context"])

    where = f"doc_id {kind}, text_hash long, start int, len int, reps int, gram long, context long"
    anchors = materialize(map_arrow(texts, anchor, where), "anchors")
    again = materialize(anchors.groupBy("gram").agg(F.sum("reps").alias("n")).where("n > 1").select("gram"), "grams")
    anchors = materialize(anchors.join(again, "gram", "left_semi"), "repeated")
    place = F.min(F.struct("doc_id", "text_hash", "start", "len")).alias("p")
    distinct = materialize(anchors.groupBy("gram", "context").agg(F.sum("reps").alias("w"), place).select("gram", "context", "w", "p.*"), "contexts")
    counts = materialize(distinct.groupBy("gram").agg(F.count("*").alias("n")), "counts")
    sized = materialize(distinct.join(counts, "gram"), "sized")
    alone = sized.where("n = 1").select("gram", "context", F.lit(0).alias("low"), F.col("len").alias("high"))

    wanted = sized.where("n > 1").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.struct("gram", "context", "w", "start", "len", (F.col("n") > HOT).alias("hot")).alias("c"))
    wanted = wanted.groupBy("d", "t").agg(F.collect_list("c").alias("wanted"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for text, asked in zip(*(batch.column(i).to_pylist() for i in range(2))):
            raw = text.encode()
            out += [(c["gram"], c["context"], c["w"], raw[c["start"] : c["start"] + c["len"]], c["hot"]) for c in asked]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["gram", "context", "w", "raw", "hot"])

    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    bytes_ = materialize(map_arrow(texts.join(wanted, same).select("text", "wanted"), cut, "gram long, context long, w long, raw binary, hot boolean"), "bytes")
    cool = bytes_.where("not hot").select("gram", "context", "w", "raw")
    ranges = cool.repartition("gram").sortWithinPartitions("gram", "context").mapInArrow(_expand, "gram long, context long, low int, high int")
    hot = bytes_.where("hot")
    if not hot.isEmpty():
        ranges = ranges.unionByName(_split_hot(hot.dropDuplicates(["gram", "context"])))
    ranges = materialize(ranges.unionByName(alone), "ranges")
    reach = (F.col("reps") - 1) * (F.col("len") - MIN_BYTES + 1) + F.col("high")
    spans = anchors.join(ranges, ["gram", "context"]).select("doc_id", "text_hash", F.struct((F.col("start") + F.col("low")).alias("a"), (F.col("start") + reach).alias("b")).alias("s"))
    return materialize(spans.groupBy("doc_id", "text_hash").agg(F.collect_list("s").alias("ranges")), "covered")


def merge(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])`` for every
    row of ``docs``; ``kept`` holds the remaining bytes."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = covered(docs).withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw, spans = (text or "").encode(), merge(ranges)
            at, kept = 0, []
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            rest = b"".join(kept) + raw[at:]
            rows.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
        cols = list(zip(*rows))[: 4 + keep_bytes]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    return map_arrow(texts.join(found, same, "left").select("doc_id", "text", "ranges"), run, schema)


def op4(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, keep_bytes=False)
