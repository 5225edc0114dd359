"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are split by size (powers of two of their distinct five-word shingles).  In
a partition whose largest possible size is ``u`` an item is indexed by its
``floor((1 - t) * u) + 1`` smallest shingle hashes, a bottom-k MinHash sketch.  A
document that holds the share ``t`` of an item's shingles misses too few of them to
miss the whole sketch, whatever its own length, so every document that meets the
threshold shares a sketch hash.  Documents are sketched alike: of their shingles
only those up to the largest hash of any item's sketch are probed.  These candidates
are verified: the item's shingles are looked up in the document as strings and
counted exactly.

Only DataFrame functions run.  Shingles of documents are made and probed inside
one generated stage, and only hits leave it; the sketch is broadcast after a count
of its rows.  Beyond the bound the join shuffles document keys and hashes, no text.

Words are maximal runs of letters and digits, in lower case.  An item of one to four
words is one shingle of that many words.  Null and empty texts hold no shingle: such
documents are clean and such items match nothing.  Documents are told apart by
``doc_id`` and text, so rows that repeat both are one document, and a text decides
for itself whatever shares its id or has none.  Each benchmark row is an item.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.runtime import broadcast_if_small, matching, materialize, packed

SHINGLE = 5
#: Share of an item's distinct shingles, in hundredths.
PERCENT = 80


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def _shingle_rows(df: DataFrame, sizes: list[int], *keys: str) -> DataFrame:
    """A row ``(keys, words, size, i, h)`` for each shingle of these sizes."""

    # size and start are packed in one number: a lambda over structs would keep
    # the rows out of generated code, which copies the words of a text for each
    def starts(k: int) -> Column:
        first = F.lit(k << 32).cast("long")
        return F.when(F.size("words") >= k, F.sequence(first, first + F.size("words") - k)).otherwise(F.array().cast("array<bigint>"))

    rows = df.withColumn("words", _words("text")).select(*keys, "words", F.explode(F.concat(*map(starts, sizes))).alias("p"))
    rows = rows.select(*keys, "words", F.shiftright("p", 32).cast("int").alias("size"), F.col("p").bitwiseAND(0xFFFFFFFF).cast("int").alias("i"))
    at = lambda k: F.when(F.col("size") > k, F.get("words", F.col("i") + k))
    return rows.withColumn("h", F.xxhash64(*[at(k) for k in range(SHINGLE)]))


def _string() -> Column:
    return F.array_join(F.slice("words", F.col("i") + 1, F.col("size")), " ")


def index(benchmark: DataFrame) -> DataFrame:
    """``(item, item_id, size, h, shingle, n_item_shingles, in_sketch)``: all
    shingles of all items, with those that form the sketches marked."""
    items = benchmark.select("item_id", "text").withColumn("item", F.monotonically_increasing_id())
    rows = _shingle_rows(items, list(range(1, SHINGLE + 1)), "item", "item_id").where(F.col("size") == F.least(F.size("words"), F.lit(SHINGLE)))
    words = benchmark.where("text is not null").agg(F.sum(F.size(_words("text")))).first()[0] or 0
    rows = materialize(packed(rows.select("item", "item_id", "size", "h", _string().alias("shingle")).distinct(), words), "items")
    counts = rows.groupBy("item").agg(F.count("*").alias("n_item_shingles"), F.array_sort(F.collect_set("h")).alias("hashes"))
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_item_shingles"))) + 1) - 1
    depth = F.floor(largest * (100 - PERCENT) / 100).cast("int") + 1
    sketch = counts.select("item", "n_item_shingles", F.get("hashes", F.least(depth, F.size("hashes")) - 1).alias("last"))
    return materialize(packed(rows.join(sketch, "item").withColumn("in_sketch", F.col("h") <= F.col("last")).drop("last"), words), "index")


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``leaks`` with ``text_hash``, which tells texts of one id apart."""
    shingles = index(benchmark)
    found = shingles.where("in_sketch").groupBy("size").agg(F.max("h").alias("h")).collect()
    sizes, bound = sorted(r["size"] for r in found) or [SHINGLE], max((r["h"] for r in found), default=0)
    sketch = broadcast_if_small(shingles.where("in_sketch").select("h", "item"))
    key = ("doc_id", "text_hash")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    probes = _shingle_rows(texts, sizes, *key).where(F.col("h") <= bound).select(*key, "h")
    candidates = materialize(probes.join(sketch, "h").select(*key, "item").distinct(), "candidates")
    near = matching(texts, F.struct(*key), candidates.select(F.struct(*key).alias("k")))
    full = broadcast_if_small(shingles.select("h", F.col("shingle").alias("s"), "item"))
    held = _shingle_rows(near, sizes, *key).select(*key, "h", _string().alias("shingle")).join(full, "h").where("shingle = s")
    counts = held.select(*key, "item", "shingle").distinct().groupBy(*key, "item").agg(F.count("*").alias("n_shared"))
    pairs = candidates.withColumnsRenamed({"doc_id": "d", "text_hash": "t", "item": "c"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("item") == F.col("c"))
    counts = counts.join(pairs, same, "left_semi")
    about = shingles.select("item", "item_id", "n_item_shingles").distinct()
    out = counts.join(broadcast_if_small(about), "item").where(F.col("n_shared") * 100 >= F.col("n_item_shingles") * PERCENT)
    out = out.select(*key, "item_id", "n_item_shingles", "n_shared", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"))
    return packed(out, candidates.count())


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_item_shingles, n_shared, containment)`` for every
    document that holds at least ``PERCENT`` of an item's shingles."""
    return _leaks(docs, benchmark).drop("text_hash")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no item."""
    bad = materialize(_leaks(docs, benchmark).select(F.struct("doc_id", "text_hash").alias("bad")), "leaks")
    # one computed key, so that no column of the rows can clash with it
    return matching(docs, F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash")), bad, keep=False)


def op1(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)


_SQL_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
SQL = f"""
with i as (select distinct item, item_id, k, unnest([array_to_string(ws[j:j+k-1], ' ') for j in range(1, len(ws) - k + 2)]) as shingle
  from (select *, least(len(ws), {SHINGLE}) as k from (select row_number() over () as item, item_id, {_SQL_WORDS} as ws from benchmark) a) b where k > 0),
n as (select item, count(*) as n_item_shingles from i group by 1),
d as (select distinct doc_id, text, k, unnest([array_to_string(ws[j:j+k-1], ' ') for j in range(1, len(ws) - k + 2)]) as shingle
  from (select doc_id, text, {_SQL_WORDS} as ws from documents) a, (select distinct k from i) b where len(ws) >= k),
c as (select doc_id, text, item, item_id, count(*) as n_shared from d join i on d.shingle = i.shingle and d.k = i.k group by 1, 2, 3, 4)
select doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles as containment
from c join n on c.item = n.item where n_shared * 100 >= n_item_shingles * {PERCENT}"""
