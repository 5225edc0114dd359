"""Quality rules with cross-document line frequency.

Every line that has a word is normalised (A-Z lower-cased, white space collapsed)
and hashed together with its host (``source``).  A line that stands in more than
``LIMIT`` documents of one host is boilerplate and is removed; a document is
depleted, and rejected, if fewer than half of its words or fewer than ``MIN_WORDS``
words remain.  Each row is a document, copies too; a line counts once in each.

Words are ``[^\\x20\\x09-\\x0D]+``.  A null text has none; a null host is a host of its
own; null ids keep their row.  Counts cover all documents; every count is combined
before it is shuffled.  Repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.runtime import broadcast_if_small, map_arrow, materialize, prepare

#: Documents of a host that may share a line.
LIMIT = 20
MIN_WORDS = 50
KEPT_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\r\x0b\x0c"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def base(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACE):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), again, repeated_words(words)


def line_keys(text: str | None, host: str | None) -> dict[int, int]:
    """Words that stand in each line, by the hash of host and line."""
    seed = xxhash.xxh64_intdigest(b"\0" if host is None else b"\1" + host.encode())
    out: dict[int, int] = {}
    for line in (text or "").encode().lower().split(b"\n"):
        words = line.split()
        if words:
            key = xxhash.xxh64_intdigest(b" ".join(words), seed)
            out[key] = out.get(key, 0) + len(words)
    return out


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, hosts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    figures = np.array([base(t) for t in texts], np.int64).reshape(-1, len(BASE))
    lines = [line_keys(t, h) for t, h in zip(texts, hosts)]
    signed = [np.fromiter(x.keys(), np.uint64, len(x)).view(np.int64) for x in lines]
    columns = [batch.column(0), *(pa.array(figures[:, i]) for i in range(len(BASE)))]
    columns += [pa.array(signed, pa.list_(pa.int64())), pa.array([list(x.values()) for x in lines], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "keys", "words"])


def judge(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_removed_words)`` for every row of ``docs``."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in BASE)}, keys array<long>, words array<int>"
    measured = materialize(map_arrow(docs.select("doc_id", "text", "source"), _measure, schema).withColumn("row", F.monotonically_increasing_id()), "lines")
    # a document lists each of its lines once, so counting keys counts documents
    seen = measured.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    common = broadcast_if_small(materialize(seen.where(F.col("n") > limit).select("key"), "common"))
    pairs = measured.select("row", F.explode(F.arrays_zip("keys", "words")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.words").alias("w"))
    removed = broadcast_if_small(materialize(pairs.join(common, "key", "left_semi").groupBy("row").agg(F.sum("w").alias("gone")), "removed"))
    out = measured.join(removed, "row", "left").withColumn("gone", F.coalesce("gone", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("gone")
    depleted = (F.col("gone") > 0) & ((left < KEPT_SHARE * F.col("n_words")) | (left < MIN_WORDS))
    return out.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.col("gone").alias("n_removed_words"))


def op9(docs: DataFrame) -> DataFrame:
    return judge(docs)


_WORD = r"[^\x20\x09-\x0D]+"
#: Every text of the table as words with their place; one row a document.
SQL = f"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t, text is null as no_text, coalesce(source, '?null') as host from documents),
w as (select *, regexp_extract_all(t, '{_WORD}') as ws, string_split(t, chr(10)) as ls from d),
g as (select row, unnest(range(1, len(ws) - 1)) as i, unnest([ws[k] || ' ' || ws[k+1] || ' ' || ws[k+2] for k in range(1, len(ws) - 1)]) as gram from w where len(ws) >= 3),
r as (select row, i from (select row, i, count(*) over (partition by row, gram) as n from g) x where n > 1),
c as (select row, count(distinct p) as n_repeat_words from (select row, unnest([i, i + 1, i + 2]) as p from r) x group by 1),
l as (select row, host, t, unnest(ls) as line from w),
u as (select row, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '{_WORD}') group by 1),
n as (select row, host, t, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), ' ') as norm,
  len(regexp_extract_all(line, '{_WORD}')) as k from l),
f as (select host, norm from n where k > 0 group by 1, 2 having count(distinct row) > {LIMIT}),
x as (select n.row, sum(k) as gone from n join f on n.host = f.host and n.norm = f.norm where k > 0 group by 1),
b as (select w.row, doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint) as n_symbols,
  cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(coalesce(gone, 0) as bigint) as n_removed_words
  from w left join c on w.row = c.row left join u on w.row = u.row left join x on w.row = x.row),
v as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed,
  n_removed_words > 0 and (n_words - n_removed_words < {KEPT_SHARE} * n_words or n_words - n_removed_words < {MIN_WORDS}) as depleted from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not depleted as kept, n_removed_words from v"""
