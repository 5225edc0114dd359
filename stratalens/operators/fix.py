"""Automatic fixes: edits are rows, files are spliced by group.

``edits(path, rule, fix_id, edit_id, start, end, replacement)``; offsets are bytes.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators import post
from stratalens.runtime import prepare
from stratalens.sources.typescript import SyntaxFailure, parse


def collect(violations: DataFrame, syn: DataFrame, more: Iterable[DataFrame] = ()) -> DataFrame:
    """edits of the rules whose findings say where and what to change,
    and ``more`` rows ``(path, rule, start, end, replacement)``."""
    v = violations.where("start is not null")
    end = F.col("end")
    whole = {"no-debugger": ("", F.col("start"), end), "no-any": ("unknown", F.col("start"), end), "no-non-null-assertion": ("", end - 1, end)}
    parts = []
    for rule, (text, a, b) in whole.items():
        parts.append(v.where(F.col("rule") == rule).select(F.col("file").alias("path"), "rule", a.alias("start"), b.alias("end"), F.lit(text).alias("replacement")))
    for rule, word in (("no-focused-test", "only"), ("no-skipped-test", "skip")):
        rows = v.where(F.col("rule") == rule)
        at = F.col("start") + F.octet_length("subject")
        parts.append(rows.select(F.col("file").alias("path"), "rule", (at - len(word) - 1).alias("start"), at.alias("end"), F.lit("").alias("replacement")))
    kind = syn.where("kind = 'as'").select("path", F.col("node_id").alias("parent_id"), F.col("start").alias("as_start"), F.col("end").alias("as_end"))
    left = syn.select("path", "parent_id", F.col("end").alias("expr_end"), F.col("start").alias("s")).join(kind, ["path", "parent_id"]).where("s = as_start")
    rows = v.where("rule = 'prefer-satisfies'").join(left, (F.col("file") == F.col("path")) & (F.col("start") == F.col("as_start")) & (F.col("end") == F.col("as_end")))
    parts.append(rows.select("path", "rule", (F.col("expr_end") + 1).alias("start"), (F.col("expr_end") + 3).alias("end"), F.lit("satisfies").alias("replacement")))
    rows = v.where("rule = 'prefer-readonly'").join(syn.where("kind = 'param'").select("path", F.col("start").alias("ps"), F.col("attrs")["type_start"].cast("int").alias("ts"), F.col("attrs")["type"].alias("tt")), (F.col("file") == F.col("path")) & (F.col("start") == F.col("ps")))
    generic = F.col("tt").startswith("Array<")
    parts.append(rows.select("path", "rule", F.col("ts").alias("start"), F.col("ts").alias("end"), F.when(generic, "Readonly").otherwise("readonly ").alias("replacement")))
    out = parts[0]
    for p in [*parts[1:], *more]:
        out = out.unionByName(p)
    fix_id = F.xxhash64("path", "rule", "start", "end")
    return out.distinct().withColumn("fix_id", fix_id).withColumn("edit_id", F.col("fix_id"))


def accepted(edits: DataFrame) -> DataFrame:
    """Edits of fixes that overlap no other."""
    return edits.join(post.overlapping_fixes(edits), ["path", "fix_id"], "left_anti")


def splice(raw: bytes, edits: list[tuple[int, int, str]]) -> bytes | None:
    """None if a range is wrong or splits a character."""
    out, at = [], 0
    for a, b, text in sorted(edits):
        if not at <= a <= b <= len(raw) or any(0 < x < len(raw) and raw[x] & 0xC0 == 0x80 for x in (a, b)):
            return None
        out += [raw[at:a], text.encode()]
        at = b
    return b"".join(out) + raw[at:]


def apply(files: DataFrame, edits: DataFrame) -> DataFrame:
    """``(path, before, after, error)`` of files with edits; a file whose
    result does not parse keeps its text."""
    prepare(files.sparkSession)
    grouped = accepted(edits).groupBy("path").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, source, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                new = splice((source or "").encode(), [(e["start"], e["end"], e["replacement"]) for e in found])
                error = None if new is not None else "an edit is out of range"
                if new is not None:
                    try:
                        parse(new.decode(), path)
                    except SyntaxFailure as e:
                        new, error = None, f"the result does not parse: {e}"
                rows.append((path, source, source if new is None else new.decode(), error))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "before", "after", "error"])

    return files.join(grouped, "path").select("path", "source", "edits").mapInArrow(run, "path string, before string, after string, error string")


def write_back(fixed: DataFrame, root: str, dry_run: bool = False) -> list[tuple[str, str]]:
    """Write files that still hold the text that was read; returns
    each path with what became of it."""
    out = []
    for r in fixed.orderBy("path").toLocalIterator():
        if r["error"]:
            out.append((r["path"], r["error"]))
            continue
        if dry_run:
            out.append((r["path"], "would change"))
            continue
        at = os.path.join(root, r["path"])
        with open(at, "rb") as f:
            if f.read() != (r["before"] or "").encode():
                out.append((r["path"], "changed on disk"))
                continue
        with open(at, "wb") as f:
            f.write(r["after"].encode())
        out.append((r["path"], "written"))
    return out
