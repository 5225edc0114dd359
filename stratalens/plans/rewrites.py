"""Fixes that need a file's text besides its findings: sorting imports
and exports, marking environment access, and turning empty interfaces to types.

With ``operators.fix`` all rules listed as fixable have one.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators import fix
from stratalens.plans import rules
from stratalens.runtime import prepare

MARK = " // lint-ignore-line no-process-env"
EDITS = "path string, rule string, start int, end int, replacement string"


def _reordered(rows: DataFrame, rule: str, sources: DataFrame, unit: list[str]) -> DataFrame:
    """One edit for each unit of statements that do not stand in order: texts
    change places, what lies between them stays.  Units with anything but white
    space between statements are left alone."""
    one = F.struct("stmt_index", "start", "end", "sort_key")
    units = rows.groupBy("path", *unit).agg(F.sort_array(F.collect_list(one)).alias("stmts")).where(F.size("stmts") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, source, stmts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = (source or "").encode()
                due = sorted(stmts, key=lambda s: (s["sort_key"], s["stmt_index"]))
                gaps = [raw[a["end"] : b["start"]] for a, b in zip(stmts, stmts[1:])]
                if due == stmts or any(g.strip() for g in gaps):
                    continue
                texts = [raw[s["start"] : s["end"]] for s in due]
                new = b"".join(x for pair in zip(texts, [*gaps, b""]) for x in pair)
                out.append((path, rule, stmts[0]["start"], stmts[-1]["end"], new.decode()))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["path", "rule", "start", "end", "replacement"])

    return units.join(sources, "path").select("path", "source", "stmts").mapInArrow(run, EDITS)


def _marked(v: DataFrame, f: rules.Facts) -> DataFrame:
    """A directive at the end of each line on which an access ends; none where
    that lies inside a template."""
    rest = F.substring(F.encode("source", "UTF-8"), F.col("end") + 1, F.octet_length("source"))
    line = F.regexp_extract(rest.cast("string"), r"^[^\r\n]*", 0)
    at = (F.col("end") + F.octet_length(line)).cast("int")
    rows = v.where("rule = 'no-process-env'").join(f.sources, F.col("file") == F.col("path"))
    rows = rows.select("path", "rule", at.alias("start"), at.alias("end"), F.lit(MARK).alias("replacement")).distinct()
    inside = f.syn.where("kind = 'template'").select(F.col("path").alias("p"), F.col("start").alias("a"), F.col("end").alias("b"))
    return rows.join(inside, (F.col("path") == F.col("p")) & (F.col("start") > F.col("a")) & (F.col("start") < F.col("b")), "left_anti")


def _typed(v: DataFrame, f: rules.Facts) -> DataFrame:
    """An empty interface that extends nothing and is declared once becomes a type."""
    shape = r"^((?:export\s+)?)interface(\s+(?!.*\bextends\b)[^{}]*?)\s*\{\s*\}$"
    once = f.syn.where("kind = 'interface'").groupBy("path", "name").agg(F.count("*").alias("n")).where("n = 1").select("path", "name")
    rows = v.where("rule = 'no-empty-interface'").join(once, (F.col("file") == F.col("path")) & (F.col("subject") == F.col("name"))).drop("path", "name")
    rows = rows.join(f.sources, F.col("file") == F.col("path")).where(~F.col("path").endswith(".d.ts"))
    raw = F.encode("source", "UTF-8")
    text = F.substring(raw, F.col("start") + 1, F.col("end") - F.col("start")).cast("string")
    semicolon = F.substring(raw, F.col("end") + 1, F.lit(1)).cast("string") == ";"
    new = F.regexp_replace(text, shape, "$1type$2 = Record<string, never>;")
    return rows.where(text.rlike(shape)).select("path", "rule", "start", (F.col("end") + semicolon.cast("int")).alias("end"), new.alias("replacement"))


def collect(f: rules.Facts, violations: DataFrame) -> DataFrame:
    """edits of all fixable rules for these findings."""
    prepare(f.spark)
    v = violations.where("start is not null")
    told = v.select(F.col("file").alias("path"), "rule").distinct()
    parts = [_marked(v, f), _typed(v, f)]
    for rule, (rows, key, unit) in rules.sorted_statements(f).items():
        mine = rows.withColumn("sort_key", key).join(told.where(F.col("rule") == rule), "path", "left_semi")
        parts.append(_reordered(mine, rule, f.sources, unit))
    return fix.collect(violations, f.syn, parts)


def previews(fixed: DataFrame) -> DataFrame:
    """``(path, diff)``: what a fix would change, as a unified diff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, "".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), p, p))) for p, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["path", "diff"])

    return fixed.where("error is null").select("path", "before", "after").mapInArrow(run, "path string, diff string")
