"""Reports: findings as text, JSON, NDJSON, SARIF and
Markdown, the import graph as DOT and JSON, statistics.

NDJSON and the SARIF results stay DataFrames until they are written; the other
formats are documents for people, built from rows in order.
"""

from __future__ import annotations

import json
import os
import sys
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import paths
from stratalens.operators import graph, post

LEVELS = {"error": "error", "warn": "warning", "info": "note"}
FORMATS = {"lint": ("text", "json", "ndjson", "sarif", "markdown"), "stats": ("text", "json"), "graph": ("dot", "json"), "rules": ("text", "json")}


def check_format(command: str, name: str) -> None:
    if name not in FORMATS[command]:
        raise ValueError(f"{command} has no format {name!r}; it has {', '.join(FORMATS[command])}")


def publish(text: str, output: str | None = None) -> None:
    """Standard output, or a file whose folders are made."""
    if output is None:
        sys.stdout.write(text)
        return
    os.makedirs(os.path.dirname(os.path.abspath(output)), exist_ok=True)
    with open(output, "w", encoding="utf-8") as f:
        f.write(text)


def _ordered(violations: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict() for r in violations.orderBy("file", "line", "column", "rule").toLocalIterator()]


def ndjson(violations: DataFrame, failures: DataFrame, summary: DataFrame, diagnostics: DataFrame | None = None, suppressions: DataFrame | None = None) -> DataFrame:
    """K3: ``(rank, value)`` in order: summary, files, diagnostics ``(category,
    message)``, failures, findings, and the totals of suppressions."""
    record = lambda df, rank, kind, *cols: df.select(F.lit(rank).alias("rank"), F.to_json(F.struct(F.lit(kind).alias("type"), *cols)).alias("value"))
    parts = record(summary, 0, "summary", *summary.columns)
    parts = parts.unionByName(record(post.by_file(violations).select("file", "n"), 1, "file", "file", "n"))
    if diagnostics is not None:
        parts = parts.unionByName(record(diagnostics, 2, "diagnostic", "category", "message"))
    parts = parts.unionByName(record(failures, 3, "parse_failure", *failures.columns))
    parts = parts.unionByName(record(violations, 4, "violation", *violations.columns))
    if suppressions is not None:
        parts = parts.unionByName(record(suppressions, 5, "suppressions", *suppressions.columns))
    return parts.orderBy("rank", "value")


def as_json(violations: DataFrame, failures: DataFrame, summary: DataFrame, stale: DataFrame | None = None, diagnostics: DataFrame | None = None) -> str:
    """K2."""
    rows = _ordered(violations)
    told = [] if diagnostics is None else [r.asDict() for r in diagnostics.select("category", "message").toLocalIterator()]
    out: dict[str, Any] = {"summary": summary.first().asDict(), "files": sorted({r["file"] for r in rows}), "violations": rows, "diagnostics": told, "parseFailures": [r.asDict() for r in failures.collect()]}
    if stale is not None:
        out["suppressions"] = {"stale": [r.asDict() for r in stale.orderBy("path", "line").collect()]}
    return json.dumps(out, indent=2) + "\n"


def sarif_results(violations: DataFrame) -> DataFrame:
    """K4: one JSON result a row; an unknown line is 1."""
    level = F.when(F.col("severity") == "warn", "warning").when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    region = F.struct(F.coalesce("line", F.lit(1)).alias("startLine"), F.coalesce("column", F.lit(1)).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.coalesce("detail", "message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return violations.select("file", "line", "column", "rule", F.to_json(result).alias("result"))


def sarif(violations: DataFrame, failures: DataFrame, tool: str = "stratalens") -> str:
    rules = [{"id": r["rule"], "shortDescription": {"text": r["message"]}, "defaultConfiguration": {"level": LEVELS.get(r["severity"], r["severity"])}} for r in violations.groupBy("severity", "rule").agg(F.min("message").alias("message")).orderBy(post.severity_rank(), "rule").collect()]
    results = [json.loads(r["result"]) for r in sarif_results(violations).orderBy("file", "line", "column", "rule").toLocalIterator()]
    notes = [{"level": "error", "message": {"text": f"{r['file']}: {r['message']}"}} for r in failures.collect()]
    run = {"tool": {"driver": {"name": tool, "rules": rules}}, "results": results, "invocations": [{"executionSuccessful": not notes, "toolExecutionNotifications": notes}]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2) + "\n"


def markdown(violations: DataFrame, summary: DataFrame) -> str:
    """K5: a table with the detail, or else the message."""
    s = summary.first()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = [f"| {r['severity']} | {r['rule']} | {cell(r['file'])} | {cell(r['line'])} | {cell(r['detail'] or r['message'])} |" for r in _ordered(violations)]
    head = f"# Findings\n\n{s['n_error']} errors, {s['n_warn']} warnings, {s['n_info']} infos; health score {s['health_score']} of 100.\n\n"
    return head + "| Severity | Rule | File | Line | Finding |\n|---|---|---|---|---|\n" + "".join(f"{r}\n" for r in rows)


def text(violations: DataFrame, summary: DataFrame, verbose: bool = False) -> str:
    """By severity and rule, then by file with ranges of lines."""
    s = summary.first()
    shown = violations if verbose else post.truncated(violations)
    ranges = post.line_ranges(shown).groupBy("rule", "file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_line", "lines"))), lambda x: x["lines"]), ", ").alias("lines"))
    groups = shown.groupBy("severity", "rule", "message", "file").agg(F.count("*").alias("n")).join(ranges, ["rule", "file"], "left")
    out = [f"{s['n_error']} errors, {s['n_warn']} warnings, {s['n_info']} infos in {s['n_files']} files; health {s['health_score']} ({s['status']})"]
    last = None
    for r in groups.orderBy(post.severity_rank(), "rule", "file").collect():
        if (r["severity"], r["rule"]) != last:
            last = (r["severity"], r["rule"])
            out += ["", f"{r['severity']}  {r['rule']}: {r['message']}"]
        out.append(f"  {r['file']}" + (f":{r['lines']}" if r["lines"] else ""))
    return "\n".join(out) + "\n"


def graph_dot(files: DataFrame, edges: DataFrame) -> str:
    """K6: barrels blue, tests yellow, re-exports bold, dynamic imports dotted."""
    colour = F.when(paths.is_barrel(F.col("path")), " [color=blue]").when(paths.is_test(F.col("path")), " [color=yellow]").otherwise("")
    style = F.when(F.col("kind") == "re_export", " [style=bold]").when(F.col("kind") == "dynamic_import", " [style=dotted]").otherwise("")
    nodes = files.select(F.concat(F.lit('  "'), F.col("path"), F.lit('"'), colour, F.lit(";")).alias("line")).orderBy("line")
    links = edges.where("target is not null").select(F.concat(F.lit('  "'), F.col("source"), F.lit('" -> "'), F.col("target"), F.lit('"'), style, F.lit(";")).alias("line")).distinct().orderBy("line")
    rows = [r["line"] for df in (nodes, links) for r in df.toLocalIterator()]
    return "digraph imports {\n" + "".join(f"{r}\n" for r in rows) + "}\n"


def graph_json(files: DataFrame, edges: DataFrame) -> str:
    names = {"import": "Import", "re_export": "ReExport", "dynamic_import": "DynamicImport"}
    nodes = [r.asDict() for r in files.select("path", paths.is_barrel(F.col("path")).alias("isBarrel"), paths.is_test(F.col("path")).alias("isTest")).orderBy("path").toLocalIterator()]
    links = [{"source": r["source"], "target": r["target"], "kind": names[r["kind"]]} for r in edges.where("target is not null").orderBy("source", "target", "kind").toLocalIterator()]
    return json.dumps({"nodes": nodes, "edges": links}, indent=2) + "\n"


def statistics(files: DataFrame, edges: DataFrame) -> dict[str, Any]:
    """K7: counts, unresolved imports by kind, the two rankings."""
    lost = graph.unresolved(edges).first().asDict()
    return {
        "files": files.count(),
        "imports": edges.count(),
        "unresolved": lost,
        "mostImported": [r.asDict() for r in graph.top(graph.fan_in(edges), "fan_in").collect()],
        "mostImporting": [r.asDict() for r in graph.top(graph.fan_out(edges), "fan_out").collect()],
    }


def statistics_text(stats: dict[str, Any]) -> str:
    out = [f"Files: {stats['files']}", f"Imports: {stats['imports']}", f"Unresolved: {stats['unresolved']['n_unresolved']}"]
    out += ["Most imported:", *(f"  {r['file']}: {r['fan_in']}" for r in stats["mostImported"])]
    out += ["Most importing:", *(f"  {r['file']}: {r['fan_out']}" for r in stats["mostImporting"])]
    return "\n".join(out) + "\n"
