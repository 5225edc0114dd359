"""Set-level processing of violations.

``violations(file, line, column, rule, message, severity, detail, subject)``; line,
column, detail and subject may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What makes two findings the same; detail and severity do not count.
KEY = ("file", "line", "column", "rule", "message", "subject")
SEVERITIES = ("error", "warn", "info")


def severity_rank(column: str = "severity") -> Column:
    return F.when(F.col(column) == "error", 0).when(F.col(column) == "warn", 1).when(F.col(column) == "info", 2).otherwise(3)


def _same(left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"b_{c}"]) for c in KEY])


def _keys(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"b_{c}") for c in KEY]).distinct()


def without_baseline(violations: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that the baseline does not know."""
    known = _keys(baseline)
    return violations.join(known, _same(violations, known), "left_anti")


def pruned_baseline(baseline: DataFrame, violations: DataFrame) -> DataFrame:
    """Baseline entries that still occur."""
    now = _keys(violations)
    return baseline.join(now, _same(baseline, now), "left_semi")


def make_baseline(violations: DataFrame) -> DataFrame:
    """L4: distinct keys; order them when writing."""
    return violations.select(*KEY).distinct()


def _directives(directives: DataFrame) -> DataFrame:
    return directives.select(F.col("path").alias("d_file"), "kind", F.col("line").alias("d_line"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))


def _silenced(directives: DataFrame) -> DataFrame:
    """What each directive silences: a row ``(file, at, about)`` for each of its
    rules; no line or no rule means any."""
    at = F.when(F.col("kind") == "line", F.col("d_line")).when(F.col("kind") == "next_line", F.col("d_line") + 1)
    rows = directives.where("kind = 'file' or d_line is not null")
    return rows.select("*", F.col("d_file").alias("file"), at.alias("at"), F.explode_outer("rules").alias("about"))


#: A key's form: whether it names a line, and whether it names a rule.
_FORMS = ((True, True), (True, False), (False, True), (False, False))


def _flagged(violations: DataFrame, directives: DataFrame) -> DataFrame:
    """``violations`` with ``_hit``, by an equi join for each form of key."""
    keys = _silenced(_directives(directives)).select("file", "at", "about").distinct()
    out, hits = violations, []
    for n, (line, rule) in enumerate(_FORMS):
        form = keys.where((F.col("at").isNotNull() == line) & (F.col("about").isNotNull() == rule))
        names = {"file": f"_file{n}", "at": f"_at{n}", "about": f"_about{n}"}
        same = (violations["file"] == F.col(f"_file{n}")) & ((violations["line"] == F.col(f"_at{n}")) if line else F.lit(True)) & ((violations["rule"] == F.col(f"_about{n}")) if rule else F.lit(True))
        out = out.join(form.withColumnsRenamed(names), same, "left")
        hits.append(F.col(f"_file{n}").isNotNull())
    return out.select(*violations.columns, reduce(lambda a, b: a | b, hits).alias("_hit"))


def suppress(violations: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings that no directive silences."""
    return _flagged(violations, directives).where("not _hit").drop("_hit")


def suppressed(violations: DataFrame, directives: DataFrame) -> DataFrame:
    return _flagged(violations, directives).where("_hit").drop("_hit")


def stale(directives: DataFrame, raw: DataFrame) -> DataFrame:
    """Directives that silence no raw finding.  Findings are cut down to
    distinct places before they meet the directives' keys."""
    d = _directives(directives)
    any_line, any_rule = F.lit(None).cast(raw.schema["line"].dataType), F.lit(None).cast("string")
    place = lambda line, rule: F.struct((F.col("line") if line else any_line).alias("at"), (F.col("rule") if rule else any_rule).alias("about"))
    forms = F.when(F.col("line").isNull(), F.array(*[place(*f) for f in _FORMS if not f[0]])).otherwise(F.array(*[place(*f) for f in _FORMS]))
    seen = raw.select("file", "line", "rule").distinct().select("file", F.inline(forms)).distinct()
    seen = seen.withColumnsRenamed({"file": "s_file", "at": "s_at", "about": "s_about"})
    own = _silenced(d)
    same = (own["file"] == seen["s_file"]) & own["at"].eqNullSafe(seen["s_at"]) & own["about"].eqNullSafe(seen["s_about"])
    live = own.join(seen, same, "left_semi").select(*[F.col(c).alias(f"l_{c}") for c in d.columns]).distinct()
    match = reduce(lambda a, b: a & b, [d[c].eqNullSafe(F.col(f"l_{c}")) for c in d.columns])
    return d.join(live, match, "left_anti").select(F.col("d_file").alias("path"), "kind", F.col("d_line").alias("line"), "rules")


def suppression_totals(raw: DataFrame, directives: DataFrame) -> DataFrame:
    """One row with the findings silenced and the directives gone stale."""
    a = suppressed(raw, directives).agg(F.count("*").alias("n_suppressed"))
    b = stale(directives, raw).agg(F.count("*").alias("n_stale"))
    return a.crossJoin(b)  # one row each


def summary(violations: DataFrame, n_files: int | Column) -> DataFrame:
    """Counts, health score and status in one row."""
    files = n_files if isinstance(n_files, Column) else F.lit(n_files).cast("long")
    counts = violations.agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES]).withColumn("n_files", files)
    penalty = F.expr("((2 * n_error + n_warn) * 100) div greatest(n_files, 1)")
    score = F.when(F.col("n_files") == 0, 100).otherwise(F.greatest(F.lit(0), 100 - penalty)).cast("long")
    status = F.when(F.col("n_error") > 0, "error").when(F.col("n_warn") > 0, "warn").when(F.col("n_info") > 0, "info").otherwise("healthy")
    return counts.withColumn("health_score", score).withColumn("status", status)


def by_rule(violations: DataFrame) -> DataFrame:
    """A row for each severity and rule; errors first, then the larger."""
    return violations.groupBy("severity", "rule").agg(F.count("*").alias("n")).orderBy(severity_rank(), F.desc("n"), "rule")


def by_file(violations: DataFrame) -> DataFrame:
    """A7."""
    return violations.groupBy("file").agg(F.count("*").alias("n")).orderBy("file")


def collected(violations: DataFrame) -> DataFrame:
    """The findings of each file as one sorted array."""
    return violations.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "column", "rule", "message"))).alias("findings"))


def truncated(violations: DataFrame, rules: int = 6, files: int = 6, lines: int = 8) -> DataFrame:
    """L3: what the text report shows of each rule, file and line."""
    per_rule = by_rule(violations).withColumn("rule_at", F.row_number().over(W.orderBy(severity_rank(), F.desc("n"), "rule"))).where(F.col("rule_at") <= rules)
    kept = violations.join(F.broadcast(per_rule.select("severity", "rule", "rule_at")), ["severity", "rule"])
    kept = kept.withColumn("file_at", F.dense_rank().over(W.partitionBy("severity", "rule").orderBy("file"))).where(F.col("file_at") <= files)
    w = W.partitionBy("severity", "rule", "file").orderBy("line", "column", "message")
    return kept.withColumn("line_at", F.row_number().over(w)).where(F.col("line_at") <= lines)


def line_ranges(violations: DataFrame) -> DataFrame:
    """Consecutive lines of a file and rule as ``a-b``; an equal line starts
    a new range."""
    w = W.partitionBy("file", "rule").orderBy("line", "column", "message")
    starts = F.when(F.col("line") == F.lag("line").over(w) + 1, 0).otherwise(1)
    rows = violations.where("line is not null").withColumn("new", starts).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    ranges = rows.groupBy("file", "rule", "island").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"))
    text = F.when(F.col("first_line") == F.col("last_line"), F.col("first_line").cast("string")).otherwise(F.concat_ws("-", "first_line", "last_line"))
    return ranges.select("file", "rule", "first_line", "last_line", text.alias("lines"))


def with_metadata(violations: DataFrame, rules: DataFrame) -> DataFrame:
    """Category and fixability by rule; the rule table has 64 rows."""
    return violations.join(F.broadcast(rules.select(F.col("name").alias("rule"), "category", "fixable")), "rule", "left")


def failing(violations: DataFrame, rules: DataFrame, default: str = "error", categories: dict[str, str] | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """P10: findings at or above their threshold: a rule's own, else its
    category's, else the default; ``any`` takes every finding."""
    rank = {"error": 0, "warn": 1, "any": 2}

    def pick(column: str, levels: dict[str, str] | None) -> Column:
        out = F.lit(None).cast("int")
        for k, v in sorted((levels or {}).items()):
            out = F.when(F.col(column) == k, rank[v]).otherwise(out)
        return out

    known = with_metadata(violations, rules)
    limit = F.coalesce(pick("rule", overrides), pick("category", categories), F.lit(rank[default]))
    return known.where(severity_rank() <= limit).select(violations.columns)


def overlapping_fixes(edits: DataFrame) -> DataFrame:
    """``(path, fix_id)`` of fixes with an edit that overlaps its neighbour;
    both whole fixes are rejected."""
    w = W.partitionBy("path").orderBy("start", "end", "fix_id", "edit_id")
    pairs = edits.select("path", "fix_id", "end", F.lead("start").over(w).alias("next_start"), F.lead("fix_id").over(w).alias("next_fix")).where(F.col("end") > F.col("next_start"))
    return pairs.select("path", "fix_id").union(pairs.select("path", "next_fix")).distinct()


def cache_split(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Each file as ``hit``, ``changed`` or ``new`` by its content hash."""
    old = cache.select("path", F.col("content_hash").alias("old_hash"))
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("content_hash"), "hit").otherwise("changed")
    return files.join(old, "path", "left").select("path", "content_hash", state.alias("state"))


def merged(old: DataFrame, new: DataFrame, affected: DataFrame) -> DataFrame:
    """Affected files take their new findings, the others keep theirs."""
    return old.join(affected.select(F.col("node").alias("file")).distinct(), "file", "left_anti").unionByName(new)


def duplicate_names(files: DataFrame) -> DataFrame:
    """Pairs of files of one name in different directories.  A name that
    very many files share makes many pairs, as it is asked for; the equi join on
    the name is split by Spark where it is skewed."""
    from stratalens.functions import paths

    rows = files.where(~paths.is_barrel(F.col("path"))).select("path", paths.base_name(F.col("path")).alias("name"), paths.parent(F.col("path")).alias("dir"))
    a, b = rows.withColumnsRenamed({"path": "file", "dir": "dir_a"}), rows.withColumnsRenamed({"path": "other", "dir": "dir_b"})
    return a.join(b, "name").where("file < other and dir_a <> dir_b").select("file", "other", "name")
