"""Findings, suppressions, baselines and reports over derived violations
(SURVEY J10-J17, A1-A2, A6-A9, A16, W6-W7, L3-L4, P10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import post
from stratalens.plans import derived as d
from stratalens.registry import query
from stratalens.runtime import table

_SAME = " and ".join(f'v."{c}" is not distinct from b."{c}"' for c in post.KEY)
_V = 'v.file, v.line, v."column", v.rule, v.message, v.severity, v.subject'
_COVER = "d.path = v.file and (d.kind = 'file' or (d.kind = 'line' and v.line = d.line) or (d.kind = 'next_line' and v.line = d.line + 1)) and (len(d.rules) = 0 or list_contains(d.rules, v.rule))"
_RULES = """rules as (select 'rule_' || i as rule, case when i < 4 then 'imports' else 'hygiene' end as category, i % 2 = 0 as fixable from range(8) t(i))"""


def _rules(spark):
    return spark.range(8).selectExpr("'rule_' || id as name", "case when id < 4 then 'imports' else 'hygiene' end as category", "id % 2 = 0 as fixable")


@query("baseline_filter", f"with {d.VIOLATIONS} select {_V} from violations v where not exists (select 1 from baseline b where {_SAME})")
def baseline_filter(spark, sf_dir):
    """J10."""
    return post.without_baseline(d.violations(spark, sf_dir), d.baseline(spark, sf_dir))


@query(
    "baseline_prune",
    f"""with {d.VIOLATIONS}, now as (select * from violations where rule <> 'rule_3')
  select v.file, v.line, v."column", v.rule, v.message, v.subject from baseline v where exists (select 1 from now b where {_SAME})""",
)
def baseline_prune(spark, sf_dir):
    """J11."""
    return post.pruned_baseline(d.baseline(spark, sf_dir), d.violations(spark, sf_dir).where("rule <> 'rule_3'"))


@query("baseline_create", f'with {d.VIOLATIONS} select distinct file, line, "column", rule, message, subject from violations')
def baseline_create(spark, sf_dir):
    """L4."""
    return post.make_baseline(d.violations(spark, sf_dir))


@query("suppression_filter", f"with {d.VIOLATIONS}, {d.DIRECTIVES} select {_V} from violations v where not exists (select 1 from directives d where {_COVER})")
def suppression_filter(spark, sf_dir):
    """J12."""
    return post.suppress(d.violations(spark, sf_dir), d.directives(spark, sf_dir))


@query("stale_directives", f"with {d.VIOLATIONS}, {d.DIRECTIVES} select d.path, d.kind, d.line, array_to_string(d.rules, ',') as rules from directives d where not exists (select 1 from violations v where {_COVER})")
def stale_directives(spark, sf_dir):
    """J13."""
    return post.stale(d.directives(spark, sf_dir), d.violations(spark, sf_dir)).withColumn("rules", F.concat_ws(",", "rules"))


@query(
    "suppression_totals",
    f"""with {d.VIOLATIONS}, {d.DIRECTIVES} select (select count(*) from violations v where exists (select 1 from directives d where {_COVER})) as n_suppressed,
  (select count(*) from directives d where not exists (select 1 from violations v where {_COVER})) as n_stale""",
)
def suppression_totals(spark, sf_dir):
    """A9."""
    return post.suppression_totals(d.violations(spark, sf_dir), d.directives(spark, sf_dir))


@query(
    "health_summary",
    f"""with {d.VIOLATIONS}, c as (select count(*) filter (where severity = 'error') as n_error, count(*) filter (where severity = 'warn') as n_warn,
    count(*) filter (where severity = 'info') as n_info from violations), f as (select count(*) as n_files from part)
  select n_error, n_warn, n_info, n_files, cast(greatest(0, 100 - ((2 * n_error + n_warn) * 100) // n_files) as bigint) as health_score,
    case when n_error > 0 then 'error' when n_warn > 0 then 'warn' when n_info > 0 then 'info' else 'healthy' end as status from c, f""",
)
def health_summary(spark, sf_dir):
    """A1, A2, A2b."""
    return post.summary(d.violations(spark, sf_dir), table(spark, sf_dir, "part").count())


@query("findings_by_rule", f"with {d.VIOLATIONS} select severity, rule, count(*) as n from violations group by 1, 2")
def findings_by_rule(spark, sf_dir):
    """A6."""
    return post.by_rule(d.violations(spark, sf_dir))


@query("findings_by_file", f"with {d.VIOLATIONS} select file, count(*) as n from violations group by 1")
def findings_by_file(spark, sf_dir):
    """A7."""
    return post.by_file(d.violations(spark, sf_dir))


@query("findings_collected", f"with {d.VIOLATIONS} select file, count(*) as n, cast(sum(coalesce(line, 0)) as bigint) as lines from violations group by 1")
def findings_collected(spark, sf_dir):
    """A8, unnested to counts."""
    rows = post.collected(d.violations(spark, sf_dir))
    lines = F.aggregate("findings", F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x["line"], F.lit(0)))
    return rows.select("file", F.size("findings").cast("long").alias("n"), lines.alias("lines"))


@query(
    "report_truncation",
    f"""with {d.VIOLATIONS}, rk as (select *, case severity when 'error' then 0 when 'warn' then 1 else 2 end as sr from violations),
  r as (select severity, rule, row_number() over (order by min(sr), count(*) desc, rule) as rule_at from rk group by 1, 2),
  f as (select v.*, rule_at, dense_rank() over (partition by v.severity, v.rule order by file) as file_at from violations v join r on v.severity = r.severity and v.rule = r.rule where rule_at <= 6),
  l as (select *, row_number() over (partition by severity, rule, file order by line nulls first, "column", message) as line_at from f where file_at <= 6)
  select severity, rule, file, count(*) as n_shown from l where line_at <= 8 group by 1, 2, 3""",
)
def report_truncation(spark, sf_dir):
    """L3."""
    return post.truncated(d.violations(spark, sf_dir)).groupBy("severity", "rule", "file").agg(F.count("*").alias("n_shown"))


@query(
    "line_ranges",
    f"""with {d.VIOLATIONS}, o as (select *, case when line = lag(line) over w + 1 then 0 else 1 end as new from violations where line is not null
    window w as (partition by file, rule order by line, "column", message)),
  i as (select *, sum(new) over (partition by file, rule order by line, "column", message rows unbounded preceding) as island from o)
  select file, rule, min(line) as first_line, max(line) as last_line, case when min(line) = max(line) then cast(min(line) as varchar) else min(line) || '-' || max(line) end as lines
  from i group by file, rule, island""",
)
def line_ranges(spark, sf_dir):
    """W6."""
    return post.line_ranges(d.violations(spark, sf_dir))


@query(
    "fail_policy",
    f"""with {d.VIOLATIONS}, {_RULES} select {_V} from violations v join rules on rules.rule = v.rule
  where case severity when 'error' then 0 when 'warn' then 1 else 2 end <= case when v.rule = 'rule_5' then 2 when category = 'imports' then 1 else 0 end""",
)
def fail_policy(spark, sf_dir):
    """P10, J17."""
    return post.failing(d.violations(spark, sf_dir), _rules(spark), "error", {"imports": "warn"}, {"rule_5": "any"})


@query("rule_metadata", f"with {d.VIOLATIONS}, {_RULES} select category, fixable, count(*) as n from violations v join rules on rules.rule = v.rule group by 1, 2")
def rule_metadata(spark, sf_dir):
    """J17."""
    return post.with_metadata(d.violations(spark, sf_dir), _rules(spark)).groupBy("category", "fixable").agg(F.count("*").alias("n"))


_EDITS = """edits as (select 'p' || (l_orderkey % 200) as path, l_partkey as fix_id, cast(l_linenumber * 10 + l_suppkey % 5 as int) as "start",
  cast(l_linenumber * 10 + l_suppkey % 5 + l_quantity as int) as "end", l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 as edit_id from lineitem)"""


@query(
    "overlapping_fixes",
    f"""with {_EDITS}, p as (select path, fix_id, "end", lead("start") over w as ns, lead(fix_id) over w as nf from edits window w as (partition by path order by "start", "end", fix_id, edit_id))
  select path, fix_id from p where "end" > ns union select path, nf from p where "end" > ns""",
)
def overlapping_fixes(spark, sf_dir):
    """W7, F2."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "'p' || (l_orderkey % 200) as path",
        "l_partkey as fix_id",
        "cast(l_linenumber * 10 + l_suppkey % 5 as int) as start",
        "cast(l_linenumber * 10 + l_suppkey % 5 + l_quantity as int) as end",
        "l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 as edit_id",
    )
    return post.overlapping_fixes(rows)


@query(
    "cache_split",
    """with c as (select doc_id, sha256(text) as content_hash, case when doc_id % 5 = 0 then sha256(text || 'x') else sha256(text) end as old_hash from documents)
  select cast(doc_id as varchar) as path, content_hash, case when doc_id % 4 = 0 then 'new' when old_hash = content_hash then 'hit' else 'changed' end as state from c""",
)
def cache_split(spark, sf_dir):
    """J15, A16."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    old = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    cache = docs.where("doc_id % 4 <> 0").select("path", old.alias("content_hash"))
    return post.cache_split(docs.select("path", F.sha2("text", 256).alias("content_hash")), cache)


@query(
    "incremental_merge",
    f"""with {d.VIOLATIONS}, hit as (select distinct 'part/' || (p_partkey % 50) as node from part where p_size > 48)
  select file, rule, count(*) as n from violations where file not in (select node from hit) or rule <> 'rule_2' group by 1, 2""",
)
def incremental_merge(spark, sf_dir):
    """The files of large parts are linted again with one rule off."""
    old = d.violations(spark, sf_dir)
    hit = table(spark, sf_dir, "part").where("p_size > 48").selectExpr("'part/' || (p_partkey % 50) as node").distinct()
    new = old.where("rule <> 'rule_2'").join(hit, F.col("file") == F.col("node"), "left_semi")
    return post.merged(old, new, hit).groupBy("file", "rule").agg(F.count("*").alias("n"))


@query(
    "duplicate_names",
    rf"""with {d.FILES}, f as (select path, regexp_extract(path, '[^/]*$') as name, regexp_replace(path, '/[^/]*$', '') as dir from files)
  select a.path as file, b.path as other, a.name from f a join f b on a.name = b.name and a.path < b.path and a.dir <> b.dir where a.name not in ('index.ts', 'index.tsx')""",
)
def duplicate_names(spark, sf_dir):
    """J14."""
    return post.duplicate_names(d.files(spark, sf_dir))
