"""Path predicates, nearest-ancestor joins, resolution and ordered scans
(SURVEY P1-P13, J1-J6, W1-W5, A10-A12) over derived facts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalens.functions import paths
from stratalens.operators import resolve
from stratalens.plans import derived as d
from stratalens.registry import query
from stratalens.runtime import table



def _p():
    return F.col("path")

LAYERS = (("data", ("src1", "src2/en"), ()), ("logic", ("src2", "en"), ()), ("tests", (), (".test.ts",)))


@query("source_files", rf"with {d.FILES} select path from files where regexp_matches(path, '\.tsx?$')")
def source_files(spark, sf_dir):
    """P1."""
    return d.files(spark, sf_dir).where(paths.is_source(_p()))


@query(
    "path_parts",
    rf"""with {d.FILES} select path, regexp_extract(path, '[^/]*$') as base, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') as stem,
  regexp_extract(path, '\.([^./]*)$', 1) as ext, regexp_replace(path, '/[^/]*$', '') as parent, len(string_split(path, '/')) as depth from files""",
)
def path_parts(spark, sf_dir):
    """2.10: base name, stem, extension, parent."""
    return d.files(spark, sf_dir).select("path", paths.base_name(_p()).alias("base"), paths.stem(_p()).alias("stem"), paths.extension(_p()).alias("ext"), paths.parent(_p()).alias("parent"), paths.depth(_p()).cast("long").alias("depth"))


@query("scope_prefix", f"with {d.FILES} select path from files where starts_with(path, 'src1/') or path = 'src1'")
def scope_prefix(spark, sf_dir):
    """P3."""
    return d.files(spark, sf_dir).where(paths.under(_p(), "src1"))


@query("domain_files", rf"with {d.FILES} select path from files where list_contains(string_split(path, '/'), 'de') or regexp_matches(path, '\.test\.ts$')")
def domain_files(spark, sf_dir):
    """P4."""
    return d.files(spark, sf_dir).where(paths.in_domain(_p(), ["de"], [".test.ts"]))


@query(
    "layer_for_file",
    rf"""with {d.FILES}, s as (select path, case when contains('/' || path || '/', '/src2/en/') then 7 when contains('/' || path || '/', '/src1/') then 4 end as a,
    case when contains('/' || path || '/', '/src2/') then 4 when contains('/' || path || '/', '/en/') then 2 end as b, case when regexp_matches(path, '\.test\.ts$') then 0 end as c from files)
  select path, case when a is not null and a >= coalesce(b, -1) and a >= coalesce(c, -1) then 0 when b is not null and b >= coalesce(c, -1) then 1 when c is not null then 2 end as layer from s""",
)
def layer_for_file(spark, sf_dir):
    """P5."""
    return d.files(spark, sf_dir).select("path", paths.layer_of(_p(), LAYERS).alias("layer"))


@query("entry_files", rf"with {d.FILES} select path from files where regexp_matches(path, '/index\.[^./]*$') or regexp_matches(path, '\.test\.ts$')")
def entry_files(spark, sf_dir):
    """P6."""
    return d.files(spark, sf_dir).where(paths.is_entry(_p(), ["index", ".test.ts"]))


@query(
    "type_location",
    rf"""with {d.FILES}, g as (select path, regexp_extract(path, '^[^/]*') as config_id, regexp_matches(path, '\.test\.ts$') as suffixed, list_contains(string_split(path, '/'), 'fr') as foldered from files)
  select path, (suffixed and (bool_or(suffixed) over w or not bool_or(foldered) over w)) or (foldered and bool_or(foldered) over w) as allowed from g window w as (partition by config_id)""",
)
def type_location(spark, sf_dir):
    """Per configuration group, suffix style and folder style."""
    rows = d.files(spark, sf_dir).withColumn("config_id", F.split("path", "/")[0]).withColumn("suffixed", _p().endswith(".test.ts")).withColumn("foldered", paths.in_domain(_p(), ["fr"], []))
    styles = rows.groupBy("config_id").agg(F.bool_or("suffixed").alias("any_suffix"), F.bool_or("foldered").alias("any_folder"))
    allowed = (F.col("suffixed") & (F.col("any_suffix") | ~F.col("any_folder"))) | (F.col("foldered") & F.col("any_folder"))
    return rows.join(styles, "config_id").select("path", allowed.alias("allowed"))


@query("glob_allow", rf"with {d.FILES} select path from files where regexp_matches(path, '^src[0-3]/[^/]*/doc_[^/]*\.ts$') or regexp_matches(path, '^(.*/)?m[^/]*/index\.tsx?$')")
def glob_allow(spark, sf_dir):
    """P8, P2."""
    return d.files(spark, sf_dir).where(paths.matches_any(_p(), ["src[0-3]/*/doc_*.ts", "**/m*/index.{ts,tsx}"]))


_SPECS = """specs as (select distinct spec from (select case page_id % 9 when 0 then 'node:fs' when 1 then '../' || page_id when 2 then '../../a/b' when 3 then './x' when 4 then './index' when 5 then 'react'
  when 6 then '@app/' || page_id when 7 then 'fs/promises' else './../up' end as spec from pages))"""


def _specs(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr(
        "case page_id % 9 when 0 then 'node:fs' when 1 then '../' || page_id when 2 then '../../a/b' when 3 then './x' when 4 then './index' when 5 then 'react' when 6 then '@app/' || page_id when 7 then 'fs/promises' else './../up' end as spec"
    ).distinct()


@query(
    "specifier_classes",
    rf"""with {_SPECS} select spec, case when spec like 'node:%' or spec like 'fs/%' then 'builtin' when spec like '@app/%' then 'internal' when spec like '../%' then 'parent'
  when spec = './index' then 'index' when spec like './%' then 'sibling' else 'external' end as class,
  cast(case when spec like '../../%' then 2 when spec like '../%' then 1 else 0 end as int) as up from specs""",
)
def specifier_classes(spark, sf_dir):
    """P12, P13."""
    s = F.col("spec")
    return _specs(spark, sf_dir).select("spec", paths.specifier_class(s, s.rlike(paths.glob_regex("@app/**"))).alias("class"), paths.upward_depth(s).cast("int").alias("up"))


@query("normalized_paths", r"select page_id, regexp_replace('a/' || (page_id % 50), '^a/', 'b/') as path from pages")
def normalized_paths(spark, sf_dir):
    """2.10: lexical normalization of ``a/./x/../../b/<n>`` and the like."""
    return table(spark, sf_dir, "pages").select("page_id", paths.normalize(F.concat(F.lit("../a/./x/../../b//"), (F.col("page_id") % 50).cast("string"), F.lit("/y/.."))).alias("path"))


_CONF = "configs as (select * from (values ('', 'root'), ('src1', 'one'), ('src1/en', 'one-en'), ('src2/en/m10', 'deep')) t(dir, config))"


@query(
    "nearest_config",
    f"""with {d.FILES}, {_CONF} select path, arg_max(config, length(dir)) as config from files join configs on dir = '' or starts_with(path, dir || '/') group by path""",
)
def nearest_config(spark, sf_dir):
    """J5, J9."""
    places = spark.createDataFrame([("", "root"), ("src1", "one"), ("src1/en", "one-en"), ("src2/en/m10", "deep")], "dir string, config string")
    return resolve.nearest(d.files(spark, sf_dir), places, "dir", "config", "config")


_IMPORTS = rf"""{d.FILES}, imp as (select path as source, unnest(['./' || regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', ''), '..', '@/en/x', '@src/' || regexp_replace(path, '\.[^./]*$', ''), 'lib1/x', 'react']) as specifier from files),
  keys as (select key, min(path) as path from (select path as key, path from files union all select regexp_replace(path, '\.tsx?$', ''), path from files where regexp_matches(path, '\.tsx?$')
    union all select regexp_replace(path, '/[^/]*$', ''), path from files where regexp_matches(path, '/index\.tsx?$')) k group by key)"""


def _imports(spark, sf_dir):
    specs = F.array(F.concat(F.lit("./"), paths.stem(_p())), F.lit(".."), F.lit("@/en/x"), F.concat(F.lit("@src/"), F.regexp_replace("path", r"\.[^./]*$", "")), F.lit("lib1/x"), F.lit("react"))
    return d.files(spark, sf_dir).select(_p().alias("source"), F.explode(specs).alias("specifier"))


@query(
    "resolve_relative",
    rf"""with {_IMPORTS} select source, specifier, keys.path as target from imp left join keys on specifier like '.%' and
  key = case when specifier = '..' then regexp_replace(source, '/?[^/]*/[^/]*$', '') else regexp_replace(source, '[^/]*$', '') || substr(specifier, 3) end""",
)
def resolve_relative(spark, sf_dir):
    """J1."""
    return resolve.resolve_relative(_imports(spark, sf_dir), d.files(spark, sf_dir)).select("source", "specifier", "target")


@query(
    "resolve_alias",
    rf"""with {_IMPORTS}, a as (select distinct source, specifier, case when specifier like '@src/%' then substr(specifier, 6) end as key from imp where specifier like '@%')
  select source, specifier, keys.path as target from a left join keys on keys.key = a.key""",
)
def resolve_alias(spark, sf_dir):
    """J2, J3, J3b."""
    aliases = spark.createDataFrame([("@src/*", "./*", 0), ("@/*", "nowhere/*", 0), ("@/*", "else/*", 1)], "pattern string, target string, rank int")
    edges = _imports(spark, sf_dir).where("specifier like '@%'")
    return resolve.resolve_alias(edges, aliases, d.files(spark, sf_dir)).select("source", "specifier", "target")


@query("resolve_package", f"with {_IMPORTS} select source, specifier, 'lib1' as package, 'x' as rest from imp where specifier = 'lib1/x'")
def resolve_package(spark, sf_dir):
    """J4."""
    packages = spark.createDataFrame([("lib1", "a"), ("lib", "b"), ("lib1/xy", "c")], "name string, directory string")
    return resolve.resolve_package(_imports(spark, sf_dir), packages)


@query("changed_files", f"with {d.FILES}, c as (select path from files where path like '%7.ts' union select 'gone.ts'), e as (select path from files where path like 'src%.ts') select path from e where path in (select path from c)")
def changed_files(spark, sf_dir):
    """Changed files that are eligible."""
    files = d.files(spark, sf_dir)
    changed = files.where(_p().endswith("7.ts")).union(spark.createDataFrame([("gone.ts",)], "path string")).distinct()
    return files.where(_p().startswith("src") & _p().endswith(".ts")).join(changed, "path", "left_semi")


_ITEMS = "items as (select l_orderkey as path, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as pos, l_returnflag as bucket, l_partkey as key, l_quantity as q from lineitem)"
_RUNS = f"{_ITEMS}, runs as (select *, sum(case when q > 40 then 1 else 0 end) over (partition by path order by pos) as run from items)"


def _items(spark, sf_dir):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.row_number().over(w).cast("long").alias("pos"), F.col("l_returnflag").alias("bucket"), F.col("l_partkey").alias("key"), F.col("l_quantity").alias("q"))


def _runs(spark, sf_dir):
    return _items(spark, sf_dir).withColumn("run", F.sum(F.when(F.col("q") > 40, 1).otherwise(0)).over(W.partitionBy("path").orderBy("pos")))


@query("adjacent_order", f"with {_RUNS}, p as (select path, run, pos, key, lag(key) over (partition by path, run order by pos) as before from runs) select path, pos, key, before from p where before > key")
def adjacent_order(spark, sf_dir):
    """Neighbours out of order within a contiguous run."""
    w = W.partitionBy("path", "run").orderBy("pos")
    return _runs(spark, sf_dir).withColumn("before", F.lag("key").over(w)).where("before > key").select("path", "pos", "key", "before")


@query("expected_position", f"with {_ITEMS}, e as (select path, pos, row_number() over (partition by path order by bucket, key, pos) as expected from items) select path, pos, expected from e where pos <> expected")
def expected_position(spark, sf_dir):
    """W4."""
    return _items(spark, sf_dir).withColumn("expected", F.row_number().over(W.partitionBy("path").orderBy("bucket", "key", "pos")).cast("long")).where("pos <> expected").select("path", "pos", "expected")


@query("newline_pairs", f"with {_ITEMS}, n as (select path, pos, bucket, lead(bucket) over (partition by path order by pos) as next_bucket, q from items) select path, pos, bucket, next_bucket from n where next_bucket <> bucket and q < 10")
def newline_pairs(spark, sf_dir):
    """Neighbours of different groups without a blank line between."""
    w = W.partitionBy("path").orderBy("pos")
    return _items(spark, sf_dir).withColumn("next_bucket", F.lead("bucket").over(w)).where("next_bucket <> bucket and q < 10").select("path", "pos", "bucket", "next_bucket")


@query("exports_per_file", f"with {_ITEMS} select path, count(*) as n from items group by 1 having count(*) > 6")
def exports_per_file(spark, sf_dir):
    """A10."""
    return _items(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n")).where("n > 6")


@query("single_names", f"with {_ITEMS}, c as (select path, pos, bucket, count(*) over (partition by path, bucket) as n from items) select path, pos, bucket from c where n <= 1")
def single_names(spark, sf_dir):
    """Names declared once in a file."""
    return _items(spark, sf_dir).withColumn("n", F.count("*").over(W.partitionBy("path", "bucket"))).where("n <= 1").select("path", "pos", "bucket")


@query("first_statement", f"with {_ITEMS} select path, min(pos) as pos, arg_min(key, pos) as key from items where q > 20 group by 1")
def first_statement(spark, sf_dir):
    """The first statement of a kind in each file."""
    return _items(spark, sf_dir).where("q > 20").groupBy("path").agg(F.min("pos").alias("pos"), F.min_by("key", "pos").alias("key"))


@query("items_per_directory", rf"with {d.FILES} select regexp_replace(path, '/[^/]*$', '') as dir, count(*) as n_items from files where regexp_matches(path, '\.tsx?$') group by 1 having count(*) > 3")
def items_per_directory(spark, sf_dir):
    """A12."""
    return d.files(spark, sf_dir).where(paths.is_source(_p())).groupBy(paths.parent(_p()).alias("dir")).agg(F.count("*").alias("n_items")).where("n_items > 3")
