"""Import resolution as equi joins.

Nothing is matched by nested loops: files are indexed under every key they answer
to, and prefixes of specifiers and paths are exploded into keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import paths


def file_keys(files: DataFrame) -> DataFrame:
    """``(key, path)``: exact path, path without extension, and directory of a
    barrel; the first path in order owns a key."""
    p = F.col("path")
    keys = F.array_compact(F.array(p, F.regexp_replace(p, r"\.tsx?$", ""), F.when(paths.is_barrel(p), paths.parent(p))))
    return files.select("path", F.explode(F.array_distinct(keys)).alias("key")).groupBy("key").agg(F.min("path").alias("path"))


def is_relative(specifier: Column) -> Column:
    return specifier.rlike(r"^(\.|/)")


def resolve_relative(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``edges(source, specifier)`` with ``target`` of relative ones."""
    spec = F.col("specifier")
    joined = F.when(spec.startswith("/"), spec).otherwise(F.concat_ws("/", paths.parent(F.col("source")), spec))
    wanted = edges.withColumn("key", F.when(is_relative(spec), paths.normalize(joined)))
    return wanted.join(file_keys(files).withColumnRenamed("path", "target"), "key", "left").drop("key")


def _capture(alias: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with every alias whose pattern their specifier meets.  Specifiers
    are exploded into prefixes, so that the join has a key."""
    spec = F.col("specifier")
    exploded = edges.select("source", "specifier").distinct().withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length(spec)), lambda n: F.substring(spec, F.lit(1), n))))
    hit = exploded.join(alias, "prefix").where(F.col("specifier").endswith(F.col("suffix")) & (F.length("specifier") >= F.length("prefix") + F.length("suffix")))
    middle = F.substring(spec, F.length("prefix") + 1, F.length(spec) - F.length("prefix") - F.length("suffix"))
    exact = ~F.col("pattern").contains("*")
    return hit.where(~exact | (F.col("specifier") == F.col("pattern"))).withColumn("middle", middle).withColumn("exact", exact)


def resolve_alias(edges: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """``(source, specifier, exact, target)`` of specifiers that an
    alias names.  ``aliases(pattern, target)`` has a row for each target in order
    ``rank``; exact patterns come first, then the longest prefix that resolves."""
    parts = F.split(F.col("pattern"), r"\*", 2)
    rows = aliases.select("pattern", F.col("target").alias("template"), "rank", parts[0].alias("prefix"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("suffix"))
    hits = _capture(rows, edges)
    path = paths.normalize(F.replace(F.col("template"), F.lit("*"), F.col("middle")))
    keys = file_keys(files)
    # the module itself, else the barrel of its directory
    asked = hits.withColumn("k", F.explode(F.array(F.struct(F.lit(0).alias("step"), path.alias("key")), F.struct(F.lit(1).alias("step"), paths.parent(path).alias("key")))))
    asked = asked.select("source", "specifier", "exact", "pattern", "prefix", "rank", "k.step", "k.key")
    found = asked.join(keys.withColumnRenamed("path", "target"), "key", "left")
    barrel_only = (F.col("step") == 0) | paths.is_barrel(F.col("target"))
    order = F.struct(F.when(F.col("target").isNotNull() & barrel_only, 0).otherwise(1).alias("miss"), (~F.col("exact")).alias("wild"), (-F.length("prefix")).alias("longest"), "pattern", "rank", "step", F.when(barrel_only, F.col("target")).alias("target"), "exact")
    best = found.groupBy("source", "specifier").agg(F.min(order).alias("best"), F.max("exact").alias("exact"))
    return best.select("source", "specifier", "exact", "best.target")


def resolve_package(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """``(source, specifier, package, rest)``: the package with the longest
    name that is the specifier or stands before a slash in it."""
    spec = F.col("specifier")
    parts = F.split(spec, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keyed = edges.select("source", "specifier").distinct().withColumn("name", F.explode(prefixes))
    hit = keyed.join(packages.select("name"), "name")
    best = hit.groupBy("source", "specifier").agg(F.max_by("name", F.length("name")).alias("package"))
    rest = F.regexp_replace(F.substring(spec, F.length("package") + 1, F.length(spec)), "^/", "")
    return best.withColumn("rest", rest)


def nearest(files: DataFrame, places: DataFrame, directory: str, value: str, column: str) -> DataFrame:
    """``files`` with the ``value`` of the deepest place whose directory
    holds the path; null if none does."""
    keyed = files.select("path", F.posexplode(paths.ancestors(F.col("path"))).alias("up", "_dir"))
    hit = keyed.join(places.select(F.col(directory).alias("_dir"), F.col(value).alias(column)), "_dir")
    best = hit.groupBy("path").agg(F.min_by(column, "up").alias(column))
    return files.join(best, "path", "left")


def specifier_kind(spec: Column, alias_hit: Column, package: Column) -> Column:
    """An unresolved package import is external, as is an unresolved wildcard."""
    return F.when(is_relative(spec), "relative").when(alias_hit, "alias").when(package.isNotNull(), "package").otherwise("external")


def resolve(edges: DataFrame, files: DataFrame, aliases: DataFrame, packages: DataFrame, entries: DataFrame) -> DataFrame:
    """All of it: ``edges(source, specifier, ...)`` with ``specifier_kind`` and
    ``target``.  ``entries(package, subpath, path)`` are public entry points."""
    rel = resolve_relative(edges.select("source", "specifier").distinct(), files).select("source", "specifier", F.col("target").alias("rel_target"))
    bare = edges.where(~is_relative(F.col("specifier"))).select("source", "specifier").distinct()
    ali = resolve_alias(bare, aliases, files).select("source", "specifier", "exact", F.col("target").alias("alias_target"))
    pkg = resolve_package(bare, packages)
    ent = entries.select("package", F.col("subpath").alias("rest"), F.col("path").alias("entry"))
    dirs = packages.select(F.col("name").alias("package"), F.col("directory").alias("pkg_dir"))
    keys = file_keys(files).withColumnRenamed("path", "dir_target")
    pkg = pkg.join(ent, ["package", "rest"], "left").join(dirs, "package", "left")
    pkg = pkg.withColumn("key", paths.normalize(F.concat_ws("/", "pkg_dir", "rest"))).join(keys, "key", "left")
    pkg = pkg.select("source", "specifier", F.coalesce("entry", "dir_target").alias("pkg_target"))
    out = edges.join(rel, ["source", "specifier"], "left").join(ali, ["source", "specifier"], "left").join(pkg, ["source", "specifier"], "left")
    alias_hit = F.coalesce(F.col("exact") | F.col("alias_target").isNotNull(), F.lit(False))
    target = F.coalesce("rel_target", "alias_target", F.when(~alias_hit, F.col("pkg_target")))
    kind = specifier_kind(F.col("specifier"), alias_hit, F.col("pkg_target"))
    return out.select(*[edges[c] for c in edges.columns], kind.alias("specifier_kind"), target.alias("target"))
