"""Facts derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalens.runtime import table

_PATH = """coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || case doc_id % 10
  when 0 then 'm' || doc_id || '/index.ts' when 1 then 'doc_' || doc_id || '.test.ts'
  when 2 then 'n' || (doc_id % 7) || '/doc_' || (doc_id % 50) || '.tsx' when 3 then 'notes_' || doc_id || '.md'
  else 'doc_' || doc_id || '.ts' end"""
FILES = f"files as (select distinct {_PATH} as path from documents)"
EDGES = """edges as (
  select distinct cast(src as varchar) as source, cast(dst as varchar) as target from (
    select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by
      l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as dst, l_quantity
    from lineitem) t where dst is not null)"""
RINGS = """edges as (
  select cast(s_suppkey as varchar) as source, cast(coalesce(lead(s_suppkey) over w, first_value(s_suppkey) over w) as varchar) as target
  from supplier window w as (partition by cast(floor(s_suppkey / 4) as bigint) order by s_suppkey))"""
MIXED = """edges as (
  select distinct cast(o_custkey as varchar) as source, cast(dst as varchar) as target from (
    select o_orderkey, o_custkey, lead(o_custkey) over (order by o_orderkey) as dst from orders) t
  where dst is not null)"""
RECENT = """recent as (
  select cast(src as varchar) as source, cast(dst as varchar) as target from (
    select s_suppkey as src, s_acctbal, lead(s_suppkey) over (partition by s_nationkey order by s_suppkey) as dst from supplier) t
  where dst is not null and s_acctbal > 5000)"""
VIOLATIONS = """raw as (
  select 'part/' || (l_partkey % 50) as file, case when l_linenumber = 7 then null else l_linenumber end as line,
    cast(l_quantity as int) as "column", 'rule_' || (l_suppkey % 8) as rule, l_returnflag || l_linestatus as message,
    case when l_discount >= 0.08 then 'error' when l_discount >= 0.04 then 'warn' else 'info' end as severity,
    case when l_tax > 0.05 then l_returnflag end as subject, l_discount as discount
  from lineitem),
violations as (select file, line, "column", rule, message, severity, subject from raw),
baseline as (select distinct file, line, "column", rule, message, subject from raw where discount < 0.03)"""
DIRECTIVES = """directives as (
  select distinct 'part/' || (event_id % 50) as path, case event_id % 60 when 0 then 'file' when 20 then 'line' else 'next_line' end as kind,
    cast(event_id % 7 as int) as line, case when event_id % 40 = 0 then [] else ['rule_' || (event_id % 8)] end as rules
  from events)"""
PACKAGES = "packages as (select distinct 'lib' || (p_partkey % 40) as package, cast(p_partkey as varchar) as path from part)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(f"{_PATH} as path").distinct()


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part to the next part of its order; the order of lines is total."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("dst", F.lead("l_partkey").over(w)).where("dst is not null")
    return rows.select(F.col("l_partkey").cast("string").alias("source"), F.col("dst").cast("string").alias("target")).distinct()


def ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy(F.floor(F.col("s_suppkey") / 4)).orderBy("s_suppkey")
    target = F.coalesce(F.lead("s_suppkey").over(w), F.first("s_suppkey").over(w))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("source"), target.cast("string").alias("target"))


def recent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier of some wealth to the next of its nation."""
    w = W.partitionBy("s_nationkey").orderBy("s_suppkey")
    rows = table(spark, sf_dir, "supplier").withColumn("dst", F.lead("s_suppkey").over(w)).where("dst is not null and s_acctbal > 5000")
    return rows.select(F.col("s_suppkey").cast("string").alias("source"), F.col("dst").cast("string").alias("target"))


def mixed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer to that of the next order, without one global window: keys
    are dense, so a range's last order looks up the first of the next range by
    an equi join."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("part", F.floor(F.col("o_orderkey") / 4096))
    w = W.partitionBy("part").orderBy("o_orderkey")
    inside = orders.withColumn("dst", F.lead("o_custkey").over(w))
    heads = orders.groupBy("part").agg(F.min_by("o_custkey", "o_orderkey").alias("head"))
    next_part = heads.select((F.col("part") - 1).alias("part"), "head")
    rows = inside.join(next_part, "part", "left").withColumn("dst", F.coalesce("dst", "head"))
    rows = rows.where("dst is not null")
    return rows.select(F.col("o_custkey").cast("string").alias("source"), F.col("dst").cast("string").alias("target")).distinct()


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'part/' || (l_partkey % 50) as file",
        "case when l_linenumber = 7 then null else l_linenumber end as line",
        "cast(l_quantity as int) as column",
        "'rule_' || (l_suppkey % 8) as rule",
        "l_returnflag || l_linestatus as message",
        "case when l_discount >= 0.08 then 'error' when l_discount >= 0.04 then 'warn' else 'info' end as severity",
        "case when l_tax > 0.05 then l_returnflag end as subject",
        "l_discount as discount",
    )


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).drop("discount")


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).where("discount < 0.03").select("file", "line", "column", "rule", "message", "subject").distinct()


def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "'part/' || (event_id % 50) as path",
        "case event_id % 60 when 0 then 'file' when 20 then 'line' else 'next_line' end as kind",
        "cast(event_id % 7 as int) as line",
        "case when event_id % 40 = 0 then cast(array() as array<string>) else array('rule_' || (event_id % 8)) end as rules",
    ).distinct()


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("'lib' || (p_partkey % 40) as package", "cast(p_partkey as string) as path").distinct()
