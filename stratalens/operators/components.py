"""Connected components of an edge list of any size.

Each round gives every node the smallest random priority within two hops and
contracts the graph along that choice.  Priorities are drawn anew each round,
so long paths shrink by a constant factor and stars and cliques vanish at once.
Nothing is collected; hub nodes meet only in joins that Spark splits at run
time or in aggregates that are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.runtime import materialize, packed, release

MAX_ROUNDS = 60


def _priority(node: str, seed: int):
    return F.struct(F.xxhash64(F.col(node), F.lit(seed)).alias("p"), F.col(node).alias("n"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rows: int | None = None) -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the
    smallest node id of its component.  Edges are undirected; self-loops keep
    their node, nulls are dropped, repeats do not matter.  ``rows`` is the number of
    ``edges``, if it is known."""
    base = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = base.unionByName(base.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = materialize(both if rows is None else packed(both, 2 * rows), "links")
    # no later table has more rows
    total = links.count()
    nodes = links.select(F.col("a").alias("node")).distinct()
    links = links.where("a <> b")
    steps: list[DataFrame] = []
    table = None
    for seed in range(MAX_ROUNDS):
        if links.isEmpty():
            break
        near = (
            links.groupBy("a")
            .agg(F.min(_priority("b", seed)).alias("m"))
            .select(F.col("a").alias("node"), F.least("m", _priority("a", seed)).alias("m"))
        )
        step = links.join(near.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("m").alias("m"))
        step = materialize(packed(step.select(F.col("a").alias("node"), F.col("m.n").alias("label")), total), "step")
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        shorter = links.join(left, "a").join(right, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        shorter = materialize(packed(shorter, total), "links")
        if seed:
            release(table)
        links = table = shorter
    else:
        raise RuntimeError("connected components did not converge")
    found = nodes.withColumn("label", F.col("node"))
    for step in steps:
        hop = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        found = found.join(hop, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    found = materialize(packed(found, total), "found")
    least = materialize(packed(found.groupBy("label").agg(F.min("node").alias("component")), total), "least")
    release(*steps)
    return found.join(least, "label").select("node", "component")
