"""Import-graph operators.

Edges are ``(source, target)`` strings unless stated; ``target`` may be null for an
unresolved import.  Loops cut their lineage through written tables.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalens.operators import small_graph
from stratalens.operators.components import connected_components
from stratalens.runtime import materialize

MAX_LEVELS = 10_000
#: Graphs of up to so many edges, by count, are searched on the driver.
DRIVER_EDGES = 100_000


def fan_in(edges: DataFrame) -> DataFrame:
    """A3: resolved edges of each target."""
    return edges.where("target is not null").groupBy(F.col("target").alias("file")).agg(F.count("*").alias("fan_in"))


def fan_out(edges: DataFrame) -> DataFrame:
    """A4: all edges of each source, external ones too."""
    return edges.groupBy(F.col("source").alias("file")).agg(F.count("*").alias("fan_out"))


def top(counts: DataFrame, column: str, n: int = 5) -> DataFrame:
    """L1: the largest counts; ties by path."""
    return counts.orderBy(F.desc(column), "file").limit(n)


def unresolved(edges: DataFrame) -> DataFrame:
    """A5: one row with the unresolved imports of each kind."""
    missing = F.col("target").isNull()
    kinds = [F.count_if(missing & (F.col("specifier_kind") == k)).alias(f"n_{k}") for k in ("relative", "alias", "package")]
    return edges.agg(F.count_if(missing & F.col("specifier_kind").isin("relative", "alias", "package")).alias("n_unresolved"), *kinds)


def imported_files(edges: DataFrame) -> DataFrame:
    """Distinct resolved targets; a file that imports itself counts."""
    return edges.where("target is not null").select(F.col("target").alias("file")).distinct()


def orphans(files: DataFrame, edges: DataFrame, exempt=None) -> DataFrame:
    """Files that nothing imports; ``exempt`` tells tests and entry files."""
    kept = files if exempt is None else files.where(~exempt)
    return kept.join(imported_files(edges), kept["path"] == F.col("file"), "left_anti").select(F.col("path").alias("file"))


def edge_hash(edges: DataFrame, columns: list[str]) -> DataFrame:
    """A digest that does not depend on the order of edges.  Each edge is
    hashed; the digests are summed in four parts, so no task holds all edges."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    digest = edges.select(F.sha2(text, 256).alias("h"))
    part = lambda i: F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
    sums = digest.agg(F.count("*").alias("n_edges"), *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)])
    return sums.select("n_edges", F.sha2(F.concat_ws("-", *[f"s{i}" for i in range(4)]), 256).alias("edge_hash"))


def reach(edges: DataFrame, seeds: DataFrame, undirected: bool = False) -> DataFrame:
    """Nodes reachable from ``seeds(node)``, seeds included even if unknown."""
    steps = edges.where("target is not null").select("source", "target")
    if undirected:
        steps = steps.union(steps.select("target", "source"))
    steps = materialize(steps.distinct(), "steps")
    seen = materialize(seeds.select("node").distinct(), "seen")
    front = seen
    for _ in range(MAX_LEVELS):
        new = front.join(steps, front["node"] == steps["source"]).select(F.col("target").alias("node")).distinct()
        front = materialize(new.join(seen, "node", "left_anti"), "front")
        if front.isEmpty():
            return seen
        seen = materialize(seen.union(front), "seen")
    raise RuntimeError("reachability did not converge")


def affected(old_edges: DataFrame, new_edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Files whose findings may change: undirected reachability over both
    graphs; one component pass instead of a frontier for each level."""
    both = old_edges.select("source", "target").union(new_edges.select("source", "target")).where("target is not null").distinct()
    parts = materialize(connected_components(both, "source", "target"), "parts")
    hit = parts.join(seeds.select("node").distinct(), "node").select("component").distinct()
    return parts.join(hit, "component", "left_semi").select("node").union(seeds.select("node")).distinct()


def _trim(edges: DataFrame) -> DataFrame:
    """Drop edges whose ends cannot lie on a cycle, until none is left."""
    edges = materialize(edges, "trim")
    before = edges.count()
    while before:
        sources, targets = edges.select(F.col("source").alias("n")).distinct(), edges.select(F.col("target").alias("n")).distinct()
        edges = edges.join(sources, edges["target"] == F.col("n"), "left_semi")
        edges = edges.join(targets, edges["source"] == F.col("n"), "left_semi")
        edges = materialize(edges, "trim")
        after = edges.count()
        if after == before:
            break
        before = after
    return edges


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Smallest label that reaches each node along edges."""
    while True:
        sent = edges.join(labels, edges["source"] == labels["node"]).select(F.col("target").alias("node"), "label")
        new = labels.union(sent).groupBy("node").agg(F.min("label").alias("label"))
        new = materialize(new, "labels")
        changed = new.join(labels.withColumnRenamed("label", "before"), "node").where("label < before")
        if changed.isEmpty():
            return new
        labels = new


def _few(edges: DataFrame) -> list[tuple[str, str]] | None:
    """The edges themselves if a bounded count shows that they are few."""
    rows = edges.limit(DRIVER_EDGES + 1).collect()
    return [(r[0], r[1]) for r in rows] if len(rows) <= DRIVER_EDGES else None


def scc(edges: DataFrame) -> DataFrame:
    """G1: ``(node, component, n_nodes)``; the component is its smallest node.

    Up to ``DRIVER_EDGES`` edges, counted first, are searched depth-first on the
    driver; larger graphs stay distributed."""
    clean = edges.where("source is not null and target is not null").select("source", "target").distinct()
    few = _few(clean)
    if few is None:
        return distributed_scc(clean)
    label = small_graph.tarjan(few)
    sizes = Counter(label.values())
    return edges.sparkSession.createDataFrame([(k, v, sizes[v]) for k, v in sorted(label.items())], "node string, component string, n_nodes long")


def distributed_scc(edges: DataFrame) -> DataFrame:
    """G1 for graphs of any size.

    Forward-backward colouring: every node takes the smallest label that
    reaches it; a label's strongly connected component is what of its colour
    reaches the label's own node.  Found components leave, the rest goes on."""
    clean = materialize(edges.select("source", "target").distinct(), "edges")
    nodes = clean.select(F.col("source").alias("node")).union(clean.select("target")).distinct()
    left = _trim(clean.where("source <> target"))
    done: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select(F.col("source").alias("node")).union(left.select("target")).distinct()
        colours = _spread(left, ends.withColumn("label", F.col("node")))
        a = colours.select(F.col("node").alias("source"), F.col("label").alias("ca"))
        b = colours.select(F.col("node").alias("target"), F.col("label").alias("cb"))
        inside = materialize(left.join(a, "source").join(b, "target").where("ca = cb").select("source", "target", F.col("ca").alias("colour")), "inside")
        roots = colours.where("node = label").select("node", F.col("label").alias("colour"))
        found = front = materialize(roots, "roots")
        while True:
            back = front.join(inside, (front["node"] == inside["target"]) & (front["colour"] == inside["colour"])).select(F.col("source").alias("node"), inside["colour"]).distinct()
            front = materialize(back.join(found, ["node", "colour"], "left_anti"), "back")
            if front.isEmpty():
                break
            found = materialize(found.union(front), "found")
        done.append(found)
        gone = found.select(F.col("node").alias("n"))
        left = left.join(gone, left["source"] == gone["n"], "left_anti")
        left = _trim(left.join(gone, left["target"] == gone["n"], "left_anti"))
    members = nodes.withColumn("component", F.lit(None).cast("string"))
    if done:
        every = done[0]
        for d in done[1:]:
            every = every.union(d)
        members = nodes.join(every.select("node", F.col("colour").alias("component")), "node", "left")
    members = materialize(members.select("node", F.coalesce("component", "node").alias("component")), "members")
    sizes = materialize(members.groupBy("component").agg(F.count("*").alias("n_nodes")), "sizes")
    return members.join(sizes, "component").select("node", "component", "n_nodes")


def cyclic_nodes(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """``(node, component, n_nodes)`` of nodes that lie on a cycle."""
    members = scc(edges) if members is None else members
    loops = edges.where("source = target").select(F.col("source").alias("node")).distinct().withColumn("loop", F.lit(True))
    return members.join(loops, "node", "left").where("n_nodes > 1 or loop").select("node", "component", "n_nodes")


def _within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(source, target, c)``: edges inside one cyclic component."""
    own = members.select("node", "component")
    inner = edges.select("source", "target").distinct().join(own.withColumnsRenamed({"node": "source", "component": "c"}), "source")
    return inner.join(own.withColumnsRenamed({"node": "target", "component": "d"}), "target").where("c = d").select("source", "target", "c")


def witnesses(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(component, cycle)``: for each cyclic component the shortest cycle
    through its smallest node, the first in order of paths; closed, so the first
    node is also the last."""
    inner = _within(edges, members)
    rows = inner.limit(DRIVER_EDGES + 1).collect()
    if len(rows) > DRIVER_EDGES:
        return distributed_witnesses(inner)
    by: dict[str, list[tuple[str, str]]] = {}
    for r in rows:
        by.setdefault(r["c"], []).append((r["source"], r["target"]))
    found = [(c, small_graph.shortest_cycle(e, c)) for c, e in sorted(by.items())]
    return edges.sparkSession.createDataFrame([x for x in found if x[1]], "component string, cycle array<string>")


def distributed_witnesses(inner: DataFrame) -> DataFrame:
    """G3 for graphs of any size: a breadth-first search for all components at
    once; a node keeps one path, so nothing grows with the number of paths."""
    inner = materialize(inner, "inner")
    front = seen = materialize(inner.where("source = c").select(F.col("c"), F.col("source").alias("node"), F.array("source").alias("path")).dropDuplicates(["c"]), "start")
    closed: list[DataFrame] = []
    while True:
        steps = front.join(inner, (front["c"] == inner["c"]) & (front["node"] == inner["source"])).select(front["c"], "target", "path")
        steps = materialize(steps.groupBy("c", "target").agg(F.min("path").alias("path")).withColumn("path", F.array_append("path", F.col("target"))), "steps")
        closed.append(steps.where("target = c").select("c", "path"))
        ended = steps.where("target = c").select("c")
        front = steps.where("target <> c").select("c", F.col("target").alias("node"), "path")
        front = front.join(ended, "c", "left_anti").join(seen.select("c", "node"), ["c", "node"], "left_anti")
        front = materialize(front, "front")
        if front.isEmpty():
            break
        seen = materialize(seen.select("c", "node").union(front.select("c", "node")), "seen")
    out = closed[0]
    for c in closed[1:]:
        out = out.union(c)
    return out.select(F.col("c").alias("component"), F.col("path").alias("cycle"))


def edges_to(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with the properties of both ends; targets outside drop out."""
    a = files.select([F.col(c).alias(f"source_{c}" if c != "path" else "source") for c in files.columns])
    b = files.select([F.col(c).alias(f"target_{c}" if c != "path" else "target") for c in files.columns])
    return edges.join(a, "source").join(b, "target")


def package_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Distinct pairs of different packages with an import between them;
    ``owners(path, package)``."""
    a = owners.select(F.col("path").alias("source"), F.col("package").alias("from_package"))
    b = owners.select(F.col("path").alias("target"), F.col("package").alias("to_package"))
    return edges.join(a, "source").join(b, "target").where("from_package <> to_package").select("from_package", "to_package").distinct()


def first_edge_into(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first edge of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
