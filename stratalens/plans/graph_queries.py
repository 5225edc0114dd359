"""Graph operators over the derived edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import graph
from stratalens.operators.components import connected_components
from stratalens.plans import derived as d
from stratalens.registry import query
from stratalens.runtime import table

_CLOSURE = "reach as (select source as a, target as b from edges union select r.a, e.target from reach r join edges e on r.b = e.source)"
_NODES = "nodes as (select source as node from edges union select target from edges)"
_SCC = f"""{_CLOSURE}, {_NODES},
  comp as (select n.node, least(n.node, coalesce((select min(x.b) from reach x join reach y on y.a = x.b and y.b = x.a where x.a = n.node), n.node)) as component from nodes n),
  scc as (select node, component, count(*) over (partition by component) as n_nodes from comp)"""


@query("fan_in_top", f"with {d.EDGES} select target as file, count(*) as fan_in from edges group by 1 order by 2 desc, 1 limit 5")
def fan_in_top(spark, sf_dir):
    """A3, L1."""
    return graph.top(graph.fan_in(d.part_edges(spark, sf_dir)), "fan_in")


@query("fan_out_top", f"with {d.EDGES} select source as file, count(*) as fan_out from edges group by 1 order by 2 desc, 1 limit 5")
def fan_out_top(spark, sf_dir):
    """A4, L1."""
    return graph.top(graph.fan_out(d.part_edges(spark, sf_dir)), "fan_out")


@query("fan_in_all", f"with {d.EDGES} select target as file, count(*) as fan_in from edges group by 1")
def fan_in_all(spark, sf_dir):
    return graph.fan_in(d.part_edges(spark, sf_dir))


@query("imported_files", f"with {d.EDGES} select distinct target as file from edges")
def imported_files(spark, sf_dir):
    """A14."""
    return graph.imported_files(d.part_edges(spark, sf_dir))


@query("orphan_files", f"with {d.RECENT} select cast(s_suppkey as varchar) as file from supplier where cast(s_suppkey as varchar) not in (select target from recent)")
def orphan_files(spark, sf_dir):
    """G6."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"))
    return graph.orphans(known, d.recent_edges(spark, sf_dir))


_HREFS = r"""hrefs as (
  select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages),
known as (select distinct regexp_replace(url, '^https?://[^/]*([^?]*).*$', '\1') as path, min(page_id) as id from pages group by 1),
links as (select page_id, href, id, case when href like '/%' then 'relative' when href like '@%' then 'alias' else 'external' end as specifier_kind
  from hrefs left join known on known.path = href)"""


def _links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hrefs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    known = pages.select(F.regexp_replace("url", r"^https?://[^/]*([^?]*).*$", "$1").alias("href"), "page_id").groupBy("href").agg(F.min("page_id").alias("target"))
    kind = F.when(F.col("href").startswith("/"), "relative").when(F.col("href").startswith("@"), "alias").otherwise("external")
    return hrefs.join(known, "href", "left").select(F.col("page_id").alias("source"), "href", "target", kind.alias("specifier_kind"))


@query(
    "unresolved_imports",
    f"""with {_HREFS} select count(*) filter (where id is null and specifier_kind in ('relative', 'alias', 'package')) as n_unresolved,
  count(*) filter (where id is null and specifier_kind = 'relative') as n_relative, count(*) filter (where id is null and specifier_kind = 'alias') as n_alias,
  count(*) filter (where id is null and specifier_kind = 'package') as n_package from links""",
)
def unresolved_imports(spark, sf_dir):
    """A5 over page links."""
    return graph.unresolved(_links(spark, sf_dir))


@query(
    "edge_hash",
    f"""with {d.EDGES}, h as (select sha256(source || chr(31) || target) as h from edges),
  s as (select count(*) as n_edges, {", ".join(f"cast(sum(cast('0x' || substr(h, {1 + 8 * i}, 8) as bigint)) as varchar) as s{i}" for i in range(4))} from h)
  select n_edges, sha256(s0 || '-' || s1 || '-' || s2 || '-' || s3) as edge_hash from s""",
)
def edge_hash(spark, sf_dir):
    """A15."""
    return graph.edge_hash(d.part_edges(spark, sf_dir), ["source", "target"])


@query("scc_rings", f"with recursive {d.RINGS}, {_SCC} select node, component, n_nodes from scc")
def scc_rings(spark, sf_dir):
    """G1."""
    return graph.scc(d.ring_edges(spark, sf_dir))


@query("cyclic_files", f"with recursive {d.RINGS}, {_SCC} select node, component, n_nodes from scc where n_nodes > 1 or node in (select source from edges where source = target)")
def cyclic_files(spark, sf_dir):
    """G2."""
    return graph.cyclic_nodes(d.ring_edges(spark, sf_dir))


@query(
    "cycle_witness",
    f"""with recursive {d.RINGS}, {_SCC},
  walk as (select component, [component, e.target] as cycle, 1 as n from scc join edges e on e.source = component where node = component and n_nodes > 1
    union all select w.component, list_append(cycle, e.target), n + 1 from walk w join edges e on e.source = cycle[-1] where cycle[-1] <> w.component and n < 6)
  select component, array_to_string(min(cycle), ' -> ') as cycle from walk where cycle[-1] = component group by 1""",
)
def cycle_witness(spark, sf_dir):
    """G3, W8."""
    edges = d.ring_edges(spark, sf_dir)
    members = graph.cyclic_nodes(edges)
    return graph.witnesses(edges, members).select("component", F.array_join("cycle", " -> ").alias("cycle"))


@query(
    "cycle_witness_distributed",
    f"""with recursive {d.RINGS}, {_SCC},
  walk as (select component, [component, e.target] as cycle, 1 as n from scc join edges e on e.source = component where node = component and n_nodes > 1
    union all select w.component, list_append(cycle, e.target), n + 1 from walk w join edges e on e.source = cycle[-1] where cycle[-1] <> w.component and n < 6)
  select component, array_to_string(min(cycle), ' -> ') as cycle from walk where cycle[-1] = component group by 1""",
)
def cycle_witness_distributed(spark, sf_dir):
    """G3 without the search on the driver."""
    edges = d.ring_edges(spark, sf_dir)
    members = graph.cyclic_nodes(edges, graph.distributed_scc(edges))
    return graph.distributed_witnesses(graph._within(edges, members.where("n_nodes > 1"))).select("component", F.array_join("cycle", " -> ").alias("cycle"))


@query("scc_parts", f"with recursive {d.EDGES}, {_SCC} select node, component, n_nodes from scc")
def scc_parts(spark, sf_dir):
    """G1 on the graph of parts."""
    return graph.distributed_scc(d.part_edges(spark, sf_dir))


@query("scc_customers", f"with recursive {d.MIXED}, {_SCC} select node, component, n_nodes from scc")
def scc_customers(spark, sf_dir):
    """G1 on the graph of customers."""
    return graph.distributed_scc(d.mixed_edges(spark, sf_dir))


@query("scc_rings_distributed", f"with recursive {d.RINGS}, {_SCC} select node, component, n_nodes from scc")
def scc_rings_distributed(spark, sf_dir):
    """G1 without the search on the driver."""
    return graph.distributed_scc(d.ring_edges(spark, sf_dir))


@query("mixed_edges", f"with {d.MIXED} select source, target from edges")
def mixed_edges(spark, sf_dir):
    return d.mixed_edges(spark, sf_dir)


@query(
    "affected_files",
    f"""with recursive {d.RINGS}, {d.RECENT}, seeds as (select cast(s_suppkey as varchar) as node from supplier where s_acctbal < 3000),
  every as (select source, target from edges union select source, target from recent),
  both_ways as (select source as a, target as b from every union select target, source from every),
  hit as (select node from seeds union select b from hit join both_ways on a = node) select node from hit""",
)
def affected_files(spark, sf_dir):
    """G5."""
    seeds = table(spark, sf_dir, "supplier").where("s_acctbal < 3000").select(F.col("s_suppkey").cast("string").alias("node"))
    return graph.affected(d.ring_edges(spark, sf_dir), d.recent_edges(spark, sf_dir), seeds)


@query(
    "reachable_files",
    f"""with recursive {d.RINGS}, hit as (select cast(s_suppkey as varchar) as node from supplier where s_acctbal < 3000 union select target from hit join edges on source = node) select node from hit""",
)
def reachable_files(spark, sf_dir):
    """Directed reachability by a frontier loop."""
    seeds = table(spark, sf_dir, "supplier").where("s_acctbal < 3000").select(F.col("s_suppkey").cast("string").alias("node"))
    return graph.reach(d.ring_edges(spark, sf_dir), seeds)


@query(
    "components_parts",
    f"""with recursive {d.EDGES}, both_ways as (select source as a, target as b from edges union select target, source from edges),
  cc(node, component) using key (node) as (select distinct a, a from both_ways
    union select b, min(cc.component) from cc join both_ways on cc.node = a join recurring.cc r on r.node = b where cc.component < r.component group by b)
  select node, component from cc""",
)
def components_parts(spark, sf_dir):
    """Undirected components of the graph of parts."""
    return connected_components(d.part_edges(spark, sf_dir), "source", "target")


@query(
    "package_edges",
    f"with {d.EDGES}, {d.PACKAGES} select distinct a.package as from_package, b.package as to_package from edges join packages a on a.path = source join packages b on b.path = target where a.package <> b.package",
)
def package_edges(spark, sf_dir):
    """A13, J9."""
    return graph.package_edges(d.part_edges(spark, sf_dir), d.packages(spark, sf_dir))


_PKG = f"""{d.EDGES}, {d.PACKAGES}, pe as (select distinct a.package as from_package, b.package as to_package, source, target
  from edges join packages a on a.path = source join packages b on b.path = target where a.package <> b.package)"""


@query("first_package_edge", f"with {_PKG} select source, to_package, min(target) as target from pe group by 1, 2")
def first_package_edge(spark, sf_dir):
    """The first edge of a file into each other package."""
    owners = d.packages(spark, sf_dir)
    a = owners.select(F.col("path").alias("source"), F.col("package").alias("from_package"))
    b = owners.select(F.col("path").alias("target"), F.col("package").alias("to_package"))
    rows = d.part_edges(spark, sf_dir).join(a, "source").join(b, "target").where("from_package <> to_package")
    return graph.first_edge_into(rows, ["source", "to_package"], ["target"]).select("source", "to_package", "target")


@query(
    "package_cycles",
    f"""with recursive {d.EDGES}, {d.PACKAGES}, e as (select distinct a.package as s, b.package as t
    from edges join packages a on a.path = source join packages b on b.path = target where a.package <> b.package),
  up(node, label) using key (node) as (select distinct s, s from e
    union select t, min(up.label) from up join e on up.node = s join recurring.up r on r.node = t where up.label < r.label group by t),
  inner_e as (select s, t, a.label as c from e join up a on a.node = s join up b on b.node = t where a.label = b.label),
  walk(c, node, n, cycle) using key (c, node) as (select c, t, 1, min([s, t]) from inner_e where s = c group by 1, 2
    union select i.c, i.t, w.n + 1, min(list_append(w.cycle, i.t)) from walk w join inner_e i on i.c = w.c and i.s = w.node and w.node <> w.c
      left join recurring.walk r on r.c = i.c and r.node = i.t where r.node is null group by 1, 2, 3)
  select c as component, array_to_string(cycle, ' -> ') as cycle from walk where node = c""",
)
def package_cycles(spark, sf_dir):
    """One witness for each cycle of packages."""
    edges = package_edges(spark, sf_dir).withColumnsRenamed({"from_package": "source", "to_package": "target"})
    members = graph.cyclic_nodes(edges)
    return graph.witnesses(edges, members).select("component", F.array_join("cycle", " -> ").alias("cycle"))


@query(
    "edge_targets",
    f"with {d.EDGES} select source, target, a.p_brand as source_brand, b.p_brand as target_brand from edges join part a on cast(a.p_partkey as varchar) = source join part b on cast(b.p_partkey as varchar) = target",
)
def edge_targets(spark, sf_dir):
    """J7, J8."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_brand").alias("brand"))
    return graph.edges_to(d.part_edges(spark, sf_dir), parts).select("source", "target", "source_brand", "target_brand")


_TWO = f"{d.RINGS.replace('edges as', 'rings as')}, {d.EDGES}"


@query("graph_union", f"with {_TWO} select source, target from edges union select source, target from rings")
def graph_union(spark, sf_dir):
    """U2, U5."""
    return d.part_edges(spark, sf_dir).union(d.ring_edges(spark, sf_dir)).distinct()


@query("graph_union_all", f"with {_TWO} select source, target from edges union all select source, target from rings")
def graph_union_all(spark, sf_dir):
    """U1."""
    return d.part_edges(spark, sf_dir).unionByName(d.ring_edges(spark, sf_dir))


@query("graph_intersect", f"with {_TWO} select source from edges intersect select source from rings")
def graph_intersect(spark, sf_dir):
    """U3, J6."""
    return d.part_edges(spark, sf_dir).select("source").intersect(d.ring_edges(spark, sf_dir).select("source"))


@query("graph_except", f"with {_TWO} select source from edges except select source from rings")
def graph_except(spark, sf_dir):
    """U4."""
    return d.part_edges(spark, sf_dir).select("source").subtract(d.ring_edges(spark, sf_dir).select("source"))
