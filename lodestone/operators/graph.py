"""Graph algebra over a vertex table (node, is_direct) and an edge table (src, dst).

The root is no row: a vertex below it has is_direct. Vertices and edges are sets; every operator keeps them so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.closure import acyclic, circles, reach
from lodestone.operators.numbering import numbered
from lodestone.plans.scratch import materialise


def _vertices(rows: DataFrame) -> DataFrame:
    return rows.where("node IS NOT NULL").groupBy("node").agg(F.bool_or("is_direct").alias("is_direct"))


def _nodes(rows: DataFrame, direct: bool) -> DataFrame:
    return rows.select("node", F.lit(direct).alias("is_direct"))


#: Pairs of an origin and a deleted node up to which paths are followed node by node.
PAIRS = 10_000_000


def _ringed(inner: DataFrame, into: DataFrame, starts: DataFrame, leave: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``inner`` (src, dst), ``into`` (origin, node), ``starts`` (node) and ``leave`` (node, dst) with a node for each large ring.

    What lies beyond a ring is found once, not for each origin: a ring leaves to all of it, and no edge of ``inner`` leads out.
    """
    rings = materialise(circles(inner), "rings")

    def named(rows: DataFrame, c: str) -> DataFrame:
        ring = rings.select(F.col("node").alias(c), "ring")
        return rows.join(ring, c, "left").withColumn(c, F.coalesce("ring", c)).drop("ring")

    inner = materialise(named(named(inner, "src"), "dst").where("src <> dst").select("src", "dst").distinct(), "ringed")
    leave = materialise(named(leave, "node").select("node", "dst").distinct(), "ring-leave")
    ring = rings.select("ring").distinct()
    beyond = reach(inner, ring.select("ring", F.col("ring").alias("node"))).join(leave, "node").select(F.col("ring").alias("node"), "dst")
    leave = leave.join(ring.toDF("node"), "node", "left_anti").select("node", "dst").unionByName(beyond.distinct())
    inner = inner.join(ring.toDF("src"), "src", "left_anti").select("src", "dst")
    return materialise(inner, "ringed"), named(into, "node").distinct(), named(starts, "node").distinct(), materialise(leave, "ring-leave")


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    # Building and reading

    @staticmethod
    def build(directs: DataFrame, edges: DataFrame, deeps: DataFrame | None = None) -> Graph:
        """A graph of direct nodes (node), edges (src, dst), whose ends become vertices, and isolated nodes (node)."""
        edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
        ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
        rows = _nodes(directs, True).unionByName(_nodes(ends, False))
        if deeps is not None:
            rows = rows.unionByName(_nodes(deeps, False))
        return Graph(_vertices(rows), edges)

    def overlay(self, other: Graph) -> Graph:
        """Union of vertices and of edges; a vertex is direct if it is in either."""
        return Graph(_vertices(self.vertices.unionByName(other.vertices)), self.edges.unionByName(other.edges).distinct())

    def saved(self) -> Graph:
        """The same graph, read from tables in the shared folder."""
        return Graph(materialise(self.vertices, "vertices"), materialise(self.edges, "edges"))

    def size(self) -> DataFrame:
        return self.vertices.agg(F.count("*").alias("n"))

    def directs(self) -> DataFrame:
        return self.vertices.where("is_direct").select("node")

    def adjacency(self) -> DataFrame:
        """(node, successors array): every vertex, successors ascending."""
        lists = self.edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("successors"))
        none = F.array().cast("array<string>")
        return self.vertices.select("node").join(lists, "node", "left").select("node", F.coalesce("successors", none).alias("successors"))

    def with_predecessors(self) -> DataFrame:
        """(node, has_predecessors): predecessors other than the root."""
        targets = self.edges.select(F.col("dst").alias("node"), F.lit(True).alias("p")).distinct()
        return self.vertices.select("node").join(targets, "node", "left").select("node", F.coalesce("p", F.lit(False)).alias("has_predecessors"))

    def contains_edges(self, probes: DataFrame) -> DataFrame:
        """``probes`` (src, dst) with found."""
        known = self.edges.withColumn("found", F.lit(True))
        return probes.join(known, ["src", "dst"], "left").select("src", "dst", F.coalesce("found", F.lit(False)).alias("found"))

    # Rewriting

    def relabel(self, mapping: DataFrame) -> Graph:
        """Nodes renamed by ``mapping`` (node, to); nodes that meet become one. Nodes with a null or no name go, and their edges with them."""
        to = mapping.where("to IS NOT NULL").select("node", "to")
        vertices = self.vertices.join(to, "node").select(F.col("to").alias("node"), "is_direct")
        edges = self.edges.join(to.toDF("src", "s"), "src").join(to.toDF("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
        return Graph(_vertices(vertices), edges.distinct())

    def traverse(self, mapping: DataFrame) -> tuple[Graph, DataFrame]:
        """The graph renamed by ``mapping`` (node, to, problem), and (node, problem) of its nodes that cannot be renamed.

        One node with a problem, or without a row, fails the whole graph, which is then empty.
        """
        told = self.vertices.select("node").join(mapping.select("node", "to", "problem"), "node", "left")
        why = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("to").isNull(), "no name")
        problems = materialise(told.select("node", why.alias("problem")).where("problem IS NOT NULL"), "traverse-problems")
        whole = problems.isEmpty()
        graph = self.relabel(mapping)
        return (graph if whole else Graph(graph.vertices.limit(0), graph.edges.limit(0))), problems

    def induce(self, keep: DataFrame) -> Graph:
        """The graph of the nodes in ``keep`` (node); nothing is rewired."""
        kept = self.vertices.join(keep.select("node").distinct(), "node", "left_semi")
        names = kept.select("node")
        edges = self.edges.join(names.toDF("src"), "src", "left_semi").join(names.toDF("dst"), "dst", "left_semi")
        return Graph(kept, edges.select("src", "dst"))

    def shrink(self, deleted: DataFrame, promote: bool = True) -> Graph:
        """The graph without ``deleted`` (node): kept u and v are joined if a path of deleted nodes leads from u to v.

        A path back to u makes a self-loop. With ``promote`` nodes below deleted direct nodes become direct, without
        it directness stays what it was. Only paths through deleted nodes are followed, a round for each of their edges;
        where those have more edges than nodes and pairs may be many, large sets that reach each other are passed as one node.
        """
        deleted = materialise(deleted.select("node").distinct().join(self.vertices, "node", "left_semi"), "deleted")
        out_of = materialise(self.edges.join(deleted.toDF("src"), "src", "left_semi").select("src", "dst"), "deleted-edges")
        inner = materialise(out_of.join(deleted.toDF("dst"), "dst", "left_semi").select("src", "dst"), "deleted-inner")
        leave = out_of.join(deleted.toDF("dst"), "dst", "left_anti").select(F.col("src").alias("node"), "dst")
        stay = self.edges.join(deleted.toDF("src"), "src", "left_anti")
        into = stay.join(deleted.toDF("dst"), "dst", "left_semi").select(F.col("src").alias("origin"), F.col("dst").alias("node"))
        starts = self.directs().join(deleted, "node", "left_semi")
        n = deleted.count()
        ringed = inner.count() > n and into.count() * n > PAIRS
        if ringed:
            inner, into, starts, leave = _ringed(inner, into, starts, leave)
        # the root goes along as an origin without a name
        if promote:
            into = into.unionByName(starts.select(F.lit(None).cast(into.schema["origin"].dataType).alias("origin"), "node"))
        found = reach(inner, into)
        if ringed:  # most origins lead to the same few rings: without this one task writes what lies beyond one
            found = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "origin")
        found = found.join(leave, "node")
        through = found.where("origin IS NOT NULL").select(F.col("origin").alias("src"), "dst")
        edges = stay.join(deleted.toDF("dst"), "dst", "left_anti").select("src", "dst").unionByName(through).distinct()
        kept = self.vertices.join(deleted, "node", "left_anti")
        if not promote:
            return Graph(kept, edges)
        below = found.where("origin IS NULL").select(F.col("dst").alias("node")).distinct()
        return Graph(_vertices(kept.unionByName(_nodes(below, True))), edges)

    def shrink_roots(self) -> Graph:
        """Direct nodes are deleted, their successors become direct."""
        return self.shrink(self.directs())

    def strip_root(self) -> Graph:
        """Successors of direct nodes are the new direct nodes; the old ones stay."""
        new = self.edges.join(self.directs().toDF("src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        return Graph(_vertices(_nodes(self.vertices, False).unionByName(_nodes(new, True))), self.edges)

    def promote(self, test: Column) -> Graph:
        """Vertices for which ``test`` holds become direct too."""
        return Graph(self.vertices.select("node", (F.col("is_direct") | F.coalesce(test, F.lit(False))).alias("is_direct")), self.edges)

    def prune_unreachable(self) -> Graph:
        return self.induce(reach(self.edges, self.directs()))

    def subgraph(self, start: DataFrame) -> Graph:
        """What ``start`` (node) reaches, itself included; nodes that are no vertices reach nothing."""
        return self.induce(reach(self.edges, start.select("node").join(self.vertices, "node", "left_semi")))

    def prune_result(self, type_col: Column) -> Graph:
        """Unreachable vertices go, unless the graph has no direct node or no edge or its type keeps them."""
        no_direct, no_edge = self.directs().isEmpty(), self.edges.isEmpty()
        exempt = self.vertices.sparkSession.range(1).select(type_col.isin("swift", "gomod")).first()[0]
        return self if no_direct or no_edge or exempt else self.prune_unreachable()

    # Questions

    def roots_of(self, targets: DataFrame) -> DataFrame:
        """(target, node): direct nodes that reach each target, itself left out."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = reach(back, targets.select(F.col("node").alias("target"), "node"))
        return found.where("node <> target").join(self.directs(), "node", "left_semi").select("target", "node")

    def sources(self) -> DataFrame:
        return self.vertices.select("node").join(self.edges.select(F.col("dst").alias("node")), "node", "left_anti")

    def related(self, start: DataFrame) -> DataFrame:
        """Descendants and ancestors of ``start``, itself included."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return reach(self.edges, start).unionByName(reach(back, start)).distinct()

    def split(self) -> DataFrame:
        """(source, node): a part for each vertex without predecessors; none if the graph has a cycle."""
        if not acyclic(self.edges):
            return self.sources().select(F.col("node").alias("source"), "node").limit(0)
        return reach(self.edges, self.sources().select(F.col("node").alias("source"), "node"))

    def hydrate(self, labels: DataFrame) -> DataFrame:
        """(node, label): labels (node, label) of each node and of all that lead to it.

        Labels travel, not ancestors: work grows with nodes times different labels.
        """
        return reach(self.edges, labels.select("label", "node")).select("node", "label")

    def conditional_reach(self, origins: DataFrame, test: DataFrame) -> DataFrame:
        """(origin, node): nodes that are reached over edges whose end is in ``test`` (node); never the origin."""
        open_edges = self.edges.join(test.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        found = reach(open_edges, origins.select(F.col("node").alias("origin"), "node"), inclusive=False)
        return found.where("node <> origin").select("origin", "node")

    def refs(self) -> tuple[DataFrame, DataFrame]:
        """(id, node, is_direct) with ids 0.. in node order, and edges as (parent, child) ids."""
        ids, _ = numbered(self.vertices, ["node"], "id")
        names = ids.select("node", "id")
        edges = self.edges.join(names.toDF("src", "parent"), "src").join(names.toDF("dst", "child"), "dst").select("parent", "child")
        return ids.select("id", "node", "is_direct"), edges

    def dot(self) -> DataFrame:
        """(line): an edge line of the graphviz text each."""
        quote = lambda c: F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return self.edges.select(F.format_string('"%s" -> "%s";', quote("src"), quote("dst")).alias("line"))


def color(vertices: DataFrame, wanted: DataFrame, mark: str) -> DataFrame:
    """``vertices`` (node, property, colors array) where those with a wanted property gain ``mark``."""
    hit = vertices.join(wanted.select("property").distinct().withColumn("_hit", F.lit(True)), "property", "left")
    colors = F.when(F.col("_hit"), F.array_sort(F.array_union("colors", F.array(F.lit(mark))))).otherwise(F.col("colors"))
    return hit.select("node", "property", colors.alias("colors"))


def kinds_of_use(edges: DataFrame, workspace: DataFrame) -> DataFrame:
    """(node, production, development) over edges (src, dst, kind).

    Production: reached from ``workspace`` (node) over edges without a kind. Development: reached from an end of an
    edge with one. A node may be both.
    """
    production = reach(edges.where("kind IS NULL").select("src", "dst"), workspace)
    development = reach(edges.select("src", "dst"), edges.where("kind IS NOT NULL").select(F.col("dst").alias("node")))
    both = production.withColumn("p", F.lit(True)).join(development.withColumn("d", F.lit(True)), "node", "full")
    return both.select("node", F.coalesce("p", F.lit(False)).alias("production"), F.coalesce("d", F.lit(False)).alias("development"))


def owners(graph: Graph, modules: DataFrame) -> DataFrame:
    """(module, node): what each module (node) reaches without passing another module."""
    stop = modules.select("node").distinct()
    return graph.conditional_reach(stop, graph.vertices.select("node").join(stop, "node", "left_anti")).withColumnRenamed("origin", "module")


def scope_filter(graph: Graph, scopes: DataFrame, include: list[str], exclude: list[str]) -> Graph:
    """Nodes whose scopes (node, scopes array) do not pass are deleted with rewiring.

    ``include``: all scopes must be in it, nodes without scopes pass only if it is empty. ``exclude``: none may be in it.
    """
    s = F.col("scopes")
    inside = F.size(F.array_except(s, F.array(*map(F.lit, include)).cast("array<string>"))) == 0
    passes = (F.when(F.size(s) == 0, F.lit(not include)).otherwise(inside) if include else F.lit(True)) & ~F.arrays_overlap(s, F.array(*map(F.lit, exclude)).cast("array<string>"))
    return graph.shrink(scopes.where(~passes).select("node"))


def project_roots(graph: Graph, inside: DataFrame) -> DataFrame:
    """(node): sources in ``inside`` (node) are projects; other sources give way to their successors, until none is left."""
    outside = graph.vertices.select("node").join(inside.select("node"), "node", "left_anti")
    through = graph.edges.join(outside.toDF("src"), "src", "left_semi").select("src", "dst")
    return reach(through, graph.sources()).join(inside.select("node").distinct(), "node", "left_semi")


def last_write(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value): the value written last under each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))
