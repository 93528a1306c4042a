"""Dependency trees printed as indented text: sbt, mix and rebar3.

A line's parent is the nearest earlier line one step less deep. Each line goes as a child to the level above its own
and as a parent to its own level, so one window over (file, tree, level) finds every parent in one pass, whatever the
depth. A tree begins at depth 0 and ends before the first line that does not fit below the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.closure import reach
from lodestone.operators.graph import Graph
from lodestone.plans.scratch import materialise
from lodestone.sources.manifests import _rows


def lines(files: DataFrame) -> DataFrame:
    """(file, at, text): the numbered lines of each content."""
    return files.select("file", F.posexplode(F.split("content", r"\r?\n")).alias("at", "text"))


def with_parents(rows: DataFrame) -> DataFrame:
    """(file, at, depth, item, parent): lines that belong to a tree, each with the item of the line it hangs on.

    ``rows``: (file, at, depth, item) for every line. A line with a null depth is no part of a tree; one with a depth
    and a null item holds a place: it has no item and nothing can hang on it.
    """
    whole = Window.partitionBy("file").orderBy("at")
    start = (F.col("depth") == 0) & F.col("item").isNotNull()
    rows = rows.withColumn("_start", F.coalesce(start, F.lit(False))).withColumn("_tree", F.sum(F.col("_start").cast("int")).over(whole))
    room = F.when(F.col("item").isNotNull(), F.col("depth") + 1).otherwise(F.col("depth"))
    before = F.lag(room).over(whole)
    wrong = ~F.col("_start") & ~F.coalesce((F.col("depth") >= 1) & (F.col("depth") <= before), F.lit(False))
    rows = rows.withColumn("_wrong", wrong).where("_tree > 0")
    rows = rows.withColumn("_over", F.max("_wrong").over(Window.partitionBy("file", "_tree").orderBy("at"))).where("NOT _over AND item IS NOT NULL")
    rows = rows.select("file", "_tree", "at", "depth", "item")
    level = lambda d, own: rows.select("file", "_tree", "at", "depth", "item", d.alias("_level"), own.alias("_own"))
    both = level(F.col("depth"), F.lit(True)).unionByName(level(F.col("depth") - 1, F.lit(False)))
    last = F.last(F.when(F.col("_own"), F.col("item")), ignorenulls=True).over(Window.partitionBy("file", "_tree", "_level").orderBy("at"))
    return both.withColumn("parent", last).where("NOT _own").select("file", "at", "depth", "item", "parent")


def _node(item: str) -> Column:
    return F.struct("file", F.col(item).alias("item"))


def as_graph(tree: DataFrame) -> Graph:
    """Nodes (file, item): those of depth 0 are direct, equal items of a file are one node."""
    edges = tree.where("parent IS NOT NULL").select(_node("parent").alias("src"), _node("item").alias("dst"))
    return Graph.build(tree.where("depth = 0").select(_node("item").alias("node")), edges)


def sbt_tree(files: DataFrame) -> DataFrame:
    """Trees of `sbt dependencyTree`: (file, at, depth, item, parent), items are (name, version).

    Log marks before a line are taken off. An evicted artifact has the version that evicted it.
    """
    text = F.regexp_replace("text", r"^\[(?:debug|info|warn|success|error|trace)\] ", "")
    rows = lines(files).select("file", "at", text.alias("text"))
    part = lambda i: F.regexp_extract("text", r"^([ |+#-]*+)(?:([\p{L}\p{N}._-]+):([\p{L}\p{N}._-]+):([\p{L}\p{N}._-]+)[ \t]*(?:\(evicted by:[ \t]*([\p{L}\p{N}._-]+)[ \t]*\))?|$)", i)
    fits = F.rlike("text", F.lit(r"^[ |+#-]*+(?:[\p{L}\p{N}._-]+:[\p{L}\p{N}._-]+:[\p{L}\p{N}._-]|$)"))
    wide = F.length(part(1))
    depth = F.when(fits & (wide == 0) & (part(2) != ""), 0).when(fits & (wide >= 4) & (wide % 2 == 0), ((wide - 2) / 2).cast("int"))
    item = F.struct(F.concat(part(2), F.lit(":"), part(3)).alias("name"), F.coalesce(F.nullif(part(5), F.lit("")), part(4)).alias("version"))
    return with_parents(rows.select("file", "at", depth.alias("depth"), F.when(fits & (part(2) != ""), item).alias("item")))


def sbt(files: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependencies and edges (file, src, dst), items for ends, of ``projects`` (file, name, version): what its own artifact reaches.

    The artifact itself and other projects among what it reaches give way to what hangs on them, which is direct. All is
    production. A project whose artifact is in no tree has none.
    """
    graph = as_graph(materialise(sbt_tree(files), "sbt-tree"))
    own = projects.select(F.struct("file", F.struct("name", "version").alias("item")).alias("node"))
    graph = graph.subgraph(own).shrink_roots()
    rows = graph.vertices.select("node.file", "node.item.name", "node.item.version", "is_direct")
    return _rows(rows, F.col("name"), F.col("version"), direct=F.col("is_direct")), graph.edges.select("src.file", F.col("src.item").alias("src"), F.col("dst.item").alias("dst"))


_GIT = r"^((?:https?|git)://[^ )]*)(?: - ([\p{L}\p{N}.]+))?$"


def _scm(text: Column) -> Column:
    return F.when(text == "Hex package", "hex").when(F.rlike(text, F.lit(_GIT)), "git").otherwise("other")


def mix_resolved(files: DataFrame) -> DataFrame:
    """(file, name, version, url, ref): entries of `mix deps` from a package index or a repository."""
    entry = files.select("file", F.explode(F.split(F.concat(F.lit("\n"), "content"), r"\n\* ")).alias("t"))
    part = lambda i: F.nullif(F.regexp_extract("t", r"^(\S+)[ \t]+(?:([\p{L}\p{N}.-]+)[ \t]+)?\(([^)]*)\)[^\n]*(?:\n[ \t]*locked at[ \t]+([\p{L}\p{N}.-]+))?", i), F.lit(""))
    rows = entry.select("file", part(1).alias("name"), part(2).alias("version"), part(3).alias("scm"), part(4).alias("ref")).where("name IS NOT NULL AND scm IS NOT NULL")
    return rows.where(_scm(F.col("scm")) != "other").select("file", "name", "version", F.when(_scm(F.col("scm")) == "git", F.regexp_extract("scm", _GIT, 1)).alias("url"), "ref")


def mix(trees: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependencies (file, name, version, type, is_direct) and edges (file, src, dst), names, of `mix deps.tree`, with `mix deps` beside it.

    A version is the resolved one, else the locked one, else that of the tree: a repository's revision or the
    requirement as it stands, none for `*`. A package from a repository is named by its address. What comes from
    elsewhere, a folder say, is left out with all below it. The first line of a tree is the project.
    """
    rows = lines(trees).where("at > 0")
    part = lambda i: F.regexp_extract("text", r"^([^\p{L}\p{N}]*?)--[ \t]*([^ ]*)[ \t]*([^(]*)\(([^)]*)\)", i)
    wide = F.length(part(1))
    fits = (part(2) != "") & (part(4) != "") & (wide % 4 == 1)
    item = F.struct(part(2).alias("name"), F.nullif(F.regexp_replace(F.trim(part(3)), r"^={1,2}\s*", ""), F.lit("")).alias("asked"), part(4).alias("scm"), F.col("at").alias("at"))
    tree = materialise(with_parents(rows.select("file", "at", F.when(fits, ((wide - 1) / 4).cast("int")).alias("depth"), F.when(fits, item).alias("item"))), "mix-tree")
    place = lambda c: F.struct("file", F.col(f"{c}.at").alias("at"))
    other = tree.where(_scm(F.col("item.scm")) == "other").select(place("item").alias("node"))
    below = reach(tree.where("parent IS NOT NULL").select(place("parent").alias("src"), place("item").alias("dst")), other).select("node.*")
    tree = tree.join(below, ["file", "at"], "left_anti")
    known = mix_resolved(resolved).groupBy("file", "name").agg(F.struct(F.max("url").alias("url"), F.max(F.coalesce("version", "ref")).alias("version")).alias("r"))

    def facts(c: str) -> DataFrame:
        """Each item as a dependency."""
        rows = tree.where(f"{c} IS NOT NULL").select("file", "at", F.col("depth"), f"{c}.*").drop("at")
        rows = rows.join(known, ["file", "name"], "left")
        git, ref = F.regexp_extract("scm", _GIT, 1), F.nullif(F.regexp_extract("scm", _GIT, 2), F.lit(""))
        name = F.coalesce("r.url", F.when(git != "", git), "name")
        version = F.coalesce("r.version", F.when(git != "", F.coalesce(ref, "asked")).otherwise(F.nullif("asked", F.lit("*"))))
        return rows.select("file", F.struct("name", "asked", "scm").alias("key"), name.alias("name"), version.alias("version"), F.when(git != "", "git").otherwise("hex").alias("type"), (F.col("depth") == 0).alias("is_direct"))

    items = materialise(facts("item"), "mix-items")
    names = items.select("file", "key", F.col("name").alias("to")).distinct()
    key = lambda c: F.struct(f"{c}.name", f"{c}.asked", f"{c}.scm")
    edges = tree.where("parent IS NOT NULL").select("file", key("parent").alias("key"), key("item").alias("child"))
    edges = edges.join(names.withColumnRenamed("to", "src"), ["file", "key"]).select("file", "src", F.col("child").alias("key")).join(names.withColumnRenamed("to", "dst"), ["file", "key"])
    return items.groupBy("file", "name", "version", "type").agg(F.bool_or("is_direct").alias("is_direct")), edges.select("file", "src", "dst").distinct()


def rebar_aliases(configs: DataFrame) -> DataFrame:
    """(file, name, package): dependencies of a rebar.config that stand for a package of another name."""
    block = F.regexp_extract("content", r"(?s)\{\s*deps\s*,\s*\[(.*?)\]\s*\}\s*\.", 1)
    pair = F.explode(F.regexp_extract_all(block, F.lit(r"\{\s*(\w+\s*,\s*(?:\"[^\"]*\"\s*,\s*)?\{\s*pkg\s*,\s*\w+)\s*\}\s*\}"), F.lit(1)))
    rows = configs.select("file", pair.alias("t"))
    return rows.select("file", F.regexp_extract("t", r"^(\w+)", 1).alias("name"), F.regexp_extract("t", r"(\w+)$", 1).alias("package"))


def rebar3(trees: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependencies (file, name, version, type, is_direct) and edges (file, src, dst), names, of `rebar3 tree -v`.

    A dependency from GitHub is named by its address; one at the top that its configuration gives another package's name
    is named by that.
    """
    part = lambda i: F.regexp_extract("text", r"^ ([ │]*)(?:& |├─ |└─ )([^─]*)─([^ ]*) \(([^)]*)\)", i)
    wide = F.length(part(1))
    fits = (part(4) != "") & (wide % 3 > 0)
    item = F.struct(part(2).alias("name"), part(3).alias("version"), part(4).alias("at"))
    depth = ((wide - 1) / 3).cast("int")
    rows = lines(trees).select("file", "at", F.when(fits, depth).alias("depth"), F.when(fits, F.struct(item.alias("i"), (depth == 0).alias("top"))).alias("item"))
    tree = with_parents(rows)
    aliases = rebar_aliases(configs).dropDuplicates(["file", "name"])
    git = lambda c: F.contains(f"{c}.i.at", F.lit("github.com"))

    def named(tree: DataFrame, c: str) -> DataFrame:
        tree = tree.withColumn("name", F.col(f"{c}.i.name")).join(aliases, ["file", "name"], "left")
        return tree.withColumn(f"_{c}", F.when(git(c), F.col(f"{c}.i.at")).when(F.col(f"{c}.top"), F.coalesce("package", "name")).otherwise(F.col("name"))).drop("name", "package")

    tree = materialise(named(named(tree, "item"), "parent"), "rebar-tree")
    rows = tree.select("file", F.col("_item").alias("name"), F.col("item.i.version").alias("version"), F.when(git("item"), "git").otherwise("hex").alias("type"), (F.col("depth") == 0).alias("is_direct"))
    edges = tree.where("parent IS NOT NULL").select("file", F.col("_parent").alias("src"), F.col("_item").alias("dst")).distinct()
    return rows.groupBy("file", "name", "version", "type").agg(F.bool_or("is_direct").alias("is_direct")), edges
