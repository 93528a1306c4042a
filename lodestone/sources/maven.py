"""Maven project files with their parents: projects, what they inherit, and their graphs.

``files`` (repo, path, content) hold the listings of many repositories at once; every join is within a repository, so
any number of them goes through the same few jobs. Projects are found over parent links between coordinates, not
between files. What a project file inherits is taken over its line of parents, found by pointer jumping in as many
rounds as the logarithm of the longest line, and decided key by key: a nearer file's value goes before a farther one's.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.dependencies import interpolate
from lodestone.functions.paths import joined
from lodestone.operators.closure import lineage, reach
from lodestone.operators.graph import Graph, project_roots
from lodestone.plans.scratch import materialise

_LIST = "array<struct<groupId:string,artifactId:string,version:string,classifier:string,scope:string,optional:string>>"
_LICENSES = "array<struct<name:string,url:string>>"
_SCHEMA = (
    "parent struct<groupId:string,artifactId:string,version:string,relativePath:string>, groupId string, artifactId string, version string, properties map<string,string>, "
    f"modules struct<module:array<string>>, dependencyManagement struct<dependencies:struct<dependency:{_LIST}>>, dependencies struct<dependency:{_LIST}>, licenses struct<license:{_LICENSES}>"
)
_FIELDS = ("version", "classifier", "scope", "optional")


class Closure(NamedTuple):
    """All projects of some repositories.

    ``poms``: (node, repo, path, properties, managed, dependencies, licenses, parent), one for each coordinate; a node is
    (repo, group, artifact, version). ``projects``: (root, repo, project), a root's node and path. ``members``: (root,
    node), what lies below and above a root. ``walked``: (root, node), a root and the files below it.
    """

    poms: DataFrame
    projects: DataFrame
    members: DataFrame
    walked: DataFrame


def _read(files: DataFrame) -> DataFrame:
    p = F.from_xml("content", _SCHEMA, {"rowTag": "project", "ignoreNamespace": "true"})
    rows = files.select("repo", "path", p.alias("p")).where("p.artifactId IS NOT NULL")
    up = F.when(F.col("p.parent.groupId").isNotNull() & F.col("p.parent.artifactId").isNotNull() & F.col("p.parent.version").isNotNull(), F.col("p.parent"))
    rows = rows.withColumn("up", up)

    def listed(c: str) -> Column:
        """A list of dependencies; one of them without group or artifact empties it."""
        none = F.array().cast(_LIST)
        given = F.coalesce(c, none)
        return F.when(F.exists(given, lambda d: d["groupId"].isNull() | d["artifactId"].isNull()), none).otherwise(given)

    coordinate = F.struct("repo", F.coalesce("p.groupId", "up.groupId").alias("group"), F.col("p.artifactId").alias("artifact"), F.coalesce("p.version", "up.version").alias("version"))
    parent = F.when(F.col("up").isNotNull(), F.struct("repo", F.col("up.groupId").alias("group"), F.col("up.artifactId").alias("artifact"), F.col("up.version").alias("version")))
    near = F.when(F.col("up").isNotNull(), F.array(F.coalesce("up.relativePath", F.lit("../pom.xml")))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        coordinate.alias("node"), "repo", "path", parent.alias("parent"), F.coalesce("p.properties", F.create_map().cast("map<string,string>")).alias("properties"),
        listed("p.dependencyManagement.dependencies.dependency").alias("managed"), listed("p.dependencies.dependency").alias("dependencies"),
        F.coalesce("p.licenses.license", F.array().cast(_LICENSES)).alias("licenses"),
        F.concat(near, F.coalesce("p.modules.module", F.array().cast("array<string>"))).alias("near"),
    )


def project_files(files: DataFrame) -> DataFrame:
    """The project files of a listing, read: those named so outside of `target` folders, and those that their parents and modules lead to.

    A path leads to a file, or to the `pom.xml` of a folder. A file that is no XML, has no artifact or no group or
    version, be it by its parent, is left out; of repeated paths any one is taken.
    """
    files = files.select("repo", "path", "content").dropDuplicates(["repo", "path"])
    new = files.where(F.rlike("path", F.lit(r"(pom\.xml|\.pom)$")) & ~F.rlike("path", F.lit(r"(^|/)target/")))
    parts = [materialise(_read(new), "poms")]
    while True:
        to = parts[-1].select("repo", F.explode("near").alias("to"), F.regexp_replace("path", r"[^/]*$", "").alias("dir"))
        to = to.select("repo", joined(F.col("dir"), F.col("to")).alias("path")).where("path IS NOT NULL")
        to = to.unionByName(to.select("repo", F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("/"))), F.lit("pom.xml")).alias("path"))).distinct()
        known = parts[0].select("repo", "path")
        for p in parts[1:]:
            known = known.unionByName(p.select("repo", "path"))
        new = files.join(to, ["repo", "path"], "left_semi").join(known, ["repo", "path"], "left_anti")
        read = materialise(_read(new), "poms")
        if read.isEmpty():
            break
        parts.append(read)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("node.group IS NOT NULL AND node.version IS NOT NULL").drop("near")


def closure(poms: DataFrame) -> Closure:
    """The projects that ``poms``, as :func:`project_files` reads them, make up.

    Links lead from parents' coordinates to their children's. A coordinate without a predecessor is a project; one
    that no file has gives way to its successors. Of files of one coordinate the last by path counts.
    """
    links = materialise(poms.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("node").alias("dst")).distinct(), "pom-links")
    one = poms.groupBy("node").agg(F.max_by(F.struct(*[c for c in poms.columns if c != "node"]), "path").alias("p")).select("node", "p.*")
    one = materialise(one, "poms-by-coordinate")
    names = one.select("node")
    graph = Graph.build(names.limit(0), links, names)
    roots = project_roots(graph, names)
    projects = materialise(roots.withColumnRenamed("node", "root").join(one.select(F.col("node").alias("root"), "repo", F.col("path").alias("project")), "root"), "maven-projects")
    start = projects.select("root", F.col("root").alias("node"))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    members = reach(links, start).unionByName(reach(back, start)).distinct()
    walked = reach(links.join(names.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), start)
    return Closure(one, projects, members, walked)


def _lines(c: Closure) -> DataFrame:
    """(root, node, ancestor, depth): each walked file's line of parents within its project's closure, itself at depth 0."""
    up = c.poms.where("parent IS NOT NULL").select("node", F.col("parent").alias("to"))
    line = c.walked.join(lineage(up, c.poms.select("node")), "node")
    inside = c.members.select("root", F.col("node").alias("ancestor"), F.lit(True).alias("inside"))
    line = line.join(inside, ["root", "ancestor"], "left")
    cut = line.groupBy("root", "node").agg(F.min(F.when(F.col("inside").isNull(), F.col("depth"))).alias("cut"))
    return line.join(cut, ["root", "node"]).where("cut IS NULL OR depth < cut").select("root", "node", "ancestor", "depth")


def _entries(poms: DataFrame, listed: str) -> DataFrame:
    """(ancestor, group, artifact, version...): the entries of one list; the last of an artifact counts."""
    rows = poms.select(F.col("node").alias("ancestor"), F.posexplode(listed).alias("at", "d")).select("ancestor", "at", "d.*")
    last = rows.groupBy("ancestor", F.col("groupId").alias("group"), F.col("artifactId").alias("artifact")).agg(F.max_by(F.struct(*_FIELDS), "at").alias("d"))
    return last.select("ancestor", "group", "artifact", "d.*")


def _inherited(line: DataFrame, entries: DataFrame) -> DataFrame:
    """(root, node, group, artifact, version...): each field from the nearest file of the line that gives it."""
    rows = line.join(entries, "ancestor")
    nearest = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c) for c in _FIELDS]
    return rows.groupBy("root", "node", "group", "artifact").agg(*nearest)


def dependencies(c: Closure) -> DataFrame:
    """(root, node, group, artifact, version, scope, optional): what each walked file depends on, inherited entries and all.

    Fields that an entry leaves open come from parents and then from the managed dependencies of the whole line. Names in
    `${}` stand for the line's properties, or the coordinate of the file itself; a classifier follows the version.
    """
    line = materialise(_lines(c), "pom-lines")
    found = _inherited(line, _entries(c.poms, "dependencies"))
    managed = _inherited(line, _entries(c.poms, "managed")).select("root", "node", "group", "artifact", F.struct(*_FIELDS).alias("m"))
    rows = found.join(managed, ["root", "node", "group", "artifact"], "left")
    rows = rows.select("root", "node", "group", "artifact", *[F.coalesce(f, f"m.{f}").alias(f) for f in _FIELDS])
    props = line.join(c.poms.select(F.col("node").alias("ancestor"), F.explode("properties").alias("key", "value")), "ancestor")
    props = props.groupBy("root", "node", "key").agg(F.min_by("value", "depth").alias("value"))
    props = props.groupBy("root", "node").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("props"))  # one file's own
    rows = rows.join(props, ["root", "node"], "left")
    own = F.create_map(F.lit("project.groupId"), F.col("node.group"), F.lit("project.artifactId"), F.col("node.artifact"), F.lit("project.version"), F.col("node.version"))
    given = F.coalesce("props", F.create_map().cast("map<string,string>"))
    rows = rows.withColumn("props", F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(given, k)), given))
    filled = lambda x: interpolate(F.col(x), F.col("props"))
    version = F.when(F.col("classifier").isNull(), filled("version")).otherwise(F.concat(filled("version"), F.lit(":"), "classifier"))
    return rows.select("root", "node", filled("group").alias("group"), filled("artifact").alias("artifact"), version.alias("version"), "scope", "optional")


def _package(group: str, artifact: str, version: str) -> Column:
    return F.struct(F.concat(group, F.lit(":"), artifact).alias("name"), F.col(version).alias("version"))


def graph(c: Closure, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Packages (repo, project, name, version, is_direct, env, scopes, optional) and edges (repo, project, src, dst) of all projects.

    A project's own file is its direct package, files below it and dependencies hang on it; a package's scopes and marks
    come from everywhere in its project. Scope `test` is the testing environment, other scopes stay as they are.
    """
    found = materialise(dependencies(c), "pom-dependencies") if found is None else found
    at = lambda p: _package(f"{p}.group", f"{p}.artifact", f"{p}.version")
    links = c.poms.where("parent IS NOT NULL").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    children = c.walked.join(links, "node").join(c.walked.withColumnRenamed("node", "child"), ["root", "child"], "left_semi")
    edges = found.select("root", at("node").alias("src"), _package("group", "artifact", "version").alias("dst"))
    edges = edges.unionByName(children.select("root", at("node").alias("src"), at("child").alias("dst"))).distinct()
    marks = found.select("root", _package("group", "artifact", "version").alias("package"), "scope", "optional", F.lit(False).alias("is_direct"))
    own = c.walked.select("root", at("node").alias("package"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("optional"), (F.col("node") == F.col("root")).alias("is_direct"))
    names = c.projects.select("root", "repo", "project")
    packages = marks.unionByName(own).groupBy("root", "package").agg(F.bool_or("is_direct").alias("is_direct"), F.sort_array(F.collect_set("scope")).alias("scopes"), F.sort_array(F.collect_set("optional")).alias("optional"))
    packages = packages.join(names, "root").select("repo", "project", "package.name", "package.version", "is_direct", F.when(F.array_contains("scopes", "test"), "testing").alias("env"), "scopes", "optional")
    return packages, edges.join(names, "root").select("repo", "project", "src", "dst")


def submodules(c: Closure) -> DataFrame:
    """(repo, project, name): the modules of each project, its targets."""
    known = c.members.join(c.poms.select("node"), "node", "left_semi")
    return known.join(c.projects, "root").select("repo", "project", F.concat("node.group", F.lit(":"), "node.artifact").alias("name")).distinct()


def licenses(c: Closure) -> DataFrame:
    """(repo, project, path, kind, value): declared licences of a project's files, by address where there is one, else by name."""
    rows = c.members.join(c.poms, "node").join(c.projects.select("root", "project"), "root").select("repo", "project", "path", F.explode("licenses").alias("l"))
    rows = rows.select("repo", "project", "path", F.when(F.col("l.url").isNotNull(), "url").otherwise("spdx").alias("kind"), F.coalesce("l.url", "l.name").alias("value"))
    return rows.where("value IS NOT NULL")


def only_submodules(packages: DataFrame, edges: DataFrame, modules: DataFrame, included: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages and edges of the ``included`` modules (repo, project, name) among all ``modules``.

    A package belongs to the modules that reach it without passing another module, by names; it stays if one of them is
    included. Nothing is rewired. Projects whose modules are all included stay as they are.
    """
    place = lambda name: F.struct("repo", "project", name.alias("name"))
    stops = modules.select(place(F.col("name")).alias("node")).distinct()
    wanted = included.select(place(F.col("name")).alias("module")).distinct()
    left_out = stops.join(wanted.withColumnRenamed("module", "node"), "node", "left_anti").select("node.repo", "node.project").distinct()
    links = edges.select(place(F.col("src.name")).alias("src"), place(F.col("dst.name")).alias("dst")).distinct()
    open_links = links.join(stops.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    start = wanted.select(F.col("module").alias("node")).join(stops, "node", "left_semi")
    kept = reach(open_links, start).select("node.*").distinct()
    whole = packages.join(left_out, ["repo", "project"], "left_anti").select("repo", "project", "name").distinct()
    kept = materialise(kept.unionByName(whole).distinct(), "kept-packages")
    stay = packages.join(kept, ["repo", "project", "name"], "left_semi").select(*packages.columns)
    for end in ("src", "dst"):
        name = f"_{end}"
        edges = edges.withColumn(name, F.col(f"{end}.name")).join(kept.withColumnRenamed("name", name), ["repo", "project", name], "left_semi").drop(name)
    return stay, edges.select("repo", "project", "src", "dst")
