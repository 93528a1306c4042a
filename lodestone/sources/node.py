"""JavaScript projects: workspaces over package.json files, and npm locks of version 3 by install places.

Listings of many repositories are worked on at once. A dependency is looked up where npm would find it, in the
`node_modules` of the place itself, of each place around it and of the root: all candidates become rows of one equality
join, and the longest that exists wins, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import ancestors, glob_pattern
from lodestone.operators.closure import left_in_circles, reach
from lodestone.plans.scratch import materialise

_STRINGS = "map<string,string>"
_PACKAGE = f"struct<version:string,dev:boolean,link:boolean,resolved:string,dependencies:{_STRINGS},devDependencies:{_STRINGS},peerDependencies:{_STRINGS},optionalDependencies:{_STRINGS}>"
_BOM = "^﻿"


def _keys(p: str, *fields: str) -> Column:
    none = F.create_map().cast(_STRINGS)
    return F.array_distinct(F.concat(*[F.map_keys(F.coalesce(f"{p}.{f}", none)) for f in fields]))


# npm locks


def lock_places(files: DataFrame) -> DataFrame:
    """The entries of version 3 locks: (file, place, name, version, env, link, target, location, needs, develops).

    ``name`` is null for the root and for workspaces. Files of other versions, without a root entry or that are no JSON give none.
    """
    j = files.select("file", F.from_json(F.regexp_replace("content", _BOM, ""), f"lockfileVersion int, packages map<string,{_PACKAGE}>").alias("j"))
    rows = j.where("j.lockfileVersion = 3 AND map_contains_key(j.packages, '')").select("file", F.explode("j.packages").alias("place", "p"))
    resolved = F.when(~F.col("p.resolved").isin("true", "false"), F.col("p.resolved"))
    link = F.coalesce("p.link", F.lit(False))
    return rows.select(
        "file", "place", F.when(F.contains("place", F.lit("node_modules/")), F.substring_index("place", "node_modules/", -1)).alias("name"), F.col("p.version").alias("version"),
        F.when(F.coalesce("p.dev", F.lit(False)), "development").otherwise("production").alias("env"), link.alias("link"), F.when(link, resolved).alias("target"), resolved.alias("location"),
        _keys("p", "dependencies", "peerDependencies", "optionalDependencies").alias("needs"), _keys("p", "devDependencies").alias("develops"),
    )


def installed(wants: DataFrame, places: DataFrame) -> DataFrame:
    """(file, place, name, found): where each of ``wants`` (file, place, name) is installed, seen from its place; without a place it is left out."""
    parts = F.split("place", "/node_modules/")
    around = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/node_modules/"), F.lit("/")))
    around = F.when(F.col("place") == "", F.array(F.lit(""))).otherwise(F.array_append(around, F.lit("")))
    tries = wants.select("file", "place", "name", F.explode(F.array_distinct(F.transform(around, lambda a: F.concat(a, F.lit("node_modules/"), "name")))).alias("found"))
    there = places.where("name IS NOT NULL").select("file", F.col("place").alias("found"))
    return tries.join(there, ["file", "found"]).groupBy("file", "place", "name").agg(F.max_by("found", F.length("found")).alias("found"))


def npm_v3(files: DataFrame, selected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Packages (file, place, name, version, env, is_direct, location) and edges (file, src, dst), by place, of version 3 locks.

    What the root and workspaces name is direct; packages that nothing names are left out. A link to a workspace counts
    as a package without a version. ``selected`` (file, place) narrows a file to its root (place '') or workspaces: then
    links give way to what the linked workspaces need, and only what is reached stays. A file whose entries are all
    selected, or that has no row, is not narrowed; one whose rows match no entry has no packages.
    """
    places = materialise(lock_places(files), "npm-places")
    wants = lambda rows, column: rows.select("file", "place", F.explode(column).alias("name"))
    inner, top = places.where("name IS NOT NULL"), places.where("name IS NULL")
    edges = materialise(installed(wants(inner, "needs"), places).select("file", F.col("place").alias("src"), F.col("found").alias("dst")), "npm-edges")
    direct = installed(wants(top, F.concat("needs", "develops")), places).select("file", "place", "found")
    if selected is not None:
        direct, edges = _narrowed(selected, places, top, direct, edges)
    direct = direct.select("file", F.col("found").alias("place")).distinct().withColumn("is_direct", F.lit(True))
    named = direct.select("file", "place").unionByName(edges.select("file", F.explode(F.array("src", "dst")).alias("place"))).distinct()
    rows = inner.join(named, ["file", "place"], "left_semi").join(direct, ["file", "place"], "left")
    return rows.select("file", "place", "name", "version", "env", F.coalesce("is_direct", F.lit(False)).alias("is_direct"), "location"), edges


def _narrowed(selected: DataFrame, places: DataFrame, top: DataFrame, direct: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    chosen = top.select("file", "place").join(selected.select("file", "place").distinct(), ["file", "place"], "left_semi")
    counts = top.groupBy("file").agg(F.count("*").alias("n")).join(chosen.groupBy("file").agg(F.count("*").alias("m")), "file", "left")
    narrow = materialise(counts.join(selected.select("file").distinct(), "file", "left_semi").where("coalesce(m, 0) < n").select("file"), "npm-narrowed")
    other = lambda rows: rows.join(narrow, "file", "left_anti").select(*rows.columns)
    own = lambda rows: rows.join(narrow, "file", "left_semi").select(*rows.columns)
    links = places.where("link").select("file", F.col("place").alias("found"), "target")
    # Links between workspaces, by what they need when they are used.
    used = own(installed(top.where("place <> ''").select("file", "place", F.explode("needs").alias("name")), places)).select("file", "place", "found")
    node = lambda place: F.struct("file", F.col(place).alias("place"))
    hops = used.join(links, ["file", "found"]).select(node("place").alias("src"), node("target").alias("dst"))
    asked = own(direct).join(chosen, ["file", "place"], "left_semi")
    first = asked.join(links, ["file", "found"]).select(node("target").alias("node"), node("place").alias("start"))
    reached = reach(hops, first.select("start", "node")).select("node.file", "node.place").distinct()
    expanded = used.join(reached, ["file", "place"], "left_semi")
    real = asked.unionByName(expanded).join(links, ["file", "found"], "left_anti").select("file", "place", "found")
    inside = own(edges).join(links.withColumnRenamed("found", "dst"), ["file", "dst"], "left_anti").select("file", "src", "dst")
    kept = reach(inside.select(node("src").alias("src"), node("dst").alias("dst")), real.select(node("found").alias("node"))).select("node.file", F.col("node.place").alias("src"))
    return other(direct).unionByName(real), other(edges).unionByName(inside.join(kept, ["file", "src"], "left_semi").select("file", "src", "dst"))


# Workspaces


def manifests(files: DataFrame) -> DataFrame:
    """(repo, path, dir, name, globs, dependencies, development): package.json files outside of folders of installed packages.

    ``files`` (repo, path, content) is a listing. Globs are those of the file and of a pnpm-workspace.yaml beside it; a
    file that is no JSON is left out.
    """
    src = files.where(~F.rlike("path", F.lit(r"(^|/)(node_modules|bower_components|\.yarn)/")))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    text = F.regexp_replace("content", _BOM, "")
    schema = f"name string, workspaces string, dependencies {_STRINGS}, peerDependencies {_STRINGS}, devDependencies {_STRINGS}"
    whole = F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("OBJECT"))
    j = src.where(F.rlike("path", F.lit(r"(^|/)package\.json$")) & whole).select("repo", "path", folder.alias("dir"), F.from_json(text, schema).alias("j"))
    globs = F.when(F.startswith(F.trim("j.workspaces"), F.lit("[")), F.from_json("j.workspaces", "array<string>")).otherwise(F.from_json(F.get_json_object("j.workspaces", "$.packages"), "array<string>"))
    block = F.regexp_extract("content", r"(?m)^packages:[ \t]*\n((?:[ \t]*(?:-.*|#.*)?\n?)*)", 1)
    items = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]*(.*)$"), F.lit(1)), lambda t: F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+#.*$", "")), "^(['\"])(.*)\\1$", "$2"))
    pnpm = src.where(F.rlike("path", F.lit(r"(^|/)pnpm-workspace\.yaml$"))).select("repo", folder.alias("dir"), items.alias("more"))
    none = F.array().cast("array<string>")
    empty = F.create_map().cast(_STRINGS)
    needs = F.map_concat(F.map_filter(F.coalesce("j.peerDependencies", empty), lambda k, _: ~F.map_contains_key(F.coalesce("j.dependencies", empty), k)), F.coalesce("j.dependencies", empty))
    return j.join(pnpm, ["repo", "dir"], "left").select("repo", "path", "dir", "j.name", F.concat(F.coalesce("more", none), F.coalesce(globs, none)).alias("globs"), needs.alias("dependencies"), F.coalesce("j.devDependencies", empty).alias("development"))


def workspace_links(found: DataFrame) -> DataFrame:
    """(repo, src, dst): a package.json with globs and another one that they match.

    A glob is taken from its file's folder. It is joined by equality on the folder before its first wildcard with the
    folders above each file, and only then compared as a pattern. What a glob with `!` matches is out.
    """
    globs = found.select("repo", "path", "dir", F.explode("globs").alias("glob"))
    bare = F.regexp_replace("glob", r"^!", "")
    whole = F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), bare)
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"/+", "/"), r"(^|(?<=/))(\./)+", ""), r"((^|/)\.)?/?$", "")
    globs = globs.select("repo", F.col("path").alias("src"), whole.alias("glob"), F.startswith("glob", F.lit("!")).alias("out"))
    fixed = F.regexp_replace(F.regexp_extract("glob", r"^((?:[^/*?\[{]+(?:/|$))*)", 1), r"/$", "")
    globs = globs.select("repo", "src", "out", fixed.alias("above"), glob_pattern(F.col("glob")).alias("pattern"))
    at = found.select("repo", F.col("path").alias("dst"), "dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), ancestors(F.col("dir")), F.array("dir")))).alias("above"))
    pairs = at.join(globs, ["repo", "above"]).where((F.col("src") != F.col("dst")) & F.rlike("dir", F.col("pattern")))
    return pairs.groupBy("repo", "src", "dst").agg(F.bool_or("out").alias("out")).where("NOT out").select("repo", "src", "dst")


#: Lock files beside a root, the first that exists decides.
LOCKS = (("yarn", "yarn.lock"), ("npm", "package-lock.json"), ("pnpm", "pnpm-lock.yaml"), ("bun", "bun.lock"))


def projects(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projects (repo, root, kind, lock), their members (repo, root, path, place, name, is_root) and problems (repo, problem).

    A package.json that no other one's globs match is the root of a project, all that its globs lead to are members;
    ``place`` is a member's folder below the root's. A repository whose globs lead in a circle has no projects and a problem.
    """
    found = materialise(manifests(files), "package-json")
    links = materialise(workspace_links(found), "workspace-links")
    node = lambda c: F.struct("repo", F.col(c).alias("path"))
    edges = materialise(links.select(node("src").alias("src"), node("dst").alias("dst")), "workspace-edges")
    circles = materialise(left_in_circles(edges).select("src.repo").distinct(), "workspace-circles")
    sources = found.select("repo", "path").join(circles, "repo", "left_anti").join(links.select("repo", F.col("dst").alias("path")), ["repo", "path"], "left_anti")
    whole = reach(edges, sources.select(F.col("path").alias("root"), node("path").alias("node"))).select("node.repo", "root", "node.path")
    members = whole.join(found.select("repo", "path", "dir", "name"), ["repo", "path"])
    base = F.regexp_replace("root", r"/?[^/]*$", "")
    inner = F.when(F.col("path") == F.col("root"), "").when(base == "", F.col("dir")).when(F.startswith("dir", F.concat(base, F.lit("/"))), F.substring(F.col("dir"), F.length(base) + 2, F.length("dir")))
    members = members.select("repo", "root", "path", inner.alias("place"), "name", (F.col("path") == F.col("root")).alias("is_root"))
    roots = sources.select("repo", F.col("path").alias("root")).withColumn("_dir", base)
    locks = files.select("repo", F.col("path").alias("_lock")).distinct()
    for kind, lock in LOCKS:
        path = F.concat(F.when(F.col("_dir") == "", "").otherwise(F.concat("_dir", F.lit("/"))), F.lit(lock))
        roots = roots.withColumn("_lock", path).join(locks.withColumn("_has", F.lit(True)), ["repo", "_lock"], "left").withColumn(f"_{kind}", F.when(F.col("_has"), F.col("_lock"))).drop("_lock", "_has")
    lock = F.coalesce(*[f"_{kind}" for kind, _ in LOCKS])
    kind = F.when(F.lit(False), "")
    for k, _ in LOCKS:
        kind = kind.when(F.col(f"_{k}").isNotNull(), k)
    roots = roots.select("repo", "root", kind.otherwise("npm").alias("kind"), lock.alias("lock"))
    return roots, members, circles.select("repo", F.lit("workspaces in a circle").alias("problem"))


def targets(roots: DataFrame, members: DataFrame) -> DataFrame:
    """(repo, root, name): what a project with workspaces can be narrowed to, for yarn and npm locks; the root must have a name."""
    named = members.join(roots.where("kind = 'yarn' OR kind = 'npm' AND lock IS NOT NULL").select("repo", "root"), ["repo", "root"], "left_semi").where("name IS NOT NULL")
    whole = named.groupBy("repo", "root").agg(F.bool_or("is_root").alias("a"), F.bool_or(~F.col("is_root")).alias("b")).where("a AND b")
    return named.join(whole, ["repo", "root"], "left_semi").select("repo", "root", "name").distinct()


def asked(files: DataFrame, members: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(repo, root, name, spec, env): what the members of each project ask for; ``chosen`` (repo, root, name) narrows to members of these names.

    Peers count as dependencies, unless the file itself has the name among them. All are direct.
    """
    rows = members.select("repo", "root", "path", "name")
    if chosen is not None:
        narrow = chosen.select("repo", "root").distinct()
        some = rows.join(chosen, ["repo", "root", "name"], "left_semi").select("repo", "root", "path")
        rows = some.unionByName(rows.join(narrow, ["repo", "root"], "left_anti").select("repo", "root", "path"))
    rows = rows.select("repo", "root", "path").join(manifests(files).select("repo", "path", "dependencies", "development"), ["repo", "path"])
    part = lambda c, env: rows.select("repo", "root", F.explode(c).alias("name", "spec"), F.lit(env).alias("env"))
    return part("dependencies", "production").unionByName(part("development", "development")).distinct()


def npm_projects(files: DataFrame, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Packages and edges, as :func:`npm_v3` gives them with (repo, root) for file, of all projects with an npm lock of version 3.

    ``chosen`` (repo, root, name) narrows a project to the members of these names.
    """
    roots, members, _ = projects(files)
    locks = roots.where("kind = 'npm'").join(files.select("repo", F.col("path").alias("lock"), "content"), ["repo", "lock"])
    locks = locks.select(F.struct("repo", "root").alias("file"), "content")
    selected = None
    if chosen is not None:
        at = chosen.join(members.select("repo", "root", "name", "place"), ["repo", "root", "name"], "left")
        selected = at.select(F.struct("repo", "root").alias("file"), "place")
    packages, edges = npm_v3(locks, selected)
    flat = lambda rows: rows.select("file.repo", "file.root", *[c for c in rows.columns if c != "file"])
    return flat(packages), flat(edges)
