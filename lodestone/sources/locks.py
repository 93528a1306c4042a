"""Readers of lock files and of captured tool output with links, as expressions over (file, content).

As in :mod:`manifests` a reader gives dependencies (file, name, version, env, is_direct) and its ``_edges`` give (file, src,
dst). Where one name may stand beside several versions, the ends of edges and the vertices are ``name@version``. Texts that
do not parse give no rows. YAML and TOML become JSON text in Arrow batches, a file at a time; the rest is the engine's. What
several joins read of a file is parsed once and written down.
"""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.dependencies import bare_version, catalog_name
from lodestone.functions.plain import plain_toml, plain_yaml
from lodestone.plans.scratch import materialise
from lodestone.sources.manifests import _from_json, _json, _rows

_STRINGS = "map<string,string>"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def plain_json(text: Column) -> Column:
    """JSON without comments and trailing commas; what stands in strings is left alone."""
    bare = F.regexp_replace(text, rf"({_STRING})|//[^\n]*|(?s:/\*.*?\*/)", "$1")
    return F.regexp_replace(bare, rf"({_STRING})|,(?=\s*[}}\]])", "$1")


def _as_json(plain, parse) -> object:
    def one(text: str | None) -> str | None:
        try:
            if text is None:
                return None
            quick = plain(text)
            return json.dumps(parse(text) if quick is None else quick, default=str)
        except Exception:  # noqa: BLE001 - a broken file never fails its neighbours
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run.asNondeterministic()  # or a filter on what it gives is moved before it, and it runs twice


def _yaml(text: str) -> object:
    import yaml

    return yaml.load(text, Loader=getattr(yaml, "CBaseLoader", yaml.BaseLoader))


def toml_json(text: Column) -> Column:
    """A TOML text as JSON; null if it is none."""
    return _as_json(plain_toml, tomllib.loads)(text)


def yaml_json(text: Column) -> Column:
    """A YAML text as JSON, every scalar a string; null if it is none."""
    return _as_json(plain_yaml, _yaml)(text)


def _read(files: DataFrame, schema: str, form=None) -> DataFrame:
    return _json(files if form is None else files.withColumn("content", form(F.col("content"))), schema)


def _parsed(files: DataFrame, schema: str, form=None) -> DataFrame:
    """As :func:`_read`, from a table: for what is read more than once."""
    text = files if form is None else files.withColumn("content", form(F.col("content")))
    return materialise(_from_json(text, schema), "parsed").where("j IS NOT NULL")


def _keys(*maps: str) -> Column:
    none = F.create_map().cast(_STRINGS)
    return F.array_distinct(F.concat(*[F.map_keys(F.coalesce(F.col(m), none)) for m in maps]))


def _edges(rows: DataFrame) -> DataFrame:
    return rows.select("file", "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def _vertex(name: str = "name", version: str = "version") -> Column:
    return F.concat_ws("@", name, version)


# npm, version 1 and 2


_V1 = "map<string,struct<version:string,dev:boolean,requires:string,dependencies:string>>"


def _npm_tree(j: DataFrame) -> DataFrame:
    """(file, name, version, dev, wants, own, up, depth): entries of nested ``dependencies``; own and up name version by name.

    A round reads the level below the one before from where that was written, until no entry holds others.
    """
    versions = lambda d: F.transform_values(d, lambda _, v: v["version"])
    level = j.select("file", F.col("j.dependencies").alias("deps"), F.create_map().cast(_STRINGS).alias("up"), F.lit(0).alias("depth"))
    out = None
    while True:
        rows = level.select("file", "up", "depth", F.explode("deps").alias("name", "d")).where("NOT startswith(coalesce(d.version, ''), 'file:')")
        rows = rows.select("file", "name", "d.version", F.coalesce("d.dev", F.lit(False)).alias("dev"), F.from_json("d.requires", _STRINGS).alias("wants"), "up", "depth", F.from_json("d.dependencies", _V1).alias("inner"))
        rows = materialise(rows.withColumn("own", versions(F.col("inner"))), "npm-tree")
        made = rows.select("file", "name", "version", "dev", "wants", "own", "up", "depth")
        out = made if out is None else out.unionByName(made)
        level = rows.where("size(inner) > 0").select("file", F.col("inner").alias("deps"), F.col("own").alias("up"), (F.col("depth") + 1).alias("depth"))
        if level.isEmpty():
            return out


def npm_v1(files: DataFrame, direct: DataFrame) -> DataFrame:
    """Entries at all depths; those at the top that ``direct`` (file, name) names are direct. ``file:`` entries are left out."""
    named = direct.select("file", "name", F.lit(0).alias("depth"), F.lit(True).alias("_d")).distinct()
    rows = _npm_tree(_read(files, f"dependencies {_V1}")).join(named, ["file", "name", "depth"], "left")
    once = _rows(rows, F.col("name"), F.col("version"), F.when(F.col("dev"), "development").otherwise("production"), F.coalesce("_d", F.lit(False)))
    return once.groupBy("file", "name", "version", "env").agg(F.bool_or("is_direct").alias("is_direct"))


def npm_v1_edges(files: DataFrame) -> DataFrame:
    """(file, src, dst): what entries require, and their peers at the top.

    A version is that of the entry's own nested entry, else of a sibling, else of a top entry, else as it is asked for.
    """
    j = _parsed(files, f"dependencies {_V1}, packages map<string,struct<peerDependencies:{_STRINGS}>>")
    tree = _npm_tree(j)
    top = tree.where("depth = 0").select("file", F.col("name").alias("want"), F.col("version").alias("top"))
    near = F.coalesce(F.try_element_at("own", F.col("want")), F.try_element_at("up", F.col("want")))
    wants = tree.select("file", _vertex().alias("src"), "own", "up", F.explode("wants").alias("want", "spec")).select("file", "src", "want", near.alias("near"), "spec")
    edges = wants.join(top, ["file", "want"], "left").select("file", "src", F.concat_ws("@", "want", F.coalesce("near", "top", "spec")).alias("dst"))
    places = j.select("file", F.explode("j.packages").alias("place", "p"))
    peers = materialise(places.select("file", F.substring_index("place", "node_modules/", -1).alias("name"), F.explode(F.map_keys("p.peerDependencies")).alias("want")), "npm-peers")
    linked = tree.select("file", "name", _vertex().alias("src")).join(peers, ["file", "name"]).join(top, ["file", "want"])
    return _edges(edges.unionByName(linked.select("file", "src", F.concat_ws("@", "want", "top").alias("dst"))))


# bun


_BUN = f"workspaces map<string,struct<dependencies:{_STRINGS},devDependencies:{_STRINGS},optionalDependencies:{_STRINGS}>>, packages map<string,array<string>>"


def _bun(j: DataFrame) -> DataFrame:
    """(file, key, name, version, type, wants) of packages from a registry or a repository."""
    p = j.select("file", F.explode("j.packages").alias("key", "p"))
    spec = F.get("p", F.lit(0))
    rows = p.select("file", "key", F.regexp_extract(spec, r"^(@?[^@]+)@", 1).alias("name"), F.regexp_extract(spec, r"^@?[^@]+@(.*)$", 1).alias("ref"), F.get(F.filter("p", lambda x: F.startswith(x, F.lit("{"))), F.lit(0)).alias("facts"))
    rows = rows.where(r"NOT ref RLIKE '^(workspace:|file:|link:|root:|module:|https://|http://|\\./|\\.\\./)'")
    git = F.regexp_extract("ref", r"^(?:github:|gitlab:|bitbucket:|git\+)(.*)$", 1)
    deps = F.from_json("facts", f"dependencies {_STRINGS}, optionalDependencies {_STRINGS}, peerDependencies {_STRINGS}")
    name = F.when(git != "", F.substring_index(git, "#", 1)).otherwise(F.col("name"))
    version = F.when(git != "", F.regexp_extract(git, r"#(.*)$", 1)).otherwise(F.col("ref"))
    return rows.select("file", "key", name.alias("name"), F.nullif(version, F.lit("")).alias("version"), deps.alias("d")).select("file", "key", "name", "version", _keys("d.dependencies", "d.optionalDependencies", "d.peerDependencies").alias("wants"))


def bun_lock(files: DataFrame) -> DataFrame:
    """Packages; those that a workspace names are direct, in development where only its development list does."""
    j = _parsed(files, _BUN, plain_json)
    spaces = j.select("file", F.explode("j.workspaces").alias("w", "s"))
    named = lambda env, *keys: spaces.select("file", F.explode(_keys(*keys)).alias("key"), F.lit(env).alias("env"))
    direct = named("production", "s.dependencies", "s.optionalDependencies").unionByName(named("development", "s.devDependencies")).distinct()
    rows = _bun(j).join(direct, ["file", "key"], "left")
    return _rows(rows, F.col("name"), F.col("version"), F.col("env"), F.col("env").isNotNull())


def bun_lock_edges(files: DataFrame) -> DataFrame:
    rows = _bun(_parsed(files, _BUN, plain_json))
    ends = rows.select("file", F.col("key").alias("want"), _vertex().alias("dst"))
    return _edges(rows.select("file", _vertex().alias("src"), F.explode("wants").alias("want")).join(ends, ["file", "want"]))


# pnpm


def _pnpm(files: DataFrame) -> DataFrame:
    schema = "lockfileVersion string, importers map<string,struct<dependencies:map<string,string>,devDependencies:map<string,string>,optionalDependencies:map<string,string>>>, dependencies map<string,string>, devDependencies map<string,string>, packages map<string,struct<dev:string,dependencies:map<string,string>,optionalDependencies:map<string,string>>>, snapshots map<string,struct<dependencies:map<string,string>,optionalDependencies:map<string,string>>>, catalogs map<string,map<string,struct<specifier:string,version:string>>>"
    return _parsed(files, schema, yaml_json)


def _pnpm_name(key: Column) -> tuple[Column, Column]:
    """Name and version of a package key: ``/name/1.0``, ``/name@1.0`` or ``name@1.0``, peers left out."""
    bare = F.regexp_replace(F.regexp_replace(key, r"^/", ""), r"\(.*$", "")
    name = F.regexp_extract(bare, r"^(@[^/@]+/[^/@]+|[^/@]+)[/@]", 1)
    return name, bare_version(F.regexp_extract(bare, r"^(?:@[^/@]+/[^/@]+|[^/@]+)[/@](.*)$", 1))


def pnpm_lock(files: DataFrame) -> DataFrame:
    """Packages of versions 4 to 9; those that an importer names are direct, ``dev`` gives the environment.

    An importer's entry is a version or a record with one; ``catalog:`` specifiers are looked up.
    """
    j = _pnpm(files)
    name, version = _pnpm_name(F.col("key"))
    rows = j.select("file", F.explode("j.packages").alias("key", "p")).select("file", name.alias("name"), version.alias("version"), (F.col("p.dev") == "true").alias("dev")).distinct()
    none = F.create_map().cast("map<string,string>")
    parts = []
    for env, key in (("production", "dependencies"), ("development", "devDependencies"), ("production", "optionalDependencies")):
        own = j.select("file", F.explode("j.importers").alias("i", "s")).select("file", F.col(f"s.{key}").alias("m"))
        if key != "optionalDependencies":
            own = own.unionByName(j.select("file", F.coalesce(F.col(f"j.{key}"), none).alias("m")))
        parts.append(own.select("file", F.explode("m").alias("name", "v")).withColumn("env", F.lit(env)))
    named = parts[0].unionByName(parts[1]).unionByName(parts[2])
    entry = F.from_json("v", "specifier string, version string")
    named = named.select("file", "name", "env", F.when(F.startswith("v", F.lit("{")), entry["version"]).otherwise(F.col("v")).alias("v"))
    catalogs = j.select("file", F.explode("j.catalogs").alias("c", "e")).select("file", "c", F.explode("e").alias("name", "s")).select("file", "name", "c", F.col("s.version").alias("cv"))
    named = named.withColumn("c", catalog_name(F.col("v"))).join(catalogs, ["file", "name", "c"], "left")
    named = named.select("file", "name", "env", bare_version(F.coalesce("cv", "v")).alias("version")).groupBy("file", "name", "version").agg(F.max("env").alias("env"))
    out = rows.join(named, ["file", "name", "version"], "left")
    env = F.coalesce("env", F.when(F.col("dev"), "development").otherwise("production"))
    return _rows(out, F.col("name"), F.col("version"), env, F.col("env").isNotNull())


def pnpm_lock_edges(files: DataFrame) -> DataFrame:
    """(file, src, dst) from packages, or in version 9 from snapshots."""
    j = _pnpm(files)
    wants = lambda part: j.select("file", F.explode(f"j.{part}").alias("key", "p")).select("file", "key", F.explode(F.map_concat(*[F.coalesce(F.col(f"p.{k}"), F.create_map().cast(_STRINGS)) for k in ("dependencies", "optionalDependencies")])).alias("want", "v"))
    rows = wants("packages").unionByName(wants("snapshots"))
    name, version = _pnpm_name(F.col("key"))
    return _edges(rows.select("file", F.concat_ws("@", name, version).alias("src"), F.concat_ws("@", "want", bare_version(F.col("v"))).alias("dst")))


# yarn 2 and later


def _berry(files: DataFrame) -> DataFrame:
    """(file, key, kind, v, wants): entries by resolution; kind is npm, workspace, git or another, v their vertex."""
    j = _read(files, "map<string,string>", yaml_json).select("file", F.explode("j").alias("key", "e")).where("key <> '__metadata'")
    e = F.from_json("e", f"version string, resolution string, dependencies {_STRINGS}")
    rows = j.select("file", "key", e.alias("e"))
    ref = F.regexp_extract("e.resolution", r"^@?[^@]+@(.*)$", 1)
    kind = F.when(F.startswith(ref, F.lit("workspace:")), "workspace").when(F.startswith(ref, F.lit("npm:")), "npm").when(F.rlike(ref, F.lit(r"\.git(#|$)|^git[@:+]|#commit=")), "git").when(F.rlike(ref, F.lit("^https?:.*(tgz|tar.gz)")), "tar").otherwise("other")
    rows = rows.select("file", "key", F.regexp_extract("e.resolution", r"^(@?[^@]+)@", 1).alias("name"), kind.alias("kind"), ref.alias("ref"), F.col("e.dependencies").alias("wants"))
    return materialise(rows.select("file", "key", "kind", _berry_vertex().alias("v"), "wants"), "berry")


def _berry_vertex() -> Column:
    version = F.when(F.col("kind") == "npm", F.substring_index(F.substring_index("ref", "npm:", -1), "::", 1)).when(F.col("kind") == "git", F.regexp_extract("ref", r"#(?:commit=)?([^&]*)$", 1)).otherwise(F.col("ref"))
    name = F.when(F.col("kind") == "git", F.substring_index("ref", "#", 1)).otherwise(F.col("name"))
    return F.struct(name.alias("name"), version.alias("version"))


def _berry_links(rows: DataFrame) -> DataFrame:
    """(file, from_kind, from, to_kind, to): entries' wants stitched to the entries whose descriptors name them."""
    ends = rows.select("file", F.explode(F.split("key", r",\s*")).alias("want"), F.col("kind").alias("to_kind"), F.col("v").alias("to"))
    wants = rows.select("file", F.col("kind").alias("from_kind"), F.col("v").alias("from"), F.explode("wants").alias("n", "spec"))
    return wants.withColumn("want", F.concat_ws("@", "n", "spec")).join(ends, ["file", "want"])


def yarn_berry(files: DataFrame) -> DataFrame:
    """Packages from a registry, repository or archive; those that a workspace wants are direct. Workspaces are left out."""
    entries = _berry(files)
    direct = _berry_links(entries).where("from_kind = 'workspace'").select("file", F.col("to").alias("v")).distinct().withColumn("_d", F.lit(True))
    rows = entries.where("kind IN ('npm', 'git', 'tar')").select("file", "v").distinct().join(direct, ["file", "v"], "left")
    return _rows(rows, F.col("v.name"), F.col("v.version"), direct=F.coalesce("_d", F.lit(False)))


def yarn_berry_edges(files: DataFrame) -> DataFrame:
    links = _berry_links(_berry(files)).where("from_kind IN ('npm', 'git', 'tar') AND to_kind IN ('npm', 'git', 'tar')")
    return _edges(links.select("file", F.concat_ws("@", "from.name", "from.version").alias("src"), F.concat_ws("@", "to.name", "to.version").alias("dst")))


# Maven and Gradle


_PLUGIN = "artifacts array<struct<numericId:int,groupId:string,artifactId:string,version:string,scopes:array<string>,optional:boolean,isDirect:boolean>>, dependencies array<struct<numericFrom:int,numericTo:int>>"


def _plugin(files: DataFrame) -> DataFrame:
    return _read(files, _PLUGIN).select("file", F.explode("j.artifacts").alias("a")).select("file", F.concat_ws(":", "a.groupId", "a.artifactId").alias("name"), "a.*")


def maven_plugin(files: DataFrame, submodules: DataFrame) -> DataFrame:
    """Artifacts of the plugin's graph, a row for each scope; direct if it says so or a submodule (file, artifact) is named so."""
    known = submodules.select("file", F.col("artifact").alias("artifactId"), F.lit(True).alias("_s")).distinct()
    rows = _plugin(files).join(known, ["file", "artifactId"], "left").withColumn("scope", F.explode_outer("scopes"))
    env = F.when(F.col("scope") == "compile", "production").when(F.col("scope") == "test", "testing").otherwise(F.col("scope"))
    return _rows(rows, F.col("name"), F.col("version"), env, F.coalesce("isDirect", F.lit(False)) | F.coalesce("_s", F.lit(False))).distinct()


def maven_plugin_edges(files: DataFrame) -> DataFrame:
    """(file, src, dst) by numeric ids; links with an unknown end go."""
    ids = _plugin(files).select("file", F.col("numericId").alias("id"), _vertex().alias("v"))
    links = _read(files, _PLUGIN).select("file", F.explode("j.dependencies").alias("l"))
    rows = links.select("file", F.col("l.numericFrom").alias("f"), F.col("l.numericTo").alias("t"))
    return _edges(rows.join(ids.toDF("file", "f", "src"), ["file", "f"]).join(ids.toDF("file", "t", "dst"), ["file", "t"]))


def _dot(files: DataFrame) -> DataFrame:
    """(file, root, a, b): the edges of each ``digraph``; b is null for the root itself."""
    graphs = files.select("file", F.explode(F.regexp_extract_all("content", F.lit(r'(?s)(digraph\s+"[^"]+"\s*\{.*?\})'), F.lit(1))).alias("g"))
    rows = graphs.select("file", F.regexp_extract("g", r'^digraph\s+"([^"]+)"', 1).alias("root"), F.regexp_extract_all("g", F.lit(r'("[^"]+"\s*->\s*"[^"]+")'), F.lit(1)).alias("e"))
    ends = rows.select("file", "root", F.explode_outer("e").alias("t"))
    return ends.select("file", "root", F.regexp_extract("t", r'^"([^"]+)"', 1).alias("a"), F.regexp_extract("t", r'->\s*"([^"]+)"', 1).alias("b"))


def _artifact(text: str) -> Column:
    """group:artifact, version and scope of ``group:artifact:type[:classifier]:version[:scope]``."""
    p = F.split(text, ":")
    n = F.size(p)
    scoped = (n >= 5) & F.get(p, n - 1).isin("compile", "test", "provided", "runtime", "system", "import")
    at = F.when(scoped, n - 2).otherwise(n - 1)
    return F.struct(F.concat_ws(":", F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("name"), F.get(p, at).alias("version"), F.when(scoped, F.get(p, n - 1)).alias("scope"))


def maven_dot(files: DataFrame) -> DataFrame:
    """Vertices of the trees that the dependency plugin draws; each tree's root is direct; no scope means production."""
    rows = _dot(files)
    all_ = rows.select("file", F.col("root").alias("t"), F.lit(True).alias("d")).unionByName(rows.select("file", F.explode(F.array("a", "b")).alias("t"), F.lit(False).alias("d")))
    v = all_.where("t <> ''").select("file", _artifact("t").alias("v"), "d").groupBy("file", "v").agg(F.bool_or("d").alias("d"))
    env = F.when(F.col("v.scope") == "test", "testing").when(F.col("v.scope").isNull() | (F.col("v.scope") == "compile"), "production").otherwise(F.col("v.scope"))
    return _rows(v, F.col("v.name"), F.col("v.version"), env, F.col("d"))


def maven_dot_edges(files: DataFrame) -> DataFrame:
    rows = _dot(files).where("b <> ''").select("file", _artifact("a").alias("x"), _artifact("b").alias("y"))
    return _edges(rows.select("file", F.concat_ws("@", "x.name", "x.version").alias("src"), F.concat_ws("@", "y.name", "y.version").alias("dst")))


# Configurations that do not ship, of Gradle itself and of its usual plugins.
TEST_CONFIGURATIONS = (
    "aggregateCodeCoverageReportResults",
    "jacocoAgent",
    "jacocoAggregation",
    "jacocoAnt",
    "testImplementation",
    "testCompileOnly",
    "testRuntimeOnly",
    "testCompileClasspath",
    "testRuntimeClasspath",
    "testFixturesApi",
    "testFixturesImplementation",
    "testFixturesRuntimeOnly",
    "testFixturesCompileOnly",
    "testFixturesRuntimeClasspath",
    "testFixturesCompileClasspath",
    "testFixturesApiElements",
)
DEV_CONFIGURATIONS = (
    "compileOnly",
    "spotbugs",
    "spotbugsPlugins",
    "spotbugsSlf4j",
)
# What Android's plugin adds: checks, debug builds, compilers; then tests, by name and by how they begin.
ANDROID_DEV = (
    "lintChecks",
    "lintClassPath",
    "lintPublish",
    "debugApiDependenciesMetadata",
    "debugCompileClasspath",
    "debugCompileOnly",
    "debugCompileOnlyDependenciesMetadata",
    "debugImplementationDependenciesMetadata",
    "debugIntransitiveDependenciesMetadata",
    "debugReverseMetadataValues",
    "debugRuntimeClasspath",
    "debugRuntimeOnlyDependenciesMetadata",
    "compileOnlyDependenciesMetadata",
    "releaseCompileOnly",
    "releaseCompileOnlyDependenciesMetadata",
    "debugWearBundling",
    "debugAnnotationProcessorClasspath",
    "releaseAnnotationProcessorClasspath",
    "androidJdkImage",
    "kotlinCompilerClasspath",
    "kotlinCompilerPluginClasspathDebug",
    "kotlinCompilerPluginClasspathDebugAndroidTest",
    "kotlinCompilerPluginClasspathDebugUnitTest",
    "kotlinCompilerPluginClasspathReleaseUnitTest",
    "kotlinCompilerPluginClasspathRelease",
    "kotlinKlibCommonizerClasspath",
    "kotlinNativeCompilerPluginClasspath",
)
ANDROID_TEST = (
    "androidJacocoAnt",
    "testApiDependenciesMetadata",
    "testCompileOnlyDependenciesMetadata",
    "testDebugApiDependenciesMetadata",
    "testDebugCompileOnlyDependenciesMetadata",
    "testDebugImplementationDependenciesMetadata",
    "testDebugIntransitiveDependenciesMetadata",
    "testDebugRuntimeOnlyDependenciesMetadata",
    "testImplementationDependenciesMetadata",
    "testIntransitiveDependenciesMetadata",
    "testReleaseApiDependenciesMetadata",
    "testReleaseCompileOnlyDependenciesMetadata",
    "testReleaseImplementationDependenciesMetadata",
    "testReleaseIntransitiveDependenciesMetadata",
    "testReleaseRuntimeOnlyDependenciesMetadata",
    "testRuntimeOnlyDependenciesMetadata",
)
ANDROID_TEST_BEGINS = ("androidTest", "debugAndroidTest", "releaseUnitTest", "debugUnitTest")

_COMPONENT = "struct<type:string,name:string,version:string>"
_GRADLE = f"name string, configurations array<struct<name:string,directComponents:array<{_COMPONENT}>,dependencies:array<struct<node:{_COMPONENT},outgoing:array<{_COMPONENT}>>>>>"


def _gradle(files: DataFrame, only: list[str] | None) -> DataFrame:
    """(file, c): the configurations of JSON lines, one for each project."""
    line = files.select("file", F.explode(F.split("content", "\n")).alias("content"))
    rows = _json(line, _GRADLE).select("file", F.explode("j.configurations").alias("c"))
    return rows.where(F.col("c.name").isin(only)) if only else rows


def _component(c: str) -> list[Column]:
    return [F.col(f"{c}.name").alias("name"), F.col(f"{c}.version").alias("version")]


def gradle(files: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Components of resolved configurations, an environment for each configuration; projects have no version.

    Known names are development or testing, every other stands for itself; with ``only`` all do.
    """
    rows = _gradle(files, only)
    direct = rows.select("file", "c.name", F.explode("c.directComponents").alias("x")).select("file", F.col("name").alias("conf"), *_component("x"), F.lit(True).alias("d"))
    node = rows.select("file", F.col("c.name").alias("conf"), F.explode("c.dependencies").alias("x"))
    deep = node.select("file", "conf", *_component("x.node"), F.lit(False).alias("d")).unionByName(node.select("file", "conf", F.explode("x.outgoing").alias("o")).select("file", "conf", *_component("o"), F.lit(False).alias("d")))
    all_ = direct.unionByName(deep)
    tests = F.col("conf").isin(*TEST_CONFIGURATIONS)
    android_tests = F.col("conf").isin(*ANDROID_TEST) | F.rlike("conf", F.lit(f"^({'|'.join(ANDROID_TEST_BEGINS)})"))
    env = F.when(F.col("conf").isin(*DEV_CONFIGURATIONS), "development").when(tests, "testing").when(F.col("conf").isin(*ANDROID_DEV), "development").when(android_tests, "testing").otherwise(F.col("conf"))
    all_ = all_.withColumn("env", F.col("conf") if only else env).groupBy("file", "name", "version", "env").agg(F.bool_or("d").alias("d"))
    return _rows(all_, F.col("name"), F.col("version"), F.col("env"), F.col("d"))


def gradle_edges(files: DataFrame, only: list[str] | None = None) -> DataFrame:
    node = _gradle(files, only).select("file", F.explode("c.dependencies").alias("x"))
    rows = node.select("file", F.concat_ws("@", "x.node.name", "x.node.version").alias("src"), F.explode("x.outgoing").alias("o"))
    return _edges(rows.select("file", "src", F.concat_ws("@", "o.name", "o.version").alias("dst")))


# NuGet


_ASSETS = f"targets map<string,map<string,struct<type:string,dependencies:{_STRINGS}>>>, project struct<frameworks:map<string,struct<dependencies:map<string,string>>>>"


def _assets(files: DataFrame) -> DataFrame:
    rows = _read(files, _ASSETS).select("file", F.explode("j.targets").alias("framework", "t")).select("file", "framework", F.explode("t").alias("key", "p"))
    return rows.select("file", "framework", F.substring_index("key", "/", 1).alias("name"), F.substring_index("key", "/", -1).alias("version"), "p.type", F.map_keys("p.dependencies").alias("wants"))


def _framework(name: Column) -> Column:
    """A framework's name without what tells its long from its short form."""
    bare = F.regexp_replace(F.lower(name), r"version=v|[.,\s]|^net(coreapp|standard|framework)?(?=\d)", "")
    return F.regexp_replace(F.regexp_replace(bare, "^(netcoreapp|netstandard|netframework)", ""), r"0+$", "")


def project_assets(files: DataFrame) -> DataFrame:
    """Resolved packages, projects left out; direct if the framework's own list names them.

    Where all frameworks ask for the same or none answers to the target's name, all their lists count.
    """
    rows = _assets(files).where("type <> 'project' OR type IS NULL")
    asked = _read(files, _ASSETS).select("file", F.explode("j.project.frameworks").alias("f", "d")).select("file", "f", F.array_sort(F.map_keys(F.coalesce("d.dependencies", F.create_map().cast(_STRINGS)))).alias("names"))
    lists = asked.groupBy("file").agg(F.collect_set("names").alias("sets"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("all"), F.collect_list(F.struct(_framework(F.col("f")).alias("f"), "names")).alias("by"))
    rows = rows.join(lists, "file", "left")
    own = F.get(F.filter("by", lambda x: x["f"] == _framework(F.col("framework"))), F.lit(0))["names"]
    names = F.when(F.size("sets") <= 1, F.col("all")).otherwise(F.coalesce(own, "all"))
    out = rows.select("file", "name", "version", F.coalesce(F.array_contains(names, F.col("name")), F.lit(False)).alias("d")).groupBy("file", "name", "version").agg(F.bool_or("d").alias("d"))
    return _rows(out, F.col("name"), F.col("version"), direct=F.col("d"))


def project_assets_edges(files: DataFrame) -> DataFrame:
    """(file, src, dst): within a framework, by name alone."""
    rows = _assets(files).where("type <> 'project' OR type IS NULL")
    ends = rows.select("file", "framework", F.col("name").alias("want"), _vertex().alias("dst"))
    return _edges(rows.select("file", "framework", _vertex().alias("src"), F.explode("wants").alias("want")).join(ends, ["file", "framework", "want"]))


def package_references(files: DataFrame) -> DataFrame:
    """(file, id, version) of PackageReference elements by Include or Update; the version is an attribute or a child."""
    item = files.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)(<PackageReference\b[^>]*?/>|<PackageReference\b.*?</PackageReference>)"), F.lit(1))).alias("t"))
    attribute = lambda k: F.regexp_extract("t", rf'^<PackageReference\b[^>]*?\s(?:{k})\s*=\s*"([^"]*)"', 1)
    version = F.coalesce(F.nullif(attribute("Version"), F.lit("")), F.nullif(F.regexp_extract("t", r"<Version>\s*([^<]*?)\s*</Version>", 1), F.lit("")))
    return item.select("file", F.coalesce(F.nullif(attribute("Include"), F.lit("")), F.nullif(attribute("Update"), F.lit(""))).alias("id"), version.alias("version")).where("id IS NOT NULL")


def paket_lock(files: DataFrame) -> DataFrame:
    """Specs of all groups and remotes, all direct."""
    spec = files.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^ {4}(\S+ \([^)]*\))"), F.lit(1))).alias("t"))
    return _rows(spec, F.substring_index("t", " ", 1), F.regexp_extract("t", r"\(([^)]*)\)", 1))


def paket_lock_edges(files: DataFrame) -> DataFrame:
    block = files.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)(^ {4}\S[^\n]*(?:\n {6}\S[^\n]*)*)"), F.lit(1))).alias("t"))
    return _edges(block.select("file", F.regexp_extract("t", r"^ {4}(\S+)", 1).alias("src"), F.explode(F.regexp_extract_all("t", F.lit(r"(?m)^ {6}(\S+)"), F.lit(1))).alias("dst")))


# Go


_GO_LIST = "ImportPath string, Standard boolean, Imports array<string>, Module struct<Path:string,Version:string,Main:boolean,Indirect:boolean>"


def _go_packages(files: DataFrame) -> DataFrame:
    """(file, package, imports, module, version, main, indirect) of the objects that ``go list -json`` writes one after the other."""
    one = files.select("file", F.explode(F.split("content", r"(?<=\n\})\s*\n(?=\{)")).alias("content"))
    rows = _json(one, _GO_LIST).where("NOT coalesce(j.Standard, false) AND j.ImportPath <> 'C' AND j.Module IS NOT NULL")
    return rows.select("file", F.col("j.ImportPath").alias("package"), F.col("j.Imports").alias("imports"), F.col("j.Module.Path").alias("module"), F.col("j.Module.Version").alias("version"), F.coalesce("j.Module.Main", F.lit(False)).alias("main"), F.coalesce("j.Module.Indirect", F.lit(False)).alias("indirect"))


def go_list(files: DataFrame) -> DataFrame:
    """Modules of the packages that a build needs, but for main ones; direct unless marked indirect."""
    rows = _go_packages(files).where("NOT main").groupBy("file", "module", "version").agg(F.bool_or(~F.col("indirect")).alias("d"))
    return _rows(rows, F.col("module"), F.col("version"), direct=F.col("d"))


def go_list_edges(files: DataFrame) -> DataFrame:
    """(file, src, dst): modules whose packages import each other, main modules left out."""
    rows = _go_packages(files).where("NOT main")
    ends = rows.select("file", F.col("package").alias("want"), F.col("module").alias("dst"))
    return _edges(rows.select("file", F.col("module").alias("src"), F.explode("imports").alias("want")).join(ends, ["file", "want"]).where("src <> dst"))


def gopkg_lock(files: DataFrame) -> DataFrame:
    """Projects of a dep lock by revision, all direct; a source stands for the name."""
    j = _read(files, "projects array<struct<name:string,source:string,revision:string>>", toml_json)
    return _rows(j.select("file", F.explode("j.projects").alias("p")), F.col("p.name"), F.col("p.revision"))


def glide_lock(files: DataFrame) -> DataFrame:
    j = _read(files, "imports array<struct<name:string,version:string>>", yaml_json)
    return _rows(j.select("file", F.explode("j.imports").alias("p")), F.col("p.name"), F.col("p.version"))


# Others


def pip_show(files: DataFrame) -> DataFrame:
    """(file, name, version, requires array) of ``Key: value`` blocks that ``---`` lines part."""
    block = files.select("file", F.explode(F.split("content", r"(?m)^---\s*$")).alias("t"))
    key = lambda k: F.regexp_extract("t", rf"(?m)^{k}:[ \t]*(.*)$", 1)
    rows = block.select("file", F.trim(key("Name")).alias("name"), F.trim(key("Version")).alias("version"), F.filter(F.split(F.trim(key("Requires")), r"\s*,\s*"), lambda x: x != "").alias("requires"))
    return rows.where("name <> ''")


_POD = "PODS array<string>, DEPENDENCIES array<string>, `CHECKOUT OPTIONS` map<string,map<string,string>>, `EXTERNAL SOURCES` map<string,map<string,string>>"


def _pods(j: DataFrame) -> DataFrame:
    """(file, name, version, wants): pods, as texts or as records with a list below."""
    j = j.select("file", F.explode("j.PODS").alias("p"))
    record = F.from_json("p", "map<string,array<string>>")
    nested = F.startswith("p", F.lit("{"))
    head = F.when(nested, F.get(F.map_keys(record), F.lit(0))).otherwise(F.col("p"))
    wants = F.when(nested, F.get(F.map_values(record), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return j.select("file", F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.regexp_extract(head, r"\(([^)]*)\)", 1).alias("version"), F.transform(wants, lambda w: F.regexp_extract(w, r"^(\S+)", 1)).alias("wants"))


def podfile_lock(files: DataFrame) -> DataFrame:
    """Pods; those under DEPENDENCIES are direct. One from a repository is named by it, at its tag, commit or branch."""
    j = _parsed(files, _POD, yaml_json)
    direct = j.select("file", F.explode("j.DEPENDENCIES").alias("t")).select("file", F.regexp_extract("t", r"^(\S+)", 1).alias("name"), F.lit(True).alias("_d")).distinct()
    source = j.select("file", F.explode("j.EXTERNAL SOURCES").alias("name", "s")).where("s[':git'] IS NOT NULL").select("file", "name", F.col("s")[":git"].alias("git"), F.coalesce(F.col("s")[":tag"], F.col("s")[":commit"], F.col("s")[":branch"]).alias("ref"))
    rows = _pods(j).join(direct, ["file", "name"], "left").join(source, ["file", "name"], "left")
    return _rows(rows, F.coalesce("git", "name"), F.when(F.col("git").isNotNull(), F.col("ref")).otherwise(F.col("version")), direct=F.coalesce("_d", F.lit(False)))


def podfile_lock_edges(files: DataFrame) -> DataFrame:
    return _edges(_pods(_read(files, _POD, yaml_json)).select("file", F.col("name").alias("src"), F.explode("wants").alias("dst")))


def pubspec_lock(files: DataFrame) -> DataFrame:
    """Hosted and git packages of a Dart lock; ``direct ...`` kinds are direct, without edges."""
    j = _read(files, "packages map<string,struct<dependency:string,source:string,version:string>>", yaml_json)
    rows = j.select("file", F.explode("j.packages").alias("name", "p")).where("p.source IN ('hosted', 'git')")
    env = F.when(F.col("p.dependency") == "direct dev", "development").otherwise("production")
    return _rows(rows, F.col("name"), F.col("p.version"), env, F.startswith("p.dependency", F.lit("direct")))


def repo_manifest(files: DataFrame) -> DataFrame:
    """Projects of a repo manifest: URL below their remote's fetch, revision of the project, its remote or the default; all direct."""
    tags = lambda t: F.regexp_extract_all("content", F.lit(rf"(<{t}\b[^>]*>)"), F.lit(1))
    key = lambda c, k: F.nullif(F.regexp_extract(c, rf'\s{k}\s*=\s*"([^"]*)"', 1), F.lit(""))
    # the default stands beside the list, so that it is looked for once a file and not once a project
    default = F.get(tags("default"), F.lit(0))
    files = materialise(files.select("file", key(default, "remote").alias("dr"), key(default, "revision").alias("dv"), tags("remote").alias("remotes"), tags("project").alias("projects")), "manifest")
    remote = files.select("file", F.explode("remotes").alias("t")).select("file", key("t", "name").alias("remote"), key("t", "fetch").alias("fetch"), key("t", "revision").alias("remote_revision"))
    rows = files.select("file", "dr", "dv", F.explode("projects").alias("t"))
    rows = rows.select("file", key("t", "name").alias("name"), F.coalesce(key("t", "remote"), "dr").alias("remote"), key("t", "revision").alias("revision"), "dv").join(remote, ["file", "remote"])
    return _rows(rows, F.concat_ws("/", F.regexp_replace("fetch", "/+$", ""), "name"), F.coalesce("revision", "remote_revision", "dv"))


def cabal_plan(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dependencies, edges) of a build plan: packages from the index; those that a local package needs are direct."""
    schema = "`install-plan` array<struct<id:string,type:string,style:string,`pkg-name`:string,`pkg-version`:string,depends:array<string>,components:map<string,struct<depends:array<string>>>>>"
    p = _read(files, schema).select("file", F.explode("j.install-plan").alias("p"))
    none = F.array().cast("array<string>")
    inner = F.flatten(F.transform(F.map_values(F.coalesce("p.components", F.create_map().cast("map<string,struct<depends:array<string>>>"))), lambda c: F.coalesce(c["depends"], none)))
    rows = p.select("file", F.col("p.id").alias("id"), F.coalesce(F.col("p.style") == "local", F.lit(False)).alias("local"), F.col("p.pkg-name").alias("name"), F.col("p.pkg-version").alias("version"), F.concat(F.coalesce("p.depends", none), inner).alias("wants"))
    ends = rows.where("NOT local").select("file", F.col("id").alias("want"), F.col("name").alias("dst"))
    links = rows.select("file", "local", F.col("name").alias("src"), F.explode("wants").alias("want")).join(ends, ["file", "want"])
    direct = links.where("local").select("file", F.col("dst").alias("name"), F.lit(True).alias("_d")).distinct()
    deps = rows.where("NOT local").join(direct, ["file", "name"], "left")
    return _rows(deps, F.col("name"), F.col("version"), direct=F.coalesce("_d", F.lit(False))), _edges(links.where("NOT local"))


def perl_meta(files: DataFrame) -> DataFrame:
    """Requirements of a META file by phase, none direct; ``perl`` itself is left out."""
    j = _read(files, f"prereqs map<string,map<string,{_STRINGS}>>").select("file", F.explode("j.prereqs").alias("phase", "r"))
    rows = j.select("file", "phase", F.explode("r").alias("kind", "m")).select("file", "phase", F.explode("m").alias("name", "v")).where("name <> 'perl'").distinct()
    env = F.when(F.col("phase") == "runtime", "production").when(F.col("phase") == "test", "testing").when(F.col("phase").isin("develop", "build", "configure"), "development").otherwise(F.col("phase"))
    return _rows(rows, F.col("name"), F.col("v"), env, False)


def rpm_spec(files: DataFrame) -> DataFrame:
    """Packages that a spec file requires at run time, all direct; names with macros are left out."""
    line = files.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^Requires(?:\([^)]*\))?:[ \t]*(.+)$"), F.lit(1))).alias("t"))
    one = line.select("file", F.explode(F.regexp_extract_all("t", F.lit(r"([^\s,<>=]+(?:\s*(?:<=|>=|==|=|<|>)\s*[^\s,]+)?)"), F.lit(1))).alias("t")).where("NOT contains(t, '%{')")
    return _rows(one, F.regexp_extract("t", r"^([^\s<>=]+)", 1), F.nullif(F.regexp_extract("t", r"[<>=]\s*([^\s<>=]+)$", 1), F.lit("")))


def conan_graph(files: DataFrame) -> DataFrame:
    """Nodes of a Conan graph but for the consumer, all direct; the version carries package id and settings as a query."""
    j = _read(files, f"graph struct<nodes:map<string,struct<ref:string,name:string,version:string,package_id:string,context:string,test:boolean,settings:{_STRINGS}>>>").select("file", F.explode("j.graph.nodes").alias("id", "n")).where("n.name IS NOT NULL AND id <> '0'")
    pairs = F.map_concat(F.coalesce("n.settings", F.create_map().cast(_STRINGS)), F.when(F.col("n.package_id").isNotNull(), F.create_map(F.lit("package_id"), F.col("n.package_id"))).otherwise(F.create_map().cast(_STRINGS)))
    query = F.array_join(F.array_sort(F.transform(F.map_entries(pairs), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"])))), "&")
    env = F.when(F.coalesce("n.test", F.lit(False)), "testing").when(F.col("n.context") == "build", "development").otherwise("production")
    return _rows(j, F.col("n.name"), F.concat("n.version", F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")), env)
