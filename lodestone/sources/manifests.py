"""Readers of package manifests and lock files, as expressions over (file, content).

A reader gives dependencies: (file, name, version, env, is_direct); those of lock files with links also edges: (file, src,
dst), names of that file. Texts that do not parse give no rows; a broken file never fails its neighbours. Rewrites of the
graphs (pruning, shrinking, spreading environments) are those of operators.graph, over all files at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import locators

_STRINGS = "map<string,string>"


def _rows(df: DataFrame, name: Column, version: Column, env: Column | str = "production", direct: Column | bool = True) -> DataFrame:
    env = F.lit(env) if isinstance(env, str) else env
    direct = F.lit(direct) if isinstance(direct, bool) else direct
    return df.select("file", name.alias("name"), version.alias("version"), env.alias("env"), direct.alias("is_direct")).where("name IS NOT NULL AND name <> ''")


def _from_json(files: DataFrame, schema: str) -> DataFrame:
    return files.select("file", F.from_json(F.regexp_replace("content", "^﻿", ""), schema).alias("j"))


def _json(files: DataFrame, schema: str) -> DataFrame:
    return _from_json(files, schema).where("j IS NOT NULL")


def package_json(files: DataFrame) -> DataFrame:
    """Production and development entries, all direct."""
    j = _json(files, f"dependencies {_STRINGS}, devDependencies {_STRINGS}")
    part = lambda key, env: _rows(j.select("file", F.explode(f"j.{key}").alias("name", "version")), F.col("name"), F.col("version"), env)
    return part("dependencies", "production").unionByName(part("devDependencies", "development"))


_NPM = f"packages map<string,struct<version:string,dev:boolean,link:boolean,dependencies:{_STRINGS},devDependencies:{_STRINGS},peerDependencies:{_STRINGS},optionalDependencies:{_STRINGS}>>"


def _npm_packages(files: DataFrame) -> DataFrame:
    return _json(files, _NPM).select("file", F.explode("j.packages").alias("place", "p"))


def _npm_names(p: Column, *keys: str) -> Column:
    none = F.create_map().cast(_STRINGS)
    return F.array_distinct(F.concat(*[F.map_keys(F.coalesce(p[k], none)) for k in keys]))


def npm_lock(files: DataFrame) -> DataFrame:
    """Packages of a version 3 lock: those that the root names are direct, ``dev`` gives the environment."""
    packages = _npm_packages(files)
    root = packages.where("place = ''").select("file", F.explode(_npm_names(F.col("p"), "dependencies", "devDependencies", "peerDependencies", "optionalDependencies")).alias("name")).withColumn("_root", F.lit(True))
    inner = packages.where("place LIKE '%node_modules/%' AND NOT coalesce(p.link, false)").withColumn("name", F.substring_index("place", "node_modules/", -1))
    at_top = F.col("place") == F.concat(F.lit("node_modules/"), "name")
    rows = inner.join(root, ["file", "name"], "left")
    return _rows(rows, F.col("name"), F.col("p.version"), F.when(F.coalesce("p.dev", F.lit(False)), "development").otherwise("production"), F.coalesce("_root", F.lit(False)) & at_top)


def npm_lock_edges(files: DataFrame) -> DataFrame:
    """(file, src, dst) as install places: a dependency is the copy below the package if there is one, else the top-level one."""
    packages = _npm_packages(files).where("place <> ''")
    wants = packages.select("file", F.col("place").alias("src"), F.explode(_npm_names(F.col("p"), "dependencies", "peerDependencies", "optionalDependencies")).alias("dep"))
    places = packages.select("file", F.col("place").alias("dst"))
    own = wants.withColumn("dst", F.concat("src", F.lit("/node_modules/"), "dep")).join(places.withColumn("_own", F.lit(True)), ["file", "dst"], "left")
    own = own.withColumn("dst", F.when(F.col("_own"), F.col("dst")).otherwise(F.concat(F.lit("node_modules/"), "dep"))).drop("_own")
    return own.join(places, ["file", "dst"], "left_semi").select("file", "src", "dst").distinct()


def yarn_v1(files: DataFrame) -> DataFrame:
    """Entries of a version 1 lock, none of them direct."""
    entry = files.select("file", F.explode(F.split("content", r"\n\n+")).alias("t")).where(r"t RLIKE '(?m)^  version '")
    name = F.regexp_extract("t", r'(?m)^"?((?:@[^/"@]+/)?[^@",]+)@', 1)
    return _rows(entry, name, F.regexp_extract("t", r'(?m)^  version "([^"]*)"', 1), direct=False)


def yarn_v1_edges(files: DataFrame) -> DataFrame:
    """(file, src, dst) by the (name, spec) keys of a version 1 lock; wants without an entry are left out."""
    entry = files.select("file", F.explode(F.split("content", r"\n\n+")).alias("t")).where(r"t RLIKE '(?m)^  version '")
    entry = entry.withColumn("name", F.regexp_extract("t", r'(?m)^"?((?:@[^/"@]+/)?[^@",]+)@', 1))
    heads = F.split(F.replace(F.regexp_extract("t", r"(?m)^(\S.*):$", 1), F.lit('"'), F.lit("")), ", ")
    keys = entry.select("file", F.col("name").alias("dst"), F.explode(heads).alias("key"))
    block = F.regexp_extract("t", r"(?s)\n  (?:dependencies|optionalDependencies):\n((?:    [^\n]*\n?)+)", 1)
    wants = entry.select("file", F.col("name").alias("src"), F.explode(F.regexp_extract_all(block, F.lit(r'(?m)^    (\S+ \S+.*)$'), F.lit(1))).alias("want"))
    key = F.concat_ws("@", F.replace(F.substring_index("want", " ", 1), F.lit('"'), F.lit("")), F.replace(F.regexp_replace("want", r"^\S+ ", ""), F.lit('"'), F.lit("")))
    return wants.withColumn("key", key).join(keys, ["file", "key"]).select("file", "src", "dst").distinct()


def requirements(files: DataFrame) -> DataFrame:
    """Requirement lines; comments, options and URLs are left out. version is the text of the constraints."""
    line = files.select("file", F.explode(F.split("content", r"\r?\n")).alias("t"))
    t = F.trim(F.regexp_replace("t", r"(^|\s)#.*$", ""))
    name = F.regexp_extract(t, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    spec = F.trim(F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z0-9][A-Za-z0-9._-]*\s*(\[[^\]]*\])?", ""), r"\s*;.*$", ""))
    return _rows(line.where(~F.rlike(t, F.lit(r"^-|://"))), name, F.nullif(spec, F.lit("")))


def pipfile_lock(files: DataFrame) -> DataFrame:
    """default and develop entries; versions lose their ==."""
    entry = "map<string,struct<version:string>>"
    j = _json(files, f"`default` {entry}, develop {entry}")
    part = lambda key, env: _rows(j.select("file", F.explode(f"j.{key}").alias("name", "v")), F.col("name"), F.substring("v.version", 3, 1 << 20), env, False)
    return part("`default`", "production").unionByName(part("develop", "development"))


def toml_packages(files: DataFrame) -> DataFrame:
    """``[[package]]`` tables of poetry, uv, pdm and cargo locks."""
    table = files.select("file", F.explode(F.slice(F.split("content", r"(?m)^\[\[package\]\]\s*$"), 2, 1 << 30)).alias("t"))
    key = lambda k: F.regexp_extract("t", rf'(?m)^{k}\s*=\s*"([^"]*)"', 1)
    env = F.when(key("category") == "dev", "development").otherwise("production")
    return _rows(table, key("name"), key("version"), env, False)


def toml_edges(files: DataFrame) -> DataFrame:
    """(file, src, dst) of ``[[package]]`` tables: names in their dependencies, as array or sub-table."""
    table = files.select("file", F.explode(F.slice(F.split("content", r"(?m)^\[\[package\]\]\s*$"), 2, 1 << 30)).alias("t"))
    src = F.regexp_extract("t", r'(?m)^name\s*=\s*"([^"]*)"', 1)
    array = F.regexp_extract("t", r"(?ms)^dependencies\s*=\s*\[(.*?)^?\]", 1)
    sub = F.regexp_extract("t", r"(?ms)^\[package\.dependencies\]\s*\n(.*?)(?=^\[|\z)", 1)
    names = F.concat(F.regexp_extract_all(array, F.lit(r'(?:name\s*=\s*|^\s*|,\s*|\[\s*)"([^" ]+)'), F.lit(1)), F.regexp_extract_all(sub, F.lit(r'(?m)^"?([A-Za-z0-9._-]+)"?\s*='), F.lit(1)))
    return table.select("file", src.alias("src"), F.explode(names).alias("dst")).distinct()


def gemfile_lock(files: DataFrame) -> DataFrame:
    """Specs of all sections; those under DEPENDENCIES are direct."""
    spec = files.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^ {4}(\S+ \([^)]*\))$"), F.lit(1))).alias("t"))
    direct = files.select("file", F.explode(F.regexp_extract_all(F.regexp_extract("content", r"(?s)\nDEPENDENCIES\n((?:  [^\n]*\n?)*)", 1), F.lit(r"(?m)^  ([^\s!]+)"), F.lit(1))).alias("name")).distinct().withColumn("_d", F.lit(True))
    rows = spec.select("file", F.substring_index("t", " ", 1).alias("name"), F.regexp_extract("t", r"\(([^)]*)\)", 1).alias("version"))
    return _rows(rows.join(direct, ["file", "name"], "left"), F.col("name"), F.col("version"), direct=F.coalesce("_d", F.lit(False)))


def gemfile_lock_edges(files: DataFrame) -> DataFrame:
    """(file, src, dst): the indented names below each spec."""
    block = files.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)(^ {4}\S[^\n]*(?:\n {6}\S[^\n]*)*)"), F.lit(1))).alias("t"))
    src = F.regexp_extract("t", r"^ {4}(\S+)", 1)
    return block.select("file", src.alias("src"), F.explode(F.regexp_extract_all("t", F.lit(r"(?m)^ {6}(\S+)"), F.lit(1))).alias("dst")).distinct()


def go_mod(files: DataFrame) -> DataFrame:
    """require entries, all direct, ``// indirect`` ones too; replaced ones carry their new name, local ones vanish."""
    text = F.regexp_replace("content", r"(?m)(^|\s)//.*$", "")
    block = lambda word: F.flatten(F.transform(F.regexp_extract_all(text, F.lit(rf"(?ms)^{word}\s*\((.*?)^\)"), F.lit(1)), lambda b: F.split(b, "\n")))
    single = lambda word: F.regexp_extract_all(text, F.lit(rf"(?m)^{word}[ \t]+([^(\s].*)$"), F.lit(1))
    lines = lambda word: files.select("file", F.explode(F.concat(block(word), single(word))).alias("t")).withColumn("t", F.btrim("t", F.lit(" \t\r"))).where("t <> ''")
    need = lines("require").select("file", F.regexp_extract("t", r"^(\S+)", 1).alias("package"), F.regexp_extract("t", r"^\S+\s+(\S+)", 1).alias("version"))
    swap = lines("replace").select("file", F.regexp_extract("t", r"^(\S+)", 1).alias("package"), F.regexp_extract("t", r"=>\s*(\S+)", 1).alias("to"), F.regexp_extract("t", r"=>\s*\S+\s+(\S+)", 1).alias("to_version"))
    rows = need.join(swap, ["file", "package"], "left").where("to IS NULL OR NOT to RLIKE '^[./]'")
    return _rows(rows, F.coalesce("to", "package"), locators.go_version(F.coalesce(F.nullif("to_version", F.lit("")), "version")))


def composer_lock(files: DataFrame) -> DataFrame:
    """packages and packages-dev, all direct."""
    entry = f"array<struct<name:string,version:string,require:{_STRINGS}>>"
    j = _json(files, f"packages {entry}, `packages-dev` {entry}")
    part = lambda key, env: _rows(j.select("file", F.explode(f"j.{key}").alias("p")), F.col("p.name"), F.col("p.version"), env)
    return part("packages", "production").unionByName(part("`packages-dev`", "development"))


def composer_lock_edges(files: DataFrame) -> DataFrame:
    """(file, src, dst): what packages require."""
    entry = f"array<struct<name:string,require:{_STRINGS}>>"
    none = F.array().cast(entry)
    j = _json(files, f"packages {entry}, `packages-dev` {entry}")
    p = j.select("file", F.explode(F.concat(F.coalesce("j.packages", none), F.coalesce("j.`packages-dev`", none))).alias("p"))
    return p.select("file", F.col("p.name").alias("src"), F.explode(F.map_keys("p.require")).alias("dst")).distinct()


def packages_config(files: DataFrame) -> DataFrame:
    """package elements of an XML list, all direct."""
    pair = F.arrays_zip(F.xpath("content", F.lit("packages/package/@id")).alias("id"), F.xpath("content", F.lit("packages/package/@version")).alias("version"))
    return _rows(files.select("file", F.explode(pair).alias("p")), F.col("p.id"), F.col("p.version"))


def pom(files: DataFrame) -> DataFrame:
    """Dependencies of a project file as group:artifact; test scope is the testing environment; properties are filled in."""
    entry = files.select("file", "content", F.explode(F.regexp_extract_all(F.regexp_replace("content", r"(?s)<dependencyManagement>.*?</dependencyManagement>", ""), F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("t"))
    tag = lambda k: F.regexp_extract("t", rf"<{k}>\s*([^<]*?)\s*</{k}>", 1)
    names = F.regexp_extract_all(F.regexp_extract("content", r"(?s)<properties>(.*?)</properties>", 1), F.lit(r"<([\w.-]+)>[^<]*</"), F.lit(1))
    values = F.regexp_extract_all(F.regexp_extract("content", r"(?s)<properties>(.*?)</properties>", 1), F.lit(r"<[\w.-]+>([^<]*)</"), F.lit(1))
    entry = entry.withColumn("props", F.map_from_arrays(names, values)).withColumn("v", tag("version"))
    wanted = F.regexp_extract("v", r"^\$\{([\w.-]+)\}$", 1)
    version = F.when(wanted == "", F.col("v")).otherwise(F.coalesce(F.try_element_at("props", wanted), F.concat(F.lit("PROPERTY NOT FOUND: "), wanted)))
    return _rows(entry, F.concat_ws(":", tag("groupId"), tag("artifactId")), F.nullif(version, F.lit("")), F.when(tag("scope") == "test", "testing").otherwise("production"))


def renv_lock(files: DataFrame) -> DataFrame:
    j = _json(files, "Packages map<string,struct<Package:string,Version:string,Source:string>>")
    return _rows(j.select("file", F.explode("j.Packages").alias("k", "p")), F.col("p.Package"), F.col("p.Version"), direct=False)


def conda_environment(files: DataFrame) -> DataFrame:
    """Items of dependencies and of its nested pip list, all direct."""
    item = files.select("file", F.explode(F.regexp_extract_all(F.regexp_extract("content", r"(?ms)^dependencies:\s*\n(.*?)(?=^\S|\z)", 1), F.lit(r"(?m)^\s+-\s+([A-Za-z0-9._-]+[^:\n]*)$"), F.lit(1))).alias("t"))
    return _rows(item, F.regexp_extract("t", r"^([A-Za-z0-9._-]+)", 1), F.nullif(F.regexp_extract("t", r"^[A-Za-z0-9._-]+\s*=+\s*([^=\s]+)", 1), F.lit("")))


def swift_resolved(files: DataFrame) -> DataFrame:
    """Pins of all schema versions; none is direct until a manifest names it."""
    state = "state:struct<version:string,revision:string,branch:string>"
    j = _json(files, f"pins array<struct<location:string,{state}>>, object struct<pins:array<struct<repositoryURL:string,{state}>>>")
    new = j.select("file", F.explode("j.pins").alias("p")).select("file", F.col("p.location").alias("u"), "p.state")
    old = j.select("file", F.explode("j.object.pins").alias("p")).select("file", F.col("p.repositoryURL").alias("u"), "p.state")
    return _rows(new.unionByName(old), F.col("u"), F.coalesce("state.version", "state.branch", "state.revision"), direct=False)


def cartfile_resolved(files: DataFrame) -> DataFrame:
    line = files.select("file", F.explode(F.split("content", r"\r?\n")).alias("t"))
    return _rows(line, F.regexp_extract("t", r'^(?:github|git|binary) "([^"]*)"', 1), F.regexp_extract("t", r'^\S+ "[^"]*" "([^"]*)"', 1))


def apk_installed(files: DataFrame) -> DataFrame:
    """Stanzas of an apk database; those without name, version or architecture are left out."""
    stanza = files.select("file", F.explode(F.split("content", r"\n\n+")).alias("t"))
    key = lambda k: F.regexp_extract("t", rf"(?m)^{k}:(.+)$", 1)
    return _rows(stanza.where((key("V") != "") & (key("A") != "")), key("P"), F.concat(key("A"), F.lit("#"), key("V")))


def dpkg_status(files: DataFrame) -> DataFrame:
    """Stanzas of a dpkg database; a stanza without a field drops its whole file."""
    stanza = files.select("file", F.explode(F.filter(F.split("content", r"\n\n+"), lambda t: F.trim(t) != "")).alias("t"))
    key = lambda k: F.regexp_extract("t", rf"(?m)^{k}:[ \t]*(.+)$", 1)
    rows = stanza.select("file", key("Package").alias("name"), key("Version").alias("v"), key("Architecture").alias("a"))
    bad = rows.where("name = '' OR v = '' OR a = ''").select("file").distinct()
    return _rows(rows.join(bad, "file", "left_anti"), F.col("name"), F.concat_ws("#", "a", "v"))


def os_identity(release: Column, cpe: Column, busybox: Column) -> Column:
    """A struct of id and version from os-release text, a CPE line or a busybox banner; ``linux`` if none says."""
    quoted = lambda k: F.regexp_extract(release, rf'(?m)^{k}="?([^"\n]*)"?$', 1)
    some = lambda c: F.nullif(c, F.lit(""))
    cpe_part = lambda i: F.regexp_extract(cpe, r"^cpe:/o:([^:]*):([^:]*):([^:\s]*)", i)
    banner = F.regexp_extract(busybox, r"BusyBox v(\S+)", 1)
    name = F.coalesce(some(quoted("ID")), some(cpe_part(2)), F.when(banner != "", "busybox"), F.lit("linux"))
    version = F.coalesce(some(quoted("VERSION_ID")), some(cpe_part(3)), some(banner))
    return F.struct(name.alias("id"), version.alias("version"))
