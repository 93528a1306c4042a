"""Lock files with links, made from the test tables: one file for each supplier, its parts as packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.sets import central_versions
from lodestone.plans.reader_queries import _ALL, _DEEP, _EDGES, _ENV, _PACKAGES, _PLAIN, _files, _packages
from lodestone.plans.registry import Registry
from lodestone.sources import locks

registry = Registry()
query = registry.query

#: Edges between packages of a file, ends as name@version.
_AT = f"WITH {_PACKAGES} SELECT a.file, a.name || '@' || a.version AS src, b.name || '@' || b.version AS dst FROM pk a JOIN pk b ON b.file = a.file AND b.name = a.dep"
_BY_NAME = f"WITH {_PACKAGES} SELECT file, name AS src, dep AS dst FROM pk"
_ODD = "name LIKE '%1'"


def _wrapped(body: DataFrame, *parts: str | Column) -> DataFrame:
    return body.select("file", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("content"))


def _two(rows: DataFrame, one: Column, two: Column, only: Column, between: str) -> DataFrame:
    """(file, content, d): the items of all packages, and other items of some."""
    return _files(rows, one, between=between).join(_files(rows, two, between=between, only=only).withColumnRenamed("content", "d"), "file", "left").withColumn("d", F.coalesce("d", F.lit("")))


def _odd() -> Column:
    return F.col("name").endswith("1")


def _npm(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.format_string('"%s":{"version":"%s","dev":%s,"requires":{"%s":"^9"},"dependencies":{"in-%s":{"version":"7"}}}', "name", "version", F.col("dev").cast("string"), "dep", "name")
    return _wrapped(_files(_packages(spark, sf_dir), item, between=","), '{"lockfileVersion":1,"dependencies":{', F.col("content"), "}}")


@query(f"WITH {_PACKAGES} SELECT file, name, version, {_ENV} AS env, {_ODD} AS is_direct FROM pk UNION ALL SELECT file, 'in-' || name, '7', 'production', false FROM pk")
def reader_npm_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.npm_v1(_npm(spark, sf_dir), _packages(spark, sf_dir).where(_odd()).select("file", "name"))


@query(f"WITH {_PACKAGES} SELECT DISTINCT a.file, a.name || '@' || a.version AS src, a.dep || '@' || coalesce(b.version, '^9') AS dst FROM pk a LEFT JOIN pk b ON b.file = a.file AND b.name = a.dep")
def reader_npm_v1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.npm_v1_edges(_npm(spark, sf_dir))


def _bun(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.format_string('  "%s": ["%s@%s", "", {"dependencies": {"%s": "*"}}, "sha"], // note', "name", "name", "version", "dep")
    both = _two(_packages(spark, sf_dir), item, F.format_string('"%s": "*"', "name"), _odd(), "\n")
    return _wrapped(both, '{ "workspaces": {"": {"dependencies": {', F.replace("d", F.lit("\n"), F.lit(",")), '},},},\n "packages": {\n', F.col("content"), "\n } }")


@query(f"WITH {_PACKAGES} SELECT file, name, version, CASE WHEN {_ODD} THEN 'production' END AS env, {_ODD} AS is_direct FROM pk")
def reader_bun_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.bun_lock(_bun(spark, sf_dir))


@query(_AT)
def reader_bun_lock_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.bun_lock_edges(_bun(spark, sf_dir))


def _pnpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.format_string("  /%s@%s:\n    dev: %s\n    dependencies:\n      %s: 1.0_peer@2", "name", "version", F.col("dev").cast("string"), "dep")
    both = _two(_packages(spark, sf_dir), item, F.format_string("  %s: %s(peer@2)", "name", "version"), _odd(), "\n")
    return _wrapped(both, "lockfileVersion: '6.0'\ndependencies:\n  none: 0\n", F.col("d"), "\npackages:\n", F.col("content"), "\n")


@query(f"WITH {_PACKAGES} SELECT file, name, version, CASE WHEN {_ODD} OR NOT dev THEN 'production' ELSE 'development' END AS env, {_ODD} AS is_direct FROM pk")
def reader_pnpm_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.pnpm_lock(_pnpm(spark, sf_dir))


@query(f"WITH {_PACKAGES} SELECT file, name || '@' || version AS src, dep || '@1.0' AS dst FROM pk")
def reader_pnpm_lock_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.pnpm_lock_edges(_pnpm(spark, sf_dir))


def _berry(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.format_string('"%s@^1, %s@^1.0":\n  version: %s\n  resolution: "%s@npm:%s"\n  dependencies:\n    %s: ^1', "name", "name", "version", "name", "version", "dep")
    both = _two(_packages(spark, sf_dir), item, F.format_string("    %s: ^1.0", "name"), _odd(), "\n")
    return _wrapped(both, '__metadata:\n  version: 6\n"root@workspace:.":\n  resolution: "root@workspace:."\n  dependencies:\n    none: ^1\n', F.col("d"), "\n", F.col("content"), "\n")


@query(_ALL.format(env="'production'", direct=_ODD))
def reader_yarn_berry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.yarn_berry(_berry(spark, sf_dir))


@query(_AT)
def reader_yarn_berry_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.yarn_berry_edges(_berry(spark, sf_dir))


def _plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.substring(c, 2, 20)
    item = F.format_string('{"numericId":%s,"groupId":"g","artifactId":"%s","version":"%s","scopes":["%s"],"isDirect":%s}', number("name"), "name", "version", F.when(F.col("dev"), "test").otherwise("compile"), _odd().cast("string"))
    both = _two(_packages(spark, sf_dir), item, F.format_string('{"numericFrom":%s,"numericTo":%s}', number("name"), number("dep")), F.lit(True), ",")
    return _wrapped(both, '{"artifacts":[', F.col("content"), '],"dependencies":[', F.col("d"), "]}")


@query(f"WITH {_PACKAGES} SELECT file, 'g:' || name AS name, version, CASE WHEN dev THEN 'testing' ELSE 'production' END AS env, {_ODD} OR name LIKE '%22' AS is_direct FROM pk")
def reader_maven_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = _packages(spark, sf_dir).where("name LIKE '%22'").select("file", F.col("name").alias("artifact"))
    return locks.maven_plugin(_plugin(spark, sf_dir), modules)


@query(_AT.replace("SELECT a.file, a.name", "SELECT a.file, 'g:' || a.name").replace(", b.name", ", 'g:' || b.name"))
def reader_maven_plugin_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.maven_plugin_edges(_plugin(spark, sf_dir))


def _dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.format_string('  "g:root:jar:1" -> "g:%s:jar:%s:%s" ;', "name", "version", F.when(F.col("dev"), "test").otherwise("compile"))
    return _wrapped(_files(_packages(spark, sf_dir), item), 'digraph "g:root:jar:1" {\n', F.col("content"), "\n}\n")


@query(f"WITH {_PACKAGES} SELECT file, 'g:' || name AS name, version, CASE WHEN dev THEN 'testing' ELSE 'production' END AS env, false AS is_direct FROM pk UNION ALL SELECT DISTINCT file, 'g:root', '1', 'production', true FROM pk")
def reader_maven_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.maven_dot(_dot(spark, sf_dir))


@query(f"WITH {_PACKAGES} SELECT file, 'g:root@1' AS src, 'g:' || name || '@' || version AS dst FROM pk")
def reader_maven_dot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.maven_dot_edges(_dot(spark, sf_dir))


def _gradle(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda a, b: F.format_string('{"type":"package","name":"g:%s","version":"%s"}', a, b)
    conf = F.when(F.col("dev"), "testImplementation").otherwise("api")
    item = F.concat(F.lit('{"name":"'), conf, F.lit('","directComponents":['), F.when(_odd(), part("name", "version")).otherwise(""), F.lit('],"dependencies":[{"node":'), part("name", "version"), F.lit(',"outgoing":[{"type":"project","name":":lib"}]}]}'))
    return _wrapped(_files(_packages(spark, sf_dir), item, between=","), '{"name":":app","configurations":[', F.col("content"), "]}\nnot json\n")


@query(f"""WITH {_PACKAGES}, e AS (SELECT *, CASE WHEN dev THEN 'testing' ELSE 'api' END AS env FROM pk)
SELECT file, 'g:' || name AS name, version, env, {_ODD} AS is_direct FROM e UNION ALL SELECT DISTINCT file, ':lib', NULL, env, false FROM e""")
def reader_gradle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.gradle(_gradle(spark, sf_dir))


@query(f"WITH {_PACKAGES} SELECT file, 'g:' || name || '@' || version AS src, ':lib' AS dst FROM pk WHERE NOT dev")
def reader_gradle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.gradle_edges(_gradle(spark, sf_dir), ["api"])


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.format_string('"%s/%s":{"type":"%s","dependencies":{"%s":"1"}}', "name", "version", F.when(F.col("dev"), "project").otherwise("package"), "dep")
    both = _two(_packages(spark, sf_dir), item, F.format_string('"%s":{"target":"Package"}', "name"), _odd(), ",")
    return _wrapped(both, '{"targets":{".NETCoreApp,Version=v3.1":{', F.col("content"), '}},"project":{"frameworks":{"netcoreapp3.1":{"dependencies":{', F.col("d"), "}}}}}")


@query(_ALL.format(env="'production'", direct=_ODD) + " WHERE NOT dev")
def reader_project_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.project_assets(_assets(spark, sf_dir))


@query(_AT + " WHERE NOT a.dev AND NOT b.dev")
def reader_project_assets_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.project_assets_edges(_assets(spark, sf_dir))


@query(f"WITH {_PACKAGES} SELECT file, upper(name) AS id, CASE WHEN dev THEN '9.' || name ELSE version END AS version FROM pk")
def reader_package_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packages(spark, sf_dir)
    item = F.when(F.col("dev"), F.format_string('<PackageReference Include="%s" />', F.upper("name"))).otherwise(F.format_string('<PackageReference Update="%s"><Version> %s </Version></PackageReference>', F.upper("name"), "version"))
    found = locks.package_references(_wrapped(_files(rows, item), "<Project>", F.col("content"), "</Project>"))
    return central_versions(found, rows.select(F.col("name").alias("id"), F.concat(F.lit("9."), "name").alias("version")).distinct())


def _paket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(_packages(spark, sf_dir), F.format_string("    %s (%s)\n      %s (>= 1)", "name", "version", "dep"), "NUGET\n  remote: https://x\n")


@query(_PLAIN)
def reader_paket_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.paket_lock(_paket(spark, sf_dir))


@query(_BY_NAME)
def reader_paket_lock_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.paket_lock_edges(_paket(spark, sf_dir))


def _go_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.format_string('{\n"ImportPath":"x/%s/pkg","Imports":["fmt","x/%s/pkg"],"Module":{"Path":"x/%s","Version":"v%s","Indirect":%s}\n}', "name", "dep", "name", "version", F.col("dev").cast("string"))
    return _wrapped(_files(_packages(spark, sf_dir), item), '{\n"ImportPath":"fmt","Standard":true\n}\n{\n"ImportPath":"main","Imports":["fmt"],"Module":{"Path":"main","Main":true}\n}\n', F.col("content"))


@query(f"WITH {_PACKAGES} SELECT file, 'x/' || name AS name, 'v' || version AS version, 'production' AS env, NOT dev AS is_direct FROM pk")
def reader_go_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.go_list(_go_list(spark, sf_dir))


@query(_EDGES.format(p="'x/'"))
def reader_go_list_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.go_list_edges(_go_list(spark, sf_dir))


@query(_PLAIN)
def reader_gopkg_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.gopkg_lock(_files(_packages(spark, sf_dir), F.format_string('[[projects]]\n  name = "%s"\n  revision = "%s"\n', "name", "version")))


@query(_PLAIN)
def reader_glide_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.glide_lock(_files(_packages(spark, sf_dir), F.format_string("- name: %s\n  version: %s", "name", "version"), "hash: x\nimports:\n"))


@query(f"WITH {_PACKAGES} SELECT file, name, version, dep || ',zz' AS requires FROM pk")
def reader_pip_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = locks.pip_show(_files(_packages(spark, sf_dir), F.format_string("Name: %s\nVersion: %s\nRequires: %s, zz", "name", "version", "dep"), between="\n---\n"))
    return rows.withColumn("requires", F.array_join("requires", ","))


def _pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _two(_packages(spark, sf_dir), F.format_string("  - %s (%s):\n    - %s (~> 1)", "name", "version", "dep"), F.format_string("  - %s (~> 1)", "name"), _odd(), "\n")
    return _wrapped(both, "PODS:\n", F.col("content"), "\nDEPENDENCIES:\n  - none\n", F.col("d"), "\n")


@query(_ALL.format(env="'production'", direct=_ODD))
def reader_podfile_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.podfile_lock(_pods(spark, sf_dir))


@query(_BY_NAME)
def reader_podfile_lock_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.podfile_lock_edges(_pods(spark, sf_dir))


@query(_ALL.format(env=_ENV, direct="dev"))
def reader_pubspec_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.format_string('  %s:\n    dependency: "%s"\n    source: hosted\n    version: "%s"', "name", F.when(F.col("dev"), "direct dev").otherwise("transitive"), "version")
    return locks.pubspec_lock(_files(_packages(spark, sf_dir), item, "packages:\n"))


@query(f"WITH {_PACKAGES} SELECT file, 'https://x/' || name AS name, CASE WHEN dev THEN 'main' ELSE version END AS version, 'production' AS env, true AS is_direct FROM pk")
def reader_repo_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.when(F.col("dev"), F.format_string('<project name="%s"/>', "name")).otherwise(F.format_string('<project name="%s" revision="%s"/>', "name", "version"))
    return locks.repo_manifest(_files(_packages(spark, sf_dir), item, '<manifest><remote name="o" fetch="https://x/"/><default remote="o" revision="main"/>', "", "</manifest>"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.format_string('{"id":"%s-id","type":"configured","style":"global","pkg-name":"%s","pkg-version":"%s","depends":["%s-id"]}', "name", "name", "version", "dep")
    both = _two(_packages(spark, sf_dir), item, F.format_string('"%s-id"', "name"), _odd(), ",")
    return _wrapped(both, '{"install-plan":[{"id":"l","style":"local","pkg-name":"l","components":{"lib":{"depends":[', F.col("d"), "]}}},", F.col("content"), "]}")


@query(_ALL.format(env="'production'", direct=_ODD))
def reader_cabal_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.cabal_plan(_plan(spark, sf_dir))[0]


@query(_EDGES.format(p="''"))
def reader_cabal_plan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.cabal_plan(_plan(spark, sf_dir))[1]


@query(_DEEP.replace("'production'", "CASE WHEN dev THEN 'testing' ELSE 'production' END"))
def reader_perl_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packages(spark, sf_dir)
    part = lambda dev: _files(rows, F.format_string('"%s":"%s"', "name", "version"), between=",", only=F.col("dev") == dev)
    both = part(False).join(part(True).withColumnRenamed("content", "d"), "file", "full")
    return locks.perl_meta(_wrapped(both, '{"prereqs":{"runtime":{"requires":{"perl":"5",', F.coalesce("content", F.lit('"perl":"5"')), '}},"test":{"requires":{', F.coalesce("d", F.lit("")), "}}}}"))


@query(_PLAIN)
def reader_rpm_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.rpm_spec(_files(_packages(spark, sf_dir), F.format_string("Requires: %s >= %s", "name", "version"), "Name: x\nBuildRequires: gcc\n", after="\nRequires: %{x}-libs\n"))


@query(f"WITH {_PACKAGES} SELECT file, name, version || '?os=Linux&package_id=p' || version AS version, CASE WHEN dev THEN 'development' ELSE 'production' END AS env, true AS is_direct FROM pk")
def reader_conan_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.format_string('"%s":{"ref":"x","name":"%s","version":"%s","package_id":"p%s","context":"%s","settings":{"os":"Linux"}}', "name", "name", "version", "version", F.when(F.col("dev"), "build").otherwise("host"))
    return locks.conan_graph(_wrapped(_files(_packages(spark, sf_dir), item, between=","), '{"graph":{"nodes":{"0":{"ref":"conanfile"},', F.col("content"), "}}}"))
