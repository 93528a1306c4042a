"""Lock files written by hand, one for each reader of links."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.sources import locks, manifests, registry


@pytest.fixture
def read(spark):
    def run(reader, text, *more):
        files = spark.createDataFrame([("f", text), ("broken", "{ not: [a file")], "file string, content string")
        return {tuple(r)[1:] for r in reader(files, *more).collect()}

    return run


def test_plain_json(spark):
    text = '{ // note\n "a": "x // y", /* b\n c */ "d": [1, 2,], "e": "tail,}", }'
    got = spark.createDataFrame([(text,)], "t string").select(locks.plain_json(F.col("t"))).first()[0]
    assert __import__("json").loads(got) == {"a": "x // y", "d": [1, 2], "e": "tail,}"}


NPM = """{"lockfileVersion": 2, "packages": {"": {}, "node_modules/a": {"peerDependencies": {"c": "*"}}},
"dependencies": {
 "a": {"version": "1.0.0", "requires": {"b": "^2.0.0"}, "dependencies": {"b": {"version": "2.1.0", "requires": {"d": "^1", "zz": "9"}}, "d": {"version": "1.5.0", "dev": true}}},
 "b": {"version": "3.0.0", "dev": true}, "c": {"version": "4.0.0"}, "d": {"version": "8.0.0"}, "local": {"version": "file:../x"}}}"""


def test_npm_v1(spark, read):
    direct = spark.createDataFrame([("f", "a"), ("f", "d"), ("f", "local")], "file string, name string")
    assert read(locks.npm_v1, NPM, direct) == {
        ("a", "1.0.0", "production", True), ("b", "2.1.0", "production", False), ("d", "1.5.0", "development", False),
        ("b", "3.0.0", "development", False), ("c", "4.0.0", "production", False), ("d", "8.0.0", "production", True),
    }
    assert read(locks.npm_v1_edges, NPM) == {("a@1.0.0", "b@2.1.0"), ("b@2.1.0", "d@1.5.0"), ("b@2.1.0", "zz@9"), ("a@1.0.0", "c@4.0.0")}


BUN = """{ "lockfileVersion": 1, // bun
 "workspaces": {"": {"name": "x", "dependencies": {"a": "^1"}, "devDependencies": {"b": "^2"}, "optionalDependencies": {"g": "github:u/r#abc"}},},
 "packages": {
  "a": ["a@1.2.0", "", {"dependencies": {"c": "*"}, "peerDependencies": {"b": "*"}}, "sha512-x"],
  "b": ["b@2.0.0", "", {}, "sha512-y"], "c": ["@s/c@3.0.0", "", {}, "sha"],
  "g": ["g@github:u/r#abc", {"dependencies": {"w": "*"}}, "u-r-abc"], "w": ["w@workspace:packages/w"],
 } }"""


def test_bun(read):
    assert read(locks.bun_lock, BUN) == {("a", "1.2.0", "production", True), ("b", "2.0.0", "development", True), ("@s/c", "3.0.0", None, False), ("u/r", "abc", "production", True)}
    assert read(locks.bun_lock_edges, BUN) == {("a@1.2.0", "@s/c@3.0.0"), ("a@1.2.0", "b@2.0.0")}


PNPM9 = """lockfileVersion: '9.0'
catalogs:
  default:
    react: {specifier: ^18, version: 18.2.0}
importers:
  .:
    dependencies:
      react: {specifier: 'catalog:', version: 18.2.0}
      '@s/x': {specifier: ^1, version: 1.0.0(react@18.2.0)}
    devDependencies:
      tool: {specifier: ^3, version: 3.0.0}
packages:
  react@18.2.0: {resolution: {integrity: a}}
  '@s/x@1.0.0': {resolution: {integrity: b}}
  tool@3.0.0: {resolution: {integrity: c}}
  deep@0.1.0: {resolution: {integrity: d}}
snapshots:
  '@s/x@1.0.0(react@18.2.0)':
    dependencies: {react: 18.2.0, deep: 0.1.0}
"""
PNPM5 = """lockfileVersion: 5.4
dependencies:
  a: 1.0.0
packages:
  /a/1.0.0:
    dependencies: {b: 2.0.0_peer@1}
    dev: false
  /b/2.0.0_peer@1: {dev: true}
"""


def test_pnpm(read):
    assert read(locks.pnpm_lock, PNPM9) == {("react", "18.2.0", "production", True), ("@s/x", "1.0.0", "production", True), ("tool", "3.0.0", "development", True), ("deep", "0.1.0", "production", False)}
    assert read(locks.pnpm_lock_edges, PNPM9) == {("@s/x@1.0.0", "react@18.2.0"), ("@s/x@1.0.0", "deep@0.1.0")}
    assert read(locks.pnpm_lock, PNPM5) == {("a", "1.0.0", "production", True), ("b", "2.0.0", "development", False)}
    assert read(locks.pnpm_lock_edges, PNPM5) == {("a@1.0.0", "b@2.0.0")}


BERRY = """__metadata:
  version: 6
"root@workspace:.":
  version: 0.0.0-use.local
  resolution: "root@workspace:."
  dependencies:
    a: ^1.0.0
    g: "https://github.com/u/g.git#commit=abc"
"a@^1.0.0, a@^1.1.0":
  version: 1.1.0
  resolution: "a@npm:1.1.0"
  dependencies:
    "@s/b": ~2.0.0
"@s/b@~2.0.0":
  version: 2.0.1
  resolution: "@s/b@npm:2.0.1"
"g@https://github.com/u/g.git#commit=abc":
  version: 1.0.0
  resolution: "g@https://github.com/u/g.git#commit=abc"
"""


def test_yarn_berry(read):
    assert read(locks.yarn_berry, BERRY) == {("a", "1.1.0", "production", True), ("@s/b", "2.0.1", "production", False), ("https://github.com/u/g.git", "abc", "production", True)}
    assert read(locks.yarn_berry_edges, BERRY) == {("a@1.1.0", "@s/b@2.0.1")}


PLUGIN = """{"artifacts": [
 {"numericId": 1, "groupId": "g", "artifactId": "a", "version": "1", "scopes": ["compile"], "optional": false, "isDirect": true},
 {"numericId": 2, "groupId": "g", "artifactId": "b", "version": "2", "scopes": ["test", "runtime"], "optional": true, "isDirect": false},
 {"numericId": 3, "groupId": "g", "artifactId": "m", "version": "3", "scopes": [], "optional": false, "isDirect": false}],
 "dependencies": [{"numericFrom": 1, "numericTo": 2}, {"numericFrom": 1, "numericTo": 9}]}"""
DOT = """digraph "g:root:jar:1.0" {
 "g:root:jar:1.0" -> "g:a:jar:2.0:compile" ;
 "g:a:jar:2.0:compile" -> "g:b:jar:linux:3.0:test" ;
}
digraph "g:lone:pom:4" {
}"""
GRADLE = """{"name": ":app", "configurations": [{"name": "runtimeClasspath", "directComponents": [{"type": "package", "name": "g:a", "version": "1"}], "dependencies": [{"node": {"type": "package", "name": "g:a", "version": "1"}, "outgoing": [{"type": "project", "name": ":lib"}]}]}]}
{"name": ":lib", "configurations": [{"name": "testImplementation", "directComponents": [{"type": "package", "name": "g:a", "version": "1"}], "dependencies": []}, {"name": "spotbugs", "directComponents": [], "dependencies": [{"node": {"type": "package", "name": "g:s", "version": "2"}, "outgoing": []}]}]}"""


def test_maven_and_gradle(spark, read):
    modules = spark.createDataFrame([("f", "m")], "file string, artifact string")
    assert read(locks.maven_plugin, PLUGIN, modules) == {("g:a", "1", "production", True), ("g:b", "2", "testing", False), ("g:b", "2", "runtime", False), ("g:m", "3", None, True)}
    assert read(locks.maven_plugin_edges, PLUGIN) == {("g:a@1", "g:b@2")}
    assert read(locks.maven_dot, DOT) == {("g:root", "1.0", "production", True), ("g:a", "2.0", "production", False), ("g:b", "3.0", "testing", False), ("g:lone", "4", "production", True)}
    assert read(locks.maven_dot_edges, DOT) == {("g:root@1.0", "g:a@2.0"), ("g:a@2.0", "g:b@3.0")}
    assert read(locks.gradle, GRADLE) == {("g:a", "1", "runtimeClasspath", True), (":lib", None, "runtimeClasspath", False), ("g:a", "1", "testing", True), ("g:s", "2", "development", False)}
    assert read(locks.gradle, GRADLE, ["spotbugs"]) == {("g:s", "2", "spotbugs", False)}
    assert read(locks.gradle_edges, GRADLE) == {("g:a@1", ":lib")}


ASSETS = """{"targets": {".NETCoreApp,Version=v3.1": {"A/1.0": {"type": "package", "dependencies": {"B": "2.0"}}, "B/2.0": {"type": "package"}, "P/1.0": {"type": "project"}},
 ".NETFramework,Version=v4.7": {"C/3.0": {"type": "package"}, "A/1.0": {"type": "package"}}},
 "project": {"frameworks": {"netcoreapp3.1": {"dependencies": {"A": {"target": "Package"}}}, "net47": {"dependencies": {"C": {"target": "Package"}}}}}}"""
PAKET = "NUGET\n  remote: https://x\n    A (1.0)\n      B (>= 2)\n    B (2.1)\nGROUP Test\nNUGET\n  remote: https://y\n    C (3.0)\n"
CSPROJ = '<Project><ItemGroup><PackageReference Include="A" Version="1.0" /><PackageReference Update="B"><Version>2.0</Version></PackageReference><PackageReference Include="C" /></ItemGroup></Project>'


def test_nuget(read):
    assert read(locks.project_assets, ASSETS) == {("A", "1.0", "production", True), ("B", "2.0", "production", False), ("C", "3.0", "production", True)}
    assert read(locks.project_assets_edges, ASSETS) == {("A@1.0", "B@2.0")}
    assert read(locks.paket_lock, PAKET) == {("A", "1.0", "production", True), ("B", "2.1", "production", True), ("C", "3.0", "production", True)}
    assert read(locks.paket_lock_edges, PAKET) == {("A", "B")}
    assert read(locks.package_references, CSPROJ) == {("A", "1.0"), ("B", "2.0"), ("C", None)}


GO_LIST = """{
	"ImportPath": "x.org/main", "Imports": ["fmt", "x.org/a/p"], "Module": {"Path": "x.org/main", "Main": true}
}
{
	"ImportPath": "fmt", "Standard": true
}
{
	"ImportPath": "x.org/a/p", "Imports": ["x.org/b"], "Module": {"Path": "x.org/a", "Version": "v1.0.0"}
}
{
	"ImportPath": "x.org/b", "Imports": ["C"], "Module": {"Path": "x.org/b", "Version": "v2.0.0", "Indirect": true}
}"""
GO_MOD = "module x\n\nrequire (\n\ta.org/a v1.2.3 // indirect\n\tb.org/b v2.0.0+incompatible\n)\nrequire c.org/c v0.0.0-20200101000000-abcdefabcdef // note\nreplace b.org/b => ../b\n"


def test_go(read):
    assert read(locks.go_list, GO_LIST) == {("x.org/a", "v1.0.0", "production", True), ("x.org/b", "v2.0.0", "production", False)}
    assert read(locks.go_list_edges, GO_LIST) == {("x.org/a", "x.org/b")}
    assert read(manifests.go_mod, GO_MOD) == {("a.org/a", "v1.2.3", "production", True), ("c.org/c", "abcdefabcdef", "production", True)}
    assert read(locks.gopkg_lock, '[[projects]]\nname = "a"\nrevision = "r1"\nsource = "s"\n[[projects]]\nname = "b"\nrevision = "r2"\n') == {("a", "r1", "production", True), ("b", "r2", "production", True)}
    assert read(locks.glide_lock, "hash: x\nimports:\n- name: a\n  version: '1'\n- name: b\n  version: 2\n") == {("a", "1", "production", True), ("b", "2", "production", True)}


PODS = """PODS:
  - A (1.0):
    - B (~> 2.0)
  - B (2.1)
  - G (0.1)
DEPENDENCIES:
  - A (from `x`)
  - G
EXTERNAL SOURCES:
  G:
    :git: https://x/g.git
    :tag: v1
"""
PUB = "packages:\n  a:\n    dependency: \"direct main\"\n    source: hosted\n    version: \"1.0\"\n  b:\n    dependency: transitive\n    source: hosted\n    version: \"2.0\"\n  s:\n    dependency: \"direct main\"\n    source: sdk\n    version: \"0\"\n"


def test_mobile(read):
    assert read(locks.podfile_lock, PODS) == {("A", "1.0", "production", True), ("B", "2.1", "production", False), ("https://x/g.git", "v1", "production", True)}
    assert read(locks.podfile_lock_edges, PODS) == {("A", "B")}
    assert read(locks.pubspec_lock, PUB) == {("a", "1.0", "production", True), ("b", "2.0", "production", False)}


def test_others(read):
    show = "Name: a\nVersion: 1.0\nRequires: b, c\n---\nName: b\nVersion: 2\nRequires:\n"
    texts = lambda f: locks.pip_show(f).withColumn("requires", F.array_join("requires", ","))
    assert read(texts, show) == {("a", "1.0", "b,c"), ("b", "2", "")}
    manifest = '<manifest><remote name="o" fetch="https://x/" revision="r1"/><remote name="p" fetch="https://y"/><default remote="o" revision="main"/><project name="a"/><project name="b" remote="p"/><project name="c" revision="v9"/></manifest>'
    assert read(locks.repo_manifest, manifest) == {("https://x/a", "r1", "production", True), ("https://y/b", "main", "production", True), ("https://x/c", "v9", "production", True)}
    plan = '{"install-plan": [{"id": "l", "type": "configured", "style": "local", "pkg-name": "l", "pkg-version": "0", "components": {"lib": {"depends": ["a-1"]}}}, {"id": "a-1", "type": "configured", "style": "global", "pkg-name": "a", "pkg-version": "1", "depends": ["b-2"]}, {"id": "b-2", "type": "pre-existing", "pkg-name": "b", "pkg-version": "2"}]}'
    assert read(lambda f: locks.cabal_plan(f)[0], plan) == {("a", "1", "production", True), ("b", "2", "production", False)}
    assert read(lambda f: locks.cabal_plan(f)[1], plan) == {("a", "b")}
    assert read(locks.perl_meta, '{"prereqs": {"runtime": {"requires": {"perl": "5", "A::B": "1"}}, "test": {"requires": {"T": "0"}}}}') == {("A::B", "1", "production", False), ("T", "0", "testing", False)}
    assert read(locks.rpm_spec, "Name: x\nBuildRequires: gcc\nRequires: a >= 1.0, b\nRequires: %{m}-libs = 2\nRequires(post): c = 3\n") == {("a", "1.0", "production", True), ("b", None, "production", True), ("c", "3", "production", True)}
    conan = '{"graph": {"nodes": {"0": {"ref": "conanfile"}, "1": {"ref": "z/1", "name": "z", "version": "1", "package_id": "p", "context": "host", "settings": {"os": "L"}}, "2": {"name": "t", "version": "2", "context": "build"}}}}'
    assert read(locks.conan_graph, conan) == {("z", "1?os=L&package_id=p", "production", True), ("t", "2", "development", True)}


@pytest.mark.parametrize(("names", "env"), [
    (["lintClassPath", "debugRuntimeClasspath", "spotbugs", "compileOnly"], "development"),
    (["testApiDependenciesMetadata", "testReleaseApiDependenciesMetadata", "androidTestApiDependenciesMetadata", "debugAndroidTestImplementationDependenciesMetadata", "releaseUnitTestX", "debugUnitTestAnnotationProcessorClasspath", "jacocoAnt"], "testing"),
    (["default", "androidApis", "implementation", "coreLibraryDesugaring", "releaseRuntimeOnlyDependenciesMetadata", "archives", "myAndroidTestApi"], None),
])
def test_gradle_configurations(spark, names, env):
    lines = "\n".join(f'{{"name":"p","configurations":[{{"name":"{n}","directComponents":[{{"type":"package","name":"{n}","version":"1"}}],"dependencies":[]}}]}}' for n in names)
    rows = locks.gradle(spark.createDataFrame([("f", lines)], "file string, content string")).collect()
    assert {r.name: r.env for r in rows} == {n: env or n for n in names}


def test_npm_trees_of_any_depth_and_dispatch(spark):
    deep = '{"version": "0.1"}'
    for i in range(70, 0, -1):
        deep = f'{{"version": "{i}.0", "dependencies": {{"n{i}": {deep}}}}}'
    tree = f'{{"lockfileVersion": 1, "dependencies": {{"top": {deep}, "other": {{"version": "2.0", "dev": true}}}}}}'
    rows = [("a/package-lock.json", tree), ("a/package.json", '{"dependencies": {"top": "*"}}'), ("b/package-lock.json", '{"lockfileVersion": 3, "packages": {"": {"dependencies": {"x": "*"}}, "node_modules/x": {"version": "1.0"}}}'), ("c/composer.lock", "{ broken"), ("d/README.md", "x")]
    files = spark.createDataFrame(rows, "path string, content string")
    found = registry.read_all(files)
    got = {(r.reader, r.file, r.name): (r.version, r.env, r.is_direct) for r in found.collect()}
    assert got["npm_v1", "a/package-lock.json", "top"] == ("1.0", "production", True) and got["npm_v1", "a/package-lock.json", "n70"] == ("0.1", "production", False)
    assert got["npm_v1", "a/package-lock.json", "other"] == ("2.0", "development", False) and got["npm_lock", "b/package-lock.json", "x"][2]
    assert len([k for k in got if k[0] == "npm_v1"]) == 72
    assert {tuple(r) for r in registry.unread(files, found).collect()} == {("c/composer.lock", "composer_lock")}
