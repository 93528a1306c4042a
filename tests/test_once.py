"""Files are parsed once and edges made once, however many joins and rounds read them."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators.closure import reach
from lodestone.sources import locks, projects

PNPM = "lockfileVersion: '6.0'\ndependencies:\n  a: 1.0\npackages:\n  /a@1.0:\n    dependencies:\n      b: 2.0\n  /b@2.0:\n    dev: true\n"
BERRY = '__metadata:\n  version: 6\n"r@workspace:.":\n  resolution: "r@workspace:."\n  dependencies:\n    a: ^1\n"a@^1":\n  resolution: "a@npm:1"\n  dependencies:\n    b: ^2\n"b@^2":\n  resolution: "b@npm:2"\n'
PODS = "PODS:\n  - a (1):\n    - b (~> 2)\n  - b (2)\nDEPENDENCIES:\n  - a\n"
BUN = '{"workspaces": {"": {"dependencies": {"a": "*"}}}, "packages": {"a": ["a@1", "", {"dependencies": {"b": "*"}}, "s"], "b": ["b@2", "", {}, "s"],}, } // end'
PUB = "packages:\n  a:\n    dependency: \"direct main\"\n    source: hosted\n    version: \"1\"\n"
MANIFEST = '<manifest><remote name="o" fetch="https://x/"/><default remote="o" revision="main"/><project name="a"/><project name="b" revision="2"/></manifest>'
NPM = '{"dependencies":{"a":{"version":"1","requires":{"b":"^2"},"dependencies":{"b":{"version":"2"}}},"c":{"version":"3","requires":{"b":"^9"}}},"packages":{"node_modules/a":{"peerDependencies":{"c":"*"}}}}'


def _counted(spark, rows, name):
    """``rows`` (file, content), and how often each was made."""
    made = spark.sparkContext.accumulator(0)

    def count(text):
        made.add(1)
        return text

    return spark.createDataFrame(rows, f"file string, {name} string").withColumn(name, F.udf(count).asNondeterministic()(name)), made


@pytest.mark.parametrize(("read", "text", "expected"), [
    (locks.pnpm_lock, PNPM, {("a", "1.0", True), ("b", "2.0", False)}),
    (locks.yarn_berry, BERRY, {("a", "1", True), ("b", "2", False)}),
    (locks.yarn_berry_edges, BERRY, {("f", "a@1", "b@2")}),
    (locks.podfile_lock, PODS, {("a", "1", True), ("b", "2", False)}),
    (locks.podfile_lock_edges, PODS, {("f", "a", "b")}),
    (locks.bun_lock, BUN, {("a", "1", True), ("b", "2", False)}),
    (locks.pubspec_lock, PUB, {("a", "1", True)}),
    (locks.repo_manifest, MANIFEST, {("https://x/a", "main", True), ("https://x/b", "2", True)}),
    (locks.npm_v1_edges, NPM, {("f", "a@1", "b@2"), ("f", "c@3", "b@^9"), ("f", "a@1", "c@3")}),
])
def test_a_file_is_made_once(spark, read, text, expected):
    files, made = _counted(spark, [("f", text)], "content")
    rows = read(files)
    rows = rows if "src" in rows.columns else rows.select("name", "version", "is_direct")
    assert {tuple(r) for r in rows.collect()} == expected
    assert made.value == 1


LOCK = '[[package]]\nname = "a"\nversion = "1"\n{}\n[[package]]\nname = "b"\nversion = "2"\n'


@pytest.mark.parametrize(("read", "lock", "project"), [
    (projects.pdm, LOCK.format('dependencies = ["b>=1"]'), '[project]\ndependencies = ["a"]\n'),
    (projects.poetry, LOCK.format('[package.dependencies]\nb = "*"') + '[metadata]\nlock-version = "2.0"\n', '[tool.poetry.dependencies]\na = "*"\n'),
    (projects.uv, '[[package]]\nname = "app"\nversion = "0"\nsource = { virtual = "." }\ndependencies = [{ name = "a" }]\n' + LOCK.format('dependencies = [{ name = "b" }]'), None),
])
def test_a_project_is_made_once(spark, read, lock, project):
    locks_, made = _counted(spark, [("f", lock)], "content")
    asked, asked_made = _counted(spark, [("f", project)], "content")
    rows = read(locks_) if project is None else read(locks_, asked)
    assert {(r.name, r.env, r.is_direct) for r in rows.collect()} == {("a", "production", True), ("b", "production", False)}
    assert made.value == 1 and asked_made.value == (project is not None)


def test_edges_are_made_once(spark):
    edges, made = _counted(spark, [(str(n), str(n + 1)) for n in range(6)], "dst")
    assert reach(edges.withColumnRenamed("file", "src"), spark.createDataFrame([("0",)], "node string")).count() == 7
    assert made.value == 6
