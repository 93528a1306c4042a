"""Dependencies that a user declares, written by hand."""

from __future__ import annotations

import json

import pytest

from lodestone.sources import declared

WHOLE = """
version: 1
referenced-dependencies:
- {type: gem, name: rubyXL, version: 1.10}
- {type: pypi, name: flask}
- {type: apk, name: curl, version: 7.0, arch: x86_64, os: alpine, osVersion: 3.18}
- {type: rpm-generic, name: bash, version: 4.4, epoch: 2, arch: x86_64, os: CentOS, osVersion: 8, labels: [{label: os, scope: org}, {label: x}]}
- {type: deb, name: none, os: debian, osVersion: 11}
- {type: notatype, name: a}
- {type: gem, name: a, license: MIT}
- {type: gem, name: a, os: alpine}
- {type: deb, name: a, arch: x, os: plan9, osVersion: 1}
- {type: gem, name: a, epoch: 1}
- {type: gem}
- just text
custom-dependencies:
- {name: hello, version: 1.2.3, license: "MIT or GPL", metadata: {description: for x, homepage: http://h}, labels: [{label: internal, scope: project}]}
- {name: foo, version: foo again, license: LGPL, url: no}
- {name: "", version: 1, license: MIT}
vendored-dependencies:
- {name: v, path: vendor/v.zip, version: 2}
- {name: w, path: w}
- {name: nopath}
remote-dependencies:
- {name: url-dep, version: 1.2.3, url: http://u, metadata: {description: d}}
- {name: bad, version: 1, url: u, license: MIT}
locator-dependencies:
- git+https://github.com/a/b$v1
- locator: npm+left-pad$1.0
  labels: [{label: l, scope: revision}]
- {labels: []}
fork-aliases:
- {fork: {type: cargo, name: my-fork, version: 1}, base: {type: cargo, name: base}}
- {fork: {type: npm, name: f}, base: {type: npm, name: b, version: 2}, labels: []}
- {fork: {type: npm, name: f}}
- {fork: {type: what, name: f}, base: {type: npm, name: b}}
"""


@pytest.fixture(scope="module")
def found(spark):
    texts = {"f": WHOLE, "empty": "", "null": "~", "two": "version: 2\nlocator-dependencies: [a+b]", "list": "- a", "broken": "a: [", "json": json.dumps({"referenced-dependencies": [{"type": "npm", "name": "x", "version": "1.0"}]})}
    return declared.declared(spark.createDataFrame(list(texts.items()), "file string, content string"))


def rows(table, *drop):
    return sorted((tuple(r) for r in table.drop(*drop).collect()), key=repr)


def test_imports(found):
    assert rows(found.imports, "list", "at") == sorted([
        ("f", "gem", "rubyXL", "1.10"), ("f", "pip", "flask", None), ("f", "apk", "curl#alpine#3.18", "x86_64#7.0"), ("f", "rpm-generic", "bash#CentOS#8", "x86_64#2:4.4"), ("f", "archive", "v", "2"), ("f", "archive", "w", ""),
        ("f", "git", "https://github.com/a/b", "v1"), ("f", "npm", "left-pad", "1.0"), ("json", "npm", "x", "1.0"),
    ], key=repr)


def test_custom_remote_aliases_and_labels(found):
    assert rows(found.custom, "at") == [("f", "hello", "1.2.3", "MIT or GPL", "for x", "http://h")]
    assert rows(found.remote, "at") == [("f", "url-dep", "1.2.3", "http://u", "d", None)]
    assert rows(found.aliases, "ord") == [("f", "cargo", "my-fork", "1", "cargo", "base", None), ("f", "npm", "f", None, "npm", "b", "2")]
    assert rows(found.labels) == [("f", "npm+left-pad$1.0", "l", "revision"), ("f", "rpm-generic+bash#CentOS#8$x86_64#2:4.4", "os", "org"), ("f", "rpm-generic+bash#CentOS#8$x86_64#2:4.4", "x", "revision"), ("f", "user+hello$1.2.3", "internal", "project")]


def test_problems(found):
    got = {(r.file, r.list and r.list.split("-")[0], r.at): r.problem for r in found.problems.collect()}
    assert {k: v for k, v in got.items() if k[0] != "f"} == {("two", None, None): "version is 2", ("list", None, None): "no mapping", ("broken", None, None): "no YAML or JSON"}
    assert {k[1:]: v for k, v in got.items() if k[0] == "f"} == {
        ("referenced", 4): "arch is required", ("referenced", 5): "dep type: notatype not supported", ("referenced", 6): "license is not allowed here", ("referenced", 7): "os is not allowed here", ("referenced", 8): "os is not supported: plan9", ("referenced", 9): "epoch is not allowed here",
        ("referenced", 10): "name is required", ("referenced", 11): "no mapping", ("custom", 1): "url is not allowed here", ("custom", 2): "name is required", ("vendored", 2): "path is required", ("remote", 1): "license is not allowed here", ("locator", 2): "locator is required",
        ("fork", 2): "base is required", ("fork", 3): "dep type: what not supported",
    }
