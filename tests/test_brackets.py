"""Bracketed sources, written by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import brackets
from lodestone.sources.locks import pip_show

SETUP = """from setuptools import setup  # name = "no"
setup(
    author='x [ y', name = 'My-Pkg',
    packages=find_packages(where=["a", "b"]),
    install_requires = [  # install_requires = [
        "pkgOne>=1.0.0, <2.0.0",  # one ]
        'pkgTwo', \\
        "pkgThree @ https://example.com ; python_version < '3.8'",
        "pkg_four[extra, more] (== 1.*)",
    ],
    extras_require={"test": ["pytest"]},
)
"""
CFG = """[metadata]
name = cfg-name
[options]
install_requires =
    importlib-metadata; python_version<"3.8"
    # platformdirs>=2

    configupdater>=3.0  # some comment
    colorama ~= 0.4.4
python_requires = >=3
"""


def table(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "file string, content string")


def test_setup_py(spark):
    bad = {
        "a": 'setup(install_requires=["a" "b"])', "b": "setup(install_requires=reqs)", "c": 'setup(name=NAME, install_requires=["a b c"])', "d": 'setup(install_requires=["a"', "e": 'setup(install_requires=["a", *more])',
    }
    names, reqs = brackets.setup_py(table(spark, f=SETUP, empty="", none="setup(install_requires=[])", one="setup(install_requires=['x',], name='y')", **bad))
    assert {tuple(r) for r in names.collect()} == {("f", "My-Pkg"), ("one", "y")}
    got = {(r.file, r.req.name): (r.req.version, r.req.marker) for r in reqs.collect()}
    assert got == {
        ("f", "pkgOne"): (">=1.0.0,<2.0.0", None), ("f", "pkgTwo"): (None, None), ("f", "pkgThree"): ("https://example.com", "python_version < '3.8'"), ("f", "pkg_four"): ("==1.*", None), ("one", "x"): (None, None),
    }


def test_setup_cfg(spark):
    names, reqs = brackets.setup_cfg(table(spark, f=CFG, bad="install_requires =\n  a\n  not good\n", same="install_requires = a\n"))
    assert {tuple(r) for r in names.collect()} == {("f", "cfg-name")}
    assert {(r.file, r.req.name, r.req.version, r.req.marker) for r in reqs.collect()} == {("f", "importlib-metadata", None, 'python_version<"3.8"'), ("f", "configupdater", ">=3.0", None), ("f", "colorama", "~=0.4.4", None)}


SHOW = """Name: my-pkg
Version: 9
Requires: PkgOne, absent
---
Name: pkgone
Version: 1.5
Requires: deep
---
Name: deep
Version: 2
Requires: pkgone
---
Name: alone
Version: 3
Requires:
"""


def test_setup_with_what_is_installed(spark):
    parts = [brackets.setup_py(table(spark, f=SETUP, g=SETUP.replace("My-Pkg", "other"))), brackets.setup_cfg(table(spark, f=CFG))]
    rows, edges = brackets.setup(parts, pip_show(table(spark, f=SHOW, g=SHOW)))
    got = {(r.file, r.name): (r.version, r.is_direct) for r in rows.collect()}
    cfg = {("f", "importlib-metadata"): (None, True), ("f", "configupdater"): (">=3.0", True), ("f", "colorama"): ("~=0.4.4", True)}
    assert {k: v for k, v in got.items() if k[0] == "f"} == cfg | {("f", "pkgone"): ("==1.5", True), ("f", "deep"): ("==2", False)}
    assert {k[1] for k in got if k[0] == "g"} == {"pkgOne", "pkgTwo", "pkgThree", "pkg_four"}
    assert {tuple(r) for r in edges.collect()} == {("f", "pkgone", "deep"), ("f", "deep", "pkgone")}
    rows, edges = brackets.setup(parts)
    assert rows.count() == 4 + 4 + 3 and edges.count() == 0


LEIN = """{[clojure-complete "0.2.5" :exclusions [[org.clojure/clojure]]] nil, ; a } comment
 [koan-engine "0.2.5"] {[fresh "1.0.2"] nil},
 [lein-koan "0.1.5" :scope "test"] nil,
 [a/q "1 \\" ]" :extension "pom" :scope "provided"] nil
 [org.clojure/clojure "1.10.0"]
 {[org.clojure/core.specs.alpha "0.2.44"] nil,
  [org.clojure/spec.alpha "0.2.176"] {[fresh "1.0.2" :scope "runtime"] nil}}}"""


def test_lein(spark):
    rows, edges = brackets.lein_tree(table(spark, f=LEIN, bad="{[a \"1\"] nil", wrong='{[a "1") nil}', empty="{}", text="Error"))
    assert {tuple(r) for r in rows.collect()} == {
        ("f", "clojure-complete:clojure-complete", "0.2.5", None, True), ("f", "koan-engine:koan-engine", "0.2.5", None, True), ("f", "fresh:fresh", "1.0.2", "runtime", False), ("f", "lein-koan:lein-koan", "0.1.5", "testing", True), ("f", "a:q", '1 \\" ]', "provided", True),
        ("f", "org.clojure:clojure", "1.10.0", None, True), ("f", "org.clojure:core.specs.alpha", "0.2.44", None, False), ("f", "org.clojure:spec.alpha", "0.2.176", None, False),
    }
    assert {(r.src.name.split(":")[1], r.dst.name.split(":")[1]) for r in edges.collect()} == {("koan-engine", "fresh"), ("clojure", "core.specs.alpha"), ("clojure", "spec.alpha"), ("spec.alpha", "fresh")}


@pytest.mark.parametrize("seed", range(2))
def test_nesting_by_a_stack(spark, seed):
    rng, texts = random.Random(seed), {}
    for f in range(30):
        text, stack = "", []
        for _ in range(rng.randrange(60)):
            c = rng.choice("([{ab,}])" if rng.random() < 0.03 else ("([{aab" if len(stack) < 3 else "ab)"))
            if c == ")" and stack:
                c = {"(": ")", "[": "]", "{": "}"}[stack.pop()]
            elif c in "([{":
                stack.append(c)
            text += c + " "
        texts[f"f{f}"] = text + "".join({"(": ")", "[": "]", "{": "}"}[c] for c in reversed(stack))
    want = set()
    for f, text in texts.items():
        stack, rows, good, count = [], set(), True, {}
        for at, c in enumerate([x for x in text if x in "([{}])ab"]):
            if c in ")]}":
                good = good and bool(stack) and stack.pop()[1] + c in ("()", "[]", "{}")
                continue
            inside = stack[-1][0] if stack else None
            count[inside] = count.get(inside, 0) + 1
            rows.add((f, at, c, len(stack), inside, count[inside]))
            if c in "([{":
                stack.append((at, c))
        if good and not stack:
            want |= rows
    got = brackets.nested(brackets.tokens(table(spark, **texts), brackets.EDN, ";"))
    assert {tuple(r) for r in got.select("file", "at", "text", F.col("depth").cast("int"), "inside", "nth").collect()} == want
    assert len({w[0] for w in want}) > 5
