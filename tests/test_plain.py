"""The quick readers of YAML and TOML give what the whole parsers give, or nothing."""

import random
import tomllib

import pytest
import yaml

from lodestone.functions.plain import plain_toml, plain_yaml

YAML = ["a: 1", "a:", "  b: x y", "  b:", "    c: 'it is'", "- a", "- a:", "  - a (1):", "    - b (~> 1)", "  - b: 2", "    d: \"q: #\"", '"x@^1, y@^2":', "  z: a#b", "  z: a #b", "# note", "", "  w: a: b", "    more", "a: [x]", "  t: |", "    text", "a: &x 1", "b: *x", "? k", "a: ''", "e: 'a''b'", 'e: "a\\n"', "u: é", "\tq: 1", "a:  2", "...", "---", "- - x", "-", "g:: 1", "/p@1(q@2): ~", "k: http://x/y", "<<: 1", "- 'q'", "  - \"r\""]
TOML = ["[[package]]", "[package.dependencies]", "[[package.files]]", "[metadata]", "[a.b]", "[a]", 'name = "x"', 'name = "y # z"', "n = 3", "n = 03", "on = true", 'list = ["a", "b"]', "list = [", ' "c",', "]", 'deps = [{ name = "x" }, { name = "y", v = "1" }]', "t = { a = \"1\", a = \"2\" }", 'source = { virtual = "." }', 'a.b = "1"', '"q r" = "1"', "x = 'l'", 'e = "a\\n"', "f = 1.5", "d = 2020-01-01", "# note", "", "[ a ]", "[[a.b]]", "[package]", 'u = "é"', "m = []", "m = [[1]]", 'c = "x" # tail', "package = []", "v = [\"a\" \"b\"]", "[source.x]"]


@pytest.mark.parametrize(("lines", "quick", "whole"), [(YAML, plain_yaml, lambda t: yaml.load(t, Loader=yaml.BaseLoader)), (TOML, plain_toml, tomllib.loads)])
def test_quick_readers_agree_with_the_whole_ones(lines, quick, whole):
    rng, read = random.Random(7), 0
    for n in range(12000):
        text = "\n".join(rng.choices(lines[: len(lines) if n % 2 else 14], k=rng.randint(1, 8)))
        found = quick(text)
        if found is not None:
            read += 1
            assert found == whole(text), text
    assert read > 500


def test_plain_locks_are_read_quickly():
    assert plain_yaml("packages:\n  /a@1:\n    dev: true\nimports:\n- name: x\n  version: 'y'\n- name: z\nnone:\n") == {"packages": {"/a@1": {"dev": "true"}}, "imports": [{"name": "x", "version": "y"}, {"name": "z"}], "none": ""}
    assert plain_toml('version = 1\n[[package]]\nname = "a"\nd = [\n "b",\n { name = "c" },\n]\n[package.source]\ngit = "u"\n') == {"version": 1, "package": [{"name": "a", "d": ["b", {"name": "c"}], "source": {"git": "u"}}]}
