"""Locators, version constraints and package names as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What has no glyph: controls, formats, surrogates, line and paragraph separators.
UNPRINTABLE = r"[\p{C}\p{Zl}\p{Zp}]"


def render(fetcher: Column, project: Column, revision: Column) -> Column:
    """``fetcher+project$revision``; a null revision leaves nothing after the $; unprintable characters go."""
    return F.regexp_replace(F.concat(fetcher, F.lit("+"), project, F.lit("$"), F.coalesce(revision, F.lit(""))), UNPRINTABLE, "")


def parse(locator: Column) -> Column:
    """A struct of fetcher, project and revision, cut at the first + and then the first $. An empty revision is null."""
    plus = F.instr(locator, "+")
    fetcher = F.when(plus > 0, F.substring(locator, F.lit(1), plus - 1)).otherwise(locator)
    rest = F.when(plus > 0, F.substring(locator, plus + 1, F.length(locator))).otherwise(F.lit(""))
    at = F.instr(rest, "$")
    project = F.when(at > 0, F.substring(rest, F.lit(1), at - 1)).otherwise(rest)
    revision = F.when(at > 0, F.substring(rest, at + 1, F.length(rest)))
    return F.struct(fetcher.alias("fetcher"), project.alias("project"), F.nullif(revision, F.lit("")).alias("revision"))


def constraint_revision(leaves: Column) -> Column:
    """The revision that a version constraint names, from its leaves (array of struct op, value) from left to right.

    Equal, compatible and ordered comparisons give their text, a URI or a negation none; of several the first counts.
    """
    good = F.filter(leaves, lambda x: x["op"].isin("EQUAL", "COMPATIBLE", "LESSTHAN", "LESSOREQUAL", "GREATERTHAN", "GREATEROREQUAL"))
    return F.get(good, F.lit(0))["value"]


def break_first(text: Column, mark: str) -> Column:
    """(before, after) the first ``mark``; all and '' without one."""
    at = F.instr(text, mark)
    return F.struct(
        F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("before"),
        F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).otherwise(F.lit("")).alias("after"),
    )


def break_last(text: Column, mark: str) -> Column:
    """(before, after) the last ``mark``; '' and all without one."""
    after = F.substring_index(text, mark, -1)
    has = F.instr(text, mark) > 0
    before = F.when(has, F.substring(text, F.lit(1), F.length(text) - F.length(after) - len(mark))).otherwise(F.lit(""))
    return F.struct(before.alias("before"), after.alias("after"))


def break_and_remove(text: Column, mark: str) -> Column:
    """(before, after) the first ``mark``, null without one."""
    return F.when(F.instr(text, mark) > 0, break_first(text, mark))


def drop_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def go_version(version: Column) -> Column:
    """A pseudo version gives its commit, a semantic version loses build metadata; '' and (devel) are null."""
    pseudo = F.regexp_extract(version, r"^v\d+\.\d+\.\d+-(?:.*\.)?(?:0\.)?\d{14}-([0-9a-f]{12})(?:\+.*)?$", 1)
    plain = F.regexp_extract(version, r"^(v\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?)(?:\+.*)?$", 1)
    return F.when(version.isin("", "(devel)"), None).when(pseudo != "", pseudo).when(plain != "", plain).otherwise(version)


def linux_package(name: Column, os: Column, os_version: Column, arch: Column, epoch: Column, version: Column, release: Column) -> Column:
    """Project and revision of an operating-system package: ``name#os#version`` and ``arch#[epoch:]version[-release]``."""
    project = F.concat_ws("#", name, os, os_version)
    revision = F.concat(arch, F.lit("#"), F.coalesce(F.concat(epoch, F.lit(":")), F.lit("")), version, F.coalesce(F.concat(F.lit("-"), release), F.lit("")))
    return F.struct(project.alias("project"), revision.alias("revision"))


def pip_constraints(spec: Column) -> Column:
    """The constraints of a pip requirement as an array of (op, value), in their order."""
    names = F.create_map(*[F.lit(x) for x in ("~=", "COMPATIBLE", "==", "EQUAL", "===", "EQUAL", "!=", "NOT", "<=", "LESSOREQUAL", ">=", "GREATEROREQUAL", "<", "LESSTHAN", ">", "GREATERTHAN")])
    parts = F.filter(F.transform(F.split(spec, ","), lambda s: F.trim(s)), lambda s: F.rlike(s, F.lit(r"^(~=|===?|!=|<=|>=|<|>)")))
    op = lambda s: F.regexp_extract(s, r"^(~=|===?|!=|<=|>=|<|>)", 1)
    return F.transform(parts, lambda s: F.struct(F.try_element_at(names, op(s)).alias("op"), F.trim(F.regexp_replace(s, r"^(~=|===?|!=|<=|>=|<|>)", "")).alias("value")))


def rpm_requirement(line: Column) -> Column:
    """(name, op, value) of a Requires entry; a name with a macro is null, an entry without a version has no op."""
    name = F.regexp_extract(line, r"^\s*(\S+)", 1)
    op = F.regexp_extract(line, r"^\s*\S+\s+(<=|>=|==|=|<|>)\s*\S+", 1)
    value = F.regexp_extract(line, r"^\s*\S+\s+(?:<=|>=|==|=|<|>)\s*(\S+)", 1)
    return F.when(~F.contains(name, F.lit("%{")) & (name != ""), F.struct(name.alias("name"), F.nullif(op, F.lit("")).alias("op"), F.nullif(value, F.lit("")).alias("value")))


def without_peer_suffix(version: Column) -> Column:
    """A locked version without what follows an underscore or a parenthesis."""
    return F.regexp_extract(version, r"^([^_(]*)", 1)


def framework_name(name: Column) -> Column:
    """A target framework as letters and digits: separators go, and zeros at the end of its version."""
    low = F.regexp_replace(F.lower(name), r"[\s,=.]|version|v(?=\d)", "")
    return F.regexp_replace(low, r"(\d)0+$", "$1")


def clojure_name(name: Column) -> Column:
    """group:artifact of a Clojure dependency; a name without a group is its own."""
    colons = F.replace(name, F.lit("/"), F.lit(":"))
    return F.when(F.contains(colons, F.lit(":")), colons).otherwise(F.concat(colons, F.lit(":"), colons))


def cargo_package(package_id: Column) -> Column:
    """(name, version, source) of a package id in the old form ``name version (source)`` or the new ``source#name@version``."""
    old = r"^(\S+) (\S+) \(([^)]*)\)$"
    new = r"^(.*)#(?:([^@]+)@)?([^@]+)$"
    is_old = F.rlike(package_id, F.lit(old))
    source = F.regexp_extract(package_id, new, 1)
    name = F.coalesce(F.nullif(F.regexp_extract(package_id, new, 2), F.lit("")), F.substring_index(F.regexp_replace(source, r"\?.*$", ""), "/", -1))
    part = lambda i, other: F.when(is_old, F.regexp_extract(package_id, old, i)).otherwise(other)
    return F.struct(part(1, name).alias("name"), part(2, F.regexp_extract(package_id, new, 3)).alias("version"), part(3, source).alias("source"))


def settings_version(version: Column, package_id: Column, settings: Column) -> Column:
    """A version with a query of the package id and the settings (map), by name and URL-encoded."""
    pairs = F.transform(F.array_sort(F.map_entries(settings)), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"])))
    query = F.array_join(F.concat(F.filter(F.array(F.concat(F.lit("package_id="), package_id)), lambda x: x.isNotNull()), pairs), "&")
    return F.when(query == "", version).otherwise(F.concat(version, F.lit("?"), query))


def canonical_name(name: Column) -> Column:
    """A Python project name with dashes and in lower case."""
    return F.lower(F.regexp_replace(name, r"[._]", "-"))


def key_value(line: Column) -> Column:
    """(key, value) of ``key: value``, trimmed; null if either is empty."""
    at = F.instr(line, ":")
    k, v = F.trim(F.substring(line, F.lit(1), at - 1)), F.trim(F.substring(line, at + 1, F.length(line)))
    return F.when((at > 0) & (k != "") & (v != ""), F.struct(k.alias("key"), v.alias("value")))


def locator_fits(url: Column, version: Column, organisation: int, most: int = 255) -> Column:
    """Whether the locator of a remote dependency is short enough."""
    return F.char_length(F.concat(F.lit(f"url-private+{organisation}/"), url, F.lit("$"), version)) <= most


def publishable(environments: Column) -> Column:
    """Whether a dependency is reported: no environment, production, or one of the user's own."""
    return (F.size(environments) == 0) | F.array_contains(environments, "production") | F.exists(environments, lambda e: F.startswith(e, F.lit("other:")))


def supported(kind: Column) -> Column:
    """Whether units may hold a dependency of this type."""
    return ~kind.isin("subproject", "googlesource", "conan", "unresolved path")
