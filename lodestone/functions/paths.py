"""Paths, globs and path filters as columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A project whose path below the base folder holds one of these is not for production.
NON_PRODUCTION = (
    "dist-newstyle",
    "doc/",
    "docs/",
    "Documentation/",
    "documentation/",
    "test/",
    "tests/",
    "example/",
    "examples/",
    "vendor/",
    "node_modules/",
    ".venv/",
    ".srclib-cache/",
    "spec/",
    "Godeps/",
    ".git/",
    "bower_components/",
    "third_party/",
    "third-party/",
    "Carthage/",
    "Checkouts/",
)


def url_path(url: Column) -> Column:
    """The path of a URL without leading and trailing slashes, query and fragment; '' if there is none."""
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*/?([^?#]*?)/?([?#].*)?$", 1)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def ancestors(path: Column) -> Column:
    """Proper ancestors of a relative path, the shallowest first."""
    s = segments(path)
    n = F.size(s)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(s, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def ancestor_pairs(path: Column) -> Column:
    """Each ancestor with the next longer prefix: ``a/b/c`` gives (a, a/b) and (a/b, a/b/c)."""
    s = segments(path)
    n = F.size(s)
    cut = lambda i: F.array_join(F.slice(s, F.lit(1), i), "/")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(cut(i).alias("parent"), cut(i + 1).alias("child")))
    return F.when(n > 1, pairs)


def parent(path: Column) -> Column:
    """What is before the last slash, with it; '' without one."""
    return F.regexp_extract(path, r"^(.*/)", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def joined(folder: Column, relative: Column) -> Column:
    """``relative`` seen from ``folder``, without ``.``, ``..`` and doubled slashes; null if it is absolute or leaves the root."""
    whole = F.filter(F.split(F.concat(folder, F.lit("/"), relative), "/"), lambda s: (s != "") & (s != "."))
    none = F.array().cast("array<string>")
    up = lambda at: F.when(F.size(at) > 0, F.slice(at, F.lit(1), F.size(at) - 1))
    kept = F.aggregate(whole, none, lambda at, s: F.when(s == "..", up(at)).otherwise(F.when(at.isNotNull(), F.array_append(at, s))))
    return F.when(~F.startswith(relative, F.lit("/")), F.array_join(kept, "/"))


def glob_regex(glob: str) -> str:
    """An anchored pattern for a glob: ``*`` stays in a segment, ``**`` stands for any number of segments."""
    parts = [p for p in re.sub(r"/+", "/", glob.replace("\\", "/")).rstrip("/").split("/") if p != "."]
    out, slash = "", ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            if last:
                out += f"({slash}.*)?" if slash else ".*"
            else:
                out += f"{slash}(.*/)?"
                slash = ""
            continue
        out += slash + "[^/]*".join(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", x) for x in part.split("*"))
        slash = "/"
    return f"^{out}$"


def glob_pattern(glob: Column) -> Column:
    """As :func:`glob_regex`, for globs that stand in a column."""
    g = F.regexp_replace(F.regexp_replace(F.regexp_replace(glob, r"/+", "/"), r"(^|(?<=/))(\./)+", ""), r"(/\.)?/?$", "")
    g = F.regexp_replace(g, r"([^A-Za-z0-9_ /*])", r"\\$1")
    g = F.regexp_replace(F.regexp_replace(g, r"(^|(?<=/))\*\*/", "\x01"), r"(^|/)\*\*$", "\x02$1\x03")
    g = F.regexp_replace(g, r"\*+", "[^/]*")
    for mark, to in (("\x01", "(.*/)?"), ("\x02/\x03", "(/.*)?"), ("\x02\x03", ".*")):
        g = F.replace(g, F.lit(mark), F.lit(to))
    return F.concat(F.lit("^"), g, F.lit("$"))


def literal_prefix(glob: str) -> list[str]:
    """Segments of a glob before the first with a wildcard."""
    out = []
    for part in filter(None, glob.replace("\\", "/").split("/")):
        if "*" in part:
            break
        out.append(part)
    return out


def split_filters(filters: Iterable[str]) -> tuple[list[str], list[str]]:
    """Path filters told apart: (relative folders, globs)."""
    paths, globs = [], []
    for f in filters:
        (globs if "*" in f else paths).append(f.rstrip("/"))
    return paths, globs


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _matches(glob: str) -> Callable[[Column], Column]:
    return lambda path: F.rlike(path, F.lit(glob_regex(glob)))


def path_allowed(path: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Whether a walk may enter a folder: not excluded, and included or on the way to what is.

    ``include`` and ``exclude`` are few and given by the user, so they become part of the expression.
    """
    in_paths, in_globs = split_filters(include)
    ex_paths, ex_globs = split_filters(exclude)
    below = lambda p: (path == p) | F.startswith(path, F.lit(p + "/"))
    excluded = _any([*(below(p) for p in ex_paths), *(F.rlike(path, F.lit(glob_regex(g))) for g in ex_globs)])
    if not in_paths and not in_globs:
        return ~excluded
    tests = [below(p) for p in in_paths]
    tests += [F.startswith(F.lit(p + "/"), F.concat(path, F.lit("/"))) for p in in_paths]
    for g in in_globs:
        tests += [F.rlike(path, F.lit(glob_regex(g))), F.exists(ancestors(path), _matches(g))]
        prefix = literal_prefix(g)
        tests.append(F.startswith(F.lit("/".join(prefix) + "/"), F.concat(path, F.lit("/"))) if prefix else F.lit(True))
    return _any(tests) & ~excluded


def non_production(path: Column, base: str = "") -> Column:
    """Whether a path, without its base folder, holds one of the usual names of folders that do not ship."""
    rest = F.when(F.startswith(path, F.lit(base)), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)
    return _any([F.contains(rest, F.lit(x)) for x in NON_PRODUCTION])


def virtual_path(archive: Column, member: Column, marker: str = "!_virtual_!") -> Column:
    """The path of an archive's member: below the archive's path and a marker."""
    return F.concat(archive, F.lit(marker + "/"), member)


def flat_path(path: Column) -> Column:
    """A path as one file name."""
    return F.replace(path, F.lit("/"), F.lit("_"))


def resolve_link(target: Column, folder: Column) -> Column:
    """Where a symbolic link in ``folder`` leads: absolute from the root, else from the folder; ``..`` stops at the root."""
    whole = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat_ws("/", folder, target))
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.array_append(acc, s))
    return F.array_join(F.aggregate(segments(whole), F.array().cast("array<string>"), step), "/")
