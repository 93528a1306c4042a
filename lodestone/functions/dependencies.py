"""Dependencies as locators: package types, fetchers and projects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.locators import constraint_revision

# The fetcher that a locator names for each type of package.
FETCHERS: dict[str, str] = {
    "archive": "archive", "bower": "bower", "carthage": "cart", "cargo": "cargo", "composer": "comp", "conan": "conan",
    "conda": "conda", "cpan": "cpan", "cran": "cran", "custom": "custom", "gem": "gem", "git": "git", "googlesource": "git",
    "go": "go", "hackage": "hackage", "hex": "hex", "apk": "apk", "deb": "deb", "rpm-generic": "rpm-generic", "maven": "mvn",
    "nodejs": "npm", "nuget": "nuget", "pip": "pip", "pod": "pod", "rpm": "rpm", "subproject": "mvn", "url": "url",
    "user": "user", "pub": "pub", "swift": "swift", "unresolved-path": "upath", "path": "path",
}
#: Types that a fetcher does not lead back to: it is shared or has no type of its own.
ONE_WAY = frozenset(["googlesource", "subproject", "conan", "swift", "unresolved-path"])


def _look_up(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def fetcher_of(kind: Column) -> Column:
    """The fetcher of a package type; null for an unknown one."""
    return _look_up(FETCHERS, kind)


def type_of(fetcher: Column) -> Column:
    """The package type of a fetcher; null where it says none."""
    return _look_up({f: t for t, f in FETCHERS.items() if t not in ONE_WAY}, fetcher)


def dependency_locator(kind: Column, name: Column, leaves: Column) -> Column:
    """The locator (fetcher, project, revision) of a dependency whose version constraint has ``leaves`` (op, value)."""
    return F.struct(fetcher_of(kind).alias("fetcher"), name.alias("project"), constraint_revision(leaves).alias("revision"))


def project_id(fetcher: Column, project: Column) -> Column:
    """A locator's text without revision."""
    return F.concat(fetcher, F.lit("+"), project)


def interpolate(text: Column, props: Column) -> Column:
    """``text`` with every ``${name}`` filled in from the map ``props``, again where a value holds names of its own.

    The first name is filled in, then the first of what that gives, and so on. A name that is not there becomes a note
    that says so. A name that was filled in since the last note becomes bare and ends the filling. That leaves a bound of
    (names + 1) times (marks + 1) fillings; beyond it names lead to each other in a circle, and what is left becomes bare.
    """
    mark = r"\$\{([^}]*)\}"
    marks = lambda c: F.size(F.regexp_extract_all(c, F.lit(mark), F.lit(0)))
    most = (1 + F.size(props)) * (1 + marks(text) + F.aggregate(F.map_values(props), F.lit(0), lambda n, v: n + F.coalesce(marks(v), F.lit(0))))

    def fill(acc: Column, _: Column) -> Column:
        at, seen = acc["text"], acc["seen"]
        before, after = F.substring_index(at, "${", 1), F.substring(at, F.instr(at, "${") + 2, F.length(at))
        name, rest = F.substring_index(after, "}", 1), F.substring(after, F.instr(after, "}") + 1, F.length(after))
        value = F.try_element_at(props, name)
        none = F.array().cast("array<string>")
        state = lambda t, s, done: F.struct(t.alias("text"), s.alias("seen"), F.lit(done).alias("done"))
        return (
            F.when(acc["done"] | ~F.rlike(at, F.lit(mark)), acc)
            .when(F.array_contains(seen, name), state(F.concat(before, name, rest), seen, True))
            .when(value.isNull(), state(F.concat(before, F.lit("PROPERTY NOT FOUND: "), name, rest), none, False))
            .otherwise(state(F.concat(before, value, rest), F.array_append(seen, name), False))
        )

    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("seen"), F.lit(False).alias("done"))
    end = F.aggregate(F.sequence(F.lit(1), most), start, fill)
    filled = F.when(end["done"], end["text"]).otherwise(F.regexp_replace(end["text"], mark, "$1"))
    return F.when(F.rlike(text, F.lit(mark)), filled).otherwise(text)


def bare_version(version: Column) -> Column:
    """A lock file's version without what follows the first underscore or parenthesis."""
    return F.regexp_extract(version, r"^([^_(]*)", 1)


def catalog_name(version: Column) -> Column:
    """The catalog that ``catalog:name`` asks for, ``default`` without a name; null for other versions."""
    name = F.trim(F.regexp_extract(version, r"^catalog:(.*)$", 1))
    return F.when(F.startswith(version, F.lit("catalog:")), F.coalesce(F.nullif(name, F.lit("")), F.lit("default")))


def marker_tags(marker: Column) -> Column:
    """(tag, value) of each comparison of an environment marker; operators are ignored but for ``not in``."""
    parts = F.regexp_extract_all(marker, F.lit(r"""([A-Za-z_]+\s*(?:===|==|~=|!=|<=|>=|<|>|not\s+in|in)\s*(?:'[^']*'|"[^"]*"))"""), F.lit(1))

    def one(part: Column) -> Column:
        value = F.regexp_extract(part, r"""['"]([^'"]*)['"]$""", 1)
        negated = F.rlike(part, F.lit(r"\snot\s+in\s"))
        return F.struct(F.regexp_extract(part, r"^([A-Za-z_]+)", 1).alias("tag"), F.when(negated, F.concat(F.lit("not ("), value, F.lit(")"))).otherwise(value).alias("value"))

    return F.transform(parts, one)
