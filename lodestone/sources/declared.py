"""The file in which a user declares dependencies by hand, as YAML or JSON.

Every entry is judged by itself: one that is wrong becomes a problem row that says why, the others of its file stay.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.dependencies import FETCHERS
from lodestone.functions.locators import parse, render
from lodestone.plans.scratch import materialise
from lodestone.sources.locks import yaml_json

LISTS = ("referenced-dependencies", "custom-dependencies", "vendored-dependencies", "remote-dependencies", "locator-dependencies", "fork-aliases")
# The types that a user may name, with the package types that they stand for, and the systems of Linux packages.
TYPES = {k: k for k in ("bower", "cargo", "carthage", "composer", "cpan", "cran", "gem", "git", "go", "hackage", "hex", "maven", "nuget", "url", "swift", "apk", "deb", "rpm-generic")} | {"npm": "nodejs", "pypi": "pip", "cocoapods": "pod"}
SYSTEMS = ("alpine", "centos", "debian", "redhat", "ubuntu", "oraclelinux", "busybox", "sles", "fedora", "rocky")
LINUX = ("apk", "deb", "rpm-generic")
SCOPES = ("org", "project", "revision")
_MAP = "map<string,string>"


class Declared(NamedTuple):
    """``imports``: (file, list, at, fetcher, project, revision). ``custom``: (file, at, name, version, license, description,
    homepage). ``remote``: (file, at, name, version, url, description, homepage). ``aliases``: as joins.translate takes them, with
    file. ``labels``: (file, locator, label, scope). ``problems``: (file, list, at, problem), without list for a whole file.
    """

    imports: DataFrame
    custom: DataFrame
    remote: DataFrame
    aliases: DataFrame
    labels: DataFrame
    problems: DataFrame


def _fetcher(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in TYPES.items() for x in (k, FETCHERS[v])]), kind)


def _first(*tests: tuple[Column, Column | str]) -> Column:
    out = F.lit(None).cast("string")
    for test, why in reversed(tests):
        out = F.when(F.coalesce(test, F.lit(False)), why if isinstance(why, Column) else F.lit(why)).otherwise(out)
    return out


def _field(m: str, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _lacks(*keys: str) -> list[tuple[Column, str]]:
    return [(F.coalesce(F.trim(_field("m", k)), F.lit("")) == "", f"{k} is required") for k in keys]


def _forbids(*keys: str, when: Column | None = None) -> list[tuple[Column, str]]:
    return [(F.map_contains_key("m", k) if when is None else when & F.map_contains_key("m", k), f"{k} is not allowed here") for k in keys]


def declared(files: DataFrame) -> Declared:
    """What ``files`` (file, content) declare. An empty file declares nothing; one that is no mapping, or of another version than 1, is a problem."""
    schema = "version string, " + ", ".join(f"`{x}` array<string>" for x in LISTS)
    text = files.select("file", "content", yaml_json(F.col("content")).alias("t"))
    empty = F.trim("content") == ""
    whole = _first((F.col("t").isNull() & ~empty, "no YAML or JSON"), (~F.startswith("t", F.lit("{")) & ~F.col("t").isin('""', '"~"', '"null"', "null") & ~empty, "no mapping"))
    j = text.select("file", F.from_json("t", schema).alias("j"), whole.alias("problem"))
    j = materialise(j.select("file", "j", F.coalesce("problem", _first((F.coalesce("j.version", F.lit("1")) != "1", F.concat(F.lit("version is "), "j.version")))).alias("problem")), "declared")
    each = None
    for name in LISTS:
        part = j.where("problem IS NULL").select("file", F.lit(name).alias("list"), F.posexplode(F.col("j")[name]).alias("at", "e"))
        each = part if each is None else each.unionByName(part)
    nested = lambda c: F.from_json(c, _MAP)
    object_ = F.startswith("e", F.lit("{"))
    each = each.withColumn("m", F.when(object_, nested(F.col("e")))).withColumns({"fork": nested(_field("m", "fork")), "base": nested(_field("m", "base")), "metadata": nested(_field("m", "metadata"))})
    kind, linux = _field("m", "type"), _field("m", "type").isin(*LINUX)
    is_ = lambda *names: F.col("list").isin(*names)
    unknown = lambda m: [(F.coalesce(_field(m, "type"), F.lit("")) == "", "type is required"), (_fetcher(_field(m, "type")).isNull(), F.concat(F.lit("dep type: "), _field(m, "type"), F.lit(" not supported"))), (F.coalesce(F.trim(_field(m, "name")), F.lit("")) == "", "name is required")]
    system = _field("m", "os")
    referenced = _first(
        *unknown("m"), *[(linux & t, why) for t, why in _lacks("arch", "os", "osVersion")], (linux & ~F.lower(system).isin(*SYSTEMS), F.concat(F.lit("os is not supported: "), F.lower(system))),
        *_forbids("license", "description", "url", "path"), *_forbids("os", "osVersion", "arch", when=~linux), *_forbids("epoch", when=kind != "rpm-generic"),
    )
    problem = (
        F.when(~object_ & ~is_("locator-dependencies"), "no mapping")
        .when(is_("referenced-dependencies"), referenced)
        .when(is_("custom-dependencies"), _first(*_lacks("name", "version", "license"), *_forbids("type", "path", "url")))
        .when(is_("vendored-dependencies"), _first(*_lacks("name", "path"), *_forbids("type", "license", "url", "description")))
        .when(is_("remote-dependencies"), _first(*_lacks("name", "version", "url"), *_forbids("license", "path", "type")))
        .when(is_("locator-dependencies"), F.when(object_, _first(*_lacks("locator"))))
        .otherwise(_first((F.col("fork").isNull(), "fork is required"), (F.col("base").isNull(), "base is required"), *unknown("fork"), *unknown("base")))
    )
    each = materialise(each.withColumn("problem", problem), "declared-entries")
    good = each.where("problem IS NULL")

    package = F.concat_ws("#", _field("m", "name"), system, _field("m", "osVersion"))
    epoch = F.when(_field("m", "epoch").isNotNull(), F.concat(_field("m", "epoch"), F.lit(":"))).otherwise("")
    revision = F.when(linux, F.concat(_field("m", "arch"), F.lit("#"), epoch, F.coalesce(_field("m", "version"), F.lit("")))).otherwise(_field("m", "version"))
    named = parse(F.when(object_, _field("m", "locator")).otherwise(F.col("e")))
    locator = lambda f, p, r: F.struct(f.alias("fetcher"), p.alias("project"), r.alias("revision"))
    at = (
        F.when(is_("referenced-dependencies"), locator(_fetcher(kind), F.when(linux, package).otherwise(_field("m", "name")), revision))
        .when(is_("vendored-dependencies"), locator(F.lit("archive"), _field("m", "name"), F.coalesce(_field("m", "version"), F.lit(""))))
        .when(is_("locator-dependencies"), locator(named["fetcher"], named["project"], named["revision"]))
        .when(is_("custom-dependencies"), locator(F.lit("user"), _field("m", "name"), _field("m", "version")))
        .when(is_("remote-dependencies"), locator(F.lit("url-private"), _field("m", "url"), _field("m", "version")))
    )
    good = good.withColumn("l", at)
    imports = good.where(is_("referenced-dependencies", "vendored-dependencies", "locator-dependencies")).select("file", "list", "at", "l.*")
    about = [_field("metadata", k).alias(k) for k in ("description", "homepage")]
    plain = lambda *keys: [_field("m", k).alias(k) for k in keys]
    custom = good.where(is_("custom-dependencies")).select("file", "at", *plain("name", "version", "license"), *about)
    remote = good.where(is_("remote-dependencies")).select("file", "at", *plain("name", "version", "url"), *about)
    side = lambda m, prefix: [_fetcher(_field(m, "type")).alias(f"{prefix}fetcher"), _field(m, "name").alias(f"{prefix}project"), _field(m, "version").alias(f"{prefix}version")]
    aliases = good.where(is_("fork-aliases")).select("file", *side("fork", ""), *side("base", "base_"), F.col("at").alias("ord"))
    label = F.explode(F.from_json(_field("m", "labels"), "array<struct<label:string,scope:string>>"))
    labels = good.where(F.col("l").isNotNull() & F.map_contains_key("m", "labels")).select("file", render(F.col("l.fetcher"), F.col("l.project"), F.col("l.revision")).alias("locator"), label.alias("x"))
    labels = labels.select("file", "locator", "x.label", F.when(F.col("x.scope").isin(*SCOPES), F.col("x.scope")).otherwise("revision").alias("scope")).where("label IS NOT NULL")
    lost = j.where("problem IS NOT NULL").select("file", F.lit(None).cast("string").alias("list"), F.lit(None).cast("int").alias("at"), "problem")
    return Declared(imports, custom, remote, aliases, labels, lost.unionByName(each.where("problem IS NOT NULL").select("file", "list", "at", "problem")))
