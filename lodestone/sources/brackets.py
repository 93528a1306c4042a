"""Sources made of nested brackets: tokens with the bracket that they stand in, for setup.py and Leiningen's trees.

A text becomes its tokens by one pattern, so that brackets in strings and comments do not count. The depth of a token
is a running sum of what opens and closes before it, and its bracket is the last one that opened at the depth above:
one window over (file, level) finds it for all tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.closure import reach
from lodestone.plans.scratch import materialise
from lodestone.sources.manifests import _rows

EDN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|;[^\n]*+|#\{|[(){}\[\]]|[^\s,;"(){}\[\]]++'
PYTHON = r"""#[^\n]*+|"[^"\n]*+"|'[^'\n]*+'|[(){}\[\]]|[\p{L}_][\p{L}\p{N}_]*+|\p{N}++|==|[^\s\\]"""


def tokens(files: DataFrame, pattern: str, comment: str) -> DataFrame:
    """(file, at, text): the tokens of each content, without those that begin with ``comment``."""
    found = files.select("file", F.posexplode(F.regexp_extract_all("content", F.lit(f"({pattern})"), F.lit(1))).alias("at", "text"))
    return found.where(~F.startswith("text", F.lit(comment)))


def nested(found: DataFrame) -> DataFrame:
    """(file, at, text, depth, inside, nth): tokens but for closing brackets, the ``at`` of the bracket that they stand in and their place there.

    An opening bracket stands for all that it holds. Files whose brackets do not match are left out.
    """
    opens, closes = F.col("text").isin("(", "[", "{", "#{"), F.col("text").isin(")", "]", "}")
    one = F.when(opens, 1).when(closes, -1).otherwise(0)
    here = Window.partitionBy("file").orderBy("at")
    rows = found.select("file", "at", "text", opens.alias("_open"), closes.alias("_close"), F.sum(one).over(here).alias("_sum"))
    rows = rows.withColumn("depth", F.when(F.col("_open"), F.col("_sum") - 1).otherwise(F.col("_sum")))
    level = lambda d, own: rows.select("*", d.alias("_level"), own.alias("_own"))
    both = level(F.col("depth"), F.lit(True)).where("_open").unionByName(level(F.when(F.col("_close"), F.col("depth")).otherwise(F.col("depth") - 1), F.lit(False)))
    last = F.last(F.when(F.col("_own"), F.struct("at", "text")), ignorenulls=True).over(Window.partitionBy("file", "_level").orderBy("at", F.col("_own").desc()))
    rows = both.withColumn("_in", last).where("NOT _own")
    # A bracket must close the one that it stands in.
    fits = F.concat("_in.text", "text").isin("()", "[]", "{}", "#{}")
    wrong = (F.col("_close") & ~F.coalesce(fits, F.lit(False))) | (F.col("_sum") < 0)
    bad = rows.groupBy("file").agg(F.bool_or(wrong).alias("wrong"), F.max_by("_sum", "at").alias("end")).where("wrong OR end <> 0")
    rows = rows.where("NOT _close").select("file", "at", "text", "depth", F.when(F.col("depth") > 0, F.col("_in.at")).alias("inside"))
    nth = F.row_number().over(Window.partitionBy("file", "inside").orderBy("at"))
    return rows.join(bad, "file", "left_anti").withColumn("nth", nth)


def _bare(text: Column) -> Column:
    return F.substring(text, F.lit(2), F.length(text) - 2)


# setup.py and setup.cfg

_COMPARED = r"(?:~=|<=|>=|!=|===|==|<|>)\s*[\p{L}\p{N}_.*+!-]+"
_REQUIREMENT = rf"^\s*([\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}._-]*[\p{{L}}\p{{N}}])?)\s*(?:\[[^\]]*\])?\s*(?:@\s*([^\s;]+)|(\(?)\s*((?:{_COMPARED}(?:\s*,\s*{_COMPARED})*)?)\s*(\)?))\s*(?:;\s*(\S.*?))?\s*$"


def requirement(text: Column) -> Column:
    """A struct of name, version (comparisons, or an address) and marker of one requirement; null for another text."""
    part = lambda i: F.nullif(F.regexp_extract(text, _REQUIREMENT, i), F.lit(""))
    fits = F.rlike(text, F.lit(_REQUIREMENT)) & (part(3).isNull() == part(5).isNull())
    return F.when(fits, F.struct(part(1).alias("name"), F.coalesce(part(2), F.regexp_replace(part(4), r"\s+", "")).alias("version"), part(6).alias("marker")))


def setup_py(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, name) of packages and (file, req) of what they require, as :func:`requirement` reads it, from setup.py.

    The first `name = "..."` and the first `install_requires = [...]` count, wherever they stand. A list that holds
    anything but requirements in quotes, parted by commas, gives none; so does a file whose brackets do not match.
    """
    rows = nested(tokens(files, PYTHON, "#"))
    order = Window.partitionBy("file").orderBy("at")
    rows = rows.withColumns({"_then": F.lead("text", 1).over(order), "_value": F.lead("text", 2).over(order), "_list": F.lead("at", 2).over(order)})
    rows = materialise(rows, "setup-tokens")
    quoted = F.rlike("_value", F.lit("^[\"'][\\p{L}\\p{N}](?:[\\p{L}\\p{N}._-]*[\\p{L}\\p{N}])?[\"']$"))
    named = rows.where("text = 'name' AND _then = '='").groupBy("file").agg(F.min_by(F.when(quoted, _bare(F.col("_value"))), "at").alias("name")).where("name IS NOT NULL")
    lists = rows.where("text = 'install_requires' AND _then = '=' AND _value = '['").groupBy("file").agg(F.min("_list").alias("inside"))
    items = rows.join(lists, ["file", "inside"]).select("file", "nth", "text", requirement(_bare(F.col("text"))).alias("req"))
    comma = F.col("text") == ","
    wrong = F.when(F.col("nth") % 2 == 0, ~comma).otherwise(~F.rlike("text", F.lit("^[\"']")) | F.col("req").isNull())
    bad = items.where(wrong).select("file").distinct()
    return named, items.join(bad, "file", "left_anti").where(~comma).select("file", "req")


def setup_cfg(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, name) and (file, req), as :func:`setup_py`, from setup.cfg: the indented lines below `install_requires =`."""
    name = F.regexp_extract("content", r"(?m)^[ \t]*name[ \t]*=[ \t]*([\p{L}\p{N}](?:[\p{L}\p{N}._-]*[\p{L}\p{N}])?)", 1)
    block = F.regexp_extract(F.concat("content", F.lit("\n")), r"(?m)^install_requires[ \t]*=[ \t]*(?:#.*)?\r?\n((?:(?:[ \t]+.*|[ \t]*#.*|\s*)\r?\n)*)", 1)
    line = F.trim(F.regexp_replace(F.col("line"), r"(^|\s)#.*$", ""))
    rows = files.select("file", F.explode(F.split(block, r"\r?\n")).alias("line")).select("file", line.alias("line")).where("line <> ''").select("file", requirement(F.col("line")).alias("req"))
    bad = rows.where("req IS NULL").select("file").distinct()
    return files.select("file", name.alias("name")).where("name <> ''"), rows.join(bad, "file", "left_anti")


def setup(parts: list[tuple[DataFrame, DataFrame]], installed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Dependencies and edges (file, src, dst), names, of the (names, requirements) that :func:`setup_py` and :func:`setup_cfg` read.

    Without ``installed`` (file, name, version, requires), as `pip show` tells it, all requirements are direct. With it, a
    project that is installed itself has what it was installed with, at the versions that are there, and all below;
    names are told apart without regard to case. Packages that require each other end.
    """
    direct, edges = None, None
    if installed is not None:
        low = F.lower("name")
        there = installed.select("file", low.alias("key"), "name", "version", "requires").dropDuplicates(["file", "key"])
        pairs = there.select("file", "key", F.explode("requires").alias("to")).select("file", "key", F.lower("to").alias("to"))
        pairs = pairs.join(there.select("file", F.col("key").alias("to")), ["file", "to"], "left_semi")
    for names, reqs in parts:
        rows = reqs.select("file", "req.name", "req.version", F.lit(True).alias("is_direct"))
        if installed is not None:
            own = names.select("file", F.lower("name").alias("key")).join(there, ["file", "key"], "left_semi")
            node = lambda c: F.struct("file", F.col(c).alias("key"))
            first = pairs.join(own, ["file", "key"], "left_semi").select("file", F.col("to").alias("key")).distinct()
            found = reach(pairs.select(node("key").alias("src"), node("to").alias("dst")), first.select(node("key").alias("node"))).select("node.*")
            pinned = found.join(first.withColumn("is_direct", F.lit(True)), ["file", "key"], "left").join(there, ["file", "key"])
            pinned = pinned.select("file", "name", F.concat(F.lit("=="), "version").alias("version"), F.coalesce("is_direct", F.lit(False)).alias("is_direct"))
            rows = rows.join(own, "file", "left_anti").unionByName(pinned)
            title = lambda c, to: there.select("file", F.col("key").alias(c), F.col("name").alias(to))
            links = pairs.join(found, ["file", "key"], "left_semi").join(title("key", "src"), ["file", "key"]).join(title("to", "dst"), ["file", "to"]).select("file", "src", "dst")
            edges = links if edges is None else edges.unionByName(links)
        direct = rows if direct is None else direct.unionByName(rows)
    rows = direct.groupBy("file", "name", "version").agg(F.bool_or("is_direct").alias("is_direct"))
    edges = direct.select("file", F.col("name").alias("src"), F.col("name").alias("dst")).limit(0) if edges is None else edges.distinct()
    return _rows(rows, F.col("name"), F.col("version"), direct=F.col("is_direct")), edges


# Leiningen


def lein_tree(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependencies (file, name, version, env, is_direct) and edges (file, src, dst), name and version, of `lein deps :tree-data`.

    A map's keys are vectors of name, version and marks, its values the map of what is below, or nil. A scope of a
    package is an environment, `test` is testing; one without a scope has a null one. Names are group:artifact; a name
    alone stands for both.
    """
    items = materialise(nested(tokens(files, EDN, ";")), "edn")
    here = Window.partitionBy("file", "inside").orderBy("nth")
    facts = items.withColumn("_mark", F.lag("text").over(here)).where("inside IS NOT NULL").groupBy("file", F.col("inside").alias("at")).agg(
        F.max(F.when(F.col("nth") == 1, F.col("text"))).alias("name"),
        F.max(F.when((F.col("nth") == 2) & F.startswith("text", F.lit('"')), _bare(F.col("text")))).alias("version"),
        F.max(F.when((F.col("nth") > 3) & (F.col("nth") % 2 == 0) & (F.col("_mark") == ":scope"), F.regexp_replace("text", '^"(.*)"$', "$1"))).alias("scope"),
    )
    maps = items.where("text = '{'").select("file", F.col("at").alias("inside"), F.col("inside").alias("_outer"), (F.col("nth") - 1).alias("_before"))
    keys = items.where("text = '[' AND nth % 2 = 1").join(maps, ["file", "inside"]).join(facts, ["file", "at"]).where("version IS NOT NULL")
    whole = F.replace("name", F.lit("/"), F.lit(":"))
    keys = keys.withColumn("name", F.when(F.contains(whole, F.lit(":")), whole).otherwise(F.concat(whole, F.lit(":"), whole)))
    keys = materialise(keys.select("file", "inside", "nth", "name", "version", "scope", "_outer", "_before"), "lein-keys")
    up = keys.select("file", F.col("inside").alias("_outer"), F.col("nth").alias("_before"), F.struct("name", "version").alias("src"))
    edges = keys.join(up, ["file", "_outer", "_before"]).select("file", "src", F.struct("name", "version").alias("dst")).distinct()
    env = F.when(F.col("scope") == "test", "testing").otherwise(F.col("scope"))
    once = keys.groupBy("file", "name", "version").agg(F.bool_or(F.col("_outer").isNull()).alias("is_direct"), F.collect_set(env).alias("envs"))
    return once.select("file", "name", "version", F.explode_outer("envs").alias("env"), "is_direct"), edges
