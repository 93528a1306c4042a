"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents fall into cells of (source, language, topic). The cells' token sums, a small table, are raked: scaled in
turn so that the sums by source, by language and by topic meet their targets, ROUNDS times. The ratio of raked to
present tokens, times one factor for all cells, is the probability with which a cell's documents are kept; the
factor is the largest that keeps the expected tokens at the asked share of what there is, with probabilities
above one cut to one (water filling over the cells in order of ratio). A document is kept if the hash of its id
lies below its cell's probability, so the sample is reproducible and needs no shuffle.

Targets default to the present shares to the power ALPHA, brought to a sum of one: rare sources, languages and
topics gain. Topics come from :func:`topic`, an ordered list of rules over the whole text.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.rows import packed
from lodestone.plans.scratch import materialise

ROUNDS = 8
ALPHA = 0.7
SHARE = 0.5
SEED = "mix-1"
AXES = ("source", "lang", "topic")
#: Cells up to which one task rakes them all; more are dealt by the axis.
ONE_TASK = 100_000

# The ordered topic rules; each is a list of words of which the lower-case text holds one.
TOPICS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("legal", ("license", "licence", "copyright", "warranty")),
    ("contact", ("@", "http://", "https://", "www.")),
    ("table", (" | ", "\t")),
    ("symbols", ("###", "$$$", "%%%", "***", "&&&")),
)
OTHER = "prose"


def topic(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(OTHER)
    for name, words in reversed(TOPICS):
        test = F.lit(False)
        for w in words:
            test = test | F.contains(low, F.lit(w))
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Words of a text, at least one, so that no document has weight zero."""
    text = F.coalesce(text, F.lit(""))
    return F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def coin(id_col: Column) -> Column:
    """A number in [0, 1) that the id decides; null ids share one."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(SEED))), 1, 8), 16, 10).cast("double") / 4294967296.0


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens); a null source or language is the value ''."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic(F.col(text_col)).alias("topic"), tokens(F.col(text_col)).alias("n_tokens")
    )


def _targets(cells: DataFrame, axis: str, given: Mapping[str, float] | None, alpha: float) -> DataFrame:
    """cells with target, the share that the cell's value of ``axis`` is to have. Values that ``given`` leaves out get none."""
    if given is not None:
        pairs = [F.lit(x) for k, v in given.items() for x in (k, float(v))]
        whole = float(sum(given.values()))
        return cells.withColumn(f"to_{axis}", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(axis)), F.lit(0.0)) / whole)
    powered = cells.withColumn("_p", F.pow(F.sum("tokens").over(Window.partitionBy(axis)) / F.sum("tokens").over(Window.partitionBy()), F.lit(alpha)))
    first = F.row_number().over(Window.partitionBy(axis).orderBy(*AXES)) == 1
    powered = powered.withColumn("_f", F.when(first, F.col("_p")).otherwise(0.0))
    return powered.withColumn(f"to_{axis}", F.col("_p") / F.sum("_f").over(Window.partitionBy())).drop("_p", "_f")


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, tokens, weight): weight is the raked share of each cell; weights sum to one.

    Targets that leave a value out give its cells no weight. Targets that no weights can meet (a value whose
    cells all have weight zero) are met as far as the others allow.
    """
    for axis in AXES:
        cells = _targets(cells, axis, (targets or {}).get(axis), alpha)
    cells = cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))
    for _ in range(rounds):
        for axis in AXES:
            now = F.sum("weight").over(Window.partitionBy(axis))
            cells = cells.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"to_{axis}") / now).otherwise(0.0))
    return cells.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy())).select(*AXES, "tokens", "weight")


def probabilities(raked: DataFrame, share: float = SHARE) -> DataFrame:
    """``raked`` with probability: the chance of each cell's documents, so that ``share`` of all tokens is expected."""
    ratio = F.when(F.col("weight") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    before = Window.orderBy(F.desc("_r"), *AXES)
    whole = F.sum("tokens").over(Window.partitionBy())
    ranked = raked.withColumn("_r", ratio)
    ranked = ranked.withColumn("_cut", F.coalesce(F.sum("tokens").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("_rest", F.sum("weight").over(before.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    ranked = ranked.withColumn("_s", F.when(F.col("_rest") > 0, (F.lit(share) * whole - F.col("_cut")) / F.col("_rest")))
    good = F.when(F.col("_s") * F.col("_r") <= 1, F.col("_s"))  # the first cell that is not cut decides
    factor = F.max(good).over(Window.partitionBy())
    p = F.when(F.col("_r") > 0, F.least(F.lit(1.0), F.coalesce(F.greatest(factor, F.lit(0.0)) * F.col("_r"), F.lit(1.0)))).otherwise(0.0)
    return ranked.withColumn("probability", p).select(*AXES, "tokens", "weight", "probability")


def cell_chances(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, share: float = SHARE, alpha: float = ALPHA, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability) for each cell of labelled rows."""
    cells = materialise(rows.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    if cells.limit(ONE_TASK + 1).count() <= ONE_TASK:
        cells = cells.coalesce(1)  # every window below then finds its rows in place
    return materialise(probabilities(rake(cells, targets, alpha, rounds), share), "mix-chances")


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, share: float = SHARE, alpha: float = ALPHA, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, kept) for every row.

    Rows with the same id share their coin, so repeated rows are kept or dropped together; null ids share one
    coin; null and empty texts weigh one token; an empty table gives an empty result; other columns are ignored.
    Expected kept tokens are ``share`` of all, less where targets leave values out that the rest can't make up.
    """
    rows = materialise(labelled(docs, id_col, text_col), "mix-rows")
    chances = cell_chances(rows, targets, share, alpha, rounds)
    out = rows.join(chances.drop("tokens"), list(AXES))
    return out.select("doc_id", *AXES, "n_tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), (coin(F.col("doc_id")) < F.round("probability", 9)).alias("kept"))


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, share: float = SHARE, alpha: float = ALPHA, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mix keeps, columns as they are."""
    chances = cell_chances(labelled(docs, id_col, text_col), targets, share, alpha, rounds).select(*AXES, F.round("probability", 9).alias("p"))
    keyed = packed(docs, source=F.coalesce("source", F.lit("")), lang=F.coalesce("lang", F.lit("")), topic=topic(F.col(text_col)), coin=coin(F.col(id_col)))
    return keyed.join(chances, list(AXES)).where("coin < p").select("row.*")


def oracle(share: float = SHARE, alpha: float = ALPHA, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, for default targets."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    tests = " ".join(f"WHEN {' OR '.join(f'contains(low, {q(w)})' for w in words)} THEN {q(name)}" for name, words in TOPICS)
    ctes = [
        "l AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, lower(coalesce(text, '')) AS low, coalesce(text, '') AS text FROM documents)",
        f"rws AS MATERIALIZED (SELECT doc_id, source, lang, CASE {tests} ELSE {q(OTHER)} END AS topic, greatest(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 1)::BIGINT AS n_tokens FROM l)",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rws GROUP BY ALL)",
    ]
    for axis in AXES:
        ctes.append(f"p_{axis} AS (SELECT {axis}, pow(sum(tokens) / (SELECT sum(tokens) FROM cells), {alpha}) AS p FROM cells GROUP BY 1)")
    to = ", ".join(f"(SELECT p FROM p_{a} x WHERE x.{a} = c.{a}) / (SELECT sum(p) FROM p_{a}) AS to_{a}" for a in AXES)
    ctes.append(f"w0 AS MATERIALIZED (SELECT c.*, {to}, tokens / (SELECT sum(tokens) FROM cells) AS weight FROM cells c)")
    n = 0
    for _ in range(rounds):
        for axis in AXES:
            ctes.append(f"w{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (weight), weight * to_{axis} / sum(weight) OVER (PARTITION BY {axis}) AS weight FROM w{n})")
            n += 1
    ctes += [
        f"r AS (SELECT source, lang, topic, tokens, weight / sum(weight) OVER () AS weight FROM w{n})",
        "o AS (SELECT *, weight / tokens AS ratio, sum(tokens) OVER () AS whole FROM r)",
        "k AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut, sum(weight) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o)",
        f"s AS (SELECT *, ({share} * whole - cut) / rest AS scale FROM k)",
        "c AS MATERIALIZED (SELECT *, least(1.0, coalesce(greatest((SELECT max(scale) FROM s WHERE scale * ratio <= 1), 0.0) * ratio, 1.0)) AS probability FROM s)",
    ]
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, source, lang, topic, n_tokens, round(weight, 9) AS weight, round(probability, 9) AS probability, "
        f"('0x' || substr(md5(doc_id::VARCHAR || ':{SEED}'), 1, 8))::UBIGINT / 4294967296.0 < round(probability, 9) AS kept FROM rws JOIN c USING (source, lang, topic)"
    )
