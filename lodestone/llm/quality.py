"""Quality rules: base counts of every text and robust multivariate outliers, with DataFrame functions only.

The statistics of a document are (log of mean word length, square root of symbols a word, share of lines that
repeat, share of words in repeated windows). For each (lang, source) a minimum-covariance-determinant estimate is
made by concentration steps: the H share of documents that lie closest to a centre gives the next mean and covariance,
and so on. Each group starts from its medians and quartiles and from the moments of small drawn subsets; after PROBE
steps the start of the least determinant goes on alone until the determinant settles. A document is rejected if its
Mahalanobis distance exceeds CUT. Estimates use every document that passes the base rules; only small aggregates are
shuffled (medians and quantiles are exact over values rounded to 0.01, so their state is bounded), never a text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rows import without
from lodestone.plans.scratch import discard, materialise

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STATS = ("x0", "x1", "x2", "x3")
#: Least standard deviation of each statistic: a source whose documents agree exactly must not reject the next clean one.
FLOOR = (0.08, 0.15, 0.1, 0.1)
H = 0.75
#: Starts of each group, the subsets drawn for all but the first, and the steps that each start gets.
STARTS = 4
DRAWN = 25
PROBE = 2
#: Change of the logarithm of the determinant that ends the steps, and most steps.
SETTLED = 1e-3
MOST_STEPS = 12
#: Rows of estimates (some 20 numbers each) up to which they are broadcast.
BROADCAST_ROWS = 50_000
#: A (lang, source) with fewer documents is judged with its language, a language with fewer with all.
LEAST = 50
#: Chance that a document of a normal group lies beyond the cut.
TAIL = 1e-6


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that are found twice or more."""

    def count(hashes: Column) -> Column:
        n = F.size(hashes)
        windows = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[hashes[i + k] for k in range(5)]))

        def marked(w: Column) -> Column:
            def covered(s: Column) -> Column:
                same = lambda j, k: F.coalesce(F.get(s, j)["w"] == F.get(s, k)["w"], F.lit(False))
                starts = F.sort_array(F.transform(F.filter(s, lambda x, j: same(j, j - 1) | same(j, j + 1)), lambda x: x["i"]))
                return _let(starts, lambda p: F.aggregate(F.transform(p, lambda at, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - at, F.lit(5)))), F.lit(0), lambda a, x: a + x))

            placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_let(placed, covered))

        return F.when(n < 6, F.lit(0)).otherwise(_let(windows, marked))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), count)


def base_counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))

    return F.struct(
        _let(words, counts).alias("w"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.char_length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base verdict and statistics of every row; texts are read once and not kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.xxhash64(text_col).alias("text_key"), base_counts(F.col(text_col)).alias("c"))
    rows = rows.select("doc_id", "lang", "source", "text_key", "c.w.*", "c.l.*", "c.word_chars", "c.n_symbols")
    n = F.greatest("n_words", F.lit(1))
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).withColumns(
        {
            "x0": F.log(F.greatest("word_chars", F.lit(1)) / n),
            "x1": F.sqrt(F.col("n_symbols") / n),
            "x2": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "x3": F.col("n_repeat_words") / n,
        }
    )


def _chi2(q: float, dof: int) -> float:
    """Distribution function of chi squared for even degrees of freedom."""
    x, term, total = q / 2, 1.0, 1.0
    for k in range(1, dof // 2):
        term *= x / k
        total += term
    return 1 - math.exp(-x) * total


def _chi2_point(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, dof) < p else (low, mid)
    return high


CUT = _chi2_point(1 - TAIL, len(STATS))
#: Makes the covariance of the closest H share consistent for normal data.
GROW = H / _chi2(_chi2_point(H, len(STATS)), len(STATS) + 2)


def _cholesky(df: DataFrame) -> DataFrame:
    """Adds the factor l{i}{j} of the covariance s{i}{j} in place of it."""
    d = len(STATS)
    for i in range(d):
        for j in range(i + 1):
            left = F.col(f"s{j}{i}")
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(FLOOR[i] ** 2 / 4))) if i == j else left / F.col(f"l{j}{j}"))
    return df


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i, x in enumerate(STATS):
        left = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            left = left - F.col(f"l{i}{k}") * z[k]
        z.append(left / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _levels(rows: DataFrame) -> DataFrame:
    """Adds g, the group that judges a row: lang and source, or lang, or all."""
    fit = rows.where("NOT base_failed")
    by_source = fit.groupBy("lang", "source").agg(F.count("*").alias("n_s"))
    by_lang = by_source.groupBy("lang").agg(F.sum("n_s").alias("n_l"))
    sizes = by_lang.join(by_source, "lang")
    g = F.when(F.col("n_s") >= LEAST, F.concat_ws("\x1f", F.lit("s"), "lang", "source")).when(F.col("n_l") >= LEAST, F.concat_ws("\x1f", F.lit("l"), "lang")).otherwise(F.lit("a"))
    known = materialise(sizes.select("lang", "source", g.alias("g")), "quality-groups")
    return rows.join(known, ["lang", "source"], "left").withColumn("g", F.coalesce("g", F.lit("a")))


def _beside(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with estimates by g; the estimates are broadcast if they are counted to be few."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, "g", how)


def _shape(moments: DataFrame) -> DataFrame:
    """(g, k, m*, l*, det) from centres m* and covariances s*; det is the logarithm of the determinant."""
    d = range(len(STATS))
    rows = _cholesky(moments).select("g", "k", *[f"m{i}" for i in d], *[f"l{i}{j}" for i in d for j in d if j <= i])
    return rows.withColumn("det", 2 * sum((F.log(f"l{i}{i}") for i in d[1:]), F.log("l00")))


def _moments(rows: DataFrame, grow: float) -> DataFrame:
    """Centres and covariances, times ``grow`` and over the floor, of each (g, k)."""
    d = range(len(STATS))
    means = [F.avg(x).alias(f"m{i}") for i, x in enumerate(STATS)]
    sums = [F.covar_pop(STATS[i], STATS[j]).alias(f"s{i}{j}") for i in d for j in d if i <= j]
    spread = {f"s{i}{j}": F.col(f"s{i}{j}") * grow + (FLOOR[i] ** 2 if i == j else 0) for i in d for j in d if i <= j}
    return rows.groupBy("g", "k").agg(*means, *sums).withColumns(spread)


def _starts(fit: DataFrame) -> DataFrame:
    """(g, k, m*, l*, det): STARTS estimates of each group to start from."""
    d = range(len(STATS))
    quart = [F.percentile(F.round(x, 2), [0.25, 0.5, 0.75]).alias(f"q{i}") for i, x in enumerate(STATS)]
    sizes = materialise(fit.groupBy("g").agg(F.count("*").alias("n"), *quart), "quality-sizes")
    cols = {f"m{i}": F.col(f"q{i}")[1] for i in d}
    cols |= {f"s{i}{j}": F.pow(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i])), 2) if i == j else F.lit(0.0) for i in d for j in d if i <= j}
    middle = _shape(sizes.withColumns(cols).withColumn("k", F.lit(0)))
    drawn = _beside(fit, sizes.select("g", "n")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(STARTS - 1))))
    drawn = drawn.where(F.pmod(F.xxhash64("k", *STATS), F.ceil(F.col("n") / DRAWN)) == 0)
    return materialise(middle.unionByName(_shape(_moments(drawn, 1.0))), "quality-start")


def _step(fit: DataFrame, shape: DataFrame) -> DataFrame:
    """One concentration step of every (g, k) of ``shape``."""
    far = _beside(fit, shape).select("g", "k", *STATS, F.round(F.log(_distance() + 1e-9), 2).alias("d"))
    edge = materialise(far.groupBy("g", "k").agg(F.percentile("d", H).alias("edge")), "quality-edge")
    near = far.join(F.broadcast(edge) if edge.count() <= BROADCAST_ROWS else edge, ["g", "k"]).where("d <= edge")
    out = materialise(_shape(_moments(near, GROW)), "quality-step")
    discard(edge)
    return out


def estimates(fit: DataFrame) -> DataFrame:
    """(g, k, m*, l*, det): centre and covariance factor of least determinant of each group of ``fit`` (g and the statistics)."""
    shape = _starts(fit)
    for _ in range(PROBE):
        shape = _step(fit, shape)
    best = shape.groupBy("g").agg(F.min_by("k", F.struct("det", "k")).alias("k"))
    shape = materialise(shape.join(best, ["g", "k"]), "quality-best")
    for _ in range(MOST_STEPS - PROBE):
        moved = _step(fit, shape)
        change = moved.select("g", F.col("det").alias("new")).join(shape.select("g", "det"), "g").agg(F.max(F.abs(F.col("new") - F.col("det")))).first()[0]
        discard(shape)
        shape = moved
        if change is None or change < SETTLED:
            break
    return shape


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, ...) for every row.

    A null text has no words and fails; a null lang or source is a value of its own; null ids and repeated rows
    are judged like others; an empty table gives an empty result; other columns are ignored. Where no group has
    an estimate (no row passes the base rules) nothing is rejected by distance. distance is rounded to 6 places.
    """
    rows = _levels(materialise(statistics(docs, id_col, text_col), "quality"))
    shape = estimates(rows.where("NOT base_failed").select("g", *STATS))
    judged = _beside(rows, shape.drop("k", "det"), "left").withColumn("distance", F.round(F.sqrt(_distance()), 6))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= math.sqrt(CUT))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance", "text_key", "lang", "source")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns as they are.

    Rows are told apart by id, hash of the text, lang and source, as a text may pass in one group and fail in another;
    rows that agree on these share one fate. A null text has no words and goes; null ids, langs and sources are values
    like others; an empty table gives an empty result.
    """
    bad = judge(docs, id_col, text_col).where("NOT kept")
    return without(docs, bad, doc_id=F.col(id_col), text_key=F.xxhash64(text_col), lang=F.coalesce("lang", F.lit("")), source=F.coalesce("source", F.lit("")))
