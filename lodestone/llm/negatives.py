"""Hard negatives by a distributed nearest-neighbour join over a Voronoi partition.

The inner product of whole-numbered vectors becomes a distance: a row x gets one more component, sqrt(M^2 - |x|^2)
with M the largest norm, an anchor q gets 0, and then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so that the rows of highest
score are the nearest. Rows are assigned to the nearest of some pivots (cells), anchors of neighbouring cells form
groups. A search has two rounds. First each group is joined with the rows of its own cells, which gives every anchor
a score that others must reach and so a radius. A row at distance d from its pivot p can lie within the radius R of
an anchor only if |q' - p| - R <= d <= |q' - p| + R and if the plane between p and the anchor's own pivot is no
farther than R; the second round sends a row only to groups that have such an anchor. Both rounds end in exact local
joins of one group with a part of its rows, so neither pivots nor groups change the result.

The search runs twice: for positives, among rows of the anchors' labels, and for negatives, whose scores lie in a
window below each positive's score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.plans.scratch import discard, materialise

SCALE = 256
#: Pivots at most; they are drawn by a hash of the id and held by every task.
PIVOTS = 256
#: Anchors of a group at most, and rows in a part of what a group is joined with.
GROUP, PART_LEAST, PART_MOST = 512, 256, 8192
#: Whole numbers up to which sums of products are exact.
EXACT = 1 << 53
#: Distances are widened by so much of the largest, for rounding.
SLACK = 1e-6

CELLS = "uid long, vec_id long, label long, v binary, norm double, cell int, dist double, home int"
_CELLS = pa.schema({"uid": pa.int64(), "vec_id": pa.int64(), "label": pa.int64(), "v": pa.binary(), "norm": pa.float64(), "cell": pa.int32(), "dist": pa.float64(), "home": pa.int32()})
FOUND = "uid long, anchor_id long, positive_uid long, positive_id long, positive_score long, negative_uid long, negative_id long, negative_score long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vectors(rows: DataFrame, vec_id: Column, label: Column, vector: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): rows that take part, their components floor(scale * x).

    Rows without an id, a label or a vector, and those with a component that is null, NaN or infinite, take no part.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    src = rows.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("e"))
    src = src.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & F.forall("e", fine))
    return src.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


class Space(NamedTuple):
    """Pivots and what distances are worked out from."""

    dim: int
    largest: float  # squared norm
    pivots: np.ndarray
    raised: np.ndarray  # the pivots' added components
    between: np.ndarray  # distances between pivots

    @classmethod
    def of(cls, vectors: list[list[int]], dim: int, largest: float) -> Space:
        p = np.zeros((len(vectors), dim))
        for i, v in enumerate(vectors):
            p[i, : len(v)] = v
        raised = np.sqrt(np.maximum(largest - (p * p).sum(1), 0))
        whole = np.column_stack([p, raised])
        return cls(dim, largest, p, raised, np.sqrt(np.maximum(2 * largest - 2 * whole @ whole.T, 0)))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to all pivots."""
        up = np.sqrt(np.maximum(self.largest - (x * x).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.largest - 2 * (x @ self.pivots.T + np.outer(up, self.raised)), 0))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.largest - 2 * q @ self.pivots.T, 0))


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i4").reshape(len(blobs), dim).astype(float)


def _cells(rows: DataFrame, space: Space, every: int) -> DataFrame:
    """Each row in its cell, vectors filled up with zeros; ``home`` is the cell nearest to an anchor."""
    dim = space.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["v"]
            sizes = np.diff(lists.offsets.to_numpy())
            x = np.zeros((len(sizes), dim), "<i4")
            x[np.arange(dim) < sizes[:, None]] = lists.flatten().to_numpy()
            far = space.of_rows(x.astype(float))
            cell = far.argmin(1)
            ids = batch["vec_id"].to_numpy()
            home = np.where(ids % every == 0, space.of_anchors(x.astype(float)).argmin(1), -1)
            norm = (x.astype(float) ** 2).sum(1)
            cols = [batch["uid"], batch["vec_id"], batch["label"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array(norm), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell]), pa.array(home.astype(np.int32), mask=home < 0)]
            yield pa.RecordBatch.from_arrays(cols, schema=_CELLS)

    return rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "label", "v").mapInArrow(run, CELLS)


def _grouped(counts: dict[int, int], space: Space, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first group and the number of groups of each cell: neighbouring cells share one, cells of many anchors are divided."""
    first, parts = np.full(len(space.pivots), -1), np.zeros(len(space.pivots), int)
    todo, group, held = set(counts), -1, most
    at = min(todo, default=None)
    while todo:
        todo.remove(at)
        n = counts[at]
        if held + n > most:
            group, held = group + 1, 0
        first[at], parts[at] = group, max(1, -(-n // most))
        group, held = group + parts[at] - 1, held + n
        at = min(todo, key=lambda c, a=at: (space.between[a, c], c), default=None)
    return first, parts


def _own(g: np.ndarray, first: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which cells are the groups' own, a row for each group."""
    return (g[:, None] >= first) & (g[:, None] < first + parts)


class _Search(NamedTuple):
    cells: DataFrame
    space: Space
    first: np.ndarray
    parts: np.ndarray

    def home(self, anchors: DataFrame, by: list[str]) -> DataFrame:
        """Routes of the first round: (by..., cell, lo, hi)."""
        spark = anchors.sparkSession
        cells = [(int(c), int(g), int(n)) for c, (g, n) in enumerate(zip(self.first, self.parts, strict=True)) if n]
        known = spark.createDataFrame(cells, "cell int, first int, n int").select("cell", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("g"))
        return anchors.select(*by).distinct().join(known, "g").select(*by, "cell", F.lit(-1.0).alias("lo"), F.lit(math.inf).alias("hi"))

    def away(self, anchors: DataFrame, by: list[str]) -> DataFrame:
        """Routes of the second round; ``anchors`` have the score ``need`` that rows must reach, null if any may."""
        space, first, parts = self.space, self.first, self.parts
        slack = SLACK * math.sqrt(2 * space.largest) + SLACK

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if not len(f):
                    continue
                q = _matrix(f["v"].tolist(), space.dim)
                far, home = space.of_anchors(q), f["home"].to_numpy()
                need = f["need"].to_numpy(dtype=float)
                radius = np.where(np.isnan(need), math.inf, np.sqrt(np.maximum((q * q).sum(1) + space.largest - 2 * np.nan_to_num(need), 0)) + slack)[:, None]
                apart = space.between[home]
                plane = np.divide(far**2 - far[np.arange(len(f)), home][:, None] ** 2, 2 * apart, out=np.zeros_like(far), where=apart > slack)
                served = (plane <= radius) & ~_own(f["g"].to_numpy(), first, parts)
                i, j = np.nonzero(served)
                out = f[by].iloc[i].assign(cell=j.astype(np.int32), lo=(far - radius)[i, j], hi=(far + radius)[i, j])
                yield out.groupby([*by, "cell"], as_index=False).agg({"lo": "min", "hi": "max"})

        kinds = dict(anchors.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", cell int, lo double, hi double"
        return anchors.mapInPandas(run, schema).groupBy(*by, "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def joined(self, anchors: DataFrame, routes: DataFrame, by: list[str], local: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """What ``local`` finds for groups of anchors and parts of the rows that ``routes`` send to them."""
        on = [c for c in by if c != "g"] + ["cell"]
        rows = self.cells.join(routes, on).where("dist >= lo AND dist <= hi")
        sizes = materialise(rows.groupBy(*by).agg(F.count("*").alias("rows")), "negatives-sizes")
        total = sizes.agg(F.sum("rows")).first()[0] or 0
        part = min(PART_MOST, max(PART_LEAST, total // 256))
        sizes = sizes.select(*by, F.ceil(F.col("rows") / part).cast("int").alias("n"))
        some = F.pmod(F.xxhash64("uid"), F.col("n")).cast("int").alias("some")
        rows = rows.join(sizes, by).select(*by, some, *[c for c in ("uid", "vec_id", "label", "v") if c not in by])
        every = anchors.join(sizes, by).withColumn("some", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
        rows, keys = rows.toDF(*rows.columns), [*by, "some"]
        return every.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(local, schema)


def _best(found: DataFrame, by: list[str], uid: str, vec_id: str, score: str, k: int) -> DataFrame:
    """The first ``k`` of each key, with their ``rank``: higher scores first, then smaller ids."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(vec_id), F.col(uid))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(dim: int, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def local(a: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(rows):
            rows = rows.sort_values(["vec_id", "uid"])
            uid, ids = rows["uid"].to_numpy(), rows["vec_id"].to_numpy()
            scores = _matrix(a["v"].tolist(), dim) @ _matrix(rows["v"].tolist(), dim).T
            for i, own in enumerate(a["uid"]):
                s = np.where(uid == own, -math.inf, scores[i])
                least = np.partition(s, -k)[-k] if len(s) > k else -math.inf
                at = np.flatnonzero((s >= least) & (s > -math.inf))
                at = at[np.argsort(-s[at], kind="stable")][:k]
                out += [(own, uid[j], ids[j], int(s[j])) for j in at]
        return pd.DataFrame(out, columns=["uid", "positive_uid", "positive_id", "positive_score"])

    return local


def _negatives(dim: int, k: int, low: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def local(a: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(rows):
            rows = rows.sort_values(["vec_id", "uid"])
            uid, ids, labels = rows["uid"].to_numpy(), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            scores = _matrix(a["v"].tolist(), dim) @ _matrix(rows["v"].tolist(), dim).T
            for i, (own, anchor, label, positives) in enumerate(zip(a["uid"], a["vec_id"], a["label"], a["positives"], strict=True)):
                tops = [p["positive_score"] for p in positives]
                s = scores[i]
                at = np.flatnonzero((100 * s >= low * min(tops)) & (s <= max(tops)) & (labels != label))
                at = at[np.argsort(-s[at], kind="stable")]
                s = s[at]
                for p, top in zip(positives, tops, strict=True):
                    start = int(np.searchsorted(-s, -top, "left"))
                    for j in range(start, min(start + k, len(s))):
                        if 100 * s[j] < low * top:
                            break
                        out.append((own, anchor, p["positive_uid"], p["positive_id"], top, uid[at[j]], ids[at[j]], int(s[j])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    return local


def mine(rows: DataFrame, every: int = 100, k: int = 5, low: int = 80, pivots: int = PIVOTS, group: int = GROUP) -> DataFrame:
    """Hard negatives of ``rows`` (vec_id, label, v), as :func:`whole_vectors` makes them: see :data:`MINED`.

    Anchors are rows whose id ``every`` divides. An anchor's positives are the ``k`` other rows of its label with the
    highest scores; for each, the first ``k`` rows of other labels follow whose score is ``low`` per cent of the
    positive's or more and no higher than it. Higher scores come first, smaller ids at ties. A row is told from others
    by its place, so a repeated row is another row, and each row of an anchor's id is an anchor. Vectors of unequal
    length count as filled up with zeros. Scores are exact; vectors whose scores could pass 2^53 are refused with a
    ValueError. No rows give no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", "label", "v")
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x)
    most = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    n, dim, largest, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm), most).first()
    if not n:
        return spark.createDataFrame([], MINED)
    if max(dim, 1) * (most or 0) ** 2 * 100 >= EXACT or (most or 0) >= 1 << 31:
        raise ValueError(f"components up to {most} in {dim} dimensions: scores would not be exact")
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(pivots, max(1, math.isqrt(n) // 4))).collect()
    space = Space.of([r["v"] for r in drawn], max(dim, 1), float(largest or 0))
    cells = materialise(_cells(rows, space, every), "negatives-cells")
    counts = {r["home"]: r["count"] for r in cells.where("home IS NOT NULL").groupBy("home").count().collect()}  # a row for each pivot
    if not counts:
        return spark.createDataFrame([], MINED)
    first, parts = _grouped(counts, space, group)
    search = _Search(cells, space, first, parts)
    place = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in counts], "home int, first int, n int")
    anchors = cells.where("home IS NOT NULL").join(F.broadcast(place), "home").select("uid", "vec_id", "label", "v", "home", (F.col("first") + F.pmod(F.xxhash64("uid"), F.col("n"))).cast("int").alias("g"))
    anchors = materialise(anchors, "negatives-anchors")

    by, schema, local = ["label", "g"], "uid long, positive_uid long, positive_id long, positive_score long", _positives(space.dim, k)
    best = lambda found: _best(found, ["uid"], "positive_uid", "positive_id", "positive_score", k)
    near = materialise(best(search.joined(anchors, search.home(anchors, by), by, local, schema)).drop("rank"), "negatives-near")
    need = near.groupBy("uid").agg(F.when(F.count("*") >= k, F.min("positive_score")).alias("need"))
    routes = materialise(search.away(anchors.join(need, "uid", "left"), by), "negatives-routes")
    positives = best(near.unionByName(search.joined(anchors, routes, by, local, schema))).drop("rank")

    # No row can lie in the window below a negative score.
    listed = positives.where("positive_score >= 0").groupBy("uid").agg(F.collect_list(F.struct("positive_uid", "positive_id", "positive_score")).alias("positives"))  # k at most
    anchors = materialise(anchors.join(listed, "uid"), "negatives-positives")
    by, local = ["g"], _negatives(space.dim, k, low)
    best = lambda found: _best(found, ["uid", "positive_uid"], "negative_uid", "negative_id", "negative_score", k)
    near2 = materialise(best(search.joined(anchors, search.home(anchors, by), by, local, FOUND)).drop("rank"), "negatives-near")
    full = near2.groupBy("uid", "positive_uid").agg(F.when(F.count("*") >= k, F.min("negative_score")).alias("kth"))
    asked = anchors.select("uid", F.explode("positives").alias("p")).select("uid", "p.positive_uid", F.ceil(F.col("p.positive_score") * low / 100).alias("least"))
    need = asked.join(full, ["uid", "positive_uid"], "left").groupBy("uid").agg(F.min(F.greatest("least", "kth")).cast("double").alias("need"))
    routes2 = materialise(search.away(anchors.drop("positives").join(need, "uid"), by), "negatives-routes")
    found = materialise(best(near2.unionByName(search.joined(anchors, routes2, by, local, FOUND))), "negatives")
    for done in (near, near2, routes, routes2, anchors, cells):
        discard(done)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: The query's SQL: all scores of all anchors.
ORACLE = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5"""
