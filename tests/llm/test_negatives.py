"""Hard negatives against all scores of all anchors."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, cell int, g string"


def plain(rows):
    """(anchor, positive, rank, negative, scores) of every anchor by sorting everything."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and fine(v)]
    out = []
    for n, (i, v, lab) in enumerate(rows):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, m, other) for m, (j, w, other) in enumerate(rows) if m != n)
        same = [(-s, j, m) for s, j, m, other in scored if other == lab][:5]
        for p, j, _ in same:
            fit = [(-s, x) for s, x, _, other in scored if other != lab and 80 * p <= 100 * -s <= 100 * p][:5]
            out += [(i, j, r, x, p, s) for r, (s, x) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    src = spark.createDataFrame([(*r, "u", 1, "g") for r in rows], "vec_id long, embedding array<float>, label int, uid string, cell int, g string")
    got = negatives.mine(negatives.whole_vectors(src, F.col("vec_id"), F.col("label"), F.col("embedding")), **more)
    assert dict(got.dtypes)["rank"] == "int"
    return sorted(tuple(r) for r in got.collect())


def clustered(n, clusters, dim, spread, seed, grid=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        v = [c + rng.gauss(0, spread) for c in rng.choice(centres)]
        size = math.sqrt(sum(x * x for x in v))
        v = [x / size for x in v]
        rows.append((i, [round(x * grid) / grid for x in v] if grid else [float(f"{x:.6f}") for x in v], rng.randrange(4)))
    return rows


def as_float(rows):
    import numpy as np

    return [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


@pytest.mark.parametrize(("rows", "pivots", "group"), [(clustered(1500, 12, 6, 0.15, 1), 24, 3), (clustered(900, 2, 3, 0.4, 2, grid=4), 9, 512), (clustered(600, 1, 16, 1.0, 3), 1, 2)])
def test_all_scores(spark, rows, pivots, group):
    rows = as_float(rows)
    want = plain(rows)
    assert len(want) > 50
    assert mined(spark, rows, pivots=pivots, group=group) == want


def test_a_third_of_all_rows_alike(spark):
    rows = as_float(clustered(800, 5, 5, 0.2, 4))
    rows = [(i, rows[0][1], 1) if i % 3 == 0 else (i, v, lab) for i, v, lab in rows]
    assert mined(spark, rows, group=2) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.5], 1), (1, [0.5, 0.4], 1), (2, [0.5, 0.3], 2), (3, None, 1), (4, [0.5, None], 1), (5, [nan, 0.5], 2), (6, [0.5, inf], 2), (7, [0.5, 0.5], None), (None, [0.5, 0.5], 1),
        (8, [], 2), (9, [0.5], 1), (10, [0.5, 0.25, 3.0], 2), (100, [-0.5, 0.0], 2), (200, [0.0, 0.0], 1), (200, [0.0, 0.0], 1), (2, [0.5, 0.3], 2), (-100, [0.5, 0.5], 9), (300, [], 1), (400, [1.0], 3), (11, [1.0], 3), (12, [0.9], 2), (13, [0.9], 2),
    ]
    assert mined(spark, as_float(rows)) == plain(as_float(rows))
    assert mined(spark, []) == [] == mined(spark, rows[2:6])
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 1, 1, 2, 0, 0)]


def test_scores_stay_exact(spark):
    with pytest.raises(ValueError, match="exact"):
        mined(spark, [(0, [1e9], 1), (1, [1e9], 1)])


def test_rounds_send_few_rows_far(spark):
    """In clustered rows most cells are out of reach of a group, and the second round leaves them out."""
    rows = as_float(clustered(3000, 20, 8, 0.02, 6))
    src = spark.createDataFrame([(*r, "u", 1, "g") for r in rows], SCHEMA)
    whole = negatives.whole_vectors(src, F.col("vec_id"), F.col("label"), F.col("embedding"))
    drawn = whole.orderBy(F.xxhash64("vec_id")).limit(30).collect()
    largest = max(sum(x * x for x in r["v"]) for r in whole.collect())
    space = negatives.Space.of([r["v"] for r in drawn], 8, float(largest))
    cells = negatives._cells(whole, space, 100).cache()
    first, parts = negatives._grouped({r["home"]: r["count"] for r in cells.where("home IS NOT NULL").groupBy("home").count().collect()}, space, 2)
    search = negatives._Search(cells, space, first, parts)
    anchors = cells.where("home IS NOT NULL").select("uid", "v", "home", F.udf(lambda c: int(first[c]), "int")("home").alias("g"), F.lit(0.9 * largest).alias("need"))
    sent = cells.join(search.away(anchors, ["g"]), "cell").where("dist >= lo AND dist <= hi").count()
    assert sent < 0.2 * cells.count() * anchors.select("g").distinct().count()
