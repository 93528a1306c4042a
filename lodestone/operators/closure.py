"""Reachability over edge tables, round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.scratch import discard, materialise

#: Rounds after which what was found so far is rewritten as one table.
COMPACT = 16
#: Rows up to which a round's finds, or all edges, are broadcast.
FEW = 200_000
#: Rows from which what is known is not sorted anew for a few finds, and not walked again in several steps.
MANY = 1_000_000
#: Steps of a round while what is found is little, over few edges.
STEPS = 6


def reach(edges: DataFrame, seeds: DataFrame, inclusive: bool = True) -> DataFrame:
    """(keys..., node): what each key's seeds reach over ``edges`` (src, dst).

    ``seeds`` has ``node`` and any key columns; without keys the answer is one set of nodes. Semi-naive: a round
    joins only what the round before found, and drops what is known, so cycles end. Edges are made once. Rounds are as
    many as the longest shortest path, or a sixth of that where edges are few and the finds of a round too. Once finds
    get few beside a large set, edges to what is in the set are left out. A small frontier is broadcast, a large one
    is shuffled; finds are written and broadcast as well once much is known. Null nodes reach nothing and are dropped.
    Without ``inclusive`` seeds count only if they are reached again.
    """
    spark, keys = seeds.sparkSession, [c for c in seeds.columns if c != "node"]
    named = [*keys, "node"]
    own = None if hasattr(edges, "_lodestone_path") else materialise(edges.select("src", "dst"), "reach-edges")
    table = edges if own is None else own
    bare = lambda rows: rows.select("src", F.col("dst").alias("_to")).where("src IS NOT NULL AND _to IS NOT NULL")
    edges, many = bare(table), table.count()

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.join(edges, frontier["node"] == edges["src"]).select(*keys, F.col("_to").alias("node")).distinct()

    def steps(frontier: DataFrame) -> DataFrame:
        """What is found in up to STEPS steps, and in which first."""
        out = frontier.withColumn("_step", F.lit(0))
        for n in range(1, STEPS + 1):
            near = out.join(F.broadcast(edges), (out["node"] == edges["src"]) & (out["_step"] == n - 1), "left")
            ends = F.array(F.struct("node", "_step"), F.struct(F.col("_to").alias("node"), F.lit(n).alias("_step")))
            out = near.select(*keys, F.inline(ends)).where("node IS NOT NULL").groupBy(*named).agg(F.min("_step").alias("_step"))
        return out

    first = seeds.where("node IS NOT NULL").select(*named).distinct()
    frontier = materialise(first if inclusive else step(first), "reach")
    schema, parts = frontier.schema, [frontier]
    known = n = frontier.count()
    pruned = 0
    while n:
        seen = spark.read.schema(schema).parquet(*[p._lodestone_path for p in parts])
        if not keys and many > FEW and 20 * n <= known and known > 2 * pruned:
            rest = materialise(table.join(seen.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "reach-edges")
            discard(own)
            table = own = rest
            edges, many, pruned = bare(table), table.count(), known
        far = many <= FEW and (known <= MANY or 50 * n <= known)
        found = materialise(steps(frontier) if far else step(frontier), "reach") if known > MANY else steps(frontier) if far else step(frontier)
        match = seen.toDF(*[f"_{c}" for c in seen.columns])
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in named]
        if known > MANY and found.count() <= FEW:
            match = match.join(F.broadcast(found.select(*named)), on, "left_semi")
        new = materialise(found.join(match, on, "left_anti"), "reach")
        parts.append(new)
        discard(found)
        n = new.count()
        known += n
        frontier = new.where(F.col("_step") == STEPS).select(*named) if far else new
        if far and n:
            n = frontier.count()
        if len(parts) >= COMPACT:
            whole = materialise(spark.read.schema(schema).parquet(*[p._lodestone_path for p in parts]), "reach")
            for p in parts[:-1]:
                discard(p)
            parts = [whole]
    discard(own)
    return spark.read.schema(schema).parquet(*[p._lodestone_path for p in parts])


#: Nodes drawn by :func:`circles`.
DRAWN = 24


def circles(edges: DataFrame) -> DataFrame:
    """(node, ring): nodes that reach each other over ``edges`` (src, dst), named by one of them; large sets of such nodes.

    Of drawn nodes what they reach and what reaches them is found; a set without a drawn node is left out. Whoever puts one
    node in place of a set gets the same answers, whichever sets are found.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both_ways = edges.select(F.col("src").alias("node")).distinct().join(back.select(F.col("src").alias("node")).distinct(), "node")
    drawn = materialise(both_ways.orderBy(F.xxhash64("node"), "node").limit(DRAWN).select(F.col("node").alias("ring"), "node"), "drawn")
    sets = reach(edges, drawn).join(reach(back, drawn), ["ring", "node"])
    found = sets.groupBy("node").agg(F.min("ring").alias("ring"))
    return found.join(found.groupBy("ring").count().where("count > 1"), "ring", "left_semi").select("node", "ring")


def lineage(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, ancestor, depth): every node's line over ``links`` (node, to), of which a node has one at most; itself at depth 0.

    Pointer jumping: a round doubles the length of the known lines and of the jump behind them, so there are as many
    rounds as the logarithm of the longest line. In a circle each node is an ancestor of the others once.
    """
    links = materialise(links.select("node", "to").where("node IS NOT NULL AND to IS NOT NULL"), "links")
    known = nodes.select("node").unionByName(links.select(F.col("to").alias("node"))).distinct()
    lines = materialise(known.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("depth")), "lineage")
    jump, length, most = links, 1, lines.count()
    while not jump.isEmpty() and length <= most:
        beyond = lines.select(F.col("node").alias("to"), "ancestor", (F.col("depth") + length).alias("depth"))
        longer = lines.unionByName(jump.join(beyond, "to").select("node", "ancestor", "depth"))
        new = materialise(longer.groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "lineage")
        far = materialise(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("_far")), "to").select("node", F.col("_far").alias("to")), "links")
        discard(lines)
        discard(jump)
        lines, jump, length = new, far, 2 * length
    return lines.join(nodes.select("node").distinct(), "node", "left_semi")


def left_in_circles(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) that lie on cycles or between them: edges out of sources and into sinks are taken off until none can go."""
    cur = materialise(edges.select("src", "dst").distinct(), "peel")
    n = cur.count()
    while n:
        on = cur.join(cur.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        on = on.join(cur.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        nxt = materialise(on, "peel")
        discard(cur)
        cur, before = nxt, n
        n = cur.count()
        if n == before:
            break
    return cur


def acyclic(edges: DataFrame) -> bool:
    """Whether ``edges`` hold no cycle."""
    return left_in_circles(edges).isEmpty()
