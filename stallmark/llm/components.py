"""Connected components over very many pairs by low-diameter decomposition.

Every vertex draws a start time from a shifted exponential distribution; clusters grow one hop a round from the
vertices that start early, and a vertex joins the cluster that reaches it first. After a few rounds every cluster is
contracted to one super-vertex, the edges between clusters are kept once, and the decomposition recurses on them until
no edge is left. The assignments are then composed from the last level down to the vertices. A cluster never leaves its
component whatever the number of rounds, so the result is exact; the drawn times only decide how fast it is reached.
A level leaves a constant fraction of the vertices that still have edges, so the number of levels is logarithmic, also
for long chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.operators.skew import find_hot, join_with_hot
from stallmark.session import cut, discard, release

ROUNDS = 3
BETA = 0.2


def start_time(vertex: Column, seed: int) -> Column:
    """Start time of a vertex: minus an exponential shift of rate BETA, drawn from the vertex and the seed."""
    u = (F.pmod(F.xxhash64(vertex, F.lit(seed)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    return F.log(u) / F.lit(BETA)


def _decompose(edges: DataFrame, hot: DataFrame | None, seed: int, rounds: int) -> DataFrame:
    """Clusters of one level: ``v``, ``cluster``. ``edges`` holds ``v``, ``w``, ``hop``: both directions with hop 1 and
    every vertex with itself and hop 0, so that one join and one aggregation are a round."""
    reach = edges.filter(F.col("hop") == 0).select("v", start_time(F.col("v"), seed).alias("at"), F.col("v").alias("c"))
    for _ in range(rounds):
        sent = join_with_hot(edges, reach, ["v"], hot, F.col("w"))
        reach = sent.groupBy(F.col("w").alias("v")).agg(F.min(F.struct((F.col("at") + F.col("hop")).alias("at"), "c")).alias("r")).select("v", "r.at", "r.c")
    return reach.select("v", F.col("c").alias("cluster"))


def connected_components(vertices: DataFrame | None, pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``id``, ``group_id`` (the smallest id of the group) for each distinct non-null ``id`` of ``vertices`` and ``pairs``.

    ``pairs`` has the links in its first two columns, in any order and as often as they come, and is read once; links
    with a null side or with both sides equal link nothing, but the ids in them come out. ``vertices`` may be None.
    Empty inputs give no rows.
    """
    a, b = pairs.columns[:2]
    ends = cut(pairs.select(F.col(a).alias("v"), F.col(b).alias("w")).filter(F.col("v").isNotNull() | F.col("w").isNotNull()).select(F.least("v", "w").alias("v"), F.greatest("v", "w").alias("w")).distinct())
    one = cut(ends.filter(F.col("v") < F.col("w")))  # least and greatest skip null: a link with a null side has both equal
    levels: list[tuple[DataFrame, int]] = []
    while total := one.count():
        both = one.select("v", "w", F.lit(1).alias("hop")).unionByName(one.select(F.col("w").alias("v"), F.col("v").alias("w"), F.lit(1).alias("hop")))
        hot = find_hot(both, ["v"], 2 * total)  # by degree, so it serves both ends of an edge
        loops = both.select("v").distinct().select("v", F.col("v").alias("w"), F.lit(0).alias("hop"))
        edges = cut(both.unionByName(loops))
        to = cut(_decompose(edges, hot, len(levels) + 1, rounds))
        levels.append((to, 2 * total))
        left = join_with_hot(one, to, ["v"], hot, F.col("w")).select(F.col("cluster").alias("a"), F.col("w").alias("v"))
        right = join_with_hot(left, to.withColumnRenamed("cluster", "b"), ["v"], hot, F.col("a"))
        last, one = one, cut(right.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("w")).distinct())
        discard(last, edges, *([hot] if hot is not None else []))
        if len(levels) % 3 == 0:
            release(pairs.sparkSession)
    named_ends = ends.select(F.explode(F.array("v", "w")).alias("id"))
    ids = named_ends if vertices is None else vertices.select(F.col(vertices.columns[0]).alias("id")).filter(F.col("id").isNotNull()).unionByName(named_ends)
    ids = ids.distinct()
    if not levels:
        return ids.select("id", F.col("id").alias("group_id"))
    # compose: what a vertex of level i became at the end is what its cluster became
    end = levels[-1][0]
    for to, bound in reversed(levels[:-1]):
        known = end.select(F.col("v").alias("cluster"), F.col("cluster").alias("last"))
        end = join_with_hot(to, known, ["cluster"], find_hot(to, ["cluster"], bound), F.col("v"), "left").select("v", F.coalesce("last", "cluster").alias("cluster"))
    end = cut(end)
    discard(*[to for to, _ in levels])
    smallest = end.groupBy("cluster").agg(F.min("v").alias("group_id"))
    named = join_with_hot(end, smallest, ["cluster"], find_hot(end, ["cluster"], levels[0][1]), F.col("v")).select(F.col("v").alias("id"), "group_id")
    return ids.join(named, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
