"""Entity graph: vertices, edges, components, component and node summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmark.operators.skew import FLOOR, find_hot, join_with_hot
from stallmark.session import cut, discard, release


#: So many edges at most (counted before) are solved in one task: a few MB, less than the rounds cost.
ONE_TASK = 200_000


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over all edges of the task, the smaller id as root."""
    parent: dict = {}

    def find(v):
        top = v
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[v] != top:
            parent[v], v = top, parent[v]
        return top

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            x, y = find(a), find(b)
            if x < y:
                parent[y] = x
            elif y < x:
                parent[x] = y
    ids = list(parent)
    if ids:
        yield pd.DataFrame({"id": ids, "component": [find(v) for v in ids]})


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``id``, ``component`` (smallest id) for the ends of the edges ``a``, ``b``.

    Alternating large-star and small-star contraction: every round points vertices to the smallest vertex they know,
    the number of rounds is logarithmic and every round is two pre-aggregated shuffles. Up to ``one_task`` edges are
    solved in one task, with the same result.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    seen, done = None, 0
    while True:
        # the number of edges and two checksums say whether a round changed anything
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if state == seen:
            break
        if seen is None and state[0] <= one_task:
            kind = dict(e.dtypes)["a"]
            return cut(e.coalesce(1).mapInPandas(_solve, f"id {kind}, component {kind}"))
        seen, total, old = state, 2 * state[0], e
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours of a vertex go to its smallest neighbour (or itself)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hot = find_hot(both, ["a"], total)
        down = join_with_hot(both, low, ["a"], hot, F.col("b")).filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        if total > FLOOR:  # hot keys are looked for, so the pairs are read more than once
            down = cut(down)
        # small star: a vertex and its smaller neighbours go to the smallest of them
        least = down.groupBy("b").agg(F.min("a").alias("m"))
        star = join_with_hot(down, least, ["b"], find_hot(down, ["b"], total), F.col("a"))
        e = cut(star.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(star.select(F.col("m").alias("a"), "b")).filter("a < b").distinct())
        discard(old, down, *([hot] if hot is not None else []))
        done += 1
        if done % 4 == 0:
            release(edges.sparkSession)
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def component_summary(member: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Size, cities, models, price range and inner edges of each component, ranked by size and smallest id."""
    n = member.join(nodes, "id", "left").groupBy("component").agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct("city").alias("cities"), F.count_distinct("model").alias("models"), F.min("price").alias("min_price"), F.max("price").alias("max_price")
    )
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(member.select(F.col("id").alias("a"), "component"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, "component", "left").select("component", "size", "cities", "models", "min_price", "max_price", F.coalesce("edges", F.lit(0)).alias("edges"), (F.col("cities") > 1).alias("cross_city"))


def node_features(edges: DataFrame) -> DataFrame:
    """Degree and number of edges per type of each vertex; edges ``a``, ``b``, ``kind`` count once a pair and kind."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind").filter("a <> b").distinct()
    both = e.select("a", "b", "kind").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind"))
    per = both.groupBy("a", "b").agg(F.max(F.when(F.col("kind") == "exact", 1).otherwise(0)).alias("x"), F.count(F.lit(1)).alias("kinds"))
    return per.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("x").alias("exact_neighbours"), F.sum("kinds").alias("edges"))
