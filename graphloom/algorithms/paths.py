"""Breadth-first search and shortest paths as semi-naive loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.traverse import EdgeTable
from ..plans.loops import Cutter

#: Fixed value: the distance that stands for "not reached" in the 32-bit convention.
UNREACHED = 2_147_483_647
#: Level tables are merged into one when there are more of them.
MERGE_LEVELS = 8
#: Pull instead of push when the frontier has at least 1/PULL_RATIO of the vertices.
PULL_RATIO = 40


def _finish(g: Graph, reached: DataFrame, column: str, unreached: str | None) -> DataFrame:
    out = g.vertices.select("id").join(reached, "id", "left")
    return out.fillna(UNREACHED, [column]) if unreached == "max" else out


def bfs(g: Graph, source: int, max_depth: int | None = None, direction: str = "auto", unreached: str | None = None) -> DataFrame:
    """(id, distance): hops over out-edges from ``source`` for every vertex.

    direction: ``push`` expands the frontier over its out-edges; ``pull`` lets the
    unvisited vertices look for a visited in-neighbour; ``auto`` pulls while the
    frontier is a large part of the graph.  The result is the same.  Vertices that
    are not reached have a null distance, or 2147483647 with ``unreached="max"``;
    they include all vertices if the source is not in the graph.
    """
    if direction not in ("auto", "push", "pull"):
        raise ValueError(f"unknown direction {direction}")
    cutter = Cutter(g.vertices.sparkSession, "bfs")
    table = EdgeTable(g.edges.select("src", "dst").filter("src <> dst").distinct(), cutter)
    ids, _, seen = cutter.cut_counting(g.vertices.select("id"), n=F.count(F.lit(1)))
    frontier, _, hit = cutter.cut_counting(ids.filter(F.col("id") == source).select("id", F.lit(0).alias("distance")), n=F.count(F.lit(1)))
    levels, depth = [frontier], 0
    while hit["n"] and (max_depth is None or depth < max_depth):
        depth += 1
        visited = levels[0]
        for x in levels[1:]:
            visited = visited.unionByName(x)
        if direction == "pull" or direction == "auto" and hit["n"] * PULL_RATIO >= seen["n"]:
            waiting = ids.join(visited, "id", "left_anti")
            seen_by = table.edges.join(waiting.withColumnRenamed("id", "dst"), "dst", "left_semi").join(frontier.select(F.col("id").alias("src")), "src", "left_semi")
            found = seen_by.select(F.col("dst").alias("id")).distinct()
        else:
            found = table.spread(frontier.select("id")).select(F.col("dst").alias("id")).distinct().join(visited, "id", "left_anti")
        frontier, _, hit = cutter.cut_counting(found.withColumn("distance", F.lit(depth)), n=F.count(F.lit(1)))
        levels.append(frontier)
        if len(levels) > MERGE_LEVELS:
            merged = levels[0]
            for x in levels[1:]:
                merged = merged.unionByName(x)
            levels = [cutter.cut(merged)[0]]
    table.close()
    reached = levels[0]
    for x in levels[1:]:
        reached = reached.unionByName(x)
    return _finish(g, reached, "distance", unreached)


def bfs_summary(g: Graph, distances: DataFrame) -> DataFrame:
    """One row (visited_nodes, visited_edges, levels): the out-edges of the visited, and the last distance + 1."""
    r = distances.filter("distance is not null").join(g.out_degrees(), "id")
    return r.agg(F.count(F.lit(1)).alias("visited_nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("visited_edges"), (F.max("distance") + 1).alias("levels"))


def bfs_edge_kinds(g: Graph, distances: DataFrame) -> DataFrame:
    """(level, n_parent, n_peer, n_valid, n_not_valid) of the edges out of each level.

    parent: to the level before; peer: inside the level; valid: one per vertex that
    the level discovers; not_valid: the other edges to the next level.
    """
    d = distances.filter("distance is not null")
    e = g.edges.join(d.select(F.col("id").alias("src"), F.col("distance").alias("level")), "src").join(d.select(F.col("id").alias("dst"), F.col("distance").alias("to")), "dst")
    forward = F.col("to") == F.col("level") + 1
    new = d.filter("distance > 0").groupBy((F.col("distance") - 1).alias("level")).agg(F.count(F.lit(1)).alias("n_valid"))
    kinds = e.groupBy("level").agg(F.count_if(F.col("to") < F.col("level")).alias("n_parent"), F.count_if(F.col("to") == F.col("level")).alias("n_peer"), F.count_if(forward).alias("f"))
    return kinds.join(new, "level", "left").fillna(0, ["n_valid"]).select("level", "n_parent", "n_peer", "n_valid", (F.col("f") - F.col("n_valid")).alias("n_not_valid"))


def sssp(g: Graph, source: int, weight: str | Column = "weight", max_rounds: int = 10_000, unreached: str | None = None) -> DataFrame:
    """(id, distance): the least sum of weights from ``source``.

    Only vertices whose distance fell take part in the next round.  Edges with a
    null weight are not passable; weights must not be negative.
    """
    w = F.col(weight) if isinstance(weight, str) else weight
    cutter = Cutter(g.vertices.sparkSession, "sssp")
    e = g.edges.select("src", "dst", w.alias("w")).filter("w is not null and src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))
    table = EdgeTable(e, cutter)
    if table.edges.filter("w < 0").limit(1).count():
        raise ValueError("a weight is negative")
    kind = table.edges.schema["w"].dataType
    kind = "double" if kind.typeName() in ("float", "double") else "bigint"
    state, path, seen = cutter.cut_counting(g.vertices.filter(F.col("id") == source).select("id", F.lit(0).cast(kind).alias("distance"), F.lit(True).alias("fresh")), n=F.count_if(F.col("fresh")))
    rounds = 0
    while seen["n"]:
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"distances still fall after {max_rounds} rounds")
        offers = table.spread(state.filter("fresh").select("id", "distance")).select(F.col("dst").alias("id"), (F.col("distance") + F.col("w")).cast(kind).alias("distance"), F.lit(None).cast(kind).alias("old"))
        merged = state.select("id", "distance", F.col("distance").alias("old")).unionByName(offers).groupBy("id").agg(F.min("distance").alias("distance"), F.min("old").alias("old"))
        before = path
        state, path, seen = cutter.cut_counting(merged.select("id", "distance", (F.col("old").isNull() | (F.col("distance") < F.col("old"))).alias("fresh")), n=F.count_if(F.col("fresh")))
        cutter.drop(before)
    table.close()
    return _finish(g, state.select("id", "distance"), "distance", unreached)
