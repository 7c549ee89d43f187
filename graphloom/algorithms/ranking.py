"""PageRank, Katz centrality and betweenness, static and after batch updates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.ordering import least_by
from ..operators.skew import HEAVY_ROWS
from ..operators.traverse import EdgeTable
from ..operators.vertex_vectors import MOST_VERTICES, EdgeBlocks, dense_ids, vertex_table
from ..plans.loops import Cutter
from . import all_roots


def page_rank(g: Graph, rounds: int = 20, threshold: float | None = 0.001, damping: float = 0.85, mode: str = "push", start: DataFrame | None = None) -> DataFrame:
    """(id, rank) after at most ``rounds`` rounds.

    Every vertex starts with 1/n, or with ``start.rank`` (a warm start; vertices it
    lacks get 1/n).  A vertex gives rank/out-degree along each out-edge; the rank of
    vertices without out-edges is lost.  The loop ends when the sum of absolute
    changes is at most ``threshold`` (``None``: all rounds run).
    mode: ``push`` sends to the target of an edge; ``pull`` gives the source of an
    edge the share of its target.
    """
    if mode not in ("push", "pull"):
        raise ValueError(f"unknown mode {mode}")
    cutter = Cutter(g.vertices.sparkSession, "pagerank")
    e = g.edges.select("src", "dst")
    base, _, seen = cutter.cut_counting(g.out_degrees(), n=F.count(F.lit(1)))
    n = seen["n"]
    if not n:
        return base.select("id", F.lit(0.0).alias("rank"))
    table = EdgeTable(e if mode == "push" else e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), cutter)
    first = base.withColumn("rank", F.lit(1.0 / n))
    if start is not None:
        first = base.join(start.select("id", F.col("rank").alias("warm")), "id", "left").select("id", "degree", F.coalesce("warm", F.lit(1.0 / n)).alias("rank"))
    state, path = cutter.cut(first)
    for _ in range(rounds):
        share = state.filter("degree > 0").select("id", (F.col("rank") / F.col("degree")).alias("share"))
        got = table.spread(share).groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        new = state.join(got, "id", "left").select("id", "degree", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("was"))
        before = path
        state, path, seen = cutter.cut_counting(new, change=F.sum(F.abs(F.col("rank") - F.col("was"))))
        state = state.drop("was")
        cutter.drop(before)
        if threshold is not None and seen["change"] <= threshold:
            break
    table.close()
    return state.select("id", "rank")


def katz(g: Graph, rounds: int = 50, top_k: int | None = None, max_degree: int | None = None, most_vertices: int = MOST_VERTICES) -> DataFrame:
    """(id, score, lower, upper, paths) of an undirected graph after up to ``rounds`` - 1 rounds.

    alpha = 1 / (max degree + 1).  In round i the number of paths of length i into a
    vertex is the sum over its neighbours, and alpha^i times it is added to the
    score.  lower and upper bound the score of the endless sum.  With ``top_k`` the
    loop ends as soon as at most that many vertices can still be among the first
    ``top_k``: those whose upper bound exceeds the lower bound at rank ``top_k``.
    Path counts are doubles.  Without ``top_k`` the counts of up to ``most_vertices``
    are vectors (see :class:`EdgeBlocks`), so a round is one job without a shuffle.
    """
    cutter = Cutter(g.vertices.sparkSession, "katz")
    edges, _, size = cutter.cut_counting(g.edges.select("src", "dst"), n=F.count(F.lit(1)))
    if max_degree is None:
        max_degree = Graph(g.vertices, edges).out_degrees().agg(F.max("degree")).first()[0] or 0
    alpha = 1.0 / (max_degree + 1)
    if top_k is None and (ids := dense_ids(g.vertices, most_vertices)) is not None:
        total = np.zeros(len(ids))
        counts = np.ones(len(ids))
        for i, counts in enumerate(_level_vectors(EdgeBlocks(edges, size["n"], ids, cutter), rounds - 1)):
            total += alpha**i * counts if i else 0.0
        # the bounds of the last round; 0 before the first
        tail = alpha**rounds if rounds > 1 else 0.0
        bound = lambda rest: F.col("score") + F.lit(tail / rest if tail else 0.0) * F.col("paths")
        found = vertex_table(g.vertices.sparkSession, ids, {"score": total, "paths": counts}, cutter)
        return found.select("id", "score", bound(1 - alpha).alias("lower") if alpha < 1 else F.col("score").alias("lower"), bound(1 - alpha * max_degree).alias("upper"), "paths")
    table = EdgeTable(edges, cutter)
    state, path = cutter.cut(g.vertices.select("id", F.lit(0.0).alias("score"), F.lit(1.0).alias("paths"), F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper"), F.lit(True).alias("active")))
    for i in range(1, rounds):
        got = table.spread(state.select("id", "paths")).groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("got"))
        paths = F.coalesce("got", F.lit(0.0))
        tail = alpha ** (i + 1)
        score = F.col("score") + F.lit(alpha**i) * paths
        new = state.join(got, "id", "left").select("id", score.alias("score"), paths.alias("paths"), (score + F.lit(tail / (1 - alpha) if alpha < 1 else 0.0) * paths).alias("lower"), (score + F.lit(tail / (1 - alpha * max_degree)) * paths).alias("upper"), "active")
        before = path
        state, path = cutter.cut(new)
        cutter.drop(before)
        if top_k is not None:
            ranked = least_by(state.filter("active").select("id", "lower"), [-F.col("lower"), F.col("id")], top_k).agg(F.min("lower"), F.count(F.lit(1))).first()
            if ranked[1] < top_k:
                break
            bound = F.col("active") & ((F.col("upper") > F.lit(ranked[0])) | (F.col("lower") >= F.lit(ranked[0])))
            before = path
            state, path, seen = cutter.cut_counting(state.withColumn("active", bound), n=F.count_if(F.col("active")))
            cutter.drop(before)
            if seen["n"] <= top_k:
                break
    table.close()
    return state.select("id", "score", "lower", "upper", "paths")


def katz_levels(g: Graph, rounds: int, max_degree: int, cutter: Cutter | None = None) -> list[DataFrame]:
    """Path counts (id, paths) per level 0 .. rounds, the state of dynamic Katz."""
    cutter = cutter or Cutter(g.vertices.sparkSession, "katz-levels")
    table = EdgeTable(g.edges.select("src", "dst"), cutter)
    levels = [cutter.cut(g.vertices.select("id", F.lit(1.0).alias("paths")))[0]]
    for _ in range(rounds):
        got = table.spread(levels[-1]).groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("got"))
        levels.append(cutter.cut(g.vertices.select("id").join(got, "id", "left").select("id", F.coalesce("got", F.lit(0.0)).alias("paths")))[0])
    table.close()
    return levels


def katz_update(levels: list[DataFrame], old_edges: DataFrame, inserted: DataFrame, erased: DataFrame) -> list[DataFrame]:
    """The levels after a batch, from their changes only.

    The change of level i is what the changed counts of level i-1 send over the new
    edges, and what the inserted (plus) and erased (minus) edges send of the old
    counts.  Vertices that no change reaches are not recomputed.  All arguments
    hold both directions of an undirected edge.
    """
    cutter = Cutter(old_edges.sparkSession, "katz-update")
    signed = inserted.select("src", "dst", F.lit(1.0).alias("sign")).unionByName(erased.select("src", "dst", F.lit(-1.0).alias("sign")))
    signed, _ = cutter.cut(signed)
    delta = None
    out = [levels[0]]
    for old_below, old in zip(levels, levels[1:], strict=False):
        sent = signed.join(old_below.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("sign") * F.col("paths")).alias("d"))
        if delta is not None:
            now = old_edges.select("src", "dst", F.lit(1.0).alias("sign")).unionByName(signed)
            sent = sent.unionByName(now.join(delta.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("sign") * F.col("d")).alias("d")))
        delta, _ = cutter.cut(sent.groupBy("id").agg(F.sum("d").alias("d")).filter("d <> 0"))
        out.append(cutter.cut(old.join(delta, "id", "left").select("id", (F.col("paths") + F.coalesce("d", F.lit(0.0))).alias("paths")))[0])
    return out


def katz_after(old: Graph, inserted: DataFrame, erased: DataFrame, rounds: int, max_degree: int, most_vertices: int = MOST_VERTICES) -> DataFrame:
    """(id, score) after a batch: the levels of ``old``, updated by their changes only.

    As :func:`katz_scores` of :func:`katz_update` of :func:`katz_levels`, but up to
    ``most_vertices`` the levels are vectors, and each is updated and added to the
    score as soon as it stands, so that none is stored.
    """
    spark = old.vertices.sparkSession
    ids = dense_ids(old.vertices, most_vertices)
    if ids is None:
        return katz_scores(katz_update(katz_levels(old, rounds, max_degree), old.edges, inserted, erased), max_degree)
    cutter = Cutter(spark, "katz-after")
    edges, _, size = cutter.cut_counting(old.edges.select("src", "dst"), n=F.count(F.lit(1)))
    signed = inserted.select("src", "dst", F.lit(1.0).alias("weight")).unionByName(erased.select("src", "dst", F.lit(-1.0).alias("weight")))
    signed, _, changed = cutter.cut_counting(signed, n=F.count(F.lit(1)))
    table = EdgeBlocks(edges, size["n"], ids, cutter)
    levels = _level_vectors(table, rounds)
    score, alpha = np.zeros(len(ids)), 1.0 / (max_degree + 1)
    for i, level in enumerate(_updated_vectors(levels, table, EdgeBlocks(signed, changed["n"], ids, cutter, weighted=True))):
        score += alpha**i * level if i else 0.0
    return vertex_table(spark, ids, {"score": score}, cutter)


def _level_vectors(table: EdgeBlocks, rounds: int) -> Iterator[np.ndarray]:
    """Path counts of the levels 0 .. rounds."""
    level = np.ones(table.size)
    yield level
    for _ in range(rounds):
        level = table.times(level)
        yield level


def _updated_vectors(levels: Iterable[np.ndarray], old: EdgeBlocks, signed: EdgeBlocks) -> Iterator[np.ndarray]:
    """The levels after a batch of signed edges, as in :func:`katz_update`."""
    below, delta = None, np.zeros(old.size)
    for level in levels:
        if below is not None:
            delta = (old.times(delta) if delta.any() else 0.0) + signed.times(below + delta)
        yield level + delta
        below = level


def katz_scores(levels: list[DataFrame], max_degree: int) -> DataFrame:
    """(id, score) of the levels 1 .. rounds."""
    alpha = 1.0 / (max_degree + 1)
    parts = None
    for i, level in enumerate(levels[1:], 1):
        p = level.select("id", (F.lit(alpha**i) * F.col("paths")).alias("s"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy("id").agg(F.sum("s").alias("score"))


def random_roots(g: Graph, k: int, seed: int = 0) -> DataFrame:
    """``k`` distinct vertices, chosen by a seeded hash."""
    return least_by(g.vertices.select("id"), [F.md5(F.concat_ws("-", "id", F.lit(seed))), F.col("id")], k)


def betweenness(g: Graph, roots: DataFrame | None = None, max_rounds: int = 10_000, state_rows: int = 200_000_000, symmetric: bool = False, heavy_rows: int = HEAVY_ROWS, most_edges: int = all_roots.MOST_EDGES) -> DataFrame:
    """(id, bc): Brandes' dependencies summed over all roots, or over ``roots.id``.

    Over all roots of a graph of up to ``most_edges`` distinct edges and with BIGINT ids,
    every task holds the graph in arrays and takes a share of the roots.  Else the state is one row per
    (root, reached vertex).  As many roots run together as
    fit ``state_rows`` if each reaches everything (at least one), and the levels of
    such a batch are removed after it.  symmetric: every edge is there in both directions, so that a
    vertex can only be met again from the last two levels.  Not halved for
    undirected graphs, not normalised.  Parallel edges count as one and self-loops
    not at all.  Vertices on no path have 0.
    """
    cutter = Cutter(g.vertices.sparkSession, "betweenness")
    edges = g.edges.select("src", "dst").filter("src <> dst").distinct()
    if roots is None and {t for k, t in edges.dtypes} | {t for k, t in g.vertices.dtypes if k == "id"} == {"bigint"}:
        edges, _, seen = cutter.cut_counting(edges, n=F.count(F.lit(1)))
        if seen["n"] <= most_edges:
            total, _ = cutter.cut(all_roots.betweenness_of(edges, g.vertices, max_rounds).select("id", F.col("delta").alias("bc")))
            return g.vertices.select("id").join(total, "id", "left").fillna(0.0, ["bc"])
    table = EdgeTable(edges, cutter, heavy_rows)
    start, _, seen = cutter.cut_counting((roots if roots is not None else g.vertices).select("id").distinct(), n=F.count(F.lit(1)))
    batches = -(-seen["n"] // max(1, state_rows // max(1, g.vertices.count())))
    sums = None
    for i in range(batches):
        mine = start.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == i)
        part = _dependencies(table, mine, cutter, max_rounds, symmetric)
        if part is not None:
            sums = part if sums is None else sums.unionByName(part)
    table.close()
    if sums is None:
        return g.vertices.select("id", F.lit(0.0).alias("bc"))
    total = sums.groupBy("id").agg(F.sum("delta").alias("bc"))
    return g.vertices.select("id").join(total, "id", "left").fillna(0.0, ["bc"])


def _dependencies(table: EdgeTable, roots: DataFrame, cutter: Cutter, max_rounds: int, symmetric: bool) -> DataFrame | None:
    """(id, delta) summed over the roots of a batch; None if they reach nothing."""
    level, path, seen = cutter.cut_counting(roots.select(F.col("id").alias("root"), "id", F.lit(1.0).alias("sigma")), n=F.count(F.lit(1)))
    levels, paths = [level], [path]
    while seen["n"]:
        sent = table.spread(levels[-1], many=True).groupBy("root", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        for old in levels[-2:] if symmetric else levels:
            sent = sent.join(old.select("root", "id"), ["root", "id"], "left_anti")
        level, path, seen = cutter.cut_counting(sent, n=F.count(F.lit(1)))
        paths.append(path)
        if seen["n"]:
            levels.append(level)
        if len(levels) > max_rounds:
            raise RuntimeError("too many levels")
    delta = levels[-1].select("root", "id", "sigma", F.lit(0.0).alias("delta"))
    total = None
    for above in reversed(levels[:-1]):
        deeper = delta.select("root", F.col("id").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        got = table.spread(above, many=True).join(deeper, ["root", "dst"]).groupBy("root", F.col("src").alias("id")).agg(F.sum("share").alias("share"))
        here, path = cutter.cut(above.join(got, ["root", "id"], "left").select("root", "id", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta")))
        paths.append(path)
        part = here.filter("root <> id").select("id", "delta")
        total = part if total is None else total.unionByName(part)
        delta = here
    if total is not None:
        total, _ = cutter.cut(total.groupBy("id").agg(F.sum("delta").alias("delta")))
    cutter.drop(*paths)
    return total
