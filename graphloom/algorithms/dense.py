"""Triangles, clustering, cores and trusses of undirected graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.skew import HEAVY_ROWS, heavy_threshold, join_counted, join_salted
from ..operators.traverse import EdgeTable
from ..plans.loops import Cutter
from . import one_task


def _oriented(edges: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Each undirected edge of a symmetric table once, from the smaller (degree, id).

    Out-degrees are then at most the square root of twice the number of edges, also
    for hubs, which bounds every adjacency array.
    """
    d = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    total, most = d.agg(F.sum("d"), F.max("d")).first()
    threshold = heavy_threshold(total or 0, heavy_rows)
    any_heavy = (most or 0) >= threshold
    e = join_counted(edges.filter("src < dst"), d.select("src", F.col("d").alias("ds"), F.col("d").alias("k")), "src", "k", threshold, any_heavy)
    e = join_counted(e, d.select(F.col("src").alias("dst"), F.col("d").alias("dd"), F.col("d").alias("k")), "dst", "k", threshold, any_heavy)
    up = F.col("ds") <= F.col("dd")
    return e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"))


def triangles_of(edges: DataFrame, cutter: Cutter | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(u, v, w): every triangle of a symmetric simple edge table once.

    A vertex to which many edges point meets its neighbours' arrays in salted
    parts, so no task takes all edges into a hub.
    """
    cutter = cutter or Cutter(edges.sparkSession, "triangles")
    oriented, _, seen = cutter.cut_counting(_oriented(edges, heavy_rows), n=F.count(F.lit(1)))
    into = oriented.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    threshold = heavy_threshold(seen["n"], heavy_rows)
    most = into.agg(F.max("n")).first()[0] or 0
    out = oriented.groupBy("u").agg(F.collect_list("v").alias("a"))
    pairs = out.select("u", "a", F.explode("a").alias("v"))
    per = out.select(F.col("u").alias("v"), F.col("a").alias("b")).join(into, "v")
    met = join_salted(pairs, per, ["v"], "n", threshold, most >= threshold)
    return met.select("u", "v", F.explode(F.array_intersect("a", "b")).alias("w"))


def triangles(g: Graph) -> DataFrame:
    """(u, v, w): every triangle once; direction, parallel edges and self-loops do not count."""
    return triangles_of(g.simple().edges)


def triangle_counts(g: Graph) -> DataFrame:
    """(id, triangles): the number of triangles that a vertex is part of."""
    t = triangles(g).select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return g.vertices.select("id").join(t, "id", "left").fillna(0, ["triangles"])


def triangle_total(g: Graph) -> DataFrame:
    """One row (triangles)."""
    return triangles(g).agg(F.count(F.lit(1)).alias("triangles"))


def clustering(g: Graph) -> DataFrame:
    """(id, coefficient): 2 T / (d (d - 1)) by simple undirected degree, 0 for degrees below 2."""
    d = g.simple().out_degrees()
    c = F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return triangle_counts(g).join(d, "id").select("id", c.alias("coefficient"))


def mean_clustering(g: Graph) -> DataFrame:
    """One row (coefficient): the average of the local coefficients."""
    return clustering(g).agg(F.avg("coefficient").alias("coefficient"))


def core_numbers_of(edges: DataFrame, start: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(id, core) of the vertices of a symmetric simple edge table.

    start: (id, core) that are at least the true core numbers, such as those of the
    graph before edges were taken from it; fewer rounds are needed then.

    Iterated h-index: a vertex takes the largest h such that h of its neighbours
    have at least h; started from the degrees this falls to the core number, in far
    fewer rounds than peeling.  Neighbour values are counted per (vertex, value) on
    the map side first, so that a hub receives one row per value and not one per
    neighbour; the values of the first round are degrees, of which there are at most
    the square root of 2E different ones.
    """
    cutter = Cutter(edges.sparkSession, "cores")
    table = EdgeTable(edges, cutter)
    first = table.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("core"))
    if start is not None:
        first = first.join(start.select("id", F.col("core").alias("most")), "id", "left").select("id", F.least("core", "most").alias("core"))
    state, path = cutter.cut(first)
    w = Window.partitionBy("id").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for _ in range(max_rounds):
        seen = table.spread(state).groupBy(F.col("dst").alias("id"), F.col("core").alias("x")).agg(F.count(F.lit(1)).alias("n"))
        counts = seen.join(state, "id").select("id", "core", F.least("x", "core").alias("x"), "n")
        best = counts.withColumn("n", F.sum("n").over(w)).groupBy("id", F.col("core").alias("was")).agg(F.max(F.least("x", "n")).alias("core"))
        before = path
        state, path, m = cutter.cut_counting(best.select("id", "core", (F.col("core") < F.col("was")).alias("c")), n=F.count_if(F.col("c")))
        state = state.drop("c")
        cutter.drop(before)
        if not m["n"]:
            break
    table.close()
    return state


def core_numbers(g: Graph) -> DataFrame:
    """(id, core): the largest k such that the vertex is in the k-core; 0 without edges."""
    return g.vertices.select("id").join(core_numbers_of(g.simple().edges), "id", "left").fillna(0, ["core"])


def core_edge_peel(g: Graph, most_edges: int = one_task.MOST_EDGES) -> DataFrame:
    """(src, dst, peel), src < dst: iterated removal of the innermost core.

    Edges at vertices of degree 1 get 1 and leave; then the innermost core of what
    is left gives its edges their core number and leaves, until no edge is left.
    Up to ``most_edges``, one task does it all by arrays.  More go by joins, until
    so few are left: an edge that has left does not matter for those that stay.
    """
    cutter = Cutter(g.vertices.sparkSession, "peel")
    once = g.edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    once, _, n = cutter.cut_counting(once, n=F.count(F.lit(1)))
    if n["n"] <= most_edges:
        return _peel_in_one_task(once, True, cutter)
    e = _both(once)
    ones = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.col("src").alias("one"))
    marked = e.join(ones.select(F.col("one").alias("src"), F.lit(1).alias("a")), "src", "left").join(ones.select(F.col("one").alias("dst"), F.lit(1).alias("b")), "dst", "left")
    edges, path = cutter.cut(marked.select("src", "dst", (F.col("a").isNotNull() | F.col("b").isNotNull()).alias("leaf")))
    done = [edges.filter("leaf and src < dst").select("src", "dst", F.lit(1).cast("bigint").alias("peel"))]
    left, _, n = cutter.cut_counting(edges.filter("not leaf").select("src", "dst"), n=F.count(F.lit(1)))
    cores = None
    while n["n"] > 2 * most_edges:
        cores, _, top = cutter.cut_counting(core_numbers_of(left, cores), k=F.max("core"))
        inner = cores.filter(F.col("core") == top["k"]).select("id")
        both = left.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi")
        part, _ = cutter.cut(both)
        done.append(part.filter("src < dst").withColumn("peel", F.lit(top["k"]).cast("bigint")))
        left, _, n = cutter.cut_counting(left.join(part, ["src", "dst"], "left_anti"), n=F.count(F.lit(1)))
    if n["n"]:
        done.append(_peel_in_one_task(left.filter("src < dst"), False, cutter))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _peel_in_one_task(edges: DataFrame, leaves: bool, cutter: Cutter) -> DataFrame:
    """(src, dst, peel) of undirected edges, each there once; ``leaves``: those at a vertex of degree 1 leave first."""
    return cutter.cut(edges.coalesce(1).mapInArrow(one_task.peel_batches(leaves), "src bigint, dst bigint, peel bigint"))[0]


def edge_support(edges: DataFrame) -> DataFrame:
    """(src, dst, support), src < dst: triangles per edge of a symmetric simple table; edges without one have 0."""
    t = triangles_of(edges).select(F.explode(F.array(F.struct(F.col("u").alias("p"), F.col("v").alias("q")), F.struct(F.col("u").alias("p"), F.col("w").alias("q")), F.struct(F.col("v").alias("p"), F.col("w").alias("q")))).alias("e"))
    n = t.groupBy(F.least("e.p", "e.q").alias("src"), F.greatest("e.p", "e.q").alias("dst")).agg(F.count(F.lit(1)).alias("support"))
    return edges.filter("src < dst").select("src", "dst").join(n, ["src", "dst"], "left").fillna(0, ["support"])


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")


def truss_numbers_of(edges: DataFrame, start: DataFrame | None = None, slack: int = 0, heavy_rows: int = HEAVY_ROWS, max_rounds: int = 10_000) -> DataFrame:
    """(src, dst, truss), src < dst, of a symmetric simple edge table.

    The triangles are listed once.  Every edge starts with its support + 2, which is
    at least its truss number, and takes the largest k for which k - 2 of its
    triangles have three edges of k or more; this falls to the truss number, in far
    fewer rounds than taking edges away for every k.  In a round a triangle sends its
    smallest value to its edges, where the values are counted on the map side.

    start: (src, dst, truss) of the graph before a batch, and ``slack`` the number of
    edges that the batch has added: an added edge raises no truss number by more than
    1, so the old numbers are bounds as well, and few rounds are needed.
    """
    cutter = Cutter(edges.sparkSession, "truss")
    low, high = F.array_sort(F.array("u", "v", "w")), ("a", "b", "c")
    t, t_path, seen = cutter.cut_counting(triangles_of(edges, cutter, heavy_rows).select(low.alias("t")).select(*(F.col("t")[i].alias(k) for i, k in enumerate(high))), n=F.count(F.lit(1)))
    sides = F.array(*(F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))))
    support = t.select(F.explode(sides).alias("e")).select("e.*").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("support"))
    first = support.withColumn("truss", F.col("support") + 2)
    if start is not None:
        first = first.join(start.select("src", "dst", F.col("truss").alias("old")), ["src", "dst"], "left").withColumn("truss", F.least("truss", F.greatest(F.col("old"), F.lit(2)) + slack)).drop("old")
    state, path, top = cutter.cut_counting(first, most=F.max("support"))
    threshold = heavy_threshold(seen["n"], heavy_rows)
    any_heavy = (top["most"] or 0) >= threshold
    w = Window.partitionBy("src", "dst").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for _ in range(max_rounds if seen["n"] else 0):
        met = t
        for i, (x, y) in enumerate((("a", "b"), ("a", "c"), ("b", "c"))):
            met = join_salted(met, state.select(F.col("src").alias(x), F.col("dst").alias(y), F.col("truss").alias(f"t{i}"), F.col("support").alias("k")), [x, y], "k", threshold, any_heavy)
        sent = met.select(F.least("t0", "t1", "t2").alias("x"), F.explode(sides).alias("e")).select("e.src", "e.dst", "x").groupBy("src", "dst", "x").agg(F.count(F.lit(1)).alias("n"))
        best = sent.withColumn("n", F.sum("n").over(w)).groupBy("src", "dst").agg(F.max(F.least("x", F.col("n") + 2)).alias("new"))
        before = path
        state, path, m = cutter.cut_counting(state.join(best, ["src", "dst"]).select("src", "dst", "support", F.col("new").alias("truss"), (F.col("new") < F.col("truss")).alias("c")), n=F.count_if(F.col("c")))
        state = state.drop("c")
        cutter.drop(before)
        if not m["n"]:
            break
    cutter.drop(t_path)
    every = edges.filter("src < dst").select("src", "dst")
    return every.join(state.select("src", "dst", "truss"), ["src", "dst"], "left").select("src", "dst", F.coalesce(F.col("truss").cast("int"), F.lit(2)).alias("truss"))


def truss(g: Graph, k: int) -> DataFrame:
    """(src, dst), src < dst: the edges of the k-truss, each in at least k - 2 triangles of it."""
    return truss_numbers(g).filter(F.col("truss") >= k).select("src", "dst")


def truss_numbers(g: Graph) -> DataFrame:
    """(src, dst, truss), src < dst: the largest k such that the edge is in the k-truss."""
    return truss_numbers_of(Cutter(g.vertices.sparkSession, "simple").cut(g.simple().edges)[0])


def truss_numbers_after(edges: DataFrame, before: DataFrame, inserted: DataFrame, erased: DataFrame) -> DataFrame:
    """Truss numbers after a batch, started from those before it.

    edges: the symmetric simple table before the batch; before: its (src, dst, truss);
    inserted, erased: (src, dst) in any order.  An edge that is in both stays or comes.
    """
    cutter = Cutter(edges.sparkSession, "truss-batch")
    norm = lambda e: e.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    old = edges.filter("src < dst").select("src", "dst")
    added, _, n = cutter.cut_counting(norm(inserted).join(old, ["src", "dst"], "left_anti"), n=F.count(F.lit(1)))
    kept = old.join(norm(erased).join(norm(inserted), ["src", "dst"], "left_anti"), ["src", "dst"], "left_anti")
    new, _ = cutter.cut(_both(kept.unionByName(added)))
    return truss_numbers_of(new, before, n["n"])


def max_truss(g: Graph) -> DataFrame:
    """One row (max_k): the largest k with a non-empty k-truss; null without edges."""
    return truss_numbers(g).agg(F.max("truss").alias("max_k"))


def support_after_erase(edges: DataFrame, support: DataFrame, erased: DataFrame) -> DataFrame:
    """Supports after a batch of deletions, from the triangles that it breaks only.

    edges: the symmetric table before the batch; support: its (src, dst, support);
    erased: (src, dst), src < dst.  Every broken triangle takes one from each of its
    edges that stay.  All edges of a broken triangle have an end in the batch, so
    the supports among such edges, before less after, are what each edge loses;
    these triangles are oriented by degree as well, so hubs cost no more.
    """
    cutter = Cutter(edges.sparkSession, "support-erase")
    near = erased.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
    around, _ = cutter.cut(_both(edges.join(near, "src", "left_semi").select("src", "dst")).distinct())
    stay = around.join(_both(erased), ["src", "dst"], "left_anti")
    lost = edge_support(stay).join(edge_support(around).withColumnRenamed("support", "was"), ["src", "dst"]).select("src", "dst", (F.col("was") - F.col("support")).alias("lost"))
    kept = support.join(erased, ["src", "dst"], "left_anti")
    return kept.join(lost, ["src", "dst"], "left").select("src", "dst", (F.col("support") - F.coalesce("lost", F.lit(0))).alias("support"))
