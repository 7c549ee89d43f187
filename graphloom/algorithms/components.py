"""Connected components, strongly connected components and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import floor_log2
from ..graph import Graph
from ..operators.ordering import with_index
from ..operators.skew import HEAVY_ROWS, heavy_threshold, join_any, join_counted
from ..operators.traverse import EdgeTable
from ..plans.loops import Cutter


def weak_labels(g: Graph, heavy_rows: int = HEAVY_ROWS, max_rounds: int = 200) -> DataFrame:
    """(id, component): the smallest id that is linked with a vertex, edges taken both ways.

    Hooking and shortcutting: each vertex points to a smaller one; in a round the
    targets of its neighbours' targets are offered to it and to its own target, and
    every pointer is replaced by that of its target.  The number of rounds grows
    with the logarithm of the diameter.  The target of a giant component is a hot
    key and is joined by broadcast.
    """
    cutter = Cutter(g.vertices.sparkSession, "components")
    table = EdgeTable(g.simple().edges, cutter, heavy_rows)
    state, path = cutter.cut(g.vertices.select("id", F.col("id").alias("f"), F.col("id").alias("gf")))
    for _ in range(max_rounds):
        best = table.spread(state.select("id", "gf")).groupBy(F.col("dst").alias("id")).agg(F.min("gf").alias("m"))
        own = state.join(best, "id", "left")
        offers = own.select(F.explode(F.array(F.struct("id", F.least("f", "gf", "m").alias("to")), F.struct(F.col("f").alias("id"), F.least("gf", "m").alias("to")))).alias("o")).select("o.*")
        f, f_path, seen = cutter.cut_counting(offers.groupBy("id").agg(F.min("to").alias("f")), n=F.count(F.lit(1)))
        counts, _, most = cutter.cut_counting(f.groupBy("f").agg(F.count(F.lit(1)).alias("n")), n=F.max("n"))
        threshold = heavy_threshold(seen["n"], heavy_rows)
        targets = f.select(F.col("id").alias("f"), F.col("f").alias("gf")).join(counts, "f")
        grand = join_counted(f, targets, "f", "n", threshold, (most["n"] or 0) >= threshold)
        joined = grand.join(state.select("id", F.col("gf").alias("was")), "id")
        before = path
        state, path, changed = cutter.cut_counting(joined.select("id", "f", "gf", (F.col("gf") != F.col("was")).alias("c")), n=F.count_if(F.col("c")))
        state = state.drop("c")
        cutter.drop(before, f_path)
        if not changed["n"]:
            table.close()
            return state.select("id", F.col("gf").alias("component"))
    raise RuntimeError(f"not stable after {max_rounds} rounds")


def connected_components(g: Graph, labels: str = "min", **kw) -> DataFrame:
    """(id, component) of an undirected graph.

    labels: ``min`` names a component by its smallest id; ``max`` by its largest id
    + 1, but 0 for the component of the vertex of the largest degree (the smallest
    such vertex).
    """
    found = weak_labels(g, **kw)
    if labels == "min":
        return found
    if labels != "max":
        raise ValueError(f"unknown labels {labels}")
    names = found.groupBy("component").agg((F.max("id") + 1).alias("name"))
    giant = found.join(g.max_degree().select("id"), "id", "left_semi").select(F.col("component").alias("giant"))
    names = names.join(F.broadcast(giant), F.col("component") == F.col("giant"), "left").select("component", F.when(F.col("giant").isNotNull(), 0).otherwise(F.col("name")).alias("name"))
    return found.join(names, "component").select("id", F.col("name").alias("component"))


def component_ids(found: DataFrame) -> DataFrame:
    """(component, component_id, size): components numbered 0, 1, ... by their smallest member."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return with_index(sizes, [F.col("component")], "component_id").select("component", "component_id", "size")


def component_statistics(found: DataFrame) -> DataFrame:
    """One row (n_components, largest, n_trivial)."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("n_components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.count_if(F.col("size") == 1).alias("n_trivial"))


def component_histogram(found: DataFrame) -> DataFrame:
    """(log2_size, n_components): components by the logarithm of their size, rounded down."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy(floor_log2(F.col("size")).cast("int").alias("log2_size")).agg(F.count(F.lit(1)).alias("n_components"))


def strong_components(g: Graph, heavy_rows: int = HEAVY_ROWS, max_rounds: int = 10_000) -> DataFrame:
    """(id, component): the smallest id of the strongly connected component of a vertex.

    Forward-backward colouring: vertices without an in- or out-edge among the
    remaining ones are components of their own; otherwise the smallest id that
    reaches a vertex is its colour, and a component is what reaches the root of a
    colour from inside it.  Found components leave the graph, and the rest repeats.
    Edges of a hub meet its state by broadcast.  Stages are removed as soon as the
    next one stands.
    """
    spark = g.vertices.sparkSession
    cutter = Cutter(spark, "strong")
    edges, edges_path, size = cutter.cut_counting(g.edges.select("src", "dst").filter("src <> dst").distinct(), n=F.count(F.lit(1)))
    left, left_path, n = cutter.cut_counting(g.vertices.select("id"), n=F.count(F.lit(1)))
    done = []
    for _ in range(max_rounds):
        if not n["n"]:
            break
        core = left.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        core, core_path, kept = cutter.cut_counting(core, n=F.count(F.lit(1)))
        if kept["n"] < n["n"]:
            part, _ = cutter.cut(left.join(core, "id", "left_anti").select("id", F.col("id").alias("component")))
            done.append(part)
        else:
            colour, colour_path = _flow(edges, size["n"], core.select("id", F.col("id").alias("value")), cutter, heavy_rows)
            value = lambda end, name: colour.select(F.col("id").alias(end), F.col("value").alias(name))
            join = (lambda e, v, end: join_any(e, v, end, heavy_rows, edges)) if size["n"] >= heavy_rows else (lambda e, v, end: e.join(v, end))
            same = join(join(edges, value("src", "a"), "src"), value("dst", "b"), "dst").filter("a = b")
            back, back_path, inside = cutter.cut_counting(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), n=F.count(F.lit(1)))
            found, found_path = _reach(back, inside["n"], colour.filter("id = value").select("id"), cutter, heavy_rows)
            part, _ = cutter.cut(colour.join(found, "id", "left_semi").select("id", F.col("value").alias("component")))
            done.append(part)
            whole, whole_path = core, core_path
            core, core_path, kept = cutter.cut_counting(whole.join(part, "id", "left_anti"), n=F.count(F.lit(1)))
            cutter.drop(colour_path, back_path, found_path, whole_path)
        before = edges_path
        edges, edges_path, size = cutter.cut_counting(edges.join(core.select(F.col("id").alias("src")), "src", "left_semi").join(core.select(F.col("id").alias("dst")), "dst", "left_semi"), n=F.count(F.lit(1)))
        cutter.drop(before, left_path)
        left, left_path, n = core, core_path, kept
    cutter.drop(edges_path, left_path)
    out = spark.createDataFrame([], "id bigint, component bigint")
    for x in done:
        out = out.unionByName(x)
    return out


class _Out:
    """Joins a vertex state to the ``n`` edges out of it, many times; hubs take the counted join."""

    def __init__(self, edges: DataFrame, n: int, cutter: Cutter, heavy_rows: int):
        self.edges, self.path, self.any_heavy = edges, None, False
        if n < heavy_rows:
            return
        self.degrees, self.path, seen = cutter.cut_counting(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")), total=F.sum("n"), most=F.max("n"))
        self.threshold = heavy_threshold(seen["total"] or 0, heavy_rows)
        self.any_heavy = (seen["most"] or 0) >= self.threshold

    def join(self, state: DataFrame) -> DataFrame:
        s = state.withColumnRenamed("id", "src")
        return join_counted(self.edges, s.join(self.degrees, "src"), "src", "n", self.threshold) if self.any_heavy else self.edges.join(s, "src")


def _flow(edges: DataFrame, size: int, state: DataFrame, cutter: Cutter, heavy_rows: int) -> tuple[DataFrame, str]:
    """The smallest value that reaches each vertex along the edges."""
    out = _Out(edges, size, cutter, heavy_rows)
    state, path, n = cutter.cut_counting(state.withColumn("fresh", F.lit(True)), n=F.count(F.lit(1)))
    while n["n"]:
        sent = out.join(state.filter("fresh").select("id", "value")).select(F.col("dst").alias("id"), "value", F.lit(None).cast("bigint").alias("old"))
        merged = state.select("id", "value", F.col("value").alias("old")).unionByName(sent).groupBy("id").agg(F.min("value").alias("value"), F.min("old").alias("old"))
        before = path
        state, path, n = cutter.cut_counting(merged.select("id", "value", (F.col("value") < F.col("old")).alias("fresh")), n=F.count_if(F.col("fresh")))
        cutter.drop(before)
    cutter.drop(out.path)
    return state.select("id", "value"), path


def _reach(edges: DataFrame, size: int, roots: DataFrame, cutter: Cutter, heavy_rows: int) -> tuple[DataFrame, str]:
    """All vertices that the roots reach, the roots included."""
    out = _Out(edges, size, cutter, heavy_rows)
    state, path, n = cutter.cut_counting(roots.select("id", F.lit(True).alias("fresh")), n=F.count(F.lit(1)))
    while n["n"]:
        sent = out.join(state.filter("fresh").select("id")).select(F.col("dst").alias("id"), F.lit(True).alias("fresh"))
        merged = state.select("id", F.lit(False).alias("fresh")).unionByName(sent).groupBy("id").agg(F.min("fresh").alias("fresh"))
        before = path
        state, path, n = cutter.cut_counting(merged, n=F.count_if(F.col("fresh")))
        cutter.drop(before)
    cutter.drop(out.path)
    return state.select("id"), path
