"""Traversal operators: apply column expressions to vertices, edges and pairs.

Where a device library takes a functor, these take Column expressions, so that
they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.loops import Cutter
from .ordering import with_index
from .skew import HEAVY_ROWS, heavy_threshold, join_any


def for_all(spark: SparkSession, n: int, **columns: Column) -> DataFrame:
    """The integers 0 .. n-1 as ``id``, with further columns."""
    return spark.range(n).withColumns(columns)


def for_all_vertices(g: Graph, only: DataFrame | None = None, **columns: Column) -> DataFrame:
    """Every vertex (or those in ``only.id``) with its out-degree and further columns."""
    d = g.out_degrees()
    v = g.vertices.join(d, "id")
    if only is not None:
        v = v.join(only.select("id").distinct(), "id", "left_semi")
    return v.withColumns(columns)


def for_all_edges(g: Graph, frontier: DataFrame | None = None, **columns: Column) -> DataFrame:
    """Every edge, or the edges out of ``frontier.id``, with further columns."""
    e = g.edges
    if frontier is not None:
        e = e.join(frontier.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return e.withColumns(columns)


def for_all_edge_numbers(g: Graph, **columns: Column) -> DataFrame:
    """Every edge with its number 0 .. n-1 in the order of its ends and attributes as ``position``, with further columns."""
    return with_index(g.edges, [F.col("src"), F.col("dst"), *(F.col(c) for c in g.edges.columns if c not in ("src", "dst"))], "position").withColumns(columns)


def for_all_edge_pairs(g: Graph, state: DataFrame, **columns: Column) -> DataFrame:
    """Every edge with the state of both ends as structs ``s`` and ``d``."""
    return for_all_pairs(g.edges, state, **columns)


def for_all_pairs(pairs: DataFrame, state: DataFrame, **columns: Column) -> DataFrame:
    """Rows (src, dst, ...) with the vertex state of both ends as structs ``s`` and ``d``."""
    rest = F.struct(*(c for c in state.columns if c != "id"))
    s = state.select(F.col("id").alias("src"), rest.alias("s"))
    d = state.select(F.col("id").alias("dst"), rest.alias("d"))
    return join_any(join_any(pairs, s, "src"), d, "dst", source=pairs).withColumns(columns)


class EdgeTable:
    """Edges kept for many joins on ``src``, with hubs apart.

    The edges are stored once.  Sources with ``threshold`` edges or more (few, see
    :func:`heavy_threshold`) keep their edges wherever they lie; what a hub sends
    reaches them by broadcast, if it is one row a vertex, else by salts.  The edges
    of all other sources are partitioned by ``src`` and kept on disk, so that a round
    shuffles only the vertex state.
    """

    def __init__(self, edges: DataFrame, cutter: Cutter, heavy_rows: int = HEAVY_ROWS):
        self.spark = edges.sparkSession
        self.edges, _, seen = cutter.cut_counting(edges, n=F.count(F.lit(1)))
        self.n = seen["n"]
        threshold = heavy_threshold(self.n, heavy_rows)
        degrees = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold)
        # a hub has one salt per ``heavy_rows`` edges
        self.hubs, _, seen = cutter.cut_counting(degrees.select("src", F.ceil(F.col("n") / heavy_rows).cast("int").alias("salts")), n=F.count(F.lit(1)))
        self.any_hub = bool(seen["n"])
        light = self.edges.join(F.broadcast(self.hubs.select("src")), "src", "left_anti") if self.any_hub else self.edges
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.light = light.repartition(parts, "src").persist()

    def spread(self, state: DataFrame, many: bool = False) -> DataFrame:
        """Each edge with the columns of the vertex ``state.id`` at its source.

        many: a vertex may have any number of rows.  Nothing is broadcast then but the
        hubs' names; the edges of a hub are salted and its rows copied to each salt.
        """
        s = state.withColumnRenamed("id", "src")
        out = self.light.join(s, "src")
        if not self.any_hub:
            return out
        names = F.broadcast(self.hubs)
        if many:
            edges = self.edges.join(names, "src").withColumn("__salt", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int")).drop("salts")
            rows = s.join(names, "src").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
            return out.unionByName(edges.join(rows.hint("shuffle_hash"), ["src", "__salt"]).drop("__salt"))
        only = names.select("src")
        hub_state = F.broadcast(s.join(F.broadcast(only), "src", "left_semi"))
        heavy = self.edges.join(F.broadcast(only), "src", "left_semi").join(hub_state, "src")
        return out.unionByName(heavy)

    def close(self) -> None:
        self.light.unpersist()


def aggregate_messages(g: Graph, state: DataFrame, message: Column, aggregate: dict[str, Column], to: str = "dst") -> DataFrame:
    """One Pregel-like superstep: (id, aggregates of the messages that reach a vertex).

    message is an expression over the edge columns, ``s`` and ``d`` (the state of
    both ends); aggregate maps names to aggregates of ``F.col("message")``.  Null
    messages are not sent.  Partial aggregation takes place before the shuffle.
    """
    sent = for_all_pairs(g.edges, state).withColumn("message", message).filter("message is not null")
    return sent.groupBy(F.col(to).alias("id")).agg(*(c.alias(k) for k, c in aggregate.items()))


def adjacency_intersections(g: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """(src, dst, common): one row per neighbour that both ends of a pair share, by default for every edge.

    The neighbours of the end with fewer of them are looked up among those of the
    other, so the work per pair is the smaller degree; no adjacency is gathered.
    Pairs and edges count once, however often they are repeated.
    """
    e = g.edges.select("src", "dst").distinct()
    d = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    p = (pairs.select("src", "dst").distinct() if pairs is not None else e).join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst")
    small = F.col("n") <= F.col("m")
    ends = p.select("src", "dst", F.when(small, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(small, F.col("dst")).otherwise(F.col("src")).alias("b"))
    offered = ends.join(e.select(F.col("src").alias("a"), F.col("dst").alias("common")), "a")
    return offered.join(e.select(F.col("src").alias("b"), F.col("dst").alias("common")), ["b", "common"], "left_semi").select("src", "dst", "common")


def run_lengths(df: DataFrame, key: str) -> DataFrame:
    """(key, n): the lengths of the runs of equal keys in sorted order."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def partition_by_flag(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """The rows for which the flag holds, and all others (a null flag does not hold)."""
    holds = F.coalesce(flag, F.lit(False))
    return df.filter(holds), df.filter(~holds)


def arg_max(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row (key, value): the largest value at its smallest key."""
    return df.orderBy(F.desc(value), key).limit(1).select(key, value)


def segmented_reduce(df: DataFrame, segment: str, **aggregates: Column) -> DataFrame:
    return df.groupBy(segment).agg(*(c.alias(k) for k, c in aggregates.items()))
