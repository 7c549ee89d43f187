"""Random edges, samples and update batches, all seeded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.ordering import least_by, running_sum, with_index


def digest(*parts) -> Column:
    """60 bits of the md5 of the parts, joined by "-": the same in every run, partitioning and database."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *(F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p) for p in parts))), 1, 15), 16, 10).cast("bigint")


def _uniform(key, seed: int, n: int) -> Column:
    """A hash of the row number, spread over 0 .. n-1."""
    return F.pmod(digest(key, seed), F.lit(n))


def random_edges(spark: SparkSession, n_vertices: int, size: int, seed: int = 0, **ranges: tuple[int, int]) -> DataFrame:
    """``size`` edges (src, dst, attributes) with independent uniform ends.

    ranges gives integer attributes with their least and largest value.
    """
    cols = [_uniform("id", seed, n_vertices).alias("src"), _uniform("id", seed + 1, n_vertices).alias("dst")]
    cols += [(F.lit(lo) + _uniform("id", seed + 2 + i, hi - lo + 1)).cast("int").alias(k) for i, (k, (lo, hi)) in enumerate(ranges.items())]
    return spark.range(size).select(*cols)


def sample_edges(edges: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows of an edge table, chosen by a seeded hash; parallel edges may be chosen each."""
    rows = edges.withColumn("__h", digest(*edges.columns, seed))
    return least_by(rows, [F.col("__h"), *(F.col(c) for c in edges.columns)], size).drop("__h")


def weighted_vertices(g: Graph, size: int, seed: int = 0) -> DataFrame:
    """(k, id): ``size`` draws of a vertex with probability proportional to its out-degree.

    Each draw picks a position in the list of all edges, and the vertex whose edges
    cover that position; so the draws join the numbered edges on equal positions.
    """
    n = g.edges.count()
    if not n:
        return g.vertices.sparkSession.createDataFrame([], "k bigint, id bigint")
    numbered = with_index(g.edges.select("src", "dst"), [F.col("src"), F.col("dst")], "at")
    draws = g.vertices.sparkSession.range(size).select(F.col("id").alias("k"), _uniform("id", seed, n).alias("at"))
    return draws.join(numbered, "at").select("k", F.col("src").alias("id"))


def insert_batch(g: Graph, size: int, seed: int = 0, weighted: bool = False, unique: bool = False) -> DataFrame:
    """A batch (src, dst) to insert: uniform ends, or sources by degree."""
    v = with_index(g.vertices.select("id"), [F.col("id")], "at")
    n = g.vertices.count()
    spark = g.vertices.sparkSession
    draws = spark.range(size).select(F.col("id").alias("k"), _uniform("id", seed, n).alias("a"), _uniform("id", seed + 1, n).alias("b"))
    if weighted:
        src = weighted_vertices(g, size, seed).select("k", F.col("id").alias("src"))
    else:
        src = draws.join(v.select(F.col("at").alias("a"), F.col("id").alias("src")), "a").select("k", "src")
    dst = draws.join(v.select(F.col("at").alias("b"), F.col("id").alias("dst")), "b").select("k", "dst")
    out = src.join(dst, "k").select("src", "dst")
    return out.distinct() if unique else out


def erase_batch(g: Graph, size: int, seed: int = 0, unique: bool = False) -> DataFrame:
    """A batch (src, dst) of existing edges: a uniform vertex with edges, then one of its edges uniformly."""
    d = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    d = running_sum(with_index(d, [F.col("src")], "at"), [F.col("src")], F.col("n"), "first")
    n = d.count()
    if not n:
        return g.edges.select("src", "dst").limit(0)
    numbered = with_index(g.edges.select("src", "dst"), [F.col("src"), F.col("dst")], "pos").select("pos", "src", "dst")
    draws = g.vertices.sparkSession.range(size).select("id", _uniform("id", seed, n).alias("at"))
    picked = draws.join(d, "at").select((F.col("first") + F.pmod(digest("id", seed + 1), F.col("n"))).alias("pos"))
    out = picked.join(numbered, "pos").select("src", "dst")
    return out.distinct() if unique else out
