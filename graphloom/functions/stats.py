"""Statistics of graphs and of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .numeric import floor_log2
from ..operators.ordering import with_index
from ..plans.loops import Cutter


def std_deviation(df: DataFrame, column: str) -> DataFrame:
    """One row (std): population standard deviation; null for an empty input."""
    return df.agg(F.stddev_pop(column).alias("std"))


def gini(df: DataFrame, column: str) -> DataFrame:
    """One row (gini): Gini coefficient of non-negative values, 0 at least; null without a positive value.

    Equal values are grouped first, so the window runs over distinct values; with
    values v and counts n in rising order it needs sums over the groups before.
    """
    groups = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    from ..operators.ordering import running_sum

    ranked = running_sum(groups, [F.col("v")], F.col("n"), "before")
    # The ranks of a group are before + 1 .. before + n; their sum weights its value.
    ranks = F.col("n") * F.col("before") + F.col("n") * (F.col("n") + 1) / 2
    s = ranked.agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("total"), F.sum(F.col("v") * ranks).alias("w"))
    value = 2 * F.col("w") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")
    return s.select(F.when(F.col("total") > 0, F.greatest(value, F.lit(0.0))).alias("gini"))


def degree_distribution(g: Graph) -> DataFrame:
    """(bucket, n_vertices, n_edges, vertex_percent, edge_percent) by out-degree, bucket = floor(log2 degree).

    Vertices of degree 0 are in bucket -1.
    """
    d = g.out_degrees()
    b = F.when(F.col("degree") == 0, F.lit(-1)).otherwise(floor_log2(F.col("degree"))).cast("int")
    t = d.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n_vertices"), F.sum("degree").alias("n_edges"))
    all_v, all_e = t.agg(F.sum("n_vertices")).scalar(), t.agg(F.sum("n_edges")).scalar()
    return t.select("bucket", "n_vertices", "n_edges", (100.0 * F.col("n_vertices") / all_v).alias("vertex_percent"), (100.0 * F.col("n_edges") / F.nullif(all_e, F.lit(0))).alias("edge_percent"))


def longest_empty_run(g: Graph) -> DataFrame:
    """One row (longest): the longest run of consecutive ids without an out-edge.

    Runs are found between the ids with edges, of which each range partition needs
    only its own and the last one before it.
    """
    ids = with_index(g.out_degrees().filter("degree = 0").select("id"), [F.col("id")], "k")
    runs = ids.groupBy((F.col("id") - F.col("k")).alias("run")).agg(F.count(F.lit(1)).alias("n"))
    return runs.agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest"))


def graph_analysis(g: Graph) -> DataFrame:
    """One row of graph statistics.

    n_vertices, n_edges, avg_degree, std_degree, cv, gini, sparsity (edges over all
    pairs), max_out, max_in, rings (self-loops), singletons (no edge at all), out_0,
    in_0, out_1, in_1, longest_empty_run, out_leaves (out-degree 1 and in-degree 0),
    in_leaves (in-degree 1 and out-degree 0).
    """
    d = g.out_degrees().withColumnRenamed("degree", "o").join(g.in_degrees().withColumnRenamed("degree", "i"), "id")
    d = Cutter(g.vertices.sparkSession, "analysis").cut(d)[0]
    rings = g.edges.filter("src = dst").agg(F.count(F.lit(1)).alias("n")).scalar()
    s = d.agg(
        F.count(F.lit(1)).alias("n_vertices"), F.coalesce(F.sum("o"), F.lit(0)).alias("n_edges"), F.avg("o").alias("avg_degree"), F.stddev_pop("o").alias("std_degree"),
        F.max("o").alias("max_out"), F.max("i").alias("max_in"), F.count_if((F.col("o") == 0) & (F.col("i") == 0)).alias("singletons"), F.count_if(F.col("o") == 0).alias("out_0"),
        F.count_if(F.col("i") == 0).alias("in_0"), F.count_if(F.col("o") == 1).alias("out_1"), F.count_if(F.col("i") == 1).alias("in_1"),
        F.count_if((F.col("o") == 1) & (F.col("i") == 0)).alias("out_leaves"), F.count_if((F.col("i") == 1) & (F.col("o") == 0)).alias("in_leaves"),
    )
    n = F.col("n_vertices")
    return s.select("*", (F.col("std_degree") / F.nullif(F.col("avg_degree"), F.lit(0.0))).alias("cv"), gini(d, "o").scalar().alias("gini"), F.when(n > 0, F.col("n_edges") / (n.cast("double") * n)).alias("sparsity"), rings.alias("rings"), longest_empty_run(g).scalar().alias("longest_empty_run"))
