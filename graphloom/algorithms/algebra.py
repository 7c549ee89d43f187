"""Sparse matrix-vector product and the energy game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.traverse import EdgeTable
from ..operators.skew import join_any
from ..plans.loops import Cutter


def spmv(g: Graph, x: DataFrame, value: str | Column = "weight") -> DataFrame:
    """(id, y): y[src] = sum of value * x[dst] over the edges; 0 for empty rows.

    x holds (id, x); entries it lacks are 0, as are null values.  Parallel edges add.
    """
    v = F.col(value) if isinstance(value, str) else value
    products = join_any(g.edges.select("src", "dst", v.alias("v")), x.select(F.col("id").alias("dst"), "x"), "dst")
    y = products.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    return g.vertices.select("id").join(y, "id", "left").withColumn("y", F.coalesce("y", F.lit(0)))


def least_potentials(g: Graph, weight: str = "weight", threshold: int = 0, max_rounds: int = 100_000) -> DataFrame:
    """(id, potential): least potentials of an energy game; null where none is finite.

    A vertex with id >= threshold belongs to the minimising player, the others to
    the maximising one.  Over its out-edges it takes the least (largest) of
    max(0, potential of the target - weight), which is infinite beyond
    M = sum over vertices of max(0, largest -weight).  Starting from 0 the values
    only rise, so the loop ends; a cycle that loses energy climbs to M step by step,
    so the number of rounds can reach M.  Vertices without out-edges keep 0; edges with a
    null weight do not exist.
    """
    cutter = Cutter(g.vertices.sparkSession, "energy")
    e = g.edges.select("src", "dst", F.col(weight).cast("bigint").alias("w")).filter("w is not null")
    table = EdgeTable(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), cutter)
    worst = e.groupBy("src").agg(F.greatest(F.max(-F.col("w")), F.lit(0)).alias("m"))
    limit = worst.agg(F.sum("m")).first()[0] or 0
    top = limit + 1
    state, path = cutter.cut(g.vertices.select("id", F.lit(0).cast("bigint").alias("p")))
    for _ in range(max_rounds):
        offer = F.when(F.col("p") >= top, F.lit(top)).when(F.col("p") - F.col("w") > limit, F.lit(top)).otherwise(F.greatest(F.col("p") - F.col("w"), F.lit(0)))
        best = table.spread(state).select(F.col("dst").alias("id"), offer.alias("o")).groupBy("id").agg(F.min("o").alias("lo"), F.max("o").alias("hi"))
        new = F.greatest("p", F.coalesce(F.when(F.col("id") >= threshold, F.col("lo")).otherwise(F.col("hi")), F.lit(0)))
        before = path
        state, path, seen = cutter.cut_counting(state.join(best, "id", "left").select("id", new.cast("bigint").alias("p"), F.col("p").alias("was")), n=F.count_if(F.col("p") > F.col("was")))
        state = state.drop("was")
        cutter.drop(before)
        if not seen["n"]:
            table.close()
            return state.select("id", F.when(F.col("p") < top, F.col("p")).alias("potential"))
    raise RuntimeError("potentials still rise")
