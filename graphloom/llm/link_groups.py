"""Consolidating pairwise matches into groups: Hash-to-Min on DataFrames.

Each vertex knows a cluster, at first its neighbours.  In a round every vertex
sends its cluster to the smallest member, and that smallest member to all the
others.  After a round the clusters are symmetric, so the state is kept as a
table of distinct pairs (a < b); the cluster of a vertex is the vertex and
everything it is paired with.

A pair is closed when both ends sent it: the smaller one as the smallest of its
cluster, the larger one as a vertex that knows nobody else.  A vertex all of whose
pairs are closed is the centre of a star that no other pair can reach, so the star
is a finished group; its rows leave the state, and later rounds work on the rest
only.  The loop ends when no pair is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import HEAVY_ROWS, heavy_threshold
from ..plans.loops import Cutter

_CENTRE, _LEAF, _CLOSED, _DONE = 1, 2, 3, 4


def link_groups(pairs: DataFrame, left: str = "index1", right: str = "index2", heavy_rows: int = HEAVY_ROWS, max_rounds: int = 200) -> DataFrame:
    """(group_id, vertex_id): the smallest vertex linked with each vertex, directly or not.

    One row for each vertex in a row of ``pairs`` where neither side is null; a
    row with a null side links nothing and adds no vertex.  A vertex that is only
    matched with itself is a group of one.  Repeated and turned pairs count once.
    An empty table gives no rows.  Other columns are not read.

    The members of a cluster are brought together by a window over its vertex, which
    holds fewer than about ``heavy_rows`` rows: vertices with more (told by a hash
    sample of the state, each round) keep their rows wherever they lie, and get their
    minimum, combined on the map side, by a broadcast of bounded size.
    """
    spark = pairs.sparkSession
    cutter = Cutter(spark, "link-groups")
    x, y = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    linked = pairs.select(x.alias("x"), y.alias("y")).filter("x is not null and y is not null")
    first = linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().withColumn("flags", F.lit(0))
    state, path, seen = cutter.cut_counting(first, n=F.count(F.lit(1)))
    done = []
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        open_ = state.filter(F.col("flags") < _DONE)
        closed = (F.col("flags") == _CLOSED).cast("int")
        ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u"), closed.alias("c")), F.struct(F.col("b").alias("v"), F.col("a").alias("u"), F.lit(0).alias("c")))
        both = open_.select(F.explode(F.when(F.col("a") < F.col("b"), ends).otherwise(F.slice(ends, 1, 1))).alias("e")).select("e.v", "e.u", "e.c")
        hubs, hubs_path = _hubs(both, 2 * seen["n"], heavy_rows, cutter)
        facts = {"low": F.min("u"), "n": F.count_if(F.col("u") != F.col("v")), "k": F.sum("c")}
        near = both if hubs is None else both.join(F.broadcast(hubs), "v", "left_anti")
        met = near.select("v", "u", *(f.over(Window.partitionBy("v")).alias(k) for k, f in facts.items()))
        if hubs is not None:
            far = both.join(F.broadcast(hubs), "v", "left_semi")
            met = met.unionByName(far.select("v", "u").join(F.broadcast(far.groupBy("v").agg(*(f.alias(k) for k, f in facts.items()))), "v"))
        m = F.least("low", "v")
        star = (m == F.col("v")) & (F.col("k") == F.col("n"))
        sent = F.when((m != F.col("u")) & (F.col("u") != F.col("v")), F.struct(F.least(m, "u").alias("a"), F.greatest(m, "u").alias("b"), F.when(star, _DONE).when(m == F.col("v"), _CENTRE).otherwise(0).alias("flags")))
        # Once per vertex: a finished centre has a row of its own, every other vertex sends the smallest member to itself.
        own = F.when((F.col("u") == F.col("low")) & (star | (m != F.col("v"))), F.struct(m.alias("a"), F.col("v").alias("b"), F.when(star, _DONE).when(F.col("n") == 1, _LEAF).otherwise(0).alias("flags")))
        new = met.select(F.explode(F.array_compact(F.array(sent, own))).alias("p")).select("p.*").groupBy("a", "b").agg(F.bit_or("flags").alias("flags"))
        previous = path
        state, path, seen = cutter.cut_counting(new, n=F.count_if(F.col("flags") < _DONE), done=F.count_if(F.col("flags") >= _DONE))
        cutter.drop(previous if not done or done[-1] != previous else None, hubs_path)
        if seen["done"]:
            done.append(path)
    else:
        if seen["n"]:
            raise RuntimeError(f"not stable after {max_rounds} rounds")
    if not done:
        return spark.createDataFrame([], "group_id bigint, vertex_id bigint")
    rows = spark.read.schema(state.schema).parquet(*done).filter(F.col("flags") >= _DONE)
    return rows.select(F.col("a").alias("group_id"), F.col("b").alias("vertex_id"))


def _hubs(both: DataFrame, total: int, heavy_rows: int, cutter: Cutter) -> tuple[DataFrame | None, str | None]:
    """(v) of the vertices with about ``heavy_rows`` rows or more, found in a sample by hash; None if there is none.

    The sample expects 500 rows of such a vertex and takes those with half as many,
    so that a hub is not missed; at most twice MAX_HEAVY come out.
    """
    if total < heavy_rows:
        return None, None
    threshold = heavy_threshold(total, heavy_rows)
    rate = max(1, threshold // 500)
    sample = both.filter(F.pmod(F.xxhash64("v", "u"), F.lit(rate)) == 0)
    hubs, path, seen = cutter.cut_counting(sample.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(1, threshold // (2 * rate))).select("v"), n=F.count(F.lit(1)))
    return (hubs, path) if seen["n"] else (None, path)


def group_sizes(groups: DataFrame) -> DataFrame:
    """(group_id, n_members) of the result of :func:`link_groups`."""
    return groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"))
