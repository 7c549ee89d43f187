"""Writers of graphs and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def write_parquet(g: Graph, path: str) -> None:
    """A snapshot with all attributes, as two tables."""
    g.vertices.write.parquet(f"{path}/vertices")
    g.edges.write.parquet(f"{path}/edges")


def market_lines(g: Graph, weight: str | None = None) -> DataFrame:
    """(value, at): the lines of a coordinate file, 1-based, sorted; every stored edge is one line."""
    n = g.vertices.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("n")).scalar()
    m = g.edges.agg(F.count(F.lit(1)).alias("n")).scalar()
    spark = g.vertices.sparkSession
    kind = "integer" if weight else "pattern"
    head = spark.createDataFrame([(f"%%MatrixMarket matrix coordinate {kind} general", 0)], "value string, k int")
    size = spark.range(1).select(F.concat_ws(" ", n, n, m).alias("value"), F.lit(1).alias("k"))
    none = F.lit(None).cast("bigint")
    cols = [F.col("src") + 1, F.col("dst") + 1, *([F.col(weight)] if weight else [])]
    body = g.edges.select(F.concat_ws(" ", *cols).alias("value"), F.struct(F.lit(2).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b")).alias("at"))
    top = head.unionByName(size).select("value", F.struct("k", none.alias("a"), none.alias("b")).alias("at"))
    return top.unionByName(body)


def dimacs10_lines(g: Graph) -> DataFrame:
    """(value, at): ``nV nE 100`` and one line of 1-based neighbours per vertex, empty ones included."""
    n = g.vertices.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("n")).scalar()
    m = g.edges.agg(F.count(F.lit(1)).alias("n")).scalar()
    adj = g.edges.groupBy(F.col("src").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.col("dst") + 1)).cast("array<string>"), " ").alias("value"))
    body = g.vertices.select("id").join(adj, "id", "left").select(F.coalesce("value", F.lit("")).alias("value"), F.col("id").alias("at"))
    head = g.vertices.sparkSession.range(1).select(F.concat_ws(" ", n, m, F.lit(100)).alias("value"), F.lit(-1).cast("bigint").alias("at"))
    return head.unionByName(body)


def write_lines(lines: DataFrame, path: str, single: bool = True) -> None:
    """Write (value, at) in the order of ``at``; as one part file by default, as the format wants it."""
    ordered = lines.orderBy("at").select("value")
    (ordered.coalesce(1) if single else ordered).write.text(path)


def peel_json(peel: DataFrame, value: str = "peel") -> DataFrame:
    """(value): one JSON object {"u,v": peel} per edge."""
    return peel.select(F.to_json(F.create_map(F.concat_ws(",", "src", "dst"), F.col(value))).alias("value"))


def write_analysis(row: DataFrame, name: str, path: str) -> None:
    """Append a row of statistics to a tab-separated table."""
    row.select(F.lit(name).alias("name"), "*").coalesce(1).write.mode("append").csv(path, sep="\t", header=False)
