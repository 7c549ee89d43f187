"""Graphs made of the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph

#: Formats whose files make up the graph before a batch; the others are the batch.
BASE_FORMATS = ("mtx", "gr", "graph")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def all_vertices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "anchor_vertices").select("id").unionByName(table(spark, d, "vertices").select("id"))


def edge_rows(spark: SparkSession, d: str) -> DataFrame:
    """Edge lines with 0-based ends and all attributes; lines with a null end are no edges."""
    e = table(spark, d, "coo_edges")
    return e.select((F.col("index1") - 1).alias("src"), (F.col("index2") - 1).alias("dst"), "weight", "w1", "edge_id", "graph_id", "seen_at").filter("src is not null and dst is not null")


def coo_graph(spark: SparkSession, d: str, *attributes: str) -> Graph:
    """The directed multigraph of all edge lines over all vertices."""
    return Graph.from_edges(edge_rows(spark, d).select("src", "dst", *attributes), all_vertices(spark, d))


def split_graph(spark: SparkSession, d: str, *attributes: str) -> tuple[Graph, DataFrame]:
    """The graph of the files of some formats, and the edges of all other files as a batch."""
    info = table(spark, d, "graph_info").select("graph_id", "file_format")
    e = edge_rows(spark, d).join(info, "graph_id", "left")
    first = F.coalesce(F.col("file_format").isin(*BASE_FORMATS), F.lit(False))
    return Graph.from_edges(e.filter(first).select("src", "dst", *attributes), all_vertices(spark, d)), e.filter(~first).select("src", "dst", *attributes)
