"""Graphs as DataFrames: vertices(id, ...) and edges(src, dst, ...).

Directed multigraphs: parallel edges and self-loops are kept unless a transform
says otherwise.  Ids are bigint and need not be dense.  An undirected graph holds
both directions of every edge.  All methods return new graphs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ordering import running_sum, with_index
from .operators.skew import join_any


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    # construction

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None, src: str = "src", dst: str = "dst") -> Graph:
        """A graph of ``edges``; rows with a null end are dropped.

        Without ``vertices`` these are the ends of the edges.  Other columns are
        edge attributes; an attribute called src or dst besides the ends is an error.
        """
        rest = [c for c in edges.columns if c not in (src, dst)]
        if {"src", "dst"} & set(rest):
            raise ValueError("an edge attribute is called src or dst")
        e = edges.select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst"), *rest).filter("src is not null and dst is not null")
        if vertices is None:
            vertices = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return Graph(vertices, e)

    @staticmethod
    def dense(edges: DataFrame, n: int, **kw) -> Graph:
        """A graph over the ids 0 .. n-1, isolated vertices included."""
        return Graph.from_edges(edges, edges.sparkSession.range(n), **kw)

    @staticmethod
    def from_csr(spark: SparkSession, offsets: list[int], targets: list[int], **attributes: list) -> Graph:
        """A graph from compressed rows: vertex i has targets[offsets[i]:offsets[i+1]]."""
        if not offsets or offsets[0] != 0 or offsets[-1] != len(targets) or any(a > b for a, b in zip(offsets, offsets[1:], strict=False)):
            raise ValueError("offsets must rise from 0 to the number of targets")
        n = len(offsets) - 1
        starts = spark.createDataFrame([(i, offsets[i], offsets[i + 1] - offsets[i]) for i in range(n)], "id bigint, offset bigint, degree bigint")
        if not targets:
            return Graph(spark.range(n), spark.createDataFrame([], "src bigint, dst bigint"))
        entries = spark.createDataFrame(list(zip(range(len(targets)), targets, *attributes.values(), strict=True)), ["position", "dst", *attributes])
        return Graph.from_csr_tables(starts, entries)

    @staticmethod
    def from_csr_tables(offsets: DataFrame, entries: DataFrame) -> Graph:
        """A graph from the two tables of :meth:`csr`: (id, offset, degree) and (position, dst, attributes)."""
        rest = [c for c in entries.columns if c not in ("position", "dst")]
        at = offsets.filter("degree > 0").select(F.col("id").alias("src"), F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("degree") - 1)).alias("position"))
        return Graph(offsets.select("id"), at.join(entries, "position").select("src", F.col("dst").cast("bigint").alias("dst"), *rest))

    # size and degrees

    def n_vertices(self) -> int:
        return self.vertices.count()

    def n_edges(self) -> int:
        return self.edges.count()

    def out_degrees(self) -> DataFrame:
        """(id, degree) of every vertex, 0 for those without edges."""
        return self._degrees("src")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst")

    def _degrees(self, end: str) -> DataFrame:
        counts = self.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("id").join(counts, "id", "left").fillna(0, ["degree"])

    def max_degree(self) -> DataFrame:
        """One row (id, degree): the largest out-degree, at its smallest id; none for an empty graph."""
        return self.out_degrees().orderBy(F.desc("degree"), "id").limit(1)

    # exports

    def coo(self, sort: bool = False) -> DataFrame:
        return self.edges.orderBy("src", "dst") if sort else self.edges

    def csr(self) -> tuple[DataFrame, DataFrame]:
        """Compressed rows as two tables: (id, offset, degree) and (position, dst, attributes).

        The entries of a vertex are at positions offset .. offset + degree - 1, sorted by
        dst and attributes.  No adjacency is gathered into one row.
        """
        rest = [c for c in self.edges.columns if c != "src"]
        offsets = running_sum(self.out_degrees(), [F.col("id")], F.col("degree"), "offset").select("id", "offset", "degree")
        entries = with_index(self.edges, [F.col("src"), *(F.col(c) for c in rest)], "position").select("position", *rest)
        return offsets, entries

    # transforms of the loader

    def reverse(self) -> Graph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return replace(self, edges=self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))

    def symmetrize(self) -> Graph:
        """Every edge in both directions; self-loops once; nothing is de-duplicated."""
        back = self.reverse().edges.filter("src <> dst")
        return replace(self, edges=self.edges.unionByName(back))

    def to_undirected(self) -> Graph:
        """Both directions, each (src, dst, attributes) once."""
        return replace(self, edges=self.symmetrize().edges.distinct())

    def simple(self) -> Graph:
        """Undirected, without self-loops, parallel edges and attributes."""
        e = self.edges.select("src", "dst").filter("src <> dst")
        both = e.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")
        return Graph(self.vertices, both.distinct())

    def to_directed(self, seed: int = 0) -> Graph:
        """One direction of each edge, chosen by a seeded hash of its ends."""
        lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
        forward = F.pmod(F.xxhash64(lo, hi, F.lit(seed)), F.lit(2)) == 0
        return replace(self, edges=self.edges.filter((F.col("src") == F.col("dst")) | (forward == (F.col("src") < F.col("dst")))))

    def by_degree(self) -> Graph:
        """The acyclic orientation: (u, v) stays iff u has the smaller (degree, id)."""
        d = self.out_degrees()
        e = join_any(self.edges, d.select(F.col("id").alias("src"), F.col("degree").alias("__ds")), "src")
        e = join_any(e, d.select(F.col("id").alias("dst"), F.col("degree").alias("__dd")), "dst", source=self.edges)
        kept = e.filter("__ds < __dd or (__ds = __dd and src < dst)")
        return replace(self, edges=kept.select(*self.edges.columns))

    def relabel(self, ids: DataFrame) -> Graph:
        """Edges with ids replaced by ids.new_id; ends without an entry drop the edge."""
        m = ids.select("id", "new_id")
        e = join_any(self.edges, m.select(F.col("id").alias("src"), F.col("new_id").alias("__s")), "src")
        e = join_any(e, m.select(F.col("id").alias("dst"), F.col("new_id").alias("__d")), "dst", source=self.edges)
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        v = self.vertices.join(m, "id").select(F.col("new_id").alias("id"), *(c for c in self.vertices.columns if c != "id"))
        return Graph(v, e.select(F.col("__s").alias("src"), F.col("__d").alias("dst"), *rest))

    def randomize_ids(self, seed: int = 0) -> Graph:
        """A seeded permutation onto 0 .. n-1."""
        order = [F.xxhash64("id", F.lit(seed)), F.col("id")]
        return self.relabel(with_index(self.vertices.select("id"), order, "new_id"))

    def drop_singletons(self) -> Graph:
        """Vertices with an in-edge and an out-edge only, relabelled densely in the order of their ids."""
        both = self.edges.select(F.col("src").alias("id")).distinct().join(self.edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        return self.relabel(with_index(self.vertices.select("id").join(both, "id", "left_semi"), [F.col("id")], "new_id"))

    # batch updates

    def insert(self, batch: DataFrame, dedup_batch: bool = False, dedup_graph: bool = False, order: list[Column] | None = None) -> Graph:
        from .operators.updates import insert_edges

        return replace(self, edges=insert_edges(self.edges, batch, dedup_batch, dedup_graph, order))

    def erase(self, batch: DataFrame, dedup_batch: bool = False) -> Graph:
        from .operators.updates import erase_edges

        return replace(self, edges=erase_edges(self.edges, batch, dedup_batch))
