"""Edge batches from a stream, applied to a stored graph.

The graph is a folder in shared storage: a full table ``base=<batch id>`` and, for
each later batch, the rows it adds (``delta=<batch id>``) and the rows it takes away
(``gone=<batch id>``).  A batch writes its own size, whatever the size of the graph;
after some batches a new base is written and folders that no reader needs any more
are removed.  A batch counts once its delta has committed, and a batch id that has
been applied is skipped, so a batch that the engine delivers again after a failure
changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.updates import erase_edges, insert_edges


class StreamingGraph:
    """A graph that edge batches change.

    A batch has src, dst, attributes and, optionally, a column ``op``: ``insert``
    (also null) or ``erase``.  Erasures of a batch take place before its inserts.
    Late edges are applied when they arrive.
    """

    def __init__(self, spark: SparkSession, path: str, edges: DataFrame, op: str | None = None, dedup_batch: bool = False, dedup_graph: bool = False, compact_after: int = 16):
        self.spark, self.path, self.op = spark, path.rstrip("/"), op
        self.dedup_batch, self.dedup_graph, self.compact_after = dedup_batch, dedup_graph, compact_after
        self.schema = edges.schema
        if not self._folders():
            edges.write.mode("overwrite").parquet(f"{self.path}/base=-1")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _folders(self) -> list[tuple[str, int]]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        found = []
        for s in fs.listStatus(path(self.path)):
            kind, _, number = s.getPath().getName().partition("=")
            if kind in ("base", "delta", "gone") and fs.exists(path(s.getPath(), "_SUCCESS")):
                found.append((kind, int(number)))
        return found

    def last_batch(self) -> int:
        """The number of the last batch that counts; -1 before the first one."""
        return max(n for k, n in self._folders() if k != "gone")

    def edges(self) -> DataFrame:
        """The edges after all batches so far."""
        found = self._folders()
        base = max(n for k, n in found if k == "base")
        deltas = sorted(n for k, n in found if k == "delta" and n > base)
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/base={base}", *(f"{self.path}/delta={n}" for n in deltas))
        gone = [f"{self.path}/gone={n}" for k, n in found if k == "gone" and n in deltas]
        if not gone:
            return rows
        # Rows are told apart by their values, so what is left is a difference of multisets; only edges that lost rows are counted.
        lost = self.spark.read.schema(self.schema).parquet(*gone)
        keys = lost.select("src", "dst").distinct()
        touched = rows.join(keys, ["src", "dst"], "left_semi").select(*rows.columns)
        return rows.join(keys, ["src", "dst"], "left_anti").select(*rows.columns).unionByName(touched.exceptAll(lost))

    def graph(self, vertices: DataFrame | None = None) -> Graph:
        return Graph.from_edges(self.edges(), vertices)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Apply one batch; for ``writeStream.foreachBatch``."""
        if self.last_batch() >= batch_id:
            return
        names = [f.name for f in self.schema.fields]
        rows = batch.filter("src is not null and dst is not null")
        added = rows.filter(F.coalesce(F.col(self.op), F.lit("insert")) != "erase") if self.op else rows
        added = added.select(*names)
        now = self.edges()
        if self.op:
            removed = rows.filter(F.col(self.op) == "erase").select("src", "dst")
            touched = now.join(removed.distinct(), ["src", "dst"], "left_semi").select(*names)
            touched.exceptAll(erase_edges(touched, removed)).write.mode("overwrite").parquet(f"{self.path}/gone={batch_id}")
        fresh = insert_edges(now.limit(0), added, self.dedup_batch)
        if self.dedup_graph:
            if self.op:
                lost = self.spark.read.schema(self.schema).parquet(f"{self.path}/gone={batch_id}")
                affected = now.join(lost.select("src", "dst").distinct(), ["src", "dst"], "left_semi").select(*names)
                now = now.join(lost.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(*names).unionByName(affected.exceptAll(lost))
            fresh = fresh.join(now.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
        fresh.select(*names).write.mode("overwrite").parquet(f"{self.path}/delta={batch_id}")
        found = self._folders()
        base = max(n for k, n in found if k == "base")
        if sum(k == "delta" and n > base for k, n in found) >= self.compact_after:
            self.compact()

    def compact(self) -> None:
        """Write all edges as a new base.  What the base before it needed stays until the next time, for readers that still use it."""
        last, found = self.last_batch(), self._folders()
        base = max(n for k, n in found if k == "base")
        if base < last:
            self.edges().write.mode("overwrite").parquet(f"{self.path}/base={last}")
            self._remove([(k, n) for k, n in found if n < base or n == base and k != "base"])

    def reset(self, edges: DataFrame | None = None) -> None:
        """Start again from ``edges`` (by default none); batches that were applied stay applied."""
        last, found = self.last_batch(), self._folders()
        rows = edges.select(*(f.name for f in self.schema.fields)) if edges is not None else self.spark.createDataFrame([], self.schema)
        rows.write.mode("overwrite").parquet(f"{self.path}/base={last + 1}")
        self._remove(found)

    def _remove(self, folders: list[tuple[str, int]]) -> None:
        fs, path = self._fs()
        for kind, n in folders:
            fs.delete(path(f"{self.path}/{kind}={n}"), True)

    def run(self, stream: DataFrame, checkpoint: str, after: Callable[[StreamingGraph, int], None] | None = None) -> None:
        """Apply everything the stream has now, batch by batch; ``after`` sees each new version."""

        def one(batch: DataFrame, batch_id: int) -> None:
            self.apply(batch, batch_id)
            if after:
                after(self, batch_id)

        stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, key: Column | None = None) -> DataFrame:
    """Edges per time window (and key), with a watermark after which late rows are dropped."""
    keys = [F.window(time, width)] + ([key.alias("key")] if key is not None else [])
    return stream.withWatermark(time, late).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"))


def store_windowed_counts(stream: DataFrame, path: str, checkpoint: str, time: str, width: str, late: str, key: Column | None = None) -> DataFrame:
    """Run :func:`windowed_counts` over everything the stream has now and return the stored windows that the watermark has closed."""
    counts = windowed_counts(stream, time, width, late, key)
    flat = counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(["key"] if key is not None else []), "n_edges")
    flat.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(flat.schema).parquet(path)
