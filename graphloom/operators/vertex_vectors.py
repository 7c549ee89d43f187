"""Products of an edge table with vertex vectors that the driver holds.

As in a distributed singular value decomposition, the vectors (8 bytes a vertex)
live on the driver and are broadcast, while the edges stay on the executors,
packed into arrays once.  A round is then one job without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.loops import Cutter

#: Vectors are held up to this number of vertices; larger graphs take the joins of :class:`EdgeTable`.
MOST_VERTICES = 12_000_000
#: Edges of a block, about.
BLOCK_EDGES = 400_000


def dense_ids(vertices: DataFrame, most: int = MOST_VERTICES) -> np.ndarray | None:
    """All ids in order; None if they are more than ``most``, or if one is null or repeated."""
    ids = vertices.select("id")
    if ids.count() > most:
        return None
    column = ids.toArrow().column(0)
    if column.null_count:
        return None
    out = np.sort(column.to_numpy())
    return None if (out[1:] == out[:-1]).any() else out


class EdgeBlocks:
    """Edges (src, dst) in arrays; with ``weighted`` there is a double ``weight`` as well.

    Edges are range-sorted by (dst, src), so that a hub's edges are spread like all others
    and a block sends one sum for each of its targets.  Edges with an end that is not
    among ``ids`` count as none.
    """

    def __init__(self, edges: DataFrame, n: int, ids: np.ndarray, cutter: Cutter, weighted: bool = False):
        self.spark, self.size = edges.sparkSession, len(ids)
        shared = self.spark.sparkContext.broadcast(ids)
        columns = ["src", "dst", "weight"] if weighted else ["src", "dst"]
        parts = max(1, -(-n // BLOCK_EDGES))
        ranged = edges.select(*columns).repartitionByRange(parts, "dst", "src").sortWithinPartitions("dst", "src")
        self.table, _ = cutter.cut(ranged.mapInArrow(_packer(shared, weighted), "targets binary, starts binary, sources binary, weights binary"))
        shared.destroy()

    def times(self, x: np.ndarray) -> np.ndarray:
        """For each vertex the sum over the edges into it of the value of ``x`` at their source, times the weight."""
        shared = self.spark.sparkContext.broadcast(x)
        got = self.table.mapInArrow(_multiplier(shared), "targets binary, sums binary").toArrow()
        out = np.zeros(self.size)
        for targets, sums in zip(got.column(0), got.column(1), strict=True):
            out[np.frombuffer(targets.as_buffer(), np.int32)] += np.frombuffer(sums.as_buffer())
        shared.destroy()
        return out


def vertex_table(spark: SparkSession, ids: np.ndarray, columns: dict[str, np.ndarray], cutter: Cutter) -> DataFrame:
    """(id, columns): the vectors as a stored table."""
    shared = spark.sparkContext.broadcast((ids, *columns.values()))
    parts = max(1, -(-len(ids) // BLOCK_EDGES))
    rows = spark.range(0, parts, 1, parts).mapInArrow(_emitter(shared, [*columns], parts), ", ".join(["id bigint", *(f"{c} double" for c in columns)]))
    out, _ = cutter.cut(rows)
    shared.destroy()
    return out


def _packer(shared, weighted: bool) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, some, n = shared.value, [], 0
        for b in batches:
            some.append(b)
            n += len(b)
            if n >= 2 * BLOCK_EDGES:
                yield from _block(pa.Table.from_batches(some), ids, weighted)
                some, n = [], 0
        if n:
            yield from _block(pa.Table.from_batches(some), ids, weighted)

    return pack


def _positions(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted ids are, and whether they are there at all."""
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return at.astype(np.int32), ids[at] == wanted


def _block(edges: pa.Table, ids: np.ndarray, weighted: bool) -> Iterator[pa.RecordBatch]:
    if not len(ids):
        return
    src, known = _positions(ids, edges.column("src").to_numpy())
    dst, also = _positions(ids, edges.column("dst").to_numpy())
    known &= also
    src, dst = src[known], dst[known]
    if len(dst):
        starts = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1])))
        weights = edges.column("weight").to_numpy()[known].tobytes() if weighted else None
        arrays = [pa.array([x], pa.binary()) for x in (dst[starts].tobytes(), starts.astype(np.int32).tobytes(), src.tobytes(), weights)]
        yield pa.RecordBatch.from_arrays(arrays, ["targets", "starts", "sources", "weights"])


def _multiplier(shared) -> Callable:
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        for b in batches:
            for targets, starts, sources, weights in zip(*b.columns, strict=True):
                sent = x[np.frombuffer(sources.as_buffer(), np.int32)]
                if weights.is_valid:
                    sent *= np.frombuffer(weights.as_buffer())
                sums = np.add.reduceat(sent, np.frombuffer(starts.as_buffer(), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([targets.as_py()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], ["targets", "sums"])

    return multiply


def _emitter(shared, names: list[str], parts: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, *columns = shared.value
        for b in batches:
            for k in b.column(0).to_pylist():
                at = slice(len(ids) * k // parts, len(ids) * (k + 1) // parts)
                yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (ids, *columns)], ["id", *names])

    return emit
