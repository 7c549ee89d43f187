"""Batch updates of an edge table with multiset semantics.

Rows with a null end are no edges and are ignored in batches.  Instances of a
parallel edge are told apart by their position among equals: (src, dst) groups are
numbered by all attributes in column order, nulls first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_index
from .skew import HEAVY_ROWS, heavy_threshold, join_counted


def _attributes(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("src", "dst")]


def sort_batch(batch: DataFrame) -> DataFrame:
    """The batch ordered by (src, dst)."""
    return batch.orderBy("src", "dst", *_attributes(batch))


def unique_batch(batch: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One row per (src, dst): the first in ``order``, by default of the attributes.

    An aggregate with map-side combining, so that an edge sent very often is one
    row per task when it is shuffled.
    """
    rest = _attributes(batch)
    if not rest:
        return batch.distinct()
    key = F.struct(*order, *rest) if order else F.struct(*rest)
    first = batch.groupBy("src", "dst").agg(F.min_by(F.struct(*rest), key).alias("__first"))
    return first.select("src", "dst", *(F.col(f"__first.{c}").alias(c) for c in rest)).select(*batch.columns)


def insert_edges(edges: DataFrame, batch: DataFrame, dedup_batch: bool = False, dedup_graph: bool = False, order: list[Column] | None = None) -> DataFrame:
    """``edges`` and the batch.

    dedup_batch keeps one row per (src, dst) of the batch; dedup_graph drops batch
    rows whose (src, dst) is in the graph already, all copies of them.  Attributes
    that the batch lacks become null; extra ones are an error.
    """
    b = batch.filter("src is not null and dst is not null")
    if extra := set(b.columns) - set(edges.columns):
        raise ValueError(f"the batch has columns that the graph lacks: {sorted(extra)}")
    if dedup_batch:
        b = unique_batch(b, order)
    if dedup_graph:
        b = b.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return edges.unionByName(b, allowMissingColumns=True)


def upsert_edges(edges: DataFrame, batch: DataFrame, mode: str = "ignore", weight: str = "weight") -> DataFrame:
    """Merge a batch of (src, dst, weight) into a simple weighted graph.

    mode: ``ignore`` keeps the old weight of an edge that exists, ``update`` takes
    the new one, ``sum`` adds.  Edges not in the graph are inserted.  A batch that
    names an edge more than once counts with its smallest weight (``sum``: all of
    them).  A null weight in the batch changes nothing.
    """
    if mode not in ("ignore", "update", "sum"):
        raise ValueError(f"unknown mode {mode}")
    agg = F.sum(weight) if mode == "sum" else F.min(weight)
    b = batch.filter("src is not null and dst is not null").groupBy("src", "dst").agg(agg.alias("__new"))
    both = edges.select("src", "dst", F.col(weight).alias("__old")).withColumn("__in", F.lit(True)).join(b, ["src", "dst"], "full_outer")
    old, new = F.col("__old"), F.col("__new")
    known = {"ignore": old, "update": F.coalesce(new, old), "sum": F.when(old.isNull() & new.isNull(), None).otherwise(F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)))}[mode]
    return both.select("src", "dst", F.when(F.col("__in"), known).otherwise(new).cast(edges.schema[weight].dataType).alias(weight))


def erase_edges(edges: DataFrame, batch: DataFrame, dedup_batch: bool = False, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Multiset difference on (src, dst): a key that the batch has k times removes up to k instances.

    With ``dedup_batch`` a key removes at most one.  Keys that match nothing are
    ignored.  Of parallel instances the first by their attributes go.  Edges whose key
    is not in the batch are not sorted.  Without attributes instances are counted; with
    them they are numbered, by a window per key, or over a global order if a key has
    ``heavy_rows`` instances or more, so that none comes into one task.
    """
    keys = batch.filter("src is not null and dst is not null").groupBy("src", "dst").agg((F.lit(1) if dedup_batch else F.count(F.lit(1))).cast("bigint").alias("__k"))
    rest = _attributes(edges)
    marked = edges.join(keys, ["src", "dst"], "left")
    kept, touched = marked.filter("__k is null"), marked.filter("__k is not null")
    counted = touched.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("__n"), F.max("__k").alias("__k"))
    if not rest:
        left = counted.filter("__n > __k").withColumn("__one", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n") - F.col("__k"))))
        return kept.select(*edges.columns).unionByName(left.select(*edges.columns))
    most = counted.agg(F.max("__n"), F.sum("__n")).first()
    threshold = heavy_threshold(most[1] or 0, heavy_rows)
    if (most[0] or 0) < threshold:
        left = touched.withColumn("__rn", F.row_number().over(Window.partitionBy("src", "dst").orderBy(*rest))).filter("__rn > __k")
    else:
        ordered = with_index(touched.withColumn("__key", F.struct("src", "dst")), [F.col("src"), F.col("dst"), *(F.col(c) for c in rest)], "__at")
        firsts = ordered.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
        left = join_counted(ordered, firsts, "__key", "__n", threshold).filter("__at - __first >= __k")
    return kept.select(*edges.columns).unionByName(left.select(*edges.columns))


def gather(edges: DataFrame, positions: DataFrame, index: str = "index") -> DataFrame:
    """The rows of ``edges`` (with an index column) at ``positions``, repeated as often as asked."""
    return positions.select(index).join(edges, index)


def as_multimap(edges: DataFrame) -> DataFrame:
    """(src, dst, attributes, n): every distinct row with its multiplicity."""
    return edges.groupBy(*edges.columns).agg(F.count(F.lit(1)).alias("n"))


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
