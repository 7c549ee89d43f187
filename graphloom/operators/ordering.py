"""Positions and running sums over a global order, without a single-task window.

Rows are range-sorted; each range partition is numbered on its own, and the
totals of the partitions (one small row each) give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import Cutter

#: Rows that one task may gather for an ordered limit.
ONE_TASK = 100_000
_POS, _PART, _VALUE = "__pos", "__part", "__value"


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str, exclusive: bool = True, cutter: Cutter | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each one in ``order``.

    With ``exclusive=False`` the row itself counts too.  Null values count as 0.
    The order should be total; among equal rows it is arbitrary but fixed once.
    An empty input stays empty.
    """
    cutter = cutter or Cutter(df.sparkSession, "running-sum")
    ranged = df.withColumn(_VALUE, F.coalesce(value.cast("bigint"), F.lit(0))).repartitionByRange(*order).sortWithinPartitions(*order)
    table, _ = cutter.cut(ranged.withColumn(_POS, F.monotonically_increasing_id()).withColumn(_PART, F.spark_partition_id()))
    totals = table.groupBy(_PART).agg(F.sum(_VALUE).alias("t")).collect()  # one row per range partition
    offsets, before = [], 0
    for r in sorted(totals, key=lambda r: r[_PART]):
        offsets.append((r[_PART], before))
        before += r.t
    small = df.sparkSession.createDataFrame(offsets, f"{_PART} int, __offset bigint")
    w = Window.partitionBy(_PART).orderBy(_POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = table.withColumn(name, F.sum(_VALUE).over(w)).join(F.broadcast(small), _PART)
    total = F.col(name) + F.col("__offset") - (F.col(_VALUE) if exclusive else F.lit(0))
    return out.withColumn(name, total).drop(_POS, _PART, _VALUE, "__offset")


def with_index(df: DataFrame, order: list[Column], name: str = "index", cutter: Cutter | None = None) -> DataFrame:
    """``df`` with dense positions 0, 1, ... in ``order``."""
    return running_sum(df, order, F.lit(1), name, True, cutter)


def running_max(df: DataFrame, order: list[Column], value: Column, name: str, cutter: Cutter | None = None) -> DataFrame:
    """``df`` with the largest value up to and including each row in ``order``; null before the first value."""
    cutter = cutter or Cutter(df.sparkSession, "running-max")
    ranged = df.withColumn(_VALUE, value).repartitionByRange(*order).sortWithinPartitions(*order)
    table, _ = cutter.cut(ranged.withColumn(_POS, F.monotonically_increasing_id()).withColumn(_PART, F.spark_partition_id()))
    tops = sorted(table.groupBy(_PART).agg(F.max(_VALUE).alias("t")).collect(), key=lambda r: r[_PART])  # one row per range partition
    before, offsets = None, []
    for r in tops:
        offsets.append((r[_PART], before))
        before = r.t if before is None or r.t is not None and r.t > before else before
    kind = table.schema[_VALUE].dataType.simpleString()
    small = df.sparkSession.createDataFrame(offsets, f"{_PART} int, __offset {kind}")
    w = Window.partitionBy(_PART).orderBy(_POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = table.join(F.broadcast(small), _PART).withColumn(name, F.greatest(F.max(_VALUE).over(w), F.col("__offset")))
    return out.drop(_POS, _PART, _VALUE, "__offset")


def least_by(df: DataFrame, order: list[Column], n: int, cutter: Cutter | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """The first ``n`` rows in ``order``, which should be total.

    Up to ``one_task`` rows they come through one task; more are cut off a range sort.
    """
    if n <= one_task:
        return df.orderBy(*order).limit(n)
    return with_index(df, order, "__at", cutter).filter(F.col("__at") < n).drop("__at")


def bounds(values: DataFrame, among: DataFrame, value: str = "x", cutter: Cutter | None = None) -> DataFrame:
    """(value, lower, upper): for each distinct value how many of ``among.<value>`` are less, and how many are not greater.

    The positions that a binary search in the sorted column finds, by one range sort
    of both tables together.  Nulls are left out.
    """
    v = values.filter(F.col(value).isNotNull()).select(value).distinct()
    asked = v.select(value, F.explode(F.array(F.lit(0), F.lit(2))).alias("__kind"))
    both = asked.unionByName(among.filter(F.col(value).isNotNull()).select(value, F.lit(1).alias("__kind")))
    ranked = running_sum(both, [F.col(value), F.col("__kind")], (F.col("__kind") == 1).cast("int"), "__n", True, cutter)
    return ranked.filter("__kind <> 1").groupBy(value).agg(F.max(F.when(F.col("__kind") == 0, F.col("__n"))).alias("lower"), F.max(F.when(F.col("__kind") == 2, F.col("__n"))).alias("upper"))


def range_lookup(values: DataFrame, ranges: DataFrame, value: str, start: str, label: str, cutter: Cutter | None = None) -> DataFrame:
    """``values`` with the ``label`` of the range in which ``value`` lies: the one of the largest ``start`` up to it.

    Null before the first range and for null values.  Starts should be distinct;
    of equal ones the largest label counts.
    """
    cutter = cutter or Cutter(values.sparkSession, "range-lookup")
    whole = F.struct(*values.columns)
    one = values.select(F.col(value).alias("__x"), F.lit(1).alias("__kind"), whole.alias("__row"), F.lit(None).cast(ranges.schema[label].dataType).alias("__label"), F.lit(None).cast(ranges.schema[start].dataType).alias("__start"))
    two = ranges.filter(F.col(start).isNotNull()).select(F.col(start).alias("__x"), F.lit(0).alias("__kind"), F.lit(None).cast(one.schema["__row"].dataType).alias("__row"), F.col(label).alias("__label"), F.col(start).alias("__start"))
    found = running_max(one.unionByName(two), [F.col("__x"), F.col("__kind")], F.when(F.col("__start").isNotNull(), F.struct("__start", "__label")), "__found", cutter)
    return found.filter("__kind = 1").select("__row.*", F.when(F.col("__x").isNotNull(), F.col("__found.__label")).alias(label))


def merge(a: DataFrame, b: DataFrame, order: list[Column]) -> DataFrame:
    """The rows of two tables of the same columns in one order."""
    return a.unionByName(b).orderBy(*order)
