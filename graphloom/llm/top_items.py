"""The most frequent values of a column: exact counts in bounded memory.

A hash aggregate with map-side combining counts every value; its hash partitions
spill to disk when they outgrow the memory of a task.  Each partition then keeps
only its own k largest, and one final ordered limit merges them.  Memory depends
on the size of a task, not on the number of distinct values, and counts are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_items(df: DataFrame, value: str | Column, k: int = 20, name: str = "item") -> DataFrame:
    """(item, n): the ``k`` most frequent values; ties go to the smaller value.

    Null is not a value.  Strings are compared exactly as they stand.  Fewer rows
    come out where there are fewer values, none from an empty table.  Counts are
    exact, so the values kept are the true ones.
    """
    v = F.col(value) if isinstance(value, str) else value
    counts = df.select(v.alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(name)).limit(k)


def top_of_fields(sources: dict[str, tuple[DataFrame, str]], k: int = 20) -> DataFrame:
    """(field, item, n) over several columns, items as strings (numbers in decimal digits)."""
    parts = [top_items(df, col, k).select(F.lit(field).alias("field"), F.col("item").cast("string").alias("item"), "n") for field, (df, col) in sources.items()]
    return reduce(DataFrame.unionByName, parts)
