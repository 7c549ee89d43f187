"""Per-key totals by multi-level tree aggregation.

A few keys may hold most rows.  With a plain two-phase aggregate every task
that saw such a key sends one partial state to a single reducer; on hundreds of
thousands of tasks that reducer is the bottleneck.  Here the input is combined
per chunk first (the map-side half of the first aggregate; a chunk is one input
split, whose size is fixed by ``spark.sql.files.maxPartitionBytes``), and the
chunk states are merged in rounds: in each round the states of ``fan_in``
neighbouring chunks come together, so that a reducer never takes more than
``fan_in`` partial states of a key, and the number of rounds is the logarithm
of the number of chunks to the base ``fan_in``.  Keys that are rare in every chunk
leave the tree after the first round.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import MAX_HEAVY

#: Rows of a key in one first merge that make it hot.
HOT_ROWS = 10_000

#: How partial states of each kind are merged.
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
_FIRST = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def rounds_for(chunks: int, fan_in: int) -> int:
    """Number of merge rounds until one state per key is left; at least one."""
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    n, slots = 1, fan_in
    while slots < chunks:
        slots *= fan_in
        n += 1
    return n


def chunks_of(df: DataFrame) -> int:
    """Number of input partitions: asked of the plan of a scan, which is free; the shuffle setting for other plans, which asking would run.

    The result of a tree does not depend on it, only the number of rounds.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "InMemoryTableScan" in plan:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.rdd.getNumPartitions()


def tree_aggregate(df: DataFrame, keys: list[str], measures: dict[str, tuple[str, Column]], fan_in: int = 8, chunks: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Aggregate ``df`` by ``keys`` in logarithmic fan-in rounds.

    measures: output name -> (``count`` | ``sum`` | ``min`` | ``max``, column).
    chunks: number of input partitions, see :func:`chunks_of`.
    hot_rows: rows of a key within the chunks of one first merge from which on the
    key takes all rounds.  Every other key has less in each of them, so its states
    are few rows for one reducer; they are merged in one step after the first round
    and do not ride through the others.  A table of so many rows that more than
    MAX_HEAVY keys could be hot raises the number.

    Null keys form a group of their own, as in SQL; null values are ignored by
    every measure, and a group without any value has a null sum, min or max and
    a count of 0.  An empty input gives no rows.  Columns other than the keys
    and those used by the measures are not read.
    """
    clash = set(measures) & set(keys)
    if clash:
        raise ValueError(f"measures clash with keys: {sorted(clash)}")
    chunks = chunks if chunks is not None else chunks_of(df)
    slot, rows = "__slot", "__rows"
    while {slot, rows} & (set(keys) | set(measures)):
        slot, rows = slot + "_", rows + "_"
    taken = df.select(*(F.col(k) for k in keys), *(c.alias(f"__in_{name}") for name, (_, c) in measures.items()))
    merged = [_MERGE[kind](F.col(name)).alias(name) for name, (kind, _) in measures.items()]
    n = rounds_for(chunks, fan_in)
    first = [_FIRST[kind](F.col(f"__in_{name}")).alias(name) for name, (kind, _) in measures.items()]
    if n == 1:
        return taken.groupBy(*keys).agg(*first)
    state = taken.withColumn(slot, F.floor(F.spark_partition_id() / fan_in).cast("int"))
    state = state.groupBy(*keys, slot).agg(*first, F.count(F.lit(1)).alias(rows))
    if n == 2:
        return state.groupBy(*keys).agg(*merged)
    least = F.greatest(F.lit(hot_rows), F.ceil(state.agg(F.sum(rows)).scalar() / MAX_HEAVY))
    hot = F.broadcast(state.filter(F.col(rows) >= least).select(*(F.col(k).alias(f"__hot_{k}") for k in keys)).distinct())
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in keys))
    light = state.join(hot, same, "left_anti").groupBy(*keys).agg(*merged)
    heavy = state.join(hot, same, "left_semi")
    for level in range(1, n):
        heavy = heavy.withColumn(slot, F.floor(F.col(slot) / fan_in).cast("int"))
        heavy = heavy.groupBy(*keys, *([] if level == n - 1 else [slot])).agg(*merged)
    return light.unionByName(heavy)


def stack_fields(df: DataFrame, fields: list[str], carry: dict[str, Column] | None = None, field: str = "field", value: str = "key_value") -> DataFrame:
    """One row per input row and field: (field, value, carried columns).  One scan for all fields."""
    pairs = F.array(*(F.struct(F.lit(f).alias(field), F.col(f).alias(value)) for f in fields))
    rows = df.select(F.explode(pairs).alias("__pair"), *(c.alias(n) for n, c in (carry or {}).items()))
    return rows.select(f"__pair.{field}", f"__pair.{value}", *(carry or {}))


def vertex_totals(edges: DataFrame, fields: tuple[str, ...] = ("index1", "index2"), weight: str = "weight", fan_in: int = 8, chunks: int | None = None) -> DataFrame:
    """Counts and weight sums per vertex of each field, complete for hubs too.

    Returns (field, key_value, n_rows, n_weighted, weight_sum).  Null is not a
    value: rows whose field is null are left out for that field.  ``n_weighted``
    counts rows with a weight; ``weight_sum`` is null where there is none.
    """
    chunks = chunks if chunks is not None else chunks_of(edges)
    w = F.col(weight).cast("bigint")
    rows = stack_fields(edges, list(fields), {"__w": w}).filter(F.col("key_value").isNotNull())
    return tree_aggregate(
        rows,
        ["field", "key_value"],
        {"n_rows": ("count", F.lit(1)), "n_weighted": ("count", F.col("__w")), "weight_sum": ("sum", F.col("__w"))},
        fan_in,
        chunks,
    )


def hubs(edges: DataFrame, share: float = 0.01, fields: tuple[str, ...] = ("index1", "index2"), fan_in: int = 8, chunks: int | None = None) -> DataFrame:
    """Values that hold at least ``share`` of all rows, as (field, key_value, n_rows).

    "All rows" includes those whose field is null.  At most ``1 / share`` values
    per field can qualify.  An empty table has no hub.
    """
    totals = vertex_totals(edges, fields, fan_in=fan_in, chunks=chunks)
    all_rows = edges.agg(F.count(F.lit(1)).alias("n")).scalar()
    return totals.filter(F.col("n_rows") >= all_rows * F.lit(Decimal(str(share)))).select("field", "key_value", "n_rows")
