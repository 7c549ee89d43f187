"""Joins that survive a key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this many rows is joined apart from the others.
HEAVY_ROWS = 100_000
#: At most this many keys are ever broadcast, whatever the data.
MAX_HEAVY = 20_000


def heavy_threshold(total_rows: int, heavy_rows: int = HEAVY_ROWS, max_heavy: int = MAX_HEAVY) -> int:
    """Rows that make a key heavy, such that at most ``max_heavy`` keys can be."""
    return max(heavy_rows, -(-total_rows // max_heavy))


def join_counted(rows: DataFrame, per_key: DataFrame, key: str, count: str, threshold: int, any_heavy: bool = True) -> DataFrame:
    """Inner join of ``rows`` with ``per_key`` (one row per ``key``), safe for hot keys.

    ``per_key[count]`` holds the number of rows each key has in ``rows``.  Keys
    with ``threshold`` rows or more are joined by broadcast, so that their rows
    stay in the partitions where they lie; there are at most
    ``len(rows) / threshold`` of them (see :func:`heavy_threshold`), which bounds
    the broadcast.  All other keys take an ordinary shuffle join in which no key
    exceeds the threshold.  Rows with a null key match nothing.
    """
    light = per_key.filter(F.col(count) < threshold).drop(count)
    if not any_heavy:
        return rows.join(light, key)
    heavy = F.broadcast(per_key.filter(F.col(count) >= threshold).drop(count))
    hot = rows.join(heavy, key)
    cold = rows.join(heavy.select(key), key, "left_anti").join(light, key)
    return hot.unionByName(cold)


def join_salted(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, threshold: int, any_heavy: bool = True) -> DataFrame:
    """As :func:`join_counted`, for values too large to broadcast: a heavy key is split by salts instead.

    The rows of a heavy key go to one salt per ``threshold`` rows, and its row of
    ``per_key`` is copied to each; only the names of heavy keys are broadcast.
    """
    if not any_heavy:
        return rows.join(per_key.drop(count), keys)
    salts = F.ceil(F.col(count) / threshold).cast("int")
    names = F.broadcast(per_key.filter(F.col(count) >= threshold).select(*keys, salts.alias("__salts")))
    salted = rows.join(names, keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
    copies = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col(count) >= threshold, salts - 1).otherwise(0)))).drop(count)
    return salted.join(copies, [*keys, "__salt"]).drop("__salt")


def join_any(rows: DataFrame, per_key: DataFrame, key: str, heavy_rows: int = HEAVY_ROWS, source: DataFrame | None = None) -> DataFrame:
    """Inner join with one row per ``key``, safe for hot keys of unknown counts; lazy, without a job of its own.

    Keys are counted with map-side combining; those that :func:`heavy_threshold`
    would call heavy (at most MAX_HEAVY) are split by salts, as in :func:`join_salted`.
    source: a plain table with the same keys as ``rows``, to count them there.
    """
    counts = (rows if source is None else source).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    least = F.greatest(F.lit(heavy_rows), F.ceil(counts.agg(F.sum("__n")).scalar() / MAX_HEAVY))
    names = F.broadcast(counts.filter(F.col("__n") >= least).select(key, F.ceil(F.col("__n") / heavy_rows).cast("int").alias("__salts")))
    plain = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "string")]
    salted = rows.join(names, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*plain), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
    copies = per_key.join(names, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return salted.join(copies, [key, "__salt"]).drop("__salt")
