"""A bounded bitmap of keys, to drop rows before they are shuffled for a join.

The bitmap has at most ``MAX_BUCKETS`` rows of 4 KB and is broadcast.  It lets every
row pass whose key is among the keys, and few others; with more keys than it can
tell apart it lets more rows pass, which costs time but loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row of the bitmap.
BUCKET_BITS = 32_768
#: Rows of the bitmap at most: 8192 of 4 KB, 32 MB.
MAX_BUCKETS = 8_192
#: Bits spent on a key while the bound allows it.
BITS_PER_KEY = 16


def buckets_for(n_keys: int) -> int:
    """Rows of the bitmap of so many keys."""
    return min(MAX_BUCKETS, max(1, -(-n_keys * BITS_PER_KEY // BUCKET_BITS)))


def _place(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets * BUCKET_BITS))


def keys_among(rows: DataFrame, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """The rows whose ``key`` may be in ``keys.key``: all that are, and few that are not.  Null keys are dropped.

    n_keys: about the number of keys, which sets the size of the bitmap.
    """
    buckets = buckets_for(n_keys)
    at = _place(key, buckets)
    given = keys.filter(F.col(key).isNotNull()).select(F.floor(at / BUCKET_BITS).alias("__bucket"), F.pmod(at, F.lit(BUCKET_BITS)).alias("__bit"))
    bitmaps = given.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    bit = F.pmod(at, F.lit(BUCKET_BITS))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("getbit", byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    return rows.filter(F.col(key).isNotNull()).join(F.broadcast(bitmaps), (F.floor(at / BUCKET_BITS) == F.col("__bucket")) & is_set, "left_semi")
