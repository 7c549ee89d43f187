"""Mixing sources to target weights: capped water-filling and seeded repetition."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Targets are a small table of settings; more is an error, not a slow run.
MAX_SOURCES = 10_000
#: Buckets per level of the histogram that finds the fractional part of a source.
BUCKETS = 1024


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


def water_fill(supply: dict[str, int], targets: list[Target], total: int | None = None) -> dict[str, float]:
    """Epochs per source, so that the sizes used come as near to the shares as the caps allow.

    total: size of the mix; by default the size of all targeted sources together.
    A source that would need more than ``max_repeats`` epochs is clamped there; what
    it lacks goes to the others in proportion to their shares, until nothing has to
    be clamped.  A source without records supplies nothing.  If all sources are
    clamped the mix is smaller than ``total``.
    """
    sizes = {t.source: supply.get(t.source, 0) or 0 for t in targets}
    rest = float(sum(sizes.values()) if total is None else total)
    epochs = {t.source: 0.0 for t in targets}
    open_ = [t for t in targets if t.share > 0]
    while open_:
        weight = sum(t.share for t in open_)
        full = [t for t in open_ if rest * t.share / weight >= sizes[t.source] * t.max_repeats]
        if not full:
            for t in open_:
                epochs[t.source] = rest * t.share / weight / sizes[t.source]
            break
        for t in full:
            epochs[t.source] = float(t.max_repeats) if sizes[t.source] else 0.0
            rest -= sizes[t.source] * t.max_repeats
        names = {t.source for t in full}
        open_ = [t for t in open_ if t.source not in names]
    return epochs


def _bucket(key: Column, seed: int, level: int) -> Column:
    """Bucket of a record at a level; the levels are different digits of one seeded hash."""
    return F.pmod(F.shiftright(F.xxhash64(key, F.lit(seed)), 20 * level), F.lit(BUCKETS)).cast("int")


def mix(counts: DataFrame, targets: list[Target], total: int | None = None, seed: int = 0, id_col: str = "doc_id", source: str = "source", size: str = "n_tokens") -> DataFrame:
    """(doc_id, source, n_tokens, copies): the records of the mix, ``copies`` >= 1 times each.

    Every record of a source is taken floor(epochs) times; the fraction that is
    left is met by taking some records once more, chosen by a seeded hash: a
    histogram of sizes over hash buckets gives the bucket at which the fraction is
    reached, and a second histogram refines that bucket.  Both stay in the plan; the
    driver sees one row per source.  The choice depends on the id and the seed
    alone, not on partitions.  Where no fraction is left, no record is taken more.

    Records with a null or an untargeted source and records without a size belong
    to no target and are left out.  Empty records (size 0) count as records.
    """
    if len(targets) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    if len({t.source for t in targets}) < len(targets):
        raise ValueError("targets need distinct sources")
    spark = counts.sparkSession
    names = F.broadcast(spark.createDataFrame([(t.source,) for t in targets], "source string"))  # MAX_SOURCES rows
    rows = counts.select(F.col(id_col).alias(id_col), F.col(source).alias("source"), F.col(size).cast("bigint").alias("n_tokens")).filter("n_tokens is not null").join(names, "source")
    rows = rows.withColumn("b0", _bucket(F.col(id_col), seed, 0)).withColumn("b1", _bucket(F.col(id_col), seed, 1))
    supply = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # MAX_SOURCES rows
    epochs = water_fill(supply, targets, total)
    wanted = [(s, math.floor(e), (e - math.floor(e)) * supply.get(s, 0)) for s, e in epochs.items()]
    plan = F.broadcast(spark.createDataFrame(wanted, "source string, whole int, want double"))
    # A source has BUCKETS rows at most in each window; the histograms are never collected.
    coarse = _filled(rows.groupBy("source", "b0").agg(F.sum("n_tokens").alias("n")), "b0").join(plan, "source")
    first = coarse.groupBy("source", "whole", "want").agg(F.min(F.when(F.col("before") + F.col("n") > F.col("want"), F.struct("b0", "before"))).alias("at"))
    first = first.select("source", "whole", F.when(F.col("want") <= 0, 0).otherwise(F.coalesce("at.b0", F.lit(BUCKETS))).alias("e0"), F.when(F.col("want") > 0, F.col("want") - F.col("at.before")).alias("rest"))
    first = F.broadcast(first)
    within = rows.join(first.filter("rest is not null").select("source", F.col("e0").alias("b0"), "rest"), ["source", "b0"])
    fine = _filled(within.groupBy("source", "rest", "b1").agg(F.sum("n_tokens").alias("n")), "b1")
    # The nearest end: a bucket is taken as long as half of it is still wanted.
    last = fine.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("before") + F.col("n") / 2 > F.col("rest"), F.col("b1"))), F.lit(BUCKETS)).alias("e1"))
    edges = F.broadcast(first.join(F.broadcast(last), "source", "left").select("source", "whole", "e0", F.coalesce("e1", F.lit(0)).alias("e1")))
    extra = (F.col("b0") < F.col("e0")) | ((F.col("b0") == F.col("e0")) & (F.col("b1") < F.col("e1")))
    return rows.join(edges, "source").withColumn("copies", F.col("whole") + extra.cast("int")).filter("copies > 0").select(id_col, "source", "n_tokens", "copies")


def _filled(histogram: DataFrame, bucket: str) -> DataFrame:
    """The histogram of each source with the sizes ``before`` a bucket."""
    w = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return histogram.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def whole_report(counts: DataFrame, mixed: DataFrame, targets: list[Target], id_col: str = "doc_id", source: str = "source", size: str = "n_tokens", slack: float = 0.005) -> DataFrame:
    """(source, within_cap, even, met): what a right mix must fulfil, for each target.

    within_cap: no record is used more than ``max_repeats`` times; even: the copies of
    any two records of the source differ by one at most; met: the share reached is
    not below the target by more than ``slack``, unless every record of the source
    is used as often as it may be.
    """
    report = mix_report(counts, mixed, targets, source, size)
    mine = counts.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(size).alias("t")).filter("t is not null").join(mixed.select(F.col(id_col).alias("id"), "copies"), "id", "left")
    used = mine.groupBy("source").agg(F.max(F.coalesce("copies", F.lit(0))).alias("most"), F.min(F.coalesce("copies", F.lit(0))).alias("least"))
    full = F.col("mixed_tokens") >= F.col("available_tokens") * F.col("max_repeats")
    facts = report.join(used, "source", "left")
    return facts.select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), (F.coalesce(F.col("most") - F.col("least"), F.lit(0)) <= 1).alias("even"), (full | (F.col("actual_share") >= F.col("target_share") - slack)).alias("met"))


def mix_report(counts: DataFrame, mixed: DataFrame, targets: list[Target], source: str = "source", size: str = "n_tokens") -> DataFrame:
    """Shares reached: (source, target_share, max_repeats, available_tokens, mixed_tokens, epochs, n_records, n_copies, actual_share).

    One row per target, also for sources without records; the shares are null if
    the mix is empty.
    """
    spark = counts.sparkSession
    goals = spark.createDataFrame([(t.source, float(t.share), int(t.max_repeats)) for t in targets], "source string, target_share double, max_repeats int")
    have = counts.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("available_tokens"))
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("n_records"), F.sum("copies").alias("n_copies"))
    all_ = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).scalar()
    rows = goals.join(have, "source", "left").join(used, "source", "left").fillna(0, ["available_tokens", "mixed_tokens", "n_records", "n_copies"])
    return rows.withColumn("epochs", F.when(F.col("available_tokens") > 0, F.col("mixed_tokens") / F.col("available_tokens")).otherwise(0.0)).withColumn("actual_share", F.col("mixed_tokens") / F.nullif(all_, F.lit(0))).select("source", "target_share", "max_repeats", "available_tokens", "mixed_tokens", "epochs", "n_records", "n_copies", "actual_share")
