"""Filling containers of fixed capacity: bulk-synchronous best-fit.

State: items that wait for a place, and gaps of open containers.  One round

1. range-sorts items and gaps together by size, the largest first,
2. sweeps every range: an item takes the smallest gap that holds it (its successor
   in the sort order); the rest of the gap may be taken again,
3. matches what is left over between ranges by rank: the leftover items and gaps of
   all ranges form a sequence in which every item closes the nearest gap before it,
   so a plan over the leftover *counts* (one row per range) pairs them without
   conflict,
4. updates the gaps, and repeats.

The ranges are cut from a histogram of sizes, not from a sample: a range holds at
most twice the rows of a sweep, and a size that is too frequent for one range is
spread over several by a hash of the id.  The placements so depend on the data
alone, not on partitions or cores.

When no waiting item fits any gap, as many containers are opened as the waiting
items need at least, each by one of the largest of them.  A container is named
by the piece that opened it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import heavy_threshold, join_counted
from ..plans.loops import Cutter

#: Rows of one sweep at least; a range holds at most twice as many, in a Python worker.
ROWS_PER_SWEEP = 10_000
#: Ranges of all containers together, about; sweeps grow beyond ROWS_PER_SWEEP only with more rows than both numbers allow.
MAX_RANGES = 20_000
#: Histogram rows (sizes of all containers) up to which the histogram is broadcast.
MAX_SIZES = 500_000
#: Containers are a small table of settings; more is an error, not a slow run.
MAX_CONTAINERS = 1_000
PLACED, GAP, ITEM, SMALL = 0, 1, 2, 3
_ROUND = "container string, kind int, size int, id bigint, piece int, bin_id bigint, bin_piece int, part bigint, rank bigint"


def best_fit_sweep(sizes: np.ndarray, is_item: np.ndarray) -> tuple[dict[int, int], dict[int, int]]:
    """One sweep over rows sorted from large to small, gaps before items of equal size.

    Returns item row -> gap row, and gap row -> what is left of it.  Gaps are kept
    in stacks by size; a bit set finds the smallest size that holds an item.
    """
    least = int(sizes[-1]) if len(sizes) else 0
    stacks: dict[int, list[int]] = defaultdict(list)
    mask = 0
    placed: dict[int, int] = {}
    left: dict[int, int] = {}
    for row, (size, item) in enumerate(zip(sizes.tolist(), is_item.tolist(), strict=True)):
        if item:
            fits = mask >> size
            if not fits:
                continue
            at = size + (fits & -fits).bit_length() - 1
            gap = stacks[at].pop()
            if not stacks[at]:
                mask &= ~(1 << at)
            placed[row] = gap
            rest = at - size
            left[gap] = rest
            if rest < least:
                continue
        else:
            gap, rest = row, size
            left[gap] = rest
        stacks[rest].append(gap)
        mask |= 1 << rest
    return placed, left


def _sweep_range(key: tuple, seg: pd.DataFrame) -> pd.DataFrame:
    container, part = key
    seg = seg.sort_values(["size", "kind", "id", "piece"], ascending=[False, True, True, True], ignore_index=True)
    sizes, is_item = seg["size"].to_numpy(), (seg["kind"] == ITEM).to_numpy()
    placed, left = best_fit_sweep(sizes, is_item)
    least = int(sizes[-1])
    done = np.fromiter(placed, np.int64, len(placed))
    bins = np.fromiter(placed.values(), np.int64, len(placed))
    ids, pieces = seg["id"].to_numpy(), seg["piece"].to_numpy()
    gap_rows = np.fromiter(left, np.int64, len(left))
    gap_left = np.fromiter(left.values(), np.int64, len(left))
    order = np.argsort(gap_left, kind="stable")
    gap_rows, gap_left = gap_rows[order], gap_left[order]
    wide = gap_left >= least
    waiting = is_item.copy()
    waiting[done] = False
    wait = np.flatnonzero(waiting)

    def frame(kind, size, rows, rank, bin_rows=None):
        return pd.DataFrame({"container": container, "kind": np.int32(kind), "size": size.astype(np.int32), "id": ids[rows], "piece": pieces[rows], "bin_id": ids[bin_rows] if bin_rows is not None else np.int64(-1), "bin_piece": pieces[bin_rows] if bin_rows is not None else np.int32(-1), "part": np.int64(part), "rank": rank})

    fresh = seg["fresh"].to_numpy()
    opened = np.flatnonzero(fresh > 0)
    return pd.concat(
        [
            frame(PLACED, sizes[done], done, np.zeros(len(done), np.int64), bins),
            frame(PLACED, fresh[opened], opened, np.zeros(len(opened), np.int64), opened),
            frame(GAP, gap_left[wide], gap_rows[wide], np.arange(wide.sum())),
            frame(SMALL, gap_left[~wide], gap_rows[~wide], np.zeros((~wide).sum(), np.int64)),
            frame(ITEM, sizes[wait], wait, np.arange(len(wait))),
        ],
        ignore_index=True,
    )


def ranged(state: DataFrame, total: int, n_sizes: int, rows_per_sweep: int) -> DataFrame:
    """The state with ``part``, the number of its range: the ranges of a container go from large to small.

    total: rows of the state; n_sizes: most rows that the histogram can have.
    """
    per = max(rows_per_sweep, -(-total // MAX_RANGES))
    key = F.concat_ws("|", "size", "kind", "container").alias("key")
    counts = state.groupBy("container", "size", "kind").agg(F.count(F.lit(1)).alias("n"))
    # one window per container over at most twice as many rows as its capacity
    before = F.coalesce(F.sum("n").over(Window.partitionBy("container").orderBy(F.desc("size"), "kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = counts.select(key, "n", F.floor(before / per).alias("step"), F.ceil(F.col("n") / per).alias("split"))
    keyed = state.select("*", key)
    if n_sizes <= MAX_SIZES:
        joined = keyed.join(F.broadcast(plan.drop("n")), "key")
    else:
        joined = join_counted(keyed, plan, "key", "n", heavy_threshold(total))
    split = F.when(F.col("split") > 1, 1 + F.pmod(F.xxhash64("id", "piece"), F.col("split"))).otherwise(0)
    return joined.select(*state.columns, (F.shiftleft(F.col("step").cast("bigint"), 24) + split).alias("part"))


def match_leftovers(parts: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Pair leftovers of ranges, given (part, items, gaps) from large to small.

    Returns (gap part, first gap rank, item part, first item rank, length): within
    a range the items come before the gaps, and each item takes the nearest gap
    before it.  At most two intervals per range come out.
    """
    stack: list[list[int]] = []
    pairs = []
    for part, items, gaps in parts:
        taken = 0
        while taken < items and stack:
            at, first, count = stack[-1]
            n = min(count, items - taken)
            pairs.append((at, first, part, taken, n))
            taken += n
            if n == count:
                stack.pop()
            else:
                stack[-1] = [at, first + n, count - n]
        if gaps:
            stack.append([part, 0, gaps])
    return pairs


def pack(sizes: DataFrame, containers: list[tuple[str, int]], id_col: str = "doc_id", size_col: str = "n_tokens", rows_per_sweep: int = ROWS_PER_SWEEP, max_rounds: int = 10_000) -> DataFrame:
    """Place every item into containers of each capacity.

    sizes: one row per item, a unique non-null id and its size; a null size is no
    item.  Returns (container, bin_id, doc_id, piece_no, start_token, n_tokens),
    one row per piece.  Only items larger than the capacity are split: into full
    pieces and a rest.  Items of size 0 take no space and go to the first
    container that is open, or one of their own if there is none.  Repeated ids
    are the caller's error.  No items, no rows.
    """
    if len(containers) > MAX_CONTAINERS:
        raise ValueError(f"more than {MAX_CONTAINERS} containers")
    if len({c for c, _ in containers}) < len(containers) or any(c is None or k is None or k < 1 for c, k in containers):
        raise ValueError("containers need distinct names and capacities of 1 or more")
    spark = sizes.sparkSession
    cutter = Cutter(spark, "packing")
    capacity = dict(containers)
    base, _ = cutter.cut(sizes.select(F.col(id_col).cast("bigint").alias("id"), F.col(size_col).cast("bigint").alias("n")).filter("n is not null"))
    kinds = F.array(*(F.struct(F.lit(c).alias("container"), F.lit(k).alias("capacity")) for c, k in containers)) if containers else F.array().cast("array<struct<container:string,capacity:int>>")
    each = base.filter("n > 0").select("id", "n", F.explode(kinds).alias("c")).select("id", "n", "c.container", "c.capacity")
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.col("capacity")).cast("int"))))
    pieces = pieces.select("container", "id", "piece", "capacity", F.least(F.col("capacity").cast("bigint"), F.col("n") - F.col("piece").cast("bigint") * F.col("capacity")).cast("int").alias("size"))
    full = pieces.filter("size = capacity").select("container", F.col("id").alias("bin_id"), F.col("piece").alias("bin_piece"), "id", "piece", "size")
    # fresh: size of the piece that opened a container since the last sweep, which records it.
    state = pieces.filter("size < capacity").select("container", F.lit(ITEM).alias("kind"), "size", "id", "piece", F.lit(0).alias("fresh"))
    swept_paths, met_paths = [], []
    rows = {r.container: r.n for r in state.groupBy("container").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_sizes = 2 * sum(capacity.values())
    for _ in range(max_rounds):
        if not rows:
            break
        parts = ranged(state, sum(rows.values()), n_sizes, rows_per_sweep)
        swept, path = cutter.cut(parts.groupBy("container", "part").applyInPandas(_sweep_range, _ROUND))
        swept_paths.append(path)
        big = F.create_map(*(x for c, k in containers for x in (F.lit(c), F.lit(k))))[F.col("container")]
        item, gap = F.col("kind") == ITEM, F.col("kind") == GAP
        counts = swept.groupBy("container", "part").agg(
            F.count_if(item).alias("items"), F.count_if(gap).alias("gaps"), F.max(F.when(F.col("kind") == SMALL, F.col("size"))).alias("small"),
            F.sum(F.when(item, F.col("size")).otherwise(0)).alias("tokens"), F.count_if(item & (F.col("size") * 2 > big)).alias("halves"), F.min(F.when(item, F.col("size"))).alias("least"),
        ).collect()  # one row per range, which MAX_RANGES bounds
        steps, least, rows = [], {}, {}
        pair = 0
        for c in capacity:
            own = sorted((r for r in counts if r.container == c), key=lambda r: r.part)
            waiting = sum(r.items for r in own)
            if not waiting:
                continue
            least[c] = min(r.least for r in own if r.least is not None)
            matched = match_leftovers((r.part, r.items, r.gaps) for r in own)
            for at, first, to, start, n in matched:
                steps += [(c, at, GAP, first, first + n, pair - first, False), (c, to, ITEM, start, start + n, pair - start, False)]
                pair += n
            rows[c] = waiting + sum(r.gaps for r in own)
            if not matched and max((r.small for r in own if r.small is not None), default=0) < least[c]:
                opened = max(1, sum(r.halves for r in own), -(-sum(r.tokens for r in own) // capacity[c]))
                for r in own:
                    n = min(opened, r.items)
                    if n:
                        steps.append((c, r.part, ITEM, 0, n, 0, True))
                    opened -= n
        if not rows:
            break
        alive = swept.filter((F.col("kind") != PLACED) & F.col("container").isin(*least))
        floor = F.create_map(*(x for c, v in least.items() for x in (F.lit(c), F.lit(v))))[F.col("container")]
        alive = alive.filter((F.col("kind") == ITEM) | (F.col("size") >= floor))
        # At most three intervals per range: the broadcast is bounded by their number.
        plan = F.broadcast(spark.createDataFrame(steps, "p_container string, p_part bigint, p_kind int, lo bigint, hi bigint, shift bigint, opens boolean"))
        on = (F.col("container") == F.col("p_container")) & (F.col("part") == F.col("p_part")) & (F.col("kind") == F.col("p_kind")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
        marked = alive.join(plan, on, "left").withColumn("kind", F.when(F.col("kind") == SMALL, GAP).otherwise(F.col("kind")))
        new = marked.filter("opens")
        born = new.select("container", F.lit(GAP).alias("kind"), (big - F.col("size")).alias("size"), "id", "piece", F.col("size").alias("fresh"))
        state = marked.filter("opens is null").select("container", "kind", "size", "id", "piece", F.lit(0).alias("fresh")).unionByName(born)
        if pair:
            both = marked.filter("not opens").withColumn("pair", F.col("rank") + F.col("shift"))
            g = both.filter(gap).select("pair", F.col("size").alias("room"), F.col("id").alias("bin_id"), F.col("piece").alias("bin_piece"))
            i = both.filter(item).select("pair", "container", "size", "id", "piece")
            met, path = cutter.cut(i.join(g, "pair"))
            met_paths.append(path)
            state = state.unionByName(met.select("container", F.lit(GAP).alias("kind"), (F.col("room") - F.col("size")).alias("size"), F.col("bin_id").alias("id"), F.col("bin_piece").alias("piece"), F.lit(0).alias("fresh")))
    else:
        raise RuntimeError(f"items are left after {max_rounds} rounds")
    columns = ["container", "bin_id", "bin_piece", "id", "piece", "size"]
    placed = full.select(*columns)
    if swept_paths:
        placed = placed.unionByName(spark.read.schema(_ROUND).parquet(*swept_paths).filter(F.col("kind") == PLACED).select(*columns))
    if met_paths:
        placed = placed.unionByName(spark.read.schema(met.schema).parquet(*met_paths).select(*columns))
    firsts = {r.container: (r.f.bin_id, r.f.bin_piece) for r in placed.groupBy("container").agg(F.min(F.struct("bin_id", "bin_piece")).alias("f")).collect()} if containers else {}
    nothing = base.filter("n <= 0")
    alone = nothing.agg(F.min("id")).first()[0]
    if alone is not None:
        homes = F.array(*(F.struct(F.lit(c).alias("container"), F.lit(firsts.get(c, (alone, 0))[0]).cast("bigint").alias("bin_id"), F.lit(firsts.get(c, (alone, 0))[1]).cast("int").alias("bin_piece")) for c, _ in containers))
        placed = placed.unionByName(nothing.select("id", F.explode(homes).alias("h")).select("h.*", "id", F.lit(0).alias("piece"), F.lit(0).alias("size")))
    cap = F.create_map(*(x for c, k in containers for x in (F.lit(c), F.lit(k).cast("bigint"))))[F.col("container")] if containers else F.lit(0)
    return placed.select("container", F.concat_ws("-", F.lit("bin"), "bin_id", "bin_piece").alias("bin_id"), F.col("id").alias(id_col), F.col("piece").alias("piece_no"), (F.col("piece") * cap).alias("start_token"), F.col("size").cast("bigint").alias("n_tokens"))


def fill_report(placed: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """(container, capacity, n_bins, n_pieces, n_tokens, least_bins, unused_share) per container."""
    cap = F.create_map(*(x for c, k in containers for x in (F.lit(c), F.lit(k).cast("bigint"))))[F.col("container")]
    bins = placed.groupBy("container", "bin_id").agg(F.count(F.lit(1)).alias("p"), F.sum("n_tokens").alias("t"))
    r = bins.groupBy("container").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("p").alias("n_pieces"), F.sum("t").alias("n_tokens")).withColumn("capacity", cap)
    return r.select("container", "capacity", "n_bins", "n_pieces", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_bins"), (1 - F.col("n_tokens") / (F.col("n_bins") * F.col("capacity"))).alias("unused_share"))


def whole_report(placed: DataFrame, sizes: DataFrame, containers: list[tuple[str, int]], id_col: str = "doc_id", size_col: str = "n_tokens", unused: float = 0.01) -> DataFrame:
    """(container, n_texts, n_overfull, n_needless_splits, n_incomplete, tight): what a right placement must fulfil.

    tight: of the containers beyond the least number, at most the share ``unused`` of
    that number and one more were opened.
    """
    cap = F.create_map(*(x for c, k in containers for x in (F.lit(c), F.lit(k).cast("bigint"))))[F.col("container")]
    texts = placed.groupBy("container", F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("t"))
    known = texts.join(sizes.select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("n")), "id", "left")
    by_text = known.groupBy("container").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= cap)).alias("n_needless_splits"), F.count_if(~F.col("t").eqNullSafe(F.col("n"))).alias("n_incomplete"))
    bins = placed.groupBy("container", "bin_id").agg(F.sum("n_tokens").alias("t"))
    by_bin = bins.groupBy("container").agg(F.count_if(F.col("t") > cap).alias("n_overfull"), F.count(F.lit(1)).alias("b"), F.sum("t").alias("t"))
    tight = F.col("b") <= F.ceil(F.col("t") / cap) * (1 + unused) + 1
    return by_text.join(by_bin.withColumn("tight", tight), "container").select("container", "n_texts", "n_overfull", "n_needless_splits", "n_incomplete", "tight")
