"""Cores and their peeling by arrays, for graphs whose edges fit one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Edges that one task takes, about 40 bytes each; larger graphs go by joins until what is left fits.
MOST_EDGES = 25_000_000
_SLICE = 200_000


def edge_cores(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The largest k for each edge such that it is in the k-core; vertices are 0 .. n-1, edges undirected and distinct."""
    core, left, k = np.zeros(len(a), np.int32), np.arange(len(a), dtype=np.int32), 0
    while len(left):
        degree = np.bincount(a[left], minlength=n) + np.bincount(b[left], minlength=n)
        k = max(k + 1, int(np.minimum(degree[a[left]], degree[b[left]]).min()))
        core[left] = k
        left = k_core(a, b, n, left, k + 1)
    return core


def k_core(a: np.ndarray, b: np.ndarray, n: int, among: np.ndarray, k: int) -> np.ndarray:
    """Those of the edges ``among`` that are in their k-core."""
    while len(among):
        enough = np.bincount(a[among], minlength=n) + np.bincount(b[among], minlength=n) >= k
        stay = enough[a[among]] & enough[b[among]]
        if stay.all():
            break
        among = among[stay]
    return among


def peel(a: np.ndarray, b: np.ndarray, n: int, leaves: bool = True) -> np.ndarray:
    """The peel of each edge, as in :func:`dense.core_edge_peel`; ``leaves``: those at a vertex of degree 1 leave first.

    Once a k-core has left, what is left has no k-core: with it the k-core would have
    been larger.  So each k comes once, downwards, and its core is looked for only
    among edges whose core number in the whole graph is k or more.
    """
    out = np.zeros(len(a), np.int32)
    if leaves:
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        out[(degree[a] == 1) | (degree[b] == 1)] = 1
    left = np.flatnonzero(out == 0).astype(np.int32)
    core = edge_cores(a, b, n)
    for k in range(int(core.max(initial=0)), 0, -1):
        out[k_core(a, b, n, left[core[left] >= k], k)] = k
        left = left[out[left] == 0]
    return out


def peel_batches(leaves: bool) -> Callable:
    """Edges (src, dst) of one partition as (src, dst, peel)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, ids = [], np.empty(0, np.int64)
        for b in batches:
            ends.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        # ids are merged by groups of batches and replaced batch by batch, to hold few copies
        for i in range(0, len(ends), 200):
            ids = np.unique(np.concatenate([ids, *(x for pair in ends[i : i + 200] for x in pair)]))
        if not len(ids):
            return
        for i, pair in enumerate(ends):
            ends[i] = tuple(np.searchsorted(ids, x).astype(np.int32) for x in pair)
        a, b = (np.concatenate([pair[k] for pair in ends]) for k in (0, 1))
        ends.clear()
        found = peel(a, b, len(ids), leaves)
        for i in range(0, len(a), _SLICE):
            s = slice(i, i + _SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[s]]), pa.array(ids[b[s]]), pa.array(found[s].astype(np.int64))], ["src", "dst", "peel"])

    return run
