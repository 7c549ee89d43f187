"""Queries that run on the whole edge table, beside brute force on a small one."""

import json
from collections import deque
from itertools import combinations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

#: (src, dst, weight) of a base file and of a batch: a clique of 5, a triangle, a path, a self-loop, parallel edges, a pair in both directions.
BASE = [(a, b, a + b) for a, b in combinations(range(5), 2) if (a, b) != (1, 3)] + [(4, 5, 7), (5, 6, -3), (6, 4, 2), (6, 7, 9), (7, 7, 1), (0, 1, 4), (1, 0, 5)]
BATCH = [(1, 3, 8), (7, 8, -6), (8, 9, 3), (9, 7, 1), (2, 1, 3)]
ROWS = [(*e, 1) for e in BASE] + [(*e, 2) for e in BATCH]
N = 12


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    n = len(ROWS)
    put = lambda name, **cols: pq.write_table(pa.table(cols), f"{d}/{name}.parquet")
    put(
        "coo_edges", edge_id=pa.array(range(n), pa.int64()), graph_id=pa.array([r[3] for r in ROWS], pa.int64()), line_no=pa.array(range(n), pa.int64()), index1=pa.array([r[0] + 1 for r in ROWS], pa.int64()),
        index2=pa.array([r[1] + 1 for r in ROWS], pa.int64()), weight=pa.array([r[2] for r in ROWS], pa.int32()), w1=pa.array([0.5] * n, pa.float32()), seen_at=pa.array([0] * n, pa.timestamp("us")),
    )
    put("graph_info", graph_id=pa.array([1, 2], pa.int64()), file_format=pa.array(["mtx", "snap"]))
    put("anchor_vertices", id=pa.array([0, 1], pa.int64()), label=pa.array(["a", "b"]))
    put("vertices", id=pa.array(range(2, N), pa.int64()), label=pa.array(["v"] * (N - 2)))
    return str(d)


@pytest.fixture
def run(spark, tables):
    return lambda name: entry.queries()[name](spark, tables)


def pairs(rows=ROWS):
    return {tuple(sorted(r[:2])) for r in rows if r[0] != r[1]}


def neighbours(edges):
    out = {v: set() for v in range(N)}
    for a, b in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def supports(edges):
    near = neighbours(edges)
    return {(a, b): len(near[a] & near[b]) for a, b in edges}


def truss(k):
    edges = pairs()
    while len(kept := {e for e, s in supports(edges).items() if s >= k - 2}) < len(edges):
        edges = kept
    return edges


def peel():
    """Leaf edges, then the innermost core again and again."""
    left, out = pairs(), {}
    near = neighbours(left)
    for a, b in [e for e in left if min(len(near[e[0]]), len(near[e[1]])) == 1]:
        out[a, b] = 1
    left -= out.keys()
    while left:
        k, core = 0, left
        while core:
            k, inner = k + 1, core
            while core and (low := {v for v, x in neighbours(core).items() if 0 < len(x) < k + 1}):
                core = {e for e in core if not low & {*e}}
        out |= dict.fromkeys(inner, k)
        left = left - inner
    return out


def brandes():
    near, total = neighbours(pairs()), dict.fromkeys(range(N), 0.0)
    for root in range(N):
        far, sigma, order, todo = {root: 0}, {root: 1.0}, [], deque([root])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    todo.append(w)
                if far[w] == far[v] + 1:
                    sigma[w] = sigma.get(w, 0) + sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if far[v] == far[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != root:
                total[w] += delta[w]
    return total


def test_supports_of_the_whole_table(run):
    assert {(r.src, r.dst): r.support for r in run("g_edge_support").collect()} == supports(pairs())
    assert {(r.src, r.dst): r.support for r in run("g_support_after_erase").collect()} == supports(pairs([r for r in ROWS if r[3] == 1]))


@pytest.mark.parametrize("k", [3, 4])
def test_trusses_of_the_whole_table(run, k):
    assert {tuple(r) for r in run(f"g_truss_{k}").collect()} == truss(k)


@pytest.mark.parametrize("name", ["g_truss_numbers", "g_truss_dynamic"])
def test_truss_numbers_of_the_whole_table(run, name):
    want = {e: max(k for k in range(2, 8) if e in truss(k)) for e in pairs()}
    assert {(r.src, r.dst): r.truss for r in run(name).collect()} == want


def test_truss_numbers_after_batches(spark):
    import random

    from graphloom.algorithms import dense

    rng = random.Random(3)
    every = list(combinations(range(14), 2))
    old = set(rng.sample(every, 50))
    gone, new = set(rng.sample(sorted(old), 9)), set(rng.sample(sorted(set(every) - old), 6))

    def numbers(edges):
        out, k, left = dict.fromkeys(edges, 2), 3, set(edges)
        while left:
            near = {v: {b for a, b in left if a == v} | {a for a, b in left if b == v} for v in range(14)}
            low = {(a, b) for a, b in left if len(near[a] & near[b]) < k - 2}
            left -= low
            if not low:
                out |= dict.fromkeys(left, k)
                k += 1
        return out

    df = lambda e: spark.createDataFrame(sorted(e), "src bigint, dst bigint")
    both = df(old | {(b, a) for a, b in old})
    for heavy in (3, 100_000):
        before = dense.truss_numbers_of(both, heavy_rows=heavy)
        assert {(r.src, r.dst): r.truss for r in before.collect()} == numbers(old)
    after = dense.truss_numbers_after(both, before, df({(b, a) for a, b in new}), df(gone))
    assert {(r.src, r.dst): r.truss for r in after.collect()} == numbers(old - gone | new)


def test_peel_of_the_whole_table(run):
    got = {}
    for r in run("g_peel_json").collect():
        got |= {tuple(map(int, k.split(","))): v for k, v in json.loads(r.value).items()}
    assert got == peel()


def test_betweenness_of_all_roots_on_the_whole_table(run):
    assert {r.id: r.bc for r in run("g_betweenness_exact").collect()} == pytest.approx(brandes(), abs=1e-5)


def pages(rows, mode="push", start=None):
    """Up to 20 rounds, ended at a change of 0.001."""
    out = {v: [r[1] for r in rows if r[0] == v] for v in range(N)}
    rank = dict(start or dict.fromkeys(range(N), 1 / N))
    for _ in range(20):
        new = dict.fromkeys(range(N), 0.15 / N)
        for v, targets in out.items():
            for w in targets:
                if mode == "push":
                    new[w] += 0.85 * rank[v] / len(targets)
                elif out[w]:
                    new[v] += 0.85 * rank[w] / len(out[w])
        change, rank = sum(abs(new[v] - rank[v]) for v in rank), new
        if change <= 0.001:
            break
    return rank


def katz_scores(rounds=49):
    near = neighbours(pairs())
    alpha = 1 / (max(map(len, near.values())) + 1)
    paths, score = dict.fromkeys(near, 1.0), dict.fromkeys(near, 0.0)
    for i in range(1, rounds + 1):
        paths = {v: sum(paths[w] for w in near[v]) for v in near}
        score = {v: score[v] + alpha**i * paths[v] for v in near}
    return score


@pytest.mark.parametrize("name", ["g_page_rank_default", "g_page_rank_pull_default", "g_page_rank_dynamic_default"])
def test_page_rank_runs_to_its_default_end(run, name):
    start = pages([r for r in ROWS if r[3] == 1]) if "dynamic" in name else None
    want = pages(ROWS, "pull" if "pull" in name else "push", start)
    assert {r.id: r["rank"] for r in run(name).collect()} == pytest.approx(want, abs=1e-9)


def test_page_rank_top_of_the_default(run):
    top = sorted(pages(ROWS).items(), key=lambda x: (-round(x[1], 12), x[0]))[:10]
    assert [(r.id, r["rank"]) for r in run("g_page_rank_top_default").collect()] == [(v, pytest.approx(x, abs=1e-9)) for v, x in top]


@pytest.mark.parametrize("name", ["g_katz_default", "g_katz_dynamic_default"])
def test_katz_runs_its_default_rounds(run, name):
    assert {r.id: r.score for r in run(name).collect()} == pytest.approx(katz_scores(), abs=1e-8)
