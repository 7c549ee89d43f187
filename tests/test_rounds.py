"""Long loops: what they give, and that their number of Spark jobs stays small."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.algorithms import all_roots, dense, ranking
from graphloom.graph import Graph
from graphloom.operators.vertex_vectors import EdgeBlocks, dense_ids
from graphloom.plans.loops import Cutter
from graphloom.sources import sinks


@pytest.fixture
def jobs(spark):
    """Runs a function and gives its result and the number of Spark jobs."""

    def run(name, f):
        sc = spark.sparkContext
        sc.setJobGroup(name, name)
        try:
            out = f()
            return out, len(sc.statusTracker().getJobIdsForGroup(name))
        finally:
            sc.setJobGroup("other", "other")

    return run


def graph(spark, edges, n):
    """Undirected; ids with gaps, and negative ones."""
    ids = lambda v: v * 7 - 20
    e = spark.createDataFrame([(ids(x), ids(y)) for a, b in edges for x, y in ((a, b), (b, a))], "src bigint, dst bigint")
    return Graph(spark.createDataFrame([(ids(i),) for i in range(n)], "id bigint"), e)


def random_edges(n, m, seed):
    rng = np.random.default_rng(seed)
    hub = [(0, int(x)) for x in rng.choice(np.arange(1, n), n // 2, replace=False)]
    return sorted({(min(p), max(p)) for p in [*hub, *rng.integers(0, n, (m, 2)).tolist()] if p[0] != p[1]})


def as_dict(df, value):
    return {r.id: r[value] for r in df.collect()}


def test_vector_products(spark):
    edges = random_edges(60, 150, 1)
    g = graph(spark, edges, 64)
    weighted = g.edges.withColumn("weight", (F.col("src") - F.col("dst")).cast("double")).unionByName(spark.createDataFrame([(-20, 999, 5.0), (999, -20, 5.0)], "src bigint, dst bigint, weight double"))
    ids = dense_ids(g.vertices)
    x = np.arange(64) + 0.5
    m = np.zeros((64, 64))
    for a, b in edges:
        m[a, b], m[b, a] = (b - a) * 7, (a - b) * 7
    assert EdgeBlocks(weighted, 3_000_000, ids, Cutter(spark, "t"), weighted=True).times(x) == pytest.approx(m @ x)
    assert EdgeBlocks(g.edges, 1, ids, Cutter(spark, "t")).times(x) == pytest.approx((m != 0) @ x)
    assert dense_ids(g.vertices, 63) is None
    assert dense_ids(g.vertices.unionByName(g.vertices)) is None
    assert dense_ids(g.vertices.unionByName(spark.createDataFrame([(None,)], "id bigint"))) is None
    assert EdgeBlocks(g.edges.limit(0), 0, ids, Cutter(spark, "t")).times(x).tolist() == [0.0] * 64


def test_katz_rounds_are_one_job_each(spark, jobs):
    g = graph(spark, random_edges(60, 150, 2), 64)
    found, n = jobs("katz", lambda: ranking.katz(g).persist())
    assert n <= 49 + 20
    want = ranking.katz(g, most_vertices=0)
    for c in ("score", "lower", "upper", "paths"):
        assert as_dict(found, c) == pytest.approx(as_dict(want, c), rel=1e-12)


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_katz_of_few_rounds_and_without_edges(spark, rounds):
    for g in (graph(spark, [(0, 1), (1, 2)], 4), Graph(spark.range(3), spark.createDataFrame([], "src bigint, dst bigint"))):
        rows = [sorted(map(tuple, ranking.katz(g, rounds, most_vertices=n).collect())) for n in (0, 100)]
        assert [x for r in rows[0] for x in r] == pytest.approx([x for r in rows[1] for x in r])


def test_katz_after_a_batch_takes_few_jobs(spark, jobs):
    edges = random_edges(40, 80, 3)
    both = lambda e: graph(spark, e, 64).edges
    old, added, gone = edges[10:], edges[:10], edges[12:15]
    g = graph(spark, old, 64)
    found, n = jobs("katz-after", lambda: ranking.katz_after(g, both(added), both(gone), 9, 40).persist())
    assert n <= 3 * 9 + 20
    new = graph(spark, [e for e in edges if e not in gone], 64)
    want = as_dict(ranking.katz_scores(ranking.katz_levels(new, 9, 40), 40), "score")
    assert as_dict(found, "score") == pytest.approx(want, rel=1e-9)
    assert as_dict(ranking.katz_after(g, both(added), both(gone), 3, 40, most_vertices=0), "score") == pytest.approx(as_dict(ranking.katz_after(g, both(added), both(gone), 3, 40), "score"))


def nested(depth):
    """Cliques of 3 .. depth vertices in a chain, a path and isolated vertices: a peel for each size."""
    out, at = [], 0
    for k in range(3, depth + 1):
        out += [*combinations(range(at, at + k), 2), (at + k - 1, at + k)]
        at += k
    return [*out, (at, at + 1), (at + 1, at + 2)], at + 5


@pytest.mark.parametrize("edges,n", [nested(7), (random_edges(80, 300, 4), 90), ([], 3)])
def test_peel_takes_few_jobs(spark, jobs, edges, n):
    g = graph(spark, edges, n)
    found, count = jobs(f"peel-{n}", lambda: sorted(map(tuple, dense.core_edge_peel(g).collect())))
    assert count <= 10
    assert len(found) == len(edges)
    if edges:
        for most in (0, len(edges) // 3):
            assert sorted(map(tuple, dense.core_edge_peel(g, most).collect())) == found


def test_peel_as_json(spark, jobs):
    g = graph(spark, [(0, 1), (0, 2), (1, 2), (2, 3)], 5)
    found, count = jobs("peel-json", lambda: sorted(r.value for r in sinks.peel_json(dense.core_edge_peel(g)).collect()))
    assert found == ['{"-13,-6":2}', '{"-20,-13":2}', '{"-20,-6":2}', '{"-6,1":1}']
    assert count <= 10


def brandes(edges, vertices):
    """Directed (src, dst), by lists of shortest paths; sums over the roots among ``vertices``."""
    near, total = {}, dict.fromkeys(vertices, 0.0)
    for a, b in set(edges):
        if a != b:
            near.setdefault(a, []).append(b)
    for root in vertices:
        far, order, sigma, delta = {root: 0}, [root], {root: 1.0}, {}
        for v in order:
            for w in near.get(v, []):
                if w not in far:
                    far[w] = far[v] + 1
                    order.append(w)
                if far[w] == far[v] + 1:
                    sigma[w] = sigma.get(w, 0.0) + sigma[v]
        for v in reversed(order):
            delta[v] = sum(sigma[v] / sigma[w] * (1 + delta[w]) for w in near.get(v, []) if far[w] == far[v] + 1)
            if v != root and v in total:
                total[v] += delta[v]
    return total


ONE_WAY = [(a, b) for a, b in random_edges(60, 150, 5) if (a + b) % 3] + [(3, 3), (5, 6), (5, 6)]
BETWEEN = {"dense": (random_edges(60, 150, 5), 64, True), "path": ([(i, i + 1) for i in range(70)], 72, True), "directed": (ONE_WAY, 64, False), "unknown ends": (ONE_WAY, 40, False), "no edges": ([], 3, True)}


@pytest.mark.parametrize("name", BETWEEN)
@pytest.mark.parametrize("together", [1, 250_000])
def test_dependencies_of_all_roots(name, together, monkeypatch):
    edges, _, symmetric = BETWEEN[name]
    pairs = sorted({p for a, b in edges if a != b for p in ([(a, b), (b, a)] if symmetric else [(a, b)])})
    monkeypatch.setattr(all_roots, "_TOGETHER", together)
    d = all_roots.Dependencies(np.searchsorted([a for a, _ in pairs], np.arange(73)), np.array([b for _, b in pairs], np.int32))
    d.add(np.arange(72))
    want = brandes(pairs, range(72))
    assert d.total.tolist() == pytest.approx([want[i] for i in range(72)])


@pytest.mark.parametrize("name", BETWEEN)
def test_betweenness_of_all_roots_takes_few_jobs(spark, jobs, name):
    edges, n, symmetric = BETWEEN[name]
    ids = lambda v: v * 7 - 20
    rows = [(ids(x), ids(y)) for a, b in edges for x, y in ([(a, b), (b, a)] if symmetric else [(a, b)])]
    vertices = [ids(i) for i in range(n)]
    g = Graph(spark.createDataFrame([(v,) for v in [*vertices, None]], "id bigint"), spark.createDataFrame(rows, "src bigint, dst bigint"))
    found, count = jobs(f"between-{name}", lambda: as_dict(ranking.betweenness(g), "bc"))
    assert count <= 12
    want = brandes(rows, vertices) | {None: 0.0}
    assert found == pytest.approx(want)
    for kw in {"dense": [{"heavy_rows": 2, "symmetric": True}], "unknown ends": [{"state_rows": 1000}]}.get(name, []):
        assert as_dict(ranking.betweenness(g, most_edges=0, **kw), "bc") == pytest.approx(want)


def test_betweenness_of_all_roots_with_other_ids(spark):
    for kind in ("int", "string"):
        g = Graph(spark.range(3).select(F.col("id").cast(kind)), spark.createDataFrame([(0, 1), (1, 2)], "src bigint, dst bigint").select(F.col("src").cast(kind), F.col("dst").cast(kind)))
        assert {str(k): v for k, v in as_dict(ranking.betweenness(g), "bc").items()} == {"0": 0.0, "1": 1.0, "2": 0.0}


@pytest.mark.parametrize("most", [0, 100])
def test_betweenness_ends_at_its_rounds(spark, most):
    g = Graph(spark.range(3), spark.createDataFrame([(0, 1), (1, 2)], "src bigint, dst bigint"))
    assert as_dict(ranking.betweenness(g, max_rounds=3, most_edges=most), "bc") == {0: 0.0, 1: 1.0, 2: 0.0}
    with pytest.raises(Exception, match="too many levels"):
        ranking.betweenness(g, max_rounds=2, most_edges=most)
