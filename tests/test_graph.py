"""Hand-checked goldens on small graphs, and invariants of updates."""

import pytest
from pyspark.sql import functions as F

from graphloom.algorithms import algebra, components, dense, paths, ranking
from graphloom.functions import stats
from graphloom.graph import Graph
from graphloom.operators import ordering, traverse, updates
from graphloom.sources import files, generators, sinks
from graphloom.streaming.graph_stream import StreamingGraph

ARCS = [(0, 2), (0, 3), (0, 4), (2, 1), (2, 8), (2, 3), (3, 2), (3, 8), (3, 7), (4, 5), (4, 6), (7, 6)]


@pytest.fixture(scope="module")
def g(spark):
    return Graph.dense(spark.createDataFrame([(a, b, i + 1) for i, (a, b) in enumerate(ARCS)], "src bigint, dst bigint, weight int"), 9)


@pytest.fixture(scope="module")
def u(g):
    return g.simple()


def as_dict(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def test_degree_statistics(g):
    a = stats.graph_analysis(g).first()
    assert (a.n_vertices, a.n_edges, a.max_out, a.rings) == (9, 12, 3, 0)
    assert a.std_degree == pytest.approx(1.33333, abs=1e-5)
    assert a.gini == pytest.approx(0.537037, abs=1e-6)
    assert a.longest_empty_run == 2


@pytest.mark.parametrize("direction", ["push", "pull", "auto"])
def test_bfs(g, direction):
    d = as_dict(paths.bfs(g, 0, direction=direction), "id", "distance")
    assert d == {0: 0, 1: 2, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2, 8: 2}


def test_bfs_unreached(g):
    assert as_dict(paths.bfs(g, 8, unreached="max"), "id", "distance")[0] == 2147483647
    assert as_dict(paths.bfs(g, 99), "id", "distance")[0] is None
    assert as_dict(paths.bfs(g, 0, max_depth=1), "id", "distance")[1] is None


def test_sssp(g):
    d = as_dict(paths.sssp(g, 0), "id", "distance")
    assert d == {0: 0, 1: 5, 2: 1, 3: 2, 4: 3, 5: 13, 6: 14, 7: 11, 8: 6}
    with pytest.raises(ValueError):
        paths.sssp(g, 0, -F.col("weight"))


def test_spmv(g, spark):
    x = spark.range(9).withColumn("x", F.lit(1))
    assert as_dict(algebra.spmv(g, x), "id", "y") == {0: 6, 2: 15, 3: 24, 4: 21, 7: 12, 1: 0, 5: 0, 6: 0, 8: 0}


def test_components(spark, u):
    assert set(as_dict(components.connected_components(u), "id", "component").values()) == {0}
    more = Graph.dense(spark.createDataFrame([*ARCS, (9, 10), (10, 11)], "src bigint, dst bigint"), 12).simple()
    d = as_dict(components.connected_components(more, "max", heavy_rows=1), "id", "component")
    assert d == {**dict.fromkeys(range(9), 0), 9: 12, 10: 12, 11: 12}


def test_triangles(g):
    assert dense.triangle_total(g).first()[0] == 2
    assert {k: v for k, v in as_dict(dense.triangle_counts(g), "id", "triangles").items() if v} == {0: 1, 2: 2, 3: 2, 8: 1}
    c = as_dict(dense.clustering(g), "id", "coefficient")
    assert c[8] == 1 and c[0] == c[2] == c[3] == pytest.approx(1 / 3) and c[1] == 0
    assert dense.mean_clustering(g).first()[0] == pytest.approx(2 / 9)


def test_cores_and_trusses(g, rows):
    assert as_dict(dense.core_numbers(g), "id", "core") == {**dict.fromkeys(range(9), 2), 1: 1, 5: 1}
    peel = {(r.src, r.dst): r.peel for r in dense.core_edge_peel(g).collect()}
    assert len(peel) == 11 and {k for k, v in peel.items() if v == 1} == {(1, 2), (4, 5)} and set(peel.values()) == {1, 2}
    assert dense.max_truss(g).first()[0] == 3
    assert rows(dense.truss(g, 3)) == [(0, 2), (0, 3), (2, 3), (2, 8), (3, 8)]
    before = dense.edge_support(g.simple().edges)
    gone = g.edges.sparkSession.createDataFrame([(2, 3)], "src bigint, dst bigint")
    after = {(r.src, r.dst): r.support for r in dense.support_after_erase(g.simple().edges, before, gone).collect()}
    assert (2, 3) not in after and set(after.values()) == {0}


def test_strong_components(g):
    d = as_dict(components.strong_components(g), "id", "component")
    assert d == {**{i: i for i in range(9)}, 3: 2}
    assert as_dict(components.strong_components(g, heavy_rows=2), "id", "component") == d


def test_betweenness(u, spark):
    d = as_dict(ranking.betweenness(u), "id", "bc")
    assert [d[i] for i in range(9)] == pytest.approx([18, 0, 17, 15, 18, 0, 4, 6, 0])
    d = as_dict(ranking.betweenness(u, spark.range(2, 3)), "id", "bc")
    assert [d[i] for i in range(9)] == pytest.approx([2.5, 0, 0, 1.5, 1.5, 0, 0, 0.5, 0])


def test_katz(u):
    d = as_dict(ranking.katz(u, rounds=4, max_degree=4), "id", "score")
    assert [d[i] for i in range(9)] == pytest.approx([1.256, 0.44, 1.472, 1.52, 0.992, 0.368, 0.696, 0.768, 0.888])


def test_katz_update_equals_recomputation(u, spark):
    batch = spark.createDataFrame([(1, 5), (5, 1), (6, 8), (8, 6)], "src bigint, dst bigint")
    erased = spark.createDataFrame([(0, 4), (4, 0)], "src bigint, dst bigint")
    new = Graph(u.vertices, u.edges.unionByName(batch).exceptAll(erased))
    got = ranking.katz_update(ranking.katz_levels(u, 4, 4), u.edges, batch, erased)
    for a, b in zip(got, ranking.katz_levels(new, 4, 4), strict=True):
        assert as_dict(a, "id", "paths") == as_dict(b, "id", "paths")


def test_page_rank(g, u):
    d = as_dict(ranking.page_rank(g), "id", "rank")
    assert [d[i] for i in range(9)] == pytest.approx([0.016667, 0.025148, 0.029871, 0.029871, 0.021389, 0.025757, 0.047189, 0.025148, 0.03363], abs=1e-6)
    d = as_dict(ranking.page_rank(g, mode="pull"), "id", "rank")
    assert [d[i] for i in range(9)] == pytest.approx([0.042593, 0.016667, 0.027631, 0.038713, *[0.016667] * 5], abs=1e-6)
    d = as_dict(ranking.page_rank(u), "id", "rank")
    assert [d[i] for i in range(9)] == pytest.approx([0.129103, 0.053114, 0.171635, 0.167046, 0.143161, 0.057153, 0.096794, 0.093377, 0.088617], abs=1e-6)


def test_hubs_take_the_broadcast_way(g, spark):
    from graphloom.plans.loops import Cutter

    t = traverse.EdgeTable(g.edges.select("src", "dst"), Cutter(spark, "t"), heavy_rows=3)
    assert t.any_hub
    got = sorted((r.src, r.dst, r.x) for r in t.spread(spark.range(9).withColumn("x", F.col("id") * 10)).collect())
    assert got == sorted((a, b, a * 10) for a, b in ARCS)


def test_intersections(g, u, spark, rows):
    near = {v: {b for a, b in ARCS if a == v} | {a for a, b in ARCS if b == v} for v in range(9)}
    assert rows(traverse.adjacency_intersections(u)) == sorted((a, b, c) for a in near for b in near[a] for c in near[a] & near[b])
    pairs = spark.createDataFrame([(0, 8), (0, 8), (5, 1)], "src bigint, dst bigint")
    assert rows(traverse.adjacency_intersections(u, pairs)) == [(0, 8, 2), (0, 8, 3)]


def test_least_potentials(spark):
    e = spark.createDataFrame([(0, 1, -3), (1, 2, 5), (2, 0, -1), (3, 0, -2), (4, 4, -1)], "src bigint, dst bigint, weight int")
    d = as_dict(algebra.least_potentials(Graph.dense(e, 6)), "id", "potential")
    w = {(0, 1): -3, (1, 2): 5, (2, 0): -1, (3, 0): -2}
    assert d[4] is None and d[5] == 0
    for (a, b), x in w.items():
        assert d[a] >= d[b] - x


def test_updates_are_multisets(spark, rows):
    base = spark.createDataFrame([(1, 2, 5), (1, 2, 3), (1, 2, None), (3, 4, 1), (None, 4, 1)], "src bigint, dst bigint, w int")
    batch = spark.createDataFrame([(1, 2), (1, 2), (9, 9), (None, 1)], "src bigint, dst bigint")
    assert rows(updates.erase_edges(base.filter("src is not null"), batch)) == [(1, 2, 5), (3, 4, 1)]
    assert rows(updates.erase_edges(base.filter("src is not null"), batch, heavy_rows=1)) == [(1, 2, 5), (3, 4, 1)]
    assert len(rows(updates.erase_edges(base.filter("src is not null"), batch, dedup_batch=True))) == 3
    assert rows(updates.as_multimap(batch)) == [(1, 2, 2), (9, 9, 1), (None, 1, 1)]
    topology = base.filter("src is not null").select("src", "dst")
    assert rows(updates.erase_edges(topology, batch)) == rows(topology.exceptAll(batch.dropna()))
    more = spark.createDataFrame([(1, 2, 7), (5, 6, 9), (5, 6, 8), (None, 1, 1)], "src bigint, dst bigint, w int")
    assert len(rows(updates.insert_edges(base.dropna(subset=["src"]), more))) == 7
    assert rows(updates.insert_edges(base.limit(0), more, dedup_batch=True)) == [(1, 2, 7), (5, 6, 8)]
    fresh = updates.insert_edges(base.dropna(subset=["src"]), more, True, True)
    assert updates.same_multiset(fresh, base.dropna(subset=["src"]).unionByName(spark.createDataFrame([(5, 6, 8)], "src bigint, dst bigint, w int")))
    with pytest.raises(ValueError):
        updates.insert_edges(base, more.withColumn("extra", F.lit(1)))


def test_upsert_modes(spark, rows):
    base = spark.createDataFrame([(1, 2, 5), (3, 4, None)], "src bigint, dst bigint, weight bigint")
    batch = spark.createDataFrame([(1, 2, 1), (1, 2, 2), (3, 4, 7), (8, 9, 4)], "src bigint, dst bigint, weight bigint")
    assert rows(updates.upsert_edges(base, batch, "ignore")) == [(1, 2, 5), (3, 4, None), (8, 9, 4)]
    assert rows(updates.upsert_edges(base, batch, "update")) == [(1, 2, 1), (3, 4, 7), (8, 9, 4)]
    assert rows(updates.upsert_edges(base, batch, "sum")) == [(1, 2, 8), (3, 4, 7), (8, 9, 4)]


def test_empty_graph(spark):
    e = Graph.from_edges(spark.createDataFrame([], "src bigint, dst bigint"))
    assert e.max_degree().count() == 0
    assert ranking.page_rank(e).count() == 0
    assert components.connected_components(e).count() == 0
    assert components.strong_components(e).count() == 0
    assert dense.truss_numbers(e).count() == 0
    assert ordering.with_index(e.vertices, [F.col("id")]).count() == 0


def test_transforms(g, spark, rows):
    assert g.symmetrize().n_edges() == 24
    assert g.simple().n_edges() == 22
    assert g.simple().by_degree().n_edges() == 11
    assert g.simple().to_directed().n_edges() == 11
    s = g.drop_singletons()
    assert sorted(r.id for r in s.vertices.collect()) == [0, 1, 2, 3]
    assert rows(s.edges, "src", "dst") == [(0, 1), (1, 0), (1, 3)]
    offsets, entries = g.csr()
    c = {r.id: (r.offset, r.degree) for r in offsets.collect()}
    assert [r.dst for r in entries.orderBy("position").collect()] == [b for _, b in sorted(ARCS)]
    assert c[0] == (0, 3) and c[1] == (3, 0) and c[7] == (11, 1)
    back = Graph.from_csr(spark, [0, 2, 2, 3], [1, 2, 0])
    assert rows(back.edges) == [(0, 1), (0, 2), (2, 0)]
    assert rows(Graph.from_csr_tables(offsets, entries).edges, "src", "dst", "weight") == rows(g.edges, "src", "dst", "weight")
    assert rows(Graph.from_csr(spark, [0, 0], []).edges) == []


def test_running_sum_and_max(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = ordering.running_sum(df, [F.col("id").desc()], F.col("v"), "s", exclusive=False).orderBy(F.desc("id")).collect()
    total = 0
    for r in got:
        total += r.v
        assert r.s == total
    top = ordering.running_max(df, [F.col("id")], F.col("v"), "m").orderBy("id").collect()
    assert [r.m for r in top[:8]] == [0, 1, 2, 3, 4, 5, 6, 6]


FILES = {
    "mtx": ("%%MatrixMarket matrix coordinate pattern general\n% c\n3 3 2\n1 2\n3 1\n", [(0, 1), (2, 0)]),
    "graph": ("3 2 100\n2 3\n\n1\n", [(0, 1), (0, 2), (2, 0)]),
    "gr": ("c x\np sp 3 2\na 1 2 7\na 3 1 9\n", [(0, 1), (2, 0)]),
    "konect": ("% asym\n% 2 3 3\n1 2\n3 1\n", [(0, 1), (2, 0)]),
    "edges": ("% undirected\n1,2\n3,1\n", [(0, 1), (0, 2), (1, 0), (2, 0)]),
    "snap": ("# Directed graph\n# Nodes: 3 Edges: 2\n70\t50\n9\t70\n", [(0, 1), (2, 0)]),
    "mm": ("% labels\n3 3 2\nx y\nz x\n", [(0, 1), (2, 0)]),
}


@pytest.mark.parametrize("fmt", FILES)
def test_readers(spark, tmp_path, rows, fmt):
    text, want = FILES[fmt]
    p = tmp_path / ("out.x" if fmt == "konect" else f"x.{fmt}")
    p.write_text(text)
    g = files.read_graph(spark, f"file://{p}")
    assert rows(g.edges, "src", "dst") == want
    assert g.n_vertices() == 3


def test_reader_refuses(spark, tmp_path):
    p = tmp_path / "a.mtx"
    p.write_text("%%MatrixMarket matrix array real general\n2 2\n1\n")
    with pytest.raises(ValueError):
        files.read_graph(spark, f"file://{p}")
    p = tmp_path / "a.graph"
    p.write_text("2 1 1\n2 5\n1 5\n")
    with pytest.raises(ValueError):
        files.read_graph(spark, f"file://{p}")


def test_writers_round_trip(g, spark, tmp_path, rows):
    sinks.write_lines(sinks.market_lines(g, "weight"), f"file://{tmp_path}/m")
    back = files.read_graph(spark, f"file://{tmp_path}/m", "mtx", weight="int")
    assert rows(back.edges, "src", "dst", "weight") == rows(g.edges, "src", "dst", "weight")
    sinks.write_lines(sinks.dimacs10_lines(g), f"file://{tmp_path}/d")
    assert rows(files.read_graph(spark, f"file://{tmp_path}/d", "graph").edges) == rows(g.edges, "src", "dst")
    sinks.write_analysis(stats.graph_analysis(g), "G", f"file://{tmp_path}/a")
    assert spark.read.text(f"file://{tmp_path}/a").first().value.startswith("G\t9\t12")
    assert sorted(r.value for r in sinks.peel_json(dense.core_edge_peel(g)).collect())[0] == '{"0,2":2}'


def test_generators_are_seeded(g, spark, rows):
    a = generators.random_edges(spark, 9, 50, 1, w=(0, 5))
    assert rows(a) == rows(generators.random_edges(spark, 9, 50, 1, w=(0, 5)).repartition(3))
    assert any(r.src != r.dst for r in a.collect()) and all(0 <= r.w <= 5 for r in a.collect())
    have = {(x, y) for x, y in ARCS}
    assert all(tuple(r) in have for r in generators.erase_batch(g, 40, 3).collect())
    assert generators.sample_edges(g.edges, 5).count() == 5
    assert generators.insert_batch(g, 20, 1, weighted=True).count() == 20
    assert {r.id for r in generators.weighted_vertices(g, 200).collect()} <= {a for a, _ in ARCS}


@pytest.mark.parametrize("compact", [1, 2, 16])
def test_stream_equals_one_batch_and_replays_nothing(spark, tmp_path, rows, compact):
    e = spark.createDataFrame([(i % 5, i % 7, "erase" if i % 11 == 10 else "insert") for i in range(60)], "src bigint, dst bigint, op string")
    s = StreamingGraph(spark, f"file://{tmp_path}/g", e.select("src", "dst").limit(0), op="op", compact_after=compact)
    want = []
    data = [tuple(r) for r in e.collect()]
    for n, at in enumerate(range(0, 60, 20)):
        part = data[at : at + 20]
        for src, dst, op in part:
            if op == "erase" and (src, dst) in want:
                want.remove((src, dst))
        want += [(a, b) for a, b, op in part if op != "erase"]
        df = spark.createDataFrame(part, e.schema)
        s.apply(df, n)
        s.apply(df, n)
    assert rows(s.edges()) == sorted(want, key=repr)
    assert s.last_batch() == 2 and len({n for k, n in s._folders() if k == "base"}) <= 2
    s.reset()
    s.apply(df, 2)
    assert rows(s.edges()) == [] and len(s._folders()) == 1
    s.reset(e.select("src", "dst").limit(1))
    assert len(rows(s.edges())) == 1


def test_range_lookup_and_bounds(spark, rows):
    ranges = spark.createDataFrame([(0, "a"), (10, "b"), (12, "c"), (None, "n")], "s bigint, name string")
    values = spark.createDataFrame([(-1,), (0,), (9,), (10,), (11,), (99,), (None,)], "v bigint")
    got = ordering.range_lookup(values, ranges, "v", "s", "name")
    assert rows(got) == sorted([(-1, None), (0, "a"), (9, "a"), (10, "b"), (11, "b"), (99, "c"), (None, None)], key=repr)
    among = spark.createDataFrame([(3,), (5,), (5,), (8,), (None,)], "x bigint")
    asked = spark.createDataFrame([(x,) for x in (1, 5, 5, 6, 9)], "x bigint")
    assert rows(ordering.bounds(asked, among), "x", "lower", "upper") == [(1, 0, 0), (5, 1, 3), (6, 3, 3), (9, 4, 4)]
    assert [r.x for r in ordering.merge(among.dropna(), asked, [F.col("x")]).collect()] == [1, 3, 5, 5, 5, 5, 6, 8, 9]


def test_windows_drop_late_rows(spark, tmp_path):
    from graphloom.streaming.graph_stream import store_windowed_counts

    at = lambda day: f"2020-01-{day:02d} 00:00:00"
    for i, days in enumerate([[1, 1, 2, 20], [2, 21, 30]]):
        spark.createDataFrame([(at(x),) for x in days], "t string").selectExpr("cast(t as timestamp) t").coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema("t timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = store_windowed_counts(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/c", "t", "1 day", "2 days")
    assert {(r.start.day, r.n_edges) for r in got.collect()} in ({(1, 2), (2, 1), (20, 1), (21, 1)}, {(1, 2), (2, 2), (20, 1), (21, 1)})


def test_structured_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, j) for j in range(4)], "src bigint, dst bigint").coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema("src bigint, dst bigint").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    s = StreamingGraph(spark, f"file://{tmp_path}/g", spark.createDataFrame([], "src bigint, dst bigint"))
    seen = []
    s.run(stream, f"file://{tmp_path}/c", lambda g, n: seen.append(g.edges().count()))
    assert s.edges().count() == 12 and seen == sorted(seen) and len(seen) >= 3


def test_many_rows_of_a_hub_are_salted_and_not_broadcast(g, spark):
    from graphloom.plans.loops import Cutter

    t = traverse.EdgeTable(g.edges.select("src", "dst"), Cutter(spark, "t"), heavy_rows=2)
    assert t.any_hub
    state = spark.range(50).select((F.col("id") % 10).alias("id"), F.col("id").alias("root"))
    out = t.spread(state, many=True)
    assert sorted((r.src, r.dst, r.root) for r in out.collect()) == sorted((a, b, k) for a, b in ARCS for k in range(50) if k % 10 == a)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ResolvedHint" not in plan or "root" not in plan.split("strategy=broadcast")[1].split("\n")[1]


@pytest.mark.parametrize("kw", [{"state_rows": 18}, {"state_rows": 40, "symmetric": True}, {"heavy_rows": 2}])
def test_betweenness_in_batches_and_with_hubs(u, kw):
    d = as_dict(ranking.betweenness(u, **kw), "id", "bc")
    assert [d[i] for i in range(9)] == pytest.approx([18, 0, 17, 15, 18, 0, 4, 6, 0])


@pytest.mark.parametrize("fmt", ["mtx", "konect", "snap", "edges"])
def test_long_headers(spark, tmp_path, rows, fmt):
    text, want = FILES[fmt]
    first, rest = text.split("\n", 1)
    sign = "#" if fmt == "snap" else "%"
    at = rest.index("\n") + 1 if fmt in ("konect", "snap") else 0
    p = tmp_path / ("out.x" if fmt == "konect" else f"x.{fmt}")
    p.write_text(first + "\n" + rest[:at] + f"{sign} more\n" * 1100 + rest[at:])
    g = files.read_graph(spark, f"file://{p}")
    assert rows(g.edges, "src", "dst") == want and g.n_vertices() == 3
