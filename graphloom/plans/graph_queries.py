"""Registered queries of the graph operators over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..algorithms import algebra, components, dense, paths, ranking
from ..functions import numeric, stats
from ..graph import Graph
from ..operators import ordering, traverse, updates
from ..sources import files, generators, sinks
from ..streaming.graph_stream import StreamingGraph, store_windowed_counts
from .derived import all_vertices, coo_graph, edge_rows, split_graph, table
from .loops import Cutter

QUERIES: dict = {}
SQL: dict[str, str] = {}

_PRE = """E AS (SELECT index1 - 1 AS src, index2 - 1 AS dst, weight, w1, edge_id, graph_id, seen_at FROM coo_edges WHERE index1 IS NOT NULL AND index2 IS NOT NULL),
V AS (SELECT id FROM anchor_vertices UNION ALL SELECT id FROM vertices),
U AS (SELECT src, dst FROM E WHERE src <> dst UNION SELECT dst, src FROM E WHERE src <> dst),
D AS (SELECT id, count(src) AS degree FROM V LEFT JOIN E ON src = id GROUP BY id),
F AS (SELECT E.*, coalesce(file_format IN ('mtx', 'gr', 'graph'), false) AS base FROM E LEFT JOIN graph_info USING (graph_id))"""


def register(sql: str | None = None, recursive: bool = False):
    """Adds a query under its own name; {..} of the SQL may use the common tables E, V, U, D and F."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{_PRE}{',' if sql.startswith('+') else ''}\n{sql.lstrip('+')}"
        return f

    return add


def _top_vertex(g: Graph) -> int:
    """The vertex of the largest degree; the root where a query needs one."""
    return g.max_degree().first().id


# sizes, degrees, exports


@register("SELECT id, degree AS out_degree, (SELECT count(*) FROM E WHERE dst = id) AS in_degree FROM D")
def g_degrees(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d)
    return g.out_degrees().withColumnRenamed("degree", "out_degree").join(g.in_degrees().withColumnRenamed("degree", "in_degree"), "id")


@register("SELECT id, degree FROM D ORDER BY degree DESC, id LIMIT 1")
def g_max_degree(spark: SparkSession, d: str) -> DataFrame:
    return coo_graph(spark, d).max_degree()


@register("SELECT (SELECT count(*) FROM V) AS n_vertices, (SELECT count(*) FROM E) AS n_edges")
def g_size(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d)
    return g.vertices.agg(F.count(F.lit(1)).alias("n_vertices")).withColumn("n_edges", g.edges.agg(F.count(F.lit(1))).scalar())


@register("SELECT src, dst, weight FROM E ORDER BY src, dst")
def g_coo(spark: SparkSession, d: str) -> DataFrame:
    return coo_graph(spark, d, "weight").coo(sort=True)


@register('SELECT id, CAST(sum(degree) OVER (ORDER BY id) - degree AS BIGINT) AS "offset", degree FROM D')
def g_csr_offsets(spark: SparkSession, d: str) -> DataFrame:
    return coo_graph(spark, d).csr()[0]


@register("SELECT row_number() OVER (ORDER BY src, dst, weight NULLS FIRST) - 1 AS position, dst, weight FROM E")
def g_csr_entries(spark: SparkSession, d: str) -> DataFrame:
    return coo_graph(spark, d, "weight").csr()[1]


@register("SELECT src, dst, weight, count(*) AS n FROM E GROUP BY ALL")
def g_multimap(spark: SparkSession, d: str) -> DataFrame:
    return updates.as_multimap(coo_graph(spark, d, "weight").edges)


# transforms


@register("SELECT src, dst, weight FROM E UNION ALL SELECT dst, src, weight FROM E WHERE src <> dst")
def g_symmetrize(spark: SparkSession, d: str) -> DataFrame:
    return coo_graph(spark, d, "weight").symmetrize().edges


@register("SELECT src, dst, weight FROM E UNION SELECT dst, src, weight FROM E")
def g_to_undirected(spark: SparkSession, d: str) -> DataFrame:
    return coo_graph(spark, d, "weight").to_undirected().edges


@register("SELECT src AS low, dst AS high, 1::BIGINT AS n, true AS both_ways FROM U WHERE src < dst")
def g_to_directed(spark: SparkSession, d: str) -> DataFrame:
    """Every pair once, and both directions in use over all pairs."""
    e = coo_graph(spark, d).simple().to_directed(7).edges
    ways = e.agg((F.count_if(F.col("src") < F.col("dst")) > 0) & (F.count_if(F.col("src") > F.col("dst")) > 0)).scalar()
    return e.groupBy(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).agg(F.count(F.lit(1)).alias("n")).withColumn("both_ways", ways)


@register("+O AS (SELECT src, count(*) AS degree FROM U GROUP BY src) SELECT U.src, U.dst FROM U JOIN O a ON a.src = U.src JOIN O b ON b.src = U.dst WHERE (a.degree, U.src) < (b.degree, U.dst)")
def g_by_degree(spark: SparkSession, d: str) -> DataFrame:
    return coo_graph(spark, d).simple().by_degree().edges


@register("SELECT src, dst, count(*) AS n, true AS moved, true AS dense FROM E GROUP BY src, dst")
def g_randomize_ids(spark: SparkSession, d: str) -> DataFrame:
    """The relabelled edges, mapped back by the permutation: the same multiset; most ids moved, and the new ids are 0 .. n-1."""
    g = coo_graph(spark, d)
    known = Cutter(spark, "ids").cut(Graph(g.vertices.withColumn("was", F.col("id")), g.edges).randomize_ids(3).vertices)[0]
    r = g.relabel(known.select(F.col("was").alias("id"), F.col("id").alias("new_id")))
    back = Graph(r.vertices, Cutter(spark, "relabelled").cut(r.edges)[0]).relabel(known.select("id", F.col("was").alias("new_id")))
    facts = known.agg((F.count_if(F.col("id") != F.col("was")) * 2 > F.count(F.lit(1))).alias("moved"), ((F.count_distinct("id") == F.count(F.lit(1))) & (F.min("id") == 0) & (F.max("id") == F.count(F.lit(1)) - 1)).alias("dense"))
    return back.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(facts))  # one row


@register("+K AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM V WHERE id IN (SELECT src FROM E) AND id IN (SELECT dst FROM E)) SELECT a.n AS src, b.n AS dst, weight FROM E JOIN K a ON a.id = src JOIN K b ON b.id = dst")
def g_drop_singletons(spark: SparkSession, d: str) -> DataFrame:
    return coo_graph(spark, d, "weight").drop_singletons().edges


@register("SELECT dst AS src, src AS dst, w1 FROM E")
def g_reverse(spark: SparkSession, d: str) -> DataFrame:
    return coo_graph(spark, d, "w1").reverse().edges


# batch updates


@register("SELECT src, dst, weight, w1 FROM F")
def g_insert(spark: SparkSession, d: str) -> DataFrame:
    g, batch = split_graph(spark, d, "weight", "w1")
    return g.insert(batch).edges


@register("SELECT src, dst, weight, edge_id FROM F WHERE base UNION ALL (SELECT src, dst, weight, edge_id FROM F WHERE NOT base QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY weight NULLS FIRST, edge_id) = 1)")
def g_insert_unique_batch(spark: SparkSession, d: str) -> DataFrame:
    g, batch = split_graph(spark, d, "weight", "edge_id")
    return g.insert(batch, dedup_batch=True).edges


@register("SELECT src, dst, weight FROM F WHERE base UNION ALL SELECT src, dst, weight FROM F WHERE NOT base AND (src, dst) NOT IN (SELECT (src, dst) FROM F WHERE base)")
def g_insert_new_edges(spark: SparkSession, d: str) -> DataFrame:
    g, batch = split_graph(spark, d, "weight")
    return g.insert(batch, dedup_graph=True).edges


@register("SELECT src, dst FROM F WHERE base UNION ALL SELECT DISTINCT src, dst FROM F WHERE NOT base AND (src, dst) NOT IN (SELECT (src, dst) FROM F WHERE base)")
def g_insert_unique_new(spark: SparkSession, d: str) -> DataFrame:
    g, batch = split_graph(spark, d)
    return g.insert(batch, dedup_batch=True, dedup_graph=True).edges


_OLD = "+O AS (SELECT src, dst, min(weight) AS weight FROM F WHERE base GROUP BY ALL), B AS (SELECT src, dst, {} AS weight FROM F WHERE NOT base GROUP BY src, dst) SELECT src, dst, CAST({} AS BIGINT) AS weight FROM O FULL JOIN B USING (src, dst)"


def _upsert(spark: SparkSession, d: str, mode: str) -> DataFrame:
    g, batch = split_graph(spark, d, "weight")
    long = F.col("weight").cast("bigint").alias("weight")
    return updates.upsert_edges(g.edges.select("src", "dst", long).groupBy("src", "dst").agg(F.min("weight").alias("weight")), batch.select("src", "dst", long), mode)


@register(_OLD.format("min(weight)", "CASE WHEN O.src IS NULL THEN B.weight ELSE O.weight END"))
def g_upsert_ignore(spark: SparkSession, d: str) -> DataFrame:
    return _upsert(spark, d, "ignore")


@register(_OLD.format("min(weight)", "coalesce(B.weight, O.weight)"))
def g_upsert_update(spark: SparkSession, d: str) -> DataFrame:
    return _upsert(spark, d, "update")


@register(_OLD.format("sum(weight)", "CASE WHEN O.weight IS NULL THEN B.weight ELSE O.weight + coalesce(B.weight, 0) END"))
def g_upsert_sum(spark: SparkSession, d: str) -> DataFrame:
    return _upsert(spark, d, "sum")


@register("SELECT src, dst FROM E EXCEPT ALL SELECT src, dst FROM F WHERE NOT base")
def g_erase(spark: SparkSession, d: str) -> DataFrame:
    return coo_graph(spark, d).erase(split_graph(spark, d)[1]).edges


@register("SELECT src, dst FROM E EXCEPT ALL SELECT DISTINCT src, dst FROM F WHERE NOT base")
def g_erase_unique(spark: SparkSession, d: str) -> DataFrame:
    return coo_graph(spark, d).erase(split_graph(spark, d)[1], dedup_batch=True).edges


@register("+K AS (SELECT src, dst, count(*) AS k FROM F WHERE NOT base GROUP BY ALL) SELECT src, dst, weight, edge_id FROM (SELECT E.*, row_number() OVER (PARTITION BY src, dst ORDER BY weight NULLS FIRST, edge_id) AS rn FROM E) LEFT JOIN K USING (src, dst) WHERE rn > coalesce(k, 0)")
def g_erase_attributes(spark: SparkSession, d: str) -> DataFrame:
    return coo_graph(spark, d, "weight", "edge_id").erase(split_graph(spark, d)[1]).edges


@register("SELECT src, dst FROM E")
def g_erase_insert_round_trip(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d)
    batch = split_graph(spark, d)[1]
    return g.erase(batch).insert(batch).edges


@register("SELECT src, dst, CAST(pos AS BIGINT) AS pos FROM (SELECT src, dst, row_number() OVER (ORDER BY edge_id) - 1 AS pos FROM E) WHERE pos IN (SELECT degree FROM D)")
def g_gather(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d, "edge_id")
    numbered = ordering.with_index(g.edges, [F.col("edge_id")], "pos")
    return updates.gather(numbered, g.out_degrees().select(F.col("degree").alias("pos")).distinct(), "pos").select("src", "dst", "pos")


def _edge_stream(spark: SparkSession, d: str) -> DataFrame:
    """The edge table as a stream of files."""
    raw = spark.readStream.schema(table(spark, d, "coo_edges").schema).option("maxFilesPerTrigger", 64).option("pathGlobFilter", "*.parquet")
    path = f"{d}/coo_edges.parquet"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        raw, path = raw.option("pathGlobFilter", "coo_edges.parquet"), d
    return raw.parquet(path)


@register("SELECT src, dst, weight FROM E")
def g_stream_inserts(spark: SparkSession, d: str) -> DataFrame:
    """The graph after the edge table has arrived as a stream of files."""
    c = Cutter(spark, "stream")
    first = edge_rows(spark, d).select("src", "dst", "weight").limit(0)
    s = StreamingGraph(spark, c.path(), first)
    stream = _edge_stream(spark, d).select((F.col("index1") - 1).alias("src"), (F.col("index2") - 1).alias("dst"), "weight")
    s.run(stream, c.path())
    return s.edges()


@register("SELECT src, dst FROM E EXCEPT ALL SELECT DISTINCT src, dst FROM F WHERE NOT base")
def g_stream_batches(spark: SparkSession, d: str) -> DataFrame:
    """Three batches: the base files, then the others, then an erasure of each edge of the others once; with a compaction."""
    c = Cutter(spark, "stream-batches")
    g, batch = split_graph(spark, d)
    op = lambda df, name: df.select("src", "dst", F.lit(name).alias("op"))
    s = StreamingGraph(spark, c.path(), g.edges.limit(0), op="op", compact_after=2)
    for n, rows in enumerate((op(g.edges, "insert"), op(batch, "insert"), op(batch.distinct(), "erase"))):
        s.apply(rows, n)
    return s.edges()


@register("""SELECT start, start + INTERVAL 1 DAY AS "end", count(*) AS n_edges FROM (SELECT date_trunc('day', seen_at) AS start FROM coo_edges WHERE seen_at IS NOT NULL)
WHERE start + INTERVAL 1 DAY <= (SELECT max(seen_at) FROM coo_edges) - INTERVAL 2 DAY GROUP BY start""")
def g_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines per day of the whole edge table as a stream, as far as the watermark has closed the windows."""
    c = Cutter(spark, "windows")
    stream = _edge_stream(spark, d).withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    counts = store_windowed_counts(stream, c.path(), c.path(), "seen_at", "1 day", "2 days")
    return counts.select(*(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "n_edges")


# traversal operators and primitives


@register("SELECT id, degree, degree * 2 + 1 AS value FROM D")
def g_for_all_vertices_whole(spark: SparkSession, d: str) -> DataFrame:
    return traverse.for_all_vertices(coo_graph(spark, d), value=F.col("degree") * 2 + 1)


@register("SELECT src, dst, src + dst AS value FROM E")
def g_for_all_edges_whole(spark: SparkSession, d: str) -> DataFrame:
    return traverse.for_all_edges(coo_graph(spark, d), value=F.col("src") + F.col("dst"))


@register("SELECT row_number() OVER (ORDER BY src, dst) - 1 AS position, src, dst, (row_number() OVER (ORDER BY src, dst) - 1) * 2 AS twice FROM E")
def g_for_all_edge_numbers(spark: SparkSession, d: str) -> DataFrame:
    return traverse.for_all_edge_numbers(coo_graph(spark, d), twice=F.col("position") * 2)


@register("SELECT src, dst, a.degree + b.degree AS both FROM F JOIN D a ON a.id = src JOIN D b ON b.id = dst WHERE NOT base")
def g_for_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Given pairs, here those of a batch, with the state of both ends."""
    batch = split_graph(spark, d)[1]
    return traverse.for_all_pairs(batch, coo_graph(spark, d).out_degrees(), both=F.col("s.degree") + F.col("d.degree")).select("src", "dst", "both")


@register("SELECT P.src, P.dst, x.dst AS common FROM (SELECT DISTINCT src, dst FROM F WHERE NOT base AND src <> dst) P JOIN U x ON x.src = P.src JOIN U y ON y.src = P.dst AND y.dst = x.dst")
def g_pair_intersections(spark: SparkSession, d: str) -> DataFrame:
    """Common neighbours of given pairs, here those of a batch."""
    pairs = split_graph(spark, d)[1].filter("src <> dst")
    return traverse.adjacency_intersections(coo_graph(spark, d).simple(), pairs)


@register("SELECT row_number() OVER (ORDER BY src, dst) - 1 AS position, src FROM E")
def g_range_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The source of every edge number, found among the offsets of the compressed rows."""
    g = coo_graph(spark, d)
    starts = g.csr()[0].filter("degree > 0").select("offset", F.col("id").alias("src"))
    return ordering.range_lookup(spark.range(g.n_edges()).withColumnRenamed("id", "position"), starts, "position", "offset", "src").select("position", "src")


@register("SELECT id AS x, (SELECT count(*) FROM E WHERE src < id) AS lower, (SELECT count(*) FROM E WHERE src <= id) AS upper FROM V")
def g_bounds(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d)
    return ordering.bounds(g.vertices.select(F.col("id").alias("x")), g.edges.select(F.col("src").alias("x")))


@register("SELECT src, dst, weight FROM F WHERE NOT base ORDER BY src, dst, weight")
def g_sort_batch(spark: SparkSession, d: str) -> DataFrame:
    return updates.sort_batch(split_graph(spark, d, "weight")[1])


@register("SELECT id, id * id AS square FROM range((SELECT count(*) FROM V)) t(id)")
def g_for_all(spark: SparkSession, d: str) -> DataFrame:
    return traverse.for_all(spark, all_vertices(spark, d).count(), square=F.col("id") * F.col("id"))


@register("SELECT id, degree, degree * 2 + 1 AS value FROM D WHERE id IN (SELECT id FROM anchor_vertices)")
def g_for_all_vertices(spark: SparkSession, d: str) -> DataFrame:
    only = table(spark, d, "anchor_vertices").select("id")
    return traverse.for_all_vertices(coo_graph(spark, d), only, value=F.col("degree") * 2 + 1)


@register("SELECT src, dst, src + dst AS value FROM E WHERE src IN (SELECT id FROM anchor_vertices)")
def g_for_all_edges(spark: SparkSession, d: str) -> DataFrame:
    return traverse.for_all_edges(coo_graph(spark, d), table(spark, d, "anchor_vertices"), value=F.col("src") + F.col("dst"))


@register("SELECT src, dst, a.degree - b.degree AS difference FROM E JOIN D a ON a.id = src JOIN D b ON b.id = dst")
def g_for_all_edge_pairs(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d)
    return traverse.for_all_edge_pairs(g, g.out_degrees(), difference=F.col("s.degree") - F.col("d.degree")).select("src", "dst", "difference")


@register("SELECT dst AS id, CAST(sum(degree) AS BIGINT) AS total, max(degree) AS top, count(*) AS n FROM E JOIN D ON id = src WHERE src <> dst GROUP BY dst")
def g_aggregate_messages(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d)
    message = F.when(F.col("src") != F.col("dst"), F.col("s.degree"))
    return traverse.aggregate_messages(g, g.out_degrees(), message, {"total": F.sum("message"), "top": F.max("message"), "n": F.count("message")})


@register("SELECT U.src, U.dst, x.dst AS common FROM U JOIN U x ON x.src = U.src JOIN U y ON y.src = U.dst AND y.dst = x.dst")
def g_adjacency_intersections(spark: SparkSession, d: str) -> DataFrame:
    return traverse.adjacency_intersections(coo_graph(spark, d).simple())


@register("SELECT id, CAST(sum(degree) OVER (ORDER BY id) - degree AS BIGINT) AS exclusive, CAST(sum(degree) OVER (ORDER BY id) AS BIGINT) AS inclusive, max(degree) OVER (ORDER BY id) AS top FROM D")
def g_prefix_scans(spark: SparkSession, d: str) -> DataFrame:
    deg = coo_graph(spark, d).out_degrees()
    a = ordering.running_sum(deg, [F.col("id")], F.col("degree"), "exclusive")
    b = ordering.running_max(a, [F.col("id")], F.col("degree"), "top")
    return b.select("id", "exclusive", (F.col("exclusive") + F.col("degree")).alias("inclusive"), "top")


@register("SELECT weight, count(*) AS n FROM E GROUP BY weight")
def g_run_lengths(spark: SparkSession, d: str) -> DataFrame:
    return traverse.run_lengths(coo_graph(spark, d, "weight").edges, "weight")


@register("SELECT weight > 50 IS TRUE AS heavy, count(*) AS n FROM E GROUP BY ALL")
def g_partition_by_flag(spark: SparkSession, d: str) -> DataFrame:
    yes, no = traverse.partition_by_flag(coo_graph(spark, d, "weight").edges, F.col("weight") > 50)
    return yes.agg(F.count(F.lit(1)).alias("n")).withColumn("heavy", F.lit(True)).unionByName(no.agg(F.count(F.lit(1)).alias("n")).withColumn("heavy", F.lit(False)))


@register("SELECT graph_id, max(edge_id) AS last_edge, count(*) AS n FROM E GROUP BY graph_id")
def g_segmented_reduce(spark: SparkSession, d: str) -> DataFrame:
    return traverse.segmented_reduce(edge_rows(spark, d), "graph_id", last_edge=F.max("edge_id"), n=F.count(F.lit(1)))


@register("SELECT id, degree FROM D ORDER BY degree DESC, id LIMIT 1")
def g_arg_max(spark: SparkSession, d: str) -> DataFrame:
    return traverse.arg_max(coo_graph(spark, d).out_degrees(), "id", "degree")


@register("""SELECT src, dst, CAST(ceil((src + 1) / (dst + 1)) AS BIGINT) AS up, CAST(floor((src + 1) / (dst + 1) + 0.5) AS BIGINT) AS near, CAST(ceil(src / 32) * 32 AS BIGINT) AS above, CAST(floor(src / 32) * 32 AS BIGINT) AS below,
bit_count(src) = 1 AS power, CAST(length(bin(src + 1)) - 1 AS BIGINT) AS log_down, CAST(CASE WHEN src = 0 THEN 0 ELSE length(bin(src)) END AS BIGINT) AS log_up, CAST(1 AS BIGINT) << CAST(CASE WHEN src = 0 THEN 0 ELSE length(bin(src)) END AS INT) AS two_up,
(src >> 3) & 1 = 1 AS bit, gcd(src, dst) AS divisor FROM E""")
def g_numeric(spark: SparkSession, d: str) -> DataFrame:
    e = coo_graph(spark, d).edges
    a, b = F.col("src"), F.col("dst")
    return e.select("src", "dst", numeric.ceil_div(a + 1, b + 1).alias("up"), numeric.round_div(a + 1, b + 1).alias("near"), numeric.upper_multiple(a, 32).alias("above"), numeric.lower_multiple(a, 32).alias("below"), numeric.is_power2(a).alias("power"), numeric.floor_log2(a + 1).cast("bigint").alias("log_down"), numeric.ceil_log2(a + 1).cast("bigint").alias("log_up"), numeric.next_power2(a + 1).alias("two_up"), numeric.read_bit(a, F.lit(3)).alias("bit"), numeric.gcd(a, b).alias("divisor"))


# statistics


@register("SELECT CAST(CASE WHEN degree = 0 THEN -1 ELSE length(bin(degree)) - 1 END AS INT) AS bucket, count(*) AS n_vertices, CAST(sum(degree) AS BIGINT) AS n_edges, round(100.0 * count(*) / (SELECT count(*) FROM D), 6) AS vertex_percent, round(100.0 * sum(degree) / (SELECT sum(degree) FROM D), 6) AS edge_percent FROM D GROUP BY ALL")
def g_degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.degree_distribution(coo_graph(spark, d)).withColumns({c: F.round(c, 6) for c in ("vertex_percent", "edge_percent")})


@register("""+I AS (SELECT id, degree AS o, (SELECT count(*) FROM E WHERE dst = id) AS i FROM D), R AS (SELECT *, row_number() OVER (ORDER BY o, id) AS r FROM I), Z AS (SELECT id - row_number() OVER (ORDER BY id) AS run FROM I WHERE o = 0)
SELECT count(*) AS n_vertices, CAST(sum(o) AS BIGINT) AS n_edges, round(avg(o), 6) AS avg_degree, round(stddev_pop(o), 6) AS std_degree, round(stddev_pop(o) / avg(o), 6) AS cv, round(2 * sum(r * o) / (count(*) * sum(o)) - (count(*) + 1) / count(*), 6) AS gini,
round(sum(o) / (count(*) * count(*)), 9) AS sparsity, max(o) AS max_out, max(i) AS max_in, (SELECT count(*) FROM E WHERE src = dst) AS rings, count(*) FILTER (o = 0 AND i = 0) AS singletons, count(*) FILTER (o = 0) AS out_0, count(*) FILTER (i = 0) AS in_0, count(*) FILTER (o = 1) AS out_1, count(*) FILTER (i = 1) AS in_1,
(SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM Z GROUP BY run)) AS longest_empty_run, count(*) FILTER (o = 1 AND i = 0) AS out_leaves, count(*) FILTER (i = 1 AND o = 0) AS in_leaves FROM R""")
def g_analysis(spark: SparkSession, d: str) -> DataFrame:
    return stats.graph_analysis(coo_graph(spark, d)).withColumns({c: F.round(c, 9 if c == "sparsity" else 6) for c in ("avg_degree", "std_degree", "cv", "gini", "sparsity")})


# paths


_BFS = "+S AS (SELECT id FROM D ORDER BY degree DESC, id LIMIT 1), B(id, distance) USING KEY (id) AS (SELECT id, 0 FROM S UNION SELECT E.dst, min(B.distance) + 1 FROM B JOIN E ON E.src = B.id WHERE E.dst NOT IN (SELECT id FROM recurring.B) GROUP BY E.dst) "


@register(_BFS + "SELECT id, distance FROM V LEFT JOIN B USING (id)", recursive=True)
def g_bfs(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d)
    return paths.bfs(g, _top_vertex(g), direction="push")


@register(_BFS + "SELECT id, coalesce(distance, 2147483647) AS distance FROM V LEFT JOIN B USING (id)", recursive=True)
def g_bfs_pull(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d)
    return paths.bfs(g, _top_vertex(g), direction="pull", unreached="max")


@register(_BFS + "SELECT count(*) AS visited_nodes, CAST(sum(degree) AS BIGINT) AS visited_edges, max(distance) + 1 AS levels FROM B JOIN D USING (id)", recursive=True)
def g_bfs_summary(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d)
    return paths.bfs_summary(g, paths.bfs(g, _top_vertex(g)))


@register(_BFS + """, L AS (SELECT a.distance AS level, b.distance AS t FROM E JOIN B a ON a.id = src JOIN B b ON b.id = dst)
SELECT level, count(*) FILTER (t < level) AS n_parent, count(*) FILTER (t = level) AS n_peer, (SELECT count(*) FROM B WHERE distance = level + 1) AS n_valid, count(*) FILTER (t = level + 1) - (SELECT count(*) FROM B WHERE distance = level + 1) AS n_not_valid FROM L GROUP BY level""", recursive=True)
def g_bfs_edge_kinds(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d)
    return paths.bfs_edge_kinds(g, paths.bfs(g, _top_vertex(g)))


@register("+S AS (SELECT id FROM D ORDER BY degree DESC, id LIMIT 1), W AS (SELECT src, dst, min(abs(CAST(weight AS BIGINT))) AS w FROM E WHERE weight IS NOT NULL AND src <> dst GROUP BY ALL), B(id, distance) USING KEY (id) AS (SELECT id, CAST(0 AS BIGINT) FROM S UNION SELECT W.dst, min(B.distance + W.w) FROM B JOIN W ON W.src = B.id LEFT JOIN recurring.B AS k ON k.id = W.dst WHERE k.id IS NULL OR B.distance + W.w < k.distance GROUP BY W.dst) SELECT id, distance FROM V LEFT JOIN B USING (id)", recursive=True)
def g_sssp(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d, "weight")
    return paths.sssp(g, _top_vertex(g), F.abs(F.col("weight").cast("bigint")))


# components


_CC = "+B(id, component) USING KEY (id) AS (SELECT id, id FROM V UNION SELECT U.dst, min(B.component) FROM B JOIN U ON U.src = B.id JOIN recurring.B AS k ON k.id = U.dst WHERE B.component < k.component GROUP BY U.dst) "


@register(_CC + "SELECT id, component FROM B", recursive=True)
def g_components(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_components(coo_graph(spark, d))


@register(_CC + ", M AS (SELECT component, max(id) + 1 AS name FROM B GROUP BY component), T AS (SELECT component FROM B WHERE id = (SELECT src FROM U GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)) SELECT id, CASE WHEN component = (SELECT component FROM T) THEN 0 ELSE name END AS component FROM B JOIN M USING (component)", recursive=True)
def g_components_max(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_components(coo_graph(spark, d).simple(), "max")


@register(_CC + "SELECT component, row_number() OVER (ORDER BY component) - 1 AS component_id, count(*) AS size FROM B GROUP BY component", recursive=True)
def g_component_ids(spark: SparkSession, d: str) -> DataFrame:
    return components.component_ids(components.connected_components(coo_graph(spark, d)))


@register(_CC + ", Z AS (SELECT count(*) AS size FROM B GROUP BY component) SELECT count(*) AS n_components, max(size) AS largest, count(*) FILTER (size = 1) AS n_trivial FROM Z", recursive=True)
def g_component_statistics(spark: SparkSession, d: str) -> DataFrame:
    return components.component_statistics(components.connected_components(coo_graph(spark, d)))


@register(_CC + ", Z AS (SELECT count(*) AS size FROM B GROUP BY component) SELECT CAST(length(bin(size)) - 1 AS INT) AS log2_size, count(*) AS n_components FROM Z GROUP BY ALL", recursive=True)
def g_component_histogram(spark: SparkSession, d: str) -> DataFrame:
    return components.component_histogram(components.connected_components(coo_graph(spark, d)))


# The component of the vertex of the largest degree by two searches; mutual reachability among all others.
_SCC = """+Q AS (SELECT DISTINCT src, dst FROM E WHERE src <> dst), S AS (SELECT id FROM D ORDER BY degree DESC, id LIMIT 1), FW AS (SELECT id FROM S UNION SELECT dst FROM FW JOIN Q ON src = id), BW AS (SELECT id FROM S UNION SELECT src FROM BW JOIN Q ON dst = id),
G AS MATERIALIZED (SELECT id FROM FW INTERSECT SELECT id FROM BW), Q2 AS MATERIALIZED (SELECT * FROM Q WHERE src NOT IN (SELECT id FROM G) AND dst NOT IN (SELECT id FROM G)), TC(a, b) AS (SELECT src, dst FROM Q2 UNION SELECT a, dst FROM TC JOIN Q2 ON src = b),
SC AS (SELECT V.id, CASE WHEN V.id IN (SELECT id FROM G) THEN (SELECT min(id) FROM G) ELSE least(V.id, coalesce(m, V.id)) END AS component FROM V LEFT JOIN (SELECT x.a AS id, min(x.b) AS m FROM TC x JOIN TC y ON y.a = x.b AND y.b = x.a GROUP BY x.a) USING (id)) """


@register(_SCC + "SELECT * FROM SC", recursive=True)
def g_strong_components(spark: SparkSession, d: str) -> DataFrame:
    return components.strong_components(coo_graph(spark, d))


@register(_SCC + "SELECT component, count(*) AS size FROM SC GROUP BY component HAVING count(*) > 1", recursive=True)
def g_strong_component_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The strongly connected components of more than one vertex."""
    found = components.strong_components(coo_graph(spark, d))
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")


# ranking


def _rank_sql(rounds: int, push: bool, start: str = "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM V) AS rank FROM V", edges: str = "E", tag: str = "P") -> str:
    a, b = ("src", "dst") if push else ("dst", "src")
    out = f"{tag}D AS (SELECT id, count(src) AS degree FROM V LEFT JOIN {edges} ON src = id GROUP BY id), {tag}0 AS MATERIALIZED ({start})"
    for i in range(1, rounds + 1):
        out += f",\n{tag}{i} AS MATERIALIZED (SELECT V.id, (0.15::DOUBLE) / (SELECT count(*) FROM V) + 0.85::DOUBLE * coalesce(s, 0) AS rank FROM V LEFT JOIN (SELECT {b} AS id, sum(rank / degree) AS s FROM {edges} JOIN {tag}{i - 1} p ON p.id = {a} JOIN {tag}D q ON q.id = {a} WHERE degree > 0 GROUP BY {b}) USING (id))"
    return out


@register("+" + _rank_sql(5, True) + " SELECT id, round(rank, 10) AS rank FROM P5")
def g_page_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.page_rank(coo_graph(spark, d), rounds=5, threshold=None).withColumn("rank", F.round("rank", 10))


@register("+" + _rank_sql(5, False) + " SELECT id, round(rank, 10) AS rank FROM P5")
def g_page_rank_pull(spark: SparkSession, d: str) -> DataFrame:
    return ranking.page_rank(coo_graph(spark, d), rounds=5, threshold=None, mode="pull").withColumn("rank", F.round("rank", 10))


@register("+" + _rank_sql(5, True) + " SELECT id, round(rank, 10) AS rank FROM P5 ORDER BY P5.rank DESC, id LIMIT 10")
def g_page_rank_top(spark: SparkSession, d: str) -> DataFrame:
    r = ranking.page_rank(coo_graph(spark, d), rounds=5, threshold=None)
    return r.orderBy(F.desc("rank"), "id").limit(10).withColumn("rank", F.round("rank", 10))


@register("+B0 AS (SELECT src, dst FROM F WHERE base), " + _rank_sql(3, True, edges="B0", tag="Q") + ", " + _rank_sql(3, True, start="SELECT * FROM Q3") + " SELECT id, round(rank, 10) AS rank FROM P3")
def g_page_rank_dynamic(spark: SparkSession, d: str) -> DataFrame:
    g, batch = split_graph(spark, d)
    before = ranking.page_rank(g, rounds=3, threshold=None)
    return ranking.page_rank(g.insert(batch), rounds=3, threshold=None, start=before).withColumn("rank", F.round("rank", 10))


# The default job: up to 20 rounds, ended by the sum of changes.  SQL unrolls all rounds and takes the first one after which it ends.


def _rank_end(tag: str = "P", rounds: int = 20) -> str:
    """The common tables {tag}E with the ranks at which the default job ends."""
    changes = " UNION ALL ".join(f"SELECT {i} AS r, sum(abs(a.rank - b.rank)) AS c FROM {tag}{i} a JOIN {tag}{i - 1} b USING (id)" for i in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS r, id, rank FROM {tag}{i}" for i in range(1, rounds + 1))
    return f", {tag}C AS MATERIALIZED ({changes}), {tag}E AS MATERIALIZED (SELECT id, rank FROM ({every}) WHERE r = coalesce((SELECT min(r) FROM {tag}C WHERE c <= 0.001), {rounds}))"


@register("+" + _rank_sql(20, True) + _rank_end() + " SELECT id, round(rank, 10) AS rank FROM PE")
def g_page_rank_default(spark: SparkSession, d: str) -> DataFrame:
    return ranking.page_rank(coo_graph(spark, d)).withColumn("rank", F.round("rank", 10))


@register("+" + _rank_sql(20, False) + _rank_end() + " SELECT id, round(rank, 10) AS rank FROM PE")
def g_page_rank_pull_default(spark: SparkSession, d: str) -> DataFrame:
    return ranking.page_rank(coo_graph(spark, d), mode="pull").withColumn("rank", F.round("rank", 10))


@register("+" + _rank_sql(20, True) + _rank_end() + " SELECT id, round(rank, 10) AS rank FROM PE ORDER BY PE.rank DESC, id LIMIT 10")
def g_page_rank_top_default(spark: SparkSession, d: str) -> DataFrame:
    r = ranking.page_rank(coo_graph(spark, d))
    return r.orderBy(F.desc("rank"), "id").limit(10).withColumn("rank", F.round("rank", 10))


@register("+B0 AS (SELECT src, dst FROM F WHERE base), " + _rank_sql(20, True, edges="B0", tag="Q") + _rank_end("Q") + ", " + _rank_sql(20, True, start="SELECT * FROM QE") + _rank_end() + " SELECT id, round(rank, 10) AS rank FROM PE")
def g_page_rank_dynamic_default(spark: SparkSession, d: str) -> DataFrame:
    g, batch = split_graph(spark, d)
    return ranking.page_rank(g.insert(batch), start=ranking.page_rank(g)).withColumn("rank", F.round("rank", 10))


def _katz_sql(rounds: int) -> str:
    out = "+A AS (SELECT 1.0::DOUBLE / (max(n) + 1) AS alpha, max(n) AS top FROM (SELECT count(*) AS n FROM U GROUP BY src)), K0 AS (SELECT id, 1.0::DOUBLE AS paths FROM V)"
    for i in range(1, rounds + 1):
        out += f",\nK{i} AS MATERIALIZED (SELECT V.id, coalesce(s, 0) AS paths FROM V LEFT JOIN (SELECT dst AS id, sum(paths) AS s FROM U JOIN K{i - 1} ON id = src GROUP BY dst) USING (id))"
    total = " UNION ALL ".join(f"SELECT id, power(alpha, {i}) * paths AS s FROM K{i}, A" for i in range(1, rounds + 1))
    return out + f", KS AS (SELECT id, sum(s) AS score FROM ({total}) GROUP BY id)"


@register(_katz_sql(4) + " SELECT id, round(score, 9) AS score, round(score + power(alpha, 5) / (1 - alpha) * paths, 9) AS lower, round(score + power(alpha, 5) / (1 - alpha * top) * paths, 9) AS upper, paths FROM KS JOIN K4 USING (id), A")
def g_katz(spark: SparkSession, d: str) -> DataFrame:
    return ranking.katz(coo_graph(spark, d).simple(), rounds=5).withColumns({c: F.round(c, 9) for c in ("score", "lower", "upper")})


@register(_katz_sql(49) + " SELECT id, round(score, 9) AS score, round(score + power(alpha, 50) / (1 - alpha) * paths, 9) AS lower, round(score + power(alpha, 50) / (1 - alpha * top) * paths, 9) AS upper FROM KS JOIN K49 USING (id), A")
def g_katz_default(spark: SparkSession, d: str) -> DataFrame:
    return ranking.katz(coo_graph(spark, d).simple()).select("id", *(F.round(c, 9).alias(c) for c in ("score", "lower", "upper")))


@register(_katz_sql(19) + " SELECT id FROM KS ORDER BY score DESC, id LIMIT 10")
def g_katz_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten vertices of the largest scores; their bounds depend on the round at which they are sure."""
    k = ranking.katz(coo_graph(spark, d).simple(), rounds=20, top_k=10)
    return k.orderBy(F.desc("lower"), "id").limit(10).select("id")


def _katz_dynamic(spark: SparkSession, d: str, rounds: int) -> DataFrame:
    """Katz of the whole graph, reached from that of the base files by their batch."""
    c = Cutter(spark, "katz-dynamic")
    g, batch = split_graph(spark, d)
    old = Graph(g.vertices, c.cut(g.simple().edges)[0])
    new = Graph(g.vertices, c.cut(g.insert(batch).simple().edges)[0])
    added = new.edges.join(old.edges, ["src", "dst"], "left_anti")
    return ranking.katz_after(old, added, old.edges.limit(0), rounds, new.max_degree().first().degree).withColumn("score", F.round("score", 9))


@register(_katz_sql(3) + " SELECT id, round(score, 9) AS score FROM KS")
def g_katz_dynamic(spark: SparkSession, d: str) -> DataFrame:
    return _katz_dynamic(spark, d, 3)


@register(_katz_sql(49) + " SELECT id, round(score, 9) AS score FROM KS")
def g_katz_dynamic_default(spark: SparkSession, d: str) -> DataFrame:
    """The rounds of the static default, which are one less than its 50."""
    return _katz_dynamic(spark, d, 49)


def _bc_sql(roots: str) -> str:
    """Brandes' dependencies: levels and path counts forwards, shares backwards."""
    return f"""+S AS ({roots}), B(root, id, lvl, sigma) USING KEY (root, id) AS (SELECT id, id, 0, 1.0::DOUBLE FROM S UNION SELECT B.root, U.dst, max(B.lvl) + 1, sum(B.sigma) FROM B JOIN U ON U.src = B.id WHERE (B.root, U.dst) NOT IN (SELECT (root, id) FROM recurring.B) GROUP BY B.root, U.dst),
L AS MATERIALIZED (SELECT * FROM B), X(root, id, lvl, sigma, delta) AS (SELECT root, id, lvl, sigma, 0::DOUBLE FROM L WHERE lvl = (SELECT max(lvl) FROM L)
UNION ALL SELECT b.root, b.id, b.lvl, b.sigma, b.sigma * coalesce(s.share, 0) FROM (SELECT * FROM L WHERE lvl = (SELECT min(lvl) FROM X) - 1) b LEFT JOIN (SELECT X.root, U.src AS id, sum((1 + X.delta) / X.sigma) AS share FROM X JOIN U ON U.dst = X.id GROUP BY ALL) s ON s.root = b.root AND s.id = b.id)
SELECT id, round(coalesce(bc, 0), 6) AS bc FROM V LEFT JOIN (SELECT id, sum(delta) AS bc FROM X WHERE id <> root GROUP BY id) USING (id)"""


@register(_bc_sql("SELECT src AS id FROM U GROUP BY src ORDER BY count(*) DESC, src LIMIT 1"), recursive=True)
def g_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """One root: the vertex of the largest degree."""
    g = coo_graph(spark, d).simple()
    return ranking.betweenness(g, g.max_degree().select("id"), symmetric=True).withColumn("bc", F.round("bc", 6))


@register(_bc_sql("SELECT id FROM V ORDER BY md5(id || '-1'), id LIMIT 8"), recursive=True)
def g_betweenness_sampled(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d).simple()
    return ranking.betweenness(g, ranking.random_roots(g, 8, 1), symmetric=True).withColumn("bc", F.round("bc", 6))


@register()
def g_betweenness_exact(spark: SparkSession, d: str) -> DataFrame:
    """All roots, on the whole graph (the effort is vertices times edges)."""
    return ranking.betweenness(coo_graph(spark, d).simple(), symmetric=True).withColumn("bc", F.round("bc", 6))


# triangles, cores, trusses


_TRI = "+O AS (SELECT src, count(*) AS degree FROM U GROUP BY src), A AS MATERIALIZED (SELECT U.src, U.dst FROM U JOIN O a ON a.src = U.src JOIN O b ON b.src = U.dst WHERE (a.degree, U.src) < (b.degree, U.dst)), T AS MATERIALIZED (SELECT x.src AS u, x.dst AS v, y.dst AS w FROM A x JOIN A y ON x.src = y.src JOIN A z ON z.src = x.dst AND z.dst = y.dst), TV AS (SELECT id, count(*) AS triangles FROM (SELECT u AS id FROM T UNION ALL SELECT v FROM T UNION ALL SELECT w FROM T) GROUP BY id) "


@register(_TRI + "SELECT count(*) AS triangles FROM T")
def g_triangles(spark: SparkSession, d: str) -> DataFrame:
    return dense.triangle_total(coo_graph(spark, d))


@register(_TRI + "SELECT id, coalesce(triangles, 0) AS triangles FROM V LEFT JOIN TV USING (id)")
def g_triangle_counts(spark: SparkSession, d: str) -> DataFrame:
    return dense.triangle_counts(coo_graph(spark, d))


@register(_TRI + "SELECT id, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0.0 END, 9) AS coefficient FROM V LEFT JOIN TV USING (id) LEFT JOIN O ON src = id")
def g_clustering(spark: SparkSession, d: str) -> DataFrame:
    return dense.clustering(coo_graph(spark, d)).withColumn("coefficient", F.round("coefficient", 9))


@register(_TRI + "SELECT round(avg(CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0.0 END), 9) AS coefficient FROM V LEFT JOIN TV USING (id) LEFT JOIN O ON src = id")
def g_mean_clustering(spark: SparkSession, d: str) -> DataFrame:
    return dense.mean_clustering(coo_graph(spark, d)).withColumn("coefficient", F.round("coefficient", 9))


_SUP = _TRI + ", TE AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS n FROM (SELECT u AS a, v AS b FROM T UNION ALL SELECT u, w FROM T UNION ALL SELECT v, w FROM T) GROUP BY ALL), S AS (SELECT src, dst, coalesce(n, 0) AS support FROM U LEFT JOIN TE USING (src, dst) WHERE src < dst) "


@register(_SUP + "SELECT * FROM S")
def g_edge_support(spark: SparkSession, d: str) -> DataFrame:
    """Supports of the whole edge table."""
    return dense.edge_support(coo_graph(spark, d).simple().edges)


@register(_SUP + "SELECT src, dst FROM S WHERE support >= 1")
def g_truss_3(spark: SparkSession, d: str) -> DataFrame:
    return dense.truss(coo_graph(spark, d), 3)


_TRUSS = _TRI + """, T3 AS MATERIALIZED (SELECT list_sort([u, v, w])[1] AS a, list_sort([u, v, w])[2] AS b, list_sort([u, v, w])[3] AS c FROM T),
S3 AS MATERIALIZED (SELECT row_number() OVER () AS t, a, b, c FROM T3), SIDES AS MATERIALIZED (SELECT t, a AS src, b AS dst FROM S3 UNION ALL SELECT t, a, c FROM S3 UNION ALL SELECT t, b, c FROM S3),
R(r, src, dst, truss) AS (SELECT 0, src, dst, count(*) + 2 FROM SIDES GROUP BY src, dst UNION ALL SELECT (SELECT max(r) FROM R) + 1, src, dst, max(least(x, k + 2)) FROM
(SELECT s.src, s.dst, m.x, row_number() OVER (PARTITION BY s.src, s.dst ORDER BY m.x DESC) AS k FROM SIDES s JOIN (SELECT t, min(truss) AS x FROM SIDES JOIN R USING (src, dst) WHERE R.r < 25 GROUP BY t) m USING (t)) GROUP BY src, dst),
TN AS (SELECT src, dst, CAST(coalesce(truss, 2) AS INT) AS truss FROM U LEFT JOIN (SELECT src, dst, truss FROM R WHERE r = 25) USING (src, dst) WHERE src < dst) """


@register(_TRUSS + "SELECT src, dst FROM TN WHERE truss >= 4", recursive=True)
def g_truss_4(spark: SparkSession, d: str) -> DataFrame:
    """More than one round: edges that leave break triangles of others."""
    return dense.truss(coo_graph(spark, d), 4)


@register(_TRUSS + "SELECT * FROM TN", recursive=True)
def g_truss_numbers(spark: SparkSession, d: str) -> DataFrame:
    return dense.truss_numbers(coo_graph(spark, d))


@register(_TRUSS + "SELECT * FROM TN", recursive=True)
def g_truss_dynamic(spark: SparkSession, d: str) -> DataFrame:
    """Truss numbers of the whole edge table, reached from those of the base files by the batch of the others."""
    g, batch = split_graph(spark, d)
    c = Cutter(spark, "truss-dynamic")
    edges, _ = c.cut(g.simple().edges)
    before, _ = c.cut(dense.truss_numbers_of(edges))
    return dense.truss_numbers_after(edges, before, batch, batch.limit(0))


@register(_TRUSS + "SELECT max(truss) AS max_k FROM TN", recursive=True)
def g_max_truss(spark: SparkSession, d: str) -> DataFrame:
    return dense.max_truss(coo_graph(spark, d))


_SUP_BASE = "+UB AS (SELECT src, dst FROM F WHERE base AND src <> dst UNION SELECT dst, src FROM F WHERE base AND src <> dst), " + _SUP[1:].replace("FROM U ", "FROM UB U ")


@register(_SUP_BASE + "SELECT * FROM S")
def g_support_after_erase(spark: SparkSession, d: str) -> DataFrame:
    """Supports of the whole edge table kept up when the pairs outside the base files are erased."""
    c = Cutter(spark, "support-erase")
    edges, _ = c.cut(coo_graph(spark, d).simple().edges)
    erased = edges.join(split_graph(spark, d)[0].simple().edges, ["src", "dst"], "left_anti").filter("src < dst")
    return dense.support_after_erase(edges, dense.edge_support(edges), c.cut(erased)[0])


_CORE = """+H(r, id, core) AS (SELECT 0, src, count(*) FROM U GROUP BY src UNION ALL SELECT (SELECT max(r) FROM H) + 1, id, max(least(x, k)) FROM (SELECT U.src AS id, H.core AS x, row_number() OVER (PARTITION BY U.src ORDER BY H.core DESC) AS k FROM H JOIN U ON U.dst = H.id WHERE H.r < 40) GROUP BY id) """


@register(_CORE + "SELECT id, coalesce(core, 0) AS core FROM V LEFT JOIN (SELECT id, core FROM H WHERE r = 40) USING (id)", recursive=True)
def g_core_numbers(spark: SparkSession, d: str) -> DataFrame:
    return dense.core_numbers(coo_graph(spark, d))


@register()
def g_core_edge_peel(spark: SparkSession, d: str) -> DataFrame:
    return dense.core_edge_peel(coo_graph(spark, d))


# algebra


@register("SELECT V.id, CAST(coalesce(y, 0) AS BIGINT) AS y FROM V LEFT JOIN (SELECT src AS id, sum(CAST(weight AS BIGINT) * degree) AS y FROM E JOIN D ON D.id = dst GROUP BY src) USING (id)")
def g_spmv(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d, "weight")
    return algebra.spmv(g, g.out_degrees().withColumnRenamed("degree", "x"), F.col("weight").cast("bigint"))


@register("""+W AS MATERIALIZED (SELECT src, dst, CASE WHEN src >= 256 AND dst < 256 THEN -((weight % 5 + 5) % 5) ELSE 5 END AS w FROM E WHERE weight IS NOT NULL), P(r, id, p) AS (SELECT 0, id, 0::BIGINT FROM V UNION ALL
SELECT (SELECT max(r) FROM P) + 1, V.id, greatest(0, coalesce(CASE WHEN V.id >= 128 THEN lo ELSE hi END, 0)) FROM V LEFT JOIN (SELECT W.src AS id, min(greatest(p - w, 0)) AS lo, max(greatest(p - w, 0)) AS hi FROM P JOIN W ON W.dst = P.id GROUP BY W.src) USING (id) WHERE (SELECT max(r) FROM P) < 30)
SELECT id, p AS potential FROM P WHERE r = 30""", recursive=True)
def g_least_potentials(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d, "weight")
    # Energy is lost on the way to an old vertex and won on every other edge, so that all potentials are finite.
    loss = F.when((F.col("src") >= 256) & (F.col("dst") < 256), -F.pmod(F.col("weight"), F.lit(5))).otherwise(5)
    e = g.edges.select("src", "dst", F.when(F.col("weight").isNotNull(), loss).alias("weight"))
    return algebra.least_potentials(Graph(g.vertices, e), threshold=128)


# sources and sinks


def _file(spark: SparkSession, lines: DataFrame) -> str:
    path = Cutter(spark, "files").path()
    sinks.write_lines(lines, path)
    return path


def _with_head(spark: SparkSession, head: list[str], body: DataFrame) -> DataFrame:
    """Lines of (value, k) behind header lines."""
    top = spark.createDataFrame([(h, -len(head) + i) for i, h in enumerate(head)], "value string, at bigint")
    return top.unionByName(body.select("value", F.col("k").cast("bigint").alias("at")))


def _pairs(spark: SparkSession, d: str, sep: str = " ", weight: bool = False) -> DataFrame:
    e = edge_rows(spark, d)
    cols = [F.col("src") + 1, F.col("dst") + 1, *([F.coalesce("weight", F.lit(0))] if weight else [])]
    return e.select(F.concat_ws(sep, *cols).alias("value"), F.col("edge_id").alias("k"))


@register("SELECT src, dst FROM E")
def g_read_mtx(spark: SparkSession, d: str) -> DataFrame:
    return files.read_graph(spark, _file(spark, sinks.market_lines(coo_graph(spark, d))), "mtx").edges


@register("SELECT src, dst, coalesce(weight, 0) AS weight FROM E")
def g_read_mtx_weighted(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d, "weight")
    full = Graph(g.vertices, g.edges.fillna(0, ["weight"]))
    return files.read_graph(spark, _file(spark, sinks.market_lines(full, "weight")), "mtx", weight="int").edges


@register("SELECT src, dst FROM E UNION ALL SELECT dst, src FROM E WHERE src <> dst")
def g_read_mtx_symmetric(spark: SparkSession, d: str) -> DataFrame:
    n = all_vertices(spark, d).count()
    lines = _with_head(spark, ["%%MatrixMarket matrix coordinate pattern symmetric", f"{n} {n} 0"], _pairs(spark, d))
    return files.read_graph(spark, _file(spark, lines), "mtx").edges


@register("SELECT src, dst FROM E")
def g_read_dimacs10(spark: SparkSession, d: str) -> DataFrame:
    return files.read_graph(spark, _file(spark, sinks.dimacs10_lines(coo_graph(spark, d))), "graph").edges


@register("SELECT src, dst, CAST(coalesce(weight, 0) AS BIGINT) AS weight FROM E")
def g_read_gr(spark: SparkSession, d: str) -> DataFrame:
    body = _pairs(spark, d, weight=True).select(F.concat(F.lit("a "), "value").alias("value"), "k")
    lines = _with_head(spark, ["c roads", f"p sp {all_vertices(spark, d).count()} 0"], body)
    return files.read_graph(spark, _file(spark, lines), "gr").edges


@register("SELECT src, dst FROM E")
def g_read_konect(spark: SparkSession, d: str) -> DataFrame:
    return files.read_graph(spark, _file(spark, _with_head(spark, ["% asym unweighted"], _pairs(spark, d))), "konect").edges


@register("SELECT src, dst FROM E UNION ALL SELECT dst, src FROM E WHERE src <> dst")
def g_read_edges(spark: SparkSession, d: str) -> DataFrame:
    return files.read_graph(spark, _file(spark, _with_head(spark, ["% undirected"], _pairs(spark, d, ","))), "edges").edges


_FIRST = "+X AS (SELECT {a} AS label, {k} AS k, 0 AS s FROM {t} UNION ALL SELECT {b}, {k}, 1 FROM {t}), I AS (SELECT label, row_number() OVER (ORDER BY min((k, s))) - 1 AS id FROM X GROUP BY label) "


@register(_FIRST.format(a="src", b="dst", k="edge_id", t="E") + "SELECT a.id AS src, b.id AS dst, CAST(coalesce(weight, 0) AS INT) AS weight FROM E JOIN I a ON a.label = src JOIN I b ON b.label = dst")
def g_read_snap(spark: SparkSession, d: str) -> DataFrame:
    lines = _with_head(spark, ["# Directed graph", "# Nodes: 0 Edges: 0"], _pairs(spark, d, "\t", weight=True))
    return files.read_graph(spark, _file(spark, lines), "snap", weight="int").edges


_L = "L AS (SELECT line_id, label1, label2 FROM label_edges WHERE label1 IS NOT NULL AND label2 IS NOT NULL AND NOT regexp_matches(label1 || label2, '\\s') AND label1 <> '' AND label2 <> '')"


@register("+" + _L + ", " + _FIRST.format(a="label1", b="label2", k="line_id", t="L")[1:] + "SELECT a.id AS src, b.id AS dst, label1, label2 FROM L JOIN I a ON a.label = label1 JOIN I b ON b.label = label2")
def g_read_labels(spark: SparkSession, d: str) -> DataFrame:
    """A file of label pairs; labels that hold blanks cannot stand in this format."""
    both = F.concat("label1", "label2")
    rows = table(spark, d, "label_edges").filter(both.isNotNull() & ~both.rlike(r"\s") & (F.col("label1") != "") & (F.col("label2") != ""))
    body = rows.select(F.concat_ws(" ", "label1", "label2").alias("value"), F.col("line_id").alias("k"))
    g = files.read_graph(spark, _file(spark, _with_head(spark, ["% labels", "0 0 0"], body)), "mm")
    e, v = g.edges, g.vertices
    return e.join(v.select(F.col("id").alias("src"), F.col("label").alias("label1")), "src").join(v.select(F.col("id").alias("dst"), F.col("label").alias("label2")), "dst").select("src", "dst", "label1", "label2")


@register("SELECT src, dst, weight, w1 FROM E")
def g_read_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = Cutter(spark, "snapshot").path()
    sinks.write_parquet(coo_graph(spark, d, "weight", "w1"), path)
    return files.read_graph(spark, path, "parquet").edges


@register("SELECT (SELECT max(id) + 1 FROM V) || ' ' || (SELECT max(id) + 1 FROM V) || ' ' || (SELECT count(*) FROM E) AS value UNION ALL SELECT '%%MatrixMarket matrix coordinate pattern general' UNION ALL SELECT (src + 1) || ' ' || (dst + 1) FROM E")
def g_market_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.market_lines(coo_graph(spark, d)).select("value")


@register("SELECT (SELECT max(id) + 1 FROM V) || ' ' || (SELECT count(*) FROM E) || ' 100' AS value UNION ALL SELECT coalesce((SELECT string_agg(CAST(dst + 1 AS VARCHAR), ' ' ORDER BY dst) FROM E WHERE src = id), '') FROM V")
def g_dimacs10_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.dimacs10_lines(coo_graph(spark, d)).select("value")


@register()
def g_peel_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.peel_json(dense.core_edge_peel(coo_graph(spark, d)))


# generators


def _u(key: str, seed: int, n: str) -> str:
    """The generators' hash of a row number."""
    return f"CAST('0x' || substr(md5({key} || '-{seed}'), 1, 15) AS BIGINT) % {n}"


@register(f"SELECT {_u('k', 5, '(SELECT count(*) FROM V)')} AS src, {_u('k', 6, '(SELECT count(*) FROM V)')} AS dst, CAST({_u('k', 7, '101')} AS INT) AS weight FROM range((SELECT count(*) FROM E)) t(k)")
def g_random_edges(spark: SparkSession, d: str) -> DataFrame:
    g = coo_graph(spark, d)
    return generators.random_edges(spark, g.n_vertices(), g.n_edges(), 5, weight=(0, 100))


@register("SELECT src, dst FROM E ORDER BY substr(md5(src || '-' || dst || '-2'), 1, 15), src, dst LIMIT 1000")
def g_sample_edges(spark: SparkSession, d: str) -> DataFrame:
    return generators.sample_edges(coo_graph(spark, d).edges, 1000, 2)


_NUMBERED = "NE AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pos, src, dst FROM E), NV AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, id FROM V)"


@register(f"+{_NUMBERED} SELECT a.id AS src, b.id AS dst FROM range(1000) t(k) JOIN NV a ON a.pos = {_u('k', 2, '(SELECT count(*) FROM V)')} JOIN NV b ON b.pos = {_u('k', 3, '(SELECT count(*) FROM V)')}")
def g_insert_batch(spark: SparkSession, d: str) -> DataFrame:
    return generators.insert_batch(coo_graph(spark, d), 1000, 2)


@register(f"+{_NUMBERED} SELECT a.src, b.id AS dst FROM range(1000) t(k) JOIN NE a ON a.pos = {_u('k', 2, '(SELECT count(*) FROM E)')} JOIN NV b ON b.pos = {_u('k', 3, '(SELECT count(*) FROM V)')}")
def g_insert_batch_weighted(spark: SparkSession, d: str) -> DataFrame:
    return generators.insert_batch(coo_graph(spark, d), 1000, 2, weighted=True)


@register(f"""+{_NUMBERED}, DD AS (SELECT src, count(*) AS n, min(pos) AS start, row_number() OVER (ORDER BY src) - 1 AS i FROM NE GROUP BY src)
SELECT DISTINCT NE.src, NE.dst FROM range(1000) t(k) JOIN DD ON DD.i = {_u('k', 2, '(SELECT count(*) FROM DD)')} JOIN NE ON NE.pos = DD.start + {_u('k', 3, 'DD.n')}""")
def g_erase_batch(spark: SparkSession, d: str) -> DataFrame:
    return generators.erase_batch(coo_graph(spark, d), 1000, 2, unique=True)
