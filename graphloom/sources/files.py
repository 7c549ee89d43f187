"""Readers of graph file formats, as plans over lines of text.

A reader takes lines (value, at), where ``at`` orders them; :func:`read_lines` makes
them of a file.  Only the header of a file (its first lines, found by one aggregate
without a sort) is looked at by the driver; all edges stay in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.ordering import with_index

_BLANKS = r"[\s,]+"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): the lines of a text file with a position that rises along the file."""
    t = spark.read.text(path)
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return t.select("value", at.alias("at"))


class Head:
    """What a driver needs of a file before its edges: found by one aggregate over all lines.

    first: the first line that is not empty; comments: the first two comment lines;
    data: the first line that is none, and ``at`` where it stands.
    """

    def __init__(self, lines: DataFrame, prefix: str):
        v = F.trim("value")
        full, comment = v != "", v.startswith(prefix)
        texts = lines.select(v.alias("v"), "at", full.alias("full"), (full & comment).alias("c"))
        row = texts.agg(
            F.min(F.when(F.col("full"), F.struct("at", "v"))).alias("first"), F.min(F.when(F.col("c"), F.struct("at", "v"))).alias("comment"),
            F.min(F.when(F.col("full") & ~F.col("c"), F.struct("at", "v"))).alias("data"), F.max(F.when(F.col("c") & F.lower("v").contains("undirected"), 1)).alias("undirected"),
        ).first()
        self.first = row.first.v if row.first else None
        self.comment = row.comment.v if row.comment else None
        self.data = row.data.v if row.data else None
        self.data_at = row.data.at if row.data else None
        self.undirected = bool(row.undirected)
        self._comment_at = row.comment.at if row.comment else None
        self._lines, self._prefix = lines, prefix

    def second_comment(self) -> str | None:
        """The comment line after the first one."""
        v = F.trim("value")
        row = self._lines.filter(v.startswith(self._prefix) & (F.col("at") > _place(self._comment_at))).agg(F.min(F.struct("at", v.alias("v"))).alias("x")).first() if self._comment_at is not None else None
        return row.x.v if row and row.x else None


def _place(at) -> Column:
    """A position of :func:`read_lines`, or a plain one, as a literal."""
    return F.struct(*(F.lit(x).alias(k) for k, x in at.asDict().items())) if hasattr(at, "asDict") else F.lit(at)


def _numbers(lines: DataFrame, comment: str, columns: list[str], offset: int, kinds: dict[str, str] | None = None) -> DataFrame:
    """Rows of white-space or comma separated numbers; ids are shifted by ``offset``."""
    v = F.trim("value")
    parts = F.split(v, _BLANKS)
    cols: list[Column] = []
    for i, c in enumerate(columns):
        x = F.get(parts, F.lit(i)).cast((kinds or {}).get(c, "bigint"))
        cols.append((x + offset if c in ("src", "dst") else x).alias(c))
    return lines.filter((v != "") & ~v.startswith(comment)).select("at", *cols)


def _graph(edges: DataFrame, n: int | None, directed: bool, ids: DataFrame | None = None) -> Graph:
    """Vertices 0 .. n-1 (at least all ids seen); both directions if undirected."""
    e = edges.drop("at").filter("src is not null and dst is not null")
    if ids is None:
        top = e.agg(F.max(F.greatest("src", "dst"))).first()[0]
        ids = e.sparkSession.range(max(n or 0, (top if top is not None else -1) + 1))
    g = Graph(ids, e)
    return g if directed else g.symmetrize()


def _by_appearance(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with labels (a, b, ...) -> dense ids in the order of first appearance, a before b in a line."""
    rest = [c for c in edges.columns if c not in ("at", "a", "b")]
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.struct("at", F.lit(0).alias("k")).alias("p")), F.struct(F.col("b").alias("label"), F.struct("at", F.lit(1).alias("k")).alias("p")))).alias("e")).select("e.*")
    first = ends.filter("label is not null").groupBy("label").agg(F.min("p").alias("p"))
    ids = with_index(first, [F.col("p")], "id").select("id", "label")
    e = edges.join(ids.select(F.col("label").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("label").alias("b"), F.col("id").alias("dst")), "b")
    return e.select("at", "src", "dst", *rest), ids


def parse_mtx(lines: DataFrame, weight: str | None = None, directed: bool | None = None) -> Graph:
    """MatrixMarket coordinate file: 1-based; ``symmetric`` means undirected.  weight: type of a third column."""
    head = Head(lines, "%")
    if not head.first or not head.first.lower().startswith("%%matrixmarket"):
        raise ValueError("no MatrixMarket header")
    words = head.first.lower().split()
    if "array" in words:
        raise ValueError("dense matrices are not supported")
    if head.data is None:
        raise ValueError("no size line")
    rows, cols = (int(x) for x in head.data.split()[:2])
    body = _numbers(lines, "%", ["src", "dst", *(["weight"] if weight else [])], -1, {"weight": weight} if weight else None)
    body = body.filter(F.col("at") > _place(head.data_at))
    return _graph(body, max(rows, cols), directed if directed is not None else "symmetric" not in words)


def parse_mm(lines: DataFrame, directed: bool = True, header: bool = True) -> Graph:
    """Market file with string labels: dense ids by first appearance; vertices(id, label)."""
    v = F.trim("value")
    rows = lines.filter((v != "") & ~v.startswith("%"))
    if header:
        rows = rows.filter(F.col("at") > rows.agg(F.min("at")).scalar())
    parts = F.split(v, r"\s+")
    e, ids = _by_appearance(rows.select("at", F.get(parts, F.lit(0)).alias("a"), F.get(parts, F.lit(1)).alias("b")))
    return _graph(e, None, directed, ids)


def parse_metis(lines: DataFrame) -> Graph:
    """Adjacency lines after a size line; line i has the 1-based neighbours of vertex i.

    A flag 0 or 100 in the size line means directed; without a flag the file is
    undirected and lists both directions already.  Weighted files (flag 1) are an
    error.  Empty lines are vertices without neighbours; lines that start with % are
    comments.
    """
    rows = lines.filter(~F.trim("value").startswith("%"))
    head = rows.agg(F.min(F.struct("at", "value")).alias("x")).first().x
    if head is None:
        raise ValueError("no size line")
    size = head.value.split()
    if len(size) > 2 and size[2] not in ("0", "100"):
        raise ValueError("weighted adjacency files are not supported")
    n = int(size[0])
    numbered = with_index(rows, [F.col("at")], "line")
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    e = numbered.filter((F.col("line") > 0) & (F.col("line") <= n)).select("at", (F.col("line") - 1).alias("src"), F.explode(parts).alias("d"))
    return _graph(e.select("at", "src", (F.col("d").cast("bigint") - 1).alias("dst")), n, True)


def parse_gr(lines: DataFrame, directed: bool = True) -> Graph:
    """Road networks: ``a u v w`` lines, 1-based, with weights."""
    v = F.trim("value")
    size = lines.filter(v.startswith("p ")).limit(1).collect()
    parts = F.split(v, r"\s+")
    e = lines.filter(v.startswith("a ")).select("at", (F.get(parts, F.lit(1)).cast("bigint") - 1).alias("src"), (F.get(parts, F.lit(2)).cast("bigint") - 1).alias("dst"), F.get(parts, F.lit(3)).cast("bigint").alias("weight"))
    return _graph(e, int(size[0].value.split()[2]) if size else None, directed)


def parse_snap(lines: DataFrame, weight: str | None = None, directed: bool | None = None) -> Graph:
    """``#`` comments, then raw ids that become dense by first appearance; vertices(id, label)."""
    if directed is None:
        directed = not Head(lines, "#").undirected
    e = _numbers(lines, "#", ["a", "b", *(["weight"] if weight else [])], 0, {"weight": weight} if weight else None)
    e, ids = _by_appearance(e)
    return _graph(e, None, directed, ids)


def parse_konect(lines: DataFrame, directed: bool | None = None) -> Graph:
    """``%`` comments: ``asym`` or ``bip`` means directed; a second line has E, n1, n2; 1-based edges."""
    head = Head(lines, "%")
    words = head.comment.lstrip("% ").lower().split() if head.comment else []
    if directed is None:
        directed = bool({"asym", "bip"} & set(words))
    size = [int(x) for x in (head.second_comment() or "").lstrip("% ").split() if x.isdigit()]
    return _graph(_numbers(lines, "%", ["src", "dst"], -1), max(size[1:3], default=None) if size else None, directed)


def parse_edges(lines: DataFrame, directed: bool | None = None) -> Graph:
    """``u,v`` or ``u v`` per line, 1-based; the first comment says whether it is directed."""
    if directed is None:
        directed = "directed" in (Head(lines, "%").comment or "").lower().split()
    return _graph(_numbers(lines, "%", ["src", "dst"], -1), None, directed)


READERS = {"mtx": parse_mtx, "mm": parse_mm, "graph": parse_metis, "gr": parse_gr, "snap": parse_snap, "konect": parse_konect, "edges": parse_edges}


def format_of(path: str, first: str) -> str:
    """The format, from the name of the file and its first token."""
    name = path.rstrip("/").split("/")[-1].lower()
    suffix = name.rsplit(".", 1)[-1]
    if name.startswith("out."):
        return "konect"
    if suffix in ("mtx", "mm", "graph", "gr", "edges"):
        return suffix
    if suffix == "snap" or first.startswith("#"):
        return "snap"
    if first.lower().startswith("%%matrixmarket"):
        return "mtx"
    raise ValueError(f"unknown graph format: {path}")


def read_graph(spark: SparkSession, path: str, fmt: str | None = None, directed: bool | None = None, randomize_ids: int | None = None, sort_adj: bool = False, **options) -> Graph:
    """Read a graph file.

    directed overrules what the file says: an undirected file read as directed keeps
    its lines as they are.  randomize_ids: seed of a permutation of the ids.
    """
    if fmt == "parquet" or fmt is None and path.rstrip("/").endswith(".parquet"):
        return read_parquet(spark, path)
    lines = read_lines(spark, path)
    if fmt is None:
        first = lines.agg(F.min(F.struct("at", "value")).alias("x")).first().x
        fmt = format_of(path, first.value if first else "")
    if directed is not None:
        options["directed"] = directed
    g = READERS[fmt](lines, **options)
    if randomize_ids is not None:
        g = g.randomize_ids(randomize_ids)
    return Graph(g.vertices, g.edges.orderBy("src", "dst")) if sort_adj else g


def read_parquet(spark: SparkSession, path: str) -> Graph:
    """A snapshot written by :func:`sinks.write_parquet`."""
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))
