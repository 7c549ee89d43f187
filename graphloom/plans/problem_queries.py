"""Registered queries for hot keys (p1) and unparsable rows (p2), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tree_totals import hubs, vertex_totals
from ..sources.delimited import EDGE, FORMATS, GINFO, load_lines, rejected_lines


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hubs(table(spark, d, "coo_edges")).select("field", "key_value")


def p1_vertex_totals(spark: SparkSession, d: str) -> DataFrame:
    return vertex_totals(table(spark, d, "coo_edges"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected_lines(table(spark, d, "raw_lines")).select("line_id", "reason")


def p2_broken_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = rejected_lines(table(spark, d, "raw_lines"))
    return rows.groupBy("reason", "broken_field").agg(F.count(F.lit(1)).alias("n_lines"))


def p2_edges(spark: SparkSession, d: str) -> DataFrame:
    return load_lines(table(spark, d, "raw_lines"), EDGE, ("line_id", "graph_id"))


def p2_ginfo(spark: SparkSession, d: str) -> DataFrame:
    return load_lines(table(spark, d, "raw_lines"), GINFO, ("line_id", "graph_id"))


QUERIES = {f.__name__: f for f in (p1_found, p1_vertex_totals, p2_found, p2_broken_fields, p2_edges, p2_ginfo)}

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_ANY = f"({_FIELD})"
_INT64 = "([ \\t]*[0-9]+[ \\t]*|\"[0-9]+\")"
_INT32 = "([ \\t]*[+-]?[0-9]+[ \\t]*|\"[+-]?[0-9]+\")"
_WAY = "([ \\t]*(?i:directed|undirected)[ \\t]*|\"(?i:directed|undirected)\")"
_E = f"{_ANY},{_INT64},{_INT64},{_INT32}"
_G = f"{_ANY},{_INT64},{_INT64},{_INT64},{_WAY}"


def _num(regex: str, i: int, kind: str) -> str:
    return f"try_cast(trim(regexp_extract(line_text, '^{regex}$', {i}), ' \"' || chr(9)) AS {kind})"


def _text(regex: str, i: int) -> str:
    raw = f"regexp_extract(line_text, '^{regex}$', {i})"
    return f"CASE WHEN starts_with({raw}, '\"') THEN replace({raw}[2:-2], '\"\"', '\"') ELSE trim({raw}, ' ' || chr(9)) END"


_EDGES = f"""SELECT line_id, graph_id, line_text, {_text(_E, 1)} AS graph_name, {_num(_E, 2, 'BIGINT')} AS index1, {_num(_E, 3, 'BIGINT')} AS index2, {_num(_E, 4, 'INT')} AS weight
FROM raw_lines WHERE line_kind = 'edge' AND regexp_full_match(line_text, '{_E}')"""
_GINFO = f"""SELECT line_id, graph_id, line_text, {_text(_G, 1)} AS graph_name, {_num(_G, 2, 'BIGINT')} AS num_vertices, {_num(_G, 3, 'BIGINT')} AS num_edges, {_num(_G, 4, 'BIGINT')} AS num_lines, lower(trim(regexp_extract(line_text, '^{_G}$', 5), ' "' || chr(9))) AS direction
FROM raw_lines WHERE line_kind = 'ginfo' AND regexp_full_match(line_text, '{_G}')"""
_GOOD_EDGES = f"SELECT * FROM ({_EDGES}) WHERE index1 IS NOT NULL AND index2 IS NOT NULL AND weight IS NOT NULL"
_GOOD_GINFO = f"SELECT * FROM ({_GINFO}) WHERE num_vertices IS NOT NULL AND num_edges IS NOT NULL AND num_lines IS NOT NULL"
_STACKED = """SELECT 'index1' AS field, index1 AS key_value, weight FROM coo_edges WHERE index1 IS NOT NULL
UNION ALL SELECT 'index2', index2, weight FROM coo_edges WHERE index2 IS NOT NULL"""



def _broken(fields: list[tuple[str, str, str | None]]) -> str:
    """The name of the first field with which the line stops being the start of a valid row; fields: (name, pattern, type)."""
    tests = []
    for k in range(1, len(fields) + 1):
        regex = ",".join(f[1] for f in fields[:k])
        end = "(?:,|$)" if k < len(fields) else "$"
        ranges = [f"try_cast(trim(regexp_extract(line_text, '^{regex}{end}', {i}), ' \"' || chr(9)) AS {f[2]}) IS NULL" for i, f in enumerate(fields[:k], 1) if f[2]]
        tests.append(f"WHEN {' OR '.join([f"NOT regexp_matches(line_text, '^{regex}{end}')", *ranges])} THEN '{fields[k - 1][0]}'")
    return f"CASE {' '.join(tests)} END"


_EDGE_FIELDS = [("graph_name", _ANY, None), ("index1", _INT64, "BIGINT"), ("index2", _INT64, "BIGINT"), ("weight", _INT32, "INT")]
_GINFO_FIELDS = [("graph_name", _ANY, None), *((x, _INT64, "BIGINT") for x in ("num_vertices", "num_edges", "num_lines")), ("direction", _WAY, None)]

SQL = {
    "p1_found": f"SELECT field, key_value FROM ({_STACKED}) GROUP BY ALL HAVING count(*) * 100 >= (SELECT count(*) FROM coo_edges)",
    "p1_vertex_totals": f"SELECT field, key_value, count(*) AS n_rows, count(weight) AS n_weighted, CAST(sum(weight) AS BIGINT) AS weight_sum FROM ({_STACKED}) GROUP BY field, key_value",
    "p2_found": f"""SELECT line_id, CASE WHEN NOT regexp_full_match(line_text, '{_FIELD}(?:,{_FIELD})*') THEN 'broken_quoting'
WHEN NOT regexp_full_match(line_text, CASE line_kind WHEN 'edge' THEN '{_FIELD}(?:,{_FIELD}){{3}}' ELSE '{_FIELD}(?:,{_FIELD}){{4}}' END) THEN 'wrong_column_count' ELSE 'invalid_value' END AS reason
FROM raw_lines WHERE line_id NOT IN (SELECT line_id FROM ({_GOOD_EDGES}) UNION ALL SELECT line_id FROM ({_GOOD_GINFO}))""",
    "p2_edges": f"SELECT line_id, graph_id, graph_name, index1, index2, weight FROM ({_GOOD_EDGES})",
    "p2_ginfo": f"SELECT line_id, graph_id, graph_name, num_vertices, num_edges, num_lines, direction FROM ({_GOOD_GINFO})",
}
SQL["p2_broken_fields"] = f"""SELECT reason, broken_field, count(*) AS n_lines FROM (SELECT reason, CASE line_kind WHEN 'edge' THEN {_broken(_EDGE_FIELDS)} ELSE {_broken(_GINFO_FIELDS)} END AS broken_field
FROM ({SQL["p2_found"]}) JOIN raw_lines USING (line_id)) GROUP BY ALL"""
assert {f.kind for f in FORMATS} == {"edge", "ginfo"}
