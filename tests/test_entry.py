"""The registered queries and their SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Loops of many rounds, which tools/compare.py runs; one of each kind is tested on small graphs elsewhere.
LOOPS = ("g_bfs", "g_sssp", "g_component", "g_strong", "g_page_rank", "g_katz", "g_betweenness", "g_truss", "g_max_truss", "g_core", "g_support", "g_least", "g_stream", "g_windowed", "g_randomize")
NAMES = [n for n in entry.oracle_sql() if n[:2] in ("g_", "p1", "p2") and not n.startswith(LOOPS)]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(NAMES) > 60


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(map(norm, r)) for r in df.collect()) == want
