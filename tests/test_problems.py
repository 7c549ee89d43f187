"""Hot keys and unparsable rows."""

import csv
import io
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators.skew import heavy_threshold, join_counted
from graphloom.operators.tree_totals import hubs, rounds_for, tree_aggregate, vertex_totals
from graphloom.sources import delimited as dl

EDGES = "index1 bigint, index2 bigint, weight int, field string"


def test_rounds():
    assert [rounds_for(n, 8) for n in (0, 1, 8, 9, 64, 65, 800_000)] == [1, 1, 1, 2, 2, 3, 7]
    with pytest.raises(ValueError):
        rounds_for(3, 1)


@pytest.mark.parametrize("fan_in", [2, 3, 100])
def test_totals_over_many_chunks(spark, rows, fan_in):
    data = [(1 if i % 3 else i, None if i % 10 == 0 else i % 4, None if i % 5 == 0 else i - 50, "x") for i in range(300)]
    df = spark.createDataFrame(data, EDGES).repartition(13)
    want = {}
    for a, b, w, _ in data:
        for f, k in (("index1", a), ("index2", b)):
            if k is not None:
                n, m, s = want.get((f, k), (0, 0, None))
                want[f, k] = (n + 1, m + (w is not None), s if w is None else (s or 0) + w)
    got = rows(vertex_totals(df, fan_in=fan_in))
    assert got == sorted(((*k, *v) for k, v in want.items()), key=repr)


def test_totals_of_nothing(spark, rows):
    empty = spark.createDataFrame([], EDGES)
    assert rows(vertex_totals(empty)) == [] and rows(hubs(empty)) == []
    nulls = spark.createDataFrame([(None, None, None, None)] * 3 + [(7, None, None, None)], EDGES)
    assert rows(vertex_totals(nulls)) == [("index1", 7, 1, 0, None)]


def test_hub_share_is_exact(spark, rows):
    data = [(5, None, 1, "")] * 2 + [(None, i, 1, "") for i in range(198)]
    assert rows(hubs(spark.createDataFrame(data, EDGES))) == [("index1", 5, 2)]
    assert rows(hubs(spark.createDataFrame([*data, (None, None, 1, "")], EDGES))) == []


def test_tree_minimum_and_clashes(spark, rows):
    df = spark.range(20).select((F.col("id") % 2).alias("k"), "id")
    assert rows(tree_aggregate(df, ["k"], {"lo": ("min", F.col("id")), "hi": ("max", F.col("id"))}, 2, 16)) == [(0, 0, 18), (1, 1, 19)]
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k"], {"k": ("sum", F.col("id"))})


def test_heavy_keys_join_apart(spark, rows):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), (None, 2)], "k string, v int")
    per = left.dropna(subset=["k"]).groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    assert rows(join_counted(left, per, "k", "n", 10)) == rows(left.join(per.drop("n"), "k"))
    assert heavy_threshold(10**12) >= 10**12 // 20_000


CASES = [
    ("edge", "a,1,2,3", None),
    ("edge", '"a, ""b""\nc", 1 ,"2",\t-3', None),
    ("edge", "a,1,2,+0000002147483647", None),
    ("edge", "a,1,2,-2147483648", None),
    ("edge", "a,1,2,2147483648", "invalid_value"),
    ("edge", "a,1,2,-2147483649", "invalid_value"),
    ("edge", "a,9223372036854775807,2,3", None),
    ("edge", "a,9223372036854775808,2,3", "invalid_value"),
    ("edge", "a,+1,2,3", "invalid_value"),
    ("edge", 'a,1," 2",3', "invalid_value"),
    ("edge", 'a,1, "2",3', "broken_quoting"),
    ("edge", 'a"b,1,2,3', "broken_quoting"),
    ("edge", '"a,1,2,3', "broken_quoting"),
    ("edge", '"a"b,1,2', "broken_quoting"),
    ("edge", "a,1,2", "wrong_column_count"),
    ("edge", "a,1,2,3,", "wrong_column_count"),
    ("edge", "", "wrong_column_count"),
    ("edge", "a,1,,3", "invalid_value"),
    ("edge", "a,1,2,٣", "invalid_value"),
    ("edge", ",1,2,3", None),
    ("ginfo", "a,1,2,3,DirecTed", None),
    ("ginfo", 'a,1,2,3,"undirected"', None),
    ("ginfo", "a,1,2,3,both", "invalid_value"),
    ("ginfo", "a,1,2,3", "wrong_column_count"),
    ("edge", None, "missing_line"),
    (None, "a,1,2,3", "unknown_kind"),
    ("other", "a,1,2,3", "unknown_kind"),
    ("edge", '"' + '""' * 200_000 + '",1,2,3', None),
    ("edge", "x" * 300_000, "wrong_column_count"),
    ("edge", '"' * 100_001 + ",1,2,3", "broken_quoting"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, k, t, "clash") for i, (k, t, _) in enumerate(CASES)], "line_id bigint, line_kind string, line_text string, reason string")
    got = {r.line_id: r.reason for r in dl.classify_lines(df).collect()}
    assert got == {i: r for i, (_, _, r) in enumerate(CASES)}


def test_broken_field(spark):
    lines = ["a,1,2,x", "a,x,2,3", "a,1", "a,1,2,3,4", '"a,1']
    df = spark.createDataFrame([(i, "edge", t) for i, t in enumerate(lines)], "line_id bigint, line_kind string, line_text string")
    got = {r.line_id: r.broken_field for r in dl.rejected_lines(df).collect()}
    assert got == {0: "weight", 1: "index1", 2: "index2", 3: "weight", 4: "graph_name"}


def test_values_are_typed(spark, rows):
    df = spark.createDataFrame([(1, "edge", ' "a' + '"'), (2, "edge", '"x ""y""", 007,"2",-0003'), (3, "ginfo", " g ,1,2,3, UNDIRECTED")], "line_id bigint, line_kind string, line_text string")
    assert rows(dl.load_lines(df, dl.EDGE)) == [(2, 'x "y"', 7, 2, -3)]
    assert rows(dl.load_lines(df, dl.GINFO)) == [(3, "g", 1, 2, 3, "undirected")]
    assert dl.load_lines(df, dl.EDGE).dtypes[-2:] == [("index2", "bigint"), ("weight", "int")]


@given(st.integers(0, 10**12))
@settings(max_examples=60, deadline=None)
def test_number_patterns(limit):
    p = re.compile(dl.digits_up_to(limit))
    for n in (0, limit - 1, limit, limit + 1, limit * 10, limit // 2):
        if n >= 0:
            assert bool(p.fullmatch(str(n))) == (n <= limit) and bool(p.fullmatch("00" + str(n))) == (n <= limit)


def test_quoting_agrees_with_a_csv_writer(spark):
    texts = ["", "a", 'a"b', "a,b", "a\nb", '""', '","', "  x ", 'q"']
    out = io.StringIO()
    data = []
    for i, t in enumerate(texts):
        out.seek(0), out.truncate()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow([t, "1", "2", "3"])
        data.append((i, "edge", out.getvalue()))
    got = {r.line_id: r.graph_name for r in dl.load_lines(spark.createDataFrame(data, "line_id bigint, line_kind string, line_text string"), dl.EDGE).collect()}
    assert got == dict(enumerate(texts))


def test_joins_of_hot_keys_equal_a_plain_join(spark, rows):
    from graphloom.operators import skew

    data = [(i % 3 if i % 2 else 7, i) for i in range(200)] + [(None, 1)]
    df = spark.createDataFrame(data, "k bigint, i int")
    per = spark.createDataFrame([(k, k * 10) for k in (0, 1, 2, 5, 7)], "k bigint, x bigint")
    want = rows(df.join(per, "k"), "k", "i", "x")
    assert rows(skew.join_any(df, per, "k", heavy_rows=20), "k", "i", "x") == want
    assert rows(skew.join_any(df, per, "k"), "k", "i", "x") == want
    counted = per.join(df.groupBy("k").count(), "k")
    assert rows(skew.join_salted(df, counted, ["k"], "count", 20), "k", "i", "x") == want


@pytest.mark.parametrize("hot_rows", [1, 20, 10_000])
def test_hot_keys_take_all_rounds_and_others_leave(spark, rows, hot_rows):
    df = spark.createDataFrame([(None if i % 3 == 0 else 7 if i % 3 == 1 else i % 11, i) for i in range(3000)], "k bigint, v bigint").repartition(40)
    got = tree_aggregate(df, ["k"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("v"))}, 2, 40, hot_rows)
    assert rows(got, "k", "n", "s") == rows(df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")), "k", "n", "s")


def test_chunks_of_a_plan_with_a_shuffle_are_not_run(spark):
    from graphloom.operators.tree_totals import chunks_of

    assert chunks_of(spark.range(10).repartition(3)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert chunks_of(spark.range(0, 10, 1, 5)) == 5
