"""The bitmap of keys: nothing that belongs is lost, whatever its size."""

import pytest

from graphloom.operators import key_filter


@pytest.mark.parametrize("n_keys", [1, 200, 10**12])
def test_all_keys_pass_and_few_others(spark, n_keys):
    rows = spark.createDataFrame([(f"k{i % 1000}", i) for i in range(3000)] + [(None, -1)], "k string, i int")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 1000, 5)] + [(None,), ("other",)], "k string")
    got = [(r.k, r.i) for r in key_filter.keys_among(rows, keys, "k", n_keys).collect()]
    want = {(f"k{i % 1000}", i) for i in range(3000) if i % 1000 % 5 == 0}
    assert want <= set(got) and len(got) == len(set(got)) and len(got) <= len(want) + 100
    assert (None, -1) not in got


def test_the_bitmap_is_bounded():
    assert key_filter.buckets_for(0) == 1
    assert key_filter.buckets_for(10**15) == key_filter.MAX_BUCKETS


def test_no_keys_and_no_rows(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k bigint")
    assert key_filter.keys_among(rows, rows.limit(0), "k", 0).collect() == []
    assert key_filter.keys_among(rows.limit(0), rows, "k", 2).collect() == []
