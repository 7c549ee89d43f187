"""The training-data operators against brute force and in edge cases."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import abuse, format_duplicates, link_groups, mixing, packing, tokens, top_items
from graphloom.llm.automaton import Neighbourhood, Trie, terms_within

sys.path.insert(0, str(Path(__file__).parent))
from abuse_held_out import HELD_OUT, HELD_OUT_2  # noqa: E402

SF = "/root/testdata/sf0.001"
TOKENIZER = f"{tokens.VOCABULARIES}/{tokens.VOCABULARY}"


# groups


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return sorted((root(x), x) for x in parent)


@pytest.mark.parametrize("heavy", [2, 100_000])
def test_groups_equal_union_find(spark, rows, heavy):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(200, 230)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(500, 500), (120, 100)]
    df = spark.createDataFrame([*pairs, (None, 7), (8, None), (None, None)], "index1 bigint, index2 bigint")
    assert rows(link_groups.link_groups(df, heavy_rows=heavy)) == union_find(pairs)


def test_groups_of_nothing(spark, rows):
    empty = spark.createDataFrame([], "index1 bigint, index2 bigint, group_id string")
    assert rows(link_groups.link_groups(empty)) == []
    one = spark.createDataFrame([(3, 3, "x"), (3, 3, None)], "index1 bigint, index2 bigint, group_id string")
    assert rows(link_groups.link_groups(one)) == [(3, 3)]
    assert rows(link_groups.group_sizes(link_groups.link_groups(one))) == [(3, 1)]


# duplicates


def test_formatting_does_not_count(spark, rows):
    data = [
        (1, "graph=Alder Weir abcde; index1=12; index2=7; direction=directed"),
        (2, '{"DIRECTION": "<directed>", "Index-2": "7", "graph": "ALDER-weir ABCDE", "index_1": "1 2"}'),
        (3, "graph=Alder Weir abcde; index1=7; index2=12; direction=directed"),
        (4, "graph=Alder Weir abcde; index1=12; index2=7; direction=un-directed"),
        (5, "graph=Alder Weir abcde; index1=12; index2=7; direction=directed"),
        (6, None),
        (7, None),
        (8, ""),
        (9, " ; "),
        (10, "nothing to read"),
        (11, "graph=Alder Weir abcde; index1=1; index2=27; direction=directed"),
    ]
    df = spark.createDataFrame([(*r, 1, "c") for r in data], "record_id bigint, record_text string, first_id int, canonical string")
    for heavy in (2, 100_000):
        assert rows(format_duplicates.copies(df, heavy_rows=heavy)) == [(1, 2), (1, 5), (8, 9)]
    got = {r.first_id: (r.n_copies, r.n_spellings) for r in format_duplicates.distinct_records(df).collect()}
    assert got == {1: (3, 2), 3: (1, 1), 4: (1, 1), 8: (2, 2), 10: (1, 1), 11: (1, 1)}
    assert rows(format_duplicates.copies(df.limit(0))) == []


# top items


def test_top_items(spark, rows):
    df = spark.createDataFrame([(x,) for x in "aaaabbbccd"] + [(None,)] * 9, "v string")
    assert [tuple(r) for r in top_items.top_items(df, "v", 3).collect()] == [("a", 4), ("b", 3), ("c", 2)]
    assert rows(top_items.top_items(df.limit(0), "v")) == []
    ties = spark.createDataFrame([(x,) for x in (3, 1, 2)], "n bigint")
    assert [r.n for r in top_items.top_items(ties, "n", 2, name="m").collect()] == [1, 1]
    assert rows(top_items.top_of_fields({"x": (ties, "n")}, 1)) == [("x", "1", 1)]


# tokens


@given(st.text(alphabet=st.sampled_from(list("ab1 .,'\n\té🙂")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_counts_equal_the_tokenizer(text):
    c = tokens.counter(TOKENIZER)
    assert c.count(text) == len(c.encoding.encode_ordinary(text))


def test_counts_of_nulls_and_documents(spark):
    c = tokens.counter(TOKENIZER)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in tokens.with_token_counts(docs).join(docs, "doc_id").collect():
        assert r.n_tokens == len(c.encoding.encode_ordinary(r.text))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 100_000)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.with_token_counts(df).collect()} == {1: None, 2: 0, 3: 100_001}


# packing


def check_packing(placed, sizes, containers):
    rows = placed.collect()
    for c, cap in containers:
        bins, docs = {}, {}
        for r in rows:
            if r.container == c:
                bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_tokens
                docs.setdefault(r.doc_id, []).append((r.piece_no, r.start_token, r.n_tokens))
        assert all(b <= cap for b in bins.values())
        assert {k: sum(x[2] for x in v) for k, v in docs.items()} == {k: v for k, v in sizes.items() if v is not None}
        for v in docs.values():
            assert len(v) == 1 or sum(x[2] for x in v) > cap
            assert [x[1] for x in sorted(v)] == [i * cap for i in range(len(v))]
        total = sum(v for v in sizes.values() if v)
        yield len(bins), -(-total // cap)


@pytest.mark.parametrize("per_sweep", [7, 100, 400_000])
def test_packing_is_complete_and_tight(spark, per_sweep):
    rng = random.Random(per_sweep)
    sizes = {i: rng.choice([0, rng.randrange(1, 60), rng.randrange(1, 400), 100, 33]) for i in range(200)}
    sizes |= {1000: None, 1001: 100, 1002: 700, 1003: 200}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    boxes = [("a", 100), ("b", 512)]
    for n, least in check_packing(packing.pack(df, boxes, rows_per_sweep=per_sweep), sizes, boxes):
        assert n <= least * 1.12 + 2


def test_placements_do_not_depend_on_partitions(spark, rows):
    rng = random.Random(5)
    data = [(i, rng.choice([rng.randrange(1, 90), 50, 50, 7])) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint")
    got = [rows(packing.pack(df.repartition(n), [("a", 100)], rows_per_sweep=20)) for n in (1, 7)]
    assert got[0] == got[1]


def test_ranges_are_bounded_and_ordered(spark):
    data = [("a", packing.ITEM, 50, i, 0, 0) for i in range(500)] + [("a", packing.ITEM, i % 40 + 1, 1000 + i, 0, 0) for i in range(300)] + [("a", packing.GAP, 50, 2000 + i, 0, 0) for i in range(30)]
    state = spark.createDataFrame(data, "container string, kind int, size int, id bigint, piece int, fresh int")
    for most in (2, packing.MAX_SIZES + 1):
        r = packing.ranged(state, len(data), most, 50).groupBy("part").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi")).orderBy("part").collect()
        assert sum(x.n for x in r) == len(data) and max(x.n for x in r) <= 100 and len(r) >= 12
        assert all(a.lo >= b.hi for a, b in zip(r, r[1:], strict=False))


def test_packing_of_little(spark, rows):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, None)], "doc_id bigint, n_tokens bigint")
    assert rows(packing.pack(df, [("a", 10)])) == [("a", "bin-1-0", 1, 0, 0, 0), ("a", "bin-1-0", 2, 0, 0, 0)]
    assert rows(packing.pack(df.limit(0), [("a", 10)])) == []
    same = spark.createDataFrame([(i, 5) for i in range(41)], "doc_id bigint, n_tokens bigint")
    placed = packing.pack(same, [("a", 10)], rows_per_sweep=6)
    assert placed.select("bin_id").distinct().count() == 21
    report = packing.fill_report(placed, [("a", 10)]).first()
    assert (report.n_bins, report.least_bins, report.n_tokens) == (21, 21, 205)
    for bad in ([("a", 0)], [("a", 1), ("a", 2)]):
        with pytest.raises(ValueError):
            packing.pack(same, bad)


@given(st.lists(st.tuples(st.integers(1, 50), st.booleans()), max_size=60))
@settings(max_examples=200, deadline=None)
def test_sweep_leaves_no_item_that_fits(rows):
    rows.sort(key=lambda r: (-r[0], r[1]))
    sizes, item = np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], bool)
    placed, left = packing.best_fit_sweep(sizes, item)
    used = {}
    for i, g in placed.items():
        assert item[i] and not item[g]
        used[g] = used.get(g, 0) + sizes[i]
    assert left == {g: sizes[g] - used.get(g, 0) for g in range(len(rows)) if not item[g]}
    assert all(v >= 0 for v in left.values())
    waiting = [sizes[i] for i in range(len(rows)) if item[i] and i not in placed]
    assert not waiting or min(waiting) > max(left.values(), default=0)


def test_leftovers_match_without_conflict():
    pairs = packing.match_leftovers([(0, 3, 2), (1, 1, 2), (2, 5, 1)])
    assert pairs == [(0, 0, 1, 0, 1), (1, 0, 2, 0, 2), (0, 1, 2, 2, 1)]


# mixing


def test_water_filling():
    t = [mixing.Target("a", 0.5, 1), mixing.Target("b", 0.3, 4), mixing.Target("c", 0.2, 2), mixing.Target("none", 0.1, 3)]
    e = mixing.water_fill({"a": 100, "b": 100, "c": 100}, t)
    assert e["a"] == 1 and e["none"] == 0
    assert e["b"] / e["c"] == pytest.approx(1.5) and 100 * sum(e.values()) == pytest.approx(300)
    assert mixing.water_fill({"a": 10}, [mixing.Target("a", 1, 2)], 1000) == {"a": 2}
    assert mixing.water_fill({}, [mixing.Target("a", 1, 2)]) == {"a": 0}


def test_mix_reaches_its_shares(spark):
    data = [(i, "big" if i % 3 else "small", 1 + i % 17) for i in range(3000)] + [(5000, None, 9), (5001, "other", 9), (5002, "big", None), (5003, "small", 0)]
    df = spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint")
    t = [mixing.Target("big", 0.3, 1), mixing.Target("small", 0.6, 2), mixing.Target("gone", 0.1, 2)]
    m = mixing.mix(df, t, seed=1)
    got = {r.source: r for r in mixing.mix_report(df, m, t).collect()}
    assert got["gone"].mixed_tokens == 0 and got["gone"].actual_share == 0
    assert got["small"].actual_share == pytest.approx(2 / 3, abs=0.01)
    assert m.agg(F.max("copies")).first()[0] <= 2
    assert {r.source for r in m.select("source").distinct().collect()} == {"big", "small"}
    again = mixing.mix(df.repartition(7), t, seed=1)
    assert m.exceptAll(again).isEmpty() and not m.exceptAll(mixing.mix(df, t, seed=2)).isEmpty()
    assert mixing.mix(df.limit(0), t).count() == 0
    assert mixing.mix_report(df.limit(0), mixing.mix(df.limit(0), t), t).count() == 3
    with pytest.raises(ValueError):
        mixing.mix(df, [t[0], t[0]])


def test_no_record_is_used_above_the_cap(spark):
    data = [(i, "a", 0) for i in range(300)] + [(1000 + i, "a", 5) for i in range(50)] + [(2000 + i, "b", 7) for i in range(400)] + [(3000, "none", 5), (3001, "none", 0)]
    df = spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint")
    t = [mixing.Target("a", 0.9, 2), mixing.Target("b", 0.1, 9), mixing.Target("none", 0.0, 0)]
    m = mixing.mix(df, t, total=2000)
    copies = {(r.source, r.copies) for r in m.select("source", "copies").distinct().collect()}
    assert {c for s, c in copies if s == "a"} == {2} and "none" not in {s for s, _ in copies}
    assert {(r.within_cap, r.even, r.met) for r in mixing.whole_report(df, m, t).collect()} == {(True, True, True)}


def test_mix_of_ten_thousand_sources(spark):
    n = mixing.MAX_SOURCES
    df = spark.range(3 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % n).alias("source"), (F.col("id") % 7 + 1).alias("n_tokens"))
    t = [mixing.Target(f"s{i}", 1 / n, 1 + i % 3) for i in range(n)]
    m = mixing.mix(df, t)
    r = m.join(spark.createDataFrame([(x.source, x.max_repeats) for x in t], "source string, cap int"), "source").agg(F.count_if(F.col("copies") > F.col("cap")).alias("bad"), F.count_distinct("source").alias("n")).first()
    assert r.bad == 0 and r.n > 0.9 * n
    with pytest.raises(ValueError):
        mixing.mix(df, [*t, mixing.Target("more", 0.1, 1)])


# abuse


def edits(a, b):
    """Least insertions, deletions, changes and swaps of neighbours, none inside a swap."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_brute_force():
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(80)})
    trie = Trie(terms)
    for _ in range(150):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 7)))
        for k in (0, 1, 2):
            near = sorted((edits(w, t), t) for t in terms if edits(w, t) <= k)
            assert terms_within(trie, w, k) == near
            if near:
                assert Neighbourhood(terms, k).may_hold(w)


@pytest.mark.parametrize(
    "written, term",
    [("sсumbаg", "scumbag"), ("m*therf*cker", "motherfucker"), ("$cumb4g", "scumbag"), ("1mb3c1le", "imbecile"), ("whhhhhore", "whore"), ("baStaRD", "bastard"), ("cré­tin", "cretin"), ("s.l.u.t", "slut"), ("disgustiing", "disgusting"), ("Ungеzіеfеr", "ungeziefer"), ("Bastrad", "bastard"), ("VOLLIDOIT", "vollidiot"), ("Hurensonh", "hurensohn"), ("Dorftrottel", "trottel"), ("motherfukcer", "motherfucker")],
)
def test_hidden_words_are_restored(written, term):
    assert abuse.lexicon().restore(written) == term


@pytest.mark.parametrize("word", ["Penter", "parties", "Cockburne", "Shitterley", "2009-LT-00000002", "61,246", "banker", "notice", "Karten", "bitte", "Massachusetts", "where", "shore", "crowns", "x" * 5000, "*" * 5000])
def test_ordinary_words_stay(word):
    assert not abuse.lexicon().restore(word) in abuse.lexicon().terms


def test_labelled_samples(spark):
    rows = abuse.score_texts(spark.read.parquet(f"{SF}/review_samples.parquet"), keep=("sample_id", "lang")).join(spark.read.parquet(f"{SF}/review_samples.parquet").withColumnRenamed("category", "label"), "sample_id").collect()
    wrong = [r.sample_id for r in rows if (r.category if r.score >= abuse.THRESHOLD else "none") != r.label]
    assert len(wrong) <= 0.02 * len(rows)


@pytest.mark.parametrize("sentences", [HELD_OUT, HELD_OUT_2])
def test_held_out_sentences(sentences):
    flagged = [(c, abuse.lexicon().score(t)[0] >= abuse.THRESHOLD) for c, t in sentences]
    true = sum(hit for c, hit in flagged if c != "none")
    assert true >= 0.9 * sum(c != "none" for c, _ in sentences)
    assert true >= 0.9 * sum(hit for _, hit in flagged)


@pytest.mark.parametrize(
    "text, case",
    [("you s t u p i d  f o o l, you are a d i r t b a g", True), ("only a worth-\nless cock-\nroach would sign", True), ("The bastard file and the rasp.", False), ("A pack ass strayed.", False), ("x " * 50_000 + "you filthy cretin", True), ("", False), ("   \n", False), ("*** ### $$$ ---", False)],
)
def test_texts(text, case):
    assert (abuse.lexicon().score(text)[0] >= abuse.THRESHOLD) is case


def test_quotation_is_told_from_direct_use():
    q = abuse.lexicon().score('The voicemail was played ("you miserable idiot") and not disputed.')
    d = abuse.lexicon().score("you miserable idiot")
    assert q[2] > 0 == q[1] and d[1] > 0 == d[2]


def test_scores_of_nulls_and_clashes(spark, rows):
    df = spark.createDataFrame([(1, None, None), (2, "you idiot", "s"), (2, "you idiot", "s"), (3, "", None)], "doc_id bigint, text string, source string")
    assert rows(abuse.abusive_texts(df)) == [(2,), (2,)]
    rates = {r.source: (r.n_texts, r.n_flagged, r.rate, r.n_direct, r.n_quoted) for r in abuse.rates_by_source(abuse.score_texts(df, keep=("doc_id", "source"))).collect()}
    assert rates == {None: (2, 0, 0.0, 0, 0), "s": (2, 2, 1.0, 2, 0)}
    assert rows(abuse.abusive_texts(df.limit(0))) == []
    with pytest.raises(ValueError):
        abuse.score_texts(df.withColumn("score", F.lit(1)), keep=("doc_id", "score"))


def test_queries_equal_sql(spark, rows):
    import duckdb

    from graphloom.llm import queries

    db = duckdb.connect()
    for t in "vertex_matches edge_records coo_edges label_edges documents container_sizes mix_targets".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, SF)
        cur = db.execute(sql)
        names = [c[0] for c in cur.description]
        assert rows(df) == sorted((tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr), name


@pytest.mark.parametrize("name", ["p6_fill", "p7_shares", "p8_rates"])
def test_reports(spark, name):
    from graphloom.llm import queries

    assert queries.QUERIES[name](spark, SF).count() > 0
