"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import abuse, format_duplicates, link_groups, mixing, packing, tokens, top_items
from ..plans.loops import Cutter


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return link_groups.link_groups(table(spark, d, "vertex_matches"))


def p3_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return link_groups.group_sizes(p3_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.copies(table(spark, d, "edge_records"))


def p4_distinct_records(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.distinct_records(table(spark, d, "edge_records"))


def _top(spark: SparkSession, d: str) -> DataFrame:
    return top_items.top_of_fields({"index1": (table(spark, d, "coo_edges"), "index1"), "label1": (table(spark, d, "label_edges"), "label1")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("field", "item")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d)


def containers(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """The small table of capacities; rows with a null are left out."""
    rows = table(spark, d, "container_sizes").select("container", "capacity_tokens").dropna().limit(packing.MAX_CONTAINERS + 1).collect()
    return sorted((r.container, r.capacity_tokens) for r in rows)


def p6_placements(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.with_token_counts(table(spark, d, "documents")), containers(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_placements(spark, d), containers(spark, d))


def p6_whole(spark: SparkSession, d: str) -> DataFrame:
    """Per container: texts placed, containers filled above capacity, texts split without need or with tokens missing, and whether at most 1 % is unused."""
    sizes = Cutter(spark, "token-counts").cut(tokens.with_token_counts(table(spark, d, "documents")))[0]
    boxes = containers(spark, d)
    return packing.whole_report(packing.pack(sizes, boxes), sizes, boxes)


def targets(spark: SparkSession, d: str) -> list[mixing.Target]:
    """The small table of targets; rows with a null are left out."""
    rows = table(spark, d, "mix_targets").select("source", "target_share", "max_repeats").dropna().limit(mixing.MAX_SOURCES + 1).collect()
    return [mixing.Target(*r) for r in sorted(rows)]


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per document, counted once and kept as a table."""
    return Cutter(spark, "token-counts").cut(tokens.with_token_counts(table(spark, d, "documents"), keep=("doc_id", "source")))[0]


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_counts(spark, d), targets(spark, d))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    counts, goals = _counts(spark, d), targets(spark, d)
    return mixing.mix_report(counts, mixing.mix(counts, goals), goals)


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mix keeps its rules, per source."""
    counts, goals = _counts(spark, d), targets(spark, d)
    return mixing.whole_report(counts, mixing.mix(counts, goals), goals)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abusive_texts(table(spark, d, "documents"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_texts(table(spark, d, "documents"), keep=("doc_id", "source"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates_by_source(p8_scores(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p3_group_sizes, p4_found, p4_distinct_records, p5_found, p5_counts, p6_placements, p6_fill, p6_whole, p7_mix, p7_shares, p7_whole, p8_found, p8_scores, p8_rates)}

_BARE = "regexp_replace(lower(record_text), '[^\\p{L}\\p{Nd}]+', '', 'g')"
# The regular expressions of the database know no lookahead: a value ends where a field name follows.
_CANONICAL = f"""SELECT record_id, record_text, b AS bare,
regexp_extract(b, 'graph(.+?)(?:index1[0-9]|index2[0-9]|direction(?:un)?directed|$)', 1) || '|' || regexp_extract(b, 'index1([0-9]+)(?:graph|index|direction|$)', 1) || '|' ||
regexp_extract(b, 'index2([0-9]+)(?:graph|index|direction|$)', 1) || '|' || regexp_extract(b, 'direction((?:un)?directed)(?:graph|index|$)', 1) AS canonical
FROM (SELECT record_id, record_text, {_BARE} AS b FROM edge_records WHERE record_text IS NOT NULL)"""
_GROUPS = """WITH RECURSIVE e AS (SELECT DISTINCT index1 AS v, index2 AS u FROM vertex_matches WHERE index1 IS NOT NULL AND index2 IS NOT NULL
UNION SELECT DISTINCT index2, index1 FROM vertex_matches WHERE index1 IS NOT NULL AND index2 IS NOT NULL),
r(v, g) USING KEY (v) AS (SELECT v, v FROM (SELECT DISTINCT v FROM e)
UNION SELECT e.u, min(r.g) FROM r JOIN e ON r.v = e.v JOIN recurring.r AS k ON k.v = e.u WHERE r.g < k.g GROUP BY e.u)
SELECT CAST(g AS BIGINT) AS group_id, CAST(v AS BIGINT) AS vertex_id FROM r"""
_TOP = """(SELECT 'index1' AS field, CAST(index1 AS VARCHAR) AS item, count(*) AS n FROM coo_edges WHERE index1 IS NOT NULL GROUP BY index1 ORDER BY n DESC, index1 LIMIT 20)
UNION ALL (SELECT 'label1', label1, count(*) AS n FROM label_edges WHERE label1 IS NOT NULL GROUP BY label1 ORDER BY n DESC, label1 LIMIT 20)"""

SQL = {
    "p3_found": _GROUPS,
    "p3_group_sizes": f"SELECT group_id, count(*) AS n_members FROM ({_GROUPS}) GROUP BY group_id",
    "p4_found": f"SELECT * FROM (SELECT min(record_id) OVER (PARTITION BY canonical) AS first_id, record_id AS copy_id FROM ({_CANONICAL})) WHERE first_id < copy_id",
    "p4_distinct_records": f"SELECT canonical, min(record_id) AS first_id, count(*) AS n_copies, count(DISTINCT record_text) AS n_spellings FROM ({_CANONICAL}) GROUP BY canonical",
    "p5_found": f"SELECT field, item FROM ({_TOP})",
    "p5_counts": _TOP,
    "p7_whole": "SELECT source, true AS within_cap, true AS even, true AS met FROM mix_targets WHERE source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL",
    "p6_whole": "SELECT container, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_texts, 0::BIGINT AS n_overfull, 0::BIGINT AS n_needless_splits, 0::BIGINT AS n_incomplete, true AS tight FROM container_sizes WHERE capacity_tokens IS NOT NULL",
}
