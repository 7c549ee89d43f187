"""Duplicates hidden by formatting: whitespace, case, punctuation and field order.

Byte-identical texts are collapsed first, with their counts, so that the regular
expressions run once per distinct text; the survivors are brought into canonical
form and grouped again on the full canonical text, summing the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.key_filter import keys_among
from ..operators.skew import HEAVY_ROWS, heavy_threshold, join_counted
from ..plans.loops import Cutter

#: Fixed names of the fields as the exporters write them.
FIELDS = ("graph", "index1", "index2", "direction")
_NEXT = r"(?=index1[0-9]|index2[0-9]|direction(?:un)?directed|graph|\z)"
#: The value that follows each field name in a text without case and punctuation.
PATTERNS = {
    "graph": r"graph((?:(?!index1[0-9]|index2[0-9]|direction(?:un)?directed).)+)",
    "index1": rf"index1([0-9]+){_NEXT}",
    "index2": rf"index2([0-9]+){_NEXT}",
    "direction": rf"direction((?:un)?directed){_NEXT}",
}
#: Between the values of a canonical text; it cannot occur in one.
SEPARATOR = "|"


def bare(text: Column) -> Column:
    """Lower case, without anything that is neither letter nor digit."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", "")


def canonical(text: Column) -> Column:
    """The four values in a fixed order, or the bare text where one is not found.

    An unreadable record so equals only records with the same letters and digits.
    """
    t = bare(text)
    values = {k: F.regexp_extract(t, p, 1) for k, p in PATTERNS.items()}
    readable = values["graph"] != ""
    for k in FIELDS[1:]:
        readable = readable & (values[k] != "")
    return F.when(readable, F.concat_ws(SEPARATOR, *(values[k] for k in FIELDS))).otherwise(t)


def distinct_texts(records: DataFrame, id_col: str = "record_id", text: str = "record_text") -> DataFrame:
    """(record_text, canonical, n, least_id): byte-identical texts collapsed.  Null texts are no case."""
    raw = records.select(F.col(id_col).alias("id"), F.col(text).alias("record_text")).filter("record_text is not null")
    once = raw.groupBy("record_text").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id"))
    return once.withColumn("canonical", canonical(F.col("record_text")))


def distinct_records(records: DataFrame, id_col: str = "record_id", text: str = "record_text") -> DataFrame:
    """One row per distinct record: (canonical, first_id, n_copies, n_spellings).

    n_copies counts all rows of the record, n_spellings its different texts.
    Null texts are left out; an empty text is a record with an empty canonical
    form.  Both aggregates combine on the map side, so a record that holds a third
    of all rows is one row per task when it is shuffled.
    """
    texts = distinct_texts(records, id_col, text)
    return texts.groupBy("canonical").agg(F.min("least_id").alias("first_id"), F.sum("n").alias("n_copies"), F.count(F.lit(1)).alias("n_spellings"))


def copies(records: DataFrame, id_col: str = "record_id", text: str = "record_text", heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(first_id, copy_id) for each row that equals one with a smaller id.

    A text that occurs once is known by its id; only the rows of repeated texts are
    joined with the first id of their record.  Bitmaps of bounded size (see
    :mod:`key_filter`) keep rows without copies out of the shuffles.  Texts with
    ``heavy_rows`` copies or more take a broadcast join of bounded size, so that no
    group of copies comes into one task.  Null ids and texts are no case.
    """
    cutter = Cutter(records.sparkSession, "copies")
    texts = distinct_texts(records.filter(F.col(id_col).isNotNull()), id_col, text)
    once = F.col("n") == 1
    kept = texts.select("canonical", "n", "least_id", F.when(~once, F.col("record_text")).alias("record_text"))
    texts, path, seen = cutter.cut_counting(kept, total=F.sum("n"), most=F.max("n"))
    threshold = heavy_threshold(seen["total"] or 0, heavy_rows)
    groups = texts.groupBy("canonical").agg(F.min("least_id").alias("first_id"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("copies"))
    firsts, firsts_path, wide = cutter.cut_counting(groups.filter("copies > 1").drop("copies"), n=F.count(F.lit(1)), most=F.max("spellings"))
    candidates = keys_among(texts, firsts, "canonical", wide["n"])
    known, _, many = cutter.cut_counting(join_counted(candidates, firsts, "canonical", "spellings", threshold, (wide["most"] or 0) >= threshold).select("n", "least_id", "record_text", "first_id"), n=F.count_if(F.col("n") > 1))
    cutter.drop(path, firsts_path)
    single = known.filter("n = 1 and least_id <> first_id").select("first_id", F.col("least_id").alias("copy_id"))
    repeated = known.filter("n > 1").select("record_text", "n", "first_id")
    rows = records.select(F.col(id_col).alias("copy_id"), F.col(text).alias("record_text")).filter("copy_id is not null")
    found = join_counted(keys_among(rows, repeated, "record_text", many["n"]), repeated, "record_text", "n", threshold, (seen["most"] or 0) >= threshold)
    return found.filter("copy_id <> first_id").select("first_id", "copy_id").unionByName(single)
