"""Token counts of whole texts with a public byte-level BPE vocabulary.

Counting splits a text at single spaces.  In the tokenizer's pattern a space that
stands alone before something else is always the start of a piece, so the pieces
of a text are those of its space-separated parts, and the count of a part can be
kept in a dictionary.  Texts with two spaces in a row, where a piece may cross a
part, are encoded whole.  The counts equal those of the tokenizer; tests compare
them.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; the first parameter of every function that counts.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts kept per worker before the dictionary starts anew.
KEPT_PARTS = 500_000


class Counter(dict):
    """Maps the part of a text after a space to its number of tokens."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, part: str) -> int:
        n = len(self.encoding.encode_ordinary(" " + part))
        if len(part) <= 64:
            if len(self) >= KEPT_PARTS:
                self.clear()
            self[part] = n
        return n

    def count(self, text: str | None) -> int | None:
        if text is None:
            return None
        if not text:
            return 0
        if "  " in text:
            return len(self.encoding.encode_ordinary(text))
        first, *rest = text.split(" ")
        return len(self.encoding.encode_ordinary(first)) + sum(map(self.__getitem__, rest))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def with_token_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "n_tokens", directory: str = VOCABULARIES, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and the number of tokens of each text; null for a null text, 0 for an empty one.

    Whole texts are counted.  Only ``keep`` and the text are read.
    """
    path = f"{directory}/{vocabulary}"
    taken = df.select(*keep, F.col(text).alias("__text"))
    schema = df.select(*keep, F.lit(None).cast("bigint").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = b.column(len(keep))
            # a few texts at a time become Python strings
            n = pa.array([c.count(t) for i in range(0, b.num_rows, 256) for t in texts.slice(i, 256).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), n], names=[*keep, name])

    return taken.mapInArrow(run, schema)
