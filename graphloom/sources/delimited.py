"""Loading of comma-separated lines, with the reason for every line that fails.

A :class:`RowFormat` generates one anchored regular expression for a whole valid
row.  Only rows that fail it go on to the prefix patterns: for ``k`` = 1, 2, ...
an anchored pattern for the first ``k`` fields; the first prefix that does not
match names the broken field.  All of it runs inside the JVM as ``rlike``.

Format of a line: fields separated by commas.  A field may be enclosed whole in
double quotes and may then hold commas, line breaks and doubled quotes; a quote
anywhere else is an error.  Blanks (space, tab) around an unquoted field do not
count.  Quantifiers over quoted text are possessive, which the regex engine runs
as a loop, so that very long fields neither backtrack nor exhaust its stack.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTED = r'"(?:[^"]++|"")*+"'
FIELD = rf'(?:{QUOTED}|[^",]*+)'

BROKEN_QUOTING = "broken_quoting"
WRONG_COLUMN_COUNT = "wrong_column_count"
INVALID_VALUE = "invalid_value"
MISSING_LINE = "missing_line"
UNKNOWN_KIND = "unknown_kind"


def digits_up_to(limit: int) -> str:
    """A pattern for decimal digits, with leading zeros, of at most ``limit``."""
    top = str(limit)
    options = [rf"[0-9]{{1,{len(top) - 1}}}"] if len(top) > 1 else []
    for i, d in enumerate(top):
        if int(d) > 0:
            rest = len(top) - i - 1
            options.append(top[:i] + f"[0-{int(d) - 1}]" + (rf"[0-9]{{{rest}}}" if rest else ""))
    options.append(top)
    return "0*(?:" + "|".join(options) + ")"


@dataclass(frozen=True)
class Field:
    """A field of a row: its name, the pattern of its value and the type it is cast to.

    A pattern of ``None`` accepts any text.
    """

    name: str
    pattern: str | None = None
    cast: str = "string"

    def regex(self, capture: bool = False) -> str:
        if self.pattern is None:
            return f"({FIELD})" if capture else FIELD
        return rf'(?:[ \t]*+(?:{self.pattern})[ \t]*+|"(?:{self.pattern})")' if not capture else rf'([ \t]*+(?:{self.pattern})[ \t]*+|"(?:{self.pattern})")'


def text_field(name: str) -> Field:
    return Field(name)


def count_field(name: str) -> Field:
    """ASCII digits in the range of int64."""
    return Field(name, digits_up_to(2**63 - 1), "bigint")


def int_field(name: str) -> Field:
    """ASCII digits with an optional sign, in the range of int32."""
    return Field(name, rf"\+?{digits_up_to(2**31 - 1)}|-{digits_up_to(2**31)}", "int")


def choice_field(name: str, *values: str) -> Field:
    """One of the values in any case; loaded in lower case."""
    return Field(name, "(?i:" + "|".join(values) + ")", "lower")


@dataclass(frozen=True)
class RowFormat:
    """The fields of one kind of line and the patterns generated from them."""

    kind: str
    fields: tuple[Field, ...]

    def whole(self, capture: bool = False) -> str:
        return r"\A" + ",".join(f.regex(capture) for f in self.fields) + r"\z"

    def prefix(self, k: int) -> str:
        """Matches lines whose first ``k`` fields are valid."""
        end = r"(?:,|\z)" if k < len(self.fields) else r"\z"
        return r"\A" + ",".join(f.regex() for f in self.fields[:k]) + end

    def shape(self) -> str:
        """Matches lines with the right number of fields, whatever their values."""
        return r"\A" + FIELD + rf"(?:,{FIELD}){{{len(self.fields) - 1}}}+\z"

    def first_broken(self, text: Column) -> Column:
        """The 1-based number of the first field whose prefix pattern fails."""
        failing = F.lit(None).cast("int")
        for k in range(len(self.fields), 0, -1):
            failing = F.when(~text.rlike(self.prefix(k)), F.lit(k)).otherwise(failing)
        return failing

    def _raw(self, text: Column) -> list[Column]:
        """The fields of a valid line as they are written.

        One run of the row pattern puts them behind each other, apart by a sign that no
        value with a pattern can hold; a field of any text comes last.
        """
        free = [i for i, f in enumerate(self.fields) if f.pattern is None]
        if len(free) > 1:
            return [F.regexp_extract(text, self.whole(capture=True), i + 1) for i in range(len(self.fields))]
        order = sorted(range(len(self.fields)), key=lambda i: (i in free, i))
        parts = F.split(F.regexp_replace(text, self.whole(capture=True), "\x1f".join(f"${i + 1}" for i in order)), "\x1f", len(order))
        return [F.get(parts, F.lit(order.index(i))) for i in range(len(self.fields))]

    def values(self, text: Column) -> list[Column]:
        """The typed fields of a valid line."""
        out = []
        for f, raw in zip(self.fields, self._raw(text), strict=True):
            quoted = raw.startswith('"')
            inner = F.when(quoted, F.replace(F.substring(raw, 2, F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(F.regexp_replace(raw, r"\A[ \t]+|[ \t]+\z", ""))
            out.append((F.lower(inner) if f.cast == "lower" else inner.cast(f.cast)).alias(f.name))
        return out


#: Matches a line whose quoting is sound from its start to its end.
SOUND = rf"\A{FIELD}(?:,{FIELD})*+\z"

EDGE = RowFormat("edge", (text_field("graph_name"), count_field("index1"), count_field("index2"), int_field("weight")))
GINFO = RowFormat("ginfo", (text_field("graph_name"), count_field("num_vertices"), count_field("num_edges"), count_field("num_lines"), choice_field("direction", "directed", "undirected")))
FORMATS = (EDGE, GINFO)


def classify_lines(df: DataFrame, formats: tuple[RowFormat, ...] = FORMATS, kind: str = "line_kind", text: str = "line_text") -> DataFrame:
    """``df`` with ``reason`` and ``broken_field``, both null for valid lines.

    reason is the first that applies of ``broken_quoting``,
    ``wrong_column_count`` and ``invalid_value``; a null text has
    ``missing_line``, a kind without a format (or a null kind) ``unknown_kind``.
    broken_field names the first field at which the line stops being a prefix of
    a valid row; it is null for the last two reasons.  An empty line is one empty
    field.  Columns of ``df`` named reason or broken_field are replaced.  Repeated
    lines stay repeated.
    """
    line, k = F.col(text), F.col(kind)

    def by_kind(make) -> Column:
        return reduce(lambda rest, f: F.when(k == f.kind, make(f)).otherwise(rest), formats, F.lit(None))

    valid = by_kind(lambda f: line.rlike(f.whole()))
    first_broken = by_kind(lambda f: f.first_broken(line))
    # Quoting and the number of fields concern the whole line and come before any value.
    reason = (
        F.when(line.isNull(), F.lit(MISSING_LINE))
        .when(k.isNull() | ~k.isin(*(f.kind for f in formats)), F.lit(UNKNOWN_KIND))
        .when(valid, F.lit(None).cast("string"))
        .when(~line.rlike(SOUND), F.lit(BROKEN_QUOTING))
        .when(~by_kind(lambda f: line.rlike(f.shape())), F.lit(WRONG_COLUMN_COUNT))
        .when(first_broken.isNotNull(), F.lit(INVALID_VALUE))
    )
    names = by_kind(lambda f: F.get(F.array(*(F.lit(x.name) for x in f.fields)), first_broken - 1))
    broken = F.when(F.col("reason").isin(BROKEN_QUOTING, WRONG_COLUMN_COUNT, INVALID_VALUE), names)
    return df.withColumn("reason", reason).withColumn("broken_field", broken)


def rejected_lines(df: DataFrame, id_col: str = "line_id", **kw) -> DataFrame:
    """(id, reason, broken_field) of each line that fails."""
    return classify_lines(df, **kw).filter(F.col("reason").isNotNull()).select(id_col, "reason", "broken_field")


def load_lines(df: DataFrame, fmt: RowFormat, id_cols: tuple[str, ...] = ("line_id",), kind: str = "line_kind", text: str = "line_text") -> DataFrame:
    """The valid lines of one format as typed rows: ``id_cols`` and the fields.

    Quoted values lose their quotes and doubled quotes become single; unquoted
    values lose the blanks around them.
    """
    good = df.filter((F.col(kind) == fmt.kind) & F.col(text).rlike(fmt.whole()))
    return good.select(*id_cols, *fmt.values(F.col(text)))
