"""Several values packed in one field, split into one value per row with its position."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTSIDE, PLAIN, QUOTED, AFTER = range(4)


@dataclass(frozen=True)
class Grammar:
    """What separates, quotes and encloses the values of a field. White space always separates.

    A quote opens only where a value starts; inside it the doubled quote, or ``escape`` and a character, stand for
    themselves. Brackets around the whole field are taken off; delimiters inside other brackets belong to the value.
    ``value`` and ``quoted_value`` are patterns that a value must match whole; other tokens are no values.
    """

    delimiters: str = ",;|/"
    quotes: str = '"'
    brackets: dict[str, str] = field(default_factory=dict)
    escape: str = ""
    value: str | None = None
    quoted_value: str | None = None


def tokens(text: str, g: Grammar) -> Iterator[tuple[str, bool]]:
    """The tokens of a field in order, each with whether it was quoted.

    A quote that is never closed reaches to the end of the field. Text directly after a closing quote starts a new token.
    """
    start, end = 0, len(text)
    while g.brackets:  # brackets around the whole
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if end - start < 2 or g.brackets.get(text[start]) != text[end - 1]:
            break
        start, end = start + 1, end - 1
    closing = set(g.brackets.values())
    state, depth, quote, out = OUTSIDE, 0, "", []
    at = start
    while at < end:
        c = text[at]
        if state == QUOTED:
            if g.escape and c == g.escape and at + 1 < end:
                at += 1
                out.append(text[at])
            elif c == quote:
                if at + 1 < end and text[at + 1] == quote:
                    at += 1
                    out.append(quote)
                else:
                    yield "".join(out), True
                    out, state = [], OUTSIDE
            else:
                out.append(c)
        elif depth == 0 and (c in g.delimiters or c.isspace()):
            if state == PLAIN:
                yield "".join(out), False
                out, state = [], OUTSIDE
        elif state == OUTSIDE and c in g.quotes:
            state, quote = QUOTED, c
        else:
            if g.escape and c == g.escape and at + 1 < end:
                at += 1
                c = text[at]
            elif c in g.brackets:
                depth += 1
            elif c in closing and depth:
                depth -= 1
            out.append(c)
            state = PLAIN
        at += 1
    if state == QUOTED or out:
        yield "".join(out), state == QUOTED


def values(texts: list[str | None], g: Grammar) -> list[str]:
    """All values of the parts of one field in order; null parts have none."""
    plain = re.compile(g.value) if g.value else None
    quoted = re.compile(g.quoted_value or g.value, re.DOTALL) if g.quoted_value or g.value else None
    found = []
    for text in texts:
        if text:
            for token, was_quoted in tokens(text, g):
                pattern = quoted if was_quoted else plain
                if token.strip() and (pattern is None or pattern.fullmatch(token)):
                    found.append(token)
    return found


#: lca: pairs of taxid and count; a quoted one may name its taxon. The mate mark leaves a lone colon, which is no pair.
LCA = Grammar(delimiters=",;|/", value=r"(?:[0-9]+|A):[0-9]+", quoted_value=r".*\S.*:[0-9]+")
#: ranks: codes of a letter and optional digits, in any list notation.
RANKS = Grammar(delimiters=",;|/>-+&:", quotes="\"'", brackets={"[": "]", "{": "}", "(": ")"}, value=r"[A-Za-z][0-9]*")


def split_packed(df: DataFrame, row_id: str, packed: str, grammar: Grammar) -> DataFrame:
    """``row_id``, ``pos`` (int, from 0) and ``val`` of every value of ``packed``, a text or an array of texts.

    Positions run through all elements of an array in order. Null and empty fields and elements give no rows, as does an
    empty table; repeated rows give their values each time, and a null ``row_id`` stays null. Other columns are not read.
    Nothing is shuffled; fields of any length are scanned whole, once.
    """
    kind = df.schema[packed].dataType
    row_kind = df.schema[row_id].dataType
    field_col = F.col(f"`{packed}`") if isinstance(kind, T.ArrayType) else F.array(F.col(f"`{packed}`").cast("string"))
    source = df.filter(F.col(f"`{packed}`").isNotNull()).select(F.col(f"`{row_id}`").alias("row_id"), field_col.alias("parts"))
    schema = T.StructType([T.StructField("row_id", row_kind), T.StructField("pos", T.IntegerType()), T.StructField("val", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, val = [], [], []
            for i, parts in enumerate(batch.column(1).to_pylist()):
                found = values(parts, grammar)
                at += [i] * len(found)
                pos += range(len(found))
                val += found
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int32()), pa.array(val, pa.string())], names=["row_id", "pos", "val"])

    return source.mapInArrow(run, schema)


def packed_ranks(df: DataFrame, row_id: str = "umi_id", ranks: str = "ranks") -> DataFrame:
    """:func:`split_packed` of the rows that have at least one element with more than one rank code.

    The rows are chosen in the scan's own stage; only they reach Python.
    """
    several = F.exists(F.col(f"`{ranks}`"), lambda e: F.regexp_count(e, F.lit(r"(?<![A-Za-z0-9])[A-Za-z][0-9]*(?![A-Za-z0-9])")) > 1)
    return split_packed(df.filter(several), row_id, ranks, RANKS)
