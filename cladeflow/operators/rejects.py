"""Report lines into typed rows, with every line that fails kept apart together with its reason.

Each record is assembled quote-aware, parsed by the strict ``csv`` reader inside the partition's batches, and only
when its structure is sound handed to the typed field constructors.
"""

from __future__ import annotations

import csv
import math
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a report line, with and without the minimizer columns.
COLUMNS_8 = ("percents", "total_reads", "reads", "minimizer_len", "minimizer_n_unique", "rank", "taxid", "name")
COLUMNS_6 = ("percents", "total_reads", "reads", "rank", "taxid", "name")

FIELDS = T.StructType(
    [
        T.StructField("percents", T.DoubleType()),
        T.StructField("total_reads", T.LongType()),
        T.StructField("reads", T.LongType()),
        T.StructField("minimizer_len", T.LongType()),
        T.StructField("minimizer_n_unique", T.LongType()),
        T.StructField("rank", T.StringType()),
        T.StructField("taxid", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)
_ARROW = {"percents": pa.float64(), "rank": pa.string(), "taxid": pa.string(), "name": pa.string()}

_BLANK = " \t\n\r\x0b\x0c"
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_COUNT = re.compile(r"\+?[0-9]+")
_RANK = re.compile(r"[URDKPCOFGS][0-9]*")
_TAXID = re.compile(r"[0-9]+")
_OPENS = re.compile(r' *(?=")')
_QUOTED = re.compile(r'"(?:[^"]|"")*"')
_PLAIN = re.compile(r"[^\t]*")
_SPACES = re.compile(r" *")
# Line ends inside a record would end it for the csv reader; they stand aside while it runs.
_ASIDE, _BACK = str.maketrans("\r\n", "\ufdd0\ufdd1"), str.maketrans("\ufdd0\ufdd1", "\r\n")
_BIGGEST = 2**63 - 1


class FieldError(ValueError):
    """A field whose text is not of its column's type; the message is the reason."""


def assemble(line: str) -> str:
    """The record of one line: no final line end, and no spaces outside the quotes of quoted columns."""
    if line.endswith("\n"):
        line = line[:-1]
    if line.endswith("\r"):
        line = line[:-1]
    if '"' not in line:
        return line
    columns, at, end = [], 0, len(line)
    while True:
        opens = _OPENS.match(line, at)
        closed = _QUOTED.match(line, opens.end()) if opens else None
        if closed:
            after = _SPACES.match(line, closed.end()).end()
            sound = after == end or line[after] == "\t"
            tail = "" if sound else _PLAIN.match(line, closed.end()).group()
            columns.append(closed.group() + tail)
            at = after if sound else closed.end() + len(tail)
        elif opens:  # never closed: the rest of the line belongs to it, and the reader will say so
            columns.append(line[opens.end() :])
            at = end
        else:
            columns.append(_PLAIN.match(line, at).group())
            at += len(columns[-1])
        if at >= end:
            return "\t".join(columns)
        at += 1  # the tab; a tab at the very end opens one more, empty column
        if at == end:
            columns.append("")
            return "\t".join(columns)


def _percents(text: str) -> float:
    text = text.strip(_BLANK)
    if not _DECIMAL.fullmatch(text):
        raise FieldError("percents_not_a_number")
    value = float(text)
    if not math.isfinite(value) or not 0 <= value <= 100:
        raise FieldError("percents_out_of_range")
    return value


def _count(column: str, text: str) -> int:
    text = text.strip(_BLANK)
    if not _COUNT.fullmatch(text):
        raise FieldError(f"{column}_not_a_count")
    digits = text.lstrip("+0")
    if len(digits) > 19 or int(digits or "0") > _BIGGEST:
        raise FieldError(f"{column}_too_large")
    return int(digits or "0")


def typed(columns: list[str]) -> dict[str, object]:
    """The typed row of 6 or 8 columns, or a FieldError with the first reason in column order."""
    names = COLUMNS_8 if len(columns) == 8 else COLUMNS_6
    row: dict[str, object] = dict.fromkeys(COLUMNS_8)
    for name, text in zip(names, columns):
        if name == "percents":
            row[name] = _percents(text)
        elif name == "rank":
            if not _RANK.fullmatch(text):
                raise FieldError("rank_unknown")
            row[name] = text
        elif name == "taxid":
            if not _TAXID.fullmatch(text):
                raise FieldError("taxid_not_digits")
            row[name] = text
        elif name == "name":
            if not text.strip():
                raise FieldError("name_blank")
            row[name] = text
        else:
            row[name] = _count(name, text)
    if row["reads"] > row["total_reads"]:
        raise FieldError("reads_above_total_reads")
    return row


def parse_line(line: str | None) -> tuple[dict[str, object] | None, str | None] | None:
    """``(row, None)`` of a valid line, ``(None, reason)`` of one that fails, None of a null or blank line."""
    if line is None or not line.strip():
        return None
    try:
        record = assemble(line).translate(_ASIDE)
        columns = next(csv.reader([record], delimiter="\t", quotechar='"', doublequote=True, strict=True))
    except csv.Error as error:
        return None, "quote_not_closed" if "end of data" in str(error) else "text_after_quote"
    if len(columns) not in (6, 8):
        return None, "column_count"
    try:
        return typed([x.translate(_BACK) for x in columns]), None
    except FieldError as error:
        return None, str(error)


def parse_report_lines(lines: DataFrame, text_col: str = "line", keep: list[str] | None = None) -> DataFrame:
    """Every line that is not blank, once, with ``reason`` null and typed report fields, or a reason and null fields.

    The columns ``keep`` (all but ``text_col`` if None) come first, as they were; one whose name is that of a report
    field, ``reason`` or ``raw`` is renamed to ``in_<name>``. ``raw`` holds the text of a failing line, null otherwise.
    Null lines and lines of white space give no row, an empty table no rows, a repeated line one row each time. Lines of
    any length are parsed whole. Nothing is shuffled.
    """
    keep = [c for c in lines.columns if c != text_col] if keep is None else keep
    taken = {f.name for f in FIELDS} | {"reason", "raw"}
    out_names = [f"in_{c}" if c in taken else c for c in keep]
    source = lines.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, out_names)], F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType(
        [*(T.StructField(f.name, f.dataType) for f in source.schema if f.name != "__text"), *FIELDS.fields]
        + [T.StructField("reason", T.StringType()), T.StructField("raw", T.StringType())]
    )
    fields = [f.name for f in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            at, rows, reasons, raw = [], [], [], []
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for i, text in enumerate(texts):
                parsed = parse_line(text)
                if parsed is None:
                    continue
                row, reason = parsed
                at.append(i)
                rows.append(row)
                reasons.append(reason)
                raw.append(None if reason is None else text)
            kept = batch.take(pa.array(at, pa.int64()))
            made = [pa.array([None if r is None else r[f] for r in rows], _ARROW.get(f, pa.int64())) for f in fields]
            yield pa.RecordBatch.from_arrays(
                [*kept.columns[:-1], *made, pa.array(reasons, pa.string()), pa.array(raw, pa.string())],
                names=[*out_names, *fields, "reason", "raw"],
            )

    return source.mapInArrow(run, schema)


def valid_rows(parsed: DataFrame) -> DataFrame:
    """The typed rows of :func:`parse_report_lines`."""
    return parsed.filter(F.col("reason").isNull()).drop("reason", "raw")


def rejected_rows(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The failing lines of :func:`parse_report_lines` with ``reason`` and ``raw``."""
    fields = {f.name for f in FIELDS}
    columns: list[str | Column] = [c for c in parsed.columns if c not in fields] if keep is None else [*keep, "reason", "raw"]
    return parsed.filter(F.col("reason").isNotNull()).select(*columns)
