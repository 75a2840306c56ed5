"""Entity-attribute-value rows into one typed row per entity."""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rank codes and their full names, root first.
RANK_NAMES = {
    "r": "root",
    "d": "domain",
    "k": "kingdom",
    "p": "phylum",
    "c": "class",
    "o": "order",
    "f": "family",
    "g": "genus",
    "s": "species",
}
MEASURES = {"n_reads": T.LongType(), "weight": T.DoubleType(), "seen_on": T.DateType()}
_DIGITS = ("", *"0123456789")
#: All columns in order: each rank, then the rank with each digit, then the measures.
COLUMNS: dict[str, T.DataType] = {f"{name}{digit}": T.StringType() for name in RANK_NAMES.values() for digit in _DIGITS} | MEASURES
#: The column of every attribute, trimmed and in lower case.
KNOWN = {f"{a}{digit}": f"{name}{digit}" for code, name in RANK_NAMES.items() for a in (code, name) for digit in _DIGITS} | {m: m for m in MEASURES}

_INTEGER = re.compile(r"\+?[0-9]+")
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
#: A register's content where the cell can't be filled with one typed value.
TORN = ("torn",)


def column_of(attribute: str | None) -> str | None:
    """The column that an attribute's spelling means, or None. Letters beyond ASCII are of no attribute, whatever their
    lower case is."""
    name = "" if attribute is None else attribute.strip()
    return KNOWN.get(name.lower()) if name.isascii() else None


def observed_columns(rows: DataFrame, attribute: str) -> list[str]:
    """The columns of COLUMNS that some attribute means, in order."""
    blank = r"[\s\p{Z}\x1c-\x1f\x85]*"
    name = F.lower(F.regexp_extract(F.col(f"`{attribute}`").cast("string"), f"^{blank}([A-Za-z_]+[0-9]?){blank}$", 1))
    # no more names than KNOWN has
    found = {KNOWN[r["name"]] for r in rows.select(name.alias("name")).filter(F.col("name").isin(list(KNOWN))).distinct().collect()}
    return [c for c in COLUMNS if c in found]


def encode(column: str, text: str) -> object:
    """The typed value of a trimmed text, or TORN if it has not the column's type."""
    if column == "n_reads":
        if not _INTEGER.fullmatch(text):
            return TORN
        digits = text.lstrip("+0") or "0"
        return int(digits) if len(digits) < 19 or (len(digits) == 19 and int(digits) < 2**63) else TORN
    if column == "weight":
        value = float(text) if _DECIMAL.fullmatch(text) else math.inf
        return value + 0.0 if math.isfinite(value) else TORN
    if column == "seen_on":
        try:
            return datetime.date.fromisoformat(text) if _DATE.fullmatch(text) else TORN
        except ValueError:
            return TORN
    return text


def merge_cell(a: object, b: object) -> object:
    """Associative and commutative: of None and a value the value, of equal values that value, else TORN."""
    if a is None or b is None:
        return b if a is None else a
    return a if a == b else TORN


# An entity's registers: one slot for each column in use, None where no value came. However many rows an entity has, its
# registers stay this small, on the map side as well.
Registers = list[object]


def entity_registers(rows: DataFrame, entity: str, attribute: str, value: str, columns: list[str]) -> RDD:
    """RDD of (entity, registers of ``columns``) over all rows, combined per entity before and after one shuffle."""
    slots = {c: i for i, c in enumerate(columns)}
    width = len(columns)

    def cells(part: Iterator[Row]) -> Iterator[tuple[object, tuple[int, object] | None]]:
        for key, name, text in part:
            slot = slots.get(column_of(name))
            text = text.strip() if text is not None else ""
            yield key, (None if slot is None or not text else (slot, encode(columns[slot], text)))

    def create(cell: tuple[int, object] | None) -> Registers:
        return add([None] * width, cell)

    def add(registers: Registers, cell: tuple[int, object] | None) -> Registers:
        if cell is not None:
            slot, new = cell
            registers[slot] = merge_cell(registers[slot], new)
        return registers

    def merge(a: Registers, b: Registers) -> Registers:
        for slot, new in enumerate(b):
            if new is not None:
                a[slot] = merge_cell(a[slot], new)
        return a

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = rows.select(F.col(f"`{entity}`"), F.col(f"`{attribute}`").cast("string"), F.col(f"`{value}`").cast("string"))
    return source.rdd.mapPartitions(cells).combineByKey(create, add, merge, partitions)


def wide_rows(rows: DataFrame, entity: str = "umi_id", attribute: str = "ranks", value: str = "taxon", columns: list[str] | None = None) -> DataFrame:
    """One row per entity: ``entity``, a typed column for each of ``columns``, and ``torn``.

    ``columns`` are some of COLUMNS, those that occur if None. A cell with values of one typed value is filled; without a
    value it is null; a value of another type or differing values leave it null and put its name into ``torn`` (sorted,
    empty if none). Rows with an unknown or null attribute and rows without a value still make their entity appear. A null
    entity is an entity of its own. Repeated rows change nothing, no rows give no rows, texts of any length are kept
    whole, other columns are not read.
    """
    names = observed_columns(rows, attribute) if columns is None else columns

    def full(part: Iterator[tuple[object, Registers]]) -> Iterator[tuple]:
        for key, registers in part:
            torn = sorted(c for c, cell in zip(names, registers) if cell == TORN)
            yield (key, *(None if cell == TORN else cell for cell in registers), torn)

    schema = T.StructType(
        [T.StructField(entity, rows.schema[entity].dataType)]
        + [T.StructField(c, COLUMNS[c]) for c in names]
        + [T.StructField("torn", T.ArrayType(T.StringType()))]
    )
    out = entity_registers(rows, entity, attribute, value, names).mapPartitions(full, preservesPartitioning=True)
    return rows.sparkSession.createDataFrame(out, schema, verifySchema=False)


def torn_cells(rows: DataFrame, entity: str = "umi_id", attribute: str = "ranks", value: str = "taxon") -> DataFrame:
    """``entity`` and ``col_name`` of every cell that :func:`wide_rows` can't fill with one typed value."""
    names = observed_columns(rows, attribute)

    def torn(part: Iterator[tuple[object, Registers]]) -> Iterator[tuple]:
        for key, registers in part:
            for c, cell in zip(names, registers):
                if cell == TORN:
                    yield key, c

    schema = T.StructType([T.StructField(entity, rows.schema[entity].dataType), T.StructField("col_name", T.StringType())])
    out = entity_registers(rows, entity, attribute, value, names).mapPartitions(torn, preservesPartitioning=True)
    return rows.sparkSession.createDataFrame(out, schema, verifySchema=False)
