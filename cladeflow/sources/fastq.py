"""FASTQ as a Spark data source.

``spark.read.format("fastq").load(path)`` gives one row per record: ``file``, ``pos`` (the record's byte offset in the
uncompressed file, which orders the records of a file), ``id``, ``desc``, ``seq``, ``sep``, ``qual``. With the option
``mates``, the second files of the same number, rows hold pairs: the mates' fields as ``desc1``, ``seq1`` ... ``qual2``.

Paths are local or URIs of any file system that Arrow opens (``hdfs://``, ``s3://``, ``gs://``, ``file://``). Plain files
are read in splits of ``split_bytes``; a gzip file is one partition. A pair of files is one partition, unless both are
plain and longer than a split: :func:`read_fastq` then reads either file in splits and pairs records by their number.
"""

from __future__ import annotations

import fnmatch
import glob
import gzip
import io
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

SINGLE_DDL = "file string, pos bigint, id string, desc string, seq string, sep string, qual string"
PAIRED_DDL = "file string, pos bigint, id string, desc1 string, seq1 string, sep1 string, qual1 string, desc2 string, seq2 string, sep2 string, qual2 string"
_NUMBERED_DDL = ", chunk bigint, nr bigint"
SPLIT_BYTES = 64 << 20
_BATCH = 8_192


class FastqError(ValueError):
    """A FASTQ file that is not as it should be."""


def _remote(path: str) -> tuple[fs.FileSystem, str] | None:
    """File system and path of a URI, None of a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path else None


def _open(path: str) -> io.BufferedIOBase:
    place = _remote(path)
    plain = open(path, "rb", buffering=4 << 20) if place is None else io.BufferedReader(place[0].open_input_file(place[1]), 4 << 20)
    return gzip.GzipFile(fileobj=plain) if path.lower().endswith(".gz") else plain  # reads all members of the file


def _size(path: str) -> int:
    place = _remote(path)
    return os.path.getsize(path) if place is None else place[0].get_file_info(place[1]).size


def _gzipped(path: str) -> bool:
    return path.lower().endswith(".gz")


class _Lines:
    """Lines without line ends, with the number and the offset of the last one."""

    def __init__(self, f: io.BufferedIOBase, offset: int = 0) -> None:
        self.f, self.number, self.next, self.offset = f, 0, offset, offset

    def read(self) -> str | None:
        raw = self.f.readline()
        if not raw:
            return None
        self.offset, self.next = self.next, self.next + len(raw)
        self.number += 1
        return raw.rstrip(b"\n").removesuffix(b"\r").decode("utf-8")


Record = tuple[int, str, str | None, str, str, str]


def read_record(lines: _Lines) -> Record | None:
    """The next record: offset, id, description, bases, separator, qualities. Blank lines may stand before a record."""
    head = lines.read()
    while head is not None and not head.strip():
        head = lines.read()
    if head is None:
        return None
    at = lines.offset
    if not head.startswith("@"):
        raise FastqError(f"no record here (line: {lines.number}): expected '@' at record start, found {head[:80]!r}")
    cut = next((i for i, c in enumerate(head) if c in " \t"), len(head))
    name, desc = head[1:cut], head[cut + 1 :] if cut < len(head) else None
    seq, sep, qual = lines.read(), lines.read(), lines.read()
    if seq is None or sep is None or qual is None:
        raise FastqError(f"the file ends within record {name} (line: {lines.number}): incomplete record")
    if not sep.startswith("+"):
        raise FastqError(f"record {name} has no separator (line: {lines.number - 1}): expected '+', found {sep[:80]!r}")
    if len(seq) != len(qual):
        raise FastqError(f"record {name} is broken (line: {lines.number}): sequence and quality lengths do not match ({len(seq)} vs {len(qual)})")
    return at, name, desc, seq, sep, qual


def _seek_record(f: io.BufferedIOBase, start: int, end: int) -> int | None:
    """The offset of the first record at or after ``start``, or None if it begins after ``end``.

    A record starts at a line with @ whose next but one starts with + and whose next has the length of the line after that.
    """
    f.seek(max(0, start - 1))
    at = f.tell()
    if start:
        at += len(f.readline())  # the rest of a line, or just the end of the one before
    window: list[tuple[int, bytes]] = []
    while True:
        while len(window) < 4:
            raw = f.readline()
            if not raw:
                return None  # a rest of fewer lines is no record; the split before sees to it
            window.append((at, raw.rstrip(b"\r\n")))
            at += len(raw)
        if window[0][0] >= end:
            return None
        (place, head), (_, seq), (_, sep), (_, qual) = window
        if head.startswith(b"@") and sep.startswith(b"+") and len(seq) == len(qual):
            return place
        window.pop(0)


def single_records(path: str, start: int = 0, end: int | None = None) -> Iterator[Record]:
    """Records of a file that start in ``start`` to ``end``; a file that is broken in the first split fails as a whole."""
    with _open(path) as f:
        if start:
            place = _seek_record(f, start, end)
            if place is None:
                return
            f.seek(place)
            start = place
        lines = _Lines(f, start)
        while end is None or lines.next < end:
            record = read_record(lines)
            if record is None or (end is not None and record[0] >= end):
                return
            yield record
        read_record(lines)  # only checked: the next split would pass over a broken or incomplete record at its start


def paired_records(first: str, second: str) -> Iterator[tuple[Record, Record]]:
    """Records of two files side by side; both must have the same ids in the same order, and as many."""
    with _open(first) as f, _open(second) as g:
        a, b = _Lines(f), _Lines(g)
        while True:
            one, two = read_record(a), read_record(b)
            if one is None and two is None:
                return
            if one is None or two is None:
                raise FastqError(f"{first if one is None else second} ends before its mate (line: {(a if one is None else b).number})")
            if one[1] != two[1]:
                raise FastqError(f"mates of different reads: sequence IDs do not match: (line: {a.number - 3}): {one[1]}, (line: {b.number - 3}): {two[1]}")
            yield one, two


class _Split(InputPartition):
    def __init__(self, path: str, mate: str | None, start: int, end: int | None) -> None:
        super().__init__((path, mate, start, end))
        self.path, self.mate, self.start, self.end = path, mate, start, end


def _shown(path: str) -> bool:
    return not os.path.basename(path).startswith(("_", "."))


def _files(paths: list[str]) -> list[str]:
    """The files that paths, folders and globs stand for. A path that exists is taken as it is, with any glob signs."""
    found: list[str] = []
    for path in paths:
        path = path.removeprefix("file:").replace("///", "/", 1) if path.startswith(("file:///", "file:/")) else path
        place = _remote(path)
        if place is None:
            if os.path.isdir(path):
                found += sorted(p for p in glob.glob(os.path.join(glob.escape(path), "*")) if os.path.isfile(p) and _shown(p))
            else:
                found += [path] if os.path.exists(path) else sorted(glob.glob(path)) or [path]
            continue
        system, inner = place
        head = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
        kind = system.get_file_info(inner).type
        if kind == fs.FileType.File:
            found.append(path)
            continue
        folder = inner if kind == fs.FileType.Directory else os.path.dirname(inner)
        listed = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        wanted = [x.path for x in listed if x.type == fs.FileType.File and _shown(x.path) and (kind == fs.FileType.Directory or fnmatch.fnmatch(x.path, inner))]
        found += sorted(head + p for p in wanted) or [path]
    return found


def _paths(text: str) -> list[str]:
    """Paths of an option: a JSON list, or one path."""
    return json.loads(text) if text.startswith("[") else [text]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = _files(_paths(options.get("paths") or options["path"]))
        self.mates = _files(_paths(options["mates"])) if options.get("mates") else None
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.numbered = options.get("numbered") == "true"
        if self.mates is not None and len(self.mates) != len(self.paths):
            raise FastqError(f"{len(self.paths)} files have {len(self.mates)} mates")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for i, path in enumerate(self.paths):
            if self.mates is not None:
                out.append(_Split(path, self.mates[i], 0, None))
            elif _gzipped(path):
                out.append(_Split(path, None, 0, None))
            else:
                out += [_Split(path, None, s, s + self.split) for s in range(0, max(_size(path), 1), self.split)]
        return out

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        if partition.mate is None:
            rows = ((partition.path, *r) for r in single_records(partition.path, partition.start, partition.end))
            ddl = SINGLE_DDL
            if self.numbered:
                rows = ((*r, partition.start, i) for i, r in enumerate(rows))
                ddl += _NUMBERED_DDL
        else:
            rows = ((partition.path, a[0], a[1], *a[2:], *b[2:]) for a, b in paired_records(partition.path, partition.mate))
            ddl = PAIRED_DDL
        fields = [x.split() for x in ddl.split(", ")]
        kinds = [pa.int64() if kind == "bigint" else pa.string() for _, kind in fields]
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=[name for name, _ in fields])

        for row in rows:
            held.append(row)
            if len(held) == _BATCH:
                yield batch()
                held = []
        if held:
            yield batch()


class FastqDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        if self.options.get("mates"):
            return PAIRED_DDL
        return SINGLE_DDL + (_NUMBERED_DDL if self.options.get("numbered") == "true" else "")

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def _load(spark: SparkSession, paths: list[str], split_bytes: int, **options: str) -> DataFrame:
    reader = spark.read.format("fastq").option("split_bytes", split_bytes).option("paths", json.dumps(paths))
    return reader.options(**options).load()


def _numbered(spark: SparkSession, paths: list[str], split_bytes: int) -> DataFrame:
    """Single records with ``pair`` (the number of their file) and ``number`` (theirs within it).

    A split numbers its records as it reads them; a first pass counts the records of each split, and only these counts
    are put in order.
    """
    rows = _load(spark, paths, split_bytes, numbered="true")
    counts = rows.groupBy("file", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    names = spark.createDataFrame(list(enumerate(paths)), "pair int, file string")
    return rows.join(offsets, ["file", "chunk"]).join(names, "file").withColumn("number", F.col("before") + F.col("nr")).drop("chunk", "nr", "before")


def _pairs_in_splits(spark: SparkSession, paths: list[str], mates: list[str], split_bytes: int) -> DataFrame:
    """The rows of :func:`paired_records`, from splits of both files; records without a mate and ids that differ are errors."""
    on = ["pair", "number"]
    a = _numbered(spark, paths, split_bytes).withColumnsRenamed({c: f"{c}1" for c in ("id", "desc", "seq", "sep", "qual")})
    b = _numbered(spark, mates, split_bytes).drop("file", "pos").withColumnsRenamed({c: f"{c}2" for c in ("id", "desc", "seq", "sep", "qual")})
    joined = a.join(b, on, "full_outer")
    where = F.concat(F.lit(" (record "), F.col("number").cast("string"), F.lit(" of pair "), F.col("pair").cast("string"), F.lit(")"))
    short = F.raise_error(F.concat(F.lit("a file ends before its mate"), where))
    differ = F.raise_error(F.concat(F.lit("sequence IDs do not match: "), F.col("id1"), F.lit(", "), F.col("id2"), where))
    name = F.when(F.col("id1").isNull() | F.col("id2").isNull(), short).when(F.col("id1") != F.col("id2"), differ).otherwise(F.col("id1"))
    columns = [x.split()[0] for x in PAIRED_DDL.split(", ")]
    return joined.withColumn("id", name).select(*columns)


def read_fastq(spark: SparkSession, path: str | list[str], mates: str | list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of FASTQ files (globs and folders are taken), or pairs where ``mates`` names the second files."""
    ship(spark)
    spark.dataSource.register(FastqDataSource)
    listed = lambda x: [x] if isinstance(x, str) else list(x)
    if mates is None:
        return _load(spark, listed(path), split_bytes)
    first, second = _files(listed(path)), _files(listed(mates))
    long = [not _gzipped(p) and _size(p) > split_bytes for p in (*first, *second)]
    if len(first) == len(second) and all(not _gzipped(p) for p in (*first, *second)) and any(long):
        return _pairs_in_splits(spark, first, second, split_bytes)
    return _load(spark, first, split_bytes, mates=json.dumps(second))
