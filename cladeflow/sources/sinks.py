"""Writers. Rows are written as they come, in parallel files; ``order`` sorts them first where it is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _write(lines: DataFrame, path: str, gzip: bool, level: int | None, order: list[str] | None) -> None:
    if level is not None and not 1 <= level <= 12:
        raise ValueError("a compression level is from 1 to 12")
    if order:
        lines = lines.sort(*order)
    writer = lines.select("value").write.mode("overwrite")
    # the codec has its own levels from 1 to 9; the given one is only a wish
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def fastq_record(name: Column, desc: Column, seq: Column, sep: Column, qual: Column) -> Column:
    """The four lines of a record; a description follows the id after a space."""
    head = F.when(desc.isNull(), F.concat(F.lit("@"), name)).otherwise(F.concat(F.lit("@"), name, F.lit(" "), desc))
    return F.concat_ws("\n", head, seq, sep, qual)


def write_fastq(reads: DataFrame, path: str, gzip: bool = False, level: int | None = None, order: list[str] | None = None, mate: str = "") -> None:
    """FASTQ files of ``reads``; with ``mate`` "1" or "2" those of a mate of paired reads."""
    c = lambda n: F.col(f"{n}{mate}")
    _write(reads.withColumn("value", fastq_record(F.col("id"), c("desc"), c("seq"), c("sep"), c("qual"))), path, gzip, level, order)


def write_fastq_pair(reads: DataFrame, first: str | None, second: str | None, gzip: bool = False, level: int | None = None, order: list[str] | None = None) -> None:
    """FASTQ files of paired reads; either may be left out.

    Where both are written, the rows are made once and kept in the shared checkpoint folder, so that the files of both
    mates have the same records in the same order.
    """
    if first is None and second is None:
        raise ValueError("at least one output is needed")
    if first is not None and second is not None:
        reads, order = checkpointed(reads.sort(*order) if order else reads), None
    for mate, path in (("1", first), ("2", second)):
        if path is not None:
            write_fastq(reads, path, gzip, level, order, mate)


def write_koutput(rows: DataFrame, path: str, gzip: bool = False, level: int | None = None) -> None:
    """The lines of classification rows, as they were read."""
    _write(rows.select(F.col("line").alias("value")), path, gzip, level, None)


def write_koutreads(reads: DataFrame, path: str, gzip: bool = False, level: int | None = None) -> None:
    """Classified reads in five tab-separated fields; tags as ``TAG:seq`` with spaces between."""
    tags = F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat_ws(":", e["key"], e["value"])), " ")
    line = F.concat_ws("\t", "taxid", F.coalesce(tags, F.lit("")), *[F.coalesce(F.col(c), F.lit("")) for c in ("lca", "seq", "qual")])
    _write(reads.select(line.alias("value")), path, gzip, level, None)


def write_cell_lines(rows: DataFrame, path: str, level: int = 22) -> None:
    """Parquet of ``taxid`` and ``rpmm``, compressed by zstd."""
    rows.select("taxid", "rpmm").write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
