"""Whole steps from files to files, each a short plan of the operators. Paths may be lists, globs and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import extract, koutreads, krcount, refine, taxonomy
from ..sources import fastq, sinks, text

Paths = str | list[str]

#: Lineages that are counted by default. Ranks are compared as the report has them, so Fungi must be of rank D there.
MICROBES = ["D__Bacteria", "D__Fungi", "D__Viruses"]


def report_lineages(spark: SparkSession, report: Paths, taxa: list[str] | None = None) -> DataFrame:
    """Rows of report files with their lineages, of the lineages ``taxa`` if given; it is an error if there are none."""
    rows = taxonomy.add_lineage(text.read_report(spark, report), ["file"], ["line_no"])
    if rows.isEmpty():
        raise ValueError("the report has no classified rows")
    return taxonomy.filter_taxonomy(rows, taxa, check=taxa is not None)


def refine_fastq(
    spark: SparkSession,
    reads: Paths,
    out: str | None,
    mates: Paths | None = None,
    mates_out: str | None = None,
    umi: object = None,
    barcode: object = None,
    extra: object = None,
    mates_umi: object = None,
    mates_barcode: object = None,
    mates_extra: object = None,
    prefix: str = refine.TAG_PREFIX,
    gzip: bool = False,
    level: int | None = None,
    ordered: bool = False,
) -> None:
    """Refined reads, or pairs where ``mates`` are given, as FASTQ; ``ordered`` keeps the order of the files."""
    order = ["file", "pos"] if ordered else None
    rows = fastq.read_fastq(spark, reads, mates)
    if mates is None:
        if mates_umi is not None or mates_barcode is not None or mates_extra is not None or mates_out is not None:
            raise ValueError("actions and output of mates need mates")
        if out is None:
            raise ValueError("an output is needed")
        sinks.write_fastq(refine.refine(rows, umi, barcode, extra, prefix), out, gzip, level, order)
        return
    pairs = refine.refine_pair(rows, umi, barcode, extra, mates_umi, mates_barcode, mates_extra, prefix)
    sinks.write_fastq_pair(pairs, out, mates_out, gzip, level, order)


def select_koutput(
    spark: SparkSession,
    report: Paths,
    koutput: Paths,
    out: str,
    taxa_in: list[str] | None = None,
    ranks: list[str] | None = None,
    taxa: list[str] | None = None,
    taxids: list[str] | None = None,
    exclude: list[str] | None = None,
    descendants: bool = True,
    mode: str = "substring",
    classified_only: bool = False,
    gzip: bool = False,
) -> None:
    """Lines of classification files whose taxon is selected by the report and that name no excluded host.

    At least one of the selections and ``exclude`` must be given; with ``exclude`` alone all other lines are kept.
    """
    selected = any(taxonomy.given(x) for x in (taxa_in, ranks, taxa, taxids))
    if not selected and not exclude:
        raise ValueError("at least one of taxa_in, ranks, taxa, taxids and exclude must be given")
    include = taxonomy.select_taxa(report_lineages(spark, report), taxa_in, ranks, taxa, taxids, descendants) if selected else None
    rows = extract.filter_koutput(text.read_koutput(spark, koutput), include, exclude, mode, classified_only)
    sinks.write_koutput(rows, out, gzip)


def extract_fastq(spark: SparkSession, koutput: Paths, reads: Paths, out: str | None, mates: Paths | None = None, mates_out: str | None = None, gzip: bool = False) -> None:
    """FASTQ of the reads, or pairs, that classification files name."""
    kept = extract.extract_reads(fastq.read_fastq(spark, reads, mates), text.read_ids(spark, koutput))
    if mates is None:
        if out is None:
            raise ValueError("an output is needed")
        sinks.write_fastq(kept, out, gzip)
    else:
        sinks.write_fastq_pair(kept, out, mates_out, gzip)


def classified_reads(
    spark: SparkSession,
    report: Paths,
    koutput: Paths,
    reads: Paths,
    mates: Paths | None = None,
    out: str | None = None,
    taxa_in: list[str] | None = MICROBES,
    exclude: list[str] | None = None,
    tags: object = None,
    mates_tags: object = None,
    prefix: str = refine.TAG_PREFIX,
    mode: str = "substring",
    gzip: bool = False,
) -> DataFrame:
    """Reads with their classification, of taxa inside ``taxa_in`` and their descendants; written to ``out`` if given."""
    include = taxonomy.select_taxa(report_lineages(spark, report), taxa_in) if taxa_in else None
    hits = extract.filter_koutput(text.read_koutput(spark, koutput), include, exclude, mode, classified_only=True)
    rows = fastq.read_fastq(spark, reads, mates)
    joined = koutreads.join_reads(hits, rows, tags, prefix) if mates is None else koutreads.join_pairs(hits, rows, tags, mates_tags, prefix)
    if out is not None:
        sinks.write_koutreads(joined, out, gzip)
    return joined


def count_classified(
    spark: SparkSession,
    reads: Paths | DataFrame,
    report: Paths,
    taxa_in: list[str] | None = MICROBES,
    barcode_tag: str | None = None,
    umi_tag: str | None = None,
    ranks: list[str] | None = None,
) -> DataFrame:
    """:func:`..operators.krcount.count_reads` of classified reads, from files or as a DataFrame."""
    rows = reads if isinstance(reads, DataFrame) else text.read_koutreads(spark, reads)
    return krcount.count_reads(rows, report_lineages(spark, report, taxa_in), barcode_tag, umi_tag, ranks)
