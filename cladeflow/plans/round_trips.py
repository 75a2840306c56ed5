"""Queries through files: whole tables written in the formats of reads, classifications and reports, and read back by the steps
from files to files. The files lie in the session's checkpoint folder, which all executors share."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..operators import extract
from ..session import ensure_checkpoint_dir, table
from ..sources import fastq, sinks, text
from ..streaming import reads
from . import analysis, files

#: Small splits, so that files of any size have several.
SPLIT_BYTES = 1 << 20


def _place(spark: SparkSession) -> Callable[[str], str]:
    """Names of files in a new folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid4().hex}"
    return lambda name: f"{folder}/{name}"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell reads as records; some have a description."""
    desc = F.when(F.col("umi_id") % 3 != 0, F.concat(F.lit("d "), F.col("umi_id").cast("string")))
    qual = F.repeat(F.lit("@"), F.length("seq"))  # looks like the start of a record
    return analysis._cell_reads(spark, sf_dir).select("umi_id", F.concat(F.lit("r"), F.col("umi_id").cast("string")).alias("id"), desc.alias("desc"), "seq", F.lit("+").alias("sep"), qual.alias("qual"))


def fastq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as plain FASTQ and read in splits."""
    at = _place(spark)
    sinks.write_fastq(_reads(spark, sf_dir), at("reads"))
    return fastq.read_fastq(spark, at("reads"), split_bytes=SPLIT_BYTES).select("id", "desc", "seq", "sep", "qual")


def fastq_gzip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as compressed FASTQ in order, and read from it."""
    at = _place(spark)
    sinks.write_fastq(_reads(spark, sf_dir), at("reads"), gzip=True, level=9, order=["umi_id"])
    return fastq.read_fastq(spark, at("reads")).select("id", "desc", "seq", "sep", "qual")


def _write_pairs(pairs: DataFrame, at: Callable[[str], str]) -> tuple[str, str]:
    sinks.write_fastq_pair(pairs.withColumns({"sep1": F.lit("+"), "sep2": F.lit("+")}), at("mate1"), at("mate2"))
    return at("mate1"), at("mate2")


def refined_pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both mates' files refined into compressed files, which are read side by side."""
    at = _place(spark)
    _, pairs = analysis._classified_pairs(spark, sf_dir)
    first, second = _write_pairs(pairs.withColumn("desc2", F.lit("m2")), at)
    actions = {"barcode": R.seq_range(1, 16), "umi": R.seq_range(17, 28), "mates_umi": R.embed("UMI", R.seq_range(end=3)), "mates_extra": R.seq_range(2, 5)}
    files.refine_fastq(spark, first, at("out1"), second, at("out2"), **actions, prefix="T", gzip=True)
    return fastq.read_fastq(spark, at("out1"), at("out2")).select("id", "desc1", "seq1", "qual1", "desc2", "seq2", "qual2")


def pair_files_in_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs read from splits of both mates' files."""
    at = _place(spark)
    _, pairs = analysis._classified_pairs(spark, sf_dir)
    first, second = _write_pairs(pairs, at)
    return fastq.read_fastq(spark, first, second, split_bytes=1 << 16).select("id", "seq1", "qual1", "seq2", "qual2")


def _flat(c: Column | str) -> Column:
    """A field without tabs and line ends; empty for null."""
    return F.coalesce(F.regexp_replace(c, "[\t\r\n]", " "), F.lit(""))


def _write_koutput(rows: DataFrame, path: str) -> None:
    line = F.concat_ws("\t", *[_flat(c) for c in ("status", "id", "taxid_text", "length", "lca")])
    sinks.write_koutput(rows.select(line.alias("line")), path)


def _write_reports(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A file for each report, in folders named by their number, lines in order."""
    rows = table(spark, sf_dir, "kreport")
    minimizers = F.when(F.col("minimizer_len").isNotNull(), F.concat_ws("\t", F.col("minimizer_len").cast("string"), F.coalesce("minimizer_n_unique", F.lit(0)).cast("string")))
    line = F.concat_ws("\t", F.col("percents").cast("string"), F.col("total_reads").cast("string"), F.col("reads").cast("string"), minimizers, "rank", "taxid", "name")
    placed = rows.select("report_id", "row_id", line.alias("value")).repartition("report_id").sortWithinPartitions("report_id", "row_id")
    placed.select("report_id", "value").write.partitionBy("report_id").text(path)


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as text, 6 or 8 columns each, and read with their lineages."""
    at = _place(spark)
    _write_reports(spark, sf_dir, at("reports"))
    rows = files.report_lineages(spark, at("reports/*/*.txt"))
    number = F.regexp_extract("file", "report_id=([0-9]+)", 1).cast("bigint")
    return rows.select(number.alias("report_id"), "percents", "total_reads", "reads", "minimizer_len", "minimizer_n_unique", "rank", "taxid", "taxon", "level", analysis._lineage_text().alias("lineage"))


def koutput_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of classification files of one domain without the host, selected by report files into compressed files."""
    at = _place(spark)
    _write_reports(spark, sf_dir, at("reports"))
    _write_koutput(table(spark, sf_dir, "koutput"), at("koutput"))
    domain = f"D__{analysis._domain(spark, sf_dir)}"
    files.select_koutput(spark, at("reports/*/*.txt"), at("koutput"), at("out"), taxa_in=[domain], exclude=analysis.HOST, classified_only=True, gzip=True)
    return text.read_koutput(spark, at("out")).select("status", "id", "taxid_text", "length", "lca")


def koutput_file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark)
    _write_koutput(table(spark, sf_dir, "koutput"), at("koutput"))
    return text.read_ids(spark, at("koutput"))


def _single_files(spark: SparkSession, sf_dir: str, at: Callable[[str], str]) -> None:
    """Classification files of single reads that are classified, and the reads' FASTQ."""
    rows, _ = analysis._classified_reads(spark, sf_dir)
    rows = rows.filter(F.col("status") == "C")
    length = F.min(F.struct("taxid", _flat("lca").alias("lca"), "length"))["length"].cast("int")
    lengths = rows.groupBy("id").agg(length.alias("n"))
    _write_koutput(rows, at("koutput"))
    sinks.write_fastq(lengths.select("id", F.lit(None).cast("string").alias("desc"), F.rpad(F.lit("A"), F.col("n"), F.lit("CGTA")).alias("seq"), F.lit("+").alias("sep"), F.repeat(F.lit("I"), F.col("n")).alias("qual")), at("reads"))


def koutreads_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads joined with their classification from files to a file, and read from it."""
    at = _place(spark)
    _single_files(spark, sf_dir, at)
    files.classified_reads(spark, [], at("koutput"), at("reads"), out=at("out"), taxa_in=None, tags={"UMI": R.seq_range(1, 12)})
    return text.read_koutreads(spark, at("out")).select("taxid", F.col("tags")["UMI"].alias("umi"), "lca", "seq", "qual")


def extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of one domain's classification files, as compressed FASTQ."""
    at = _place(spark)
    _single_files(spark, sf_dir, at)
    _write_reports(spark, sf_dir, at("reports"))
    files.select_koutput(spark, at("reports/*/*.txt"), at("koutput"), at("kept"), taxa_in=[f"D__{analysis._domain(spark, sf_dir)}"])
    files.extract_fastq(spark, at("kept"), at("reads"), at("out"), gzip=True)
    return fastq.read_fastq(spark, at("out")).select("id", "seq", "qual")


def extract_pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one domain's classification files."""
    at = _place(spark)
    rows, pairs = analysis._classified_pairs(spark, sf_dir)
    _write_koutput(extract.filter_koutput(rows, analysis._included(spark, sf_dir)), at("kept"))
    first, second = _write_pairs(pairs, at)
    files.extract_fastq(spark, at("kept"), first, at("out1"), second, at("out2"))
    return fastq.read_fastq(spark, at("out1"), at("out2")).select("id", "seq1", "seq2")


def krcount_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UMIs and k-mers of classified reads' files by report files, inside one domain."""
    at = _place(spark)
    _write_reports(spark, sf_dir, at("reports"))
    sinks.write_koutreads(analysis._koutreads(spark, sf_dir).filter(F.col("taxid").isNotNull()), at("koutreads"), gzip=True)
    return files.count_classified(spark, at("koutreads"), at("reports/*/*.txt"), [f"D__{analysis._domain(spark, sf_dir)}"], "BARCODE", "UMI")


def cell_line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference table of cell lines, from text to Parquet."""
    at = _place(spark)
    table(spark, sf_dir, "cell_lines").filter(~F.isnan("rpmm") | F.col("rpmm").isNull()).select("taxid", "rpmm").write.csv(at("lines"), sep=" ", header=True)
    sinks.write_cell_lines(text.read_cell_lines(spark, at("lines")), at("out"))
    return spark.read.parquet(at("out"))


def stream_umi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct UMIs of each day, sample and taxid, from a stream that stores partial results."""
    at = _place(spark)
    events = spark.readStream.schema(table(spark, sf_dir, "umi").schema).parquet(f"{sf_dir}/umi.[p]arquet")  # a glob, as the table may be one file
    reads.store_umis(events, at("partials"), at("progress")).awaitTermination()
    return reads.exact_umi_counts(spark.read.parquet(at("partials")))


def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of single reads joined with the table of their classifications."""
    at = _place(spark)
    rows, singles = analysis._classified_reads(spark, sf_dir)
    singles.write.parquet(at("reads"))
    events = spark.readStream.schema(singles.schema).parquet(at("reads"))
    joined = reads.join_stream(rows, events, {"UMI": R.seq_range(1, 12)})
    flat = joined.select("id", "taxid", F.col("tags")["UMI"].alias("umi"), "lca", "seq", "qual")
    flat.writeStream.format("parquet").option("checkpointLocation", at("progress")).trigger(availableNow=True).start(at("out")).awaitTermination()
    return spark.read.parquet(at("out"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        fastq_files, fastq_gzip_files, refined_pair_files, pair_files_in_splits, report_files, koutput_files, koutput_file_ids, koutreads_files, extract_files, extract_pair_files,
        krcount_files, cell_line_files, stream_umi_counts, stream_join,
    )
}

_RECORDS = f"""WITH {analysis._CELLS}
SELECT 'r' || umi_id AS id, CASE WHEN umi_id % 3 <> 0 THEN 'd ' || umi_id END AS "desc", seq, '+' AS sep, repeat('@', length(seq)) AS qual FROM cells"""
_LCA = "coalesce(regexp_replace(lca, '[\\t\\r\\n]', ' ', 'g'), '')"
_SINGLE = f"""named AS (
  SELECT *, {analysis._TAXID} AS taxid FROM koutput
), single AS (
  SELECT id, min({{'taxid': taxid, 'lca': {_LCA}, 'length': length}}) AS x FROM named WHERE taxid IS NOT NULL AND status = 'C' AND regexp_full_match(length, '[0-9]+') GROUP BY id
), reads AS (
  SELECT id, x.taxid AS taxid, x.lca AS lca, rpad('A', x.length::INTEGER, 'CGTA') AS seq, repeat('I', x.length::INTEGER) AS qual FROM single
)"""

SQL: dict[str, str] = {
    "fastq_files": _RECORDS,
    "fastq_gzip_files": _RECORDS,
    "refined_pair_files": analysis.SQL["refined_pairs"],
    "pair_files_in_splits": f"""WITH {analysis._PAIRS}
SELECT id, tags || mate1 AS seq1, repeat('I', length(tags) + length(mate1)) AS qual1, mate2 AS seq2, repeat('J', length(mate2)) AS qual2 FROM pairs""",
    "report_files": analysis._TREE
    + """
SELECT report_id, percents, total_reads, reads, minimizer_len, CASE WHEN minimizer_len IS NOT NULL THEN coalesce(minimizer_n_unique, 0) END AS minimizer_n_unique, rank, taxid, taxon, level,
  array_to_string(list_transform(lineage, lambda x: x.rank || ':' || x.taxid || ':' || x.taxon), '|') AS lineage FROM report""",
    "koutput_files": f"""{analysis._TREE}
SELECT status, id, taxid_text, length, {_LCA} AS lca FROM koutput
WHERE status = 'C' AND NOT coalesce(contains(lca, '2831896:') OR contains(lca, '322656:'), false) AND {analysis._TAXID} IN (SELECT taxid FROM inside)""",
    "koutput_file_ids": "SELECT id FROM koutput WHERE id <> ''",
    "koutreads_files": f"WITH {_SINGLE}\nSELECT taxid, seq[1:12] AS umi, lca, seq, qual FROM reads",
    "extract_files": f"{analysis._TREE}, {_SINGLE}\nSELECT id, seq, qual FROM reads WHERE id IN (SELECT id FROM named WHERE status = 'C' AND regexp_full_match(length, '[0-9]+') AND taxid IN (SELECT taxid FROM inside))",
    "extract_pair_files": f"""{analysis._TREE}, {analysis._PAIRS}
SELECT id, tags || mate1 AS seq1, mate2 AS seq2 FROM pairs WHERE id IN (SELECT id FROM named WHERE regexp_full_match(length, '[0-9]+[|:][0-9]+') AND taxid IN (SELECT taxid FROM inside))""",
    "krcount_files": f"{analysis._TREE}, {analysis._CELLS}, {analysis._UP.replace('FROM report', 'FROM inside')}, {analysis._KMERS}\n{analysis._CELL_COUNTS}",
    "stream_umi_counts": "SELECT date_trunc('day', seen_at) AS window_start, sample_id, taxid, count(*) AS n_rows, count(DISTINCT umi) AS n_umis FROM umi WHERE seen_at IS NOT NULL GROUP BY ALL",
    "stream_join": analysis.SQL["koutreads_join"],
    "cell_line_files": "SELECT taxid, rpmm FROM cell_lines WHERE rpmm IS NULL OR NOT isnan(rpmm)",
}
