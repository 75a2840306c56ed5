"""Denoising of taxon counts: quantile test against cell lines, sample-level and barcode-level correlation, count table.

A sample is a column; all samples are in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks as ranks_of
from . import stats, taxonomy

#: Lineages whose reads count as microbiome reads; ranks in lower case.
MICROBES = ["d__Bacteria", "d__Fungi", "d__Viruses"]


def rpmm(reports: DataFrame, taxa: list[str] = MICROBES, sample: str = "sample") -> DataFrame:
    """``sample, taxid, taxon, rpmm``: reads per million microbiome reads of every row with a lineage in ``taxa``.

    The microbiome reads of a sample are those of the rows that are themselves one of ``taxa``.
    """
    own = F.concat(F.lower("rank"), F.lit("__"), F.col("taxon")).isin(taxa)
    totals = reports.filter(own).groupBy(F.col(sample).alias("__of")).agg(F.sum("total_reads").cast("double").alias("__total"))
    rows = reports.filter(taxonomy.matches_taxonomy(taxa, lower=True)).select(sample, "taxid", "taxon", "total_reads")
    joined = rows.join(totals, F.col(sample).eqNullSafe(F.col("__of")), "left")
    return joined.select(sample, "taxid", "taxon", (F.try_divide("total_reads", "__total") * 1e6).alias("rpmm"))


@dataclass(frozen=True)
class QuantileTest:
    """``data``: taxid, taxon, rpmm, study, and ``weight``, how often the row counts (a cell line's value counts once for
    each report row of its taxid); ``pvalues``: taxid, taxon, reference, pvalue (null if unmatched); ``unmatched``,
    ``significant`` and ``truly``: distinct taxid."""

    data: DataFrame
    pvalues: DataFrame
    unmatched: DataFrame
    significant: DataFrame
    truly: DataFrame

    def density_frame(self) -> DataFrame:
        """Rows for a density plot of log10 rpmm by study, for the truly present taxa that are matched, in order of p."""
        order = self.pvalues.groupBy("taxid").agg(F.min("pvalue").alias("pvalue"))
        shown = self.truly.join(self.unmatched, "taxid", "left_anti")
        return self.data.join(shown, "taxid", "left_semi").join(order, "taxid").withColumn("log10_rpmm", F.when(F.col("rpmm") > 0, F.log10("rpmm")))


def quantile_test(
    reports: DataFrame,
    cell_lines: DataFrame,
    study: str = "current study",
    taxa: list[str] = MICROBES,
    quantile: float = 0.95,
    alpha: float = 0.05,
    alternative: str = "greater",
    drop_unmatched: bool = True,
    sample: str = "sample",
) -> QuantileTest:
    """Whether taxa are more (or less) abundant than in cell lines, by ``rpmm`` of ``reports`` and of ``cell_lines``.

    The reference is a quantile of the cell lines' values per taxid, each counted once for every report row of the taxid.
    Taxa without a reference are unmatched and have a null p; they are truly present unless ``drop_unmatched``.
    """
    own = rpmm(reports, taxa, sample)
    # a copy of a cell line's value for each report row of the taxid: a weight instead of copies
    times = own.groupBy("taxid").agg(F.count(F.lit(1)).alias("w"))
    lines = cell_lines.filter(F.col("rpmm").isNotNull() & F.col("taxid").isNotNull()).select("taxid", "rpmm")
    counts = lines.groupBy("taxid", "rpmm").agg(F.count(F.lit(1)).alias("c"))
    weighted = counts.join(times, "taxid").withColumn("c", F.col("c") * F.col("w"))
    reference = stats.nearest_quantiles(weighted, ["taxid"], "rpmm", quantile, "reference", "c")
    tested = own.join(reference, "taxid", "left").groupBy("taxid", "taxon", "reference")
    tested = tested.agg(F.count_if(F.col("rpmm") < F.col("reference")).alias("below"), F.count_if(F.col("rpmm") <= F.col("reference")).alias("upto"), F.count("rpmm").alias("n"))
    p = stats.quantile_test_p(F.col("below"), F.col("upto"), F.col("n"), alternative)
    pvalues = tested.select("taxid", "taxon", "reference", F.when(F.col("reference").isNotNull(), p).alias("pvalue"))
    unmatched = pvalues.filter(F.col("reference").isNull()).select("taxid").distinct()
    significant = pvalues.filter(F.col("pvalue") < alpha).select("taxid").distinct()
    truly = significant if drop_unmatched else unmatched.union(significant).distinct()
    names = own.groupBy("taxid", "taxon").agg(F.count(F.lit(1)).alias("w")).join(counts, "taxid")
    names = names.select("taxid", "taxon", "rpmm", F.lit("cell lines").alias("study"), (F.col("w") * F.col("c")).alias("weight"))
    data = own.select("taxid", "taxon", "rpmm", F.lit(study).alias("study"), F.lit(1).cast("bigint").alias("weight")).unionByName(names)
    return QuantileTest(data, pvalues, unmatched, significant, truly)


def sample_level(
    reports: DataFrame,
    method: str = "spearman",
    min_reads: int = 3,
    min_minimizer_n_unique: int = 3,
    min_samples: int = 3,
    **test: object,
) -> DataFrame:
    """``taxid, taxon, r1, r2, r3, p1, p2, p3``: correlations over samples of minimizer_len with minimizer_n_unique (1), of
    minimizer_len with total_reads (2) and of total_reads with minimizer_n_unique (3), for taxa with enough rows."""
    rows = reports.filter((F.col("total_reads") >= min_reads) & (F.col("minimizer_n_unique") >= min_minimizer_n_unique))
    rows = rows.select("taxid", "taxon", "total_reads", "minimizer_len", "minimizer_n_unique")
    pairs = [("minimizer_len", "minimizer_n_unique", "r1", "p1"), ("minimizer_len", "total_reads", "r2", "p2"), ("total_reads", "minimizer_n_unique", "r3", "p3")]
    found = stats.correlate(rows, ["taxid", "taxon"], pairs, method, min_rows=min_samples, **test)
    return found.select("taxid", "taxon", "r1", "r2", "r3", "p1", "p2", "p3")


def barcode_level(
    kmers: DataFrame,
    method: str = "spearman",
    min_kmer_len: int = 3,
    min_cells: int = 3,
    p_adjust: str = "BH",
    sample: str | None = None,
    **test: object,
) -> DataFrame:
    """``[sample,] taxid, taxon, cor, pvalue, padj``: correlation over barcodes of kmer_len with kmer_n_unique; p adjusted
    over the taxa (of each sample)."""
    by = [] if sample is None else [sample]
    group = [*by, "taxid", "taxon"]
    rows = kmers.filter(F.col("kmer_len") >= min_kmer_len).select(*group, "kmer_len", "kmer_n_unique")
    found = stats.correlate(rows, group, [("kmer_len", "kmer_n_unique", "cor", "pvalue")], method, min_rows=min_cells, **test)
    return stats.adjust_p(found, "pvalue", p_adjust, by)


def taxa_counts(umis: DataFrame, ranks: list[str], sample: str | None = None) -> DataFrame:
    """``[sample,] barcode, taxid, taxa, rank``, a column per rank of the lineage in hierarchical order, and ``counts``, the
    distinct UMIs.

    ``ranks`` are the codes to show, as ``G`` or ``S1``; their columns have the full names. A null UMI counts as one value.
    """
    keys = [*([] if sample is None else [sample]), "barcode", "taxid", "taxa", "rank"]
    value = F.count_distinct("umi") + F.max(F.when(F.col("umi").isNull(), 1).otherwise(0))
    counted = umis.groupBy(*keys, "taxon", "ranks").agg(value.alias("counts"))
    order = "RDKPCOFGS"
    codes = sorted((r for r in ranks if r and r[0] in order), key=lambda r: (order.index(r[0]), r[1:]))
    lineage = F.arrays_zip(F.col("ranks").alias("rank"), F.col("taxon").alias("taxon"))
    at = lambda r: F.get(F.filter(lineage, lambda x: x["rank"] == F.lit(r)), F.lit(0))["taxon"]
    return counted.select(*keys, *[at(r).alias(ranks_of.NAMES[r[0]] + r[1:]) for r in codes], "counts")


def observed_ranks(umis: DataFrame) -> list[str]:
    """Rank codes that occur in lineages, at most one for each letter and number."""
    found = umis.select(F.explode("ranks").alias("r")).filter(F.col("r").rlike("^[RDKPCOFGS][0-9]*$")).distinct()
    return sorted(r["r"] for r in found.collect())


@dataclass(frozen=True)
class Denoised:
    """``counts``: the table of :func:`taxa_counts`; the results of the tests it rests on."""

    counts: DataFrame
    sample_level: DataFrame
    barcode_level: DataFrame
    quantile_test: QuantileTest


def denoise_counts(
    reports: DataFrame,
    kmers: DataFrame,
    umis: DataFrame,
    cell_lines: DataFrame,
    ranks: list[str],
    sample: str = "sample",
    taxa: list[str] = MICROBES,
    drop_unmatched: bool = True,
    quantile: float = 0.95,
    alpha: float = 0.05,
    alternative: str = "greater",
    min_reads: int = 3,
    min_minimizer_n_unique: int = 3,
    min_samples: int = 3,
    min_kmer_len: int = 3,
    min_cells: int = 3,
    cor_threshold: float = 0.0,
    p_threshold: float = 0.05,
    padj_threshold: float = 0.05,
    p_adjust: str = "BH",
    method: str = "spearman",
    study: str = "current study",
    **test: object,
) -> Denoised:
    """Counts of the taxa that all three tests find real: in cell lines' terms, over samples, and in the sample's barcodes.

    ``alternative`` is that of the quantile test; correlations are two-sided unless ``test`` says otherwise.
    """
    quantiles = quantile_test(reports, cell_lines, study, taxa, quantile, alpha, alternative, drop_unmatched, sample)
    samples = sample_level(reports, method, min_reads, min_minimizer_n_unique, min_samples, **test)
    good: Column = F.lit(True)
    for i in (1, 2, 3):
        good = good & (F.col(f"r{i}") > cor_threshold) & (F.col(f"p{i}") < p_threshold)
    barcodes = barcode_level(kmers, method, min_kmer_len, min_cells, p_adjust, sample, **test)
    real = barcodes.filter(F.col("padj") < padj_threshold).select(sample, "taxid").distinct()
    real = real.join(samples.filter(good).select("taxid"), "taxid", "left_semi").join(quantiles.truly, "taxid", "left_semi")
    return Denoised(taxa_counts(umis.join(real, [sample, "taxid"], "left_semi"), ranks, sample), samples, barcodes, quantiles)
