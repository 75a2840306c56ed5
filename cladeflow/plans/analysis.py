"""Queries of the analysis operators over whole tables, and their SQL.

The tables hold no base sequences, so reads are derived from them by the same text functions on either side: a read of an
umi row is its barcode and UMI forwards and backwards, a read of a classification row has its length in repeated bases. A
pair has both lengths, and before mate 1 a barcode and a UMI made from the id, which are cut off before the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..functions import ranks as ranks_of
from ..operators import denoise, extract, koutreads, krcount, refine, stats, taxonomy
from ..session import checkpointed, table
from . import tests_sql

#: A taxid that is excluded as the host's.
HOST = ["2831896", "322656"]


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.add_lineage(table(spark, sf_dir, "kreport"), ["report_id"], ["row_id"])


def _domain(spark: SparkSession, sf_dir: str) -> str:
    """The name of the first domain, by which queries select."""
    return table(spark, sf_dir, "kreport").filter(F.col("rank") == "D").agg(F.min(F.trim("name"))).first()[0]


def _domains(spark: SparkSession, sf_dir: str) -> list[str]:
    """The lineages of all domains that occur; a bounded list."""
    names = table(spark, sf_dir, "kreport").filter((F.col("rank") == "D") & F.col("name").isNotNull()).select(F.ltrim("name").alias("name")).distinct()
    return sorted(f"d__{r['name']}" for r in names.collect())


def _lineage_text(column: str = "lineage") -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["rank"], x["taxid"], x["taxon"])), "|")


def report_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select("report_id", "row_id", "rank", "taxid", "taxon", "level", _lineage_text().alias("lineage"))


def taxonomy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = taxonomy.filter_taxonomy(_report(spark, sf_dir), [f"D__{_domain(spark, sf_dir)}"])
    return kept.select("report_id", "row_id", "taxid", "taxon", "total_reads")


def select_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxids at or below a family, inside one domain."""
    return taxonomy.select_taxa(_report(spark, sf_dir), [f"D__{_domain(spark, sf_dir)}"], ranks=["F"])


def select_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.select_taxa(_report(spark, sf_dir), ranks=["G", "S"], descendants=False)


def select_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxids at or below the rows of the first domain's name and the first domain's taxid; missing values don't count."""
    first = table(spark, sf_dir, "kreport").filter((F.col("rank") == "D") & (F.trim("name") == _domain(spark, sf_dir)))
    return taxonomy.select_taxa(_report(spark, sf_dir), taxa=[_domain(spark, sf_dir), None], taxids=[None, first.agg(F.min("taxid")).first()[0]])


def rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineages' names with a column for every rank that occurs in reports or in UMIs' lineages."""
    own = table(spark, sf_dir, "kreport").select(F.array("rank").alias("ranks"))
    ranks = denoise.observed_ranks(own.unionByName(table(spark, sf_dir, "umi").select("ranks")))
    return taxonomy.rank_columns(_report(spark, sf_dir), ranks, ["report_id", "row_id", "taxid"])


def rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks that occur, with their place in hierarchical order and their full names."""
    ranks = table(spark, sf_dir, "kreport").select("rank").filter(F.col("rank").isNotNull()).distinct()
    place = F.row_number().over(Window.orderBy(ranks_of.order_key(F.col("rank")), "rank"))  # a few dozen rows
    return ranks.select("rank", place.alias("place"), ranks_of.full_name(F.col("rank")).alias("full_name"))


def koutput_taxids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "koutput").select("koutput_id", extract.taxid_of("taxid_text").alias("taxid"))


def _included(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.select_taxa(_report(spark, sf_dir), [f"D__{_domain(spark, sf_dir)}"])


def koutput_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified rows of one domain without k-mers of the host, by substrings as the reports' tools look for it."""
    kept = extract.filter_koutput(table(spark, sf_dir, "koutput"), _included(spark, sf_dir), HOST, classified_only=True)
    return kept.select("koutput_id", "id", "taxid", "lca")


def koutput_filter_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = extract.filter_koutput(table(spark, sf_dir, "koutput"), _included(spark, sf_dir), HOST, mode="exact")
    return kept.select("koutput_id", "taxid")


def _classified_reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Single-end classifications with a taxid, and a read for each of their ids."""
    rows = table(spark, sf_dir, "koutput").withColumn("taxid", extract.taxid_of("taxid_text"))
    rows = rows.filter(F.col("taxid").isNotNull() & F.col("length").rlike("^[0-9]+$"))
    length = F.min(F.struct("taxid", "lca", "length"))["length"].cast("int")
    reads = rows.groupBy("id").agg(length.alias("n")).select("id", F.lit(None).cast("string").alias("desc"), F.rpad(F.lit("A"), F.col("n"), F.lit("CGTA")).alias("seq"), F.rpad(F.lit("I"), F.col("n"), F.lit("I")).alias("qual"))
    return rows, reads


def koutreads_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, reads = _classified_reads(spark, sf_dir)
    joined = koutreads.join_reads(rows, reads, {"UMI": R.seq_range(1, 12)})
    return joined.select("id", "taxid", F.col("tags")["UMI"].alias("umi"), "lca", "seq", "qual")


def reads_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose id is among the classified ones of one domain."""
    _, reads = _classified_reads(spark, sf_dir)
    ids = extract.filter_koutput(table(spark, sf_dir, "koutput"), _included(spark, sf_dir)).select("id")
    return extract.extract_reads(reads, ids).select("id", "seq")


def _classified_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Classifications of pairs with a taxid, and a pair for each of their ids."""
    rows = table(spark, sf_dir, "koutput").withColumn("taxid", extract.taxid_of("taxid_text"))
    rows = rows.filter(F.col("taxid").isNotNull() & F.col("length").rlike("^[0-9]+[:|][0-9]+$"))
    least = F.split(F.min(F.struct("taxid", "lca", "length"))["length"], "[:|]")
    ids = rows.groupBy("id").agg(F.get(least, F.lit(0)).cast("int").alias("n1"), F.get(least, F.lit(1)).cast("int").alias("n2"))
    tags = F.substring(F.translate(F.md5("id"), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 28)
    seq1, seq2 = F.concat(tags, F.rpad(F.lit("A"), F.col("n1"), F.lit("CGTA"))), F.rpad(F.lit("T"), F.col("n2"), F.lit("GCAT"))
    quals = [F.repeat(F.lit(q), F.length(seq)) for q, seq in (("I", seq1), ("J", seq2))]
    mates = [x for m, seq, qual in ((1, seq1, quals[0]), (2, seq2, quals[1])) for x in (F.lit(None).cast("string").alias(f"desc{m}"), seq.alias(f"seq{m}"), qual.alias(f"qual{m}"))]
    return rows, ids.select("id", *mates)


def koutreads_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with their classification: barcode and UMI cut off mate 1, then read back from the descriptions."""
    rows, pairs = _classified_pairs(spark, sf_dir)
    pairs = refine.refine_pair(pairs, barcode1=R.seq_range(1, 16), umi1=R.seq_range(17, 28))
    joined = koutreads.join_pairs(rows, pairs)
    return joined.select("id", "taxid", F.col("tags")["BARCODE"].alias("barcode"), F.col("tags")["UMI"].alias("umi"), "lca", "seq", "qual")


def refined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of both mates in both descriptions, equal labels put together; each mate trimmed by its own ranges."""
    _, pairs = _classified_pairs(spark, sf_dir)
    pairs = pairs.withColumn("desc2", F.lit("m2"))
    out = refine.refine_pair(pairs, barcode1=R.seq_range(1, 16), umi1=R.seq_range(17, 28), umi2=R.embed("UMI", R.seq_range(end=3)), extra2=R.seq_range(2, 5), prefix="T")
    return out.select("id", "desc1", "seq1", "qual1", "desc2", "seq2", "qual2")


def koutreads_pair_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of pairs: those of mate 2's description hold over mate 1's, and those of the ranges over both."""
    rows, pairs = _classified_pairs(spark, sf_dir)
    pairs = refine.refine_pair(pairs, barcode1=R.seq_range(1, 16), umi1=R.seq_range(17, 28))
    own = F.concat(F.lit(refine.TAG_PREFIX + "{UMI:"), F.reverse(F.substring("seq2", 1, 4)), F.lit(":X:"), F.substring("seq2", 1, 2), F.lit("}"))
    joined = koutreads.join_pairs(rows, pairs.withColumn("desc2", own), {"BOTH": R.seq_range(1, 2)}, [R.tag("BOTH", R.seq_range(3, 5)), R.tag("X", R.seq_range(end=3))])
    return joined.select("id", *[F.col("tags")[t].alias(t.lower()) for t in ("BARCODE", "UMI", "X", "BOTH")])


def koutreads_join_lone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose classification is of mate 2 alone: only that mate is given."""
    rows, reads = _classified_reads(spark, sf_dir)
    mate1 = [F.lit("d").alias("desc1"), F.lit("ACGT").alias("seq1"), F.lit("IIII").alias("qual1")]
    pairs = reads.select("id", *mate1, *[F.col(c).alias(f"{c}2") for c in ("desc", "seq", "qual")])
    return koutreads.join_pairs(rows, pairs).select("id", "taxid", "lca", "seq", "qual")


def reads_extract_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose id is among the classified ones of one domain."""
    _, pairs = _classified_pairs(spark, sf_dir)
    ids = extract.filter_koutput(table(spark, sf_dir, "koutput"), _included(spark, sf_dir)).select("id")
    return extract.extract_reads(pairs, ids).select("id", "seq1", "seq2")


def _cell_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of every umi row: barcode, UMI and 64 bases of its taxon (one of 97 places), some of one base only."""
    place = F.concat(F.coalesce("taxid", F.lit("0")), F.lit(":"), (F.col("umi_id") % 97).cast("string"))
    bases = F.translate(F.concat(F.md5(place), F.md5(F.concat(place, F.lit("+")))), "0123456789abcdef", "ACGTACGTACGTACGT")
    insert = F.when(F.col("umi_id") % 61 == 0, F.repeat(F.lit("A"), F.lit(64))).otherwise(bases)
    qual = F.concat(F.repeat(F.lit("I"), F.lit(63)), F.when(F.col("umi_id") % 53 == 0, F.lit("4")).otherwise(F.lit("5")))
    barcode, umi = F.coalesce("barcode", F.lit("")), F.coalesce("umi", F.lit(""))
    rows = table(spark, sf_dir, "umi").select("umi_id", "taxid", barcode.alias("barcode"), umi.alias("umi"), insert.alias("insert"), qual.alias("insert_qual"))
    return rows.withColumn("seq", F.concat("barcode", "umi", "insert"))


def refined_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UMI and barcode embedded and trimmed, two more bases trimmed."""
    reads = _cell_reads(spark, sf_dir).select("umi_id", F.lit("x").alias("desc"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
    out = refine.refine(reads, umi=R.seq_range(17, 22), barcode=R.seq_range(end=16), extra=R.trim(R.seq_range(22, 24)), prefix="T")
    return out.select("umi_id", "desc", "seq", "qual")


def refined_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags read back from the descriptions."""
    tags = refine.parse_tags(F.col("desc"), "T")
    return refined_reads(spark, sf_dir).select("umi_id", tags["UMI"].alias("umi"), tags["BARCODE"].alias("barcode"))


def _koutreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell reads as classified reads, their tags cut off, with 34 k-mers (of 31 bases) each.

    They are written once, as classified reads are: else the optimizer would make their bases anew for every use of them.
    """
    tags = F.create_map(F.lit("BARCODE"), F.col("barcode"), F.lit("UMI"), F.col("umi"))
    lca = F.concat(F.coalesce("taxid", F.lit("0")), F.lit(":20 0:14"))
    rows = _cell_reads(spark, sf_dir).select("umi_id", "taxid", tags.alias("tags"), lca.alias("lca"), F.col("insert").alias("seq"), F.col("insert_qual").alias("qual"))
    return checkpointed(rows.repartition("umi_id"))


def read_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each cell read passes the complexity filter and the quality filter."""
    return _koutreads(spark, sf_dir).select("umi_id", krcount.passes_complexity("seq").alias("complex"), krcount.passes_quality("qual").alias("good"))


def read_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _koutreads(spark, sf_dir).select("taxid", F.explode_outer(krcount.kmers("lca", "seq")).alias("kmer"))
    return rows.groupBy("taxid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kmer").alias("n_unique"))


def krcount_umi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UMIs, k-mers and distinct k-mers of every barcode and ancestor."""
    return krcount.count_reads(_koutreads(spark, sf_dir), _report(spark, sf_dir), "BARCODE", "UMI")


def krcount_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and k-mers of every ancestor, without barcodes and UMIs."""
    return krcount.count_reads(_koutreads(spark, sf_dir), _report(spark, sf_dir))


def krcount_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of genera and species only."""
    return krcount.count_reads(_koutreads(spark, sf_dir), _report(spark, sf_dir), ranks=["G", "S"])


def krcount_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of pairs, each read cut into mates of 32 bases with two k-mers each."""
    mates = lambda c: F.concat_ws(" ", F.substring(c, 1, 32), F.substring(c, 33, 32))
    taxid = F.coalesce("taxid", F.lit("0"))
    lca = F.concat(taxid, F.lit(":2 |:| A:1 "), taxid, F.lit(":1"))
    rows = _koutreads(spark, sf_dir).withColumns({"seq": mates(F.col("seq")), "qual": mates(F.col("qual")), "lca": lca})
    return krcount.count_reads(rows, _report(spark, sf_dir), "BARCODE", "UMI")


#: Barcodes that the matrix has columns for.
CELLS = ["AGCACGAGATCCTTCA", "GTCGGCAGGTTCCAAG", "CATCTGGACTGTGGGA", "NNNNNNNNNNNNNNNN"]


def krcount_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UMIs of all taxa as a matrix, with a column for each of a few given barcodes."""
    return krcount.count_matrix(krcount_umi(spark, sf_dir), "reads", CELLS)


def taxa_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a column for every rank that occurs."""
    rows = table(spark, sf_dir, "umi")
    return denoise.taxa_counts(rows, denoise.observed_ranks(rows), "sample_id")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as samples. Their lineages are made once: the tests look at them several times."""
    return checkpointed(_report(spark, sf_dir).withColumn("sample", F.col("report_id").cast("string")))


def _microbes(spark: SparkSession, sf_dir: str) -> list[str]:
    return [f"d__{_domain(spark, sf_dir)}"]


def rpmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denoise.rpmm(_samples(spark, sf_dir), _microbes(spark, sf_dir)).withColumn("rpmm", F.round("rpmm", 6))


def rpmm_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rpmm of the rows of every domain."""
    return denoise.rpmm(_samples(spark, sf_dir), _domains(spark, sf_dir)).withColumn("rpmm", F.round("rpmm", 6))


def _quantile_test(spark: SparkSession, sf_dir: str, taxa: list[str]) -> denoise.QuantileTest:
    lines = table(spark, sf_dir, "cell_lines").filter(~F.isnan("rpmm"))
    return denoise.quantile_test(_samples(spark, sf_dir), lines, taxa=taxa, quantile=0.5)


def quantile_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantile_test(spark, sf_dir, _microbes(spark, sf_dir)).pvalues.withColumn("pvalue", F.round("pvalue", 9))


def quantile_test_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantile test of the taxa of every domain."""
    return _quantile_test(spark, sf_dir, _domains(spark, sf_dir)).pvalues.withColumn("pvalue", F.round("pvalue", 9))


def quantile_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantile_test(spark, sf_dir, _microbes(spark, sf_dir)).unmatched


def quantile_unmatched_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantile_test(spark, sf_dir, _domains(spark, sf_dir)).unmatched


def quantile_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test of all domains against the 0.95 quantile, to each side."""
    out, samples, taxa = None, _samples(spark, sf_dir), _domains(spark, sf_dir)
    lines = table(spark, sf_dir, "cell_lines").filter(~F.isnan("rpmm"))
    for side in ("less", "greater", "two.sided"):
        p = denoise.quantile_test(samples, lines, taxa=taxa, alternative=side).pvalues
        p = p.select(F.lit(side).alias("alternative"), "taxid", "taxon", "reference", F.round("pvalue", 9).alias("pvalue"))
        out = p if out is None else out.unionByName(p)
    return out


def quantile_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for a density plot of the taxa that are truly present at alpha 0.5, by the median of the cell lines."""
    lines = table(spark, sf_dir, "cell_lines").filter(~F.isnan("rpmm"))
    test = denoise.quantile_test(_samples(spark, sf_dir), lines, taxa=_domains(spark, sf_dir), quantile=0.5, alpha=0.5, drop_unmatched=False)
    rows = test.density_frame().withColumns({"rpmm": F.round("rpmm", 6), "log10_rpmm": F.round("log10_rpmm", 6) + 0.0, "pvalue": F.round("pvalue", 9)})
    return rows.groupBy("taxid", "taxon", "study", "rpmm", "log10_rpmm", "pvalue").agg(F.sum("weight").alias("weight"))


#: Methods of adjustment, with the names of their columns.
ADJUSTMENTS = {"holm": "holm", "hochberg": "hochberg", "hommel": "hommel", "bonferroni": "bonferroni", "BH": "bh", "BY": "by", "fdr": "fdr", "none": "raw"}


def _adjusted(test: denoise.QuantileTest) -> DataFrame:
    out = test.pvalues.select("taxid", "taxon", "pvalue")
    for method, name in ADJUSTMENTS.items():
        out = stats.adjust_p(out, "pvalue", method, name=name)
    return out.select("taxid", "taxon", *[F.round(m, 9).alias(m) for m in ("pvalue", *ADJUSTMENTS.values())])


def adjusted_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of the quantile test, adjusted in all ways."""
    return _adjusted(_quantile_test(spark, sf_dir, _microbes(spark, sf_dir)))


def adjusted_p_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of the quantile test over the taxa of every domain, adjusted in all ways."""
    return _adjusted(_quantile_test(spark, sf_dir, _domains(spark, sf_dir)))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) + 0.0 for c in columns})


_SIX = ("r1", "r2", "r3", "p1", "p2", "p3")


def sample_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample-level test, by Spearman's rho."""
    return _rounded(denoise.sample_level(_samples(spark, sf_dir)), *_SIX)


def sample_level_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(denoise.sample_level(_samples(spark, sf_dir), "pearson"), *_SIX)


def sample_level_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(denoise.sample_level(_samples(spark, sf_dir), "kendall"), *_SIX)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "kmer").withColumnRenamed("taxa", "taxon")


def barcode_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The barcode-level test of each sample, by Spearman's rho, p adjusted over the sample's taxa."""
    return _rounded(denoise.barcode_level(_cells(spark, sf_dir), sample="sample_id"), "cor", "pvalue", "padj")


def barcode_level_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(denoise.barcode_level(_cells(spark, sf_dir), "pearson", p_adjust="BY", sample="sample_id"), "cor", "pvalue", "padj")


def barcode_level_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(denoise.barcode_level(_cells(spark, sf_dir), "kendall", sample="sample_id"), "cor", "pvalue", "padj")


def _denoised(spark: SparkSession, sf_dir: str, **limits: object) -> DataFrame:
    reports = checkpointed(_report(spark, sf_dir).withColumnRenamed("sample_id", "sample"))
    kmers = table(spark, sf_dir, "kmer").withColumnsRenamed({"taxa": "taxon", "sample_id": "sample"})
    umis = table(spark, sf_dir, "umi").withColumnRenamed("sample_id", "sample")
    lines = table(spark, sf_dir, "cell_lines").filter(~F.isnan("rpmm"))
    return denoise.denoise_counts(reports, kmers, umis, lines, denoise.observed_ranks(umis), taxa=_domains(spark, sf_dir), **limits).counts


def denoise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over all samples and domains, with the operator's own limits."""
    return _denoised(spark, sf_dir)


#: Wider limits of significance, for tables with few samples and cells of a taxon.
LENIENT = {"drop_unmatched": False, "quantile": 0.5, "alpha": 0.5, "p_threshold": 0.5, "padj_threshold": 0.5}


def denoise_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with wider limits, and with taxa that no cell line has."""
    return _denoised(spark, sf_dir, **LENIENT)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        report_lineage, taxonomy_filter, select_descendants, select_own, select_named, rank_table, rank_order, koutput_taxids, koutput_filter, koutput_filter_exact,
        koutreads_join, reads_extract, koutreads_join_pairs, koutreads_pair_tags, koutreads_join_lone, reads_extract_pairs, refined_reads, refined_pairs, refined_tags,
        read_filters, read_kmers, krcount_umi, krcount_bulk, krcount_ranks, krcount_pairs, krcount_matrix, taxa_counts,
        rpmm, rpmm_domains, quantile_test, quantile_test_domains, quantile_unmatched, quantile_unmatched_domains, quantile_sides, quantile_density, adjusted_p, adjusted_p_domains,
        sample_level, sample_level_pearson, sample_level_kendall, barcode_level, barcode_level_pearson, barcode_level_kendall, denoise_counts, denoise_lenient,
    )
}

_TREE = """
WITH RECURSIVE k AS (
  SELECT *, ((length(name) - length(ltrim(name, ' '))) // 2)::INTEGER AS level, ltrim(name, ' ') AS taxon FROM kreport WHERE NOT starts_with(rank, 'U')
), parents AS (
  SELECT a.report_id, a.row_id, b.row_id AS parent
  FROM k a ASOF LEFT JOIN (SELECT * FROM k WHERE NOT starts_with(rank, 'R')) b ON a.report_id = b.report_id AND a.level - 1 = b.level AND a.row_id > b.row_id
), lined AS (
  SELECT k.row_id, [{'rank': k.rank, 'taxid': k.taxid, 'taxon': k.taxon}] AS lineage FROM k JOIN parents p USING (row_id) WHERE p.parent IS NULL
  UNION ALL
  SELECT k.row_id, list_append(l.lineage, {'rank': k.rank, 'taxid': k.taxid, 'taxon': k.taxon}) FROM lined l JOIN parents p ON p.parent = l.row_id JOIN k ON k.row_id = p.row_id
), report AS (
  SELECT k.*, l.lineage FROM k JOIN lined l USING (row_id)
), first_domain AS (
  SELECT min(trim(name)) AS d FROM kreport WHERE rank = 'D'
), inside AS (
  SELECT * FROM report, first_domain WHERE len(list_filter(lineage, lambda x: x.rank = 'D' AND x.taxon = d)) > 0
)"""
_TAXID = "CASE WHEN contains(taxid_text, '(taxid ') THEN nullif(regexp_extract(taxid_text, '\\(taxid ([^)]*)\\)', 1), '') ELSE taxid_text END"
_CELLS = """placed_reads AS (
  SELECT umi_id, taxid, coalesce(barcode, '') AS barcode, coalesce(umi, '') AS umi, coalesce(taxid, '0') || ':' || (umi_id % 97) AS place FROM umi
), cells AS (
  SELECT *, barcode || umi || "insert" AS seq FROM (
    SELECT umi_id, taxid, barcode, umi, CASE WHEN umi_id % 61 = 0 THEN repeat('A', 64) ELSE translate(md5(place) || md5(place || '+'), '0123456789abcdef', 'ACGTACGTACGTACGT') END AS "insert",
      repeat('I', 63) || CASE WHEN umi_id % 53 = 0 THEN '4' ELSE '5' END AS qual FROM placed_reads)
)"""
_READS = f"""named AS (
  SELECT *, {_TAXID} AS taxid FROM koutput
), single AS (
  SELECT id, min({{'taxid': taxid, 'a': lca IS NOT NULL, 'lca': lca, 'length': length}}) AS x FROM named WHERE taxid IS NOT NULL AND regexp_full_match(length, '[0-9]+') GROUP BY id
), reads AS (
  SELECT id, x.taxid AS taxid, x.lca AS lca, rpad('A', x.length::INTEGER, 'CGTA') AS seq, rpad('I', x.length::INTEGER, 'I') AS qual FROM single
)"""
_PAIRS = f"""named AS (
  SELECT *, {_TAXID} AS taxid FROM koutput
), paired AS (
  SELECT id, min({{'taxid': taxid, 'a': lca IS NOT NULL, 'lca': lca, 'length': length}}) AS x FROM named WHERE taxid IS NOT NULL AND regexp_full_match(length, '[0-9]+[|:][0-9]+') GROUP BY id
), pairs AS (
  SELECT id, x.taxid AS taxid, x.lca AS lca, translate(md5(id), '0123456789abcdef', 'ACGTACGTACGTACGT')[1:28] AS tags,
    rpad('A', regexp_extract(x.length, '^[0-9]+')::INTEGER, 'CGTA') AS mate1, rpad('T', regexp_extract(x.length, '[0-9]+$')::INTEGER, 'GCAT') AS mate2 FROM paired
)"""
_MOST = "list_max(list_transform(list_distinct(string_split({0}, '')), lambda b: length({0}) - length(replace({0}, b, ''))))"
_PASSES = f"(length({{0}}) < 20 OR {_MOST} <= length({{0}}) - 20)"
_GOOD = "NOT regexp_matches(qual, '[\\x00-\\x34]')"
_UP = "up AS (SELECT DISTINCT taxid, unnest(list_transform(lineage, lambda x: x.taxid)) AS ancestor FROM report)"
_RANKED_UP = "up AS (SELECT DISTINCT taxid, unnest(list_transform(list_filter(lineage, lambda x: x.rank IN ('G', 'S')), lambda x: x.taxid)) AS ancestor FROM report)"
_WINDOWS = """list_transform(range(1, 35), lambda i: substr("insert", i, 31))"""
_KMERS = f"""kept AS (SELECT *, {_WINDOWS} AS kmers FROM cells WHERE {_PASSES.format('"insert"')} AND {_GOOD})"""
_PAIR_KMERS = f"""kept AS (
  SELECT *, list_transform([1, 2, 33, 34], lambda i: substr("insert", i, 31)) AS kmers FROM cells WHERE {_PASSES.format('"insert"[1:32]')} AND {_PASSES.format('"insert"[33:]')} AND {_GOOD}
)"""
_COUNTED = """SELECT {barcode} AS barcode, ancestor AS taxid, {reads} AS reads, sum(len(kmers))::BIGINT AS kmer_total, len(list_distinct(flatten(list(kmers)))) AS kmer_unique
FROM kept JOIN up USING (taxid) GROUP BY {by}"""
_CELL_COUNTS = _COUNTED.format(barcode="barcode", reads="count(DISTINCT umi)", by="barcode, ancestor")
_RPMM = """totals AS (
  SELECT report_id, sum(total_reads) AS t FROM report, first_domain WHERE rank = 'D' AND taxon = d GROUP BY report_id
), own AS (
  SELECT i.report_id, taxid, taxon, total_reads / t::DOUBLE * 1e6 AS rpmm FROM inside i LEFT JOIN totals USING (report_id)
)"""
_REFERENCE = """weights AS (
  SELECT taxid, count(*) AS w FROM own GROUP BY taxid
), spread AS (
  SELECT taxid, rpmm, count(*) * any_value(w) AS c FROM cell_lines JOIN weights USING (taxid) WHERE rpmm IS NOT NULL AND NOT isnan(rpmm) GROUP BY taxid, rpmm
), placed AS (
  SELECT *, sum(c) OVER (PARTITION BY taxid ORDER BY rpmm ROWS UNBOUNDED PRECEDING) AS u, sum(c) OVER (PARTITION BY taxid) AS n FROM spread
), ref AS (
  SELECT taxid, min(rpmm) AS reference FROM placed WHERE u > round({quantile} * (n - 1)) GROUP BY taxid
), tests AS (
  SELECT taxid, taxon, reference, count(*) FILTER (rpmm < reference) AS below, count(*) FILTER (rpmm <= reference) AS upto, count(rpmm) AS n FROM own LEFT JOIN ref USING (taxid) GROUP BY ALL
), sides AS (
  SELECT taxid, taxon, reference, CASE WHEN reference IS NOT NULL THEN coalesce(list_sum(list_transform(range(0, upto + 1), lambda i: chance(i))), 0) END AS greater,
    CASE WHEN reference IS NOT NULL THEN coalesce(list_sum(list_transform(range(below, n + 1), lambda i: chance(i))), 0) END AS less FROM tests
), pvalues AS (
  SELECT taxid, taxon, reference, greater AS pvalue FROM sides
)""".replace("chance(i)", "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))")
_TEST = f"{_RPMM}, {_REFERENCE.format(quantile=0.5)}"

_ENOUGH = """enough AS (
  SELECT * FROM (SELECT taxid, taxon, total_reads, minimizer_len, minimizer_n_unique, count(*) OVER (PARTITION BY taxid, taxon) AS c FROM report WHERE total_reads >= 3 AND minimizer_n_unique >= 3) WHERE c >= 3
)"""
_VARIED = """varied AS (
  SELECT * FROM (SELECT sample_id, taxid, taxa AS taxon, kmer_len, kmer_n_unique, count(*) OVER (PARTITION BY sample_id, taxid, taxa) AS c FROM kmer WHERE kmer_len >= 3) WHERE c >= 3
)"""
_PAIRS_OF_SAMPLES = (("minimizer_len", "minimizer_n_unique"), ("minimizer_len", "total_reads"), ("total_reads", "minimizer_n_unique"))


def _sample_tests(method: Callable[..., str]) -> str:
    """CTEs up to ``samples``: the sample-level test."""
    each = ", ".join(method(f"c{i}", "enough", "taxid, taxon", x, y) for i, (x, y) in enumerate(_PAIRS_OF_SAMPLES, 1))
    joins = " ".join(f"LEFT JOIN c{i} ON c{i}.taxid IS NOT DISTINCT FROM g.taxid AND c{i}.taxon IS NOT DISTINCT FROM g.taxon" for i in (1, 2, 3))
    shown = ", ".join(f"c{i}.{c} AS {c}{i}" for c in "rp" for i in (1, 2, 3))
    return f"{_ENOUGH}, {each}, samples AS (SELECT g.taxid, g.taxon, {shown} FROM (SELECT DISTINCT taxid, taxon FROM enough) g {joins})"


def _cell_tests(method: Callable[..., str], adjustment: str = "BH") -> str:
    """CTEs up to ``barcodes``: the barcode-level test of each sample."""
    keys = ("sample_id", "taxid", "taxon")
    same = " AND ".join(f"c.{k} IS NOT DISTINCT FROM g.{k}" for k in keys)
    return f"""{_VARIED}, {method("c", "varied", ", ".join(keys), "kmer_len", "kmer_n_unique")}, cors AS (
  SELECT g.*, c.r AS cor, c.p AS pvalue FROM (SELECT DISTINCT sample_id, taxid, taxon FROM varied) g LEFT JOIN c ON {same}
), numbered AS (
  SELECT *, count(pvalue) OVER (PARTITION BY sample_id) AS n, row_number() OVER (PARTITION BY sample_id, pvalue IS NULL ORDER BY pvalue) AS i FROM cors
), barcodes AS (
  SELECT sample_id, taxid, taxon, cor, pvalue, {tests_sql.adjusted("pvalue", "sample_id", adjustment)} AS padj FROM numbered WHERE pvalue IS NOT NULL
  UNION ALL SELECT sample_id, taxid, taxon, cor, NULL, NULL FROM numbered WHERE pvalue IS NULL
)"""


def _nine(*columns: str) -> str:
    return ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in columns)


# every rank code that the tables have, spelled out
_COUNTS = """SELECT {sample}, barcode, taxid, taxa, rank, taxon[nullif(list_position(ranks, 'D'), 0)] AS "domain", taxon[nullif(list_position(ranks, 'K'), 0)] AS kingdom,
  taxon[nullif(list_position(ranks, 'P'), 0)] AS phylum, taxon[nullif(list_position(ranks, 'P1'), 0)] AS phylum1, taxon[nullif(list_position(ranks, 'C'), 0)] AS "class",
  taxon[nullif(list_position(ranks, 'C1'), 0)] AS class1, taxon[nullif(list_position(ranks, 'O'), 0)] AS "order", taxon[nullif(list_position(ranks, 'O1'), 0)] AS order1,
  taxon[nullif(list_position(ranks, 'F'), 0)] AS family, taxon[nullif(list_position(ranks, 'F1'), 0)] AS family1, taxon[nullif(list_position(ranks, 'G'), 0)] AS genus,
  taxon[nullif(list_position(ranks, 'G1'), 0)] AS genus1, taxon[nullif(list_position(ranks, 'S'), 0)] AS species, taxon[nullif(list_position(ranks, 'S1'), 0)] AS species1,
  taxon[nullif(list_position(ranks, 'S2'), 0)] AS species2, counts
FROM (SELECT sample_id, barcode, taxid, taxa, rank, taxon, ranks, count(DISTINCT umi) + max((umi IS NULL)::INTEGER) AS counts FROM umi {where} GROUP BY ALL)"""


def _denoise_sql(quantile: float, alpha: float, p: float, padj: float, unmatched: bool) -> str:
    missing = " OR reference IS NULL" if unmatched else ""
    good = " AND ".join(f"r{i} > 0 AND p{i} < {p}" for i in (1, 2, 3))
    real = f"""real_taxa AS (
  SELECT DISTINCT sample_id, taxid FROM barcodes WHERE padj < {padj} AND taxid IN (SELECT taxid FROM samples WHERE {good}) AND taxid IN (SELECT taxid FROM pvalues WHERE pvalue < {alpha}{missing})
)"""
    where = "WHERE (sample_id, taxid) IN (SELECT sample_id, taxid FROM real_taxa)"
    return f"""{_TREE_DOMAINS}, {tests_sql.NULLS}, {_RPMM_DOMAINS}, {_REFERENCE.format(quantile=quantile)}, {_sample_tests(tests_sql.spearman)}, {_cell_tests(tests_sql.spearman)}, {real}
""" + _COUNTS.format(sample="sample_id AS sample", where=where)


_HOMMEL = """levels AS (
  SELECT m, min(m * q.pvalue / (q.i - n + m)) AS inside, min(m * q.pvalue / (q.i - n + m)) FILTER (q.i - n + m > 1) AS outside
  FROM placed_p q, (SELECT unnest(range(1, max(n) + 1)) AS m FROM placed_p) WHERE q.pvalue IS NOT NULL AND q.i > n - m GROUP BY m
), hommels AS (
  SELECT i, least(1, max(CASE WHEN i > n - m THEN inside ELSE least(m * pvalue, coalesce(outside, m * pvalue)) END)) AS hommel FROM placed_p, levels WHERE pvalue IS NOT NULL GROUP BY i
)"""
#: The tests over the rows of every domain.
_TREE_DOMAINS = _TREE.replace("SELECT * FROM report, first_domain WHERE len(list_filter(lineage, lambda x: x.rank = 'D' AND x.taxon = d)) > 0", "SELECT * FROM report WHERE len(list_filter(lineage, lambda x: x.rank = 'D')) > 0")
_RPMM_DOMAINS = _RPMM.replace("FROM report, first_domain WHERE rank = 'D' AND taxon = d", "FROM report WHERE rank = 'D'")

SQL: dict[str, str] = {
    "report_lineage": _TREE
    + "\nSELECT report_id, row_id, rank, taxid, taxon, level, array_to_string(list_transform(lineage, lambda x: x.rank || ':' || x.taxid || ':' || x.taxon), '|') AS lineage FROM report",
    "taxonomy_filter": _TREE + "\nSELECT report_id, row_id, taxid, taxon, total_reads FROM inside",
    "select_descendants": _TREE
    + """, each AS (
  SELECT taxid, unnest(list_transform(lineage, lambda x: x.taxid)) AS above FROM inside
)
SELECT DISTINCT taxid FROM each WHERE above IN (SELECT taxid FROM inside WHERE rank = 'F')""",
    "select_own": "SELECT DISTINCT taxid FROM kreport WHERE rank IN ('G', 'S')",
    "select_named": _TREE
    + """
SELECT DISTINCT taxid FROM (SELECT taxid, unnest(list_transform(lineage, lambda x: x.taxid)) AS above FROM report)
WHERE above IN (SELECT min(k.taxid) FROM kreport k, first_domain WHERE k.rank = 'D' AND trim(k.name) = d)""",
    "rank_table": _TREE
    + "\nSELECT report_id, row_id, taxid, "
    + ", ".join(f"list_filter(lineage, lambda x: x.rank = '{r}')[1].taxon AS \"{r}\"" for r in ("D", "K", "P", "P1", "C", "C1", "O", "O1", "F", "F1", "G", "G1", "S", "S1", "S2"))
    + " FROM report",
    "rank_order": """
SELECT rank, row_number() OVER (ORDER BY position(rank[1] IN 'URDKPCOFGS'), coalesce(try_cast(nullif(rank[2:], '') AS INTEGER), 0), rank)::INTEGER AS place,
  CASE rank[1] WHEN 'R' THEN 'root' WHEN 'D' THEN 'domain' WHEN 'K' THEN 'kingdom' WHEN 'P' THEN 'phylum' WHEN 'C' THEN 'class' WHEN 'O' THEN 'order'
    WHEN 'F' THEN 'family' WHEN 'G' THEN 'genus' WHEN 'S' THEN 'species' ELSE rank[1] END || rank[2:] AS full_name
FROM (SELECT DISTINCT rank FROM kreport WHERE rank IS NOT NULL)""",
    "koutput_taxids": f"SELECT koutput_id, {_TAXID} AS taxid FROM koutput",
    "koutput_filter": f"""{_TREE}
SELECT koutput_id, id, {_TAXID} AS taxid, lca FROM koutput
WHERE status = 'C' AND NOT coalesce(contains(lca, '2831896:') OR contains(lca, '322656:'), false) AND {_TAXID} IN (SELECT taxid FROM inside)""",
    "koutput_filter_exact": f"""{_TREE}
SELECT koutput_id, {_TAXID} AS taxid FROM koutput
WHERE NOT coalesce(regexp_matches(lca, '(^|[^0-9A-Za-z])(2831896|322656):'), false) AND {_TAXID} IN (SELECT taxid FROM inside)""",
    "koutreads_join": f"WITH {_READS}\nSELECT id, taxid, seq[1:12] AS umi, lca, seq, qual FROM reads",
    "reads_extract": f"{_TREE}, {_READS}\nSELECT id, seq FROM reads WHERE id IN (SELECT id FROM named WHERE taxid IN (SELECT taxid FROM inside))",
    "koutreads_join_pairs": f"""WITH {_PAIRS}
SELECT id, taxid, tags[1:16] AS barcode, tags[17:28] AS umi, lca, mate1 || ' ' || mate2 AS seq, repeat('I', length(mate1)) || ' ' || repeat('J', length(mate2)) AS qual FROM pairs""",
    "refined_pairs": f"""WITH {_PAIRS}
SELECT id, 'T{{UMI:' || tags[17:28] || mate2[1:3] || ':BARCODE:' || tags[1:16] || '}}' AS desc1, mate1 AS seq1, repeat('I', length(mate1)) AS qual1,
  'm2 T{{UMI:' || tags[17:28] || mate2[1:3] || ':BARCODE:' || tags[1:16] || '}}' AS desc2, mate2[1:1] || mate2[6:] AS seq2, repeat('J', length(mate2) - 4) AS qual2 FROM pairs""",
    "koutreads_pair_tags": f"""WITH {_PAIRS}
SELECT id, tags[1:16] AS barcode, reverse(mate2[1:4]) AS umi, mate2[1:3] AS x, mate1[1:2] || mate2[3:5] AS "both" FROM pairs""",
    "koutreads_join_lone": f"WITH {_READS}\nSELECT id, taxid, lca, seq, qual FROM reads",
    "reads_extract_pairs": f"{_TREE}, {_PAIRS}\nSELECT id, tags || mate1 AS seq1, mate2 AS seq2 FROM pairs WHERE id IN (SELECT id FROM named WHERE taxid IN (SELECT taxid FROM inside))",
    "refined_reads": f"WITH {_CELLS}\nSELECT umi_id, 'x T{{UMI:' || seq[17:22] || ':BARCODE:' || seq[1:16] || '}}' AS \"desc\", seq[25:] AS seq, repeat('I', length(seq) - 24) AS qual FROM cells",
    "refined_tags": f"WITH {_CELLS}\nSELECT umi_id, seq[17:22] AS umi, seq[1:16] AS barcode FROM cells",
    "read_filters": f"""WITH {_CELLS}\nSELECT umi_id, {_PASSES.format('"insert"')} AS complex, {_GOOD} AS good FROM cells""",
    "read_kmers": f"WITH {_CELLS}\nSELECT taxid, count(*) AS n, count(DISTINCT kmer) AS n_unique FROM (SELECT taxid, unnest({_WINDOWS}) AS kmer FROM cells) GROUP BY taxid",
    "krcount_umi": f"{_TREE}, {_CELLS}, {_UP}, {_KMERS}\n{_CELL_COUNTS}",
    "krcount_bulk": f"{_TREE}, {_CELLS}, {_UP}, {_KMERS}\n" + _COUNTED.format(barcode="''", reads="count(*)", by="ancestor"),
    "krcount_ranks": f"{_TREE}, {_CELLS}, {_RANKED_UP}, {_KMERS}\n" + _COUNTED.format(barcode="''", reads="count(*)", by="ancestor"),
    "krcount_pairs": f"{_TREE}, {_CELLS}, {_UP}, {_PAIR_KMERS}\n{_CELL_COUNTS}",
    "krcount_matrix": f"{_TREE}, {_CELLS}, {_UP}, {_KMERS}, counted AS ({_CELL_COUNTS})\nSELECT taxid, "
    + ", ".join(f"max(reads) FILTER (barcode = '{b}') AS \"{b}\"" for b in CELLS)
    + " FROM counted GROUP BY taxid",
    "taxa_counts": _COUNTS.format(sample="sample_id", where=""),
    "denoise_counts": _denoise_sql(0.95, 0.05, 0.05, 0.05, False),
    "denoise_lenient": _denoise_sql(0.5, 0.5, 0.5, 0.5, True),
    "rpmm": f"{_TREE}, {_RPMM}\nSELECT report_id::VARCHAR AS sample, taxid, taxon, round(rpmm, 6) AS rpmm FROM own",
    "quantile_test": f"{_TREE}, {_TEST}\nSELECT taxid, taxon, reference, round(pvalue, 9) AS pvalue FROM pvalues",
    "quantile_unmatched": f"{_TREE}, {_TEST}\nSELECT DISTINCT taxid FROM pvalues WHERE reference IS NULL",
    "quantile_sides": f"""{_TREE_DOMAINS}, {_RPMM_DOMAINS}, {_REFERENCE.format(quantile=0.95)}
SELECT 'less' AS alternative, taxid, taxon, reference, round(less, 9) AS pvalue FROM sides
UNION ALL SELECT 'greater', taxid, taxon, reference, round(greater, 9) FROM sides UNION ALL SELECT 'two.sided', taxid, taxon, reference, round(2 * least(less, greater), 9) FROM sides""",
    "quantile_density": f"""{_TREE_DOMAINS}, {_RPMM_DOMAINS}, {_REFERENCE.format(quantile=0.5)}, shown AS (
  SELECT taxid, min(pvalue) AS pvalue FROM pvalues GROUP BY taxid HAVING min(pvalue) < 0.5 AND count(*) FILTER (reference IS NULL) = 0
), points AS (
  SELECT taxid, taxon, 'current study' AS study, rpmm FROM own UNION ALL SELECT o.taxid, o.taxon, 'cell lines', c.rpmm FROM own o JOIN cell_lines c USING (taxid) WHERE c.rpmm IS NOT NULL AND NOT isnan(c.rpmm)
)
SELECT taxid, taxon, study, round(rpmm, 6) AS rpmm, CASE WHEN rpmm > 0 THEN round(log10(rpmm), 6) + 0.0 END AS log10_rpmm, round(pvalue, 9) AS pvalue, count(*) AS weight
FROM points JOIN shown USING (taxid) GROUP BY ALL""",
    "adjusted_p": f"""{_TREE}, {_TEST}, placed_p AS (
  SELECT *, count(pvalue) OVER () AS n, CASE WHEN pvalue IS NOT NULL THEN row_number() OVER (PARTITION BY pvalue IS NULL ORDER BY pvalue, taxid, taxon) END AS i FROM pvalues
), {_HOMMEL}, adjusted AS (
  SELECT p.*, hommel, least(1, max((n - i + 1) * pvalue) OVER up) AS holm, least(1, min((n - i + 1) * pvalue) OVER down) AS hochberg, least(1, n * pvalue) AS bonferroni,
    {tests_sql.adjusted("pvalue", "", "BH")} AS bh, {tests_sql.adjusted("pvalue", "", "BY")} AS "by"
  FROM placed_p p JOIN hommels USING (i) WHERE pvalue IS NOT NULL WINDOW up AS (ORDER BY i ROWS UNBOUNDED PRECEDING), down AS (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)
)
SELECT taxid, taxon, round(pvalue, 9) AS pvalue, round(holm, 9) AS holm, round(hochberg, 9) AS hochberg, round(hommel, 9) AS hommel, round(bonferroni, 9) AS bonferroni, round(bh, 9) AS bh,
  round("by", 9) AS "by", round(bh, 9) AS fdr, round(pvalue, 9) AS raw FROM adjusted
UNION ALL SELECT taxid, taxon, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pvalues WHERE pvalue IS NULL""",
    **{
        f"sample_level{suffix}": f"{_TREE}, {tests_sql.NULLS}, {_sample_tests(method)}\nSELECT taxid, taxon, {_nine(*_SIX)} FROM samples"
        for suffix, method in (("", tests_sql.spearman), ("_pearson", tests_sql.pearson), ("_kendall", tests_sql.kendall))
    },
    **{
        f"barcode_level{suffix}": f"WITH RECURSIVE {tests_sql.NULLS}, {_cell_tests(method, adjustment)}\nSELECT sample_id, taxid, taxon, {_nine('cor', 'pvalue', 'padj')} FROM barcodes"
        for suffix, method, adjustment in (("", tests_sql.spearman, "BH"), ("_pearson", tests_sql.pearson, "BY"), ("_kendall", tests_sql.kendall, "BH"))
    },
}

SQL |= {f"{name}_domains": SQL[name].replace(_TREE, _TREE_DOMAINS).replace(_RPMM, _RPMM_DOMAINS) for name in ("rpmm", "quantile_test", "quantile_unmatched", "adjusted_p")}
