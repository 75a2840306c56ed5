"""Reads, UMIs, k-mers and distinct k-mers for every barcode and every ancestor taxon.

The canonical result is long, one row per (barcode, taxid); matrices are pivots of it on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from ..session import checkpointed
from .extract import lca_pairs

#: Lowest quality character that passes: Phred 20 in Phred+33.
MIN_QUALITY = 53
#: Bases that a read needs besides its commonest one.
MIN_OTHER = 20
BASES = "ACGTN"


def passes_quality(qual: Column | str, lowest: int = MIN_QUALITY) -> Column:
    """Whether all quality characters are at least ``lowest``; the space between mates is none of them."""
    qual = F.col(qual) if isinstance(qual, str) else qual
    return ~F.replace(qual, F.lit(" "), F.lit("")).rlike(f"[\\x00-\\x{lowest - 1:02x}]")


def passes_complexity(seq: Column | str, others: int = MIN_OTHER) -> Column:
    """Whether no base makes up more than ``length - others`` of the read; reads shorter than that pass.

    Mates are judged each on their own.
    """
    seq = F.col(seq) if isinstance(seq, str) else seq

    def one(s: Column) -> Column:
        n = F.length(s)
        counts = [n - F.length(F.replace(s, F.lit(b), F.lit(""))) for b in BASES]
        rest = F.length(F.translate(s, BASES, ""))
        # the usual bases are counted without lambdas; others one by one only if together they are too many
        any_of = F.array_max(F.transform(F.array_distinct(F.split(s, "")), lambda b: n - F.length(F.replace(s, b, F.lit("")))))
        most = F.when(rest > n - others, any_of).otherwise(F.greatest(*counts))
        return (n < others) | (most <= n - others)

    single = one(seq)
    return F.when(F.contains(seq, F.lit(" ")), F.forall(F.split(seq, " "), one)).otherwise(single)


def _checked_total(lca: Column, seq: Column) -> Column:
    """Number of k-mers of a mate's list, an error if the mate can't have as many."""
    total = F.aggregate(lca_pairs(F.trim(lca)), F.lit(0).cast("bigint"), lambda a, p: a + p["n"])

    def checked(n: Column) -> Column:
        message = F.concat(F.lit("k-mers of the LCA list don't fit the read: "), n.cast("string"))
        return F.when((n < 1) | (n > F.length(seq)), F.raise_error(message).cast("bigint")).otherwise(n)

    return let(total, checked)


def _windows(seq: Column, n: Column) -> Column:
    return let((F.length(seq) + 1 - n).cast("int"), lambda k: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.substr(seq, i, k)))


def _mates(lca: Column | str, seq: Column | str) -> Column:
    """``array<struct<l, s>>``: list and bases of each mate, an error unless there are as many of both."""
    lca = F.col(lca) if isinstance(lca, str) else lca
    seq = F.col(seq) if isinstance(seq, str) else seq
    lists, reads = F.split(lca, r"\|:\|"), F.split(seq, " ")
    mates = F.arrays_zip(lists.alias("l"), reads.alias("s"))
    mismatch = F.raise_error("the LCA list and the read don't both have two mates").cast("array<struct<l:string,s:string>>")
    return F.when(F.size(lists) != F.size(reads), mismatch).otherwise(mates)


def kmers(lca: Column | str, seq: Column | str) -> Column:
    """All k-mers of a read in order, of a pair those of mate 1 and then mate 2.

    k follows from the read's length and the number of k-mers in its LCA list; a list with none, or more than the read has
    bases, is an error, as is a pair's list without a pair of reads.
    """
    return F.flatten(F.transform(_mates(lca, seq), lambda x: let(_checked_total(x["l"], x["s"]), lambda n: _windows(x["s"], n))))


def kmer_count(lca: Column | str, seq: Column | str) -> Column:
    """The number of :func:`kmers`, without making them."""
    return F.aggregate(_mates(lca, seq), F.lit(0).cast("bigint"), lambda a, x: a + _checked_total(x["l"], x["s"]))


def ancestors(report: DataFrame, ranks: list[str] | None = None) -> DataFrame:
    """One row for each ``taxid`` that a report has, with ``ancestors``: the taxids of its lineages, itself included, of
    ``ranks`` if given (none may be left)."""
    parts = F.col("lineage") if ranks is None else F.filter("lineage", lambda x: x["rank"].isin(ranks))
    each = report.filter(F.col("taxid").isNotNull()).select("taxid", F.explode_outer(F.transform(parts, lambda x: x["taxid"])).alias("a")).distinct()
    return each.groupBy("taxid").agg(F.sort_array(F.collect_set("a")).alias("ancestors"))


def tag_value(label: str | None) -> Column:
    """The tag's value; the empty text if no label is given, an error where a row lacks the tag."""
    if label is None:
        return F.lit("")
    value = F.try_element_at("tags", F.lit(label))
    return F.when(value.isNull(), F.raise_error(F.lit(f"a read has no tag {label}"))).otherwise(value)


def count_reads(koutreads: DataFrame, report: DataFrame, barcode_tag: str | None = None, umi_tag: str | None = None, ranks: list[str] | None = None) -> DataFrame:
    """``barcode, taxid, reads, kmer_total, kmer_unique`` for all taxa with reads below them.

    ``koutreads`` has taxid, tags, lca, seq, qual; ``report`` has taxid and lineage. ``reads`` counts distinct UMIs where
    ``umi_tag`` is given. Reads that fail the quality or the complexity filter, and those of taxids that the report doesn't
    have, are left out before tags and lists are looked at. With ``ranks`` only ancestors of these ranks are counted.

    Reads are looked at once: each gives its k-mers, its UMI and its sums as values of the barcode. Equal values of a taxid
    are put together before the first shuffle; the second brings the taxids of a value together. Values of the same
    taxids are then counted, and only these counts fan out to ancestors: a deep lineage multiplies counts, not reads or
    k-mers. The report's lineages are made once and kept in the shared checkpoint folder; a taxonomy is small beside reads.
    """
    taxonomy = checkpointed(ancestors(report, ranks).withColumn("tax", F.monotonically_increasing_id()))
    reads = koutreads.filter(passes_quality("qual") & passes_complexity("seq")).join(taxonomy.select("taxid", "tax"), "taxid")
    sums, kmer, umi = 0, 1, 2
    # explode_outer and coalesce: from explode, and from a join on columns that might be null, the optimizer would infer
    # conditions on lists and tags, and so look at those of reads that the filters leave out
    mates = reads.select(F.coalesce(tag_value(barcode_tag), F.lit("")).alias("barcode"), "tax", tag_value(umi_tag).alias("umi"), F.posexplode_outer(_mates("lca", "seq")).alias("mate", "x"))
    mates = mates.select("barcode", "tax", "umi", "mate", F.col("x.s").alias("s"), _checked_total(F.col("x.l"), F.col("x.s")).alias("kmers"))
    # place 0 of a mate stands for its sums, place -1 of mate 1 for the UMI, the others are those of k-mers
    first = F.when(F.col("mate") == 0, F.lit(0 if umi_tag is None else -1)).otherwise(F.lit(0))
    each = mates.select("*", F.explode_outer(F.sequence(first, F.col("kmers").cast("int"))).alias("i"))
    i = F.col("i")
    # the value of sums is the taxid, so that it has no other
    text = F.when(i > 0, F.substr("s", i, (F.length("s") + 1 - F.col("kmers")).cast("int"))).when(i == -1, F.col("umi")).otherwise(F.col("tax").cast("string"))
    kind = F.when(i > 0, F.lit(kmer)).when(i == -1, F.lit(umi)).otherwise(F.lit(sums))
    read = F.when((i == 0) & (F.col("mate") == 0), F.lit(1)).otherwise(F.lit(0))
    each = each.select("barcode", kind.alias("kind"), F.coalesce(text, F.lit("")).alias("text"), "tax", F.when(i == 0, F.col("kmers")).otherwise(F.lit(0)).alias("n"), read.alias("reads"))
    value = ["barcode", "kind", "text"]
    own = each.groupBy(*value, "tax").agg(F.sum("n").alias("n"), F.sum("reads").alias("reads")).repartition(*value)
    sets = own.groupBy(*value).agg(F.min("tax").alias("low"), F.max("tax").alias("high"), F.count(F.lit(1)).alias("taxa"), F.sum("n").alias("n"), F.sum("reads").alias("reads"))
    different = F.count(F.lit(1)).alias("different")
    # two taxids at most are all told by the least and the greatest; only sets of more are gathered
    few = sets.filter("taxa <= 2").groupBy("barcode", "kind", "low", "high").agg(different, F.sum("n").alias("n"), F.sum("reads").alias("reads"))
    few = few.withColumn("set", F.array_distinct(F.array("low", "high"))).drop("low", "high")
    # all columns of the shuffle are used on either side, so that the plan has it once
    large = sets.filter("taxa > 2 AND low < high").select(*value, F.col("n").alias("n_all"), F.col("reads").alias("reads_all"))
    gathered = own.join(large.hint("shuffle_hash"), value).groupBy(*value).agg(
        F.sort_array(F.collect_set("tax")).alias("set"),
        F.greatest(F.sum("n"), F.max("n_all")).alias("n"),
        F.greatest(F.sum("reads"), F.max("reads_all")).alias("reads"),
    )
    many = gathered.groupBy("barcode", "kind", "set").agg(different, F.sum("n").alias("n"), F.sum("reads").alias("reads"))
    counts = few.unionByName(many).withColumn("tax", F.explode("set"))
    up = counts.join(taxonomy.select("tax", "ancestors"), "tax").drop("tax")
    up = up.withColumn("ancestor", F.explode("ancestors")).drop("ancestors").distinct()
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)))
    number = of(sums, "reads") if umi_tag is None else of(umi, "different")
    out = up.groupBy("barcode", "ancestor").agg(number.alias("reads"), of(sums, "n").alias("kmer_total"), of(kmer, "different").alias("kmer_unique"))
    return out.select("barcode", F.col("ancestor").alias("taxid"), "reads", "kmer_total", "kmer_unique")


def count_matrix(counts: DataFrame, value: str, barcodes: list[str]) -> DataFrame:
    """A row per taxid with a column per barcode, null where there is no count."""
    return counts.groupBy("taxid").pivot("barcode", barcodes).agg(F.first(value))
