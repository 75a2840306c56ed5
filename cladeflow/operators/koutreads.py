"""Classification rows joined with their reads into one relation: taxid, tags, lca, seq, qual."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranges as R
from . import refine


def one_per_id(koutput: DataFrame) -> DataFrame:
    """``id, taxid, lca, length`` of each id's smallest row by (taxid, lca, length)."""
    least = F.min(F.struct("taxid", "lca", "length")).alias("x")
    return koutput.groupBy("id").agg(least).select("id", "x.*")


def over(base: Column, newer: Column) -> Column:
    """Both maps' entries; where both have a key, the newer one's."""
    return F.map_zip_with(base, newer, lambda k, a, b: F.coalesce(b, a))


def _fail(condition: Column, message: Column | str, value: Column) -> Column:
    return F.when(condition, F.raise_error(message)).otherwise(value)


def _range_tags(sequences: list[Column], tags: list[list[R.Tag]]) -> Column | None:
    parts: dict[str, Column] = {}
    for seq, found in zip(sequences, tags):
        for t in found:
            part = R.extracted(seq, t.ranges)
            parts[t.label] = F.concat(parts[t.label], part) if t.label in parts else part
    if not parts:
        return None
    return F.create_map(*[x for label, seq in parts.items() for x in (F.lit(label), seq)])


def join_reads(koutput: DataFrame, reads: DataFrame, tags: object = None, prefix: str = refine.TAG_PREFIX) -> DataFrame:
    """Single reads with their classification (``id, taxid, lca, length``), one row per read.

    The length given must be that of the read; a pair of lengths is an error. Tags come from the description, and over
    these from ``tags``, labelled ranges of the bases. Reads without a classification are left out.
    """
    joined = reads.join(one_per_id(koutput), "id")
    length, seq = F.col("length"), F.col("seq")
    paired = length.rlike("[:|]")
    differs = length.try_cast("bigint") != F.length("seq")
    checked = _fail(paired, F.concat(F.lit("lengths of a pair for the single read "), F.col("id")), _fail(F.coalesce(differs, F.lit(True)), F.concat(F.lit("the length of read "), F.col("id"), F.lit(" differs from its classification's")), seq))
    found = refine.parse_tags(F.coalesce(F.col("desc"), F.lit("")), prefix)
    ranged = _range_tags([seq], [R.tags_for(tags)])
    return joined.select("id", "taxid", (found if ranged is None else over(found, ranged)).alias("tags"), "lca", checked.alias("seq"), "qual")


def join_pairs(koutput: DataFrame, reads: DataFrame, tags1: object = None, tags2: object = None, prefix: str = refine.TAG_PREFIX) -> DataFrame:
    """Paired reads with their classification, one row per pair; ``seq`` and ``qual`` hold both mates with a space between.

    The lengths ``l1|l2`` (or ``l1:l2``) must be those of the mates. A lone length is that of mate 2, and only mate 2 is
    then given. Tags: description of mate 1, over these of mate 2, over these those of the ranges.
    """
    joined = reads.join(one_per_id(koutput), "id")
    parts = F.split("length", "[:|]")
    n1, n2 = F.get(parts, F.lit(0)).try_cast("bigint"), F.get(parts, F.lit(1)).try_cast("bigint")
    lone = F.size(parts) == 1
    good = F.when(lone, n1 == F.length("seq2")).otherwise((n1 == F.length("seq1")) & (n2 == F.length("seq2")))
    bad = ~F.coalesce(good, F.lit(False))
    seq = _fail(bad, F.concat(F.lit("the lengths of pair "), F.col("id"), F.lit(" differ from its classification's")), F.when(lone, F.col("seq2")).otherwise(F.concat_ws(" ", "seq1", "seq2")))
    maps = [refine.parse_tags(F.coalesce(F.col(f"desc{m}"), F.lit("")), prefix) for m in (1, 2)]
    ranged = _range_tags([F.col("seq1"), F.col("seq2")], [R.tags_for(tags1), R.tags_for(tags2)])
    found = reduce(over, [*maps, *([] if ranged is None else [ranged])])
    return joined.select("id", "taxid", found.alias("tags"), "lca", seq.alias("seq"), F.when(lone, F.col("qual2")).otherwise(F.concat_ws(" ", "qual1", "qual2")).alias("qual"))
