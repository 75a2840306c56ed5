"""Classification rows by taxon and host, and the reads they name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def taxid_of(text: Column | str) -> Column:
    """The taxid of a plain or use-names field; null where the name's taxid is cut short."""
    text = F.col(text) if isinstance(text, str) else text
    named = F.regexp_extract(text, r"\(taxid ([^)]*)\)", 1)
    return F.when(F.contains(text, F.lit("(taxid ")), F.nullif(named, F.lit(""))).otherwise(text)


def lca_pairs(lca: Column | str) -> Column:
    """``array<struct<taxid, n>>`` of a space-separated list of pairs; the mate mark gives none. A broken pair is an error."""
    lca = F.col(lca) if isinstance(lca, str) else lca
    tokens = F.filter(F.split(lca, " +"), lambda t: (t != "") & (t != "|:|"))

    def pair(t: Column) -> Column:
        bad = F.raise_error(F.concat(F.lit("an LCA list has a broken pair: "), t)).cast("bigint")
        n = F.coalesce(F.split_part(t, F.lit(":"), F.lit(2)).try_cast("bigint"), bad)
        return F.struct(F.substring_index(t, ":", 1).alias("taxid"), n.alias("n"))

    return F.transform(tokens, pair)


def names_host(lca: Column | str, hosts: list[str], mode: str = "substring") -> Column:
    """Whether an LCA list has k-mers of a host taxid.

    ``substring`` looks for ``<taxid>:`` anywhere, so that 9606 is also found in 19606; ``exact`` compares whole taxids.
    """
    lca = F.col(lca) if isinstance(lca, str) else lca
    if mode == "substring":
        return F.coalesce(lca.rlike("(?:" + "|".join(re.escape(h) for h in hosts) + "):"), F.lit(False))
    if mode == "exact":
        return F.coalesce(lca.rlike(r"(?:^|[^0-9A-Za-z])(?:" + "|".join(re.escape(h) for h in hosts) + "):"), F.lit(False))
    raise ValueError("mode must be 'substring' or 'exact'")


def filter_koutput(
    koutput: DataFrame,
    include: DataFrame | None = None,
    exclude: list[str] | None = None,
    mode: str = "substring",
    classified_only: bool = False,
) -> DataFrame:
    """Rows whose taxid is in ``include`` (``taxid``) and whose LCA list has none of ``exclude``, with their ``taxid``.

    Rows without a taxid are left out where ``include`` is given. Cheap conditions come first; ``include`` is broadcast by
    the optimizer only if it is small.
    """
    rows = koutput.filter(F.col("status") == "C") if classified_only else koutput
    rows = rows.withColumn("taxid", taxid_of("taxid_text"))
    if exclude:
        rows = rows.filter(~names_host("lca", exclude, mode))
    return rows if include is None else rows.join(include.select("taxid").distinct(), "taxid", "left_semi")


def extract_reads(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """Reads, or pairs of reads, whose id is one of ``ids`` (``id``); each once, however often the id occurs."""
    return reads.join(ids.select("id"), "id", "left_semi")
