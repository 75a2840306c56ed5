"""Report rows with their lineage, and selection of taxa by it.

A report here is a DataFrame with ``rank, taxid, name`` (indented by two spaces per level) and counts; rows of many reports
are told apart by key columns. ``lineage`` is an array of ``struct<rank, taxid, taxon>`` from the highest ancestor down to
the row itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINEAGE = T.ArrayType(T.StructType([T.StructField("rank", T.StringType()), T.StructField("taxid", T.StringType()), T.StructField("taxon", T.StringType())]))


def add_lineage(report: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The classified rows of reports with ``taxon`` (the name without indent), ``level`` and ``lineage``.

    A row's parent is the last row before it, of the same report (``by``) in ``order``, that is one level up, unless a row
    between has closed it. Rows of ranks ``R...`` are nobody's ancestors; rows of ranks ``U...`` and of null rank are left
    out. Reports of any length pass through a task row by row, with only the open ancestors kept.
    """
    indent = F.length("name") - F.length(F.ltrim(F.col("name")))
    rows = report.filter(~F.col("rank").startswith("U")).drop("taxon", "level", "lineage")
    rows = rows.withColumns({"taxon": F.ltrim(F.coalesce(F.col("name"), F.lit(""))), "level": F.coalesce(F.floor(indent / 2), F.lit(0)).cast("int")})
    placed = rows.repartition(*by).sortWithinPartitions(*by, *order)
    schema = T.StructType([*placed.schema.fields, T.StructField("lineage", LINEAGE)])
    kind = pa.list_(pa.struct([("rank", pa.string()), ("taxid", pa.string()), ("taxon", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_rows = object(), []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*by, "level", "rank", "taxid", "taxon")]
            lineages = []
            for row in zip(*columns):
                key, (level, rank, taxid, taxon) = row[: len(by)], row[len(by) :]
                if key != current:
                    current, open_rows = key, []
                while open_rows and open_rows[-1][0] != level - 1:
                    open_rows.pop()
                own = {"rank": rank, "taxid": taxid, "taxon": taxon}
                lineages.append([*(x for _, x in open_rows), own])
                if not rank.startswith("R"):
                    open_rows.append((level, own))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lineages, kind)], names=schema.names)

    return placed.mapInArrow(run, schema)


def matches_taxonomy(taxonomy: list[str], lineage: Column | str = "lineage", lower: bool = False) -> Column:
    """Whether some part of the lineage is one of ``taxonomy``, texts ``rank__name`` compared exactly.

    With ``lower`` the lineage's ranks are taken in lower case. Texts without ``__`` are ignored; none valid is an error.
    """
    wanted = [t for t in taxonomy if t is not None and "__" in t]
    if not wanted:
        raise ValueError("taxonomy has no text of the form rank__name")
    return F.exists(lineage, lambda x: F.concat(F.lower(x["rank"]) if lower else x["rank"], F.lit("__"), x["taxon"]).isin(wanted))


def filter_taxonomy(report: DataFrame, taxonomy: list[str] | None, check: bool = False) -> DataFrame:
    """Rows with a lineage in ``taxonomy``; all if it is None. With ``check`` no such row is an error (this runs a job)."""
    if taxonomy is None:
        return report
    kept = report.filter(matches_taxonomy(taxonomy))
    if check and kept.isEmpty():
        raise ValueError("no row of the report matches the taxonomy")
    return kept


def given(values: list[str | None] | None) -> list[str] | None:
    """Argument values without missing ones; None if there are none."""
    kept = [v for v in values or [] if v is not None]
    return kept or None


def select_taxa(
    report: DataFrame,
    taxonomy: list[str] | None = None,
    ranks: list[str] | None = None,
    taxa: list[str] | None = None,
    taxids: list[str] | None = None,
    descendants: bool = True,
) -> DataFrame:
    """Distinct ``taxid`` of the rows in ``taxonomy`` whose own rank, taxon and taxid are among those given.

    With ``descendants`` also of all rows (in ``taxonomy``) with one of these in their lineage. At least one argument must
    be given.
    """
    chosen = {"rank": given(ranks), "taxon": given(taxa), "taxid": given(taxids)}
    taxonomy = given(taxonomy)
    if taxonomy is None and not any(chosen.values()):
        raise ValueError("at least one of taxonomy, ranks, taxa and taxids must be given")
    inside = filter_taxonomy(report, taxonomy)
    if not any(chosen.values()):
        return inside.select("taxid").distinct()
    own = inside
    for column, values in chosen.items():
        if values:
            own = own.filter(F.col(column).isin(values))
    targets = own.select("taxid").distinct()
    if not descendants:
        return targets
    every = inside.select("taxid", F.explode(F.array_distinct(F.transform("lineage", lambda x: x["taxid"]))).alias("above")).distinct()
    return every.join(targets.select(F.col("taxid").alias("above")), "above", "left_semi").select("taxid").distinct()


def taxon_at(rank: str, lineage: Column | str = "lineage") -> Column:
    """The taxon of the first lineage entry of a rank, null without one."""
    return F.get(F.filter(lineage, lambda x: x["rank"] == F.lit(rank)), F.lit(0))["taxon"]


def rank_columns(report: DataFrame, ranks: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and a column for each of ``ranks`` with the row's taxon at it. Nothing is shuffled."""
    return report.select(*keep, *[taxon_at(r).alias(r) for r in ranks])


def lineage_of(ranks: Column | str, taxa: Column | str) -> Column:
    """A lineage from parallel arrays of ranks and taxa (without taxids)."""
    zipped = F.arrays_zip(F.col(ranks) if isinstance(ranks, str) else ranks, F.col(taxa) if isinstance(taxa, str) else taxa)
    return F.transform(zipped, lambda x: F.struct(x["0"].alias("rank"), F.lit(None).cast("string").alias("taxid"), x["1"].alias("taxon")))
