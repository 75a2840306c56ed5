"""Exact distinct counts for any combination of groups, from membership patterns.

Each identifier is reduced to its pattern, the set of groups (cells) that contain it. Identifiers with identical patterns
are counted together, and the number of distinct identifiers in any union of cells is the total of the patterns that meet
it. The counts are exact: the error bound is 0.

No set is larger than MAX_CELLS: the cells of an identifier that has more are cut into pieces that keep its name, and an
identifier with a large share of the rows, whose cells no single task should meet, stays as one row for each cell.

Partial results of days or partitions are rows of identifiers with their cells in that part. They merge by putting an
identifier's cells together, whatever identifiers the parts have in common.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An identifier with a larger share of the rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
_TRACKED = 16_384
#: Cells of one set at most.
MAX_CELLS = 1_024
_SEP, _NULL = "\x01", "\x02"


def hot_identifiers(pairs: DataFrame, share: float = HOT_SHARE) -> list[str]:
    """Identifiers that may hold ``share`` of the rows, all that do among them, from a mergeable sketch of bounded size."""
    most = int(2 / share)
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(id, {most}, {_TRACKED})").alias("top")).first()
    return [x["item"] for x in row["top"] or [] if x["item"] is not None and x["count"] >= share * row["n"] / 2]


@dataclass(frozen=True)
class Patterns:
    """``rows``: ``cells`` (sorted array of structs of the dimensions), ``id`` and ``n``. Where ``id`` is null, ``n``
    identifiers have just these cells; else they are some of the cells of that one identifier. ``dims``: the dimensions' names."""

    rows: DataFrame
    dims: tuple[str, ...]

    def merge(self, other: Patterns) -> Patterns:
        """Patterns of both, which must have no identifier in common (as shards by a hash of the identifier)."""
        return Patterns(self.rows.unionByName(other.rows).groupBy("id", "cells").agg(F.sum("n").alias("n")), self.dims)

    def count_where(self, chosen) -> DataFrame:  # noqa: ANN001 - a function from {dimension: Column} to a condition
        """``n_distinct``, one row: the identifiers in the union of all cells for which ``chosen`` holds."""
        met = self.rows.filter(F.exists("cells", lambda c: F.coalesce(chosen({d: c[d] for d in self.dims}), F.lit(False))))
        each = met.groupBy("id").agg(F.sum("n").alias("n")).select(_weight())
        return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_distinct"))

    def count_groups(self) -> DataFrame:
        """Distinct identifiers of every group of every subset of the dimensions, the whole included.

        Rows: ``by_<dimension>`` (whether grouped by it), the dimensions (null where not grouped by), ``n_distinct``.
        """
        sets = list(product((False, True), repeat=len(self.dims)))

        def coded(cell) -> list[Column]:  # noqa: ANN001 - a code of the cell's group in each set
            texts = [F.coalesce(cell(d).cast("string"), F.lit(_NULL)) for d in self.dims]
            return [F.concat_ws(_SEP, F.lit("".join("1" if b else "0" for b in s)), *[t for t, b in zip(texts, s) if b]) for s in sets]

        def groups_of(i: int) -> Column:
            return F.array_distinct(F.transform("cells", lambda c: coded(lambda d: c[d])[i]))

        each = self.rows.select("id", "n", F.explode(F.concat(*[groups_of(i) for i in range(len(sets))])).alias("g"))
        named = each.groupBy("id", "g").agg(F.sum("n").alias("n")).select("g", _weight())
        sums = named.groupBy("g").agg(F.sum("n").alias("n_distinct")).withColumn("x", F.split("g", _SEP))
        kinds = self.rows.schema["cells"].dataType.elementType
        out = [F.col("n_distinct")]
        for i, d in enumerate(self.dims):
            by = F.substring(F.col("x")[0], i + 1, 1) == "1"
            # the dimension's place among those of its set
            place = F.length(F.replace(F.substring(F.col("x")[0], 1, i + 1), F.lit("0"), F.lit("")))
            text = F.get(F.col("x"), place)
            out += [by.alias(f"by_{d}"), F.when(by & (text != _NULL), text).cast(kinds[d].dataType).alias(d)]
        return sums.select(*out)


def _weight() -> Column:
    """Identifiers that a sum of ``n`` stands for: a named one counts once, in however many pieces it lies."""
    return F.when(F.col("id").isNull(), F.col("n")).otherwise(F.lit(1)).alias("n")


def _in_pieces(pairs: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """``keys``, ``cells`` (sorted, at most MAX_CELLS) and ``whole`` (whether these are all) from rows of keys and dimensions.

    One shuffle by ``keys``; what has too many cells for one set is cut by their order, without being gathered.
    """
    own = Window.partitionBy(*keys)
    rows = pairs.repartition(*keys).groupBy(*keys, *dims).agg(F.count(F.lit(1)).alias("__rows"))
    rows = rows.withColumns({"__n": F.count(F.lit(1)).over(own), "__i": F.row_number().over(own.orderBy(*dims))})
    rows = rows.withColumn("__piece", F.when(F.col("__n") > MAX_CELLS, F.floor((F.col("__i") - 1) / MAX_CELLS)).otherwise(0))
    cells = F.sort_array(F.collect_list(F.struct(*dims))).alias("cells")
    return rows.groupBy(*keys, "__piece").agg(cells, (F.max("__n") <= MAX_CELLS).alias("whole")).drop("__piece")


def _pairs(df: DataFrame, identifier: str, dims: dict[str, Column], **more: Column) -> DataFrame:
    known = df.filter(F.col(f"`{identifier}`").isNotNull())
    return known.select(F.col(f"`{identifier}`").cast("string").alias("id"), *[e.alias(d) for d, e in dims.items()], *[e.alias(c) for c, e in more.items()])


def _patterns(pairs: DataFrame, dims: list[str]) -> Patterns:
    hot_ids = hot_identifiers(pairs)
    cold = pairs.filter(~F.col("id").isin(hot_ids)) if hot_ids else pairs
    sets = _in_pieces(cold, ["id"], dims)
    rows = sets.groupBy(F.when(~F.col("whole"), F.col("id")).alias("id"), "cells").agg(F.count(F.lit(1)).alias("n"))
    if hot_ids:
        hot = pairs.filter(F.col("id").isin(hot_ids)).distinct()
        rows = rows.unionByName(hot.select("id", F.array(F.struct(*dims)).alias("cells"), F.lit(1).cast("bigint").alias("n")))
    return Patterns(rows, tuple(dims))


def membership_patterns(df: DataFrame, identifier: str, dims: dict[str, Column]) -> Patterns:
    """The patterns of ``identifier`` over cells of ``dims`` (names and expressions over ``df``).

    Null identifiers do not count; all others count as stored, the empty text too. A null dimension is a group of its own,
    told from an empty text. Repeated rows change nothing; an empty table has no patterns. Dimensions must not hold the
    control characters 1 and 2. Other columns are not read.
    """
    return _patterns(_pairs(df, identifier, dims), list(dims))


def partial_patterns(df: DataFrame, identifier: str, dims: dict[str, Column], part: Column | None = None) -> DataFrame:
    """The partial result of some rows, or of each value of ``part``: ``part`` (null if none), ``id`` and ``cells``.

    It can be stored, and merged with any others by :func:`merge_partials`. Nulls, ties and so on as in
    :func:`membership_patterns`. An identifier's cells in one part are bounded by the part's rows, and lie in pieces.
    """
    pairs = _pairs(df, identifier, dims, part=F.lit(None).cast("string") if part is None else part)
    return _in_pieces(pairs, ["part", "id"], list(dims)).drop("whole")


def merge_partials(parts: list[DataFrame]) -> Patterns:
    """The patterns of all rows that went into the partial results, which may have identifiers and cells in common."""
    rows = parts[0].select("id", "cells")
    for p in parts[1:]:
        rows = rows.unionByName(p.select("id", "cells"))
    dims = [f.name for f in rows.schema["cells"].dataType.elementType]
    return _patterns(rows.select("id", F.inline("cells")), dims)
