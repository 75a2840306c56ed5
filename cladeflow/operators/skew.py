"""Per-key results where a few keys hold most rows: two-stage aggregation with salted heavy keys."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("count", "count_value", "sum", "min", "max", "avg", "count_distinct")


@dataclass(frozen=True)
class Agg:
    """One aggregate: ``kind`` of KINDS over ``column`` (any column for ``count``, which counts rows), named ``name``."""

    name: str
    kind: str
    column: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown aggregate {self.kind!r}; one of {', '.join(KINDS)}")
        if self.kind != "count" and self.column is None:
            raise ValueError(f"{self.kind} needs a column")


def heavy_keys(df: DataFrame, key: str, share: float) -> tuple[list[object], int]:
    """Keys, not null, that hold at least ``share`` of all rows, and the number of rows.

    At most ``1 / share`` keys, whatever the size. Counts are combined before the shuffle, so that a hot key sends one
    row per task.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    counts = df.select(F.col(f"`{key}`").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    rows = counts.filter(F.col("k").isNotNull() & (F.col("n") >= least_rows(share, total))).collect()
    return [r["k"] for r in rows], total


def least_rows(share: float, total: int) -> int:
    """The smallest number of rows that is at least ``share`` of ``total``."""
    return math.ceil(Fraction(str(share)) * total)


def _salt(key: Column, heavy: list[object], salts: int, seed: int) -> Column:
    if not heavy:
        return F.lit(0)
    # seeded by partition: a scan partition that is computed again draws the same salts
    return F.when(key.isin(heavy), F.floor(F.rand(seed) * salts).cast("int")).otherwise(F.lit(0))


def salted_aggregate(
    df: DataFrame,
    key: str,
    aggregates: list[Agg],
    share: float = 0.01,
    salts: int | None = None,
    seed: int = 17,
    heavy: list[object] | None = None,
) -> DataFrame:
    """One row per value of ``key``, named ``key_value``, with ``aggregates``, complete however skewed the keys are.

    Keys with at least ``share`` of all rows get a random salt of ``salts`` (the session's shuffle partitions if None);
    stage one aggregates per key and salt, stage two merges the partial results per key. Distinct values of a heavy key
    are spread by the value itself, so that each is counted by one task only.

    A null key is a key of its own, as is an empty text. Nulls are ignored by all kinds but ``count``; where a key has no
    value, sum, min, max and avg are null and the counts 0. Repeated rows count each time; no rows give no rows. Other
    columns of ``df`` are not read.
    """
    spark = df.sparkSession
    salts = salts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    heavy = heavy_keys(df, key, share)[0] if heavy is None else heavy
    columns = list(dict.fromkeys(a.column for a in aggregates if a.column is not None))
    short = {c: f"c{i}" for i, c in enumerate(columns)}
    base = df.select(F.col(f"`{key}`").alias("k"), *[F.col(f"`{c}`").alias(short[c]) for c in columns])
    plain = [a for a in aggregates if a.kind != "count_distinct"]
    partial: list[Column] = [F.count(F.lit(1)).alias("p_rows")]
    merged: list[Column] = []
    for i, a in enumerate(plain):
        value = F.col(short[a.column]) if a.column else None
        if a.kind == "count":
            merged.append(F.sum("p_rows").alias(a.name))
        elif a.kind == "count_value":
            partial.append(F.count(value).alias(f"p{i}"))
            merged.append(F.sum(f"p{i}").alias(a.name))
        elif a.kind == "avg":
            partial += [F.sum(value).alias(f"p{i}"), F.count(value).alias(f"q{i}")]
            merged.append(F.try_divide(F.sum(f"p{i}"), F.sum(f"q{i}")).alias(a.name))
        else:
            f = {"sum": F.sum, "min": F.min, "max": F.max}[a.kind]
            partial.append(f(value).alias(f"p{i}"))
            merged.append(f(f"p{i}").alias(a.name))
    k = F.col("k")
    first = base.withColumn("salt", _salt(k, heavy, salts, seed)).groupBy("k", "salt").agg(*partial)
    out = first.groupBy("k").agg(F.sum("p_rows").alias("p_rows"), *merged)
    for a in aggregates:
        if a.kind != "count_distinct":
            continue
        value = F.col(short[a.column])
        spread = F.when(k.isin(heavy), F.pmod(F.xxhash64(value), F.lit(salts))).otherwise(F.lit(0)) if heavy else F.lit(0)
        # a group holds one value of one key, the key's values are then counted per salt, and the counts added per key
        values = base.filter(value.isNotNull()).select(k, spread.alias("salt"), value.alias("v")).distinct()
        counts = values.groupBy("k", "salt").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.sum("n").alias(a.name))
        counts = counts.select(F.col("k").alias("k2"), a.name)
        out = out.join(counts, F.col("k").eqNullSafe(F.col("k2")), "left").drop("k2").withColumn(a.name, F.coalesce(a.name, F.lit(0)))
    return out.select(F.col("k").alias("key_value"), *[F.col(f"`{a.name}`") for a in aggregates])


def keys_holding(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys, as stored and not null, with at least ``share`` of all rows: ``key_value`` and ``n``.

    The counts are those of :func:`salted_aggregate`; rows with a null key belong to the whole.
    """
    heavy, total = heavy_keys(df, key, share)
    counts = salted_aggregate(df, key, [Agg("n", "count")], share=share, heavy=heavy)
    return counts.filter(F.col("key_value").isNotNull() & (F.col("n") >= least_rows(share, total)))
