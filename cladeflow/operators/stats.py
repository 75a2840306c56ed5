"""Correlation tests per group, adjustment of p-values, and the quantile test.

Moments and ranks are aggregates and windows; only the tail probabilities of one row per group pass through Arrow batches.
A group may hold most of all rows. No window is ordered within a group's values: these are put into buckets by their size
first, buckets are ordered within a group, and values within a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distributions as D

ALTERNATIVES = ("two.sided", "less", "greater")
METHODS = ("pearson", "spearman", "kendall")
ADJUSTMENTS = ("holm", "hochberg", "hommel", "bonferroni", "BH", "BY", "fdr", "none")


def one_of(value: str, choices: tuple[str, ...], what: str) -> str:
    """The choice that ``value`` is or, if only one does, begins."""
    found = [c for c in choices if c == value] or [c for c in choices if c.startswith(value)]
    if len(found) != 1:
        raise ValueError(f"{what} must be one of {', '.join(choices)}")
    return found[0]


def _tail(t: np.ndarray, df: np.ndarray, alternative: str) -> np.ndarray:
    upper = D.t_upper(t, df)
    return {"greater": upper, "less": 1 - upper}.get(alternative, np.minimum(1, 2 * np.minimum(upper, 1 - upper)))


#: Buckets of values in each doubling.
_STEPS = 4096
#: Rows of a group that a task counts Kendall's pairs of at a time.
STRIP = 1 << 20
_BEFORE = (Window.unboundedPreceding, -1)


def bucket(v: Column) -> Column:
    """A whole number that grows with the value, of some 4,096 for each doubling."""
    size = F.abs(v)
    steps = F.floor(F.log2(size) * _STEPS) + 1100 * _STEPS
    return F.signum(v).cast("bigint") * F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(10**7)).otherwise(steps).cast("bigint")


def _bucket_sums(counts: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``keys``, ``b`` and ``sum``, with ``start`` (the weights of lower buckets) and ``n`` (of all)."""
    sums = counts.groupBy(*keys, "b").agg(F.sum(weight).alias("sum"))
    whole = Window.partitionBy(*keys)
    return sums.withColumns({"start": F.coalesce(F.sum("sum").over(whole.orderBy("b").rowsBetween(*_BEFORE)), F.lit(0)), "n": F.sum("sum").over(whole)})


def placed(counts: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """``counts``, a row for each value of ``keys`` (not null), with ``before``, the weights of smaller values, and ``n``, of all."""
    rows = counts.withColumn("b", bucket(F.col(value)))
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy(*keys, "b").orderBy(value).rowsBetween(*_BEFORE)), F.lit(0))
    starts = _bucket_sums(rows, keys, weight).drop("sum")
    return rows.withColumn("inside", inside).join(starts, [*keys, "b"]).withColumn("before", F.col("start") + F.col("inside")).drop("b", "inside", "start")


def _number(column: str) -> Column:
    """The value as a double; NaN is none."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x + F.lit(0.0))


def _pearson(rows: DataFrame, group: list[str], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """``group``, ``rows`` and ``r{i}, n{i}, tied{i}`` for each pair, by one aggregation."""
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, (x, y, _, _) in enumerate(pairs):
        both = _number(x).isNotNull() & _number(y).isNotNull()
        cx, cy = F.when(both, _number(x)), F.when(both, _number(y))
        aggregates += [F.covar_pop(cx, cy).alias(f"xy{i}"), F.var_pop(cx).alias(f"xx{i}"), F.var_pop(cy).alias(f"yy{i}"), F.count(cx).alias(f"n{i}")]
    sums = rows.groupBy(*group).agg(*aggregates)
    shown = [c for i in range(len(pairs)) for c in (_estimate(f"xy{i}", f"xx{i}", f"yy{i}", f"n{i}").alias(f"r{i}"), F.col(f"n{i}"), F.lit(True).alias(f"tied{i}"))]
    return sums.select(*group, "rows", *shown)


def _estimate(xy: str, xx: str, yy: str, n: str) -> Column:
    ratio = F.try_divide(F.col(xy), F.sqrt(xx) * F.sqrt(yy))
    # within rounding of 1 the estimate is 1: its p would else tell nothing but the rounding
    return F.when((F.col(n) >= 2) & ratio.isNotNull(), F.when(F.abs(ratio) > 1 - 1e-12, F.signum(ratio)).otherwise(ratio))


def _with_ranks(rows: DataFrame, group: list[str], pairs: list[tuple[str, str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs of values of all ``pairs`` in one frame, and the sides' values.

    The first: ``g`` (struct of the group), ``pair``, ``x, y`` (both null where either is), ``c`` rows, and of either side
    the values ``before`` it (``bx, by``), those equal to it (``tx, ty``), and ``n``. The second: ``g, pair, side, t``.
    """
    each = []
    for i, (x, y, _, _) in enumerate(pairs):
        both = _number(x).isNotNull() & _number(y).isNotNull()
        each.append(F.struct(F.lit(i).alias("pair"), F.when(both, _number(x)).alias("x"), F.when(both, _number(y)).alias("y")))
    # equal structs may hold nulls, which equal columns may not
    counts = rows.select(F.struct(*group).alias("g"), F.inline(F.array(*each))).groupBy("g", "pair", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    sides = F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("v")), F.struct(F.lit(1).alias("side"), F.col("y").alias("v"))))
    values = counts.filter(F.col("x").isNotNull()).select("g", "pair", "c", sides).groupBy("g", "pair", "side", "v").agg(F.sum("c").alias("t"))
    ranks = placed(values, ["g", "pair", "side"], "v", "t")
    left = ranks.filter("side = 0").select("g", "pair", F.col("v").alias("x"), F.col("before").alias("bx"), F.col("t").alias("tx"), "n")
    right = ranks.filter("side = 1").select("g", "pair", F.col("v").alias("y"), F.col("before").alias("by"), F.col("t").alias("ty"))
    return counts.join(left, ["g", "pair", "x"], "left").join(right, ["g", "pair", "y"], "left"), values


def _side_by_side(found: DataFrame, group: list[str], pairs: int, columns: list[str]) -> DataFrame:
    """One row per ``g`` from one row per ``g`` and pair: ``group``, ``rows``, and each column with the pair's number."""
    shown = [F.max(F.when(F.col("pair") == i, F.col(c))).alias(f"{c}{i}") for i in range(pairs) for c in columns]
    return found.groupBy("g").agg(F.max("rows").alias("rows"), *shown).select(*[F.col("g")[c].alias(c) for c in group], "rows", *[f"{c}{i}" for i in range(pairs) for c in columns])


def _spearman(rows: DataFrame, group: list[str], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """As :func:`_pearson`, of mean ranks."""
    ranked, _ = _with_ranks(rows, group, pairs)
    # ranks less their mean: before + (t + 1) / 2 - (n + 1) / 2
    x, y = (F.col(b) + (F.col(t) - F.col("n")) / 2 for b, t in (("bx", "tx"), ("by", "ty")))
    c = F.col("c")
    tied = (F.max(F.greatest("tx", "ty")) > 1).alias("tied")
    sums = ranked.groupBy("g", "pair").agg(F.sum(c * x * y).alias("xy"), F.sum(c * x * x).alias("xx"), F.sum(c * y * y).alias("yy"), F.sum(F.when(F.col("x").isNotNull(), c)).alias("n"), tied, F.sum("c").alias("rows"))
    return _side_by_side(sums.withColumn("r", _estimate("xy", "xx", "yy", "n")), group, len(pairs), ["r", "n", "tied"])


def _kendall(rows: DataFrame, group: list[str], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """As :func:`_pearson`, tau-b, with what its p needs: ``s`` and the sums over ties.

    Groups above STRIP rows are cut by rank into strips of x and strips of y. Points in different strips of both are
    counted by the numbers of points of each pair of strips, points in one strip of x by themselves, and points in one
    strip of y by their y and strip of x. A value with more than STRIP rows is a strip of its own, in which all are ties.
    """
    ranked, values = _with_ranks(rows, group, pairs)
    strip = lambda b, t: 2 * F.floor(F.col(b) / STRIP) + F.when(F.col(t) > STRIP, F.lit(1)).otherwise(F.lit(0))
    points = ranked.filter(F.col("x").isNotNull()).select("g", "pair", "c", "x", "y", "n", strip("bx", "tx").alias("kx"), strip("by", "ty").alias("ky"))
    long = F.col("n") > STRIP
    part = lambda kind, k, a, b: F.struct(F.lit(kind).alias("kind"), k.cast("bigint").alias("k"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    kx, ky, x, y = (F.col(c) for c in ("kx", "ky", "x", "y"))
    parts = F.array(F.when(kx % 2 == 0, part(0, kx, x, y)), F.when(long & (ky % 2 == 0), part(1, ky, kx, y)), F.when(long, part(2, F.lit(0), kx, ky)))
    cut = points.select("g", "pair", "c", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).groupBy("g", "pair", "p").agg(F.sum("c").alias("c"))
    cut = cut.select("g", "pair", "p.*", "c")
    schema = T.StructType([cut.schema["g"], cut.schema["pair"], T.StructField("s", T.DoubleType())])

    def count(t: pa.Table) -> pa.Table:
        a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "c"))
        return pa.table([t.column("g").slice(0, 1), t.column("pair").slice(0, 1), pa.array([D.kendall_sum(a, b, w)])], names=schema.names)

    s = cut.groupBy("g", "pair", "kind", "k").applyInArrow(count, schema).groupBy("g", "pair").agg(F.sum("s").alias("s"))
    t = F.col("t").cast("double")
    sums = {"pairs": t * (t - 1), "triples": t * (t - 1) * (t - 2), "spread": t * (t - 1) * (2 * t + 5)}
    ties = values.groupBy("g", "pair").agg(*[F.sum(F.when(F.col("side") == i, v)).alias(f"{name}_{side}") for i, side in enumerate("xy") for name, v in sums.items()])
    n = F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("c"))), F.lit(0))
    out = ranked.groupBy("g", "pair").agg(n.alias("n"), (F.max(F.greatest("tx", "ty")) > 1).alias("tied"), F.sum("c").alias("rows"))
    out = out.join(s, ["g", "pair"], "left").join(ties, ["g", "pair"], "left")
    every = F.col("n").cast("double") * (F.col("n") - 1)
    r = F.try_divide(2 * F.col("s"), F.sqrt(every - F.col("pairs_x")) * F.sqrt(every - F.col("pairs_y")))
    names = ["r", "n", "tied", "s", *[f"{name}_{side}" for name in ("spread", "pairs", "triples") for side in "xy"]]
    return _side_by_side(out.withColumn("r", F.when(F.col("n") >= 2, r)), group, len(pairs), names)


def correlate(
    rows: DataFrame,
    group: list[str],
    pairs: list[tuple[str, str, str, str]],
    method: str = "spearman",
    alternative: str = "two.sided",
    exact: bool | None = None,
    continuity: bool = False,
    min_rows: int = 1,
) -> DataFrame:
    """``group`` and, for each of ``pairs`` (x, y, name of estimate, name of p-value), a correlation test per group.

    Groups with fewer than ``min_rows`` rows are left out; null keys form groups. Rows with a null or NaN in x or y don't
    count for that pair. With fewer than two values, or where one of them doesn't vary, the estimate and p are null;
    Pearson's p also with fewer than three. Spearman's p is exact below 1290 values without ties (unless ``exact`` is
    False), else by the t approximation, as Pearson's is; for Kendall's see :func:`..functions.distributions.kendall_p`.
    """
    method, alternative = one_of(method, METHODS, "method"), one_of(alternative, ALTERNATIVES, "alternative")
    names = ["r", "n", "tied"]
    if method == "kendall":
        names += ["s", *[f"{name}_{side}" for name in ("spread", "pairs", "triples") for side in "xy"]]
    found = {"pearson": _pearson, "spearman": _spearman, "kendall": _kendall}[method](rows, group, pairs)
    source = found.filter(F.col("rows") >= min_rows).select(*group, *[f"{c}{i}" for i in range(len(pairs)) for c in names])
    schema = T.StructType([source.schema[g] for g in group] + [T.StructField(n, T.DoubleType()) for _, _, r, p in pairs for n in (r, p)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(batch.columns[: len(group)])
            for i in range(len(pairs)):
                columns = [batch.column(len(group) + len(names) * i + j).to_pandas() for j in range(len(names))]
                r, n = (c.to_numpy(float) for c in columns[:2])
                tied = columns[2].eq(True).to_numpy()
                p = np.full(len(r), np.nan)
                if method == "kendall":
                    rest = [c.to_numpy(float) for c in columns[3:]]
                    for j in np.flatnonzero((n >= 2) & ~np.isnan(r)):
                        s, sx, sy, px, py, tx, ty = (float(v[j]) for v in rest)
                        p[j] = D.kendall_p(r[j], s, int(n[j]), bool(tied[j]), (sx, sy), (px, py), (tx, ty), alternative, exact, continuity)
                else:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        t = r * np.sqrt((n - 2) / (1 - r * r))
                    known = (n > 2) & ~np.isnan(r)
                    p[known] = _tail(np.nan_to_num(t[known], nan=0.0, posinf=np.inf, neginf=-np.inf), n[known] - 2, alternative)
                    if method == "spearman" and exact is not False:
                        for j in np.flatnonzero(~tied & (n < 1290) & (n >= 2) & ~np.isnan(r)):
                            p[j] = D.spearman_p(r[j], int(n[j]), alternative)
                out += [pa.array(r, from_pandas=True), pa.array(p, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return source.mapInArrow(run, schema)


def adjust_p(rows: DataFrame, p: str, method: str = "BH", by: list[str] | None = None, name: str = "padj") -> DataFrame:
    """``rows`` with the adjusted ``p`` as ``name``, over the rows of each ``by`` (all if None). Null p don't count, and stay null.

    The rows are one for each test; those of one ``by`` are sorted by one task.
    """
    method = one_of(method, ADJUSTMENTS, "method")
    by = by or []
    rows = rows.withColumn(p, F.when(F.isnan(p), None).otherwise(F.col(p)))
    if method == "none":
        return rows.withColumn(name, F.col(p))
    n = F.count(p).over(Window.partitionBy(*by))
    if method == "bonferroni":
        return rows.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * n)))
    if method == "hommel":
        schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
        return rows.groupBy(*by).applyInPandas(lambda d: d.assign(**{name: _hommel(d[p].to_numpy(float))}), schema)
    place = F.row_number().over(Window.partitionBy(*by, F.col(p).isNull()).orderBy(p))
    rows = rows.withColumns({"__n": n, "__i": F.when(F.col(p).isNotNull(), place)})
    down = Window.partitionBy(*by).orderBy(F.col("__i").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*by).orderBy(F.col("__i").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    i, n = F.col("__i"), F.col("__n")
    if method == "holm":
        value = F.max((n - i + 1) * F.col(p)).over(up)
    elif method == "hochberg":
        value = F.min((n - i + 1) * F.col(p)).over(down)
    else:
        scaled = F.col(p) * n / i
        if method == "BY":
            harmonic = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, k: a + 1 / k)
            scaled = scaled * harmonic
        value = F.min(scaled).over(down)
    return rows.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), value))).drop("__n", "__i")


def _hommel(p: np.ndarray) -> np.ndarray:
    """By the definition: p is adjusted to the largest of Simes' tests over all sets of hypotheses that hold it.

    Of the sets of m hypotheses the worst for a given one has the m - 1 largest others, so Simes' test of the m largest
    (without the first, if it isn't in them) is all there is to look at: min over k of m p(n-m+k) / k.
    """
    known = np.flatnonzero(~np.isnan(p))
    values = np.sort(p[known])
    n = len(values)
    worst = values.copy()
    for m in range(2, n + 1):
        simes = m * values[n - m :] / np.arange(1, m + 1)
        inside, outside = simes.min(), simes[1:].min()
        # a hypothesis among the m largest is in that set; a smaller one stands first in its own, with m p as its term
        worst[n - m :] = np.maximum(worst[n - m :], inside)
        worst[: n - m] = np.maximum(worst[: n - m], np.minimum(m * values[: n - m], outside))
    out = p.copy()
    out[known] = np.minimum(worst, 1.0)[np.searchsorted(values, p[known])]
    return out


def nearest_quantiles(rows: DataFrame, group: list[str], value: str, q: float, name: str, times: str | None = None) -> DataFrame:
    """``group`` and ``name``, the value at the place nearest to ``q (n - 1)`` in order, each value counted ``times`` (a column).

    ``times`` is the same in all rows of a group. Null and NaN don't count, and a group without values has no row; null
    keys form groups. Values are counted first; the bucket with the place is found among a group's buckets, and then only
    the values of that bucket are put in order.
    """
    rows = rows.select(F.struct(*group).alias("g"), _number(value).alias("v"), (F.col(times) if times else F.lit(1)).cast("bigint").alias("w")).filter(F.col("v").isNotNull())
    counts = rows.groupBy("g", "v").agg(F.sum("w").alias("c")).withColumn("b", bucket(F.col("v")))
    place = F.round(F.lit(float(q)) * (F.col("n") - 1))
    found = _bucket_sums(counts, ["g"], "c").filter(F.col("start") + F.col("sum") > place).groupBy("g").agg(F.min(F.struct("b", "start", "n")).alias("x"))
    inside = counts.join(found.select("g", "x.*"), ["g", "b"])
    upto = F.col("start") + F.sum("c").over(Window.partitionBy("g", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    out = inside.withColumn("u", upto).filter(F.col("u") > place).groupBy("g").agg(F.min("v").alias(name))
    return out.select(*[F.col("g")[c].alias(c) for c in group], name)


def quantile_test_p(below: Column, upto: Column, n: Column, alternative: str) -> Column:
    """p-value of the quantile (sign) test from the numbers of values below and up to the reference, of ``n``."""
    alternative = one_of(alternative, ALTERNATIVES, "alternative")

    @F.pandas_udf(T.DoubleType())
    def p(below: pd.Series, upto: pd.Series, n: pd.Series) -> pd.Series:
        less = 1 - D.binom_lower(below.to_numpy(float) - 1, n.to_numpy(float))
        greater = D.binom_lower(upto.to_numpy(float), n.to_numpy(float))
        return pd.Series({"less": less, "greater": greater}.get(alternative, 2 * np.minimum(less, greater)))

    return p(below.cast("double"), upto.cast("double"), n.cast("double"))
