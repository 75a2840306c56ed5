import datetime
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladeflow.llm import quantiles as Q


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1))
def test_leaves_are_ordered_and_near(values):
    x = np.array(values)
    v = Q.leaves(x)
    assert (v >= 0).all() and (v < 1 << Q.HEIGHT).all()
    order = np.argsort(x, kind="stable")
    assert (np.diff(v[order]) >= 0).all()
    back = Q.leaf_values(v)
    normal = np.isfinite(x) & (np.abs(x) > 1e-300)
    assert np.all(np.abs(back[normal] - x[normal]) <= np.abs(x[normal]) * Q.VALUE_ERROR)
    assert np.all(back[np.isinf(x)] == x[np.isinf(x)])


def test_zero_is_one_leaf():
    assert len(set(Q.leaves(np.array([0.0, -0.0])).tolist())) == 1 and Q.leaf_values(Q.leaves(np.array([0.0]))).tolist() == [0.0]


@pytest.mark.parametrize("parts", [1, 7])
def test_compress_keeps_counts_and_bounds(parts):
    r = np.random.default_rng(5)
    k = 300
    x = np.concatenate([r.lognormal(3, 4, 40_000), np.zeros(9_000), r.normal(0, 1e-3, 1000)])
    r.shuffle(x)
    pieces = [Q.compress(np.zeros(len(p), np.int64), Q.leaves(p) + (1 << Q.HEIGHT), np.ones(len(p), np.int64), k) for p in np.array_split(x, parts)]
    g, node, count = Q.compress(*(np.concatenate([p[i] for p in pieces]) for i in range(3)), k)
    n = len(x)
    assert count.sum() == n and len(node) <= 3 * k
    inner = node < (1 << Q.HEIGHT)
    assert (count[inner] <= n // k).all()
    level = np.frexp(node.astype(float))[1] - 1
    last = ((node + 1) << (Q.HEIGHT - level)) - 1 - (1 << Q.HEIGHT)
    order = np.lexsort((-level, last))
    upto = np.cumsum(count[order])
    s = np.sort(Q.leaves(x))
    for p in (0.001, 0.01, 0.3, 0.5, 0.9, 0.999):
        rank = max(1, math.ceil(p * n))
        leaf = last[order][np.searchsorted(upto, rank)]
        below, to = np.searchsorted(s, leaf, "left"), np.searchsorted(s, leaf, "right")
        assert below < rank + Q.HEIGHT * (n // k) and to >= rank - Q.HEIGHT * (n // k)


def rows(spark, n=20_000):
    r = np.random.default_rng(1)
    data = []
    for i in range(n):
        key = ["hot", "hot", "a", None][int(r.integers(0, 4))]
        x = [float(r.lognormal(2, 3)), 0.0, float(r.integers(0, 5)), None, math.nan][int(r.integers(0, 5))]
        data.append((key, datetime.date(2025, 3, 1 + int(r.integers(0, 5))), x, i))
    data += [("few", datetime.date(2025, 3, 1), v, 0) for v in (math.inf, -math.inf, -2.5, 1.0, 1.0)] + [("none", None, None, 0), ("none", None, math.nan, 0)]
    return spark.createDataFrame(data, "k string, d date, x double, p int")


@pytest.mark.parametrize("error", [0.005, 0.05])
def test_percentiles_against_exact_ranks(spark, error):
    df = rows(spark).repartition(5).cache()
    got = Q.percentiles(df, {"k": ["k"], "d": ["d"], "all": []}, "x", [0.0, 0.1, 0.5, 0.99, 1.0], error).collect()
    data = [r for r in df.collect() if r["x"] is not None and not math.isnan(r["x"])]
    keys = {("k", r["k"], None) for r in data} | {("d", None, r["d"]) for r in data} | {("all", None, None)}
    assert {(r["scope"], r["k"], r["d"]) for r in got} == keys and len(got) == 5 * len(keys)
    for r in got:
        x = np.sort([y["x"] for y in data if (r["scope"] != "k" or y["k"] == r["k"]) and (r["scope"] != "d" or y["d"] == r["d"])])
        assert r["n"] == len(x) and r["rank_error"] <= error * len(x)
        rank, near = max(1, math.ceil(r["p"] * len(x))), abs(r["value"]) * Q.VALUE_ERROR if math.isfinite(r["value"]) else 0
        assert np.searchsorted(x, r["value"] - near, "left") < rank + r["rank_error"]
        assert np.searchsorted(x, r["value"] + near, "right") >= rank - r["rank_error"]
    few = {r["p"]: r["value"] for r in got if r["k"] == "few"}
    assert few[0.0] == -math.inf and few[1.0] == math.inf and few[0.5] == 1.0


def test_digests_of_days_merge_to_that_of_all(spark):
    df = rows(spark).filter(F.col("d").isNotNull()).cache()
    days = [Q.merge_digests(Q.local_digests(df.filter(F.dayofmonth("d") == i), ["k"], "x", 0.02), ["k"], 0.02) for i in range(1, 6)]
    union = days[0]
    for d in days[1:]:
        union = union.unionByName(d)
    merged = Q.merge_digests(union, ["k"], 0.02, F.pmod(F.xxhash64("digest"), F.lit(3)))
    exact = {r["k"]: sorted(r["v"]) for r in df.filter(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("k").agg(F.collect_list("x").alias("v")).collect()}
    assert {r["k"]: r["n"] for r in merged.select("k", "n").collect()} == {k: len(v) for k, v in exact.items()}
    for r in Q.read_percentiles(merged, ["k"], [0.1, 0.5, 0.9]).collect():
        x = exact[r["k"]]
        rank, near = math.ceil(r["p"] * len(x)), abs(r["value"]) * Q.VALUE_ERROR if math.isfinite(r["value"]) else 0
        assert r["rank_error"] <= 0.02 * len(x)
        assert np.searchsorted(x, r["value"] - near, "left") < rank + r["rank_error"] and np.searchsorted(x, r["value"] + near, "right") >= rank - r["rank_error"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.floats(allow_nan=False)), min_size=1, max_size=300), st.sampled_from([0.01, 0.1, 0.4]))
def test_tightened_keeps_counts_and_its_error(points, share):
    group, x = (np.array(v) for v in zip(*points))
    keys, counts = Q._added((group.astype(np.int64) << 25) | (Q.leaves(x) + (1 << Q.HEIGHT)), np.ones(len(x), np.int64))
    small_k, small_c = Q.tightened(keys, counts, 4, share)
    n = Q._totals(keys, counts, 4)
    assert (Q._totals(small_k, small_c, 4) == n).all() and len(small_k) <= len(keys)
    error = Q.errors(small_k, small_c, 4)
    assert (error <= n * share).all()
    for g in range(4):  # by brute force: the sums over each leaf's ancestors
        own = dict(zip((small_k[small_k >> 25 == g] & (1 << 25) - 1).tolist(), small_c[small_k >> 25 == g].tolist()))
        paths = [sum(own.get(node >> d, 0) for d in range(25) if node >> d < 1 << Q.HEIGHT) for node in own]
        assert error[g] == max(paths, default=0)
        node, count = (np.array(v, np.int64) for v in zip(*sorted(own.items()))) if own else (np.zeros(0, np.int64),) * 2
        assert all((a == b).all() for a, b in zip(Q.unpack(Q.pack(node, count)), (node, count)))


def test_many_flushes_give_the_same_bound(spark, monkeypatch):
    for name, v in (("FLUSH_ROWS", 700), ("HOLD_NODES", 300), ("FLUSH_NODES", 900)):
        monkeypatch.setattr(Q, name, v)
    r = np.random.default_rng(4)
    x = np.sort(np.r_[r.lognormal(2, 3, 20_000), np.zeros(500)])
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(r.permutation(x))], "k string, x double").repartition(4)
    for got in Q.percentiles(df, {"all": [], "k": ["k"]}, "x", [0.05, 0.5, 0.95], 0.02).filter("scope = 'all'").collect():
        rank, near = math.ceil(got["p"] * len(x)), abs(got["value"]) * Q.VALUE_ERROR
        assert 0 < got["rank_error"] <= 0.02 * len(x) and got["n"] == len(x)
        assert np.searchsorted(x, got["value"] - near, "left") < rank + got["rank_error"] and np.searchsorted(x, got["value"] + near, "right") >= rank - got["rank_error"]


def test_empty_and_bad(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert Q.percentiles(df, {"k": ["k"], "all": []}, "x", [0.5]).collect() == []
    with pytest.raises(ValueError, match="percentile"):
        Q.percentiles(df, {"k": ["k"]}, "x", [1.5])
    with pytest.raises(ValueError, match="rank_error"):
        Q.percentiles(df, {"k": ["k"]}, "x", [0.5], 0)
