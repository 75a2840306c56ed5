import random
from collections import defaultdict

import pytest

from cladeflow.operators import skew


def rows(n=3000):
    r = random.Random(4)
    for i in range(n):
        key = r.choice(["hot"] * 6 + ["warm"] * 2 + [None, "", f"k{r.randint(0, 200)}"])
        yield key, r.choice([None, *range(20)]), r.choice([None, 1.5, 2.5, -1.0]), i


AGGS = [skew.Agg("n", "count"), skew.Agg("v", "count_value", "x"), skew.Agg("s", "sum", "x"), skew.Agg("lo", "min", "y"), skew.Agg("hi", "max", "y"), skew.Agg("mean", "avg", "x"), skew.Agg("d", "count_distinct", "x")]


@pytest.mark.parametrize("share", [0.01, 0.3, 1.0])
def test_against_brute_force(spark, share):
    data = list(rows())
    df = spark.createDataFrame(data, "key string, x int, y double, key_value int")
    groups = defaultdict(list)
    for key, x, y, _ in data:
        groups[key].append((x, y))
    expected = {}
    for key, values in groups.items():
        xs, ys = [x for x, _ in values if x is not None], [y for _, y in values if y is not None]
        expected[key] = (len(values), len(xs), sum(xs) if xs else None, min(ys, default=None), max(ys, default=None), sum(xs) / len(xs) if xs else None, len(set(xs)))
    got = {r["key_value"]: tuple(r)[1:] for r in skew.salted_aggregate(df, "key", AGGS, share=share, salts=7).collect()}
    assert got == expected


def test_heavy_keys_and_found(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] + [(None,)] * 96 + [("",)], "k string")
    assert sorted(skew.heavy_keys(df, "k", 0.02)[0]) == ["a"]
    assert [tuple(r) for r in skew.keys_holding(df, "k", 0.02).collect()] == [("a", 2)]
    assert skew.heavy_keys(df, "k", 0.01)[1] == 100
    assert sorted(skew.heavy_keys(df, "k", 0.01)[0]) == ["", "a", "b"]


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([], "k string, x int")
    assert skew.keys_holding(df, "k", 0.02).collect() == []
    assert skew.salted_aggregate(df, "k", [skew.Agg("n", "count"), skew.Agg("d", "count_distinct", "x")]).collect() == []
    df = spark.createDataFrame([(None, None)] * 3, "k string, x int")
    assert [tuple(r) for r in skew.salted_aggregate(df, "k", [skew.Agg("n", "count"), skew.Agg("d", "count_distinct", "x"), skew.Agg("s", "sum", "x")]).collect()] == [(None, 3, 0, None)]


def test_bad_arguments(spark):
    with pytest.raises(ValueError, match="unknown aggregate"):
        skew.Agg("n", "median", "x")
    with pytest.raises(ValueError, match="needs a column"):
        skew.Agg("n", "sum")
    with pytest.raises(ValueError, match="share"):
        skew.heavy_keys(spark.range(1), "id", 0)


def test_share_is_exact():
    assert [skew.least_rows(s, n) for s, n in ((0.02, 100), (0.02, 101), (0.07, 100), (0.29, 100), (1.0, 3), (0.1, 0))] == [2, 3, 7, 29, 3, 0]
