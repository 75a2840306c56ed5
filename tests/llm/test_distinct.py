import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from cladeflow.llm import distinct


def data(n=4000):
    r = random.Random(3)
    for i in range(n):
        x = r.choice(["hot", "hot2", None, "", f"u{r.randint(0, 900)}", f"u{r.randint(0, 900)}"])
        yield x, r.choice(["d1", "d2", None]), r.choice(["s1", ""]), r.choice(["5", None, "7"]), i


def frame(spark, rows):
    return spark.createDataFrame(rows, "x string, a string, b string, c string, n int")


def dims():
    return {d: F.col(d) for d in "abc"}


def exact(rows):
    out = {}
    for by in product((False, True), repeat=3):
        for x, a, b, c, _ in rows:
            if x is not None:
                out.setdefault((*by, *(v if use else None for v, use in zip((a, b, c), by))), set()).add(x)
    return {k: len(v) for k, v in out.items()}


@pytest.mark.parametrize("share", [0.001, 0.05, 2.0])
def test_all_combinations(spark, monkeypatch, share):
    monkeypatch.setattr(distinct, "HOT_SHARE", share)
    rows = list(data())
    if share == 2.0:
        monkeypatch.setattr(distinct, "hot_identifiers", lambda pairs: [])
    else:
        monkeypatch.setattr(distinct.hot_identifiers, "__defaults__", (share,))
    got = distinct.membership_patterns(frame(spark, rows), "x", dims()).count_groups().collect()
    assert {(r["by_a"], r["by_b"], r["by_c"], r["a"], r["b"], r["c"]): r["n_distinct"] for r in got} == exact(rows)
    assert len(got) == len(exact(rows))


def test_any_union_and_merging(spark):
    rows = list(data())
    df = frame(spark, rows)
    whole = distinct.membership_patterns(df, "x", dims())
    chosen = lambda c: (c["a"] == "d1") & c["c"].isin("5", "7")
    want = len({x for x, a, b, c, _ in rows if x is not None and a == "d1" and c in ("5", "7")})
    assert whole.count_where(chosen).first()["n_distinct"] == want
    shards = [distinct.membership_patterns(df.filter(F.pmod(F.xxhash64("x"), F.lit(2)) == i), "x", dims()) for i in (0, 1)]
    assert shards[0].merge(shards[1]).count_where(chosen).first()["n_distinct"] == want
    # parts with identifiers and cells in common, one of them a merge's own part
    parts = [distinct.partial_patterns(df.filter(F.col("n") % 3 == i), "x", dims()) for i in range(3)]
    parts.append(distinct.partial_patterns(df.filter(F.col("n") < 999), "x", dims(), F.col("b")))
    merged = distinct.merge_partials(parts)
    assert merged.count_where(chosen).first()["n_distinct"] == want
    assert {(r["by_a"], r["by_b"], r["by_c"], r["a"], r["b"], r["c"]): r["n_distinct"] for r in merged.count_groups().collect()} == exact(rows)


@pytest.mark.parametrize("most", [1, 2, 5])
def test_sets_are_bounded(spark, monkeypatch, most):
    monkeypatch.setattr(distinct, "MAX_CELLS", most)
    monkeypatch.setattr(distinct, "hot_identifiers", lambda pairs: ["hot2"])
    rows = list(data())
    found = distinct.membership_patterns(frame(spark, rows), "x", dims())
    sizes = [(r["id"], len(r["cells"]), r["n"]) for r in found.rows.collect()]
    assert max(s for _, s, _ in sizes) <= most and any(i == "hot" for i, _, _ in sizes) and any(i is None for i, _, _ in sizes)
    assert {(r["by_a"], r["by_b"], r["by_c"], r["a"], r["b"], r["c"]): r["n_distinct"] for r in found.count_groups().collect()} == exact(rows)
    chosen = lambda c: c["b"] == "s1"
    assert found.count_where(chosen).first()["n_distinct"] == len({x for x, _, b, _, _ in rows if x is not None and b == "s1"})


def test_hot_identifiers_are_found(spark):
    df = spark.createDataFrame([("h",)] * 500 + [(f"x{i}",) for i in range(5000)] + [(None,)] * 10, "id string")
    assert "h" in distinct.hot_identifiers(df)


def test_empty_and_null(spark):
    empty = distinct.membership_patterns(frame(spark, []), "x", dims())
    assert empty.count_groups().collect() == [] and empty.count_where(lambda c: c["a"] == "z").first()["n_distinct"] == 0
    nulls = distinct.membership_patterns(frame(spark, [(None, "a", "b", "c", 1)] * 3), "x", dims())
    assert nulls.count_groups().collect() == []
    same = distinct.membership_patterns(frame(spark, [("q", "a", "b", "c", 1)] * 3), "x", dims())
    assert {r["n_distinct"] for r in same.count_groups().collect()} == {1}
