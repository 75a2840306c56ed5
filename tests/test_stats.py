import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.functions import distributions as D
from cladeflow.operators import denoise, stats


def test_tails():
    assert 2 * D.t_upper(np.array([2.570582, 2.042272]), np.array([5, 30])) == pytest.approx([0.05, 0.05], abs=1e-6)
    assert D.t_upper(np.array([-1.0, 0.0, np.inf]), np.array([3, 3, 3])) == pytest.approx([0.80449889, 0.5, 0.0], abs=1e-7)
    assert D.binom_lower(np.array([3, -1, 10, 0]), np.array([10, 10, 10, 10])) == pytest.approx([0.171875, 0, 1, 2**-10])
    want = [sum(math.comb(40, i) for i in range(k + 1)) / 2**40 for k in range(41)]
    assert D.binom_lower(np.arange(41), np.full(41, 40)) == pytest.approx(want, rel=1e-10)
    assert D.norm_upper(np.array([1.959963985])) == pytest.approx([0.025])


@pytest.mark.parametrize("n", [4, 6, 8])
def test_exact_distributions_by_enumeration(n):
    base, r = list(range(n)), random.Random(n)
    every = list(permutations(base))
    s_of = lambda p: sum((a - b) ** 2 for a, b in zip(base, p))
    c_of = lambda p: sum(p[i] < p[j] for i in range(n) for j in range(i + 1, n))
    for p in r.sample(every, 5):
        s, c = s_of(p), c_of(p)
        rho, tau = 1 - 6 * s / (n**3 - n), 4 * c / (n * (n - 1)) - 1
        assert D.spearman_p(rho, n, "greater") == pytest.approx(sum(s_of(q) <= s for q in every) / len(every))
        assert D.spearman_p(rho, n, "less") == pytest.approx(sum(s_of(q) >= s for q in every) / len(every))
        assert D.kendall_exact_p(tau, n, "greater") == pytest.approx(sum(c_of(q) >= c for q in every) / len(every))


def test_series_is_near_exact_and_t():
    # the published series is good to about 0.001 at its smallest n
    values, upto = D._spearman_counts(9)
    shares = 1 - np.r_[0, upto[:-1]] / upto[-1]
    assert max(abs(D.spearman_series(float(s), 9) - x) for s, x in zip(values, shares)) < 0.0015
    for rho in (0.1, 0.4, -0.6):
        n = 60
        t = rho * math.sqrt((n - 2) / (1 - rho * rho))
        assert D.spearman_p(rho, n, "two.sided") == pytest.approx(2 * float(D.t_upper(np.array(abs(t)), np.array(n - 2))), abs=0.002)


def kendall_brute(x, y):
    n, s = len(x), 0
    for i in range(n):
        for j in range(i):
            s += np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
    ties = lambda v: sum(v[i] == v[j] for i in range(n) for j in range(i))
    p = n * (n - 1) / 2
    return s / math.sqrt((p - ties(x)) * (p - ties(y)))


def test_correlations_against_numpy(spark):
    r = np.random.default_rng(3)
    rows = []
    for g in range(6):
        for _ in range(int(r.integers(5, 60))):
            rows.append((f"g{g}", float(r.integers(0, 8)) if g % 2 else float(r.random()), None if r.random() < 0.1 else float(r.integers(0, 9)) if g % 2 else float(r.random())))
    rows += [("flat", 1.0, float(i)) for i in range(5)] + [("one", 1.0, 2.0), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    for method in stats.METHODS:
        got = {x["g"]: x for x in stats.correlate(df, ["g"], [("x", "y", "r", "p")], method).collect()}
        assert set(got) == {x[0] for x in rows}
        for g in range(6):
            x, y = (np.array(v) for v in zip(*[(a, b) for k, a, b in rows if k == f"g{g}" and b is not None]))
            rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
            want = kendall_brute(x, y) if method == "kendall" else np.corrcoef(*((rank(x), rank(y)) if method == "spearman" else (x, y)))[0, 1]
            assert got[f"g{g}"]["r"] == pytest.approx(want)
            assert 0 <= got[f"g{g}"]["p"] <= 1
        assert all(got[k]["r"] is None and got[k]["p"] is None for k in ("flat", "one", "none"))


def test_correlation_small_case(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", 3, 2)], "g string, x int, y int")
    assert stats.correlate(df, ["g"], [("x", "y", "r", "p")], "pear").first()["r"] == pytest.approx(0.5)
    assert stats.correlate(df, ["g"], [("x", "y", "r", "p")], "spearman").first()["p"] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="method"):
        stats.correlate(df, ["g"], [], "x")


P = [0.01, 0.04, 0.03, 0.2, None, 0.04]
ADJUSTED = {  # by hand from the definitions, n = 5
    "bonferroni": [0.05, 0.2, 0.15, 1.0, None, 0.2],
    "holm": [0.05, 0.12, 0.12, 0.2, None, 0.12],
    "hochberg": [0.05, 0.08, 0.08, 0.2, None, 0.08],
    "BH": [0.05, 0.05, 0.05, 0.2, None, 0.05],
    "none": P,
}


@pytest.mark.parametrize("method", stats.ADJUSTMENTS)
def test_adjustments(spark, method):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(P)] + [(9, 0.5, "y")], "i int, p double, s string")
    got = {r["i"]: r["padj"] for r in stats.adjust_p(df, "p", method, ["s"]).collect()}
    assert got[9] == pytest.approx(0.5)
    values = [got[i] for i in range(6)]
    if method in ADJUSTED:
        assert values == pytest.approx(ADJUSTED[method])
    if method == "BY":
        assert values == pytest.approx([None if x is None else min(1, x * (1 + 1 / 2 + 1 / 3 + 1 / 4 + 1 / 5)) for x in ADJUSTED["BH"]])
    if method == "fdr":
        assert values == pytest.approx(ADJUSTED["BH"])
    if method == "hommel":  # by closed testing with Simes' test over all subsets
        known = [(i, p) for i, p in enumerate(P) if p is not None]
        for i, p in known:
            worst = 0.0
            for mask in range(1 << len(known)):
                subset = [known[k] for k in range(len(known)) if mask >> k & 1]
                if any(j == i for j, _ in subset):
                    s = sorted(q for _, q in subset)
                    worst = max(worst, min(len(s) * q / (k + 1) for k, q in enumerate(s)))
            assert values[i] == pytest.approx(worst)


def test_nearest_quantile(spark):
    values = [5.0, 1.0, 3.0, 2.0, 2.0, 9.0, None]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "g string, x double")
    for q in (0, 0.1, 0.5, 0.7, 0.95, 1):
        want = sorted(v for v in values if v is not None)[int(math.floor(q * 5 + 0.5))]
        assert [tuple(r) for r in stats.nearest_quantiles(df, ["g"], "x", q, "v").collect()] == [("a", want)]


L = "array<struct<rank:string,taxid:string,taxon:string>>"


def reports(spark):
    rows = []
    domain, other = {"rank": "D", "taxid": "2", "taxon": "Bacteria"}, {"rank": "D", "taxid": "9", "taxon": "Eukaryota"}
    for s in range(5):
        rows.append((f"s{s}", "D", "2", "Bacteria", 1000, 100 + s, 50 + s, [domain]))
        rows.append((f"s{s}", "S", "562", "Ecoli", 10 * (s + 1), 100 * (s + 1), 50 * (s + 1) ** 2, [domain, {"rank": "S", "taxid": "562", "taxon": "Ecoli"}]))
        rows.append((f"s{s}", "S", "7", "Rare", 2, 9, 9, [domain, {"rank": "S", "taxid": "7", "taxon": "Rare"}]))
        rows.append((f"s{s}", "D", "9", "Eukaryota", 5, 9, None, [other]))
    return spark.createDataFrame(rows, f"sample string, rank string, taxid string, taxon string, total_reads long, minimizer_len long, minimizer_n_unique long, lineage {L}")


def test_quantile_test(spark):
    lines = spark.createDataFrame([("562", float(v)) for v in (1, 2, 25000, 3)] + [("x", 1.0), ("562", None)], "taxid string, rpmm double")
    t = denoise.quantile_test(reports(spark), lines, taxa=["d__Bacteria"], quantile=1.0, alpha=0.6, sample="sample")
    p = {r["taxid"]: r for r in t.pvalues.collect()}
    assert p["562"]["reference"] == 25000.0 and p["562"]["pvalue"] == pytest.approx(float(D.binom_lower(np.array([2]), np.array([5]))[0]))
    assert p["2"]["pvalue"] is None and set(p) == {"562", "7", "2"}
    ids = lambda df: sorted(r["taxid"] for r in df.collect())
    assert ids(t.unmatched) == ["2", "7"] and ids(t.significant) == ids(t.truly) == ["562"]
    t = denoise.quantile_test(reports(spark), lines, taxa=["d__Bacteria"], quantile=1.0, alpha=0.1, drop_unmatched=False)
    assert ids(t.significant) == [] and ids(t.truly) == ["2", "7"]
    t = denoise.quantile_test(reports(spark), lines, taxa=["d__Bacteria"], alternative="two", alpha=2.0)
    copies = lambda df: sum(r["weight"] for r in df.collect())
    assert copies(t.data) == 15 + 4 * 5 and copies(t.density_frame()) == 5 + 20  # cell lines without a value have no row


def test_levels_and_counts(spark):
    got = {r["taxid"]: r for r in denoise.sample_level(reports(spark)).collect()}
    assert set(got) == {"2", "562"} and got["562"]["r1"] == pytest.approx(1.0) and got["562"]["p1"] == pytest.approx(2 / 120)
    assert got["2"]["r2"] is None
    kmers = spark.createDataFrame([("s0", f"b{i}", "562", "Ecoli", 3 + i, 1 + i) for i in range(6)] + [("s0", "b", "7", "Rare", 2, 2)], "sample string, barcode string, taxid string, taxon string, kmer_len long, kmer_n_unique long")
    rows = denoise.barcode_level(kmers, sample="sample").collect()
    assert [(r["taxid"], r["cor"], r["padj"]) for r in rows] == [("562", pytest.approx(1.0), pytest.approx(2 / 720))]
    umis = spark.createDataFrame([("s0", "b", "562", "Ecoli", "S", ["Bacteria", "Ecoli"], ["D", "S"], u) for u in ("x", "x", "y", None)] + [("s0", "b", "7", "Rare", "S", ["Bacteria", "Rare"], ["D", "S"], "x"), ("s1", "b", "562", "Ecoli", "S", None, None, "x")], "sample string, barcode string, taxid string, taxa string, rank string, taxon array<string>, ranks array<string>, umi string")
    counts = denoise.taxa_counts(umis, ["S", "D", "G"], "sample")
    assert counts.columns == ["sample", "barcode", "taxid", "taxa", "rank", "domain", "genus", "species", "counts"]
    assert sorted((r["sample"], r["taxid"], r["domain"], r["genus"], r["counts"]) for r in counts.collect() if r["domain"]) == [("s0", "562", "Bacteria", None, 3), ("s0", "7", "Bacteria", None, 1)]
    assert denoise.observed_ranks(umis) == ["D", "S"]
    lines = spark.createDataFrame([("562", 1e9)], "taxid string, rpmm double")
    out = denoise.denoise_counts(reports(spark), kmers, umis, lines, ["D", "S"], taxa=["d__Bacteria"], alpha=0.5)
    assert [(r["sample"], r["taxid"], r["counts"]) for r in out.counts.collect()] == []
    out = denoise.denoise_counts(reports(spark), kmers, umis, lines, ["D", "S"], taxa=["d__Bacteria"], alternative="less", alpha=1.1)
    assert [(r["sample"], r["taxid"], r["counts"]) for r in out.counts.collect()] == [("s0", "562", 3)]


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_a_group_with_most_rows(spark, method, monkeypatch):
    """One key holds nine tenths of the rows; strips are small, so that it is cut many times, with ties above a strip."""
    monkeypatch.setattr(stats, "STRIP", 40)
    r = np.random.default_rng(8)
    n = 900
    x = np.where(r.random(n) < 0.2, 7.0, np.round(r.lognormal(3, 2, n), 1))
    y = np.where(r.random(n) < 0.15, -3.0, np.round(x * r.random(n) - r.normal(0, 9, n), 0))
    rows = [("hot", float(a), float(b)) for a, b in zip(x, y)] + [(None, float(i), float(i * i)) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    got = {k["g"]: k for k in stats.correlate(df, ["g"], [("x", "y", "r", "p"), ("y", "x", "r2", "p2")], method).collect()}
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    want = kendall_brute(x, y) if method == "kendall" else np.corrcoef(rank(x), rank(y))[0, 1]
    assert got["hot"]["r"] == pytest.approx(want) and got["hot"]["r2"] == pytest.approx(want)
    assert got[None]["r"] == pytest.approx(1.0) and got["hot"]["p"] == pytest.approx(got["hot"]["p2"])
    plan = stats.correlate(df, ["g"], [("x", "y", "r", "p")], method)._jdf.queryExecution().executedPlan().toString()
    ordered = [w for w in (part.split("\n")[0] for part in plan.split("Window")[1:]) if " ASC" in w]
    assert ordered and all("b#" in w for w in ordered)  # buckets within a group, or values within a bucket


def test_quantile_of_a_group_with_most_rows(spark):
    r = np.random.default_rng(9)
    x = np.r_[np.round(r.lognormal(0, 4, 900), 2), np.zeros(60), -np.round(r.lognormal(0, 2, 40), 1), np.inf]
    df = spark.createDataFrame([("hot", float(v), 3) for v in x] + [(None, 1.0, 2), ("nan", math.nan, 1)], "g string, x double, w int")
    s = np.sort(np.repeat(x, 3))
    for q in (0.0, 0.03, 0.5, 0.95, 1.0):
        got = {k["g"]: k["v"] for k in stats.nearest_quantiles(df, ["g"], "x", q, "v", "w").collect()}
        assert got == {"hot": s[math.floor(q * (len(s) - 1) + 0.5)], None: 1.0}


def test_buckets_grow_with_values(spark):
    v = [-math.inf, -1e300, -2.5, -2.4999, -1e-300, -0.0, 0.0, 5e-324, 1e-300, 1.0, 1.0000001, 3.0, 2.0**53, 1e308, math.inf]
    b = [k["b"] for k in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x double").orderBy("i").select(stats.bucket(F.col("x")).alias("b")).collect()]
    assert b == sorted(b) and b[5] == b[6] == 0 and b[0] < b[1] and b[-2] < b[-1]
