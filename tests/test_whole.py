"""Queries that must cover the whole of their tables."""

import math
import random
from collections import defaultdict
from itertools import permutations

import duckdb

from cladeflow.operators import extract
from cladeflow.plans import analysis
from cladeflow.session import table

FOLDER = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["id"] for r in df.select("id").distinct().collect())


def test_single_reads_and_pairs_are_all_classified_reads(spark):
    rows = table(spark, FOLDER, "koutput").withColumn("taxid", extract.taxid_of("taxid_text")).filter("taxid IS NOT NULL")
    single, paired = (analysis.QUERIES[name](spark, FOLDER) for name in ("koutreads_join", "koutreads_join_pairs"))
    assert sorted(ids(single) + ids(paired)) == ids(rows)
    kept = ids(extract.filter_koutput(rows, analysis._included(spark, FOLDER)))
    single, paired = (analysis.QUERIES[name](spark, FOLDER) for name in ("reads_extract", "reads_extract_pairs"))
    assert sorted(ids(single) + ids(paired)) == kept and ids(paired)


def ranked(v):
    return [sorted(v).index(x) for x in v]  # no ties here


def spearman(x, y):
    """r and the two-sided p by enumeration."""
    a, b = ranked(x), ranked(y)
    n, s = len(a), sum((i - j) ** 2 for i, j in zip(a, b))
    every = [sum((i - j) ** 2 for i, j in zip(a, q)) for q in permutations(range(n))]
    tail = min(sum(e <= s for e in every), sum(e >= s for e in every)) / len(every)
    return 1 - 6 * s / (n**3 - n), min(1.0, 2 * tail)


def adjusted(ps):
    """Benjamini and Hochberg."""
    order = sorted(ps, key=ps.get, reverse=True)
    out, low = {}, 1.0
    for place, k in enumerate(order):
        low = min(low, ps[k] * len(ps) / (len(ps) - place))
        out[k] = low
    return out


def pipeline_tables(spark, folder):
    """Six samples, two domains of twelve species; by their number species are noisy over samples, over barcodes, frequent or missing in cell lines."""
    r, n = random.Random(7), 6
    noisy = lambda i, far: i + far * r.random()
    report, kmers, umis, lines, row = [], [], [], [], 0
    for s in range(n):
        for d, name in enumerate(("Aarchonta", "Borchonta")):
            row += 1
            report.append((row, s, f"s{s}", 100000, 500, 400, "D", str(d + 1), f"  {name}"))
            for k in range(12):
                far, row = (0, 12)[k % 4 == 1], row + 1
                reads, length, unique = (int(100 * noisy(s + 1, far)) for _ in range(3))
                report.append((row, s, f"s{s}", reads, length, unique, "S", f"{d + 1}{k:02}", f"    T{d}{k}"))
    for s in range(n):
        for d in (0, 1):
            for k in range(12):
                key = (f"s{s}", f"{d + 1}{k:02}", f"T{d}{k}")
                for b in range(n):
                    kmers.append((key[0], f"b{b}", *key[1:], int(100 * noisy(b + 1, (0, 12)[k % 4 == 2])), int(100 * noisy(b + 1, (0, 12)[k % 4 == 2]))))
                umis += [(key[0], f"b{b}", key[1], key[2], "S", ["Aarchonta" if d == 0 else "Borchonta", key[2]], ["D", "S"], f"u{u}") for b in range(2) for u in (0, 0, b + k)]
    for d in (0, 1):
        for k in range(12):
            if k != 4:
                lines += [(f"{d + 1}{k:02}", 1e9 if k % 6 == 3 and i > 5 else 1.0 + i) for i in range(8)]
    put = lambda rows, name, schema: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    put(report, "kreport", "row_id long, report_id long, sample_id string, total_reads long, minimizer_len long, minimizer_n_unique long, rank string, taxid string, name string")
    put(kmers, "kmer", "sample_id string, barcode string, taxid string, taxa string, kmer_len long, kmer_n_unique long")
    put(umis, "umi", "sample_id string, barcode string, taxid string, taxa string, rank string, taxon array<string>, ranks array<string>, umi string")
    put(lines, "cell_lines", "taxid string, rpmm double")
    return report, kmers, umis, lines


def test_denoise_counts_by_brute_force(spark, tmp_path):
    report, kmers, umis, lines = pipeline_tables(spark, tmp_path)
    total, rows, cells = defaultdict(int), defaultdict(list), defaultdict(list)
    for _, _, sample, reads, *_, rank, _, _ in report:
        total[sample] += reads if rank == "D" else 0
    for _, _, sample, reads, length, unique, _, taxid, _ in report:
        rows[taxid].append((reads, length, unique, reads / total[sample] * 1e6))
    truly, alike = set(), set()
    for taxid, found in rows.items():
        values = sorted(v for t, v in lines if t == taxid for _ in found)
        if values:
            reference = values[math.floor(0.95 * (len(values) - 1) + 0.5)]
            upto = sum(x[3] <= reference for x in found)
            if sum(math.comb(len(found), i) for i in range(upto + 1)) / 2 ** len(found) < 0.05:
                truly.add(taxid)
        reads, length, unique, _ = zip(*found)
        if len(set(reads)) == len(found) and all(c > 0 and p < 0.05 for c, p in (spearman(length, unique), spearman(length, reads), spearman(reads, unique))):
            alike.add(taxid)
    for sample, _, taxid, _, length, unique in kmers:
        cells[sample, taxid].append((length, unique))
    ps = {k: spearman(*zip(*v))[1] for k, v in cells.items()}
    padj = {k: p for s in range(6) for k, p in adjusted({k: p for k, p in ps.items() if k[0] == f"s{s}"}).items()}
    real = {k for k, p in padj.items() if p < 0.05 and k[1] in truly and k[1] in alike}
    want = defaultdict(set)
    for sample, barcode, taxid, *_, umi in umis:
        if (sample, taxid) in real:
            want[sample, barcode, taxid].add(umi)
    got = {(r["sample"], r["barcode"], r["taxid"]): r["counts"] for r in analysis.QUERIES["denoise_counts"](spark, str(tmp_path)).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    # every test rejects something here, and both domains are in
    taxids = {t for t in rows if len(t) == 3}
    assert {t[0] for _, t in real} == {"1", "2"} and taxids - truly and taxids - alike and any(p >= 0.05 for p in padj.values())
    opened = {(r["sample"], r["barcode"], r["taxid"]) for r in analysis.QUERIES["denoise_lenient"](spark, str(tmp_path)).collect()}
    assert opened - set(got)
    # the SQL, which gives no rows on small driver tables, finds the same here; it spells out ranks that these tables lack
    con = duckdb.connect()
    for name in ("kreport", "kmer", "umi", "cell_lines"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    con.execute("CREATE VIEW found AS " + analysis.SQL["denoise_counts"])
    sql = {tuple(r[:3]): r[3] for r in con.execute("SELECT sample, barcode, taxid, counts FROM found").fetchall()}
    assert sql == got and got


def test_rpmm_covers_every_domain(spark):
    inside = analysis._report(spark, FOLDER).filter("exists(lineage, x -> x.rank = 'D')")
    got = analysis.QUERIES["rpmm_domains"](spark, FOLDER)
    assert len(analysis._domains(spark, FOLDER)) == 3
    assert sorted(r["taxid"] for r in got.collect()) == sorted(r["taxid"] for r in inside.collect())
    assert got.count() > analysis.QUERIES["rpmm"](spark, FOLDER).count()
