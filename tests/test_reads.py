import gzip

import pytest
from pyspark.sql import functions as F

from cladeflow.functions import ranges as R
from cladeflow.operators import extract, koutreads, krcount
from cladeflow.sources import classifier, sinks, text
from cladeflow.streaming import reads as streaming

K = "status string, id string, taxid_text string, length string, lca string"


def kout(spark, rows):
    return spark.createDataFrame(rows, K)


def include(spark, *taxids):
    return spark.createDataFrame([(t,) for t in taxids], "taxid string")


def test_filter_koutput(spark):
    rows = kout(spark, [("C", "a", "Escherichia coli (taxid 562)", "9", "562:3 9606:2"), ("C", "b", "562", "9", "562:3 19606:2"), ("U", "c", "562", "9", "0:1"), ("C", "d", "9", "9", "9:1"), ("C", "e", "x (taxid 562", "9", "1:1"), ("C", "f", "562", "9", None)])
    keep = lambda **kw: sorted(r["id"] for r in extract.filter_koutput(rows, include(spark, "562"), **kw).collect())
    assert keep() == ["a", "b", "c", "f"]
    assert keep(classified_only=True) == ["a", "b", "f"]
    assert keep(exclude=["9606"]) == ["c", "f"]
    assert keep(exclude=["9606"], mode="exact") == ["b", "c", "f"]
    assert extract.filter_koutput(rows, exclude=["9606"]).count() == 4
    with pytest.raises(ValueError, match="mode"):
        keep(exclude=["1"], mode="x")


def test_extract_reads_keeps_only_listed_ids(spark):
    reads = spark.createDataFrame([("a", "A"), ("b", "C"), ("a", "G")], "id string, seq string")
    ids = spark.createDataFrame([("a",), ("a",), ("z",)], "id string")
    assert sorted(r["seq"] for r in extract.extract_reads(reads, ids).collect()) == ["A", "G"]


SINGLE = "id string, desc string, seq string, sep string, qual string"
PAIR = "id string, desc1 string, seq1 string, qual1 string, desc2 string, seq2 string, qual2 string"


def with_taxid(df):
    return df.withColumn("taxid", extract.taxid_of("taxid_text"))


def test_join_reads(spark):
    rows = with_taxid(kout(spark, [("C", "a", "562", "4", "562:1"), ("C", "a", "561", "4", "561:1"), ("C", "b", "7", "4", "7:1")]))
    reads = spark.createDataFrame([("a", "T{UMI:GG:X:CC}", "ACGT", "+", "IIII"), ("q", None, "A", "+", "I")], SINGLE)
    got = koutreads.join_reads(rows, reads, {"UMI": [R.seq_range(1, 2), R.seq_range(4, 4)]}, prefix="T").collect()
    assert [(r["id"], r["taxid"], r["tags"], r["lca"]) for r in got] == [("a", "561", {"UMI": "ACT", "X": "CC"}, "561:1")]
    for length, message in (("5", "differs"), ("4|4", "lengths of a pair"), ("x", "differs")):
        bad = with_taxid(kout(spark, [("C", "a", "562", length, "562:1")]))
        with pytest.raises(Exception, match=message):
            koutreads.join_reads(bad, reads).collect()


def test_join_pairs(spark):
    reads = spark.createDataFrame([("a", "T{U:1}", "ACG", "III", "T{U:2:V:3}", "TTTT", "JJJJ")], PAIR)
    for length in ("3|4", "3:4"):
        rows = with_taxid(kout(spark, [("C", "a", "5", length, "5:1 |:| 5:2")]))
        got = koutreads.join_pairs(rows, reads, prefix="T").first()
        assert (got["seq"], got["qual"], got["tags"]) == ("ACG TTTT", "III JJJJ", {"U": "2", "V": "3"})
    lone = with_taxid(kout(spark, [("C", "a", "5", "4", "5:1")]))
    got = koutreads.join_pairs(lone, reads, {"U": R.seq_range(1, 1)}, {"U": R.seq_range(1, 2)}, prefix="T").first()
    assert (got["seq"], got["qual"], got["tags"]["U"]) == ("TTTT", "JJJJ", "ATT")
    with pytest.raises(Exception, match="differ"):
        koutreads.join_pairs(with_taxid(kout(spark, [("C", "a", "5", "3", "5:1")])), reads).collect()


def test_stream_join_matches_batch(spark, tmp_path):
    rows = with_taxid(kout(spark, [("C", "a", "562", "4", "562:1"), ("C", "b", "7", "1", "7:1")]))
    reads = spark.createDataFrame([("a", None, "ACGT", "+", "IIII"), ("b", None, "A", "+", "I"), ("q", None, "A", "+", "I")], SINGLE)
    reads.write.parquet(str(tmp_path / "in"))
    stream = streaming.join_stream(rows, spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("joined").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["id"] for r in spark.table("joined").collect()) == sorted(r["id"] for r in koutreads.join_reads(rows, reads).collect()) == ["a", "b"]
    events = spark.createDataFrame([("s", "b", "t", "u", "2025-01-01 00:00:00"), ("s", "b", "t", "u", "2025-01-01 01:00:00"), ("s", "b", "t", "v", "2025-01-01 00:30:00")], "sample_id string, barcode string, taxid string, umi string, seen_at string")
    events = events.withColumn("seen_at", F.to_timestamp("seen_at"))
    events.write.parquet(str(tmp_path / "ev"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = streaming.distinct_umis(source).writeStream.format("memory").queryName("umis").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["umi"] for r in spark.table("umis").collect()) == ["u", "v"]
    with pytest.raises(ValueError, match="static"):
        streaming.join_stream(source, reads)


GOOD = "ACGTACGTACGTACGTACGTACGTACGTACGT"


def test_filters(spark):
    q = lambda *qs: [r[0] for r in spark.createDataFrame([(x,) for x in qs], "q string").select(krcount.passes_quality("q")).collect()]
    assert q("555", "554", "", "55 55", "54 55") == [True, False, True, True, False]
    c = lambda *ss: [r[0] for r in spark.createDataFrame([(x,) for x in ss], "s string").select(krcount.passes_complexity("s")).collect()]
    assert c(GOOD, "A" * 19, "A" * 20, "A" * 10 + "x" * 20, "A" * 20 + "x" * 20, GOOD + " " + "A" * 30, "x" * 21 + "A" * 19) == [True, True, False, False, True, False, False]


def test_kmers(spark):
    def of(lca, seq):
        return spark.createDataFrame([(lca, seq)], "lca string, seq string").select(krcount.kmers("lca", "seq").alias("k"), krcount.kmer_count("lca", "seq").alias("n")).first()

    got = of("562:3 0:2 A:1", "ACGTACGTAC")
    assert got["k"] == ["ACGTA", "CGTAC", "GTACG", "TACGT", "ACGTA", "CGTAC"] and got["n"] == 6
    got = of("a:2 |:| b:3", "AAAC GGGGT")
    assert got["k"] == ["AAA", "AAC", "GGG", "GGG", "GGT"] and got["n"] == 5
    for lca, seq in (("562:0", "ACG"), ("562:4", "ACG"), ("562", "ACG"), ("562:x", "ACG"), ("1:1 |:| 1:1", "ACG"), ("1:1", "ACG ACG")):
        with pytest.raises(Exception):
            of(lca, seq)


def test_count_reads(spark):
    line = [("D", "2"), ("P", "1224"), ("G", "561"), ("S", "562")]
    entry = lambda i: [{"rank": r, "taxid": t, "taxon": t} for r, t in line[: i + 1]]
    report = spark.createDataFrame([(line[i][0], line[i][1], entry(i)) for i in range(4)] * 2, "rank string, taxid string, lineage array<struct<rank:string,taxid:string,taxon:string>>")
    good = "I" * len(GOOD)
    rows = [("562", {"B": "b", "U": "u"}, "562:2", GOOD, good), ("562", {"B": "b", "U": "u"}, "562:2", GOOD, good), ("561", {"B": "b", "U": "v"}, "561:2", GOOD, good)]
    rows += [("9999", {}, "bad", GOOD, good), ("562", {}, "bad", GOOD, "!" * len(GOOD)), ("562", {}, "bad", "A" * 40, "I" * 40)]  # all left out before anything is parsed
    df = spark.createDataFrame(rows, "taxid string, tags map<string,string>, lca string, seq string, qual string")
    got = {(r["barcode"], r["taxid"]): tuple(r)[2:] for r in krcount.count_reads(df, report, "B", "U").collect()}
    assert got == {("b", "2"): (2, 6, 2), ("b", "1224"): (2, 6, 2), ("b", "561"): (2, 6, 2), ("b", "562"): (1, 4, 2)}
    got = {(r["barcode"], r["taxid"]): tuple(r)[2:] for r in krcount.count_reads(df, report, ranks=["G", "S"]).collect()}
    assert got == {("", "561"): (3, 6, 2), ("", "562"): (2, 4, 2)}
    with pytest.raises(Exception, match="no tag X"):
        krcount.count_reads(df, report, "X").collect()
    matrix = krcount.count_matrix(krcount.count_reads(df, report, "B", "U"), "reads", ["b", "c"]).orderBy("taxid").collect()
    assert [tuple(r) for r in matrix][-1] == ("562", 1, None)


def test_text_round_trip(spark, tmp_path):
    p = tmp_path / "k.txt.gz"
    p.write_bytes(gzip.compress(b"C\tread1\tkraken:(taxid 123)\t123\tBacteria\r\nC\tread2\t456\t456\tFungi\n\nU\t\t0\t1\t\n"))
    rows = text.read_koutput(spark, str(p))
    kept = extract.filter_koutput(rows, include(spark, "123"))
    sinks.write_koutput(kept, str(tmp_path / "out"))
    assert [r["id"] for r in text.read_koutput(spark, str(tmp_path / "out")).collect()] == ["read1"]
    assert sorted(r["id"] for r in text.read_ids(spark, str(p)).collect()) == ["read1", "read2"]
    reads = spark.createDataFrame([("5", {"U": "AC", "B": "G"}, "5:1", "ACGT", "IIII"), ("6", {}, "", "A", "I")], "taxid string, tags map<string,string>, lca string, seq string, qual string")
    sinks.write_koutreads(reads, str(tmp_path / "kr"), gzip=True)
    assert sorted(tuple(r) for r in text.read_koutreads(spark, str(tmp_path / "kr")).collect()) == sorted(tuple(r) for r in reads.collect())
    (tmp_path / "bad").write_text("a\tb\n")
    with pytest.raises(Exception, match="not 5"):
        text.read_koutreads(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "cells").write_text("taxid rpmm\n5 1.5\n6 2\n")
    sinks.write_cell_lines(text.read_cell_lines(spark, str(tmp_path / "cells")), str(tmp_path / "cells.parquet"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "cells.parquet")).collect()) == [("5", 1.5), ("6", 2.0)]


def test_classifier_command():
    command = classifier.classifier_command(["a.fq.gz", "b.fq.gz"], db="d", odir="o", classified_out="c#.fq", threads=3)
    assert command[-4:] == ["--paired", "--gzip-compressed", "a.fq.gz", "b.fq.gz"] and "--report-minimizer-data" in command and "o/c#.fq" in command
    with pytest.raises(ValueError, match="reads"):
        classifier.classifier_command([])


def test_repeated_and_odd_tags_of_koutreads(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("1\tUMI:AC  UMI:GG B:x:y Q\t1:1\tA\tI\n2\t\t1:1\tA\tI\n")
    got = {r["taxid"]: r["tags"] for r in text.read_koutreads(spark, str(p)).collect()}
    assert got == {"1": {"UMI": "GG", "B": "x:y", "Q": None}, "2": {}}


def test_late_rows_count_exactly(spark, tmp_path):
    schema = "sample_id string, taxid string, umi string, seen_at timestamp"
    day = lambda d, *umis: spark.createDataFrame([("s", "t", u, None) for u in umis], schema).withColumn("seen_at", F.lit(f"2025-01-{d:02} 10:00:00").cast("timestamp"))
    path, progress = str(tmp_path / "partials"), str(tmp_path / "progress")
    for rows in (day(1, "a", "b"), day(20, "c"), day(1, "a", "d", None)):  # the last come weeks late
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        streaming.store_umis(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, progress).awaitTermination()
    got = {r["window_start"].day: (r["n_rows"], r["n_umis"]) for r in streaming.exact_umi_counts(spark.read.parquet(path)).collect()}
    assert got == {1: (5, 3), 20: (1, 1)}
