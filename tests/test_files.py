import pytest

from cladeflow.functions import ranges as R
from cladeflow.plans import files
from cladeflow.sources import fastq, text

REPORT = ["\t".join(x) for x in [(" 90.00", "90", "0", "D", "2", "  Bacteria"), (" 50.00", "50", "20", "G", "561", "    Escherichia"), (" 30.00", "30", "30", "S", "562", "      Escherichia coli"), ("  5.00", "5", "5", "D", "2759", "  Eukaryota")]]
SEQ = "ACGTTGCAACGTACGTTGCATTGCACGTACGTACGTACGT"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "r.txt").write_text("\n".join(REPORT) + "\n")
    n = len(SEQ)
    kout = [f"C\ta\t562\t{n - 6}\t562:4 0:2", f"C\tb\tEscherichia (taxid 561)\t{n - 6}\t561:6", f"C\tc\t2759\t{n - 6}\t2759:6", f"U\td\t0\t{n - 6}\t0:6", f"C\te\t562\t{n - 6}\t562:1 9606:5"]
    (tmp_path / "k.txt").write_text("\n".join(kout) + "\n")
    (tmp_path / "x.fq").write_text("".join(f"@{c}\n{SEQ}\n+\n{'I' * n}\n" for c in "abcdef"))
    return tmp_path


def test_from_files_to_counts(spark, folder):
    p = lambda name: str(folder / name)
    files.refine_fastq(spark, p("x.fq"), p("refined"), umi=R.seq_range(1, 2), barcode=R.seq_range(3, 6), ordered=True)
    got = fastq.read_fastq(spark, p("refined")).orderBy("file", "pos").collect()
    assert [r["id"] for r in got] == list("abcdef") and got[0]["desc"] == "SEQTAG{UMI:AC:BARCODE:GTTG}" and got[0]["seq"] == SEQ[6:]
    files.select_koutput(spark, p("r.txt"), p("k.txt"), p("kept"), ranks=["G"], exclude=["9606"])
    assert sorted(r["id"] for r in text.read_koutput(spark, p("kept")).collect()) == ["a", "b"]
    files.select_koutput(spark, p("r.txt"), p("k.txt"), p("kept2"), exclude=["9606"])
    assert text.read_koutput(spark, p("kept2")).count() == 4
    files.extract_fastq(spark, p("kept"), p("refined"), p("extracted"), gzip=True)
    assert sorted(r["id"] for r in fastq.read_fastq(spark, p("extracted")).collect()) == ["a", "b"]
    files.classified_reads(spark, p("r.txt"), p("k.txt"), p("refined"), out=p("joined"), taxa_in=["D__Bacteria"], exclude=["9606"])
    counts = files.count_classified(spark, p("joined"), p("r.txt"), ["D__Bacteria"], "BARCODE", "UMI")
    assert {(r["barcode"], r["taxid"]): (r["reads"], r["kmer_total"]) for r in counts.collect()} == {("GTTG", "2"): (1, 12), ("GTTG", "561"): (1, 12), ("GTTG", "562"): (1, 6)}
    bulk = files.count_classified(spark, p("joined"), p("r.txt"), ["D__Bacteria"], ranks=["G"]).collect()
    assert [(r["barcode"], r["taxid"], r["reads"]) for r in bulk] == [("", "561", 2)]


def test_arguments(spark, folder):
    p = lambda name: str(folder / name)
    with pytest.raises(ValueError, match="at least one"):
        files.select_koutput(spark, p("r.txt"), p("k.txt"), p("o"))
    with pytest.raises(ValueError, match="need mates"):
        files.refine_fastq(spark, p("x.fq"), p("o"), umi=R.seq_range(1, 2), mates_out=p("o2"))
    with pytest.raises(ValueError, match="no row"):
        files.report_lineages(spark, p("r.txt"), ["D__Archaea"])
    (folder / "empty.txt").write_text("\n")
    with pytest.raises(ValueError, match="no classified rows"):
        files.report_lineages(spark, p("empty.txt"))
