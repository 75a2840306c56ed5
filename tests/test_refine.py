import pytest

from cladeflow.functions import ranges as R
from cladeflow.operators import refine


def test_ranges():
    with pytest.raises(ValueError, match="after the end"):
        R.seq_range(5, 4)
    with pytest.raises(ValueError, match="start or an end"):
        R.seq_range()
    with pytest.raises(ValueError, match="from 1"):
        R.seq_range(0)
    with pytest.raises(ValueError, match="overlap"):
        R.embed("UMI", [R.seq_range(1, 4), R.seq_range(3, 6)])
    assert [repr(r) for r in R.embed("UMI", [R.seq_range(5, 6), R.seq_range(1, 4)]).ranges] == ["1..4", "5..6"]
    with pytest.raises(ValueError, match="more than one"):
        R.embed("UMI", [R.seq_range(end=2), R.seq_range(end=4)])
    with pytest.raises(ValueError, match="overlap"):
        R.embed("UMI", [R.seq_range(start=3), R.seq_range(end=3)])
    assert R.merged(R.seq_range(1, 2) + R.seq_range(2, 4)) == [(0, 4)]
    with pytest.raises(ValueError, match="label"):
        R.tags_for([R.seq_range(1, 2)])
    assert R.tags_for({"A": R.seq_range(1)})[0].label == "A"
    assert isinstance(R.extra_actions(R.seq_range(1, 2))[0], R.Trim) and isinstance(R.action_for(R.seq_range(1, 2), "UMI")[0], R.EmbedTrim)


def reads(spark, rows):
    return spark.createDataFrame(rows, "id string, desc string, seq string, qual string")


def one(df):
    return tuple(df.select("desc", "seq", "qual").first())


def test_single(spark):
    df = reads(spark, [("r", None, "GATTTGGGG", "IIIIIIIII")])
    assert one(refine.refine(df, umi=R.embed("UMI", [R.seq_range(start=4), R.seq_range(end=2)]), prefix="T"))[0] == "T{UMI:GATTGGGG}"
    df = reads(spark, [("r", "d", "ACGTT", "ABCDE")])
    assert one(refine.refine(df, umi=R.seq_range(1, 3), prefix="T")) == ("d T{UMI:ACG}", "TT", "DE")
    df = reads(spark, [("r", "d", "ACGTACGT", "ABCDEFGH")])
    assert one(refine.refine(df, extra=[R.seq_range(1, 2), R.trim([R.seq_range(2, 4)])])) == ("d", "ACGT", "EFGH")
    assert one(refine.refine(df, barcode=R.embed_trim("B", R.seq_range(3, 4)), umi=R.seq_range(start=7), prefix="T")) == ("d T{UMI:GT:B:GT}", "ACAC", "ABEF")
    with pytest.raises(ValueError, match="at least one action"):
        refine.refine(df)


@pytest.mark.parametrize(("r", "ok"), [(R.seq_range(end=9), False), (R.seq_range(start=9), False), (R.seq_range(7, 9), False), (R.seq_range(start=8), True), (R.seq_range(5, 5), True)])
def test_bounds(spark, r, ok):
    df = refine.refine(reads(spark, [("r", None, "ACGTACGT", "IIIIIIII")]), umi=R.embed("U", r), prefix="T")
    if ok:
        assert one(df)[0] == ("T{U:T}" if r.kind == "from" else "T{U:A}")
    else:
        with pytest.raises(Exception, match="out of bounds"):
            df.collect()


def test_pair(spark):
    schema = "id string, desc1 string, seq1 string, qual1 string, desc2 string, seq2 string, qual2 string"
    df = spark.createDataFrame([("a", None, "ACGT", "!!!!", None, "TTAA", "$$$$"), ("b", "x", "TGCA", "####", "y", "AATT", "%%%%")], schema)
    out = refine.refine_pair(df, umi1=R.embed("UMI", [R.seq_range(start=4), R.seq_range(end=2)]), prefix="T").orderBy("id").collect()
    assert [(r["desc1"], r["desc2"], r["seq1"], r["seq2"]) for r in out] == [("T{UMI:ACT}", "T{UMI:ACT}", "ACGT", "TTAA"), ("x T{UMI:TGA}", "y T{UMI:TGA}", "TGCA", "AATT")]
    out = refine.refine_pair(df, umi1=R.seq_range(1, 1), umi2=R.seq_range(2, 3), prefix="T").orderBy("id").first()
    assert (out["desc1"], out["seq1"], out["seq2"], out["qual2"]) == ("T{UMI:ATA}", "CGT", "TA", "$$")


@pytest.mark.parametrize(("desc", "expected"), [("T{UMI:AC:BARCODE:GG}", {"UMI": "AC", "BARCODE": "GG"}), ("T{UMI}", {}), ("T{A:C:B}", {"A": "C"}), ("x", {}), ("q T{A:C:A:G}", {"A": "G"})])
def test_parse_tags(spark, desc, expected):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(desc,)], "desc string").select(refine.parse_tags(F.col("desc"), "T").alias("t")).first()["t"] == expected


@pytest.mark.parametrize("prefix", ["T+", "a.b", "(x", "[q]"])
def test_prefix_is_no_pattern(spark, prefix):
    from pyspark.sql import functions as F

    df = refine.refine(reads(spark, [("r", "d", "ACGTT", "IIIII")]), umi=R.seq_range(1, 3), prefix=prefix)
    assert df.select(refine.parse_tags(F.col("desc"), prefix).alias("t")).first()["t"] == {"UMI": "ACG"}
