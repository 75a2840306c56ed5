import pytest

from cladeflow.operators import packed


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("562:3 561:4 A:31 0:1", ["562:3", "561:4", "A:31", "0:1"]),
        ("1:2,,3:4 |:| 5:6;; 7:8 ", ["1:2", "3:4", "5:6", "7:8"]),
        ("1:2|:|3:4", ["1:2", "3:4"]),
        ("1:2 / 3:4\t5:6\xa07:8", ["1:2", "3:4", "5:6", "7:8"]),
        ('"A b, c (taxid 5):6" "7:8"', ["A b, c (taxid 5):6", "7:8"]),
        ('"A ""b"" (taxid 5):6";1:2', ['A "b" (taxid 5):6', "1:2"]),
        ("", []), ("|:|", []), ('""', []), (" x 1:y ", []), ('"1:2', ["1:2"]),
    ],
)
def test_lca(text, expected):
    assert packed.values([text], packed.LCA) == expected


@pytest.mark.parametrize("text", ["D,P1,S", "D|P1|S|", " D | P1 | S ", "D / P1 / S", "['D', 'P1', 'S']", "{D,P1,S}", '"D","P1","S"', "D;;P1;;S", "D\tP1\tS", "D>P1>S", "D - P1 - S"])
def test_ranks(text):
    assert packed.values([text], packed.RANKS) == ["D", "P1", "S"]


def test_escape_and_nesting():
    g = packed.Grammar(delimiters=",", quotes='"', brackets={"[": "]"}, escape="\\")
    assert packed.values(["[a,[b,c],d\\,e,\"f,\\\"g\"]"], g) == ["a", "[b,c]", "d,e", 'f,"g']


def test_operator(spark):
    df = spark.createDataFrame([(1, ["D", None, "P, C", ""], 0), (2, ["D", "P"], 0), (3, None, 0), (None, ["g s1"], 0), (4, [], 0), (1, ["D", None, "P, C", ""], 0)], "umi_id long, ranks array<string>, pos int")
    got = sorted((tuple(r) for r in packed.packed_ranks(df).collect()), key=str)
    assert got == sorted([(1, 0, "D"), (1, 1, "P"), (1, 2, "C"), (None, 0, "g"), (None, 1, "s1")] + [(1, 0, "D"), (1, 1, "P"), (1, 2, "C")], key=str)
    empty = spark.createDataFrame([], "id long, lca string")
    assert packed.split_packed(empty, "id", "lca", packed.LCA).collect() == []
    long = spark.createDataFrame([(1, "1:2 " * 50_000)], "id long, lca string")
    assert packed.split_packed(long, "id", "lca", packed.LCA).count() == 50_000
