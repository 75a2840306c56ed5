import datetime
import random

import pytest

from cladeflow.operators import wide


@pytest.mark.parametrize(("attribute", "column"), [("S1", "species1"), (" g ", "genus"), ("Genus", "genus"), ("R", "root"), ("N_READS\t", "n_reads"), ("species12", None), ("x", None), ("", None), (None, None), ("U", None)])
def test_attributes(attribute, column):
    assert wide.column_of(attribute) == column


@pytest.mark.parametrize(
    ("column", "text", "value"),
    [
        ("n_reads", "+07", 7), ("n_reads", "-1", wide.TORN), ("n_reads", "1.0", wide.TORN), ("n_reads", "9223372036854775808", wide.TORN), ("n_reads", "٣", wide.TORN),
        ("weight", "-1.50", -1.5), ("weight", "1e3", wide.TORN), ("weight", ".5", 0.5), ("weight", "9" * 400, wide.TORN), ("weight", "inf", wide.TORN),
        ("seen_on", "2024-02-29", datetime.date(2024, 2, 29)), ("seen_on", "2023-02-29", wide.TORN), ("seen_on", "20240229", wide.TORN), ("genus", "x", "x"),
    ],
)
def test_typing(column, text, value):
    assert wide.encode(column, text) == value


def test_merge_is_associative():
    cells = [None, "a", "b", wide.TORN]
    for a in cells:
        for b in cells:
            assert wide.merge_cell(a, b) == wide.merge_cell(b, a)
            for c in cells:
                assert wide.merge_cell(wide.merge_cell(a, b), c) == wide.merge_cell(a, wide.merge_cell(b, c))


def test_wide_rows(spark):
    data = [
        (1, "G", "Aa"), (1, "genus ", " Aa "), (1, "n_reads", "+5"), (1, "N_reads", "05"), (1, "S1", None),
        (2, "G", "Aa"), (2, "g", "aa"), (2, "weight", "1.5"), (2, "Weight", "1.50"), (2, "seen_on", "2023-13-01"),
        (3, "nonsense", "x"), (None, "G", "Bb"), (4, None, "x"), (4, "G", "  "),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "umi_id long, ranks string, taxon string, genus int")
    got = {r["umi_id"]: r for r in wide.wide_rows(df).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert (got[1]["genus"], got[1]["n_reads"], got[1]["species1"], got[1]["torn"]) == ("Aa", 5, None, [])
    assert (got[2]["genus"], got[2]["weight"], got[2]["torn"]) == (None, 1.5, ["genus", "seen_on"])
    assert got[None]["genus"] == "Bb" and got[3]["genus"] is None and got[4]["genus"] is None
    assert {(r["umi_id"], r["col_name"]) for r in wide.torn_cells(df).collect()} == {(2, "genus"), (2, "seen_on")}
    assert wide.wide_rows(df).columns == ["umi_id", "genus", "species1", "n_reads", "weight", "seen_on", "torn"]


def test_empty_and_hot_entity(spark):
    empty = spark.createDataFrame([], "umi_id long, ranks string, taxon string")
    assert wide.wide_rows(empty).collect() == [] and wide.torn_cells(empty).collect() == []
    r = random.Random(1)
    data = [(7, "P", "x" * 100_000)] + [(7, r.choice(["P", "p", "phylum "]), "x" * 100_000)] * 20 + [(i % 3, "C", "y") for i in range(3000)]
    got = {x["umi_id"]: x for x in wide.wide_rows(spark.createDataFrame(data, "umi_id long, ranks string, taxon string")).collect()}
    assert got[7]["phylum"] == "x" * 100_000 and got[0]["class"] == "y"


def test_letters_beyond_ascii_are_of_no_attribute(spark):
    kelvin = "\u212a"  # its lower case is k
    assert wide.column_of(kelvin) is None and wide.column_of(" \u2003K1\u00a0") == "kingdom1"
    for other in ("s", "k"):
        df = spark.createDataFrame([(1, kelvin, "x"), (1, other, "y")], "umi_id long, ranks string, taxon string")
        row = wide.wide_rows(df, columns=["kingdom", "species"]).first()
        assert (row["kingdom"], row["species"], row["torn"]) == (("y", None, []) if other == "k" else (None, "y", []))
