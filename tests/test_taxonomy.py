import pytest

from cladeflow.functions import ranks
from cladeflow.operators import taxonomy
from cladeflow.sources import text

LINES = [
    " 10.00\t10\t10\t0\t0\tU\t0\tunclassified",
    " 90.00\t90\t0\t900\t90\tR\t1\troot",
    " 90.00\t90\t0\t900\t90\tR1\t131567\t  cellular organisms",
    " 60.00\t60\t5\t600\t60\tD\t2\t    Bacteria",
    " 55.00\t55\t5\t550\t55\tP\t1224\t      Proteobacteria",
    " 50.00\t50\t20\t500\t50\tG\t561\t        Escherichia",
    "",
    " 30.00\t30\t30\t300\t30\tS\t562\t          Escherichia coli",
    " 30.00\t30\t30\t300\t30\tD\t2759\t    Eukaryota",
]


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("report") / "a.kreport"
    p.write_text("\r\n".join(LINES) + "\r\n")
    return taxonomy.add_lineage(text.read_report(spark, str(p)), ["file"], ["line_no"]).cache()


def ids(df):
    return sorted(r["taxid"] for r in df.collect())


def test_lineage(report):
    rows = {r["taxid"]: r for r in report.collect()}
    assert len(rows) == 7 and "0" not in rows
    assert [(x["rank"], x["taxid"]) for x in rows["562"]["lineage"]] == [("D", "2"), ("P", "1224"), ("G", "561"), ("S", "562")]
    assert rows["562"]["level"] == 5 and rows["562"]["taxon"] == "Escherichia coli" and rows["562"]["minimizer_n_unique"] == 30
    assert [x["taxid"] for x in rows["2759"]["lineage"]] == ["2759"]
    assert [x["taxid"] for x in rows["131567"]["lineage"]] == ["131567"]


def test_filters(report):
    assert ids(taxonomy.filter_taxonomy(report, ["D__Bacteria", "x"])) == ["1224", "2", "561", "562"]
    assert ids(taxonomy.filter_taxonomy(report, None)) == ids(report)
    with pytest.raises(ValueError, match="no row"):
        taxonomy.filter_taxonomy(report, ["d__Bacteria"], check=True)
    with pytest.raises(ValueError, match="rank__name"):
        taxonomy.filter_taxonomy(report, ["Bacteria"])


def test_selection(report):
    assert ids(taxonomy.select_taxa(report, ranks=["G"])) == ["561", "562"]
    assert ids(taxonomy.select_taxa(report, ranks=["G"], descendants=False)) == ["561"]
    assert ids(taxonomy.select_taxa(report, ["D__Eukaryota"], ranks=["G"])) == []
    assert ids(taxonomy.select_taxa(report, taxa=["Bacteria"], ranks=["D"], taxids=["2", None])) == ["1224", "2", "561", "562"]
    assert ids(taxonomy.select_taxa(report, ["D__Eukaryota"])) == ["2759"]
    with pytest.raises(ValueError, match="at least one"):
        taxonomy.select_taxa(report, ranks=[None])


def test_rank_columns_and_order(spark, report):
    row = {r["taxid"]: r for r in taxonomy.rank_columns(report, ["D", "S"], ["taxid"]).collect()}
    assert (row["562"]["D"], row["562"]["S"], row["1224"]["S"]) == ("Bacteria", "Escherichia coli", None)
    df = spark.createDataFrame([(r,) for r in ["S", "G2", "R1", "Dx", "G", "X", "U", "D", "G10"]], "rank string")
    assert [r["rank"] for r in df.orderBy(ranks.order_key(df["rank"])).collect()] == ["U", "R1", "D", "Dx", "G", "G2", "G10", "S", "X"]
    names = {r["rank"]: r["n"] for r in df.select("rank", ranks.full_name(df["rank"]).alias("n")).collect()}
    assert (names["G2"], names["S"], names["X"], names["R1"]) == ("genus2", "species", "X", "root1")


def test_many_reports_and_odd_indents(spark):
    rows = [("a", 1, "D", "1", "  A", 1), ("a", 2, "P", "2", "    B", 1), ("b", 1, "D", "3", "  C", 1), ("a", 3, "G", "4", "          jump", 1), ("a", 4, "C", "5", "      D", 1), ("b", 2, "U", "0", "u", 1), ("b", 3, None, "9", None, 1)]
    df = spark.createDataFrame(rows, "f string, i int, rank string, taxid string, name string, taxon int")
    got = {(r["f"], r["i"]): [x["taxid"] for x in r["lineage"]] for r in taxonomy.add_lineage(df, ["f"], ["i"]).collect()}
    # a row that skips levels closes all open rows
    assert got == {("a", 1): ["1"], ("a", 2): ["1", "2"], ("b", 1): ["3"], ("a", 3): ["4"], ("a", 4): ["5"]}


def test_report_that_fails(spark, tmp_path):
    p = tmp_path / "bad.kreport"
    p.write_text(LINES[1] + "\nx\ty\n")
    with pytest.raises(Exception, match="column_count"):
        text.read_report(spark, str(p)).collect()
    assert text.read_report(spark, str(p), fail=False).count() == 1


def test_quotes_and_odd_ranks_are_ordinary_text(spark, tmp_path):
    p = tmp_path / "q.kreport"
    names = ["  Bacteria", '    "Bacillus"', '      "Bacillus" sp.', "      half\"open", "    tail"]
    ranks = ["D", "G", "S", "-", "X1"]
    p.write_text("".join(f" 1.5\t9\t+1\t{r}\t{i}\t{name}\n" for i, (r, name) in enumerate(zip(ranks, names))))
    rows = {r["taxid"]: r for r in taxonomy.add_lineage(text.read_report(spark, str(p)), ["file"], ["line_no"]).collect()}
    assert [rows[str(i)]["taxon"] for i in range(5)] == [n.lstrip() for n in names]
    assert [rows[str(i)]["level"] for i in range(5)] == [1, 2, 3, 3, 2]
    lineage = lambda i: [x["taxid"] for x in rows[i]["lineage"]]
    assert [lineage("2"), lineage("3"), lineage("4")] == [["0", "1", "2"], ["0", "1", "3"], ["0", "4"]]
    assert rows["0"]["reads"] == 1 and rows["0"]["minimizer_len"] is None


@pytest.mark.parametrize("line", ["1d\t1\t1\tD\t1\tx", "1\t1.5\t1\tD\t1\tx", "1\t1\t-1\tD\t1\tx", "1\t1\t1\t\t1\tD\t1\tx"])
def test_numbers_of_reports(spark, tmp_path, line):
    p = tmp_path / "n.kreport"
    p.write_text(line + "\n 1\t 1 \t1\t?\t?\tU\t0\tunclassified\n")
    with pytest.raises(Exception, match="not a number"):
        text.read_report(spark, str(p)).collect()
    assert [r["rank"] for r in text.read_report(spark, str(p), fail=False).collect()] == ["U"]
