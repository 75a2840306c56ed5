import pytest

from cladeflow.operators import rejects

GOOD8 = " 10.00\t10\t9\t0\t0\tG2\t561\t        Escherichia"
GOOD6 = "1e1\t+010\t 9 \tS\t562\tx"


def reason(line):
    parsed = rejects.parse_line(line)
    return parsed and parsed[1]


@pytest.mark.parametrize("line", [GOOD8, GOOD6, GOOD8 + "\r", '.5\t1\t0\tU\t0\t "a""b" ', "5.\t9223372036854775807\t0\tD\t1\ta\"b", '"1"\t"2"\t"1"\tD\t1\t"a\tb"', "0\t1\t1\tS\t1\t\xa0x"])
def test_valid_lines(line):
    assert reason(line) is None and rejects.parse_line(line)[0] is not None


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("a\tb", "column_count"),
        (GOOD6 + "\t", "column_count"),
        (GOOD6.replace("x", '"x'), "quote_not_closed"),
        (GOOD6.replace("x", '"x" y'), "text_after_quote"),
        (GOOD6.replace("x", '"x"y'), "text_after_quote"),
        (GOOD6.replace("x", " "), "name_blank"),
        (GOOD6.replace("x", '"  "'), "name_blank"),
        (GOOD6.replace("1e1", "1,5"), "percents_not_a_number"),
        (GOOD6.replace("1e1", "１"), "percents_not_a_number"),
        (GOOD6.replace("1e1", "nan"), "percents_not_a_number"),
        (GOOD6.replace("1e1", "1e999"), "percents_out_of_range"),
        (GOOD6.replace("1e1", "100.01"), "percents_out_of_range"),
        (GOOD6.replace("1e1", "-1"), "percents_out_of_range"),
        (GOOD6.replace("+010", "1_0"), "total_reads_not_a_count"),
        (GOOD6.replace("+010", "9223372036854775808"), "total_reads_too_large"),
        (GOOD6.replace(" 9 ", "\xa09"), "reads_not_a_count"),
        (GOOD6.replace(" 9 ", "11"), "reads_above_total_reads"),
        (GOOD6.replace("\tS\t", "\ts\t"), "rank_unknown"),
        (GOOD6.replace("562", "5x"), "taxid_not_digits"),
        (GOOD8.replace("\t0\t0\t", "\t-1\t0\t"), "minimizer_len_not_a_count"),
    ],
)
def test_reasons(line, expected):
    assert reason(line) == expected


@pytest.mark.parametrize("line", [None, "", "  ", "\t\t", "\r"])
def test_blank_lines_are_no_cases(line):
    assert rejects.parse_line(line) is None


def test_quoted_content_counts():
    row, _ = rejects.parse_line('"1"\t "2" \t1\tD\t1\t  "a\tb""c" ')
    assert (row["percents"], row["total_reads"], row["name"]) == (1.0, 2, 'a\tb"c')
    row, _ = rejects.parse_line("1\t2\t1\tD\t1\ta\rb")  # an inner carriage return is ordinary
    assert row["name"] == "a\rb"


def test_operator_keeps_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", GOOD8), (2, "b", "x"), (3, None, None), (4, "d", GOOD8), (None, "e", "y")], "id int, rank string, line string")
    parsed = rejects.parse_report_lines(df)
    valid = sorted((r["id"], r["in_rank"], r["rank"]) for r in rejects.valid_rows(parsed).collect())
    assert valid == [(1, "a", "G2"), (4, "d", "G2")]
    bad = {(r["id"], r["in_rank"], r["reason"], r["raw"]) for r in rejects.rejected_rows(parsed).collect()}
    assert bad == {(2, "b", "column_count", "x"), (None, "e", "column_count", "y")}
    assert "MapInArrow" in parsed._jdf.queryExecution().toString() and "Exchange" not in parsed._jdf.queryExecution().toString()


def test_empty_table_and_very_long_line(spark):
    df = spark.createDataFrame([], "id int, line string")
    assert rejects.parse_report_lines(df).collect() == []
    name = "n" * 300_000
    df = spark.createDataFrame([(1, f'1\t1\t1\tS\t1\t"{name}"')], "id int, line string")
    assert rejects.parse_report_lines(df).first()["name"] == name
