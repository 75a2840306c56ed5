"""Queries p1, p3, p5 and p6 over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packed, rejects, skew, wide
from ..session import table

HEAVY_SHARE = 0.02

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = rejects.parse_report_lines(table(spark, sf_dir, "kreport_raw"), keep=["line_id"])
    return rejects.rejected_rows(parsed, keep=["line_id"]).select("line_id")


def p1_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.valid_rows(rejects.parse_report_lines(table(spark, sf_dir, "kreport_raw"), keep=["line_id"]))


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = rejects.parse_report_lines(table(spark, sf_dir, "kreport_raw"), keep=["sample_id"])
    return rejects.rejected_rows(parsed, keep=["sample_id"]).groupBy("sample_id", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        skew.keys_holding(table(spark, sf_dir, name), key, HEAVY_SHARE).select(F.lit(name).alias("source_table"), "key_value")
        for name, key in (("kmer", "taxid"), ("umi", "barcode"))
    ]
    return parts[0].unionByName(parts[1])


def p3_kmer_taxid(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggregates = [
        skew.Agg("n_rows", "count"),
        skew.Agg("kmer_len_sum", "sum", "kmer_len"),
        skew.Agg("n_unique_max", "max", "kmer_n_unique"),
        skew.Agg("n_unique_min", "min", "kmer_n_unique"),
        skew.Agg("n_barcodes", "count_distinct", "barcode"),
    ]
    return skew.salted_aggregate(table(spark, sf_dir, "kmer"), "taxid", aggregates)


def p3_umi_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggregates = [
        skew.Agg("n_rows", "count"),
        skew.Agg("n_umis", "count_distinct", "umi"),
        skew.Agg("n_taxids", "count_distinct", "taxid"),
        skew.Agg("first_seen", "min", "seen_at"),
        skew.Agg("last_seen", "max", "seen_at"),
    ]
    return skew.salted_aggregate(table(spark, sf_dir, "umi"), "barcode", aggregates)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.torn_cells(table(spark, sf_dir, "umi_attr"))


def p5_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.wide_rows(table(spark, sf_dir, "umi_attr"), columns=list(wide.COLUMNS)).drop("torn")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    koutput = packed.split_packed(table(spark, sf_dir, "koutput"), "koutput_id", "lca", packed.LCA)
    umi = packed.packed_ranks(table(spark, sf_dir, "umi"))
    named = [df.select(F.lit(name).alias("source_table"), "row_id", "pos", "val") for name, df in (("koutput", koutput), ("umi", umi))]
    return named[0].unionByName(named[1])


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_valid, p1_reasons, p3_found, p3_kmer_taxid, p3_umi_barcode, p5_found, p5_wide, p6_found)
}

# A column of a line: quoted with only spaces about it, or one whose first non-space character is no quote.
_FIELD = r'( *"(?:[^"]|"")*" *| *[^\t" ][^\t]*| *)'
_WS = r" \t\n\r\x0b\x0c"
_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def _line(n: int) -> str:
    return r"(?s)\A" + r"\t".join([_FIELD] * n) + r"\z"


def _report_sql() -> str:
    """CTEs up to ``checked``: line_id, the typed columns, and ok."""
    eight = ", ".join(f"{_pick(8, i)} AS f{i}" for i in range(1, 9))
    six = ", ".join(f"{_pick(6, j)} AS f{i}" if (j := {1: 1, 2: 2, 3: 3, 6: 4, 7: 5, 8: 6}.get(i)) else f"NULL AS f{i}" for i in range(1, 9))
    number = lambda c: f"trim({c}, E' \\t\\n\\r\\x0b\\x0c')"
    count = lambda c: f"(regexp_full_match({number(c)}, '\\+?[0-9]+') AND try_cast(ltrim({number(c)}, '+') AS HUGEINT) BETWEEN 0 AND 9223372036854775807)"
    big = lambda c: f"try_cast(ltrim({number(c)}, '+') AS BIGINT)"
    return f"""
WITH lines AS (
  SELECT line_id, regexp_replace(line, '\\r?\\n?\\z', '') AS l FROM kreport_raw WHERE regexp_matches(line, '\\S')
), counted AS (
  SELECT line_id, l, CASE WHEN regexp_matches(l, '{_line(8)}') THEN 8 WHEN regexp_matches(l, '{_line(6)}') THEN 6 ELSE 0 END AS n FROM lines
), fields AS (
  SELECT line_id, n, {eight} FROM counted WHERE n = 8
  UNION ALL SELECT line_id, n, {six} FROM counted WHERE n = 6
  UNION ALL SELECT line_id, n, {", ".join(["NULL"] * 8)} FROM counted WHERE n = 0
), checked AS (
  SELECT line_id, n, {", ".join(f"f{i}" for i in range(1, 9))}, try_cast({number("f1")} AS DOUBLE) AS percents, {big("f2")} AS total_reads, {big("f3")} AS reads, {big("f4")} AS minimizer_len,
    {big("f5")} AS minimizer_n_unique, f6 AS rank, f7 AS taxid, f8 AS name,
    coalesce(n > 0 AND regexp_full_match({number("f1")}, '{_NUMBER}') AND try_cast({number("f1")} AS DOUBLE) BETWEEN 0 AND 100
      AND {count("f2")} AND {count("f3")} AND (n = 6 OR ({count("f4")} AND {count("f5")})) AND {big("f3")} <= {big("f2")}
      AND regexp_full_match(f6, '[URDKPCOFGS][0-9]*') AND regexp_full_match(f7, '[0-9]+') AND regexp_matches(f8, '\\S'), false) AS ok
  FROM fields
)"""


def _pick(n: int, i: int) -> str:
    f = f"regexp_extract(l, '{_line(n)}', {i})"
    return f"CASE WHEN starts_with(ltrim({f}, ' '), '\"') THEN replace(substr(trim({f}, ' '), 2, length(trim({f}, ' ')) - 2), '\"\"', '\"') ELSE {f} END"


def _reasons_sql() -> str:
    """The first fault of every failing line: of its columns from the left, then of its fields."""
    number = lambda c: f"trim({c}, E' \\t\\n\\r\\x0b\\x0c')"
    rest = f"regexp_replace(l, '(?s)\\A({_FIELD}\\t)*', '')"  # from the first column on that isn't sound
    sound = f"regexp_matches(l, '(?s)\\A({_FIELD}\\t)*{_FIELD}\\z')"
    faults = [
        f"WHEN n = 0 AND NOT {sound} AND regexp_matches({rest}, '(?s)\\A *\"([^\"]|\"\")*\"') THEN 'text_after_quote'",
        f"WHEN n = 0 AND NOT {sound} THEN 'quote_not_closed'",
        "WHEN n = 0 THEN 'column_count'",
        f"WHEN NOT regexp_full_match({number('f1')}, '{_NUMBER}') THEN 'percents_not_a_number'",
        f"WHEN NOT coalesce(try_cast({number('f1')} AS DOUBLE) BETWEEN 0 AND 100, false) THEN 'percents_out_of_range'",
    ]
    for i, name in ((2, "total_reads"), (3, "reads"), (4, "minimizer_len"), (5, "minimizer_n_unique")):
        when = "n = 8 AND " if i > 3 else ""
        faults.append(f"WHEN {when}NOT regexp_full_match({number(f'f{i}')}, '\\+?[0-9]+') THEN '{name}_not_a_count'")
        faults.append(f"WHEN {when}try_cast(ltrim({number(f'f{i}')}, '+') AS BIGINT) IS NULL THEN '{name}_too_large'")
    faults += [
        "WHEN NOT regexp_full_match(f6, '[URDKPCOFGS][0-9]*') THEN 'rank_unknown'",
        "WHEN NOT regexp_full_match(f7, '[0-9]+') THEN 'taxid_not_digits'",
        "WHEN NOT regexp_matches(f8, '\\S') THEN 'name_blank'",
        "ELSE 'reads_above_total_reads'",
    ]
    return f"""{_report_sql()}
SELECT sample_id, CASE {" ".join(faults)} END AS reason, count(*) AS n_lines
FROM checked JOIN lines USING (line_id) JOIN kreport_raw USING (line_id) WHERE NOT ok GROUP BY ALL"""


_NAMES = "|".join(wide.RANK_NAMES.values())
_CELLS = f"""
WITH typed AS (
  SELECT umi_id, trim(taxon, E' \\t\\n\\r\\x0b\\x0c') AS v, lower(trim(ranks, E' \\t\\n\\r\\x0b\\x0c')) AS a FROM umi_attr
), named AS (
  SELECT umi_id, v, CASE WHEN a IN ('n_reads', 'weight', 'seen_on') THEN a
    WHEN regexp_full_match(a, '({_NAMES})[0-9]?') THEN a
    WHEN regexp_full_match(a, '[rdkpcofgs][0-9]?') THEN
      CASE a[1] {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in wide.RANK_NAMES.items())} END || a[2:] END AS c
  FROM typed
), cells AS (
  SELECT umi_id, c, v, CASE c
    WHEN 'n_reads' THEN CASE WHEN regexp_full_match(v, '\\+?[0-9]+') THEN try_cast(ltrim(v, '+') AS BIGINT)::VARCHAR END
    WHEN 'weight' THEN CASE WHEN regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN try_cast(v AS DOUBLE)::VARCHAR END
    WHEN 'seen_on' THEN CASE WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(v AS DATE)::VARCHAR END
    ELSE v END AS t
  FROM named WHERE c IS NOT NULL AND v <> ''
), summed AS (
  SELECT umi_id, c, count(DISTINCT t) AS n, count(*) - count(t) AS bad, min(t) AS t FROM cells GROUP BY ALL
)"""


def _wide_sql() -> str:
    kinds = {"n_reads": "BIGINT", "weight": "DOUBLE", "seen_on": "DATE"}
    columns = ", ".join(f"max(CASE WHEN c = '{c}' AND n = 1 AND bad = 0 THEN t END)::{kinds.get(c, 'VARCHAR')} AS \"{c}\"" for c in wide.COLUMNS)
    return f"{_CELLS}\nSELECT e.umi_id, {columns} FROM (SELECT DISTINCT umi_id FROM umi_attr) e LEFT JOIN summed s ON e.umi_id IS NOT DISTINCT FROM s.umi_id GROUP BY e.umi_id"


_PACKED = r"""
WITH lca AS (
  SELECT koutput_id AS row_id, regexp_extract_all(lca, '(?s)"(?:[^"]|"")*"|[^\s\x{00a0},;|/"]+') AS t FROM koutput
), pairs AS (
  SELECT row_id, list_filter(t, lambda x: regexp_full_match(x, '([0-9]+|A):[0-9]+|(?s)".*\S.*:[0-9]+"')) AS t FROM lca
), ranks AS (
  SELECT umi_id AS row_id, regexp_extract_all(array_to_string(list_filter(ranks, lambda x: x IS NOT NULL), ','), '[A-Za-z][0-9]*') AS t FROM umi
  WHERE len(list_filter(ranks, lambda x: len(regexp_extract_all(x, '[A-Za-z][0-9]*')) > 1)) > 0
), every AS (
  SELECT 'koutput' AS source_table, row_id, unnest(t) AS v, unnest(range(len(t))) AS pos FROM pairs
  UNION ALL SELECT 'umi', row_id, unnest(t), unnest(range(len(t))) FROM ranks
)
SELECT source_table, row_id, pos::INTEGER AS pos, CASE WHEN v[1] = '"' THEN replace(v[2:-2], '""', '"') ELSE v END AS val FROM every"""

SQL: dict[str, str] = {
    "p1_found": _report_sql() + "\nSELECT line_id FROM checked WHERE NOT ok",
    "p1_valid": _report_sql() + "\nSELECT * EXCLUDE (ok, n, f1, f2, f3, f4, f5, f6, f7, f8) FROM checked WHERE ok",
    "p1_reasons": _reasons_sql(),
    "p3_found": """
SELECT 'kmer' AS source_table, taxid AS key_value FROM kmer WHERE taxid IS NOT NULL GROUP BY taxid HAVING count(*) >= 0.02 * (SELECT count(*) FROM kmer)
UNION ALL
SELECT 'umi', barcode FROM umi WHERE barcode IS NOT NULL GROUP BY barcode HAVING count(*) >= 0.02 * (SELECT count(*) FROM umi)""",
    "p3_kmer_taxid": """
SELECT taxid AS key_value, count(*) AS n_rows, sum(kmer_len)::BIGINT AS kmer_len_sum, max(kmer_n_unique) AS n_unique_max, min(kmer_n_unique) AS n_unique_min,
  count(DISTINCT barcode) AS n_barcodes FROM kmer GROUP BY taxid""",
    "p3_umi_barcode": """
SELECT barcode AS key_value, count(*) AS n_rows, count(DISTINCT umi) AS n_umis, count(DISTINCT taxid) AS n_taxids, min(seen_at) AS first_seen, max(seen_at) AS last_seen
FROM umi GROUP BY barcode""",
    "p5_found": f"{_CELLS}\nSELECT umi_id, c AS col_name FROM summed WHERE n > 1 OR bad > 0",
    "p5_wide": _wide_sql(),
    "p6_found": _PACKED,
}
