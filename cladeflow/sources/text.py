"""Readers of tab-separated classification texts, reports and cell-line tables. Gzip is told by the extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import refine
from ..session import ship


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    ship(spark)
    return spark.read.text(path).filter(F.trim("value") != "")


def field(i: int, line: Column | str = "value") -> Column:
    """Field ``i`` (from 0) of a tab-separated line, null if it has fewer."""
    return F.get(F.split(line, "\t"), i)


def read_koutput(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Classification rows: ``status, id, taxid_text, length, lca`` and the ``line`` itself. Short lines have nulls."""
    names = ("status", "id", "taxid_text", "length", "lca")
    return _lines(spark, path).select(*[field(i).alias(n) for i, n in enumerate(names)], F.col("value").alias("line"))


def read_ids(spark: SparkSession, koutput: str | list[str]) -> DataFrame:
    """``id`` of the classification rows; empty and missing ones are left out."""
    return _lines(spark, koutput).select(field(1).alias("id")).filter(F.col("id") != "")


def read_koutreads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Classified reads: ``taxid``, ``tags`` (a map), ``lca``, ``seq``, ``qual``. A line without just 5 fields is an error.

    Of a tag that occurs more than once the last one holds; one without a colon has a null value.
    """
    fields = F.split("value", "\t")
    bad = F.raise_error(F.concat(F.lit("a line of classified reads has "), F.size(fields).cast("string"), F.lit(" fields, not 5")))
    lines = _lines(spark, path).select(F.when(F.size(fields) == 5, fields).otherwise(bad).alias("f"))
    tokens = F.filter(F.split(F.col("f")[1], " "), lambda t: t != "")
    value = lambda t: F.when(F.contains(t, F.lit(":")), F.substr(t, F.instr(t, ":") + 1))
    tags = refine.tag_map(F.transform(tokens, lambda t: F.struct(F.substring_index(t, ":", 1).alias("key"), value(t).alias("value"))))
    return lines.select(F.col("f")[0].alias("taxid"), tags.alias("tags"), *[F.col("f")[i].alias(n) for i, n in ((2, "lca"), (3, "seq"), (4, "qual"))])


_SPACE = r"[ \t\n\x0c\r]*"
_FLOAT = rf"^{_SPACE}[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan)){_SPACE}$"
_COUNT = rf"^{_SPACE}\+?[0-9]+{_SPACE}$"


def read_report(spark: SparkSession, path: str | list[str], fail: bool = True) -> DataFrame:
    """Rows of report files: ``file``, ``line_no`` (their order), ``percents, total_reads, reads, minimizer_len,
    minimizer_n_unique, rank, taxid, name`` (with its indent).

    Lines are split at tabs and nothing else: a quote is text like any other. Blank lines are skipped. A line without 6 or
    8 fields, or with a number that is none, is an error; with ``fail`` off such lines are left out. Minimizers of
    unclassified rows (ranks ``U...``) are not looked at; any rank, taxid and name is taken. A report is a small file:
    each is read by one task. (Quoted lines with reasons for failure are the business of :mod:`..operators.rejects`.)
    """
    ship(spark)
    lines = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"\r$", "")).filter(F.col("line").rlike(r"\S"))
    f = F.split("line", "\t")
    n = F.size(f)
    at = lambda eight, six: F.get(f, F.when(n == 8, F.lit(eight)).otherwise(F.lit(six) if six is not None else F.lit(None).cast("int")))
    number = lambda x: F.regexp_replace(x, r"\s", "").try_cast("bigint")
    count = lambda x: x.rlike(_COUNT) & number(x).isNotNull()
    rows = lines.select("file", "line_no", "line", n.alias("n"), at(0, 0).alias("p"), at(1, 1).alias("t"), at(2, 2).alias("r"), at(3, None).alias("l"), at(4, None).alias("u"), at(5, 3).alias("rank"), at(6, 4).alias("taxid"), at(7, 5).alias("name"))
    unclassified = F.col("rank").startswith("U")
    good = F.col("n").isin(6, 8) & F.col("p").rlike(_FLOAT) & count(F.col("t")) & count(F.col("r")) & ((F.col("n") == 6) | unclassified | (count(F.col("l")) & count(F.col("u"))))
    good = F.coalesce(good, F.lit(False))
    if fail:
        reason = F.when(F.col("n").isin(6, 8), F.lit("a field is not a number")).otherwise(F.lit("column_count"))
        message = F.concat(F.lit("a report line fails ("), reason, F.lit("): "), F.col("line"))
        rows = rows.withColumn("rank", F.when(good, F.col("rank")).otherwise(F.raise_error(message)))
    else:
        rows = rows.filter(good)
    numbers = [number(F.col(c)).alias(name) for c, name in (("t", "total_reads"), ("r", "reads"), ("l", "minimizer_len"), ("u", "minimizer_n_unique"))]
    return rows.select("file", "line_no", F.regexp_replace("p", r"\s", "").try_cast("double").alias("percents"), *numbers, "rank", "taxid", "name")


def read_cell_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``taxid`` (text) and ``rpmm`` of a space-separated table with a header."""
    ship(spark)
    return spark.read.csv(path, sep=" ", header=True, inferSchema=False).select(F.col("taxid").cast("string"), F.col("rpmm").cast("double"))
