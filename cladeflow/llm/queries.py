"""Queries p2, p4, p7, p8 and p9 over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, table
from . import distinct, packing, quantiles, subjects, tokens

POINTS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
SCOPES = {"taxid": ["taxid"], "day": ["measured_on"], "all": []}


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentiles(table(spark, sf_dir, "cell_lines"), SCOPES, "rpmm", POINTS)


def p2_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each percentile lies within the stated error, held against the exact ranks of all values."""
    rows = table(spark, sf_dir, "cell_lines").filter(F.col("rpmm").isNotNull() & ~F.isnan("rpmm")).select("taxid", "measured_on", "rpmm")
    found = checkpointed(p2_percentiles(spark, sf_dir))
    near = F.abs(F.col("value")) * F.lit(quantiles.VALUE_ERROR)
    low, high = F.coalesce(F.col("value") - near, F.col("value")), F.coalesce(F.col("value") + near, F.col("value"))
    low, high = (F.when(F.isnan(x), F.col("value")).otherwise(x) for x in (low, high))
    out = None
    for scope, keys in SCOPES.items():
        part = found.filter(F.col("scope") == scope).select(*[F.col(k).alias(f"of_{k}") for k in keys], "p", "value", "n", "rank_error", low.alias("low"), high.alias("high"))
        wide = part.groupBy(*[f"of_{k}" for k in keys]).agg(F.collect_list(F.struct("p", "n", "rank_error", "low", "high")).alias("found"))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
        # one row of found percentiles for each group
        joined = rows.join(F.broadcast(wide) if not keys else wide, on).select(*keys, "rpmm", F.explode("found").alias("f"))
        counts = joined.groupBy(*keys, "f.p", "f.n", "f.rank_error").agg(F.count_if(F.col("rpmm") < F.col("f.low")).alias("below"), F.count_if(F.col("rpmm") <= F.col("f.high")).alias("upto"))
        rank = F.greatest(F.ceil(F.col("p") * F.col("n")), F.lit(1))
        ok = (F.col("below") < rank + F.col("rank_error")) & (F.col("upto") >= rank - F.col("rank_error")) & (F.col("rank_error") <= F.col("n") * quantiles.RANK_ERROR)
        shown = [F.col(c) if c in keys else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("taxid", "measured_on")]
        counts = counts.select(F.lit(scope).alias("scope"), *shown, "p", "n", ok.alias("within_bound"))
        out = counts if out is None else out.unionByName(counts)
    return out


def _dims() -> dict[str, Column]:
    return {"day": F.to_date("seen_at"), "sample_id": F.col("sample_id"), "taxid": F.col("taxid")}


def _patterns(spark: SparkSession, sf_dir: str, name: str, identifier: str) -> distinct.Patterns:
    return distinct.membership_patterns(table(spark, sf_dir, name), identifier, _dims())


IDENTIFIERS = (("umi", "umi"), ("umi", "barcode"), ("kmer", "kmer_n_unique"))


def _of_each(count: Callable[[str, str], DataFrame]) -> DataFrame:
    """The rows of ``count`` (table, identifier) for all identifiers, with their names."""
    out = None
    for name, identifier in IDENTIFIERS:
        part = count(name, identifier).select(F.lit(f"{name}.{identifier}").alias("identifier"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def p4_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_each(lambda name, identifier: _patterns(spark, sf_dir, name, identifier).count_groups())


def p4_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from one partial result for each day, which have identifiers in common."""

    def count(name: str, identifier: str) -> DataFrame:
        days = distinct.partial_patterns(table(spark, sf_dir, name), identifier, _dims(), F.to_date("seen_at").cast("string"))
        return distinct.merge_partials([checkpointed(days)]).count_groups()

    return _of_each(count)


def p4_tumour_march(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct identifiers in one combination of groups: tumour samples on the days of March 2025, all taxids."""
    chosen = lambda c: c["sample_id"].endswith("_T") & c["day"].between("2025-03-01", "2025-03-31")
    return _of_each(lambda name, identifier: _patterns(spark, sf_dir, name, identifier).count_where(chosen))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language, how many have ids that stand for just their text, and how many have none."""
    texts = tokens.decode_corpus(p7_ids(spark, sf_dir)).withColumnRenamed("text", "decoded")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").join(texts, "doc_id")
    equal = F.count_if(F.coalesce("text", F.lit("")) == F.col("decoded"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_documents"), equal.alias("n_equal"), F.count_if(F.col("n_tokens") == 0).alias("n_without"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = tokens.count_tokens(table(spark, sf_dir, "documents"))
    return packing.pack(sized, "doc_id", "n_tokens", costs=packing.training_costs())


def p8_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents in containers and of faults of the containers, of which there must be none."""
    sized = tokens.count_tokens(table(spark, sf_dir, "documents"))
    rows = checkpointed(p8_containers(spark, sf_dir))
    parts = rows.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"))
    whole = sized.join(parts, "doc_id", "full_outer").agg(
        F.count("n").alias("documents"),
        F.count_if(~F.col("size").eqNullSafe(F.col("n_tokens"))).alias("sizes_lost"),
        F.count_if((F.col("n") != F.greatest(F.ceil(F.col("n_tokens") / max(packing.CAPACITIES)), F.lit(1))) | (F.col("n") != F.col("last") + 1)).alias("wrongly_split"),
    )
    bins = rows.groupBy("container_id").agg(F.sum("size").alias("size"), F.max("container_size").alias("said"), F.max("capacity").alias("capacity"))
    filled = bins.agg(
        F.count_if((F.col("size") > F.col("capacity")) | (F.col("size") != F.col("said"))).alias("overfull"),
        F.count_if(~F.col("capacity").isin(list(packing.CAPACITIES))).alias("of_other_capacity"),
        (F.max("container_id") + 1 - F.count(F.lit(1))).alias("numbers_left_out"),
    )
    return whole.join(F.broadcast(filled))  # one row each


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    models = subjects.train(table(spark, sf_dir, "doc_labels"), documents, table(spark, sf_dir, "subjects"))
    return subjects.document_subjects(documents, models)


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each subject, by source."""
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    return p9_found(spark, sf_dir).join(sources, "doc_id").groupBy("source", "subject").agg(F.count(F.lit(1)).alias("n_documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_percentiles, p2_within_bound, p4_distinct, p4_merged_days, p4_tumour_march, p7_ids, p7_round_trip, p8_containers, p8_sound, p9_found, p9_composition)
}

_CUBE = """
SELECT '{table}.{column}' AS identifier, grouping(day) = 0 AS by_day, grouping(sample_id) = 0 AS by_sample_id, grouping(taxid) = 0 AS by_taxid,
  day, sample_id, taxid, count(DISTINCT {column}) AS n_distinct
FROM (SELECT seen_at::DATE AS day, sample_id, taxid, {column} FROM {table} WHERE {column} IS NOT NULL) GROUP BY CUBE (day, sample_id, taxid)"""

_CUBES = " UNION ALL ".join(_CUBE.format(table=t, column=c) for t, c in IDENTIFIERS)

SQL: dict[str, str] = {
    "p2_within_bound": f"""
WITH groups AS (
  SELECT 'taxid' AS scope, taxid, NULL::DATE AS measured_on, count(*) AS n FROM cell_lines WHERE rpmm IS NOT NULL AND NOT isnan(rpmm) GROUP BY taxid
  UNION ALL SELECT 'day', NULL, measured_on, count(*) FROM cell_lines WHERE rpmm IS NOT NULL AND NOT isnan(rpmm) GROUP BY measured_on
  UNION ALL SELECT 'all', NULL, NULL, count(*) FROM cell_lines WHERE rpmm IS NOT NULL AND NOT isnan(rpmm)
)
SELECT scope, taxid, measured_on, p, n, true AS within_bound FROM groups, (SELECT unnest({POINTS}::DOUBLE[]) AS p)""",
    "p7_round_trip": "SELECT lang, count(*) AS n_documents, count(*) AS n_equal, count(*) FILTER (text IS NULL OR text = '') AS n_without FROM documents GROUP BY lang",
    "p8_sound": "SELECT count(*) AS documents, 0::BIGINT AS sizes_lost, 0::BIGINT AS wrongly_split, 0::BIGINT AS overfull, 0::BIGINT AS of_other_capacity, 0::BIGINT AS numbers_left_out FROM documents",
    "p4_distinct": _CUBES,
    "p4_merged_days": _CUBES,
    "p4_tumour_march": " UNION ALL ".join(
        f"SELECT '{t}.{c}' AS identifier, count(DISTINCT {c}) AS n_distinct FROM {t} WHERE ends_with(sample_id, '_T') AND seen_at::DATE BETWEEN '2025-03-01' AND '2025-03-31'"
        for t, c in IDENTIFIERS
    ),
}
