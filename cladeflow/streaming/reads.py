"""Structured Streaming over reads and UMI events.

The join gives the batch operator's rows. Of UMI events there are two ways. With a watermark, rows that come more than
``late`` behind the newest event may be dropped, so results are those of all rows only where ``late`` is above the longest
delay, and distinct UMIs of windows are approximate. With partial results in a table (:func:`store_umis`,
:func:`exact_umi_counts`) no state is kept in the stream, and rows count however late they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import koutreads


def join_stream(koutput: DataFrame, reads: DataFrame, tags: object = None) -> DataFrame:
    """A stream of single reads joined with a static table of classifications; no state is kept."""
    if koutput.isStreaming:
        raise ValueError("the classifications must be a static table")
    return koutreads.join_reads(koutput, reads, tags)


def distinct_umis(umis: DataFrame, event_time: str = "seen_at", late: str = "1 day", keys: tuple[str, ...] = ("sample_id", "barcode", "taxid", "umi")) -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed, ``late`` behind the newest event."""
    return umis.withWatermark(event_time, late).dropDuplicatesWithinWatermark(list(keys))


def umi_counts(umis: DataFrame, event_time: str = "seen_at", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """UMI rows by event-time window, sample and taxid, each window given once it can't change any more (append mode)."""
    timed = umis.withWatermark(event_time, late)
    counts = timed.groupBy(F.window(event_time, window).alias("w"), "sample_id", "taxid").agg(F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct("umi").alias("n_umis_approx"))
    return counts.select(F.col("w.start").alias("window_start"), "sample_id", "taxid", "n_rows", "n_umis_approx")


def store_umis(umis: DataFrame, path: str, checkpoint: str, event_time: str = "seen_at", window: str = "1 day") -> StreamingQuery:
    """Start writing, for every micro-batch, the numbers of rows of each window, sample, taxid and UMI to a table.

    The rows of a batch lie in its own folder, so that a batch that is run again after a failure replaces them.
    """
    keys = [F.window(event_time, window)["start"].alias("window_start"), F.col("sample_id"), F.col("taxid"), F.col("umi")]

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.filter(F.col(event_time).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return umis.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exact_umi_counts(stored: DataFrame) -> DataFrame:
    """``window_start, sample_id, taxid, n_rows, n_umis`` of all batches stored so far; null UMIs are rows but no UMIs."""
    keys = ["window_start", "sample_id", "taxid"]
    # each UMI of a window first, so that a window with most rows is counted by many tasks
    umis = stored.groupBy(*keys, "umi").agg(F.sum("n_rows").alias("n"))
    return umis.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count("umi").alias("n_umis"))
