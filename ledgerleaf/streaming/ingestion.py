"""Streams: processed documents into the store, and rolling statistics of a query log. Extensions beyond batch parity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerleaf.sources.ingest import DOCUMENT, chunk_rows


def document_stream(spark: SparkSession, directory: str) -> DataFrame:
    """New ``rag_chunks.json`` files below a directory."""
    return spark.readStream.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).json(directory)


def stream_into(documents: DataFrame, store, embed: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Upsert every micro-batch; a batch that is run again replaces the same documents, so the store stays right."""
    chunks = chunk_rows(documents.where(F.col("doc_id").isNotNull()))
    return chunks.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _n: store.upsert(embed(df))).start()


def rolling_statistics(log: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, event_type, n, mean_value`` per window of ``ts, event_type, value``; ts must be a timestamp with time zone for the watermark."""
    w = F.window("ts", every)
    return log.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def rolling_stream(events: DataFrame, target: str, checkpoint: str, every: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Rolling statistics of a stream: the groups that a micro-batch has changed are written below ``target``, a folder for each batch."""

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={n}")  # a batch that is run again replaces its own rows

    return rolling_statistics(events, every, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest_statistics(spark: SparkSession, target: str) -> DataFrame:
    """What ``rolling_stream`` has written: of each window and type the last batch's row."""
    rows = spark.read.parquet(target)
    last = F.max_by(F.struct("n", "mean_value"), "batch").alias("x")
    return rows.groupBy("start", "event_type").agg(last).select("start", "event_type", "x.n", "x.mean_value")
