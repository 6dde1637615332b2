"""Reading processed documents (``<directory>/<document>/rag_chunks.json``) and bringing them into the store."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("ledgerleaf.ingest")

DOCUMENT = (
    "doc_id string, metadata struct<title:string,creation_date:string,source_file:string>, "
    "chunks array<struct<chunk_id:string,content:string,chunk_type:string,token_count:int,section_anchor:string,pages:array<int>,element_ids:array<string>,"
    "element_types:array<string>,metadata:struct<keywords:array<string>,source_count:int>>>, _corrupt_record string"
)


def read_documents(spark: SparkSession, directory: str, doc_id: str | None = None) -> DataFrame:
    """All documents below a directory, or one; names that start with a dot are skipped, a missing directory gives none.

    A file that does not parse has its text in ``_corrupt_record``.
    """
    pattern = f"{directory.rstrip('/')}/{doc_id or '[!.]*'}/rag_chunks.json"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if found is None or not len(found):
        return spark.createDataFrame([], DOCUMENT)
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(pattern)


def write_documents(documents: DataFrame, directory: str) -> None:
    """Processed documents as JSON, a folder ``doc=<id>`` for each."""
    documents.drop("_corrupt_record").withColumn("doc", F.col("doc_id")).repartition("doc").write.partitionBy("doc").json(directory)


def read_written(spark: SparkSession, directory: str, doc_id: str | None = None) -> DataFrame:
    """What ``write_documents`` wrote: all documents, or one."""
    at = f"{directory.rstrip('/')}/doc={doc_id or '*'}/part-*.json"
    return spark.read.schema(DOCUMENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(at)


def chunk_rows(documents: DataFrame) -> DataFrame:
    """A row per chunk with its document's metadata; missing values become "", [] or 0. Arrays stay arrays."""
    e = documents.select("doc_id", "metadata", F.explode("chunks").alias("c"))
    empty = F.array().cast("array<string>")
    return e.select(
        F.coalesce("c.chunk_id", F.lit("")).alias("chunk_id"),
        "doc_id",
        F.coalesce("c.content", F.lit("")).alias("content"),
        F.coalesce("c.chunk_type", F.lit("text")).alias("chunk_type"),
        F.coalesce("c.token_count", F.lit(0)).alias("token_count"),
        F.coalesce("c.section_anchor", F.lit("")).alias("section_anchor"),
        F.coalesce("metadata.title", F.lit("")).alias("doc_title"),
        F.coalesce("metadata.creation_date", F.lit("")).alias("doc_date"),
        F.coalesce("metadata.source_file", F.lit("")).alias("source_file"),
        F.coalesce("c.pages", F.array().cast("array<int>")).alias("pages"),
        F.coalesce("c.element_ids", empty).alias("element_ids"),
        F.coalesce("c.element_types", empty).alias("element_types"),
        F.coalesce("c.metadata.keywords", empty).alias("keywords"),
        F.coalesce("c.metadata.source_count", F.lit(0)).alias("source_count"),
    )


def exported(chunks: DataFrame) -> DataFrame:
    """Arrays as JSON text, for stores that hold scalars only."""
    return chunks.withColumns({c: F.to_json(c) for c in ("pages", "element_ids", "element_types", "keywords")})


def imported(chunks: DataFrame) -> DataFrame:
    """The inverse of ``exported``."""
    kinds = {"pages": "array<int>", "element_ids": "array<string>", "element_types": "array<string>", "keywords": "array<string>"}
    return chunks.withColumns({c: F.from_json(c, t) for c, t in kinds.items()})


def ingestion_stats(documents: DataFrame) -> DataFrame:
    """One row: documents read, unreadable ones, those without chunks, chunks and tokens."""
    bad = F.col("_corrupt_record").isNotNull() | F.col("doc_id").isNull()
    n = F.coalesce(F.size("chunks"), F.lit(0))
    tokens = F.aggregate("chunks", F.lit(0), lambda s, c: s + F.coalesce(c["token_count"], F.lit(0)))
    return documents.agg(
        F.count_if(~bad & (n > 0)).alias("docs_processed"), F.count_if(bad).alias("docs_failed"), F.count_if(~bad & (n <= 0)).alias("docs_empty"), F.coalesce(F.sum(F.when(~bad & (n > 0), n)), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.when(~bad & (n > 0), tokens)), F.lit(0)).alias("tokens")
    )


def ingest(spark: SparkSession, directory: str, store, embed: Callable[[DataFrame], DataFrame], doc_id: str | None = None) -> DataFrame:
    """Read, explode, embed and upsert in one job; returns the statistics. ``embed`` adds ``embedding`` to chunk rows."""
    documents = read_documents(spark, directory, doc_id)
    store.upsert(embed(chunk_rows(documents.where(F.col("_corrupt_record").isNull() & F.col("doc_id").isNotNull()))))
    return ingestion_stats(documents)


def main(args: list[str] | None = None) -> None:
    """Command line of a spark-submit job."""
    from ledgerleaf.sources.providers import HashEmbedder
    from ledgerleaf.sources.store import VectorStore

    p = argparse.ArgumentParser()
    p.add_argument("--processed-dir", required=True)
    p.add_argument("--collection", required=True)
    p.add_argument("--reset", action="store_true")
    p.add_argument("--verify", action="store_true")
    p.add_argument("--doc-id")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("ledgerleaf-ingest").getOrCreate()
    embedder = HashEmbedder()
    store = VectorStore(spark, a.collection, dimension=embedder.dimension)
    if a.reset:
        store.reset()
    log.info("ingested: %s", ingest(spark, a.processed_dir, store, embedder.documents, a.doc_id).first())
    if a.verify:
        questions = ["What moved inflation?", "What did participants say about employment?", "Which rates were projected?"]
        asked = embedder.queries(spark.createDataFrame(list(enumerate(questions)), "query long, content string"))
        for row in store.query(asked.select("query", F.col("embedding").alias("vector")), 3).orderBy("query", "rank").collect():
            log.info("%s %s %.4f %s", row.query, row.chunk_id, row.distance, row.content[:150])


if __name__ == "__main__":
    main()
