"""A versioned vector store of Parquet files.

Rows lie in buckets by a hash of their document. A change writes new files for the buckets it touches, then a manifest with the next number,
which names every bucket's files; so a reader never sees half a change, a failed write leaves the old state, what is untouched is not
rewritten, and of two writers that start from one manifest the second fails. Manifests and files that no recent manifest names are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerleaf.functions import filters
from ledgerleaf.functions.vectors import METRICS
from ledgerleaf.operators import search
from ledgerleaf.sources.stages import drop, read_text

BUCKETS = 64
KEEP = 2
MISMATCH = "chunks and embeddings don't match"


@dataclass(frozen=True)
class Manifest:
    """``parts``: the folder of each bucket that has rows; ``schema`` as JSON, None while nothing was written."""

    number: int
    metric: str
    dimension: int
    buckets: int
    parts: dict[str, str] = field(default_factory=dict)
    schema: str | None = None


def incoming_ids(chunks: DataFrame) -> DataFrame:
    """The distinct documents of a batch; null and empty ids are none."""
    return chunks.select("doc_id").where(F.col("doc_id").isNotNull() & (F.col("doc_id") != "")).distinct()


def upserted(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing rows without the incoming documents, and the incoming rows. Rows without a document are only added."""
    return existing.join(incoming_ids(incoming), "doc_id", "left_anti").unionByName(incoming, allowMissingColumns=True)


def deleted(existing: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true."""
    return existing.where(~F.coalesce(predicate, F.lit(False)))


class VectorStore:
    """An open collection; created if it is not there. An existing one keeps its metric, width and buckets."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine", dimension: int = 384, buckets: int = BUCKETS):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._numbers():
            self._publish(Manifest(1, metric, dimension, buckets))

    def _names(self, folder: str) -> list[str]:
        at = self._jpath(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json"))

    def _at(self, number: int) -> Manifest | None:
        try:
            return Manifest(**json.loads(read_text(self.spark, f"{self.path}/manifests/{number:012d}.json") or ""))
        except ValueError:  # another writer is about to write it
            return None

    @property
    def manifest(self) -> Manifest:
        return next(m for n in reversed(self._numbers()) if (m := self._at(n)))

    def _publish(self, manifest: Manifest) -> None:
        """Write the manifest; fails if its number is taken. Then what is older than the last ones goes."""
        try:
            stream = self._fs.create(self._jpath(f"{self.path}/manifests/{manifest.number:012d}.json"), False)
        except Exception as e:
            raise RuntimeError("another writer has changed the collection") from e
        stream.write(json.dumps(asdict(manifest)).encode())
        stream.close()
        numbers = self._numbers()
        old, kept = numbers[:-KEEP], [m for n in numbers[-KEEP:] if (m := self._at(n))]
        needed = {v for m in kept for v in m.parts.values()}
        gone = {v for n in old if (m := self._at(n)) for v in m.parts.values()} - needed
        for n in old:
            drop(self.spark, f"{self.path}/manifests/{n:012d}.json")
        for v in gone:
            drop(self.spark, f"{self.path}/data/{v}")

    def _bucket(self) -> Column:
        key = F.coalesce(F.when(F.col("doc_id") != "", F.col("doc_id")), F.col("chunk_id"), F.lit(""))
        return F.pmod(F.xxhash64(key), F.lit(self.manifest.buckets)).cast("int")

    def _rows(self, m: Manifest, buckets: list[str] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(m.parts.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(StructType.fromJson(json.loads(m.schema))).parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The rows, or None while the collection is empty."""
        return self._rows(self.manifest)

    def _write(self, rows: DataFrame) -> str:
        version = uuid.uuid4().hex
        # few files a bucket, and a large bucket still by several tasks
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{version}")
        return version

    def _written(self, version: str) -> list[str]:
        return [n.removeprefix("bucket=") for n in self._names(f"data/{version}") if n.startswith("bucket=")]

    def upsert(self, chunks: DataFrame) -> None:
        """``chunk_id, doc_id, content, embedding`` and further columns; every embedding must have the collection's width.

        The chunks are worked out and checked once, as they are written; the buckets they fall in are then written anew if they had rows.
        """
        m = self.manifest
        right = F.col("embedding").isNotNull() & (F.size("embedding") == m.dimension)
        try:
            new = self._write(chunks.withColumn("embedding", F.when(right, F.col("embedding")).otherwise(F.raise_error(F.lit(MISMATCH)))))
        except Exception as e:
            if MISMATCH in str(e):
                raise ValueError(MISMATCH) from e
            raise
        touched = self._written(new)
        if not touched:
            drop(self.spark, f"{self.path}/data/{new}")
            return
        incoming = self.spark.read.schema(chunks.schema).parquet(*(f"{self.path}/data/{new}/bucket={b}" for b in touched))
        known = StructType.fromJson(json.loads(m.schema)).fields if m.schema else []
        schema = StructType([*known, *(f for f in chunks.schema.fields if f.name not in {k.name for k in known})])
        if old := self._rows(m, touched):
            merged = self._write(upserted(old, incoming))
            drop(self.spark, f"{self.path}/data/{new}")
            new = merged
        self._publish(replace(m, number=m.number + 1, parts=m.parts | {b: new for b in touched}, schema=schema.json()))

    def delete(self, where: Mapping[str, Any]) -> None:
        """Only buckets that hold a row to delete are written anew."""
        m, predicate = self.manifest, filters.where(where)
        if (rows := self._rows(m)) is None:
            return
        touched = [str(r[0]) for r in rows.where(predicate).select(self._bucket()).distinct().collect()]
        if touched:
            new = self._write(deleted(self._rows(m, touched), predicate))
            kept = {b: v for b, v in m.parts.items() if b not in touched}
            self._publish(replace(m, number=m.number + 1, parts=kept | {b: new for b in self._written(new)}))

    def count(self) -> int:
        rows = self.read()
        return 0 if rows is None else rows.count()

    def reset(self) -> None:
        """An empty collection with the same metric."""
        m = self.manifest
        self._publish(replace(m, number=m.number + 1, parts={}, schema=None))

    def query(self, queries: DataFrame, n_results: int = 5, where: Mapping[str, Any] | None = None, where_document: Mapping[str, Any] | None = None) -> DataFrame:
        """``query, rank, chunk_id, content, distance``; ties go to the lesser chunk_id. queries: ``query, vector``.

        An unreadable store raises; only an empty one gives no rows.
        """
        m = self.manifest
        rows = self._rows(m)
        if rows is None:
            return self.spark.createDataFrame([], "query long, rank int, chunk_id string, content string, distance double")
        kept = rows.where(filters.where(where) & filters.where_document(where_document))
        hits = search.top_k(kept.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector")), queries, n_results, m.metric)
        contents = kept.join(hits.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("content").alias("content"))
        return hits.withColumnRenamed("id", "chunk_id").join(contents, "chunk_id").select("query", "rank", "chunk_id", "content", "distance")
