"""Reading the Parquet tables of a data directory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, directory: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Table ``name`` of ``directory``; ``columns`` prunes the scan explicitly where Catalyst can't see through Python."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df
