"""Pairs within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1000


def dealt_pairs(rows: DataFrame, keys: list[str], carry: list[str], block: int | None = None) -> DataFrame:
    """``*keys, x, y`` (structs of ``carry``): rows joined with themselves on ``keys``, each with itself and in both orders.

    A key of more than ``block`` rows is dealt to blocks, and each pair of blocks is a key of its own, so no task gets all pairs of a key.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block or BLOCK)).cast("int").alias("_n")).where("_n > 1")
    dealt = rows.join(sizes, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64(*carry), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    x = dealt.select(*keys, F.col("_own").alias("_i"), other.alias("_j"), F.struct(*carry).alias("x"))
    y = dealt.select(*keys, other.alias("_i"), F.col("_own").alias("_j"), F.struct(*carry).alias("y"))
    return x.join(y, [*keys, "_i", "_j"]).select(*keys, "x", "y")
