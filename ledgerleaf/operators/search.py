"""Exact top-k vector search.

Query vectors are taken in blocks of bounded size and sent to all tasks; every task multiplies its rows' matrix with the block's and keeps the k nearest
of each query, so only k rows per query and task are shuffled. A filter goes to the scan before anything is ranked. Ties go to the lesser id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.vectors import METRICS
from ledgerleaf.sources.stages import stage

BLOCK_BYTES = 32 << 20


def distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows to all queries in double precision, (queries, rows). Cosine of a zero vector is nan and ranks last."""
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1.0 - (queries @ rows.T) / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :])
    if metric == "ip":
        return 1.0 - queries @ rows.T
    if metric == "l2":
        return np.maximum(0.0, (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2.0 * (queries @ rows.T))
    raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")


def _scan(keys: list, block: np.ndarray, k: int, metric: str, text_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dist = np.full((len(keys), 0), np.inf)
        ids = np.zeros((len(keys), 0), "U1" if text_ids else np.int64)
        for batch in batches:
            if not len(batch):
                continue
            found = np.round(distances(block, np.stack(batch["vector"].to_numpy()).astype(np.float64), metric), 9)
            found = np.where(np.isnan(found), np.inf, found)
            both = np.concatenate([dist, found], 1)
            name = np.concatenate([ids, np.broadcast_to(batch["id"].to_numpy(str if text_ids else np.int64), found.shape)], 1)
            if both.shape[1] > 4 * k + 64:  # cut before the exact sort, ties kept
                edge = np.partition(both, k - 1, axis=1)[:, k - 1 : k]
                width = max(k, int((both <= edge).sum(1).max()))
                part = np.argsort(both, axis=1, kind="stable")[:, :width]
                both, name = np.take_along_axis(both, part, 1), np.take_along_axis(name, part, 1)
            order = np.lexsort((name, both), axis=1)[:, :k]
            dist, ids = np.take_along_axis(both, order, 1), np.take_along_axis(name, order, 1)
        n = ids.shape[1]
        yield pd.DataFrame({"query": np.repeat(np.asarray(keys, np.int64), n), "id": ids.ravel().astype(object if text_ids else np.int64), "distance": dist.ravel()})

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """``query, id, distance, rank`` of the k nearest rows of every query vector.

    rows: ``id, vector`` (and whatever ``where`` reads); queries: ``query, vector``; ids are strings or 64-bit numbers. Null ids, null vectors and those of
    another length than the queries' are skipped. k of 0 means 5. Queries are read in blocks of at most 32 MB, with a pass over the rows for each;
    if there are several blocks, the hits of each are staged before the next is read.
    """
    k = k or 5
    if where is not None:
        rows = rows.where(where)
    out, keys, block = None, [], []
    dims: int | None = None
    text_ids = dict(rows.dtypes)["id"] == "string"
    kind = "string" if text_ids else "long"

    def search(keys: list, block: list) -> DataFrame:
        have = rows.select(F.col("id").cast(kind).alias("id"), "vector").where(F.col("id").isNotNull() & (F.size("vector") == dims))
        near = have.mapInPandas(_scan(keys, np.asarray(block, np.float64), k, metric, text_ids), f"query long, id {kind}, distance double")
        w = Window.partitionBy("query").orderBy("distance", "id")
        return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    for row in queries.select(F.col("query").cast("long"), "vector").where(F.col("vector").isNotNull()).toLocalIterator():
        dims = dims or len(row[1])
        if len(row[1]) != dims:
            raise ValueError("query vectors of different lengths")
        keys.append(row[0])
        block.append(row[1])
        if len(block) * dims * 8 >= BLOCK_BYTES:
            found = stage(search(keys, block), "hits")
            out, keys, block = (found if out is None else out.unionByName(found)), [], []
    if block:
        found = search(keys, block)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"query long, id {kind}, distance double, rank int")
    return out


def adaptive(hits: DataFrame, decisions: DataFrame, k: int = 5, expanded: int = 10) -> DataFrame:
    """Hits up to k, or up to ``expanded`` for queries that expand without abstaining. hits: ranked once to ``expanded``; decisions: ``query, should_expand, should_abstain``."""
    most = F.when(F.coalesce(F.col("should_expand") & ~F.col("should_abstain"), F.lit(False)), expanded).otherwise(k)
    return hits.join(decisions, "query", "left").where(F.col("rank") <= most).select(*hits.columns)


def pivoted_reply(replies: DataFrame) -> DataFrame:
    """Rows of a reply of parallel lists: ``query, rank, id, content, distance``."""
    zipped = F.arrays_zip("ids", "contents", "distances")
    return replies.select("query", F.posexplode(zipped).alias("p", "x")).select("query", (F.col("p") + 1).alias("rank"), F.col("x.ids").alias("id"), F.col("x.contents").alias("content"), F.col("x.distances").alias("distance"))
