"""Keyword search by BM25, routing, rank fusion and reranking. The formulas are the published ones; constants are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.sources.stages import stage


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


MOST_TERMS = 200_000


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """Rows for all tasks if they are few, so that a frequent term is no key of a shuffle; else as they are."""
    return F.broadcast(rows) if n <= MOST_TERMS else rows


def postings(docs: DataFrame, vocabulary: DataFrame, n_terms: int) -> tuple[DataFrame, int, float]:
    """(``id, len, term, tf`` of the vocabulary's terms, number of documents, their mean length), from one scan.

    A document's row with a null term carries its length. The vocabulary is sent to all tasks if it has 200,000 terms or fewer, so that
    other tokens are dropped where they are read; frequencies are added up in each task before they travel.
    """
    known = _sent(vocabulary.select("term", F.lit(True).alias("known")), n_terms)
    each = docs.select("id", terms(F.coalesce("text", F.lit(""))).alias("all")).select("id", F.size("all").alias("len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "all")).alias("term"))
    kept = each.join(known, "term", "left").where(F.col("term").isNull() | F.col("known"))
    counted = stage(kept.groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    n_docs, mean = counted.where(F.col("term").isNull()).agg(F.count(F.lit(1)), F.avg("len")).first()
    return counted.where(F.col("term").isNotNull()), n_docs, mean or 1.0


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, rare: float = 0.01) -> DataFrame:
    """``query, id, score, rank``: the k best documents of every query; ties go to the lesser id.

    docs: ``id, text``; queries: ``query, text``. Ids are unique. Null texts count as empty ones. A query's stop words pair with nearly all documents, so they
    don't bring documents in: the k-th best score by the rare terms alone (those in at most a share of ``rare`` of the documents, and the rarest one)
    is a bound from below, and the weakest terms whose greatest weights together stay under it can't lift a document over it. Documents
    with none of the other terms are left out, all others get their whole score, so the result is exact.
    """
    asked = stage(queries.select("query", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct(), "asked")
    vocabulary = asked.select("term").distinct()
    n_asked, n_terms = asked.agg(F.count(F.lit(1)), F.countDistinct("term")).first()
    held, n_docs, mean = postings(docs, vocabulary, n_terms)
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = held.join(_sent(df, n_terms), "term").select("term", "id", "df", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(float(mean))))).alias("w"))
    weighted = stage(weighted, "weights")
    most = weighted.groupBy("term").agg(F.max("w").alias("most"), F.max("df").alias("df"))
    each = asked.join(most, "term").withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("df", "term")))
    each = each.withColumn("is_rare", (F.col("df") <= rare * n_docs) | (F.col("nth") == 1))

    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    partial = weighted.join(_sent(each.where("is_rare").select("query", "term"), n_asked), "term").groupBy("query", "id").agg(F.sum("w").alias("score"))
    bound = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query", F.col("score").alias("bound"))
    together = F.sum("most").over(Window.partitionBy("query").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    roles = each.join(bound, "query", "left").withColumn("weak", F.coalesce(together < F.col("bound") - 1e-5, F.lit(False)))
    roles = stage(roles.select("query", "term", "weak"), "roles")
    strong = stage(weighted.join(_sent(roles.where(~F.col("weak")).select("query", "term"), n_asked), "term").groupBy("query", "id").agg(F.sum("w").alias("w")), "strong")
    # the weak terms of the documents that are in: keyed by document, so that a stop word is no key
    weak = strong.select("query", "id").join(roles.where("weak").select("query", "term"), "query").join(weighted.select("id", "term", "w"), ["id", "term"]).select("query", "id", "w")
    scores = strong.unionByName(weak).groupBy("query", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def routes(queries: DataFrame) -> DataFrame:
    """``query, lexical_weight, vector_weight``: questions with numbers, dates or quotations lean on keywords; both branches always run."""
    exact = F.col("text").rlike(r"[0-9]|[\"“”]")
    return queries.select("query", F.when(exact, 0.6).otherwise(0.4).alias("lexical_weight"), F.when(exact, 0.4).otherwise(0.6).alias("vector_weight"))


def fused(left: DataFrame, right: DataFrame, k: int = 5, constant: int = 60, weights: DataFrame | None = None) -> DataFrame:
    """``query, id, score, rank`` by reciprocal ranks of two ranked lists; ranks are used as one side's score is a distance."""
    a, b = left.select("query", "id", F.col("rank").alias("ra")), right.select("query", "id", F.col("rank").alias("rb"))
    both = a.join(b, ["query", "id"], "full")
    wa, wb = F.lit(1.0), F.lit(1.0)
    if weights is not None:
        both = both.join(weights, "query", "left")
        wa, wb = F.coalesce("lexical_weight", F.lit(0.5)), F.coalesce("vector_weight", F.lit(0.5))
    score = F.coalesce(wa / (constant + F.col("ra")), F.lit(0.0)) + F.coalesce(wb / (constant + F.col("rb")), F.lit(0.0))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return both.select("query", "id", F.round(score, 9).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reranked(hits: DataFrame, score: Column, k: int = 5) -> DataFrame:
    """The k best hits of every query by a scorer's column."""
    w = Window.partitionBy("query").orderBy(F.desc("rerank_score"), "id")
    return hits.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_overlap(question: Column, content: Column) -> Column:
    """The share of a question's distinct terms that a passage holds: the deterministic stand-in for a cross-encoder."""
    q = F.array_distinct(terms(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, terms(content))) / F.size(q)).otherwise(F.lit(0.0))
