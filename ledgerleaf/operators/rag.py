"""Answering questions over retrieved chunks: entropy gate, sources, responses and their statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import scores, text
from ledgerleaf.sources.stages import stage

ABSTENTION = "I can't answer this with enough certainty from the documents at hand."
NOTHING_FOUND = "No relevant documents were found."


def sequence_entropy(tokens: DataFrame) -> DataFrame:
    """``id, n_tokens, entropy``: the mean of the entropies of tokens that have log-probabilities. tokens: ``id, pos, logprobs``."""
    each = tokens.select("id", scores.token_entropy(F.col("logprobs")).alias("h"))
    return each.groupBy("id").agg(F.count("h").alias("n_tokens"), F.avg("h").alias("entropy"))


def deduplicated(top: Column) -> Column:
    """Log-probabilities of ``array<struct<token, logprob>>`` with the last entry of a repeated token."""
    last = F.filter(top, lambda x, i: ~F.exists(F.slice(top, i + 2, F.size(top)), lambda y: y["token"] == x["token"]))
    return F.transform(last, lambda x: x["logprob"])


def gated(entropies: DataFrame) -> DataFrame:
    """Adds the uncertainty level and whether to expand or to abstain."""
    level = scores.uncertainty(F.col("entropy"))
    return entropies.withColumn("uncertainty_level", level).withColumn("should_expand", F.coalesce(level == "medium", F.lit(False))).withColumn("should_abstain", F.coalesce(level == "high", F.lit(False)))


def sources(hits: DataFrame, most: int = 5) -> DataFrame:
    """``query, sources``: the first hits in rank order with previews. hits: ``query, rank, id, content, distance``."""
    s = F.struct("rank", "id", text.preview(F.col("content")).alias("content"), "distance")
    return hits.where(F.col("rank") <= most).groupBy("query").agg(F.sort_array(F.collect_list(s)).alias("sources"))


def cited(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """``query, n, id``: the chunk that each ``[Document n]`` of an answer names; numbers without a hit are dropped."""
    n = F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[Document (\d{1,6})\]"), F.lit(1))))
    return answers.select("query", n.alias("n")).select("query", F.col("n").cast("int").alias("n")).join(hits.select("query", F.col("rank").alias("n"), "id"), ["query", "n"])


def responses(questions: DataFrame, hits: DataFrame, generated: DataFrame, most: int = 5) -> DataFrame:
    """One row per question: answer, sources, confidence.

    questions: ``query, text``; hits: ranked; generated: ``query, answer, entropy``. Without hits the answer says so and the confidence is UNKNOWN;
    with too high an entropy the answer is replaced and the sources stay.
    """
    gate = gated(generated)
    r = questions.join(sources(hits, most), "query", "left").join(gate, "query", "left")
    none = F.col("sources").isNull()
    abstained = F.coalesce(F.col("should_abstain"), F.lit(False)) & ~none
    return r.select(
        "query",
        F.when(none, NOTHING_FOUND).when(abstained, ABSTENTION).otherwise(F.col("answer")).alias("answer"),
        F.when(none, F.lit(None)).otherwise(F.col("entropy")).alias("entropy"),
        abstained.alias("abstained"),
        F.when(none, "UNKNOWN").otherwise(scores.confidence(F.col("uncertainty_level"), abstained)).alias("confidence"),
        F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"),
        "sources",
    )


def expanded_context(first: Column, more: Column) -> Column:
    """The first passages, then those of the wider retrieval that are not among them."""
    return F.array_distinct(F.concat(first, more))


def _asked(contexts: DataFrame, generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``query, answer, entropy`` of the prompts over ``query, text, passages``. generate adds ``answer`` and ``logprobs`` to ``query, prompt``."""
    prompts = contexts.select("query", text.rag_prompt(F.col("text"), F.transform("passages", lambda p: p["content"])).alias("prompt"))
    h = F.filter(F.transform("logprobs", scores.token_entropy), lambda x: x.isNotNull())
    mean = F.when(F.size(h) > 0, F.aggregate(h, F.lit(0.0), lambda s, x: s + x) / F.size(h))
    return generate(prompts).select("query", "answer", mean.alias("entropy"))


def answered(questions: DataFrame, hits: DataFrame, generate: Callable[[DataFrame], DataFrame], k: int = 5) -> DataFrame:
    """``responses`` of all questions with ``expanded`` and the ``first_entropy``: asked over the k best passages, and once more where that is unsure.

    questions: ``query, text``; hits: ``query, rank, id, content, distance``, retrieved once to the wider k. A question whose first answer is of medium
    entropy is asked again over all its hits; that answer, its entropy and its passages replace the first. High entropy is refused
    at once. Each model call is staged, as a second use would call the model again.
    """
    passage = F.struct("rank", "id", "content")
    all_ = hits.groupBy("query").agg(F.sort_array(F.collect_list(passage)).alias("all"))
    known = questions.select("query", "text").join(all_, "query").withColumn("first", F.filter("all", lambda p: p["rank"] <= k))
    known = stage(known, "contexts")
    once = stage(_asked(known.withColumn("passages", F.col("first")), generate), "answers")
    unsure = gated(once).where(F.col("should_expand") & ~F.col("should_abstain")).select("query")
    wide = known.join(unsure, "query", "left_semi").withColumn("passages", expanded_context(F.col("first"), F.col("all")))
    again = stage(_asked(wide, generate).select("query", F.col("answer").alias("again"), F.col("entropy").alias("entropy_again"), F.lit(True).alias("expanded")), "answers")
    best = once.join(again, "query", "left").withColumn("expanded", F.coalesce("expanded", F.lit(False))).withColumn("first_entropy", F.col("entropy"))
    best = best.withColumn("answer", F.when(F.col("expanded"), F.col("again")).otherwise(F.col("answer"))).withColumn("entropy", F.when(F.col("expanded"), F.col("entropy_again")).otherwise(F.col("entropy")))
    shown = hits.join(best.select("query", "expanded"), "query", "left").where((F.col("rank") <= k) | F.col("expanded")).drop("expanded")
    most = hits.agg(F.max("rank")).first()[0] or k
    return responses(questions, shown, best.select("query", "answer", "entropy"), most).join(best.select("query", "expanded", "first_entropy"), "query", "left").withColumn("expanded", F.coalesce("expanded", F.lit(False)))


def query_statistics(log: DataFrame) -> DataFrame:
    """One row over ``entropy, latency, expanded, abstained``: counts, rates (0 for an empty log) and means of what is not null."""
    n = F.count(F.lit(1))
    rate = lambda c: F.when(n > 0, F.count_if(F.col(c)) / n).otherwise(F.lit(0.0))
    return log.agg(
        n.alias("total_queries"), F.count_if(F.col("expanded")).alias("expanded_queries"), F.count_if(F.col("abstained")).alias("abstained_queries"), rate("expanded").alias("expansion_rate"), rate("abstained").alias("abstention_rate"),
        F.round(F.avg("entropy"), 6).alias("avg_entropy"), F.round(F.avg("latency"), 6).alias("avg_latency"),
    )


def running_statistics(log: DataFrame) -> DataFrame:
    """``seq, avg_entropy, avg_latency`` as they stood after each query of ``stream, seq, entropy, latency``."""
    w = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("stream", "seq", F.round(F.avg("entropy").over(w), 6).alias("avg_entropy"), F.round(F.avg("latency").over(w), 6).alias("avg_latency"))
