"""Column functions for entropy, confidence and extraction quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPAND_AT, ABSTAIN_AT = 1.5, 2.0


def token_entropy(logprobs: Column) -> Column:
    """Natural-log entropy of one token's log-probabilities after renormalising; null for none."""
    p = F.transform(logprobs, F.exp)
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(logprobs) > 0, F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.log(x / total)).otherwise(F.lit(0.0))))


def uncertainty(entropy: Column) -> Column:
    """high above 2.0, medium from 1.5, else low; null without entropy."""
    return F.when(entropy > ABSTAIN_AT, "high").when(entropy >= EXPAND_AT, "medium").when(entropy.isNotNull(), "low")


def confidence(level: Column, abstained: Column) -> Column:
    return F.when(abstained, "NONE").when(level.isNull(), "UNKNOWN").when(level == "low", "HIGH").when(level == "medium", "MEDIUM").otherwise("LOW")


def quality(content: Column, status: Column, structured: Column, base: Column) -> Column:
    """Extraction quality in [0, 1]; text that says EXTRACTION_FAILED has none. Null content counts as empty, a null base as 0.7."""
    text = F.coalesce(content, F.lit(""))
    score = F.coalesce(base, F.lit(0.7))
    score = score - F.when(F.length(text) < 10, 0.2).otherwise(0.0)
    score = score - F.when(status == "FAIL", 0.3).when(status == "PARTIAL", 0.1).otherwise(0.0)
    score = score + F.when(structured, 0.1).otherwise(0.0)
    return F.when(text.contains("EXTRACTION_FAILED"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def keyword_similarity(anchor_a: Column, anchor_b: Column, words_a: Column, words_b: Column) -> Column:
    """0.4 for the same anchor (null equals null) and 0.4 times the Jaccard of the keyword sets."""
    both, either = F.size(F.array_intersect(words_a, words_b)), F.size(F.array_union(words_a, words_b))
    jaccard = F.when((F.size(words_a) > 0) & (F.size(words_b) > 0), both / either).otherwise(F.lit(0.0))
    return F.when(anchor_a.eqNullSafe(anchor_b), 0.4).otherwise(0.0) + 0.4 * F.coalesce(jaccard, F.lit(0.0))
