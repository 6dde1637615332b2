"""Calibration and grading of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRADE_WEIGHTS = {"accuracy": 0.4, "completeness": 0.3, "clarity": 0.2, "citations": 0.1}
WIN_THRESHOLD, MIN_GAP = 7.0, 0.5


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """``bin, n, mean_confidence, accuracy, gap`` of ``confidence`` in [0, 1] and ``correct``; the last bin holds 1."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return predictions.where(F.col("confidence").isNotNull() & F.col("correct").isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), F.round(F.abs(F.avg("confidence") - F.avg(F.col("correct").cast("double"))), 6).alias("gap")
    )


def expected_calibration_error(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """One row ``n, ece``: the gaps weighted by bin size."""
    c = calibration(predictions, bins)
    return c.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("gap") * F.col("n")) / F.sum("n"), 6).alias("ece"))


def graded(answers: DataFrame) -> DataFrame:
    """Answers with their weighted ``grade``."""
    total = sum((F.col(k) * w for k, w in GRADE_WEIGHTS.items()), F.lit(0.0))
    return answers.withColumn("grade", F.round(total, 6))


def preferences(grades: DataFrame) -> DataFrame:
    """``question_id, chosen, rejected, gap``: the best answer of a question against its worst, if the best reaches 7.0 and is 0.5 or more ahead."""
    each = grades.where(F.col("grade").isNotNull()).groupBy("question_id").agg(
        F.max_by(F.struct("answer_id", "grade"), F.struct("grade", F.negative("answer_id"))).alias("best"), F.min_by(F.struct("answer_id", "grade"), F.struct("grade", "answer_id")).alias("worst")
    )
    gap = F.round(F.col("best.grade") - F.col("worst.grade"), 6)
    return each.where((F.col("best.grade") >= WIN_THRESHOLD) & (gap >= MIN_GAP)).select("question_id", F.col("best.answer_id").alias("chosen"), F.col("worst.answer_id").alias("rejected"), gap.alias("gap"))
