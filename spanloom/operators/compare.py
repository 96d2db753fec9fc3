"""Two aligners side by side, and the list of sentences to review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_methods(fuzzy: DataFrame, other: DataFrame, tolerance_ms: int = 500) -> DataFrame:
    """(doc_id, idx, kind, diff_ms) where two aligners differ: timestamp_diff (a bound is off by more than the tolerance), fuzzy_only, external_only, both_failed."""
    a = fuzzy.select("doc_id", "idx", F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"))
    b = other.select("doc_id", "idx", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    both = a.join(b, ["doc_id", "idx"], "full_outer")
    diff = F.greatest(F.abs(F.col("s1") - F.col("s2")), F.abs(F.col("e1") - F.col("e2")))
    kind = F.when(F.col("s1").isNull() & F.col("s2").isNull(), "both_failed").when(F.col("s2").isNull(), "fuzzy_only").when(F.col("s1").isNull(), "external_only").when(diff > tolerance_ms, "timestamp_diff")
    return both.select("doc_id", "idx", kind.alias("kind"), diff.alias("diff_ms")).where("kind is not null")


def review_queue(spans: DataFrame, details: DataFrame, show: str = "all") -> DataFrame:
    """(doc_id, idx, badge, score, priority) in the order of review: sort by doc_id, priority, idx.

    badge: failed, warning or good, by the first detail; a span found in the second pass counts as good. priority: only not_aligned and
    warning come first, which no aligner reports but for warnings. show: all, issues (sentences with a detail) or adjusted.
    """
    first = details.groupBy("doc_id", "idx").agg(F.min_by(F.struct("status", F.coalesce("score", F.lit(0.0)).alias("score")), F.col("ord")).alias("d"))
    both = spans.join(first, ["doc_id", "idx"], "left_outer")
    if show == "issues":
        both = both.where("d is not null")
    elif show == "adjusted":
        both = both.where("adjusted")
    status = F.col("d.status")
    none = F.col("d").isNull()
    badge = F.when(status.isin("not_aligned", "failed") | (none & F.col("start_ms").isNull()), "failed").when(status.isin("warning", "low_score"), "warning").otherwise("good")
    score = F.when(none, F.when(F.col("start_ms").isNotNull(), 1.0).otherwise(0.0)).otherwise(F.col("d.score"))
    priority = F.when(status == "not_aligned", 0).when(status.isin("warning", "low_score"), 1).otherwise(2)
    return both.select("doc_id", "idx", badge.alias("badge"), score.alias("score"), F.coalesce(priority, F.lit(2)).alias("priority"))


def first_issues(queue: DataFrame, most: int = 10) -> DataFrame:
    """The first rows of a review queue, a report of fixed size."""
    return queue.orderBy("priority", "doc_id", "idx").limit(most)
