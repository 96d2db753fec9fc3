"""Which aligner's span counts: the router, the hybrid merge, and the reports of both."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import Config
from . import external
from .align import align
from .long_align import align_long

DETAILS = ("doc_id", "idx", "text", "status", "score", "reason", "method", "start_idx", "end_idx", "confidence", "span_ms", "ord")


def align_all(docs: DataFrame, config: Config) -> DataFrame:
    """align(), with documents of more sentences or words than config.alignment.long_document on many tasks each; the rows are the same."""
    most = config.alignment.long_document
    if not most:
        return align(docs, config.alignment, config.pad_ms)
    long = (F.coalesce(F.size("sentences"), F.lit(0)) > most) | (F.coalesce(F.size("words"), F.lit(0)) > most)
    found = align(docs.where(~long), config.alignment, config.pad_ms)
    if docs.where(long).isEmpty():
        return found
    return found.unionByName(align_long(docs.where(long), config.alignment, config.pad_ms))


def unaligned(spans: DataFrame) -> DataFrame:
    return spans.where("start_ms is null")


def fuzzy_retry(docs: DataFrame, first: DataFrame, config: Config) -> DataFrame:
    """Fuzzy spans of the sentences that first left out, under their own numbers; the search starts at the first word again."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    missed = unaligned(first).withColumn("again", F.row_number().over(order)).select("doc_id", "idx", "again", "text")
    lists = missed.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("again", "text"))), lambda s: s["text"]).alias("sentences"))
    found = align_all(docs.select("doc_id", "words").join(lists, "doc_id"), config)
    return found.withColumnRenamed("idx", "again").join(missed.select("doc_id", "idx", "again"), ["doc_id", "again"]).drop("again")


def merge_spans(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, idx, text, start_ms, end_ms, method): the first aligner's span, else the second's; method is null if neither has one."""
    rest = second.where("start_ms is not null").select("doc_id", "idx", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    both = first.join(rest, ["doc_id", "idx"], "left")
    method = F.when(F.col("start_ms").isNotNull(), "external").when(F.col("s2").isNotNull(), "fuzzy")
    return both.select("doc_id", "idx", "text", F.coalesce("start_ms", "s2").alias("start_ms"), F.coalesce("end_ms", "e2").alias("end_ms"), method.alias("method"))


def details(spans: DataFrame, method: str, place: int = 0) -> DataFrame:
    """Rows of the report: one for each sentence that isn't simply fine, with texts of up to 120 characters. place orders the rows of several aligners.

    Places of words are the fuzzy aligner's; the confidence, and with it the span in ms, are the external one's.
    """
    has = set(spans.columns)
    score = F.col("score") if "score" in has else F.lit(None).cast("double")
    index = [F.col(c) if c in has else F.lit(None).cast("int").alias(c) for c in ("start_idx", "end_idx")]
    confidence = F.col("confidence") if "confidence" in has else F.lit(None).cast("double")
    span = F.when(confidence.isNotNull() & F.col("start_ms").isNotNull(), F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))).alias("span_ms")
    rows = spans.where("status <> 'ok'").select(
        "doc_id", "idx", F.substring("text", 1, 120).alias("text"), "status", score.alias("score"), F.col("note").alias("reason"), F.lit(method).alias("method"), *index, confidence.alias("confidence"), span
    )
    return rows.withColumn("ord", F.lit(place))


def route(docs: DataFrame, config: Config, provider: external.Provider | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans, details) of docs (doc_id, sentences, words) by config.alignment.method: external, hybrid, or any other for fuzzy alone.

    Without a provider hybrid is fuzzy alone, with a warning, and external is an error.
    """
    method = config.alignment.method
    if method == "hybrid" and provider is None:
        warnings.warn("no provider, so hybrid aligns by fuzzy search alone", stacklevel=2)
        method = "fuzzy"
    if method not in ("external", "hybrid"):
        found = align_all(docs, config)
        spans = found.select("doc_id", "idx", "text", "start_ms", "end_ms", F.when(F.col("start_ms").isNotNull(), "fuzzy").alias("method"))
        return spans, details(found, "fuzzy")
    if provider is None:
        raise ValueError(f"{method} needs a provider")
    first = external.align_external(docs, provider, config)
    if method == "external":
        spans = first.select("doc_id", "idx", "text", "start_ms", "end_ms", F.when(F.col("start_ms").isNotNull(), "external").alias("method"))
        return spans, details(first, "external")
    second = fuzzy_retry(docs, first, config)
    return merge_spans(first, second), details(first, "external").unionByName(details(second, "fuzzy", 1))
