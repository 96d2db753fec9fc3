"""The whole build over a corpus: texts and word streams in, time line, manifests and reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audio, compare, external, merge, report, schedule, splitter
from ..operators.sentences import split_sentences
from .config import Config


@dataclass(frozen=True)
class Build:
    spans: DataFrame
    details: DataFrame
    blocks: DataFrame
    reads: DataFrame
    manifests: DataFrame
    reports: DataFrame
    summaries: DataFrame
    review: DataFrame
    inputs: DataFrame
    sounds: DataFrame | None = None


def build(texts: DataFrame, transcripts: DataFrame, config: Config = Config(), provider: external.Provider | None = None, overrides: DataFrame | None = None, recordings: DataFrame | None = None, learned: splitter.Learned | None = None) -> Build:
    """texts (doc_id, text) and transcripts (doc_id, words) meet once, by document; the rest follows by document.

    A document without a single aligned sentence has an empty time line and a report that says so; one without words is
    such a document. inputs gives each document's status: ok, no words, no sentences, or no text (words alone, which are not built).
    Sentences are split by the rule, or by a trained splitter's learned tables.
    The spans are read by several results, so they are kept; unpersist build.spans and build.details when done.
    """
    split = texts.select("doc_id", split_sentences(F.col("text")).alias("sentences"))
    if learned is not None:
        lists = splitter.sentence_lists(texts, learned)
        split = texts.select("doc_id").join(lists, "doc_id", "left").withColumn("sentences", F.coalesce("sentences", F.array().cast("array<string>")))
    docs = split.join(transcripts.select("doc_id", "words"), "doc_id", "left")
    has = docs.select("doc_id", (F.size("sentences") > 0).alias("has_text"), (F.coalesce(F.size("words"), F.lit(0)) > 0).alias("has_words"))
    status = F.when(~F.col("has_text"), "no sentences").when(~F.col("has_words"), "no words").otherwise("ok")
    alone = transcripts.select("doc_id").join(texts.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("no text").alias("status"))
    inputs = has.select("doc_id", status.alias("status")).unionByName(alone)
    spans, details = merge.route(docs, config, provider)
    if overrides is not None:
        spans = schedule.apply_overrides(spans, overrides)
    else:
        spans = spans.withColumn("adjusted", F.lit(False))
    spans, details = spans.persist(), details.persist()
    blocks = schedule.with_blocks(schedule.aligned_only(spans), config)
    reads = schedule.reads(blocks, config)
    totals = report.counts(spans, details)
    rows = report.manifest_rows(spans, details, blocks, reads, config)
    sounds = audio.render(recordings.select("doc_id", "content"), blocks, config) if recordings is not None else None
    return Build(spans, details, blocks, reads, report.manifests(rows, blocks, config), report.reports(totals, details), report.summary_text(totals, details), compare.review_queue(spans, details), inputs, sounds)
