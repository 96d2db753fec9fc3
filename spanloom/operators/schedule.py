"""From spans to the output time line: overrides, renumbering, repeats, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import Config


def apply_overrides(spans: DataFrame, overrides: DataFrame) -> DataFrame:
    """spans with start_ms and end_ms replaced by the last override (doc_id, sentence_idx, seq, start_ms, end_ms) of a sentence; unaligned ones can be filled."""
    last = overrides.groupBy("doc_id", F.col("sentence_idx").alias("idx")).agg(F.max(F.struct("seq", "start_ms", "end_ms")).alias("o"))
    both = spans.join(last, ["doc_id", "idx"], "left")
    mine = F.col("o").isNotNull()
    out = {c: F.when(mine, F.col(f"o.{c}")).otherwise(F.col(c)) for c in ("start_ms", "end_ms")}
    return both.select(*(out.get(c, F.col(c)).alias(c) for c in spans.columns), mine.alias("adjusted"))


def aligned_only(spans: DataFrame) -> DataFrame:
    """Aligned sentences with audio_idx, dense from 1 in each document."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    return spans.where("start_ms is not null and end_ms is not null").withColumn("audio_idx", F.row_number().over(order))


def with_repeats(spans: DataFrame, config: Config = Config()) -> DataFrame:
    """spans with seconds and num_repeats: fewer for spans shorter than the threshold, or a fixed number."""
    seconds = (F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0)
    dynamic = config.dynamic_repetitions
    repeats = F.when(seconds < dynamic.threshold_seconds, dynamic.short_chunk_repeats).otherwise(dynamic.long_chunk_repeats) if dynamic.enabled else F.lit(config.repeats)
    return spans.withColumns({"seconds": seconds, "num_repeats": repeats.cast("int")})


def with_blocks(spans: DataFrame, config: Config = Config()) -> DataFrame:
    """with_repeats() plus clip_ms, block_start and block_end. A clip lasts round(span / tempo), an estimate of the sound's real length."""
    clips = with_repeats(spans, config).withColumn("clip_ms", F.round((F.col("end_ms") - F.col("start_ms")) / F.lit(config.tempo)).cast("long"))
    pause, after = config.pause_ms, config.after_sentence_ms
    took = F.col("num_repeats") * F.col("clip_ms") + (F.col("num_repeats") - 1) * pause + after
    end = F.sum(took).over(Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return clips.withColumns({"block_start": (end - took).cast("long"), "block_end": end.cast("long")})


def reads(blocks: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, idx, rep, read_start_ms, read_end_ms) of with_blocks()."""
    rows = blocks.select("doc_id", "idx", "block_start", "clip_ms", F.explode(F.sequence(F.lit(1), F.col("num_repeats"))).alias("rep"))
    start = F.col("block_start") + (F.col("rep") - 1) * (F.col("clip_ms") + config.pause_ms)
    return rows.select("doc_id", "idx", "rep", start.cast("long").alias("read_start_ms"), (start + F.col("clip_ms")).cast("long").alias("read_end_ms"))


def repeat_histogram(spans: DataFrame, config: Config = Config()) -> DataFrame:
    """(num_repeats, n_sentences, n_reads)"""
    return with_repeats(spans, config).groupBy("num_repeats").agg(F.count("*").alias("n_sentences"), F.sum(F.col("num_repeats").cast("long")).alias("n_reads"))
