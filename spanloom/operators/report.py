"""Reports and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config
from . import schedule

_READS = ("first", "second", "third", "fourth", "fifth")


def formatted(details: DataFrame) -> DataFrame:
    """details as they are published: a missing score is 0."""
    return details.withColumns({"score": F.coalesce("score", F.lit(0.0)), "reason": F.coalesce("reason", F.lit(""))})


def counts(spans: DataFrame, details: DataFrame) -> DataFrame:
    """(doc_id, num_sentences, aligned, unaligned, warnings, external, fuzzy); a span found in the second pass counts as a warning."""
    warned = details.groupBy("doc_id").agg(F.count_if(F.col("status").isin("warning", "fallback")).alias("warnings"))
    done = F.col("start_ms").isNotNull()
    per = spans.groupBy("doc_id").agg(
        F.count("*").alias("num_sentences"), F.count_if(done).alias("aligned"), F.count_if(~done).alias("unaligned"), F.count_if(F.col("method") == "external").alias("external"), F.count_if(F.col("method") == "fuzzy").alias("fuzzy")
    )
    return per.join(warned, "doc_id", "left").select("doc_id", "num_sentences", "aligned", "unaligned", F.coalesce("warnings", F.lit(0)).cast("long").alias("warnings"), "external", "fuzzy")


def quality(spans: DataFrame, details: DataFrame) -> DataFrame:
    """spans with quality_score and quality_note. The first detail of a sentence decides; without one it is fine.

    As published scores are filled with 0, a sentence that one aligner failed and the other saved keeps 0.0 and "ok".
    """
    first = formatted(details).groupBy("doc_id", "idx").agg(F.min_by(F.struct("score", "status"), F.col("ord")).alias("d"))
    note = F.when(F.col("d.status") == "warning", "low score but acceptable").when(F.col("d.status") == "fallback", "found with fallback search").otherwise("ok")
    both = spans.join(first, ["doc_id", "idx"], "left")
    found = F.col("start_ms").isNotNull()
    score = F.when(found, F.coalesce("d.score", F.lit(1.0))).otherwise(0.0)
    return both.select(*spans.columns, score.alias("quality_score"), F.when(found, note).otherwise("alignment failed").alias("quality_note"))


def manifest_rows(spans: DataFrame, details: DataFrame, blocks: DataFrame, reads: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, idx, entry): a sentence's part of the manifest. Reads after the fifth have no place in it."""
    listed = reads.groupBy("doc_id", "idx").agg(F.array_sort(F.collect_list(F.struct("rep", "read_start_ms", "read_end_ms"))).alias("reads"))
    timed = blocks.select("doc_id", "idx", "num_repeats", "seconds", "block_end").join(listed, ["doc_id", "idx"], "left")
    return _entries(quality(spans, details).join(timed, ["doc_id", "idx"], "left"), config)


def own_manifest_rows(spans: DataFrame, config: Config = Config()) -> DataFrame:
    """manifest_rows() of one aligner's spans with status and score, whose details are its own rows. Blocks and reads are columns of the spans, so nothing is joined."""
    aligned, fine = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull(), F.coalesce(F.col("status") == "ok", F.lit(True))
    # the details of a sentence that isn't fine: their missing score is 0
    score = F.when(F.col("start_ms").isNotNull(), F.when(fine, 1.0).otherwise(F.coalesce("score", F.lit(0.0)))).otherwise(0.0)
    note = F.when(F.col("start_ms").isNull(), "alignment failed").when(F.col("status") == "warning", "low score but acceptable").when(F.col("status") == "fallback", "found with fallback search").otherwise("ok")
    # sentences without a span take no time, and have no block
    timed = schedule.with_blocks(spans.select(*spans.columns, score.alias("quality_score"), note.alias("quality_note")), config)
    timed = timed.withColumns({c: F.when(aligned, F.col(c)) for c in ("num_repeats", "seconds", "clip_ms", "block_start", "block_end")})
    start = lambda rep: (F.col("block_start") + (rep - 1) * (F.col("clip_ms") + config.pause_ms)).cast("long")
    reads = F.transform(F.sequence(F.lit(1), F.col("num_repeats")), lambda rep: F.struct(rep.alias("rep"), start(rep).alias("read_start_ms"), (start(rep) + F.col("clip_ms")).alias("read_end_ms")))
    return _entries(timed.withColumn("reads", reads), config)


def _entries(rows: DataFrame, config: Config) -> DataFrame:
    """The entries of rows that have all their columns."""
    at = lambda i, side: F.get(F.filter("reads", lambda r: r["rep"] == i + 1), F.lit(0))[f"read_{side}_ms"].alias(f"{_READS[i]}_read_{side}")
    found, has = F.col("start_ms").isNotNull(), F.col("block_end").isNotNull()
    entry = F.struct(
        "idx",
        "text",
        F.when(~found, "not_aligned").when(~has, "error").alias("status"),
        F.when(found, F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), F.lit(config.pad_ms).alias("pad_ms"))).alias("source_span_ms"),
        F.struct(F.when(found & ~has, 0.0).otherwise(F.col("quality_score")).alias("score"), F.when(found & ~has, "timing info missing").otherwise(F.col("quality_note")).alias("note")).alias("quality"),
        F.when(has, F.struct(*(at(i, side) for i in range(5) for side in ("start", "end")), "block_end")).alias("output_offsets_ms"),
        "num_repeats",
        F.round("seconds", 3).alias("original_duration_seconds"),
    )
    return rows.select("doc_id", "idx", entry.alias("entry"))


def manifests(rows: DataFrame, blocks: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, manifest): one struct a document, sentences in order."""
    total = blocks.groupBy("doc_id").agg(F.max("block_end").alias("total"))
    lists = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "entry"))), lambda r: r["entry"]).alias("sentences"))
    return lists.join(total, "doc_id", "left").select(
        "doc_id",
        F.struct(
            F.col("doc_id").cast("string").alias("audio_in"), F.lit(config.tempo).alias("tempo"), F.lit(config.pause_ms).alias("pause_ms"), F.lit(config.repeats).alias("repeats"), "sentences", F.coalesce("total", F.lit(0)).alias("total_duration_ms")
        ).alias("manifest"),
    )


def reports(totals: DataFrame, details: DataFrame) -> DataFrame:
    """(doc_id, report): one struct a document, with its details in order."""
    rows = formatted(details).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "idx", "text", "status", "score", "reason", "method", F.struct("start_idx", "end_idx").alias("span_indices")))).alias("details"))
    counted = F.struct("num_sentences", "aligned", "unaligned", "warnings", F.struct("external", "fuzzy").alias("methods"))
    return totals.join(rows, "doc_id", "left").select("doc_id", F.struct(counted.alias("global"), F.coalesce("details", F.array()).alias("details")).alias("report"))


def summary(totals: DataFrame) -> DataFrame:
    """(doc_id, summary): the counts in a line; a document without sentences has 0.0%."""
    share = F.when(F.col("num_sentences") > 0, F.col("aligned") * 100.0 / F.col("num_sentences")).otherwise(0.0)
    share = F.format_string("%.1f", F.round(share, 1))
    return totals.select("doc_id", F.concat(F.lit("aligned "), F.col("aligned").cast("string"), F.lit(" of "), F.col("num_sentences").cast("string"), F.lit(" ("), share, F.lit("%), failed "), F.col("unaligned").cast("string"), F.lit(", warnings "), F.col("warnings").cast("string")).alias("summary"))


def issues(details: DataFrame, *more: str) -> DataFrame:
    """(doc_id, idx, line), and more columns of details: a line for each detail, with 60 characters of its text."""
    preview = F.concat(F.substring("text", 1, 60), F.when(F.length("text") > 60, "...").otherwise(""))
    line = F.format_string("[%d] %s (score: %.2f, method: %s) - %s", "idx", "status", F.coalesce("score", F.lit(0.0)), F.coalesce("method", F.lit("unknown")), preview)
    return details.select("doc_id", "idx", line.alias("line"), *more)


def summary_text(totals: DataFrame, details: DataFrame) -> DataFrame:
    """(doc_id, summary): the published summary of several lines: counts, methods, and a line for each detail.

    A document without sentences has 0.0%; details are in the order of their aligner, then their sentence.
    """
    share = F.when(F.col("num_sentences") > 0, F.col("aligned") * 100.0 / F.col("num_sentences")).otherwise(0.0)
    ordered = issues(details, "ord").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "idx", "line"))).alias("found"))
    listed = F.array_join(F.transform("found", lambda d: F.concat(F.lit("\n  "), d["line"])), "")
    head = F.format_string(
        "Alignment Summary:\n  Total sentences: %d\n  Successfully aligned: %d (%s%%)\n  Failed to align: %d\n  Warnings: %d\n\nAlignment Methods:\n  External: %d\n  Fuzzy matching: %d",
        "num_sentences", "aligned", F.format_string("%.1f", F.round(share, 1)), "unaligned", "warnings", "external", "fuzzy",
    )
    both = totals.join(ordered, "doc_id", "left")
    return both.select("doc_id", F.when(F.size("found") > 0, F.concat(head, F.lit("\n\nIssues:"), listed)).otherwise(head).alias("summary"))


def results(spans: DataFrame, reported: DataFrame) -> DataFrame:
    """(doc_id, result): sentences with their spans, null where there is none, in order, and the report of reports()."""
    span = F.when(F.col("start_ms").isNotNull(), F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))).alias("span_ms")
    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text", span))).alias("sentences"))
    return lists.join(reported, "doc_id", "left").select("doc_id", F.struct("sentences", "report").alias("result"))


def comparison(methods: dict[str, tuple[DataFrame, DataFrame, float]]) -> DataFrame:
    """(doc_id, comparison): per method its duration, report and spans, and the sentences once; methods are (spans, reports(), seconds) of the same documents."""
    out, columns = None, []
    for name, (spans, reported, seconds) in methods.items():
        found = results(spans, reported).withColumnRenamed("result", name)
        out = found if out is None else out.join(found, "doc_id", "full")
        columns.append(F.struct(F.lit(float(seconds)).alias("duration_seconds"), F.col(f"{name}.report"), F.col(f"{name}.sentences.span_ms").alias("spans")).alias(name))
    texts = F.coalesce(*(F.col(f"{name}.sentences.text") for name in methods))
    return out.select("doc_id", F.struct(*columns, texts.alias("sentences")).alias("comparison"))


def success_rate(totals: DataFrame) -> DataFrame:
    """(aligned, sentences, rate) over all documents, in percent."""
    return totals.agg(F.sum("aligned").alias("aligned"), F.sum("num_sentences").alias("sentences")).withColumn("rate", F.when(F.col("sentences") > 0, F.col("aligned") * 100.0 / F.col("sentences")))
