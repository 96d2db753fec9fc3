"""The registered queries of the alignment engine and the SQL that checks them.

The tables hold no transcripts, so word streams and spans are derived from texts by whole-number arithmetic that
both engines repeat: a word of n letters takes 60 * n + 40 ms, and words follow one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as text_functions
from .functions import timecode
from .functions.similarity import indel_ratio
from .operators import align as alignment
from .operators import audio, compare, compound, external, long_align, merge, report, schedule, sentences, splitter, words
from .plans.config import Alignment, Config
from .sources import readers

CONFIG = Config()
#: Thresholds at which ordinary sentences align.
LENIENT = Alignment(min_accept=0.82, warn_accept=0.75)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


# ---- derived inputs


def derived_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, text, start_ms, end_ms, status, score, note, method): sentences one after the other, every seventh not aligned, every fifth a warning."""
    # by document before the texts are taken apart, so the window needs no shuffle of sentences
    rows = sentences.explode_sentences(docs.select("doc_id", "text").repartition("doc_id")).withColumn("tokens", text_functions.tokens(F.col("sentence")))
    took = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + F.length(t) * 60 + 40)
    rows = rows.select("doc_id", "idx", F.col("sentence").alias("text"), took.alias("took"))
    end = F.sum("took").over(Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    turn = F.col("doc_id") + F.col("idx")
    failed, warned = turn % 7 == 0, turn % 5 == 0
    rows = rows.withColumn("stop", end).select("*", (F.col("stop") - F.col("took")).alias("begin"))
    return rows.select(
        "doc_id",
        "idx",
        "text",
        F.when(~failed, F.greatest(F.lit(0), F.col("begin") - CONFIG.pad_ms)).alias("start_ms"),
        F.when(~failed, F.col("stop") + CONFIG.pad_ms).alias("end_ms"),
        F.when(failed, "failed").when(warned, "warning").otherwise("ok").alias("status"),
        F.when(failed, 0.0).when(warned, 0.8).otherwise(0.95).alias("score"),
        F.when(failed, "no viable span found").when(warned, "acceptable but low score").otherwise("good match").alias("note"),
        F.when(~failed, "fuzzy").alias("method"),
    )


def other_spans(docs: DataFrame) -> DataFrame:
    """A second aligner: 100 ms times idx % 9 later, every fourth sentence not aligned."""
    late = (F.col("idx") % 9) * 100
    aligned = (F.col("doc_id") + F.col("idx")) % 4 != 0
    first = derived_spans(docs.select("doc_id", "text"))
    whole = first.withColumns({"start_ms": F.col("start_ms") + late, "end_ms": F.col("end_ms") + late})
    return whole.withColumns({c: F.when(aligned, F.col(c)) for c in ("start_ms", "end_ms")}).drop("method", "score", "note", "status")


def derived_overrides(docs: DataFrame) -> DataFrame:
    """Two overrides of every third sentence; the later one counts."""
    rows = sentences.explode_sentences(docs).where("idx % 3 = 0").select("doc_id", F.col("idx").alias("sentence_idx"))
    rows = rows.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    return rows.withColumns({"start_ms": (F.col("sentence_idx") * 1000 + F.col("seq")).cast("long"), "end_ms": (F.col("sentence_idx") * 1000 + 500 * F.col("seq") + 2500).cast("long")})


def spoken(docs: DataFrame, perturb: bool) -> DataFrame:
    """(doc_id, sentences, words) with the text's own tokens as words; perturbed, every 17th is left out and every 11th loses its last letter."""
    tokens = text_functions.tokens(F.col("text"))
    worn = F.filter(F.transform("tokens", lambda t, i: F.when(i % 17 == 16, F.lit(None)).when(i % 11 == 10, F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)), lambda t: t.isNotNull())
    rows = docs.select("doc_id", sentences.split_sentences(F.col("text")).alias("sentences"), tokens.alias("tokens"))
    if perturb:
        rows = rows.withColumn("tokens", worn)
    rows = rows.withColumn("took", F.transform("tokens", lambda t: (F.length(t) * 60 + 40).cast("long"))).withColumn("at", text_functions.running_sums(F.col("took")))
    timed = F.transform("tokens", lambda t, i: F.struct(t.alias("text"), F.get("at", i).alias("start"), F.get("at", i + 1).alias("end")))
    return rows.select("doc_id", "sentences", timed.alias("words"))


# ---- queries


def strip_quotes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text_functions.strip_quotes(F.col("text")).alias("text"))


def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text_functions.normalize(F.col("text")).alias("norm"))


def tokenize_docs(spark, sf_dir):
    return text_functions.explode_tokens(documents(spark, sf_dir), "doc_id", "text")


def sentence_split(spark, sf_dir):
    return sentences.explode_sentences(documents(spark, sf_dir))


def learned_splitter(spark, sf_dir):
    """What the documents teach the trained splitter: abbreviations, collocations and beginnings with their scores."""
    learned = splitter.train(documents(spark, sf_dir))
    part = lambda name, df, after: df.select(F.lit(name).alias("kind"), "type", after.alias("next"), F.round("score", 4).alias("score"))
    none = F.lit(None).cast("string")
    return part("abbreviation", learned.abbreviations, none).unionByName(part("collocation", learned.collocations, F.col("next"))).unionByName(part("starter", learned.starters, none))


def trained_sentences(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return splitter.explode_sentences(docs, splitter.train(docs))


def token_freq(spark, sf_dir):
    return words.token_frequency(documents(spark, sf_dir))


def token_idf(spark, sf_dir):
    return words.token_idf(documents(spark, sf_dir))


def distinct_vocab(spark, sf_dir):
    return words.token_frequency(documents(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))


def anchors_top3(spark, sf_dir):
    return words.anchors(documents(spark, sf_dir))


def token_weight(spark, sf_dir):
    rows = text_functions.explode_tokens(documents(spark, sf_dir), "doc_id", "text")
    return rows.withColumn("weight", text_functions.token_weight(F.col("token")))


def unit_normalize(spark, sf_dir):
    rows = text_functions.explode_tokens(documents(spark, sf_dir), "doc_id", "text").groupBy("token").count().select("token")
    return rows.select("token", text_functions.normalize_unit(F.col("token")).alias("unit"), text_functions.contraction_key(F.col("token")).alias("long_form"))


def number_equiv_digits(spark, sf_dir):
    raw = documents(spark, sf_dir).select(F.explode(F.split("text", r"[ \t\n]+")).alias("word")).where(F.col("word").rlike("[0-9]")).distinct()
    rows = raw.withColumn("digits", F.regexp_replace("word", "[^0-9]", ""))
    return rows.alias("x").join(rows.alias("y"), "digits").where("x.word < y.word").select("digits", F.col("x.word").alias("a"), F.col("y.word").alias("b"))


def indel_ratio_pairs(spark, sf_dir):
    rows = text_functions.explode_tokens(benchmark(spark, sf_dir), "doc_id", "text")
    after = F.lead("token").over(Window.partitionBy("doc_id").orderBy("pos"))
    pairs = rows.withColumn("after", after).where("after is not null").select(F.col("token").alias("a"), F.col("after").alias("b")).distinct()
    return pairs.select("a", "b", F.round(indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


def fuzzy_vocab_join(spark, sf_dir):
    rows = text_functions.explode_tokens(benchmark(spark, sf_dir), "doc_id", "text")
    return words.vocabulary_matches(rows, 92.0).select("a", "b", F.round("ratio", 6).alias("ratio"))


def ngrams(spark, sf_dir):
    return words.ngrams(benchmark(spark, sf_dir), "doc_id", "text")


def compound_matches(spark, sf_dir):
    """Long tokens of each document against its own words, two or three run together."""
    return compound.text_compounds(documents(spark, sf_dir), 92.0)


def word_timeline(spark, sf_dir):
    return words.derived_words(documents(spark, sf_dir))


def band_candidates(spark, sf_dir):
    docs = benchmark(spark, sf_dir)
    rows = sentences.explode_sentences(docs).withColumn("tokens", text_functions.tokens(F.col("sentence"))).where(F.size("tokens") > 0)
    stream = text_functions.explode_tokens(docs, "doc_id", "text").withColumnRenamed("token", "word")
    return words.band_candidates(rows, stream, "doc_id")


def anchor_ranges(spark, sf_dir):
    return words.anchor_ranges(documents(spark, sf_dir))


def align_fuzzy(spark, sf_dir):
    # texts are dealt out, not the words made of them
    found = alignment.align(spoken(alignment.spread(documents(spark, sf_dir)), perturb=False), LENIENT, dealt=True)
    return found.withColumn("score", F.round("score", 9))


def align_fallback(spark, sf_dir):
    found = alignment.align(spoken(alignment.spread(documents(spark, sf_dir)), perturb=True), LENIENT, dealt=True)
    return found.withColumn("score", F.round("score", 9))


def align_segments(spark, sf_dir):
    """align_fallback's rows by the segment-parallel fold: all documents, in segments of 50 sentences."""
    found = long_align.align_long(spoken(alignment.spread(documents(spark, sf_dir)), perturb=True), LENIENT, segment=50, dealt=True)
    return found.withColumn("score", F.round("score", 9))


def align_external(spark, sf_dir):
    return external.align_external(spoken(benchmark(spark, sf_dir), perturb=True), external.ExactProvider()).drop("confidence")


def hybrid_build(spark, sf_dir):
    """The router's hybrid: external first, fuzzy for what it left out."""
    return merge.route(spoken(benchmark(spark, sf_dir), perturb=True), Config(alignment=LENIENT), external.ExactProvider())[0]


def hybrid_merge(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return merge.merge_spans(other_spans(docs), derived_spans(docs))


def manual_override(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return schedule.apply_overrides(derived_spans(docs).select("doc_id", "idx", "start_ms", "end_ms"), derived_overrides(docs))


def aligned_renumber(spark, sf_dir):
    return schedule.aligned_only(derived_spans(documents(spark, sf_dir))).select("doc_id", "idx", "audio_idx", "start_ms", "end_ms")


def repeat_rule(spark, sf_dir):
    found = schedule.aligned_only(derived_spans(documents(spark, sf_dir)))
    return schedule.with_repeats(found).select("doc_id", "idx", "seconds", "num_repeats")


def repeat_histogram(spark, sf_dir):
    return schedule.repeat_histogram(schedule.aligned_only(derived_spans(documents(spark, sf_dir))))


def _blocks(spark, sf_dir) -> DataFrame:
    return schedule.with_blocks(schedule.aligned_only(derived_spans(documents(spark, sf_dir))))


def block_ends(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "idx", "audio_idx", "clip_ms", "num_repeats", "block_start", "block_end")


def read_offsets(spark, sf_dir):
    return schedule.reads(_blocks(spark, sf_dir))


def report_details(spark, sf_dir):
    return report.formatted(merge.details(derived_spans(documents(spark, sf_dir)), "fuzzy")).select("doc_id", "idx", "text", "status", "score", "reason", "method")


def _counts(spark, sf_dir) -> DataFrame:
    spans = derived_spans(documents(spark, sf_dir))
    return report.counts(spans, merge.details(spans, "fuzzy"))


def report_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


def summary_line(spark, sf_dir):
    return report.summary(_counts(spark, sf_dir))


def summary_text(spark, sf_dir):
    spans = derived_spans(documents(spark, sf_dir))
    details = merge.details(spans, "fuzzy")
    return report.summary_text(report.counts(spans, details), details)


def success_rate(spark, sf_dir):
    return report.success_rate(_counts(spark, sf_dir))


def issue_lines(spark, sf_dir):
    return report.issues(merge.details(derived_spans(documents(spark, sf_dir)), "fuzzy"))


def avg_quality(spark, sf_dir):
    spans = derived_spans(documents(spark, sf_dir))
    scored = report.quality(spans, merge.details(spans, "fuzzy"))
    return scored.groupBy("doc_id").agg(F.round(F.avg("quality_score"), 9).alias("avg_score"), F.count_if(F.col("start_ms").isNotNull()).alias("processed"))


def manifest_rows(spark, sf_dir):
    rows = report.own_manifest_rows(derived_spans(documents(spark, sf_dir)))
    return rows.select("doc_id", "idx", F.to_json("entry").alias("entry"))


def manifest_offsets(spark, sf_dir):
    rows = report.own_manifest_rows(derived_spans(documents(spark, sf_dir)))
    offsets = [F.col(f"entry.output_offsets_ms.{r}_read_{s}").alias(f"{r}_{s}") for r in ("first", "third", "fifth") for s in ("start", "end")]
    return rows.select("doc_id", "idx", "entry.status", F.col("entry.quality.score").alias("score"), F.col("entry.quality.note").alias("note"), *offsets, "entry.num_repeats", "entry.original_duration_seconds")


def compare_methods(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return compare.compare_methods(derived_spans(docs), other_spans(docs))


def review_queue(spark, sf_dir):
    spans = derived_spans(documents(spark, sf_dir))
    return compare.review_queue(spans, merge.details(spans, "fuzzy"))


def time_format(spark, sf_dir):
    rows = words.derived_words(documents(spark, sf_dir)).select(F.col("end_ms").alias("ms")).distinct()
    return rows.select("ms", timecode.hours_timestamp(F.col("ms")).alias("hours"), timecode.minutes_timestamp(F.col("ms")).alias("minutes"))


def time_parse(spark, sf_dir):
    rows = words.derived_words(documents(spark, sf_dir)).select(F.col("end_ms").alias("ms")).distinct()
    return rows.select("ms", timecode.parse_time(timecode.minutes_timestamp(F.col("ms"))).alias("parsed"), timecode.parse_time(F.col("ms").cast("string")).alias("seconds"))


def file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", timecode.file_name(F.col("url")).alias("name"))


def transcript_explode(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(text_functions.tokens(F.col("text"))).alias("pos", "token"))
    return rows


def words_envelope(spark, sf_dir):
    """Each conversation as a words file, read back by the words source: format, id and number of words."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text_functions.tokens(F.col("text"))).alias("pos", "token"))
    order = Window.partitionBy("conv_id").orderBy("turn", "pos")
    timed = turns.withColumn("n", F.row_number().over(order)).select("conv_id", F.struct(F.col("n"), F.struct(F.col("token").alias("text"), (F.col("n") * 100).cast("long").alias("start"), (F.col("n") * 100 + 90).cast("long").alias("end")).alias("w")).alias("w"))
    listed = timed.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("w")), lambda x: x["w"]).alias("words"))
    named = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id")).alias("audio_id"), F.lit(16000).alias("sr_hz"), "words"))).otherwise(
        F.to_json(F.struct(F.concat(F.lit("t"), F.col("conv_id")).alias("id"), F.lit("en").alias("language_code"), "words"))
    )
    parsed = readers.parse_words(listed.select("conv_id", named.alias("json")), "json")
    return parsed.select("conv_id", "format", "audio_id", F.size("words").cast("long").alias("n_words"), "valid")


def silence_blocks(spark, sf_dir):
    """The length in bytes of each block's sound: clips and pauses as 16-bit samples."""
    return _blocks(spark, sf_dir).select("doc_id", "idx", audio.block_bytes(F.col("clip_ms"), F.col("num_repeats"), CONFIG).alias("n_bytes"))


QUERIES = {
    f.__name__: f
    for f in (
        strip_quotes, normalize_text, tokenize_docs, sentence_split, learned_splitter, trained_sentences, token_freq, token_idf, distinct_vocab, anchors_top3, token_weight, unit_normalize,
        number_equiv_digits, indel_ratio_pairs, fuzzy_vocab_join, ngrams, compound_matches, word_timeline, band_candidates, anchor_ranges, align_fuzzy, align_fallback, align_segments,
        align_external, hybrid_build, hybrid_merge, manual_override, aligned_renumber, repeat_rule, repeat_histogram, block_ends, read_offsets,
        report_details, report_counts, summary_line, summary_text, success_rate, issue_lines, avg_quality, manifest_rows, manifest_offsets, compare_methods,
        review_queue, time_format, time_parse, file_names, transcript_explode, words_envelope, silence_blocks,
    )
}

from . import oracles, oracles_splitter  # noqa: E402

ORACLE_SQL = {**oracles.ORACLE_SQL, **oracles_splitter.ORACLE_SQL}
