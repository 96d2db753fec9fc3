"""Texts, word files, recordings, overrides and earlier manifests as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nfkc
from ..operators.audio import audio_info

WORDS = "array<struct<text:string,start:bigint,end:bigint,confidence:double,speaker:string>>"
ENVELOPE = f"audio_id string, id string, language_code string, text string, status string, audio_duration double, sr_hz int, words {WORDS}"
OVERRIDES = "doc_id string, sentence_idx int, seq int, start_ms long, end_ms long"


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): each UTF-8 file is a document, named by its file, in compatibility normal form."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(_stem(F.input_file_name()).alias("doc_id"), nfkc(F.col("value")).alias("text"))


def _described(rows: DataFrame, e: str) -> DataFrame:
    """The envelope in column e as format, audio_id, sr_hz, words and valid: at least one word, each with text, start and end."""
    whole = F.forall(f"{e}.words", lambda w: w["text"].isNotNull() & w["start"].isNotNull() & w["end"].isNotNull())
    return rows.select(
        *(c for c in rows.columns if c != e),
        F.when(F.col(f"{e}.language_code").isNotNull(), "service").otherwise("spec").alias("format"),
        F.coalesce(F.col(f"{e}.audio_id"), F.col(f"{e}.id"), F.lit("unknown")).alias("audio_id"),
        F.col(f"{e}.sr_hz").alias("sr_hz"),
        F.col(f"{e}.words").alias("words"),
        F.coalesce((F.size(f"{e}.words") > 0) & whole, F.lit(False)).alias("valid"),
    )


def parse_words(rows: DataFrame, json: str) -> DataFrame:
    """rows with the word file in column `json` parsed; unreadable ones are not valid."""
    return _described(rows.withColumn("_e", F.from_json(json, ENVELOPE)).drop(json), "_e")


def read_words(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(doc_id, format, audio_id, sr_hz, words, valid), a word file a row. strict: an invalid file is an error when it is read."""
    rows = spark.read.text(path, wholetext=True).select(_stem(F.input_file_name()).alias("doc_id"), F.col("value").alias("json"))
    found = parse_words(rows, "json")
    if strict:
        wrong = F.raise_error(F.concat(F.lit("no usable words in "), F.col("doc_id")))
        # in the words themselves too, as a plan that doesn't ask for `valid` doesn't compute it
        found = found.withColumns({"words": F.when(F.col("valid"), F.col("words")).otherwise(wrong.cast(WORDS)), "valid": F.when(F.col("valid"), True).otherwise(wrong.cast("boolean"))})
    return found


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content, duration_ms, sample_rate, channels) of WAV files."""
    rows = spark.read.format("binaryFile").load(path).select(_stem(F.col("path")).alias("doc_id"), "content")
    return rows.withColumn("info", audio_info(F.col("content"))).select("doc_id", "content", "info.*")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OVERRIDES).json(path)


def aligned_in_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_sentences, n_aligned) of manifests written by write_manifests()."""
    schema = "doc_id string, manifest struct<sentences:array<struct<idx:int,source_span_ms:struct<start:bigint,end:bigint,pad_ms:int>>>>"
    s = F.col("manifest.sentences")
    return spark.read.schema(schema).json(path).select("doc_id", F.size(s).alias("n_sentences"), F.size(F.filter(s, lambda x: x["source_span_ms"].isNotNull())).alias("n_aligned"))
