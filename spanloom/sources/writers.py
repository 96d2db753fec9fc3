"""Manifests, reports, transcripts, comparisons and sounds out to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import write_files


def write_manifests(manifests: DataFrame, reports: DataFrame, path: str) -> None:
    """A JSON line a document, under manifests and reports; nulls are kept, as readers tell by them."""
    for name, rows in (("manifests", manifests), ("reports", reports)):
        rows.withColumn("doc_id", F.col("doc_id").cast("string")).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def write_json(rows: DataFrame, path: str) -> None:
    """Transcripts, comparisons and other results, a JSON line a row."""
    rows.write.mode("overwrite").json(path)


def write_documents(rows: DataFrame, column: str, path: str) -> None:
    """Column `column` of rows (doc_id, ...) as one JSON file a document, nulls kept: manifests, reports, results, comparisons."""
    write_files(rows.select("doc_id", F.to_json(column, {"ignoreNullFields": "false", "pretty": "true"}).alias("json")), path, "doc_id", "json", "json")


def write_sounds(sounds: DataFrame, path: str) -> None:
    """(doc_id, wav) as one WAV file a document."""
    write_files(sounds, path, "doc_id", "wav", "wav")


def write_summaries(summaries: DataFrame, path: str) -> None:
    """(doc_id, summary) as one text file a document."""
    write_files(summaries, path, "doc_id", "summary", "txt")
