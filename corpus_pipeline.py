"""The corpus pipeline: documents in, packed training sequences out.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import common, exact_dedup, ngram_join, packing, pii, quality_rules, queries


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule. Null and empty texts break one; repeated rows are judged each for itself; an empty table stays empty."""
    return quality_rules.quality_rules(docs).where("kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts. Rows that repeat id and text are one document.

    Null counts as the empty text; an empty table stays empty. Documents are found by id, and by text too only where ids repeat; few
    of them to drop are sent to where the texts are read.
    """
    repeats = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeats:
        docs = docs.dropDuplicates(["doc_id", "text"])
    gone = exact_dedup.exact_dedup(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.col("n_points").alias("_n"), F.col("text_sha256").alias("_sha"))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    if repeats:
        body = common.text_or_empty("text")
        same = same & (F.length(body) == F.col("_n")) & (F.sha2(F.encode(common.without_spaces(body), "UTF-8"), 256) == F.col("_sha"))
    return docs.join(common.sent_if_few(gone, "pipeline-gone"), same, "left_anti").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Null and empty texts are linked with nothing and stay; an empty table stays empty. Rows that repeat id and text are one document.
    Where ids repeat or are null, documents are told apart by id and text, a null id comes last, and of a group's smallest id the text
    with the least hash stays.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = ngram_join.ngram_jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(common.sent_if_few(gone, "pipeline-near"), "doc_id", "left_anti").select(*docs.columns)
    own = F.sha2(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(","), common.text_or_empty("text")), "UTF-8"), 256)
    keyed = docs.withColumn("_near", own)
    found = ngram_join.ngram_jaccard_components(keyed, id_col="_near").select("_near", "component_id").distinct()
    found = common.staged(found.join(keyed.select("_near", "doc_id").distinct(), "_near"), "pipeline-members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_near").alias("least")))
    groups = found.groupBy("component_id").agg(F.count("*").alias("_size"), first.alias("_first"))
    members = common.join_groups(found, groups, ["component_id"], "_size", found.count(), F.col("_near"))
    gone = members.where("_near <> _first.least").select("_near")
    return keyed.join(common.sent_if_few(gone, "pipeline-near"), "_near", "left_anti").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, and their new lengths. Null texts stay null; repeated rows are masked alike; an empty table stays empty."""
    masked = pii.mask_pii(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences. A null or empty text is the closing id alone; repeated rows are packed each for itself; an empty table gives no rows."""
    found = packing.best_fit_packing(docs, queries.tokenizer_file("word_bpe_49k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("pii", private), ("best_fit_packing", packed)]

#: Not expressible: tokenization and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each staged in the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
