"""Exact dedup by progressive refinement: length, then a prefix hash, then the full hash of surviving groups.

Defined results: null counts as the empty text; texts are equal when they are identical without the
characters [\\x20\\x09-\\x0D]; of equal texts the row with the most code points in its own text stays, of
these the smallest id; repeated rows that tie with the row that stays (same id, same length) all count as kept.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, staged, text_or_empty, without_spaces

#: Characters of the normalised text under the prefix hash.
PREFIX = 64
#: Groups of length and prefix (20 bytes each) that are sent to all executors; of more groups, only which of so many hash
#: buckets have one.
FEW_GROUPS, BUCKETS = 200_000, 1 << 20


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", prefix: int = PREFIX, all_digests: bool = False) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 of the normalised text, and n_points (the text's code points).

    The first pass keeps the id, the number of code points, the length and a prefix hash. Rows alone with their length, then rows
    alone with their length and prefix, are settled there. The second pass hashes the full texts of the others where they are
    read, so just 32 bytes a row travel, and only they are grouped by it. With all_digests it hashes the settled texts too,
    for the column alone; text_sha256 is null for settled rows otherwise. Equal SHA-256 counts as equal text.
    """
    body = text_or_empty(text)
    norm = without_spaces(body)
    full_of = lambda text: F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))
    full = full_of(norm)
    if id_col in ("n_points", "n_norm", "n_prefix", "digest", "kept", "keep_id", "group_size"):
        raise ValueError(f"{id_col} is the name of a result column")
    size, head = F.length(norm).alias("n_norm"), F.xxhash64(F.substring(norm, 1, prefix)).alias("n_prefix")
    first = staged(docs.select(F.col(id_col), F.length(body).alias("n_points"), size, head), "exact-first")
    total = first.count()
    spread = F.struct(id_col, "n_points")

    # lengths, then length and prefix: groups of one are settled without their full text
    by_length = first.groupBy("n_norm").agg(F.count("*").alias("n_same")).where("n_same > 1")
    by_prefix = first.groupBy("n_norm", "n_prefix").agg(F.count("*").alias("n_same")).where("n_same > 1").join(by_length.select("n_norm"), "n_norm", "left_semi")
    by_prefix = staged(by_prefix.select("n_norm", "n_prefix", F.lit(True).alias("_open")), "exact-prefix")
    again = docs.select(F.col(id_col), F.length(body).alias("n_points"), size, head, norm.alias("norm"))
    if by_prefix.count() <= FEW_GROUPS:
        met = again.join(F.broadcast(by_prefix), ["n_norm", "n_prefix"], "left")
    else:  # texts that merely share a bucket with an open group are hashed too, and settled by the hash
        bucket = F.pmod(F.xxhash64("n_norm", "n_prefix"), F.lit(BUCKETS)).alias("_bucket")
        met = again.withColumn("_bucket", bucket).join(F.broadcast(by_prefix.select(bucket, "_open").distinct()), "_bucket", "left")
    met = met.select(id_col, "n_points", "n_norm", "n_prefix", F.col("_open").isNotNull().alias("_open"), "norm")
    hashed = full_of(F.col("norm")) if all_digests else F.when(F.col("_open"), full_of(F.col("norm")))
    rows = staged(met.withColumn("digest", hashed).drop("norm"), "exact-open")
    open_, settled = rows.where("_open"), rows.where("not _open")

    # full hash: the row that stays is the smallest of (-code points, id)
    key = ["n_norm", "n_prefix", "digest"]
    best = F.min(F.struct((-F.col("n_points")).alias("m"), F.col(id_col).alias("i")))
    groups = open_.groupBy(*key).agg(best.alias("_best"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = groups.select(*key, F.col("_best.i").alias("keep_id"), F.col("_best.m").alias("_m"), "group_size")
    out = join_groups(open_, groups, key, "group_size", total, spread)
    out = out.unionByName(settled, allowMissingColumns=True)
    return out.select(
        id_col,
        F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("keep_id").eqNullSafe(F.col(id_col)) & (F.col("_m") == -F.col("n_points")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_points",
    )
