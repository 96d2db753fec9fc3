"""Pieces that the corpus operators share: the shared folder, staged tables, skew-safe joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and text contracts: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: At most this many groups can each hold a thousandth of all rows, so a table of such groups is bounded.
HOT_SHARE = 1000
#: Rows of a list (100 bytes each or so) that is sent to all executors, so that what it meets needn't travel.
FEW_ROWS = 200_000
#: Rows of an Arrow batch, where the session has the usual 10000.
ROWS_A_BATCH = 2000
#: Seconds without use after which a Python worker gives up what it keeps from task to task.
IDLE_S = 3


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one is set only where it is unset and all runs on one machine, as in tests."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), "spanloom-shared"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes the folders of staged tables that df reads directly; for tables that no later step needs."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/spanloom/" in folder:
            path = hadoop(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sent_if_few(df: DataFrame, name: str, most: int = FEW_ROWS) -> DataFrame:
    """df, staged and counted: to be broadcast if it has few rows, else to be joined by shuffle."""
    df = staged(df, name)
    return F.broadcast(df) if df.count() <= most else df


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def without_spaces(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: Column) -> DataFrame:
    """Left join of rows with one row per group, safe when one group holds a large share of all rows.

    Groups with at least total / HOT_SHARE rows number at most HOT_SHARE, so they are broadcast. The other
    groups are small and join by shuffle; rows of hot groups get a spread-out key there, so none gathers.
    """
    values = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) * HOT_SHARE >= F.lit(total)).select(*keys, F.struct(*values).alias("_hot"))
    # a key of 0 that isn't a literal: the planner would take a literal out of the join's keys and deal by the others
    cold = groups.where(F.col(size) * HOT_SHARE < F.lit(total)).select(*keys, F.least(F.col(size), F.lit(0)).cast("int").alias("_deal"), F.struct(*values).alias("_cold"))
    joined = rows.join(F.broadcast(hot), keys, "left")
    joined = joined.withColumn("_deal", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 30)).cast("int")))
    joined = joined.join(cold, [*keys, "_deal"], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *(found[c].alias(c) for c in values))


def small_batches(spark: SparkSession) -> None:
    """Fewer rows of text at once in Python workers and in the buffers before them; a number that the user has set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ROWS_A_BATCH))


class Kept:
    """make(key), kept in a Python worker from task to task, and given up after IDLE_S seconds without use.

    Workers outlive the stage: what they held on to would be lacking in all later stages of the session, those without Python too.
    A task that still holds the value goes on with it.
    """

    def __init__(self, make: Callable):
        self.make, self.key, self.value, self.used, self.lock = make, None, None, 0.0, threading.Lock()

    def get(self, key):
        with self.lock:
            if self.value is None or self.key != key:
                if self.value is None:
                    threading.Thread(target=self._watch, daemon=True).start()
                self.key, self.value = key, self.make(key)
            self.used = time.monotonic()
            return self.value

    def touch(self) -> None:
        self.used = time.monotonic()

    def _watch(self) -> None:
        while True:
            with self.lock:
                left = self.used + IDLE_S - time.monotonic()
                if left <= 0:
                    self.key = self.value = None
                    break
            time.sleep(left)
        with contextlib.suppress(AttributeError, OSError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, columns: list[str], schema: str, make) -> DataFrame:
    """mapInArrow over columns: make() gives, once a task, a function from a tuple of column lists to output column lists."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = df.sparkSession  # the parser needs a session
    assert spark is not None
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        work = make()
        gc.disable()  # memories of many parts, without cycles, would be searched for cycles over and over
        try:
            for batch in batches:
                out = work(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
                yield pa.RecordBatch.from_arrays([pa.array(values, type=field.type) for values, field in zip(out, target, strict=True)], schema=target)
        finally:
            gc.enable()

    small_batches(spark)
    return df.select(*columns).mapInArrow(run, schema)
