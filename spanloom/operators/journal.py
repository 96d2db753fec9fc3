"""A durable journal of calls to a service outside Spark: a reply is written down as soon as it is there, and never asked for again.

Calls run in one job, at once, and their rows are committed to `replies`; every plan reads these and calls nothing. Until
the job commits, each attempt of a task adds its replies to a file of its own in `segments/<run>/<partition>`. A task
that is run again, after its worker or executor was lost, reads what the attempts before it wrote; a run that follows a lost driver reads
all segments. Calls that end without a reply aren't kept as replies, so a later run asks again.

On file systems that can append (local, NFS, HDFS) no reply that came back is lost; on others a file is visible once closed, so an
attempt closes one for each document, and what a killed one had asked for its last document is asked again. Attempts that run side by side
(speculation) and runs that share a journal at the same time don't see each other's calls.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPLY = "key string, status string, start_ms long, end_ms long, confidence double, note string"
#: Statuses that are replies of the service, and final.
FINAL = ("found", "none")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class Segment:
    """The file of one attempt of a task, and the replies of the attempts before it."""

    def __init__(self, uri: str):
        self.fs, self.folder = _file_system(uri)
        self.fs.create_dir(self.folder, recursive=True)
        self.lock, self.stream, self.appends = Lock(), None, True

    def before(self) -> dict[str, dict]:
        from pyarrow import fs

        found = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.folder)):
            with self.fs.open_input_stream(info.path) as stream:
                for line in stream.read().split(b"\n"):
                    try:
                        record = json.loads(line)
                    except ValueError:  # the last line of an attempt that was killed
                        continue
                    if record.get("status") in FINAL:
                        found[record["key"]] = record
        return found

    def add(self, record: dict) -> None:
        with self.lock:
            if self.stream is None:
                path = f"{self.folder}/{uuid.uuid4().hex}.jsonl"
                try:
                    self.stream = self.fs.open_append_stream(path)
                except (NotImplementedError, OSError):
                    self.stream, self.appends = self.fs.open_output_stream(path), False
            self.stream.write(json.dumps(record).encode() + b"\n")
            self.stream.flush()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


class RateLimit:
    """At most so many calls a second of all workers of one executor: the time of the next free call stands in a locked file beside them."""

    def __init__(self, calls_a_second: float | None, name: str):
        self.gap = 1.0 / calls_a_second if calls_a_second else 0.0
        self.path = os.path.join(tempfile.gettempdir(), f"spanloom-calls-{name}")

    def wait(self) -> None:
        if not self.gap:
            return
        import fcntl

        with open(self.path, "a+") as held:
            fcntl.flock(held, fcntl.LOCK_EX)
            held.seek(0)
            free = max(time.time(), float(held.read() or 0))
            held.truncate(0)
            held.write(repr(free + self.gap))
            held.flush()
            fcntl.flock(held, fcntl.LOCK_UN)
        time.sleep(max(0.0, free - time.time()))


def replies(spark: SparkSession, path: str) -> DataFrame:
    """(key, status, start_ms, end_ms, confidence, note): what has been replied so far, once for each key."""
    found = spark.createDataFrame([], REPLY)
    for folder, kind in (("replies", "parquet"), ("segments", "json")):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            rows = spark.read.schema(REPLY).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").format(kind).load(f"{path}/{folder}")
            found = found.unionByName(rows.where(F.col("status").isin(*FINAL)))
    return found.dropDuplicates(["key"])


def call(docs: DataFrame, path: str, ask: Callable[[str, list[dict]], dict], workers: int, calls_a_second: float | None = None) -> DataFrame:
    """Replies to docs (doc_id, keys, sentences, words), where keys[i] names the question sentences[i] of words; each key is asked once.

    ask gives the columns of REPLY but the key. The result has a row for each key that was asked now or before; those
    whose calls failed now are among them. The job that calls is run here, not when the result is read.
    """
    spark, run = docs.sparkSession, uuid.uuid4().hex
    known = replies(spark, path)
    asked = docs.select("doc_id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    open_ = asked.join(known.select("key"), "key", "left_anti").groupBy("doc_id").agg(F.collect_set("key").alias("open"))
    # a partition holds the same documents in every attempt: it is dealt by id into a stated number
    parts = 2 * spark.sparkContext.defaultParallelism
    open_ = open_.join(docs.select("doc_id", "keys", "sentences", "words"), "doc_id").repartition(parts, "doc_id")
    segments, name = f"{path}/segments/{run}", spark.sparkContext.applicationId

    def work(batches):
        import pandas as pd
        from pyspark import TaskContext

        segment = Segment(f"{segments}/{TaskContext.get().partitionId()}")
        done, limit = segment.before(), RateLimit(calls_a_second, name)

        def once(question):
            key, sentence, words = question
            if key not in done:
                limit.wait()
                done[key] = {"key": key, **ask(sentence, words)}
                segment.add(done[key])
            return done[key]

        columns = [c.split()[0] for c in REPLY.split(", ")]
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                rows = []
                for open_keys, keys, sentences, words in zip(batch["open"], batch["keys"], batch["sentences"], batch["words"], strict=True):
                    spoken, wanted = [dict(w) for w in (words if words is not None else ())], set(open_keys)
                    questions = {k: (k, s, spoken) for k, s in zip(keys, sentences, strict=True) if k in wanted}
                    rows += pool.map(once, questions.values())
                    if not segment.appends:
                        segment.close()
                out = pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns)
                yield out.astype({"start_ms": "Int64", "end_ms": "Int64", "confidence": "float64"})
        segment.close()

    open_.mapInPandas(work, REPLY).write.mode("append").parquet(f"{path}/replies")
    place = spark._jvm.org.apache.hadoop.fs.Path(segments)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    rows = spark.read.schema(REPLY).parquet(f"{path}/replies")
    best = F.struct(F.col("status").isin(*FINAL).alias("f"), F.col("status"), "start_ms", "end_ms", "confidence", "note")
    chosen = rows.groupBy("key").agg(F.max(best).alias("r")).select("key", "r.status", "r.start_ms", "r.end_ms", "r.confidence", "r.note")
    return chosen.unionByName(known.join(chosen.select("key"), "key", "left_anti"))
