import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from spanloom.sources import files


def held(path):
    """Files below path by their own name, with contents; hidden and empty marks apart."""
    found = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n not in ("_SUCCESS",) and not n.endswith(".crc"):
                assert n not in found
                found[n] = open(os.path.join(folder, n), "rb").read()
    return found


def test_a_file_a_row(spark, tmp_path):
    names = ["Lesson/2/Part1", "Lesson_2_Part1", "lesson:2:part1", "", None, "..", "a" * 400, "é" * 300, "x\ny", "con.", "b__2", "b", "b", "B"]
    rows = spark.createDataFrame([(n, f"text {i}") for i, n in enumerate(names)], "doc_id string, body string").repartition(3)
    files.write_files(rows, str(tmp_path / "out"), "doc_id", "body", "json")
    got = held(tmp_path / "out")
    assert sorted(v.decode() for v in got.values()) == sorted(f"text {i}" for i in range(len(names)))
    assert {"Lesson_2_Part1.json", "B.json", "b__2.json", "b__3.json", "b__2_.json"} <= set(got) and len({n.lower() for n in got}) == len(names)
    assert not os.path.exists(tmp_path / "out/_temporary") and os.path.exists(tmp_path / "out/_SUCCESS")
    files.write_files(rows.limit(1), str(tmp_path / "out"), "doc_id", "body", "json")  # replaces all
    assert len(held(tmp_path / "out")) == 1
    files.write_files(rows.limit(0), str(tmp_path / "none"), "doc_id", "body", "json")
    assert held(tmp_path / "none") == {}
    back = spark.read.format("binaryFile").load(str(tmp_path / "out/*/*.json"))
    assert back.count() == 1


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    good = spark.createDataFrame([("a", "old")], "doc_id string, body string")
    files.write_files(good, str(tmp_path / "out"), "doc_id", "body", "txt")
    bad = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("doc_id"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.lit("new")).alias("body"))
    with pytest.raises(Exception, match="broken"):
        files.write_files(bad, str(tmp_path / "out"), "doc_id", "body", "txt")
    assert held(tmp_path / "out") == {"a.txt": b"old"}


def test_a_task_that_runs_again(tmp_path):
    """A worker dies after it has written files: the task's second attempt writes them anew, and each is there once and whole."""
    script = textwrap.dedent(f"""
        import os
        from pyspark.sql import SparkSession, functions as F
        from spanloom.sources import files
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        real = files.FilesWriter.write
        def dying(self, iterator):
            def rows():
                for i, row in enumerate(iterator):
                    if i == 5 and not os.path.exists("{tmp_path}/died"):
                        open("{tmp_path}/died", "w").close()
                        os._exit(1)
                    yield row
            return real(self, rows())
        class Dies(files.FilesWriter):
            write = dying
        class Source(files.Files):
            def writer(self, schema, overwrite):
                return Dies(self.options["path"], overwrite)
        files.Files = Source
        rows = spark.range(60).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id").cast("int") * 100).alias("body"))
        files.write_files(rows, "{tmp_path}/out", "doc_id", "body", "wav")
    """)
    env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, env=env, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert os.path.exists(tmp_path / "died")
    assert {n: len(v) for n, v in held(tmp_path / "out").items()} == {f"d{i}.wav": 100 * i for i in range(60)}
    assert not os.path.exists(tmp_path / "out/_temporary")
