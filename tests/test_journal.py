import json
import os
import subprocess
import sys
import textwrap
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import external, journal, merge
from spanloom.plans import config
from spanloom.plans.build import build

DOCS = "doc_id string, sentences array<string>, words array<struct<text:string,start:bigint,end:bigint>>"


class Counting:
    """Notes each call in a file, before the reply is given; knows sentences with a w."""

    def __init__(self, path, fails=()):
        self.path, self.fails = path, fails

    def align(self, sentence, words):
        with open(self.path, "a") as out:
            out.write(sentence + "\n")
        if sentence in self.fails:
            raise TimeoutError
        if sentence == "odd":
            return "a", "b", None
        return (50, 390, 0.8 if "x" in sentence else 1.0) if "w" in sentence else None


def calls(path):
    return Counter(open(path).read().split("\n")[:-1])


def timed(text):
    return [(w, i * 100, i * 100 + 90) for i, w in enumerate(text.split())]


def test_one_call_a_sentence_through_the_build(spark, tmp_path):
    own = config.load(alignment={"min_accept": 0.82, "warn_accept": 0.3}, external={"retry_delay": 0.0, "journal": str(tmp_path / "journal")})
    texts = spark.createDataFrame([(f"d{i}", " ".join(f"Wonderful water {i} {j}." if j % 3 else f"Other {i} {j}." for j in range(5))) for i in range(6)], "doc_id string, text string")
    transcripts = spark.createDataFrame([(f"d{i}", timed("wonderful water here other words")) for i in range(6)], "doc_id string, words array<struct<text:string,start:bigint,end:bigint>>")
    provider = Counting(str(tmp_path / "calls"))
    for _ in range(2):  # the second build reads what the first one was told
        made = build(texts, transcripts, own, provider)
        assert made.spans.count() == 30 and made.details.count() and made.manifests.count() == 6 and made.reports.count() == 6
        assert made.review.count() == 30 and made.spans.where("method = 'external'").count() == 18
        assert set(calls(provider.path).values()) == {1} and len(calls(provider.path)) == 30


def test_statuses_and_details(spark, tmp_path):
    own = config.load(external={"retry_delay": 0.0, "max_retries": 2})
    df = spark.createDataFrame([("a", ["w", "wx", "no", "odd", "never w", "w"], timed("w x")), ("b", ["w"], timed("w x")), ("c", None, None), ("d", ["w"], None), (None, [], [])], DOCS)
    provider = Counting(str(tmp_path / "calls"), fails={"never w"})
    found = external.align_external(df.withColumn("key", F.lit("clash")), provider, own)
    got = rows(found.select("doc_id", "idx", "status", "note", "start_ms", "end_ms", "confidence"))
    assert [r[:6] for r in got] == [
        ("a", 1, "ok", "", 0, 490),
        ("a", 2, "warning", "low confidence", 0, 490),
        ("a", 3, "failed", "no times found", None, None),
        ("a", 4, "error", "TypeError: '>=' not supported between instances of 'str' and 'int'", None, None),
        ("a", 5, "failed", "no times found", None, None),
        ("a", 6, "ok", "", 0, 490),
        ("b", 1, "ok", "", 0, 490),
        ("d", 1, "ok", "", 0, 490),
    ]
    # equal questions are one call; another word stream makes another question
    assert calls(provider.path) == {"w": 2, "wx": 1, "no": 1, "odd": 1, "never w": 2}
    details = {r.idx: r for r in merge.details(found, "external").where("doc_id = 'a'").collect()}
    assert details[2].confidence == 0.8 and tuple(details[2].span_ms) == (0, 490) and details[3].span_ms is None and set(details) == {2, 3, 4, 5}


def test_calls_that_failed_are_made_again_by_the_next_run(spark, tmp_path):
    own = config.load(external={"retry_delay": 0.0, "max_retries": 1, "journal": str(tmp_path / "journal")})
    df = spark.createDataFrame([("a", ["w", "wy"], timed("w x"))], DOCS)
    first, second = Counting(str(tmp_path / "one"), fails={"wy"}), Counting(str(tmp_path / "two"))
    assert rows(external.align_external(df, first, own).select("idx", "status")) == [(1, "ok"), (2, "failed")]
    assert rows(external.align_external(df, second, own).select("idx", "status")) == [(1, "ok"), (2, "ok")]
    assert calls(second.path) == {"wy": 1}


def test_torn_lines_and_segments_of_a_lost_driver(spark, tmp_path):
    segment = journal.Segment(str(tmp_path / "journal/segments/r/0"))
    segment.add({"key": "k", "status": "found", "start_ms": 1, "end_ms": 2, "confidence": 1.0})
    segment.add({"key": "f", "status": "failed"})
    segment.close()
    (tmp_path / "journal/segments/r/0/x.jsonl").write_text('{"key": "l", "status": "none"}\n{"key": "m", "sta')
    assert set(journal.Segment(str(tmp_path / "journal/segments/r/0")).before()) == {"k", "l"}
    assert rows(journal.replies(spark, str(tmp_path / "journal")).select("key", "status", "end_ms")) == [("k", "found", 2), ("l", "none", None)]


def test_killed_task(tmp_path):
    """A worker that dies in the middle of a task: the task runs again, and asks for the rest alone."""
    script = textwrap.dedent(f"""
        import os, sys
        from pyspark.sql import SparkSession
        from spanloom.operators import external
        from spanloom.plans import config
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.default.parallelism", "2").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
        class Dies:
            def align(self, sentence, words):
                if sentence == "w 7" and not os.path.exists("{tmp_path}/died"):
                    open("{tmp_path}/died", "w").close()
                    os._exit(1)
                with open("{tmp_path}/calls", "a") as out:
                    out.write(sentence + chr(10))
                return 1, 2, 1.0
        df = spark.createDataFrame([("a", [f"w {{i}}" for i in range(12)], [("w", 0, 1)]), ("b", [f"v {{i}}" for i in range(12)], [("v", 0, 1)])], "{DOCS}")
        found = external.align_external(df, Dies(), config.load(external={{"max_workers": 1}}))
        assert found.where("status = 'ok'").count() == 24, found.count()
        assert not os.listdir(f"{tmp_path}/shared/spanloom/" + os.listdir("{tmp_path}/shared/spanloom")[0] + "/segments")
    """)
    env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, env=env, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert os.path.exists(tmp_path / "died")
    assert set(calls(tmp_path / "calls").values()) == {1} and len(calls(tmp_path / "calls")) == 24


def test_rate_limit_is_shared_by_workers(tmp_path, monkeypatch):
    monkeypatch.setattr(journal.tempfile, "gettempdir", lambda: str(tmp_path))
    limits, began = [journal.RateLimit(50, "app") for _ in range(4)], time.time()
    threads = [threading.Thread(target=lambda own=own: [own.wait() for _ in range(5)]) for own in limits]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert 0.37 < time.time() - began < 3


@pytest.fixture
def service():
    seen = []

    class Chat(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers.get("Authorization"), body))
            self.send_response(200)
            self.end_headers()
            known = "water" in body["messages"][0]["content"].split("Find")[1]
            content = json.dumps({"start_ms": 0, "end_ms": 390, "confidence": 0.95}) if known else ""
            self.wfile.write(json.dumps({"choices": [{"message": {"content": content}}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/chat", seen
    server.shutdown()


def test_chat_provider(service, monkeypatch):
    url, seen = service
    monkeypatch.setenv("SOME_KEY", "k")
    provider = external.ChatProvider(url, "m", "SOME_KEY")
    words = [{"text": "water", "start": 0, "end": 390, "speaker": "A"}]
    assert external.ask(provider, 'The "water".', words, 1, 0) == {"status": "found", "start_ms": 0, "end_ms": 390, "confidence": 0.95}
    assert external.ask(provider, "Nothing.", words, 1, 0) == {"status": "none"}
    assert seen[0][0] == "Bearer k" and seen[0][1]["model"] == "m" and '[{"text":"water","start":0,"end":390}]' in seen[0][1]["messages"][0]["content"]
    assert external.ask(external.ChatProvider("http://127.0.0.1:9/none", "m"), "x", words, 2, 0) == {"status": "failed"}
