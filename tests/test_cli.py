import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.__main__ import parse, run
from spanloom.operators.audio import silence, wav_bytes, wav_info
from spanloom.sources import readers, speech


def test_files_to_files(spark, tmp_path):
    for name in ("t", "w", "r"):
        (tmp_path / name).mkdir()
    (tmp_path / "t/a.txt").write_text("Remarkable water flows downhill.")
    words = [{"text": w, "start": i * 300, "end": i * 300 + 250} for i, w in enumerate("remarkable water flows downhill".split())]
    (tmp_path / "w/a.json").write_text(json.dumps({"audio_id": "a", "words": words}))
    (tmp_path / "r/a.wav").write_bytes(wav_bytes([silence(2000, 8000)], 8000))
    (tmp_path / "c.yaml").write_text("pause_ms: 100\ninter_sentence_pause_ms: 100\nalignment: {method: fuzzy, min_accept: 0.82, warn_accept: 0.75}\n")
    run(spark, parse([str(tmp_path / "t"), str(tmp_path / "w"), str(tmp_path / "out"), "--recordings", str(tmp_path / "r"), "-c", str(tmp_path / "c.yaml"), "--tempo", "1.0", "--files"]))
    assert rows(readers.aligned_in_manifests(spark, str(tmp_path / "out/manifests"))) == [("a", 1, 1)]
    one = lambda pattern: next(iter(tmp_path.glob(f"out/{pattern}")))
    assert one("summaries/*/a.txt").read_text().startswith("Alignment Summary:\n  Total sentences: 1\n  Successfully aligned: 1 (100.0%)")
    assert wav_info(one("sounds/*/a.wav").read_bytes())[1:] == (44100, 1)
    assert json.loads(one("manifest_files/*/a.json").read_text())["sentences"][0]["idx"] == 1
    assert json.loads(one("report_files/*/a.json").read_text())["global"]["aligned"] == 1


def test_the_configured_method_counts(spark, tmp_path):
    for name in ("t", "w"):
        (tmp_path / name).mkdir()
    (tmp_path / "c.yaml").write_text("alignment: {method: external}\n")
    (tmp_path / "t/a.txt").write_text("One.")
    (tmp_path / "w/a.json").write_text('{"words": [{"text": "one", "start": 0, "end": 5}]}')
    with pytest.raises(ValueError, match="provider"):
        run(spark, parse([str(tmp_path / "t"), str(tmp_path / "w"), str(tmp_path / "out"), "-c", str(tmp_path / "c.yaml")]))


class Silent:
    def transcribe(self, content, language):
        raise ConnectionError


def test_transcripts(spark):
    df = spark.createDataFrame([("a", b"x", 1500), ("b", b"y", 0)], "doc_id string, content binary, duration_ms long")
    got = speech.transcribe(df, speech.FixedTranscriber("one two"), at_once=1)
    assert rows(got.select("doc_id", "status", "audio_duration", F.size("words").alias("n"))) == [("a", "completed", 1.5, 2), ("b", "completed", 0.0, 2)]
    parsed = readers.parse_words(got.select("doc_id", F.to_json(F.struct(*(c for c in got.columns if c != "doc_id"))).alias("j")), "j")
    assert rows(parsed.select("doc_id", "format", "valid")) == [("a", "service", True), ("b", "service", True)]
    assert {r.status for r in speech.transcribe(df, Silent()).collect()} == {"error"}
