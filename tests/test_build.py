import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import audio, compare, external, merge, report, schedule, words
from spanloom.plans import config
from spanloom.plans.build import build
from spanloom.sources import readers, writers


def spans_of(spark, data):
    return spark.createDataFrame(data, "doc_id long, idx int, text string, start_ms long, end_ms long, status string, score double, note string, method string")


def test_time_line(spark):
    plain = config.load(tempo=1.0)
    df = spark.createDataFrame([(1, 1, 0, 4499), (1, 2, 0, 6200), (2, 1, None, None), (2, 2, 100, 100)], "doc_id long, idx int, start_ms long, end_ms long")
    blocks = schedule.with_blocks(schedule.aligned_only(df), plain)
    got = {(r.doc_id, r.idx): r for r in blocks.collect()}
    assert got[1, 1].block_end == 3 * 4499 + 2 * 10000 + 10000 and got[1, 1].num_repeats == 3
    assert got[1, 2].block_end - got[1, 2].block_start == 81000 and got[1, 2].num_repeats == 5
    assert got[2, 2].audio_idx == 1 and got[2, 2].clip_ms == 0
    starts = [r.read_start_ms for r in schedule.reads(blocks, plain).where("doc_id = 1 and idx = 2").orderBy("rep").collect()]
    assert [s - got[1, 2].block_start for s in starts] == [0, 16200, 32400, 48600, 64800]


@pytest.mark.parametrize(("threshold", "short", "long", "seconds", "repeats"), [(4.5, 3, 5, [2.5, 3.8, 4.2, 4.5, 5.8, 7.2, 1.5, 8.9], [3, 3, 3, 5, 5, 5, 3, 5]), (3.0, 2, 4, [0.8, 2.1, 3.0, 4.5], [2, 2, 4, 4])])
def test_repeats(spark, threshold, short, long, seconds, repeats):
    own = config.load(dynamic_repetitions={"threshold_seconds": threshold, "short_chunk_repeats": short, "long_chunk_repeats": long})
    df = spark.createDataFrame([(1, i, 0, int(s * 1000)) for i, s in enumerate(seconds)], "doc_id long, idx int, start_ms long, end_ms long")
    assert [r.num_repeats for r in schedule.with_repeats(df, own).orderBy("idx").collect()] == repeats
    fixed = config.load(dynamic_repetitions={"enabled": False}, repeats=7)
    assert {r.num_repeats for r in schedule.with_repeats(df, fixed).collect()} == {7}


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("tempo: 0.9\nalignment: {min_accept: 0.82, weights: {token_sim: 1}}\nunknown: 1\n")
    with pytest.warns(UserWarning, match="no effect"):
        own = config.load(str(tmp_path / "c.yaml"), pause_ms=5)
    assert (own.tempo, own.pause_ms, own.alignment.min_accept, own.alignment.warn_accept) == (0.9, 5, 0.82, 0.78)
    assert config.load(inter_sentence_pause_ms=None, pause_ms=7).after_sentence_ms == 7


def test_overrides(spark):
    df = spark.createDataFrame([(1, 1, 5, 6), (1, 2, None, None), (2, 1, 1, 2)], "doc_id long, idx int, start_ms long, end_ms long")
    over = spark.createDataFrame([(1, 2, 1, 10, 20), (1, 2, 2, 30, 40), (9, 9, 1, 0, 0)], "doc_id long, sentence_idx int, seq int, start_ms long, end_ms long")
    assert rows(schedule.apply_overrides(df, over)) == [(1, 1, 5, 6, False), (1, 2, 30, 40, True), (2, 1, 1, 2, False)]


def words_of(text, step=100):
    return [(w, i * step, i * step + 90) for i, w in enumerate(text.split())]


TEXTS = [("a", "Remarkable water flows downhill. The icebreaker doesn’t stop."), ("b", "Nothing here matches anything."), ("c", "")]


def frames(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id string, text string")
    spoken = [("a", words_of("remarkable water flows downhill the ice breaker does not stop")), ("b", words_of("quite other words")), ("c", words_of("x"))]
    return texts, spark.createDataFrame(spoken, "doc_id string, words array<struct<text:string,start:bigint,end:bigint>>")


class Flaky:
    """Finds a sentence with water only, at its second call."""

    def __init__(self):
        self.calls = 0

    def align(self, sentence, words):
        self.calls += 1
        if self.calls % 2:
            raise TimeoutError
        return (50, 390, 0.8) if "water" in sentence else None


@pytest.mark.parametrize("method", ["fuzzy", "external", "hybrid"])
def test_build(spark, tmp_path, method):
    own = config.load(alignment={"method": method, "min_accept": 0.82, "warn_accept": 0.3}, external={"retry_delay": 0.0, "max_workers": 1})
    texts, transcripts = frames(spark)
    over = spark.createDataFrame([("b", 1, 1, 7, 4007)], "doc_id string, sentence_idx int, seq int, start_ms long, end_ms long")
    sound = np.arange(44100 * 5, dtype="<i2")
    recordings = spark.createDataFrame([("a", audio.wav_bytes([sound], 44100)), ("b", audio.wav_bytes([sound], 44100))], "doc_id string, content binary")
    made = build(texts, transcripts, own, Flaky() if method != "fuzzy" else None, over, recordings)
    spans = {(r.doc_id, r.idx): r for r in made.spans.collect()}
    assert spans["b", 1].start_ms == 7 and spans["b", 1].adjusted
    assert spans["a", 1].method == ("fuzzy" if method == "fuzzy" else "external")
    assert spans["a", 2].method == (None if method == "external" else "fuzzy")
    totals = {r.doc_id: json.loads(r.r) for r in made.reports.select("doc_id", F.to_json("report").alias("r")).collect()}
    assert totals["a"]["global"]["num_sentences"] == 2
    writers.write_manifests(made.manifests, made.reports, str(tmp_path / "out"))
    done = {r.doc_id: (r.n_sentences, r.n_aligned) for r in readers.aligned_in_manifests(spark, str(tmp_path / "out/manifests")).collect()}
    assert done["a"] == (2, 1 if method == "external" else 2) and done["b"] == (1, 1) and "c" not in done
    ends = {r.doc_id: r.e for r in made.blocks.groupBy("doc_id").agg(F.max("block_end").alias("e")).collect()}
    sounds = {r.doc_id: audio.wav_info(bytes(r.wav)) for r in made.sounds.collect()}
    for doc, (ms, rate, channels) in sounds.items():
        assert (rate, channels) == (44100, 1) and abs(ms - ends[doc]) < 5
    assert made.review.count() == 3 and made.summaries.count() == 2


def test_missing_provider(spark):
    with pytest.raises(ValueError, match="provider"):
        build(*frames(spark), config.load(alignment={"method": "external"}))
    with pytest.warns(UserWarning, match="fuzzy search alone"):
        made = build(*frames(spark), config.load(alignment={"min_accept": 0.82, "warn_accept": 0.3}))
    assert {r.method for r in made.spans.collect()} == {"fuzzy", None}


def test_documents_without_words_are_reported(spark):
    texts, transcripts = frames(spark)
    more = transcripts.where("doc_id <> 'b'").unionByName(spark.createDataFrame([("d", words_of("alone"))], transcripts.schema))
    made = build(texts, more, config.load(alignment={"method": "fuzzy"}))
    assert rows(made.inputs) == [("a", "ok"), ("b", "no words"), ("c", "no sentences"), ("d", "no text")]
    counted = {r.doc_id: (r.n, r.a) for r in made.reports.select("doc_id", F.col("report.global.num_sentences").alias("n"), F.col("report.global.aligned").alias("a")).collect()}
    assert counted["b"] == (1, 0) and "d" not in counted


def test_words_in_compatibility_form(spark):
    df = spark.createDataFrame([(1, [("ﬁve", 0, 1), ("½", 1, 2), ("Ⅳ", 2, 3)])], "doc_id long, words array<struct<text:string,start:bigint,end:bigint>>")
    assert [r.norm for r in words.explode_words(df).orderBy("pos").collect()] == ["five", "1 2", "iv"]


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.txt").write_text("One ½.\nTwo.")
    assert rows(readers.read_texts(spark, str(tmp_path / "t"))) == [("x", "One 1⁄2.\nTwo.")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/s.json").write_text('{"audio_id": "A", "sr_hz": 16000,\n "words": [{"text": "a", "start": 0, "end": 5, "other": 1}]}')
    (tmp_path / "w/v.json").write_text('{"id": "B", "language_code": "en", "words": [{"text": "a", "start": 0, "end": 5, "speaker": "S"}]}')
    got = rows(readers.read_words(spark, str(tmp_path / "w")).select("doc_id", "format", "audio_id", "valid"))
    assert got == [("s", "spec", "A", True), ("v", "service", "B", True)]
    (tmp_path / "w/e.json").write_text('{"words": []}')
    (tmp_path / "w/m.json").write_text('{"words": [{"text": "a", "start": 0}]}')
    (tmp_path / "w/z.json").write_text("no json")
    bad = readers.read_words(spark, str(tmp_path / "w"), strict=False).where("not valid")
    assert [r.doc_id for r in bad.orderBy("doc_id").collect()] == ["e", "m", "z"]
    with pytest.raises(Exception, match="no usable words"):
        readers.read_words(spark, str(tmp_path / "w")).collect()
    with pytest.raises(Exception, match="no usable words"):  # in a plan that never looks at `valid`
        readers.read_words(spark, str(tmp_path / "w")).select("doc_id", F.size("words")).collect()
    (tmp_path / "r").mkdir()
    (tmp_path / "r/n.wav").write_bytes(audio.wav_bytes([audio.silence(1234, 8000)], 8000))
    (tmp_path / "r/o.wav").write_bytes(b"none")
    assert rows(readers.read_recordings(spark, str(tmp_path / "r")).drop("content")) == [("n", 1234, 8000, 1), ("o", 0, 44100, 1)]
    writers.write_json(spark.createDataFrame([("d", 1, 1, 2, 3)], readers.OVERRIDES), str(tmp_path / "ov"))
    assert rows(readers.read_overrides(spark, str(tmp_path / "ov"))) == [("d", 1, 1, 2, 3)]


def test_sound():
    sound = np.full(8000, 1000, dtype="<i2")
    clip = audio.cut(sound, 8000, -50, 100, 8)
    assert len(clip) == 800 and clip[0] == 0 and clip[400] == 1000 and len(audio.cut(sound, 8000, 10, 5)) == 8
    assert len(audio.stretch(sound, 0.8)) == 10000 and abs(int(audio.stretch(sound, 0.8)[5000]) - 1000) < 5
    with pytest.raises(ValueError, match="tempo"):
        audio.stretch(sound, 3)


def test_comparison_and_review(spark):
    a = spans_of(spark, [(1, 1, "x", 0, 100, "ok", 0.9, "", "fuzzy"), (1, 2, "x", None, None, "failed", 0.0, "", None), (1, 3, "x", 0, 100, "fallback", 0.8, "", "fuzzy"), (1, 4, "x", None, None, "failed", 0.0, "", None), (1, 5, "x", 5, 9, "warning", 0.8, "", "fuzzy")])
    b = a.select("doc_id", "idx", (F.col("start_ms") + F.when(F.col("idx") == 1, 501).otherwise(500)).alias("start_ms"), "end_ms").withColumns(
        {"start_ms": F.when(F.col("idx") == 2, 1).when(F.col("idx") == 5, None).otherwise(F.col("start_ms")), "end_ms": F.when(F.col("idx") == 2, 2).when(F.col("idx") == 5, None).otherwise(F.col("end_ms"))}
    )
    got = rows(compare.compare_methods(a, b))
    assert got == [(1, 1, "timestamp_diff", 501), (1, 2, "external_only", None), (1, 4, "both_failed", None), (1, 5, "fuzzy_only", None)]
    queue = compare.review_queue(a, merge.details(a, "fuzzy"))
    assert rows(queue.select("idx", "badge", "priority")) == [(1, "good", 2), (2, "failed", 2), (3, "good", 2), (4, "failed", 2), (5, "warning", 1)]
    assert compare.review_queue(a, merge.details(a, "fuzzy"), "issues").count() == 4
    assert [r.idx for r in compare.first_issues(queue, 2).collect()] == [5, 1]


def test_vocabulary_matches(spark):
    from spanloom.functions.similarity import ratio

    tokens = ["onanre", "onantre", "ballards", "ballard's", "cat", "cats", "a" * 30, "a" * 28, "b" * 14 + "c" * 16, "b" * 13 + "c" * 15, "xyz" * 9, "xyz" * 9 + "x", "x"]
    got = rows(words.vocabulary_matches(spark.createDataFrame([(t,) for t in tokens], "token string")).select("a", "b"))
    assert set(got) == {(a, b) for a in tokens for b in tokens if a < b and ratio(a, b) >= 92} and len(got) == len(set(got))


def test_external_bounds():
    assert [external.valid_reply(*r) for r in [(0, 5, 0.9), (9, 5, 0.5), (-1, 5, 0.9), (0, 5, 1.5)]] == [True, True, False, False]
    assert '"text":"a"' in external.prompt("A.", [{"text": "a", "start": 0, "end": 1}])


def test_results_and_comparison(spark):
    a = spans_of(spark, [(1, 2, "y", None, None, "failed", 0.0, "no", None), (1, 1, "x", 0, 100, "ok", 0.9, "", "fuzzy")])
    b = spans_of(spark, [(1, 1, "x", 5, 105, "ok", 0.9, "", "external"), (1, 2, "y", 200, 300, "ok", 0.9, "", "external")])
    reported = lambda spans: report.reports(report.counts(spans, merge.details(spans, "fuzzy")), merge.details(spans, "fuzzy"))
    made = report.comparison({"fuzzy_matching": (a, reported(a), 1.5), "external_alignment": (b, reported(b), 2)})
    got = json.loads(made.select(F.to_json("comparison", {"ignoreNullFields": "false"})).first()[0])
    assert got["sentences"] == ["x", "y"] and got["fuzzy_matching"]["spans"] == [{"start": 0, "end": 100}, None] and got["fuzzy_matching"]["duration_seconds"] == 1.5
    assert got["external_alignment"]["spans"][1] == {"start": 200, "end": 300} and got["fuzzy_matching"]["report"]["global"]["unaligned"] == 1
    one = json.loads(report.results(a, reported(a)).select(F.to_json("result", {"ignoreNullFields": "false"})).first()[0])
    assert one["sentences"] == [{"idx": 1, "text": "x", "span_ms": {"start": 0, "end": 100}}, {"idx": 2, "text": "y", "span_ms": None}] and one["report"]["details"][0]["status"] == "failed"


def test_summary_text(spark):
    a = spans_of(spark, [(1, 1, "x" * 70, 0, 100, "warning", 0.8, "", "fuzzy"), (1, 2, "y", None, None, "failed", None, "no", None), (2, 1, "z", 0, 9, "ok", 0.9, "", "fuzzy")])
    details = merge.details(a, "fuzzy")
    got = {r.doc_id: r.summary for r in report.summary_text(report.counts(a, details), details).collect()}
    assert got[1] == (
        "Alignment Summary:\n  Total sentences: 2\n  Successfully aligned: 1 (50.0%)\n  Failed to align: 1\n  Warnings: 1\n\nAlignment Methods:\n  External: 0\n  Fuzzy matching: 1"
        f"\n\nIssues:\n  [1] warning (score: 0.80, method: fuzzy) - {'x' * 60}...\n  [2] failed (score: 0.00, method: fuzzy) - y"
    )
    assert "Issues" not in got[2]
