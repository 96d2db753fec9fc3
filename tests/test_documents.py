"""Work by document: no word is sorted or shuffled, and results hold for repeated ids."""

from collections import Counter

import pytest
from oracle import engine, same_rows

from spanloom.operators import merge, report, schedule, splitter, words
from spanloom.queries import ORACLE_SQL

TEXTS = [(1, "Plain elephants. Wonderful elephants arrived, 12 of them!"), (2, None), (3, ""), (4, "One " * 300 + "remarkable zebras. Zebras 7 again.")]


def steps(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return Counter({name: plan.count(name) for name in ("Window", "Exchange", "HashAggregate")})


def test_timeline_sorts_no_words(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    found = words.derived_words(df)
    assert steps(found)["Window"] == 0
    got = [(r.word, r.start_ms, r.end_ms) for r in found.where("doc_id = 4").orderBy("pos").collect()]
    at = 0
    for word, start, end in got:
        assert (start, end) == (at, at + 60 * len(word) + 40)
        at = end
    assert len(got) == 305 and {r.doc_id for r in found.collect()} == {1, 4}


@pytest.mark.parametrize("name", ["token_idf", "anchors_top3", "anchor_ranges"])
def test_repeated_ids_and_plans(spark, name):
    make = {"token_idf": words.token_idf, "anchors_top3": words.anchors, "anchor_ranges": words.anchor_ranges}[name]
    df = spark.createDataFrame([*TEXTS, (1, "Elephants again, plain. Second sentence stands here.")], "doc_id long, text string")
    found = make(df)
    assert steps(found) == Counter(Exchange=1)
    base = engine("/nowhere")
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", [tuple(r) for r in df.collect()])
    same_rows(found, base.sql(ORACLE_SQL[name]))


def test_own_manifest_is_the_general_one(spark):
    rows = [(1, 1, "a", 0, 900, "ok", 0.9), (1, 2, "b", None, None, "failed", 0.0), (1, 3, "c", 1000, 9000, "warning", 0.8), (1, 4, "d", 9000, 12345, "fallback", None)]
    rows += [(2, 1, "e", None, None, "empty", None), (2, 2, "f", 10, None, None, 0.5), (2, 3, "g", 10, 7000, None, 0.5), (3, 1, None, None, None, "failed", None)]
    spans = spark.createDataFrame(rows, "doc_id long, idx int, text string, start_ms long, end_ms long, status string, score double").selectExpr("*", "'why' note", "'fuzzy' method")
    blocks = schedule.with_blocks(schedule.aligned_only(spans))
    general = report.manifest_rows(spans, merge.details(spans, "fuzzy"), blocks, schedule.reads(blocks))
    own = report.own_manifest_rows(spans)
    assert sorted(own.collect(), key=repr) == sorted(general.collect(), key=repr)
    assert own.schema["entry"].dataType.simpleString() == general.schema["entry"].dataType.simpleString()
    assert own._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_training_takes_texts_apart_once(spark):
    df = spark.createDataFrame([(1, "Mr. Smith came. He saw mr. Smith. Then he left. The dog of Smith stayed."), (2, None), (3, "One two. Three")], "doc_id long, text string")
    learned = splitter.train(df)
    for table in (learned.abbreviations, learned.collocations, learned.starters, learned.cases):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Window" not in plan
    assert steps(splitter.marked_words(df))["Window"] == 0
    got = {r.type: (r.lower, r.inside) for r in learned.cases.collect()}
    assert got["smith"] == (False, True) and got["he"] == (True, False)
