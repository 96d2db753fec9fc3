import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.functions.numbers import match_keys, same_number
from spanloom.functions.similarity import tokens_match
from spanloom.operators import compound

PARTS = "ice breaker deep sea un remark able km kilometers kilo metres doesn't does not 6000 six thousand 6,000 19 12 1912 nineteen twelve 1 7 a b wonder ful x² ½ s . don t water's".split()


def odd_tokens(rng, n):
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    letters = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 45))) for _ in range(n // 4)]
    return [*made, *letters, *(t[: len(t) // 2] + rng.choice(["", "x"]) + t[len(t) // 2 + 1 :] for t in [*made, *letters]), "", "km", "kms", "kilometers", "Kilometers", "a" * 60, "a" * 62, "can't", "cant", "cannot", "can not", None]


def test_number_keys():
    rng = random.Random(1)
    tokens = [t for t in odd_tokens(rng, 60) if t is not None]
    for a in tokens:
        for b in tokens:
            assert same_number(a, b) == (not match_keys(a).isdisjoint(match_keys(b))), (a, b)


@pytest.mark.parametrize("cutoff", [92.0, 88.0])
def test_pairs_against_brute_force(spark, cutoff):
    rng = random.Random(int(cutoff))
    left, right = [(i % 2, t) for i, t in enumerate(odd_tokens(rng, 60))], [(i % 2, t) for i, t in enumerate(odd_tokens(rng, 80))]
    frame = lambda data: spark.createDataFrame(data, "doc_id long, token string").withColumn("key", F.lit("clash"))
    got = rows(compound.match_pairs(frame(left), frame(right + right[:9]), cutoff))
    want = {(i, a, b) for i, a in left for j, b in right if i == j and None not in (a, b) and tokens_match(a, b, cutoff)}
    assert set(got) == want and len(got) == len(want)
    assert {t for t in want if t[1] == "km"} and ("kilometers", "km") not in {t[1:] for t in want}  # units in one direction only


def test_compound_matches(spark):
    stream = "the ice breaker went un remark ably down 19 12 kilo metres".split()
    runs = [(1, i, "".join(stream[i : i + 2]) if i + 2 <= len(stream) else None, "".join(stream[i : i + 3]) if i + 3 <= len(stream) else None) for i in range(len(stream))]
    tokens = spark.createDataFrame([(1, "icebreaker"), (1, "icebreaker"), (1, "unremarkably"), (1, "kilometres"), (1, "19-12"), (1, "went"), (2, "icebreaker"), (1, None)], "doc_id long, token string")
    got = rows(compound.compound_matches(tokens, spark.createDataFrame(runs, "doc_id long, pos int, two string, three string")))
    # of numbers only the digits count: "down1912" and "1912kilo" match too
    assert got == [(1, "19-12", 7, 3), (1, "19-12", 8, 2), (1, "19-12", 8, 3), (1, "icebreaker", 1, 2), (1, "kilometres", 10, 2), (1, "unremarkably", 4, 3)]


def test_texts_are_dealt_out_once(spark):
    """Runs and what is left of them aren't shuffled: one exchange, of texts, no join and nothing exploded before it."""
    from spanloom import queries

    plan = queries.compound_matches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Generate" not in plan


def test_text_compounds(spark):
    rng = random.Random(3)
    texts = [(i % 7, " ".join(t for t in odd_tokens(rng, 12) if t)) for i in range(7)] + [(7, None), (8, ""), (9, "wonderful"), (None, "ice breaker icebreaker"), (10, "Icebreakers saw ice breakers. Un-remarkable un remark able kilometer kilo metres nineteentwelve 19 12 1912000000 1,912")]
    # an id's two texts share their tokens, but no run passes from one to the other
    texts += [(11, "the icebreaker ice"), (11, "breaker deep ice breaker")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = rows(compound.text_compounds(docs))
    split = [(r.doc_id, r.t) for r in docs.select("doc_id", compound.tokens(F.col("text")).alias("t")).collect()]
    want = [
        (i, token, pos, size)
        for i, words in split
        if i is not None
        for token in {t for j, other in split if i == j for t in other if len(t) > 8}
        for size in (2, 3)
        for pos in range(len(words) - size + 1)
        if tokens_match(token, "".join(words[pos : pos + size]), 92.0)
    ]
    assert got == sorted(want, key=repr) and {(10, "icebreakers", 2, 2), (10, "kilometer", 9, 2), (11, "icebreaker", 2, 2)} <= set(got) and (11, "icebreaker", 0, 2) not in got


def test_matches_in_parts(monkeypatch):
    """Runs and places are looked at in parts of any size."""
    rng = random.Random(5)
    made = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(150)]
    asked, runs = sorted({*made[:70], *(m[1:] for m in made[70:])}), sorted({*made[60:], *(m[:-1] for m in made[:60])})
    for cutoff in (50.0, 80.0, 92.0, 100.0, 101.0):
        want = {(a, b) for a in asked for b in runs if tokens_match(a, b, cutoff)}
        for runs_at_once, places in ((compound.RUNS, compound.PLACES), (7, 1), (1, 50)):
            monkeypatch.setattr(compound, "RUNS", runs_at_once)
            monkeypatch.setattr(compound, "PLACES", places)
            assert compound.matches(asked, runs, cutoff) == want
