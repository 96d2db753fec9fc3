import pytest
from pyspark.sql import functions as F

from spanloom.functions import numbers, similarity, text, timecode
from spanloom.operators.sentences import split_at_marks, split_sentences

NORMAL = [
    ("re-enter", "reenter", ["reenter"]),
    ("a-b-c-d", "abcd", ["abcd"]),
    ("Titanic’s", "titanic s", ["titanic", "s"]),
    ("child's", "child's", ["child's"]),
    ("' hi '", "hi", ["hi"]),
    ("'tis", "'tis", ["tis"]),
    ("U.S.", "u s", ["u", "s"]),
    ("6,000", "6 000", ["6", "000"]),
    ("½ cup", "1 2 cup", ["1", "2", "cup"]),
    ("x² y", "x2 y", ["x2", "y"]),
    ("Ⅳ", "iv", ["iv"]),
    ("deep-sea—robot 10–12", "deepsea robot 1012", ["deepsea", "robot", "1012"]),
    ("snake_case", "snake_case", ["snake_case"]),
    ("''", "''", []),
    ("...", "", []),
    ("a--b c-–d e–f", "a b c d ef", ["a", "b", "c", "d", "ef"]),
    ("rock 'n' roll' - 'x", "rock 'n' roll' 'x", ["rock", "n'", "roll'", "x"]),
    (None, "", []),
    ("", "", []),
]


def test_normal_forms(spark):
    df = spark.createDataFrame([(x,) for x, _, _ in NORMAL], "x string").withColumn("x", text.nfkc(F.col("x")))
    got = df.select(text.normalize(F.col("x")), text.tokens(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(n, t) for _, n, t in NORMAL]
    assert [(text.normalize_text(x), text.token_list(x)) for x, _, _ in NORMAL] == [(n, t) for _, n, t in NORMAL]


RATIOS = [("doesnt", "doesn't", 92.3077), ("dont", "don't", 88.8889), ("its", "it's", 85.7143), ("im", "i'm", 80.0), ("ballards", "ballard's", 94.1176), ("6000", "6 000", 88.8889), ("kilometers", "kilometres", 90.0), ("four", "4", 0.0), ("", "", 100.0), ("a", "", 0.0)]


def test_ratio(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in RATIOS], "a string, b string")
    got = [r[0] for r in df.select(similarity.indel_ratio(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 4) for x in got] == [r for _, _, r in RATIOS]
    assert [round(similarity.ratio(a, b), 4) for a, b, _ in RATIOS] == [r for _, _, r in RATIOS]


def test_match():
    match = similarity.tokens_match
    assert match("6000", "6 000", 92) and match("four", "4", 92) and match("third", "3rd", 92) and match("nineteen twelve", "1912", 92)
    assert match("kilometres", "kilometers", 92) and not match("kilometers", "kilometres", 92)
    assert match("km", "kilometers", 92) and not match("kilometers", "km", 92)
    assert match("deep-sea", "deep sea", 100) and not match("cat", "dog", 88) and match("a1", "b1", 100)


def test_numbers():
    assert numbers.cardinal(1912) == "one thousand, nine hundred and twelve"
    assert [numbers.cardinal(n) for n in (0, 21, 100, 105, 1000, 1001, 1100, 1_000_000)] == ["zero", "twenty-one", "one hundred", "one hundred and five", "one thousand", "one thousand and one", "one thousand, one hundred", "one million"]
    assert [numbers.ordinal(n) for n in (1, 3, 12, 20, 21, 100)] == ["first", "third", "twelfth", "twentieth", "twenty-first", "one hundredth"]
    assert numbers.spoken_forms(1912)[3] == "nineteen twelve" and numbers.spoken_forms(2000)[3] == "twenty hundred"
    assert numbers.spoken_tokens(["3", "cats", "1,000"]) == ["three", "cats", "one thousand"]


def test_units(spark):
    df = spark.createDataFrame([("kms.",), ("in",), ("inches",), ("ms",), ("Cat",), ("cannot",)], "t string")
    got = df.select(text.normalize_unit(F.col("t")), text.contraction_key(F.col("t"))).collect()
    assert [r[0] for r in got] == ["kilometers", "inches", "inches", "meters", "Cat", "cannot"]
    assert got[-1][1] == "can not"


def test_sentences(spark):
    cases = {
        'He said "Hi." Then left': ["He said Hi.", "Then left."],
        "Mr. Smith met Dr. Jones. They spoke!": ["Mr. Smith met Dr. Jones.", "They spoke!"],
        "Wait... what? Yes": ["Wait ... what?", "Yes."],
        "Mr. mrs. dr. X. Y": ["Mr. mrs. dr. X.", "Y."],
        "E.g.  this, i.e. U.S. law. Form. Firm!  So,\tetc.? Yes": ["E.g. this, i.e. U.S. law.", "Form.", "Firm!", "So, etc.?", "Yes."],
        "  ": [],
        "": [],
        "It’s 3.5 m. Good": ["It’s 3.5 m.", "Good."],
    }
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    assert [r[0] for r in df.select(split_sentences(F.col("x"))).collect()] == list(cases.values())
    assert split_at_marks("One. two. Three.") == ["One.", "two.", "Three."]
    assert split_at_marks("Dr. Who is 3.x now!Yes") == ["Dr. Who is 3.x now!", "Yes"]


def test_times(spark):
    df = spark.createDataFrame([("00:01.001", 3_723_004), ("abc", 0), ("5", 999), ("01:02:03", 60_000), ("", 1)], "t string, ms long")
    got = df.select(timecode.parse_time(F.col("t")), timecode.hours_timestamp(F.col("ms")), timecode.minutes_timestamp(F.col("ms"))).collect()
    assert [r[0] for r in got] == [1000, 0, 5000, 62000, 0]
    assert tuple(got[0])[1:] == ("01:02:03.004", "62:03.004") and tuple(got[2])[1:] == ("00:00:00.999", "00:00.999")


@pytest.mark.parametrize(("name", "clean"), [("Lesson/2/Part1", "Lesson_2_Part1"), ("", "dictation_final"), ("a b", "a b"), (None, "dictation_final")])
def test_file_names(spark, name, clean):
    assert spark.createDataFrame([(name,)], "n string").select(timecode.file_name(F.col("n"))).first()[0] == clean


def test_sound_types(spark):
    df = spark.createDataFrame([(b"RIFFxx",), (b"fLaC",), (b"ID3",)], "c binary")
    assert [r[0] for r in df.select(timecode.sound_type(F.col("c"))).collect()] == ["audio/wav", "audio/flac", "audio/mpeg"]
