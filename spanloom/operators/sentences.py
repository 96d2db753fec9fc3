"""Sentences of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_quotes

#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr vs etc inc ltd co corp dept est fig gen gov hon lt maj messrs mlle mme mt no op ord p pp rev st "
    "u.s u.s.a u.k a.m p.m e.g i.e viz approx appt"
).split()

_GUARD = "|".join(a.replace(".", r"\.") for a in sorted(ABBREVIATIONS, key=len, reverse=True))
#: An end mark and the white space behind it, unless the mark is an abbreviation's dot; looks back from marks only.
_END = rf"([.!?])(?<!(?<![\p{{L}}\p{{N}}_])(?i:{_GUARD})\.)\s+"
#: White space that isn't a single blank.
_SPACES = r"\s\s+|[\t\n\x0B\f\r]"


def split_sentences(text: Column, quotes: bool = False) -> Column:
    """Sentences as an array. A sentence ends at . ! or ? before white space, but not after an abbreviation.

    Straight quotes go unless quotes is set; three dots never end a sentence; white space collapses; a sentence without
    an end mark gets a dot. A trained splitter would differ in places; the rule is plain and repeatable.
    """
    x = F.coalesce(text, F.lit(""))
    if not quotes:
        x = strip_quotes(x)
    x = F.replace(x, F.lit("..."), F.lit(" <ELLIPSIS> "))
    x = F.regexp_replace(x, _END, "$1\x01")
    cleaned = F.transform(F.split(x, "\x01"), lambda s: F.trim(F.replace(F.regexp_replace(s, _SPACES, " "), F.lit("<ELLIPSIS>"), F.lit("..."))))
    return F.transform(F.filter(cleaned, lambda s: s != ""), lambda s: F.when(F.substring(s, -1, 1).isin(".", "!", "?"), s).otherwise(F.concat(s, F.lit("."))))


def explode_sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", quotes: bool = False) -> DataFrame:
    """(id, idx, sentence), idx from 1."""
    return docs.select(id_col, F.posexplode(split_sentences(F.col(text), quotes)).alias("pos", "sentence")).select(id_col, (F.col("pos") + 1).alias("idx"), "sentence")


def split_at_marks(text: str) -> list[str]:
    """The older rule, for comparison: every . ! or ? ends a sentence unless an abbreviation stands before it or a small letter follows."""
    out, start = [], 0
    for at, c in enumerate(text):
        if c not in ".!?":
            continue
        before = text[:at].lower().split()
        ends = at >= len(text) - 1 or not before or (before[-1].rstrip(".") not in ABBREVIATIONS and not text[at + 1].islower())
        if ends:
            out.append(text[start : at + 1].strip())
            start = at + 1
    out.append(text[start:].strip())
    return [s for s in out if s]
