"""Text functions as Columns: quotes, normal form, tokens, units, weights.

Patterns are written once, in the syntax that Java's and RE2's engines share, so the checking SQL can use the same.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters, digits and the underscore of any script.
WORD = r"[\p{L}\p{N}_]"

#: A hyphen or en dash between two words' letters. It starts with the mark itself, so only marks are looked at.
_INNER_HYPHEN = rf"[-–](?<={WORD}[-–])(?={WORD})"

#: Units and their full forms.
UNITS = {
    "km": "kilometers", "kilometer": "kilometers", "kilometres": "kilometers", "kilometre": "kilometers",
    "m": "meters", "meter": "meters", "metres": "meters", "metre": "meters",
    "cm": "centimeters", "centimeter": "centimeters", "centimetre": "centimeters",
    "ft": "feet", "foot": "feet", "mi": "miles", "mile": "miles",
    "lb": "pounds", "lbs": "pounds", "pound": "pounds", "kg": "kilograms", "kilogram": "kilograms",
    "g": "grams", "gram": "grams", "oz": "ounces", "ounce": "ounces", "in": "inches", "inch": "inches",
    "yd": "yards", "yard": "yards", "mph": "miles per hour", "kph": "kilometers per hour",
    "l": "liters", "liter": "liters", "litre": "liters", "ml": "milliliters",
}

#: Words of half weight.
LIGHT_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did "
    "will would could should may might must can this that these those i you he she it we they"
).split()

#: Words that are never anchors.
NEVER_ANCHORS = [*LIGHT_WORDS, "my", "your", "his", "her", "its", "our", "their"]

#: The two contractions that stay reachable once quotes are gone, and their long forms.
CONTRACTIONS = {"doesnt": "does not", "cannot": "can not"}


def strip_quotes(text: Column) -> Column:
    """text without straight quotes; typographic ones stay."""
    return F.translate(text, "\"'", "")


def nfkc(text: Column) -> Column:
    """Compatibility normal form, which has no built-in; ASCII texts pass through."""

    def form(texts):
        return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(form, T.StringType())(text)


def normalize(text: Column) -> Column:
    """Lower-cased words with inner apostrophes, one blank between them. text is in compatibility normal form (see nfkc)."""
    x = F.lower(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(x, _INNER_HYPHEN, "")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_'\s]", " ")
    x = F.regexp_replace(x, r"\s'\s", " ")
    x = F.regexp_replace(x, r"^'\s", "")
    x = F.regexp_replace(x, r"\s'$", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def tokens(text: Column) -> Column:
    """The words of normalize(text), from their first letter or digit on.

    Of the normal form only lower case and joined hyphens can change a word: all else it touches stands between words.
    """
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _INNER_HYPHEN, "")
    return F.regexp_extract_all(x, F.lit(f"{WORD}[\\p{{L}}\\p{{N}}_']*"), F.lit(0))


def normalize_unit(token: Column) -> Column:
    """A unit's full form; all trailing s and dots are dropped for the lookup. Other tokens stay as they are."""
    full = F.create_map(*map(F.lit, chain.from_iterable(UNITS.items())))
    return F.coalesce(F.try_element_at(full, F.rtrim(F.lower(token), F.lit("s."))), token)


def contraction_key(token: Column) -> Column:
    """The long form of a reachable contraction, else the token."""
    long = F.create_map(*map(F.lit, chain.from_iterable(CONTRACTIONS.items())))
    return F.coalesce(F.try_element_at(long, F.replace(F.lower(token), F.lit("'"), F.lit(""))), token)


def token_weight(token: Column) -> Column:
    return F.when(F.lower(token).isin(LIGHT_WORDS), 0.5).when(token.rlike(r"^\p{Nd}"), 1.25).otherwise(1.0)


def explode_tokens(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, pos, token), pos from 0."""
    return docs.select(id_col, F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def running_sums(values: Column, block: int = 128) -> Column:
    """For an array of n whole numbers 0 and the n sums up to each. Sums are made in blocks, so an array isn't copied for each of its values."""
    none = F.array(F.lit(0).cast("long"))
    within = lambda part: F.slice(F.aggregate(part, none, lambda out, v: F.concat(out, F.array(F.element_at(out, -1) + v))), 2, block)
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(block))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(starts, none, lambda out, start: F.concat(out, F.transform(within(F.slice(values, start, block)), lambda v: v + F.element_at(out, -1))))


# the same functions for single strings, for code that runs inside a group


_HYPHEN, _TOKEN = re.compile(r"(?<=\w)-(?=\w)"), re.compile(r"\w[\w']*")
_BLANKS = [(re.compile(p), " ") for p in (r"[^\w'\s]", r"\s'\s", r"^'\s", r"\s'$", r"\s+")]


def _lower(text: str) -> str:
    """text in compatibility normal form and small letters, without dashes and hyphens between letters."""
    x = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower().replace("—", " ").replace("–", "-")
    return _HYPHEN.sub("", x) if "-" in x else x


def normalize_text(text: str) -> str:
    x = _lower(text or "")
    if x.isalpha():
        return x
    for pattern, new in _BLANKS:
        x = pattern.sub(new, x)
    return x.strip()


def token_list(text: str) -> list[str]:
    """The words of normalize_text(text), from their first letter or digit on; all else that it changes stands between words."""
    return _TOKEN.findall(_lower(text or ""))


def unit_of(token: str) -> str:
    return UNITS.get(token.lower().rstrip("s."), token)


_LIGHT = frozenset(LIGHT_WORDS)


@lru_cache(maxsize=1 << 17)
def weight_of(token: str) -> float:
    if token.lower() in _LIGHT:
        return 0.5
    return 1.25 if re.match(r"\d", token) else 1.0
