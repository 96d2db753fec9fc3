"""Quality rules: a threshold table compiled into one Spark projection, evaluated without user functions.

Defined results: a null or empty text has no words and fails the length rule; a very long text is judged whole and, over
1,000,000 words, fails the rule for most words; an empty table gives no rows; repeated rows are judged
each for itself; extra columns are carried along, and columns named like a metric are replaced.
Words are the runs of characters that are not in [\\x20\\x09-\\x0D]; lines are the parts between \\n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, without_spaces

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to in is that it for was on with as at by this be are "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine "
    "le la les de des et en un une du que qui dans pour par sur au est "
    "el los las y en del se por con para su al lo como que una"
).split()


@dataclass(frozen=True)
class Rule:
    """metric * scale must lie in [low * base, high * base]; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    base: str | None = None
    scale: int = 1


#: The base rules of the contract: at least 50 words, at most half of them in repeated 3-word windows.
BASE_RULES = (
    Rule("length", "n_words", low=50),
    Rule("repeats", "n_repeat_words", high=50, base="n_words", scale=100),
)

#: The further rules: ratios of symbols, word lengths, stop words and repeated lines.
METHOD_RULES = (
    Rule("most_words", "n_words", high=1_000_000),
    Rule("symbol_ratio", "n_symbols", high=10, base="n_words", scale=100),
    Rule("mean_word_length", "word_chars", low=2, high=15, base="n_words"),
    Rule("dup_line_ratio", "n_dup_lines", high=50, base="n_lines", scale=100),
    Rule("stop_words", "n_stop_words", low=2),
)

_REPEATS = """
element_at(transform(array({w}), w -> if(size(w) < 3, 0L,
  element_at(transform(array(sort_array(slice(arrays_zip(slice(w, 1, size(w)), slice(w, 2, size(w)),
      slice(w, 3, size(w)), sequence(0, size(w) - 1)), 1, size(w) - 2))), s ->
    element_at(transform(array(sort_array(transform(filter(s, (x, i) ->
        coalesce(x.`0` = get(s, i - 1).`0` and x.`1` = get(s, i - 1).`1` and x.`2` = get(s, i - 1).`2`, false)
        or coalesce(x.`0` = get(s, i + 1).`0` and x.`1` = get(s, i + 1).`1` and x.`2` = get(s, i + 1).`2`, false)),
      x -> x.`3`))), p -> if(size(p) = 0, 0L,
        aggregate(zip_with(slice(p, 2, size(p)), slice(p, 1, size(p) - 1), (b, a) -> least(3, b - a)),
          3L, (n, d) -> n + d))), 1)), 1))), 1)
"""


def quality_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words (long)."""
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
    keep = [c for c in docs.columns if c not in names]
    body = F.coalesce(F.col(text), F.lit(""))
    blank = f"[{SPACES}]+"
    base = docs.select(
        *keep,
        F.array_remove(F.split(body, blank, -1), "").alias("_words"),
        # a line counts if it has a word
        F.filter(F.split(body, "\n", -1), lambda line: F.trim(line, F.lit(SPACES)) != "").alias("_lines"),
        F.length(without_spaces(body)).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return base.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATS.format(w="_words")).alias("n_repeat_words"),
        F.size(F.array_intersect(F.split(F.lower(F.array_join("_words", " ")), " "), F.array(*map(F.lit, sorted(set(STOP_WORDS)))))).cast("long").alias("n_stop_words"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """True where every rule holds; metrics are whole numbers, so ratios are compared without division."""
    holds = F.lit(True)
    for rule in rules:
        value, base = F.col(rule.metric) * rule.scale, F.col(rule.base) if rule.base else F.lit(1)
        if rule.low is not None:
            holds = holds & (value >= base * F.lit(rule.low))
        if rule.high is not None:
            holds = holds & (value <= base * F.lit(rule.high))
    return holds


def quality_rules(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES, more: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """quality_metrics() with base_failed (a base rule is broken) and kept (no rule is broken)."""
    judged = quality_metrics(docs.drop("base_failed", "kept"), text)
    failed = ~compile_rules(base)
    return judged.withColumns({"base_failed": failed, "kept": ~failed & compile_rules(more)})
