"""Tokens that a speech recogniser took apart: a token against runs of two or three words of the stream, under the token match.

The token match is an OR of similarity, equal numbers, and equality without hyphens, of units or of long forms. It holds or not
within one document, so texts (or both sides' strings) are dealt out by id once and a task looks at one document at a time; only matches leave it.
Equalities are looked up by keys. Two strings reach a ratio of c percent if they differ by few enough letters: a token is cut into one piece more than
letters may differ, one of which stands whole in the run, near its own place. The first letters of the pieces are looked up among those at all places of all
runs, as whole numbers in arrays, so no token meets all runs; what has one
near the same place and letters enough in common is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import match_keys
from ..functions.similarity import contraction_of, ratio
from ..functions.text import CONTRACTIONS, tokens, unit_of
from .words import map_documents

#: Most letters of a piece that are looked up.
LETTERS = 4
#: Runs, and places that may match, that are in arrays at once.
RUNS, PLACES = 20_000, 250_000
#: Kinds of letters that are counted.
_KINDS = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def equal_keys(token: str, left: bool) -> set[str]:
    """Keys of the rules that are equalities; two tokens match by one if they share one. Units count only if the left token is an abbreviation, so its own unit isn't a key of its."""
    keys, plain, unit = match_keys(token), token.replace("-", "").replace(" ", ""), unit_of(token)
    if len(plain) > 3:
        keys.add(f"p:{plain}")
    if not left or unit != token:
        keys.add(f"u:{unit}")
    keys.add(f"c:{contraction_of(token)}")
    return keys


def _equal(asked: list[str], runs: list[str]) -> set[tuple[str, str]]:
    """(a, b) that share a key. A run of lower-case letters alone is its own key, unless units or long forms are asked for."""
    by_key: dict[str, list[str]] = {}
    for a in asked:
        for key in equal_keys(a, True):
            by_key.setdefault(key, []).append(a)
    plain = {key[2:] for key in by_key if key[0] in "npc"}
    other = any(key[0] == "u" or (key[0] == "c" and key[2:] in CONTRACTIONS.values()) for key in by_key)
    found = set()
    for b in runs:
        if other or b in plain or not b.isalpha() or b != b.lower():
            found.update((a, b) for key in equal_keys(b, False) if key in by_key for a in by_key[key])
    return found


def _common(total, cutoff: float):
    """The shortest common subsequence with which strings of so many letters in all reach the cutoff."""
    return np.ceil(cutoff * total / 200.0 - 1e-9).astype(np.int64)


@lru_cache(maxsize=1 << 12)
def _reach(m: int, cutoff: float) -> tuple[int, int, int]:
    """Least and greatest length of a string that may reach the cutoff with one of m letters, and by how many letters the two may differ then; -1 if none may."""
    n = np.arange(int(m * (200 - cutoff) / cutoff) + 2)
    common = _common(m + n, cutoff)
    n, edits = n[common <= np.minimum(m, n)], (m + n - 2 * common)[common <= np.minimum(m, n)]
    return (int(n[0]), int(n[-1]), int(edits.max())) if len(n) else (0, -1, -1)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters in a row, and where each word starts, with the end at last."""
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)), out=starts[1:])
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64), starts


def _grams(letters: np.ndarray, size: int) -> np.ndarray:
    """A number for the `size` letters from each place on; equal letters have equal numbers."""
    code = np.zeros(max(0, len(letters) - size + 1), dtype=np.uint64)
    for i in range(size):
        code = code * _MIX + letters[i : i + len(code)]
    return (code ^ (code >> np.uint64(29))) * _MIX


def _bags(letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each word has letters of each kind; bounds the common subsequence of two words."""
    sizes = np.diff(starts)
    kinds = np.repeat(np.arange(len(sizes)), sizes) * _KINDS + (letters % _KINDS).astype(np.int64)
    return np.bincount(kinds, minlength=len(sizes) * _KINDS).reshape(-1, _KINDS).astype(np.uint8 if sizes.max(initial=0) < 256 else np.int64)


def _alike(asked: list[str], runs: list[str], cutoff: float) -> Iterator[tuple[str, str]]:
    """(a, b) with a piece's first letters in common, near the same place, whose lengths and letters may reach the cutoff; some of them more than once."""
    groups: dict[int, list[tuple[str, int]]] = {}
    reaches = [_reach(len(a), cutoff) for a in asked]
    for a, (_, most, edits) in zip(asked, reaches, strict=True):
        if most >= 0:
            groups.setdefault(min(LETTERS, len(a) // (edits + 1)), []).append((a, edits + 1))
    least, most = min((r[0] for r in reaches if r[1] >= 0), default=0), max((r[1] for r in reaches), default=-1)
    runs = [b for b in runs if least <= len(b) <= most]
    for a, _ in groups.pop(0, ()):  # more letters may differ than it has
        yield from ((a, b) for b in runs)
    for size, group in groups.items():
        names = [a for a, _ in group]
        letters, starts = _letters(names)
        own = _bags(letters, starts)
        cuts = [(i, len(a) * k // n) for i, (a, n) in enumerate(group) for k in range(n)]
        owner, start = np.array(cuts, dtype=np.int64).T
        code = _grams(letters, size)[starts[owner] + start]
        order = np.argsort(code, kind="stable")
        code, owner, start, lengths = code[order], owner[order], start[order], np.diff(starts)
        known = np.zeros(1 << 16, dtype=bool)
        known[code >> np.uint64(48)] = True
        for first in range(0, len(runs), RUNS):
            part = runs[first : first + RUNS]
            letters, starts = _letters(part)
            bags = _bags(letters, starts)
            here = _grams(letters, size)
            at = np.flatnonzero(known[here >> np.uint64(48)])
            low, high = np.searchsorted(code, here[at], "left"), np.searchsorted(code, here[at], "right")
            at, low, count = at[low < high], low[low < high], (high - low)[low < high]
            run = np.searchsorted(starts, at, "right") - 1
            place = at - starts[run]
            n = starts[run + 1] - starts[run]
            ends = np.cumsum(count)
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PLACES, "right")))
                each = count[i:j]
                back = np.repeat(np.arange(i, j), each)
                which = np.arange(len(back)) - np.repeat(np.cumsum(each) - each, each) + low[back]
                token, m = owner[which], lengths[owner[which]]
                common = _common(m + n[back], cutoff)
                met = (common <= np.minimum(m, n[back])) & (place[back] + size <= n[back]) & (np.abs(place[back] - start[which]) <= m + n[back] - 2 * common)
                r, t = np.divmod(np.unique(run[back[met]] * len(names) + token[met]), len(names))
                enough = np.minimum(own[t], bags[r]).sum(axis=1, dtype=np.int64) >= _common(lengths[t] + np.diff(starts)[r], cutoff)
                yield from ((names[j], part[i]) for i, j in zip(r[enough].tolist(), t[enough].tolist(), strict=True))
                i = j


def matches(asked: list[str], runs: list[str], cutoff: float = 92.0) -> set[tuple[str, str]]:
    """(a, b): pairs of distinct strings of asked and of runs, in this order, that match as tokens."""
    if not asked or not runs:
        return set()
    if cutoff <= 0:
        return {(a, b) for a in asked for b in runs}
    found = _equal(asked, runs)
    return found.union(p for p in _alike(asked, runs, cutoff) if p not in found and ratio(*p) >= cutoff)


def match_pairs(left: DataFrame, right: DataFrame, cutoff: float = 92.0, id_col: str = "doc_id") -> DataFrame:
    """(id, a, b): pairs of a token of left (id, token) and one of right (id, token), of the same id, that match as (a, b); the order matters for units.

    Null tokens and ids match nothing; repeated rows count once. An id's tokens of one side are one row.
    """
    import pyarrow as pa

    sides = [side.where("token is not null").groupBy(id_col).agg(F.collect_set("token").alias(name)) for side, name in ((left, "_left"), (right, "_right"))]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pairs = list(matches(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), cutoff))
                ids = batch.column(0).take(pa.array([i] * len(pairs), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1))], names=[id_col, "a", "b"])

    return sides[0].join(sides[1], id_col).mapInArrow(run, f"`{id_col}` {left.schema[id_col].dataType.simpleString()}, a string, b string")


def is_asked(token: str, longer: int) -> bool:
    return "-" in token or len(token) > longer


def text_compounds(docs: DataFrame, cutoff: float = 92.0, id_col: str = "doc_id", text: str = "text", longer: int = 8) -> DataFrame:
    """compound_matches() of the texts' own tokens and words. One shuffle, of texts by id; a task looks at one document at a time.

    Null and empty texts have no words; a null id matches nothing. The texts of a repeated id share their tokens, but no run passes from one to another.
    """

    def work(texts):
        asked = {t for (words,) in texts for t in words if is_asked(t, longer)}
        if not asked:
            return []
        runs = []
        for (words,) in texts:
            two = list(map(add, words, words[1:]))
            runs.append((two, list(map(add, two, words[2:]))))
        by_bare: dict[str, list[str]] = {}
        for t in asked:
            by_bare.setdefault(t.replace("-", ""), []).append(t)
        found: dict[str, list[str]] = {}
        for bare, run in matches(list(by_bare), list(set().union(*(r for pair in runs for r in pair))), cutoff):
            found.setdefault(run, []).extend(by_bare[bare])
        return [(t, pos, size) for pair in runs for size, of in enumerate(pair, start=2) for pos, run in enumerate(of) if run in found for t in found[run]]

    return map_documents(docs.select(id_col, text).where(F.col(id_col).isNotNull()), id_col, [tokens(F.col(text)).alias("_tokens")], "token string, pos int, size int", work)


def compound_matches(tokens: DataFrame, stream: DataFrame, cutoff: float = 92.0, id_col: str = "doc_id", longer: int = 8) -> DataFrame:
    """(id, token, pos, size): where `size` words of the stream, 2 or 3, run together make up a token.

    tokens (id, token): those with a hyphen or of more than `longer` letters are looked at, without their hyphens. stream (id, pos, two, three): each
    place with the runs that begin there, null at the end of a document (see words.ngrams).
    """
    asked = tokens.select(id_col, "token").where(F.col("token").contains("-") | (F.length("token") > longer)).distinct().withColumn("bare", F.replace("token", F.lit("-"), F.lit("")))
    runs = stream.select(id_col, "pos", F.explode(F.array(F.struct(F.lit(2).alias("size"), F.col("two").alias("run")), F.struct(F.lit(3).alias("size"), F.col("three").alias("run")))).alias("r"))
    runs = runs.select(id_col, "pos", "r.size", "r.run").where("run is not null")
    pairs = match_pairs(asked.select(id_col, F.col("bare").alias("token")), runs.select(id_col, F.col("run").alias("token")), cutoff, id_col)
    found = asked.join(pairs.withColumnRenamed("a", "bare"), [id_col, "bare"]).withColumnRenamed("b", "run")
    return found.join(runs, [id_col, "run"]).select(id_col, "token", "pos", "size")
