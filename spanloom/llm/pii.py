"""Personal data by offset-preserving deobfuscation.

Base detectors find e-mail addresses, IPv4 addresses, card numbers and phone numbers as they are written. Then
transducers rewrite disguises and keep, for every character they write, the span of source characters it
came from: look-alike letters and digits, invisible characters, spelled digits, and "at", "dot" and "plus" as words
or in brackets, also between the numbers of an IP address. The same detectors run on the rewritten text, and their finds are mapped back to the source.
A find counts if it rests on a rewrite and reaches beyond the base spans it overlaps; base spans always stay beside it.

Not caught: a plain "at" before a host with written dots only (name at host.com), and an address of plain words whose top-level
domain isn't in TOP_LEVEL (john at firma dot pl). Brackets around "at" or a dot lift both limits.

Defined results: a null or empty text has no spans; spans are code points with an exclusive end; repeated rows
are searched each for itself; an empty table gives no rows; a very long text is searched whole, in linear time; columns
named like a result are left out, and masking leaves all others as they are; equal or overlapping added spans keep the first by kind and start.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, small_batches

#: Order of the kinds in results.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a run of digits is entered at its start only: matches are the same, without a second look at long runs
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Look-alikes of Latin letters, by the letter they stand for.
LOOK_ALIKES = {
    "a": "аα", "b": "Ьв", "c": "сϲ", "d": "ԁ", "e": "еє", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "кκ", "l": "ӏ",
    "m": "м", "n": "п", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "ν", "w": "ԝѡ", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ",
    "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
#: Characters that show nothing, and dashes and blanks beside the ASCII ones.
INVISIBLE = "­​‌‍⁠﻿"
DASHES = "‐‑‒–−"
BLANKS = "    "

#: Digits as words in English, German, French and Spanish.
SPELLED = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
#: Top-level domains that make plain words an address.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co uk de fr es eu it nl ch at us ca au ru cn jp in br".split())
_DIGIT = {word: digit for digit, words in SPELLED.items() for word in words.split()}
_NUMBER = "|".join(sorted(_DIGIT, key=len, reverse=True))
_AT = r"(?:\s*[\[({<]\s*(?:at|arroba|arobase|@)\s*[\])}>]\s*|\s+(?:at|arroba|arobase)\s+)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|point|punto)\s+)"
# an address with a disguised @: a plain "at" needs a disguised dot too, a bracketed one doesn't. It is looked for from its "at" on,
# to both sides, so that a long row of words and dots is walked along once
_SIGN = re.compile(rf"(?i)(?<=[a-z0-9_%+-])(?:{_AT}|@)")
_HOST = re.compile(rf"(?i)[a-z0-9-]++(?:(?:\.|{_DOT})[a-z0-9-]++)++")
_NAME = re.compile(rf"(?i)[a-z0-9_%+-]++(?:(?:\.|{_DOT})[a-z0-9_%+-]++)*+")
_NAME_PART = re.compile(r"(?i)(?<![\w.%+-])[a-z0-9_%+-]++")
_DOTS = re.compile(rf"(?i)(?<!\s)(?:{_DOT})")
_NAME_LETTERS = _LOCAL - {"."}
#: A number of so many digits is none of the kinds.
_NO_NUMBER = re.compile(r"[0-9]{40,}+")
_CUES = re.compile(r"(?i)[\[({<]\s*(?:at|arroba|arobase|@|dot|punkt|point|punto|\.)\s*[\])}>]|\s(?:at|arroba|arobase)\s(?=.{0,80}\s(?:dot|punkt|point|punto)\s)|\s(?:dot|punkt|point|punto)\s")
#: Four numbers with dots between them, and what disguises a dot there.
_BETWEEN = rf"(?:{_DOT}|\s\.\s|\.)"
_QUAD = re.compile(rf"(?i)(?<![\w.])[0-9]{{1,3}}(?:{_BETWEEN}[0-9]{{1,3}}){{3}}(?!\w|\.[0-9])")
_QUAD_DOT = re.compile(rf"(?i)(?<=[0-9]){_BETWEEN}(?=[0-9])")
_QUAD_CUE = re.compile(r"(?i)[0-9]\s*[\[({<]\s*(?:dot|punkt|point|punto|\.)|[0-9]\s+(?:dot|punkt|point|punto)\s+[0-9]|[0-9]\s\.\s[0-9]")
#: Four digits in a row of which at least two are words, with what stands between the parts of a number.
_SPOKEN = re.compile(rf"(?i)(?<!\w)(?:(?:plus|\+)[\s-]*)?(?:(?:{_NUMBER}|[0-9])(?:[\s-]+(?:(?:dot|punkt|point|punto)[\s-]+)?|\.)?){{3,}}(?:{_NUMBER}|[0-9]+)(?!\w)")
_SPOKEN_CUE = re.compile(rf"(?i)(?<!\w)(?:{_NUMBER})[\s.-]+(?:(?:dot|punkt|point|punto)[\s-]+)?(?:{_NUMBER}|[0-9])(?!\w)")
_SPOKEN_PART = re.compile(rf"(?i)plus|\+|dot|punkt|point|punto|\.|{_NUMBER}|[0-9]|[\s-]+")

_SAME = {ord(x): letter for letter, like in LOOK_ALIKES.items() for x in like}
_SAME |= {ord(x): "-" for x in DASHES} | {ord(x): " " for x in BLANKS} | {code: chr(code - 0xFEE0) for code in range(0xFF01, 0xFF5F)}
_GONE = frozenset(INVISIBLE)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, leftmost and without overlap within a kind; matches that fail their test are dropped."""
    found = {kind: [] for kind in KINDS}
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found["email"].append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.groups()):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


class Tape:
    """A rewritten text with the source span of each character."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replaces sorted, disjoint ranges; each new character stands for its whole range."""
        out, starts, ends, at = [], [], [], 0
        for a, b, new in [*changes, (len(self.text), len(self.text), "")]:
            out.append(self.text[at:a])
            starts.extend(self.starts[at:a])
            ends.extend(self.ends[at:a])
            if new:
                out.append(new)
                starts.extend([self.starts[a]] * len(new))
                ends.extend([self.ends[b - 1]] * len(new))
            at = b
        self.text, self.starts, self.ends = "".join(out), starts, ends


def _look_alikes(text: str) -> list[tuple[int, int, str]]:
    """Letters change only in words that also have ASCII letters or digits, so texts in other scripts stay."""
    changes = []
    for m in re.finditer(r"\S+", text):
        mixed = any(c.isascii() and (c.isalnum() or c == "@") for c in m[0])
        for i, c in enumerate(m[0], m.start()):
            if c.isascii():
                continue
            if c in _GONE:
                changes.append((i, i + 1, ""))
            elif (same := _SAME.get(ord(c))) and (mixed or not same.isalpha() or ord(c) >= 0xFF01):
                changes.append((i, i + 1, same))
            elif (digit := unicodedata.decimal(c, None)) is not None:
                changes.append((i, i + 1, str(digit)))
            elif ord(c) >= 0x1D400 and (plain := unicodedata.normalize("NFKC", c)).isascii() and plain:
                changes.append((i, i + 1, plain))
    blanks = ((m.start(), m.end(), " ") for m in re.finditer(f"[{BLANKS}]", text))
    return sorted({*changes, *blanks})


def _addresses(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, start and end of the at, end) of addresses, leftmost and without overlap."""
    free, sign, names = 0, _SIGN.search(text), _NAME.finditer(text)
    name = next(names, None)
    while sign:
        at, host = sign.span(), _HOST.match(text, sign.end())
        if host:
            while name and name.end() < at[0]:
                name = next(names, None)
            if name and name.start() < at[0] < name.end():
                # the word before the "at" could be a dot between names; here it is the name
                start = at[0]
                while start > free and text[start - 1] in _NAME_LETTERS:
                    start -= 1
                part = _NAME_PART.match(text, start, at[0])
            else:
                part = name and name.end() == at[0] and _NAME_PART.search(text, max(free, name.start()), at[0])
            if part:
                yield part.start(), *at, host.end()
                free = host.end()
                names = _NAME.finditer(text, free)
                name = next(names, None)
        sign = _SIGN.search(text, max(free, at[0] + 1))


def _at_and_dot(text: str) -> list[tuple[int, int, str]]:
    changes = []
    for start, at, after, end in _addresses(text):
        whole, sign = text[start:end], text[at:after]
        dots = [(start + x.start(), start + x.end(), ".") for x in _DOTS.finditer(whole)]
        if sign == "@" and not dots:
            continue
        bare = not re.search(r"[\[({<]", whole)
        if bare and (not dots or _DOTS.split(whole.lower())[-1].rpartition(".")[2] not in TOP_LEVEL):
            continue  # plain words are an address only under a usual top-level domain
        if not dots and not re.search(r"[\[({<]", sign):
            continue
        changes += dots
        if sign != "@":
            changes.append((at, after, "@"))
    return sorted(changes)


def _dotted_numbers(text: str) -> list[tuple[int, int, str]]:
    dots = ((m.start() + x.start(), m.start() + x.end(), x[0]) for m in _QUAD.finditer(text) for x in _QUAD_DOT.finditer(m[0]))
    return [(a, b, ".") for a, b, dot in dots if dot != "."]


def _spoken_numbers(text: str) -> list[tuple[int, int, str]]:
    changes, ends = [], [m.span() for m in _NO_NUMBER.finditer(text)]
    bounds = zip([0, *(b for _, b in ends)], [*(a for a, _ in ends), len(text)], strict=True)
    for m in (m for a, b in bounds for m in _SPOKEN.finditer(text, a, b)):
        if len(_SPOKEN_CUE.findall(m[0])) == 0:
            continue
        for x in _SPOKEN_PART.finditer(m[0]):
            word = x[0].lower()
            new = _DIGIT.get(word) or {"plus": "+", "dot": ".", "punkt": ".", "point": ".", "punto": "."}.get(word)
            if new is None and not word.strip(" \t\n\r\x0b\x0c-"):
                new = ""
            if new is not None:
                changes.append((m.start() + x.start(), m.start() + x.end(), new))
    return changes


def normalise(text: str) -> Tape | None:
    """The rewritten text, or None if there is nothing to rewrite."""
    tape = Tape(text)
    changed = False
    if not text.isascii() and not _PLAIN.issuperset(set(text)):
        if changes := _look_alikes(text):
            tape.rewrite(changes)
            changed = True
    for cue, transducer in ((_CUES, _at_and_dot), (_QUAD_CUE, _dotted_numbers), (_SPOKEN_CUE, _spoken_numbers)):
        if cue.search(tape.text) and (changes := transducer(tape.text)):
            tape.rewrite(changes)
            changed = True
    return tape if changed else None


#: Characters of Latin scripts that no transducer changes; texts of these alone skip the first one.
_PLAIN = frozenset(chr(c) for c in range(0x250) if chr(c) not in _GONE and c not in _SAME)


def find_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind; all spans by kind, then start."""
    base = detect(text)
    every = [(kind, *span) for kind in KINDS for span in base[kind]]
    if (tape := normalise(text)) is not None:
        bases = sorted(span for spans in base.values() for span in spans)
        reach = list(accumulate((end for _, end in bases), max))
        added: list[tuple[int, int]] = []  # sorted, and disjoint
        for kind, spans in detect(tape.text).items():
            for a, b in spans:
                start, end = tape.starts[a], tape.ends[b - 1]
                before = bisect_right(bases, (start, len(text))) - 1
                if text[start:end] == tape.text[a:b] or (before >= 0 and reach[before] >= end):
                    continue
                place = bisect_right(added, (start, end))
                if (place and added[place - 1][1] > start) or (place < len(added) and added[place][0] < end):
                    continue
                added.insert(place, (start, end))
                every.append((kind, start, end))
    every.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, every


def listed(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans lists all as kind:start:end."""

    def make():
        def work(keys, texts):
            out = [[] for _ in range(7)]
            for key, t in zip(keys, texts, strict=True):
                base, every = find_spans(t or "")
                digest = hashlib.sha256(listed((k, *s) for k in KINDS for s in base[k]).encode()).hexdigest()
                for column, value in zip(out, (key, *(len(base[k]) for k in KINDS), digest, listed(every)), strict=True):
                    column.append(value)
            return out

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text], f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)


def mask(text: str) -> str:
    """text with every span replaced by its kind in brackets; overlapping spans are masked as one, under the first kind."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in find_spans(text)[1]):
        if start >= at:
            out.append(f"{text[at:start]}[{kind.upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with masked texts (null stays null); the other columns are as before."""
    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else mask(t) for t in texts.to_pylist()], pa.string())

    small_batches(docs.sparkSession)
    return docs.withColumn(text, masked(F.col(text)))
