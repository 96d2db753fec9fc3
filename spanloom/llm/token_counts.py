"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole; its tokens' spans are then joined with the spans of its sections by a
sorted interval join, and a token that crosses a boundary goes to one section by an explicit rule:
"first" (the section of its first byte), "last" (of its last byte) or "largest" (the most bytes; of equals the
first). So the sections' counts add up to the document's.

Sections are the lines with their \\n, counted from 0, or those of a table (id, section, start, end) in code points, which may
leave gaps but not overlap. A token that the rule gives to a gap counts nowhere.

Defined results: a null or empty text has one empty line without tokens; repeated rows are counted each for itself; an empty
table gives no rows; a very long text is one task's; columns beside id and text are left out. Given sections are cut at the
text's end; a document without any gives no rows, nor does one without an id; null bounds are 0 and the text's end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import encoder_of
from .common import map_rows

RULES = ("first", "last", "largest")


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token. Both tile the same bytes from 0; ends are sorted, sections may be empty."""
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    if rule == "first":
        return first
    if rule == "last":
        return last
    best = first.copy()
    for i in np.flatnonzero(last > first):  # few: only tokens across a boundary
        cuts = np.concatenate(([starts[i]], section_ends[first[i] : last[i]], [token_ends[i]]))
        best[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return best


def token_counts(docs: DataFrame, path: str, pattern: str, rule: str = "largest", id_col: str = "doc_id", text: str = "text", sections: DataFrame | None = None) -> DataFrame:
    """One row per section: id, section, start and end (code points), n_tokens, n_crossing (its tokens that reach into another section or a gap)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows, named = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "int"
    if sections is not None:
        named = sections.schema["section"].dataType.simpleString()
        lists = sections.groupBy(F.col(id_col).alias("_id")).agg(F.collect_list(F.struct("start", "end", "section")).alias("_sections"))  # bounded by the document
        rows = rows.join(lists, "_id")

    def tiles(spans, size):
        """Section ends in code points that tile the text, with the section of each, None for gaps."""
        ends, owners, at = [], [], 0
        for s in sorted(spans, key=lambda s: (s["start"] or 0, size if s["end"] is None else s["end"])):
            start, end = min(s["start"] or 0, size), size if s["end"] is None else min(s["end"], size)
            if start < at or end < start:
                raise ValueError("sections overlap")
            if start > at:
                ends.append(start)
                owners.append(None)
            ends.append(end)
            owners.append((s["section"],))
            at = end
        if at < size:
            ends.append(size)
            owners.append(None)
        return ends, owners

    def make():
        encoder = encoder_of(path, pattern)
        sizes = np.fromiter(map(len, encoder.words.bytes), dtype=np.int64, count=len(encoder.words.bytes))

        def work(keys, texts, spans=None):
            out = [[], [], [], [], [], []]
            for i, (key, t, ids) in enumerate(zip(keys, texts, encoder.encode(texts), strict=True)):
                data = np.frombuffer((t or "").encode(), dtype=np.uint8)
                if spans is None:
                    ends = np.append(np.flatnonzero(data == 10) + 1, len(data))
                    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[ends]  # of characters, not bytes
                    owners = range(len(ends))
                else:
                    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                    points, owned = tiles(spans[i], len(places) - 1)
                    points = np.array(points, dtype=np.int64)
                    ends = places[points]
                    kept = np.array([j for j, owner in enumerate(owned) if owner is not None], dtype=np.int64)
                    owners = [owned[j][0] for j in kept]
                token_ends = np.cumsum(sizes[ids])
                place = allocate(token_ends, ends, rule)
                starts = token_ends - np.diff(token_ends, prepend=0)
                crossing = np.searchsorted(ends, token_ends, side="left") > np.searchsorted(ends, starts, side="right")
                n = len(ends)
                found = [np.concatenate(([0], points[:-1])), points, np.bincount(place, minlength=n), np.bincount(place[crossing], minlength=n)]
                if spans is not None:
                    found = [values[kept] for values in found]
                out[0] += [key] * len(owners)
                out[1] += owners
                for column, values in zip(out[2:], found, strict=True):
                    column.append(values)
            out[2:] = [np.concatenate(column) if column else column for column in out[2:]]
            return out

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    columns = ["_id", "_text", *(["_sections"] if sections is not None else [])]
    return map_rows(rows, columns, f"`{id_col}` {kind}, section {named}, start long, end long, n_tokens long, n_crossing long", make)
