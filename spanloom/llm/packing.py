"""Best-fit decreasing packing of token sequences, planned over the counts of lengths.

Pieces of equal length are interchangeable, so best-fit decreasing depends only on how many pieces each length
has. The driver plans over that histogram, at most `capacity` rows whatever the input: open sequences are kept as
runs by remaining capacity, and a segment tree over capacities finds the tightest that fits. A plan row sends a
range of ranks of one length to a run of sequences. The executors number the pieces of each length, dealt out so
that a frequent length isn't one task, and look their place up.

Defined results: a null or empty text is the single closing id; repeated rows are packed each for itself;
an empty table gives no rows; a very long text is cut like any other; columns beside id and text are left out.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, map_rows, staged

CAPACITY = 4096
#: Parts that the pieces of one length are numbered in.
DEALS = 128
#: Chunks, and words, that a worker remembers, and their characters.
REMEMBERED, REMEMBERED_CHARACTERS = 1_000_000, 50_000_000
#: Chunks of texts that are encoded together.
AT_ONCE = 300_000


class OpenRuns:
    """Runs of open sequences by remaining capacity, with a segment tree that finds the tightest."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, remaining: int) -> None:
        node = self.leaves + remaining
        self.tree[node] = bool(self.runs[remaining])
        while node > 1:
            node //= 2
            self.tree[node] = self.tree[2 * node] or self.tree[2 * node + 1]

    def put(self, remaining: int, first: int, count: int) -> None:
        if remaining and count:
            self.runs[remaining].append((first, count))
            self._mark(remaining)

    def take(self, remaining: int) -> tuple[int, int]:
        run = self.runs[remaining].pop()
        self._mark(remaining)
        return run

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least length."""
        node = self.leaves + length
        if length < len(self.runs) and self.tree[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank from, rank to, first sequence, pieces a sequence, offset) of best-fit decreasing."""
    rows, runs, opened = [], OpenRuns(capacity), 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = runs.tightest(length)
            if remaining is None:
                remaining = capacity
                first, count = opened, -(-left // (capacity // length))
                opened += count
            else:
                first, count = runs.take(remaining)
            each = remaining // length
            used = min(left, count * each)
            rows.append((length, rank, rank + used, first, each, capacity - remaining))
            full, part = divmod(used, each)
            runs.put(remaining, first + full + (part > 0), count - full - (part > 0))
            runs.put(remaining - part * length, first + full, int(part > 0))
            runs.put(remaining - each * length, first, full)
            rank, left = rank + used, left - used
    return rows


#: How the tokenizer cuts a lower-cased chunk into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class ChunkMemory(dict):
    """The ids, as little-endian bytes, of parts between ASCII white space, which the tokenizer drops.

    Chunks of Latin-1 characters have no other normal form and lower-case letter by letter, so they are cut into the
    tokenizer's words, which are far fewer, and these are encoded; other chunks are encoded as they are.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.words, self.cut = tokenizer, {}, regex.compile(WORDS).findall
        self.held = self.held_words = 0
        names = tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(names.values()) + 1, dtype=bool)
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> dict[str, bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return {text: np.array(x.ids, dtype="<u4").tobytes() for text, x in zip(texts, got, strict=True)}

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Many words are encoded as one text, as ids that end a word tell them apart again."""
        out = {}
        for at in range(0, len(words), 1000):
            group = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(stops) == len(group):
                data = ids.tobytes()
                out.update(zip(group, map(data.__getitem__, map(slice, [0, *stops[:-1].tolist()], stops.tolist())), strict=True))
            else:
                out.update(self._encode(group))
        return out

    def fill(self, chunks: set[bytes]) -> None:
        new = chunks.difference(self)
        self.held += sum(map(len, new))
        if len(self) + len(new) > REMEMBERED or self.held > REMEMBERED_CHARACTERS:
            self.clear()
            new, self.held = chunks, sum(map(len, chunks))
        cut, whole = {}, {}
        for chunk in new:
            text = chunk.decode()
            if text.isascii() or max(text) < "\u0100":
                text = text.lower()
                if text.isalpha():  # as most are: a word, or one with a mark behind
                    cut[chunk] = (text,)
                elif text[-1] in ".,;:!?" and text[:-1].isalpha():
                    cut[chunk] = (text[:-1], text[-1])
                else:
                    cut[chunk] = self.cut(text)
            else:
                whole[text] = chunk
        words = set(chain.from_iterable(cut.values()))
        unknown = words.difference(self.words)
        self.held_words += sum(map(len, unknown))
        if len(self.words) + len(unknown) > REMEMBERED or self.held_words > REMEMBERED_CHARACTERS:
            self.words.clear()
            unknown, self.held_words = words, sum(map(len, words))
        self.words.update(self._encode_words(list(unknown)))
        for chunk, found in cut.items():
            self[chunk] = self.words[found[0]] if len(found) == 1 else b"".join(map(self.words.__getitem__, found))
        for text, ids in self._encode(list(whole)).items():
            self[whole[text]] = ids
        _kept.touch()


def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


_kept = Kept(lambda path: ChunkMemory(_tokenizer(path)))


def _memory(path: str) -> ChunkMemory:
    """One memory for all tasks that a worker runs, until it is idle."""
    return _kept.get(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece of at most capacity ids: id, piece, start, length, ids_crc32. Only longer documents are cut."""

    def make():
        memory = _memory(path)
        end = np.array([closing], dtype="<u4").tobytes()

        def in_groups(texts):
            at = 0
            while at < len(texts):
                group, size = [], 0
                while at < len(texts) and size < AT_ONCE:
                    group.append((texts[at] or "").encode().split())
                    size, at = size + len(group[-1]), at + 1
                memory.fill(set(chain.from_iterable(group)))
                yield from group

        def work(keys, texts):
            out = [[], [], [], [], []]
            for key, chunks in zip(keys, in_groups(texts), strict=True):
                ids = b"".join(map(memory.__getitem__, chunks)) + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    for column, value in zip(out, (key, piece, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            return out

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text], f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long", make)


def pack(parts: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """parts (with length) and their sequence_id and offset."""
    spark = parts.sparkSession
    parts = parts.withColumn("_deal", F.pmod(F.xxhash64(*order), F.lit(DEALS)).cast("int"))
    dealt = parts.groupBy("length", "_deal").agg(F.count("*").alias("_n"))
    dealt = staged(dealt, "pack-counts")  # at most capacity * DEALS rows
    before = dealt.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_deal")) - F.col("_n")).select("length", "_deal", "_before")
    counts = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    schema = "length long, _from long, _to long, _first long, _each long, _at long"
    placed = spark.createDataFrame(plan(counts, capacity), schema)
    within = Window.partitionBy("length", "_deal").orderBy(*order)
    ranked = parts.withColumn("_rank", F.row_number().over(within) - 1).join(F.broadcast(before), ["length", "_deal"])
    ranked = ranked.withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long"))
    found = ranked.join(F.broadcast(placed), "length").where("_rank >= _from and _rank < _to")
    return found.select(
        *(c for c in parts.columns if c != "_deal"),
        F.expr("_first + (_rank - _from) div _each").alias("sequence_id"),
        (F.col("_at") + F.pmod(F.col("_rank") - F.col("_from"), F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """pieces(), packed."""
    cut = staged(pieces(docs, path, capacity, closing, id_col, text), "pack-pieces")
    return pack(cut, capacity, (id_col, "piece", "ids_crc32"))
