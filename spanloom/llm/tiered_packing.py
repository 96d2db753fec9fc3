"""Packing into context windows of several sizes, without padding.

Windows are powers of two. Whole windows of the largest size are cut off each document; what is left of it is routed to
the smallest tier that holds it. The tiers are packed from the largest down: each window is opened by the longest piece of
its tier, its gap is filled by the longest whole pieces of the shorter tiers that fit, and where none fits the shortest longer
piece is cut, whose end goes back to the tier of its own length. A tier opens no more windows than all that is left
can fill, so every window gets full; at most the last few ids go to windows below the least tier. Each tier is dealt evenly over
the training steps, so steps hold as many ids, and the same mix of windows, but for one window a tier.

Pieces of equal length are interchangeable, so the driver plans over the counts of lengths, fewer than `capacity` rows whatever the
input; a row of the plan sends a range of ranks of one length to a run of windows. Executors number the documents of each
length, in parts of bounded size, and cut them by the plan.

Defined results: a null or empty text is the single closing id; repeated rows are packed each for itself; an empty table gives
no rows; a very long text is cut like any other; a null id stays null; columns beside id and text are left out.
"""

from __future__ import annotations

import bisect
import uuid
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_words import as_bytes, encoded, map_batches, text_slices
from .common import FEW_ROWS, staged

CAPACITY, LEAST_TIER = 1024, 64
#: Ids of a training step.
STEP = 512 * 1024
#: Documents of one length that are numbered in one task, in the mean.
NUMBERED_AT_ONCE = 200_000
#: Chunks of each of a worker's two memories, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 250_000, 10_000_000
#: Bytes of text that are encoded together, and chunks that are joined for it.
ENCODED_AT_ONCE, JOINED = 3_000_000, 1000


class Pool:
    """Runs of pieces by length. A run (whole, start, rank, count): of the documents with `whole` ids left, those from rank on, each from id start on."""

    def __init__(self, counts: dict[int, int]):
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.lengths: list[int] = []
        self.held = 0
        for length, count in counts.items():
            self.give(length, (length, 0, 0, count))

    def give(self, length: int, run: tuple[int, int, int, int]) -> None:
        if length and run[3]:
            if not self.runs[length]:
                bisect.insort(self.lengths, length)
            self.runs[length].append(run)
            self.held += length * run[3]

    def take(self, length: int, most: int) -> tuple[int, int, int, int]:
        """A run of at most so many pieces."""
        whole, start, rank, count = self.runs[length].pop()
        taken = min(count, most)
        if taken < count:
            self.runs[length].append((whole, start, rank + taken, count - taken))
        elif not self.runs[length]:
            self.lengths.remove(length)
        self.held -= length * taken
        return whole, start, rank, taken

    def best(self, gap: int) -> int:
        """The longest piece that fits, or else the shortest."""
        at = bisect.bisect_right(self.lengths, gap)
        return self.lengths[at - 1] if at else self.lengths[0]


def plan(counts: dict[int, int], capacity: int = CAPACITY, least: int = LEAST_TIER) -> list[tuple[int, ...]]:
    """Rows (whole, rank from, rank to, start, length, window size, first window of that size, offset) for documents by ids left."""
    pool, rows, opened = Pool({n: c for n, c in counts.items() if n}), [], defaultdict(int)
    size = capacity
    while pool.held:
        # a tier ends when only shorter tiers' pieces are left; the least one, and those below for the last ids, take all
        while pool.held >= size and (size <= least or pool.lengths[-1] > size // 2):
            windows = pool.held // size
            longest = pool.lengths[-1]
            windows = min(windows, sum(r[3] for r in pool.runs[longest]))
            open_ = [(opened[size], windows, 0)]
            opened[size] += windows
            while open_:
                first, count, offset = open_.pop()
                gap = size - offset
                length = pool.best(gap) if offset else longest
                whole, start, rank, taken = pool.take(length, count)
                if taken < count:
                    open_.append((first + taken, count - taken, offset))
                used = min(length, gap)
                rows.append((whole, rank, rank + taken, start, used, size, first, offset))
                pool.give(length - used, (whole, start + used, rank, taken))
                if used < gap:
                    open_.append((first, taken, offset + used))
        size //= 2
    return rows


class Placements:
    """The plan by number of ids left: for a rank, the (start, length, size, window, offset) of its pieces."""

    def __init__(self, rows: list[tuple[int, ...]]):
        self.edges, self.found = {}, {}
        by_whole = defaultdict(list)
        for whole, *row in rows:
            by_whole[whole].append(row)
        for whole, found in by_whole.items():
            edges = sorted({edge for row in found for edge in row[:2]})
            within = [[] for _ in edges]
            for row in sorted(found, key=lambda row: row[2]):
                for at in range(bisect.bisect_left(edges, row[0]), bisect.bisect_left(edges, row[1])):
                    within[at].append(row)
            self.edges[whole], self.found[whole] = edges, within

    def of(self, whole: int, rank: int) -> list[tuple[int, int, int, int, int]]:
        at = bisect.bisect_right(self.edges[whole], rank) - 1
        return [(start, length, size, first + rank - low, offset) for low, _, start, length, size, first, offset in self.found[whole][at]]


@lru_cache(maxsize=1)
def _kept_placements(key: str) -> list[Placements]:
    return []


def _placements(key: str, rows: list[tuple[int, ...]]) -> Placements:
    """One for all tasks that a worker runs of a plan."""
    kept = _kept_placements(key)
    if not kept:
        kept.append(Placements(rows))
    return kept[0]


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide, letter, mark = np.zeros((3, 256), dtype=bool)
    wide[0xC3:0xE0] = True  # begins a character of two bytes, none of which is white space
    letter[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    mark[0x21:0x7F] = True
    return wide, letter, mark & ~letter


WIDE, ALNUM, MARK = _kinds()
SOLID = WIDE | ALNUM | MARK


def chunk_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where texts may be cut so that byte-level BPE with the usual pattern of words gives each part the ids that it has in the text.

    These places begin a match of the pattern: a single space or line feed between characters that aren't white space, what follows such a
    line feed, and a mark that follows an ASCII letter or digit. Where the neighbours could be white space beyond ASCII, nothing is cut.
    """
    starts = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 2:
        before, here, after = data[:-2], data[1:-1], data[2:]
        solid = ALNUM[before] | MARK[before]
        solid[1:] |= (before[1:] >= 0x80) & WIDE[before[:-1]]
        alone = solid & SOLID[after]
        feed = alone & (here == 0x0A)
        starts[1:-2] = (alone & (here == 0x20)) | feed | (ALNUM[before] & MARK[here])
        starts[2:-1] |= feed
        if MARK[data[-1]] and ALNUM[data[-2]]:
            starts[len(data) - 1] = True
    starts[bounds] = True
    return np.flatnonzero(starts)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


class ChunkIds:
    """The ids, as little-endian bytes, of chunks of text. When the young memory is full it becomes the old one; what is asked for again comes back."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        names = tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(names.values()) + 1, dtype=np.int64)
        self.sizes[list(names.values())] = list(map(len, names))  # a letter of a name stands for a byte

    def _encode(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Chunks that begin with a space and a solid character, and end with one, keep their ids when they are joined; the bytes of the ids tell them apart again."""
        solid, wide = SOLID.tolist(), WIDE.tolist()
        usual = [c for c in chunks if len(c) > 1 and c[0] == 0x20 and solid[c[1]] and (0x20 < c[-1] < 0x7F or wide[c[-2]])]
        out = {}
        for first in range(0, len(usual), JOINED):
            group = usual[first : first + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(group).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends, reached = np.cumsum(list(map(len, group))), np.cumsum(self.sizes[ids])
            stops = np.searchsorted(reached, ends)
            if len(ids) and reached[-1] == ends[-1] and np.array_equal(reached[stops], ends):
                data, cuts = ids.tobytes(), (4 * (stops + 1)).tolist()
                out.update(zip(group, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
        rest = [c for c in chunks if c not in out]
        got = self.tokenizer.encode_batch_fast([c.decode() for c in rest], add_special_tokens=False)
        out.update((c, np.array(x.ids, dtype="<u4").tobytes()) for c, x in zip(rest, got, strict=True))
        return out

    def of(self, chunks: list[bytes]) -> list[bytes]:
        young, old = self.young, self.old
        missed = [c for c in chunks if c not in young]
        fresh = []
        for chunk in missed:
            if chunk in old:
                young[chunk] = old[chunk]
            else:
                fresh.append(chunk)
        young.update(self._encode(fresh))
        found = list(map(young.__getitem__, chunks))
        self.held += sum(map(len, missed))
        if len(young) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.old, self.young, self.held = young, {}, 0
        return found


@lru_cache(maxsize=1)
def _memory(path: str) -> ChunkIds:
    """One memory for all tasks that a worker runs."""
    return ChunkIds(_tokenizer(path))


def slice_ids(memory: ChunkIds, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows of a slice, and where those of each row begin, and the end."""
    starts = chunk_starts(data, bounds)
    if len(starts) < 2:
        return np.zeros(0, dtype="<u4"), np.zeros(len(bounds), dtype=np.int64)
    names, codes = encoded(data, starts)
    parts = memory.of(as_bytes(names))
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
    firsts = np.cumsum(sizes) - sizes
    ids = np.frombuffer(b"".join(parts), dtype="<u4")
    ends = np.cumsum(sizes[codes])
    ids = ids[np.arange(ends[-1]) + np.repeat(firsts[codes] - ends + sizes[codes], sizes[codes])]
    return ids, np.append(0, ends)[np.searchsorted(starts, bounds)]


def encoded_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, _tokens, _crcs of its whole windows, _left (ids beyond them), and _rest, these ids as little-endian bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        memory = _memory(path)
        end = np.array([closing], dtype="<u4").tobytes()

        def work(batch):
            if batch is None or not batch.num_rows:
                return
            for first, data, bounds in text_slices(batch.column(1), ENCODED_AT_ONCE):
                ids, edges = slice_ids(memory, data, bounds)
                tokens, crcs, left, rest = [], [], [], []
                for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    row = ids[low:high].tobytes() + end
                    count = len(row) // 4
                    whole = count - count % capacity
                    tokens.append(count)
                    crcs.append([zlib.crc32(row[4 * at : 4 * (at + capacity)]) for at in range(0, whole, capacity)])
                    left.append(count - whole)
                    rest.append(row[4 * whole :])
                yield [batch.column(0).slice(first, len(tokens)), pa.array(tokens), pa.array(crcs, pa.list_(pa.int64())), pa.array(left), pa.array(rest, pa.binary())]

        return work

    return map_batches(docs, [id_col, text], f"`{id_col}` {kind}, _tokens long, _crcs array<long>, _left long, _rest binary", make)


def tiered_packing(
    docs: DataFrame, path: str, capacity: int = CAPACITY, least: int = LEAST_TIER, closing: int = 0, step: int = STEP, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the size of its window and its training step."""
    if capacity & (capacity - 1) or least & (least - 1):
        raise ValueError("windows are powers of two")
    spark = docs.sparkSession
    rows = staged(encoded_documents(docs, path, capacity, closing, id_col, text), "tiers-ids")

    # documents by ids left, in parts of bounded size: fewer than capacity rows come to the driver
    by_left = rows.groupBy("_left").agg(F.count("*").alias("n"), F.sum(F.size("_crcs")).alias("whole")).collect()
    counts = {r["_left"]: r["n"] for r in by_left}
    deals = spark.createDataFrame([(r["_left"], 1 + r["n"] // NUMBERED_AT_ONCE) for r in by_left], "_left long, _deals long")
    rows = rows.join(F.broadcast(deals), "_left").withColumn("_deal", F.pmod(F.xxhash64(id_col, F.crc32("_rest")), F.col("_deals"))).drop("_deals")
    parts = rows.groupBy("_left", "_deal").agg(F.count("*").alias("_n"), F.sum(F.size("_crcs")).cast("long").alias("_w"))
    parts = staged(parts, "tiers-parts")  # the documents by NUMBERED_AT_ONCE, and fewer than capacity besides
    lower = Window.partitionBy("_left").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_left", "_deal", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_ranks"), F.coalesce(F.sum("_w").over(lower), F.lit(0)).alias("_wholes"))
    before = F.broadcast(before) if parts.count() <= FEW_ROWS else before

    placed = plan(counts, capacity, least)
    windows: dict[int, int] = defaultdict(int)
    for _, low, high, _, _, size, first, _ in placed:
        windows[size] = max(windows[size], first + high - low)
    planned = windows[capacity]
    whole_before, wholes = {}, 0
    for r in sorted(by_left, key=lambda r: r["_left"]):
        whole_before[r["_left"]], wholes = planned + wholes, wholes + (r["whole"] or 0)
    windows[capacity] += wholes
    bases, at = {}, 0
    for size in sorted(windows, reverse=True):
        bases[size], at = at, at + windows[size]
    steps = max(1, sum(size * n for size, n in windows.items()) // step)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, placed, dict(windows), bases, whole_before))  # of the size of the plan

    order = [id_col, "_tokens", F.crc32("_rest"), "_crcs"]
    within = Window.partitionBy("_left", "_deal").orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1)
    ranked = ranked.withColumn("_whole", F.coalesce(F.sum(F.size("_crcs")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(before, ["_left", "_deal"]).select(
        id_col, "_tokens", "_crcs", "_left", "_rest", (F.col("_rank") + F.col("_ranks")).cast("long").alias("_rank"), (F.col("_whole") + F.col("_wholes")).cast("long").alias("_whole")
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        key, placed, windows, bases, whole_before = sent.value
        placements = _placements(key, placed)

        def work(batch):
            if batch is None or not batch.num_rows:
                return
            lists = [batch.column(i).to_pylist() for i in range(1, 7)]
            taken, out = [], []
            for at, (tokens, crcs, left, rest, rank, whole) in enumerate(zip(*lists, strict=True)):
                window = whole_before[left] + whole
                out += [(i * capacity, capacity, crc, tokens, capacity, window + i, 0) for i, crc in enumerate(crcs)]
                if left:
                    base = len(crcs) * capacity
                    for start, length, size, window, offset in placements.of(left, rank):
                        out.append((base + start, length, zlib.crc32(rest[4 * start : 4 * (start + length)]), tokens, size, window, offset))
                taken += [at] * (len(out) - len(taken))
            start, length, crc, tokens, size, window, offset = (list(column) for column in zip(*out, strict=True))
            numbers = [bases[s] + w for s, w in zip(size, window, strict=True)]
            turns = [w * steps // windows[s] for s, w in zip(size, window, strict=True)]
            yield [batch.column(0).take(pa.array(taken)), *map(pa.array, (start, length, crc, tokens, numbers, offset, size, turns))]

        return work

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_size int, step long"
    return map_batches(ranked, ranked.columns, schema, make)
