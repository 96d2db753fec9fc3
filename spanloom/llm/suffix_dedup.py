"""Removal of long repeated byte strings by one distributed sort of a sparse suffix array.

Doubling is done within a task: the rank of the 2h bytes at a position is a fingerprint of the pair of ranks at the position
and h bytes on, up to RANK bytes. It has no rounds in Spark that sort pairs of position and rank at growing offsets. Only anchors take part in the distributed sort: in every window of
`length` bytes the leftmost position of least rank, so equal windows choose equal anchors, and each anchor
answers for an unbroken run of windows. The rounds rerank at growing reach and drop what is settled:

1. Anchors are sorted by rank, then by the rank of all bytes their windows span. One alone with its
   rank is unique: none of its windows repeats. One whose whole span stood earlier is settled: all of its windows repeat.
2. What is left are first occurrences whose rank others share with another span, the edges of repeats. For them the windows' bytes
   themselves are compared within the rank.

Equal spans are settled within a batch before anything is shuffled, so a group of copies sends a row a batch. Sorted
rows are read as streams. A rank with more than `large` open anchors is dealt by window instead.

Defined results: a null text is empty; texts of fewer than `length` bytes keep all; rows that repeat id and text are one
document and get the same result; of different texts under one id that with the smaller hash counts as
earlier; a null id is the earliest; ids are integers, others an error; an empty table gives no rows; columns beside id and text
are left out. Spans' ranks count as equal if 128 bits agree.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_groups, small_batches, staged

#: Bytes under an anchor's rank; a power of two.
RANK = 32
#: Open anchors of one rank that one task compares.
LARGE = 20_000
#: Bytes that are ranked together; longer documents are ranked in parts whose windows follow on.
AT_ONCE = 500_000

_random = np.random.default_rng(100)
_BYTES = _random.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = _random.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_PIECES = np.concatenate((_ODD[10:13], _random.integers(0, 2**64, 32, dtype=np.uint64) | np.uint64(1)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[14]
    return x ^ (x >> np.uint64(29))


def ranks(data: np.ndarray, size: int) -> list[np.ndarray]:
    """Ranks of the 1, 2, 4 .. size bytes at each position; each is made of two of the one before."""
    out = [_BYTES[data]]
    h, step = 1, 0
    while h < size:
        last = out[-1]
        out.append(last[:-h] * _ODD[step] + last[h:] if len(last) > h else last[:0])
        h, step = 2 * h, step + 1
    return out


def anchors(data: np.ndarray, ends: np.ndarray, length: int, rank: int = RANK) -> tuple[np.ndarray, ...]:
    """(position, first window, last window, rank, span's rank) of the anchors of documents laid end to end."""
    levels = ranks(data, 2 * rank)
    key = _mix(levels[-2])
    wide = levels[-1]
    reach = length - rank + 1
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    least, have = key, 1
    while 2 * have <= reach:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[: len(least) - (reach - have)], least[reach - have :])[:n]
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(n + 1, dtype=np.int32)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, np.minimum(ends[long] - length + 1, n), -1)
    valid = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    if not len(valid):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    breaks = np.ones(len(valid), dtype=bool)
    breaks[1:] = (least[valid[1:]] != least[valid[:-1]]) | (valid[1:] != valid[:-1] + 1)
    breaks[1:] |= np.isin(valid[1:], starts)  # documents of just enough bytes may stand side by side
    first = valid[breaks]
    last = valid[np.concatenate((np.flatnonzero(breaks)[1:] - 1, [len(valid) - 1]))]
    views = np.lib.stride_tricks.sliding_window_view(key, reach)
    found = []
    while len(first):  # a rank that comes again within a window's reach takes another turn
        at = np.concatenate([first[i : i + 4096] + np.argmax(views[first[i : i + 4096]] == least[first[i : i + 4096], None], axis=1) for i in range(0, len(first), 4096)])
        stop = np.minimum(last, at)
        found.append((at, first, stop))
        more = stop < last
        first, last = at[more] + 1, last[more]
    at, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    size = hi + length - lo
    # as many pieces as the longest span needs, so that they meet or overlap in every span
    last = max(3, -(-(2 * length - rank) // (2 * rank))) - 1
    span = np.zeros(len(lo), dtype=np.uint64)
    for k in range(last + 1):
        span += wide[lo + (size - 2 * rank) * k // last] * _PIECES[k]
    span = _mix(span + (at - lo).astype(np.uint64) * _ODD[13] + (at - hi).astype(np.uint64) * _ODD[15])
    return at, lo, hi, key[at], span


def _pack(at, lo, hi):
    """Place in the document, with the reach to the first and last window; sorts by place."""
    return (at.astype(np.int64) << 20) | ((at - lo).astype(np.int64) << 10) | (at - hi).astype(np.int64)


def _unpack(place):
    at = place >> 20
    return at, at - ((place >> 10) & 1023), at - (place & 1023)


def _batch(names, *columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names=names)


ANCHORS = ["deal", "done", "span", "doc", "sub", "place"]


def _groups(texts, length: int, at_once: int):
    """Lists of (row, offset, bytes) of at_once bytes or so; parts of one text share length - 1 bytes, so each window is in one part."""
    group, size = [], 0
    for row, text in enumerate(texts):
        data = text.as_py()
        data = b"" if data is None else data.encode()
        for offset in range(0, max(1, len(data) - length + 1), at_once):
            group.append((row, offset, data[offset : offset + at_once + length - 1]))
            size += len(group[-1][2])
            if size >= at_once:
                yield group
                group, size = [], 0
    if group:
        yield group


def _anchor_rows(length: int, at_once: int):
    def run(batches):
        for batch in batches:
            ids, subs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group in _groups(batch.column(2), length, at_once):
                rows, offsets, parts = zip(*group, strict=True)
                sizes = np.array([len(p) for p in parts])
                ends = np.cumsum(sizes)
                position, lo, hi, rank, span = anchors(np.frombuffer(b"".join(parts), dtype=np.uint8), ends, length)
                if not len(position):
                    continue
                owner = np.searchsorted(ends, position, side="right")
                base = (ends - sizes - np.array(offsets))[owner]
                place = _pack(position - base, lo - base, hi - base)
                doc, sub = (np.array([x[i] for i in rows], dtype=np.int64)[owner] for x in (ids, subs))
                order = np.lexsort((place, sub, doc, span, rank))
                rank, span, doc, sub, place = (x[order] for x in (rank, span, doc, sub, place))
                done = np.zeros(len(rank), dtype=bool)
                done[1:] = (rank[1:] == rank[:-1]) & (span[1:] == span[:-1])
                # settled rows are dealt evenly
                deal = np.where(done, _mix(rank + place.astype(np.uint64) * _ODD[0] + doc.astype(np.uint64) * _ODD[1]), rank)
                yield _batch(ANCHORS, deal.view(np.int64), done, span.view(np.int64), doc, sub, place)

    return run


FOUND = "kind int, doc long, sub long, a long, b long, deal long"


def _found(kind, doc, sub, a, b, deal):
    return _batch(["kind", "doc", "sub", "a", "b", "deal"], np.full(len(doc), kind, dtype=np.int32), doc, sub, a, b, deal)


def _rerank(length: int):
    """From anchors sorted by rank and span: kind 1, removed from a to b; kind 2, open with place a."""

    def run(batches):
        before = None  # (deal, span) of the last row
        held = None  # the last first-of-its-span, until it is known whether its rank has another span
        several = False  # whether held's rank had an earlier span
        for batch in batches:
            deal, done, span, doc, sub, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            if not len(deal):
                continue
            _, lo, hi = _unpack(place[done])
            if done.any():
                yield _found(1, doc[done], sub[done], lo, hi + length, deal[done])
            deal, span, doc, sub, place = (x[~done] for x in (deal, span, doc, sub, place))
            if not len(deal):
                continue
            new = np.ones(len(deal), dtype=bool)
            new[1:] = (deal[1:] != deal[:-1]) | (span[1:] != span[:-1])
            if before is not None:
                new[0] = before != (deal[0], span[0])
            before = (deal[-1], span[-1])
            if not new.all():
                _, lo, hi = _unpack(place[~new])
                yield _found(1, doc[~new], sub[~new], lo, hi + length, deal[~new])
            deal, doc, sub, place = (x[new] for x in (deal, doc, sub, place))
            if not len(deal):
                continue
            if held is not None:
                deal, doc, sub, place = (np.concatenate(([h], x)) for h, x in zip(held, (deal, doc, sub, place), strict=True))
            same = deal[1:] == deal[:-1]
            open_ = np.zeros(len(deal), dtype=bool)
            open_[1:] |= same
            open_[:-1] |= same
            open_[0] |= several and held is not None
            several = bool(same[-1]) if len(same) else several and held is not None
            held = (deal[-1], doc[-1], sub[-1], place[-1])
            open_[-1] = False
            if open_.any():
                yield _found(2, doc[open_], sub[open_], place[open_], place[open_], deal[open_])
        if held is not None and several:
            yield _found(2, *(np.array([x]) for x in (held[1], held[2], held[3], held[3], held[0])))

    return run


def _spans_of(repeats: list[int], length: int) -> list[tuple[int, int]]:
    """Unbroken runs of repeated windows, as bytes."""
    out = []
    for i in repeats:
        if out and i <= out[-1][1]:
            out[-1][1] = i + length
        else:
            out.append([i, i + length])
    return out


def _windows(length: int, kind: str):
    """Per document with its open anchors: the bytes under each (small ranks) or a digest of each window (large ones)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], [], []]
            for i in range(batch.num_rows):
                doc, sub, packed, opens = (batch.column(c)[i].as_py() for c in range(4))
                data = zlib.decompress(packed)
                for anchor in opens:
                    if anchor["big"] != (kind == "big"):
                        continue
                    _, lo, hi = _unpack(anchor["a"])
                    for column, value in zip(out, (anchor["deal"], doc, sub, anchor["a"], data[lo : hi + length]), strict=True) if kind == "small" else ():
                        column.append(value)
                    if kind == "big":
                        for start in range(lo, hi + 1):
                            for column, value in zip(out, (anchor["deal"], doc, sub, start, hashlib.blake2b(data[start : start + length], digest_size=16).digest()), strict=True):
                                column.append(value)
                if len(out[0]) > 20_000:
                    yield _batch(["deal", "doc", "sub", "a", "bytes"], *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary()))
                    out = [[], [], [], [], []]
            yield _batch(["deal", "doc", "sub", "a", "bytes"], *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary()))

    return run


def _compare(length: int):
    """From open anchors sorted by rank, then place: kind 1 for windows whose bytes stood earlier within the rank."""

    def run(batches):
        import pyarrow as pa

        rank, seen = None, set()
        for batch in batches:
            out = [[], [], [], []]
            deals, docs, subs, places = (batch.column(i).to_pylist() for i in range(4))
            for i, (deal, doc, sub, place) in enumerate(zip(deals, docs, subs, places, strict=True)):
                if deal != rank:
                    rank, seen = deal, set()
                data = batch.column(4)[i].as_py()
                _, lo, hi = _unpack(place)
                repeats = []
                for start in range(hi - lo + 1):
                    window = hash_of(data[start : start + length])
                    if window in seen:
                        repeats.append(lo + start)
                    else:
                        seen.add(window)
                for a, b in _spans_of(repeats, length):
                    for column, value in zip(out, (doc, sub, a, b), strict=True):
                        column.append(value)
            yield _batch(["doc", "sub", "a", "b"], *(pa.array(c, pa.int64()) for c in out))

    def hash_of(window: bytes) -> bytes:
        return hashlib.blake2b(window, digest_size=16).digest()

    return run


def _result():
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], [], []]
            for i in range(batch.num_rows):
                doc, packed, spans = (batch.column(c)[i].as_py() for c in range(3))
                data = zlib.decompress(packed)
                kept, at, runs, removed = hashlib.sha256(), 0, 0, 0
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                for a, b in merged:
                    kept.update(data[at:a])
                    at, runs, removed = b, runs + 1, removed + b - a
                kept.update(data[at:])
                for column, value in zip(out, (doc, len(data), removed, runs, kept.hexdigest()), strict=True):
                    column.append(value)
            yield _batch(["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string()))

    return run


def _packed(texts: DataFrame) -> DataFrame:
    """(doc, sub, packed): the texts' bytes compressed for the way through a shuffle."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            packed = pa.array([zlib.compress((t.as_py() or "").encode(), 1) for t in batch.column(2)], pa.binary())
            yield _batch(["doc", "sub", "packed"], batch.column(0), batch.column(1), packed)

    return texts.mapInArrow(run, "doc long, sub long, packed binary")


def repeated_spans(texts: DataFrame, length: int, large: int = LARGE, at_once: int = AT_ONCE) -> DataFrame:
    """(doc, sub, a, b): byte ranges of (doc, sub, text) that are covered by windows of which equal ones start earlier. Ranges may overlap."""
    rows = texts.mapInArrow(_anchor_rows(length, at_once), "deal long, done boolean, span long, doc long, sub long, place long")
    found = rows.repartition("deal").sortWithinPartitions("deal", "done", "span", "doc", "sub", "place").mapInArrow(_rerank(length), FOUND)
    found = staged(found, "suffix-found")
    spans = found.where("kind = 1").select("doc", "sub", "a", "b")
    opens = found.where("kind = 2").select("doc", "sub", "a", "deal")
    by_rank = opens.groupBy("deal").agg(F.count("*").alias("n_open")).where(F.col("n_open") > large)
    any_big = not by_rank.isEmpty()
    if any_big:
        opens = join_groups(opens, by_rank, ["deal"], "n_open", opens.count(), F.struct("doc", "a")).withColumn("big", F.col("n_open").isNotNull())
    else:
        opens = opens.withColumn("big", F.lit(False))
    lists = opens.groupBy("doc", "sub").agg(F.collect_list(F.struct("a", "deal", "big")).alias("opens"))  # bounded by the document's own size
    with_text = _packed(texts).join(lists, ["doc", "sub"]).select("doc", "sub", "packed", "opens")
    windows = "deal long, doc long, sub long, a long, bytes binary"
    small = with_text.mapInArrow(_windows(length, "small"), windows)
    small = small.repartition("deal").sortWithinPartitions("deal", "doc", "sub", "a").mapInArrow(_compare(length), "doc long, sub long, a long, b long")
    spans = spans.unionByName(staged(small, "suffix-small"))
    if any_big:
        big = staged(with_text.mapInArrow(_windows(length, "big"), windows), "suffix-windows")
        first = big.groupBy("bytes").agg(F.min(F.struct("doc", "sub", "a")).alias("first"), F.count("*").alias("n")).where("n > 1")
        again = join_groups(big, first, ["bytes"], "n", big.count(), F.struct("doc", "sub", "a")).where("first is not null").where(F.struct("doc", "sub", "a") != F.col("first"))
        spans = spans.unionByName(again.select("doc", "sub", "a", (F.col("a") + length).alias("b")))
    return spans


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text: str = "text", large: int = LARGE, at_once: int = AT_ONCE) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans and kept_sha256."""
    if length < 2 * RANK or length > 1000:
        raise ValueError(f"length must be from {2 * RANK} to 1000")
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    small_batches(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    repeats = not docs.groupBy(id_col).count().where("count > 1").isEmpty()
    texts = docs.select(key.alias("doc"), (F.xxhash64(text) if repeats else F.lit(0).cast("long")).alias("sub"), F.col(text).alias("text"))
    spans = repeated_spans(texts.distinct() if repeats else texts, length, large, at_once)
    lists = spans.groupBy("doc", "sub").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    both = _packed(texts).join(lists, ["doc", "sub"], "left").select("doc", "packed", "spans")
    out = both.mapInArrow(_result(), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    kind = docs.schema[id_col].dataType
    return out.select(F.when(F.col("id") != -(2**63), F.col("id")).cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
