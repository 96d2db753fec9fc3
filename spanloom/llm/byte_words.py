"""Words of many texts at once: Arrow buffers cut by classes of bytes, without a Python object for each word.

All marks that cut are ASCII, so UTF-8 can be cut byte by byte.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Bytes of text that are cut together; a longer text is cut alone.
AT_ONCE = 4_000_000
#: Rows and bytes of a batch that a task gives out.
ROWS_OUT, BYTES_OUT = 100_000, 32_000_000

WORD, GAP, BREAK = 0, 1, 2
#: A-Z as a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """names: the distinct words, as bytes; for each word in order its number in names, its row, and the number of breaks before it."""

    names: pa.Array
    codes: np.ndarray
    rows: np.ndarray
    parts: np.ndarray


def text_slices(texts: pa.Array, at_once: int = AT_ONCE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where each row begins, and the end) of runs of rows of at most at_once bytes; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + at_once, side="right")) - 1)
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings data[offsets[i]:offsets[i + 1]] and, for each i, its number among them."""
    if len(offsets) < 2:
        return pa.array([], pa.large_binary()), np.zeros(0, dtype=np.int64)
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    found = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64)


def words(data: np.ndarray, bounds: np.ndarray, kinds: np.ndarray) -> Words:
    """The maximal runs of bytes of kind WORD in each row, A-Z lower-cased."""
    kind = kinds[data]
    inside = kind == WORD
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = bounds[1:-1]
    edges = edges[edges < len(data)]
    starts[edges] = inside[edges]
    held = LOWER[data[inside]]
    names, codes = encoded(held, np.append(np.flatnonzero(starts[inside]), len(held)) if len(held) else np.zeros(0))
    where = np.flatnonzero(starts)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(where, bounds)))
    return Words(names, codes, rows, np.searchsorted(np.flatnonzero(kind == BREAK), where))


def as_bytes(values: pa.Array) -> list[bytes]:
    """A large_binary array without nulls as Python bytes."""
    _, offsets, data = values.buffers()
    cuts = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1].tolist() if len(values) else [0]
    return list(map((data.to_pybytes() if data is not None else b"").__getitem__, map(slice, cuts[:-1], cuts[1:])))


def strings(values: pa.Array) -> pa.Array:
    """Bytes that are UTF-8 as strings."""
    return values.view(pa.large_string()) if values.type == pa.large_binary() else values


def map_batches(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[list]]]) -> DataFrame:
    """mapInArrow over columns: make() gives, once a task, a function from a batch to lists of columns. After the last batch it is called with None."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def parted(columns):
        size = len(columns[0])
        sizes = sum(np.diff(np.frombuffer(c.buffers()[1], dtype=np.int64)[c.offset : c.offset + size + 1]) for c in columns if isinstance(c, pa.LargeStringArray) and size)
        ends = np.cumsum(sizes) if isinstance(sizes, np.ndarray) else np.zeros(size, dtype=np.int64)
        first = 0
        while first < size:
            before = ends[first - 1] if first else 0
            last = min(first + ROWS_OUT, max(first + 1, int(np.searchsorted(ends, before + BYTES_OUT, side="right"))))
            yield pa.RecordBatch.from_arrays([c.slice(first, last - first).cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)
            first = last

    def run(batches):
        work = make()
        gc.disable()  # memories of many parts, without cycles, would be searched for cycles over and over
        try:
            for batch in batches:
                for columns in work(batch):
                    yield from parted([c if isinstance(c, pa.Array) else pa.array(c) for c in columns])
            for columns in work(None):
                yield from parted([c if isinstance(c, pa.Array) else pa.array(c) for c in columns])
        finally:
            gc.enable()

    small_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)
