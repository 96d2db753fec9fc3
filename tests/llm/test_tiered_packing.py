import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import tiered_packing
from spanloom.llm.byte_words import text_slices

from .conftest import ODD, documents


def encoder(path):
    tokenizers = pytest.importorskip("tokenizers")
    found = tokenizers.Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def odd_texts(rng, n=300):
    marks = [" ", "  ", "\n", " \n", "\n\n", "\t", " ", " ", "　", "\x85", "'", "'s", "'ll", ",", ". ", "...", "-", "é", "ñandú", "日本", "a", "Word", "9", "12", "😀", "\x1c", "\x00", "<|endoftext|>", "ß", "ü "]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_chunks_give_the_ids_of_whole_texts(vocabulary_file):
    import pyarrow as pa

    path = vocabulary_file("byte_bpe_50k.json")
    ids_of, memory = encoder(path), tiered_packing.ChunkIds(tiered_packing._tokenizer(path))
    texts = [*odd_texts(random.Random(5)), *ODD]
    for at_once in (1, 200, 4_000_000):
        got = []
        for _, data, bounds in text_slices(pa.array(texts, pa.string()), at_once):
            ids, edges = tiered_packing.slice_ids(memory, data, bounds)
            got += [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        assert got == [ids_of(t) for t in texts]


def padding(sizes):
    return sum(0 if size & (size - 1) == 0 else 1024 - size for size in sizes)


@pytest.mark.parametrize("lengths", [[700] * 50, [1] * 5, list(range(1, 1024)) * 3, [513, 513, 3], [1023], [64] * 7 + [1000] * 9, []])
def test_plan_fills_every_window(lengths):
    counts = dict(Counter(lengths))
    held, found = defaultdict(list), tiered_packing.Placements(tiered_packing.plan(counts))
    for length, count in counts.items():
        for rank in range(count):
            at = 0
            for start, size, window, number, offset in found.of(length, rank):
                assert start == at
                at += size
                held[window, number].append((offset, size))
            assert at == length
    for (window, _), pieces in held.items():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at == window


@pytest.mark.parametrize("at_once", [3, 200_000])
def test_tiered_packing(spark, vocabulary_file, monkeypatch, at_once):
    monkeypatch.setattr(tiered_packing, "NUMBERED_AT_ONCE", at_once)
    path = vocabulary_file("byte_bpe_50k.json")
    ids_of, rng = encoder(path), random.Random(8)
    texts = [*odd_texts(rng, 60), *ODD, *[" ".join(rng.choice(["one", "two", "three,", "vier", "fünf."]) for _ in range(rng.randint(1, 3000))) for _ in range(40)], "word", "word"]
    df = documents(spark, texts).repartition(4).withColumn("_left", F.lit("clash")).withColumn("step", F.lit(1))
    df = df.unionByName(df.where("doc_id = 3"))  # a repeated row
    rows = tiered_packing.tiered_packing(df, path, step=4096).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = np.array([*ids_of(text), 0], dtype="<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert all(r.doc_tokens == len(ids) for r in pieces)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
        if i != 3:
            assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        assert sum(r.length for r in pieces) == len(ids) * (2 if i == 3 else 1)
    steps = Counter()
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].window_size <= 1024
        steps[pieces[0].step] += at
    assert padding(sum(r.length for r in pieces) for pieces in by_sequence.values()) == 0
    assert max(steps.values()) - min(steps.values()) <= 2 * 2048


def test_empty_table(spark, vocabulary_file):
    assert tiered_packing.tiered_packing(documents(spark, []), vocabulary_file("byte_bpe_50k.json")).collect() == []
