import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from spanloom.llm import pii, quality_rules

from .conftest import ODD, documents
from .test_corpus_ops import plain_components
from .test_text_ops import plain_best_fit, plain_metrics


def plain_quality(text):
    n, chars, symbols, dup_lines, repeats = plain_metrics(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stops = {w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")} & set(quality_rules.STOP_WORDS)
    return n >= 50 and 100 * repeats <= 50 * n and 100 * symbols <= 10 * n and 2 * n <= chars <= 15 * n and 2 * dup_lines <= len(lines) and len(stops) >= 2


def corpus():
    rng = random.Random(13)
    vocabulary = ["the", "of", "and", *(f"word{i}" for i in range(300))]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = list(ODD)
    for _ in range(12):
        base = make(rng.randint(60, 200))
        texts.append(" ".join(base))
        texts += ["  ".join(base), "\n".join(base)]
        near = list(base)
        near[3] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(make(80)) + " write me@x.org or +1 (212) 555-0100 " + " ".join(make(5)) for _ in range(5)]
    texts += ["the of # " * 60, "short the of"]
    return texts


def test_stages_against_plain_steps(spark, tmp_path, vocabulary_file):
    tokenizers = pytest.importorskip("tokenizers")
    texts = corpus()
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    kept = {i: t for i, t in enumerate(texts) if plain_quality(t)}
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t) for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if i == min((j for j in kept if norm[j] == norm[i]), key=lambda j: (-len(kept[j]), j))}
    ids = sorted(kept)
    least = plain_components([kept[i] for i in ids])
    kept = {i: pii.mask(kept[i]) for k, i in enumerate(ids) if least[k][1] == k}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in kept.items()}

    library = tokenizers.Tokenizer.from_file(vocabulary_file("word_bpe_49k.json"))
    wanted = []
    for i, t in kept.items():
        part = np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        wanted.append((i, 0, 0, len(part), zlib.crc32(part.tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(wanted)
    assert len({r.sequence_id for r in got}) == plain_best_fit([w[3] for w in wanted], 4096)


def test_repeated_rows_and_empty_tables(spark):
    docs = documents(spark, ["the of " + " ".join(f"w{i}" for i in range(80))])
    twice = docs.unionAll(docs)
    for _, stage in corpus_pipeline.STAGES[:3]:
        twice = stage(spark, twice, "")
    assert twice.count() == 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_near_copies_where_ids_repeat(spark):
    rng = random.Random(4)
    make = lambda: [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    base, other, third = make(), make(), make()
    copy = lambda words, i: " ".join([*words[:i], "changed", *words[i + 1 :]])
    rows = [(1, " ".join(base)), (2, copy(base, 5)), (2, " ".join(other)), (3, copy(other, 7)), (None, copy(base, 9)), (None, " ".join(third)), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, "").collect()), key=repr)
    assert kept == sorted([(1, " ".join(base)), (2, " ".join(other)), (None, " ".join(third)), (4, None), (4, None), (5, "")], key=repr)
