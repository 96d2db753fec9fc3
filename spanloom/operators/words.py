"""Word streams: explode, frequencies, anchors, n-grams, bands."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from heapq import nlargest
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NEVER_ANCHORS, explode_tokens, nfkc, normalize, tokens
from .sentences import split_sentences


_NEVER = frozenset(NEVER_ANCHORS)


def explode_words(transcripts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, text, norm, start, end) of transcripts with an array `words`; each word is normalised once and stays one entry."""
    w = transcripts.select(id_col, F.posexplode("words").alias("pos", "w"))
    return w.select(id_col, "pos", F.col("w.text").alias("text"), normalize(nfkc(F.col("w.text"))).alias("norm"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def token_frequency(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, token, n)"""
    return explode_tokens(docs, id_col, text).groupBy(id_col, "token").agg(F.count("*").alias("n"))


def token_idf(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, token, idf) with idf = 1 / (1 + share of the token in its document). One shuffle, of texts by id; a task counts one document at a time."""

    def count(texts):
        n = Counter(t for (tokens_of,) in texts for t in tokens_of)
        every = sum(n.values())
        return [(t, 1.0 / (1.0 + k / every)) for t, k in n.items()]

    return map_documents(docs.select(id_col, text), id_col, [tokens(F.col(text)).alias("_tokens")], "token string, idf double", count)


def map_documents(docs: DataFrame, id_col: str, columns: list, schema: str, work) -> DataFrame:
    """(id, columns of schema): the rows that work() gives for each id's list of tuples of columns, a tuple a text. Texts are shuffled and sorted by id; a task
    holds one id's values and one Arrow batch."""
    import pyarrow as pa

    kind = docs.schema[id_col].dataType.simpleString()
    ordered = docs.repartition(id_col).sortWithinPartitions(id_col).select(id_col, *columns)

    def run(batches):
        # the types of ids and of results, from what comes in and from the schema's few names
        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        fields = [f.strip().split(" ") for f in schema.split(",")]
        out, id_type = [[] for _ in range(len(fields) + 1)], None

        def made():
            full = pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out, [id_type, *(types[t] for _, t in fields)], strict=True)], names=[id_col, *(n for n, _ in fields)])
            for v in out:
                v.clear()
            return full

        def texts():
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(0).type
                for i in range(batch.num_rows):
                    yield tuple(c[i].as_py() for c in batch.columns)

        for doc, rows in groupby(texts(), key=lambda r: r[0]):
            for r in work([r[1:] for r in rows]):
                for v, x in zip(out, (doc, *r), strict=True):
                    v.append(x)
            if len(out[0]) >= 20_000:
                yield made()
        if out[0]:
            yield made()

    return ordered.mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def _sentence_tokens(text: str):
    return F.transform(split_sentences(F.col(text)), tokens).alias("_sentences")


def _may_anchor(token: str) -> bool:
    return (token[0].isdecimal() or len(token) >= 5) and token.lower() not in _NEVER


def _anchors(texts: list[list[list[str]]], most: int) -> dict[int, list[tuple[float, int, str]]]:
    """By idx from 1 the (score, pos, token) of anchors(), best first, of one id's texts as lists of sentences as lists of tokens."""
    n = Counter(t for sentences in texts for s in sentences for t in s)
    every, found = sum(n.values()), {}
    for sentences in texts:
        for idx, s in enumerate(sentences, start=1):
            found.setdefault(idx, []).extend((1.0 / (1.0 + n[t] / every) + t[0].isdecimal(), pos, t) for pos, t in enumerate(s) if _may_anchor(t))
    return {idx: nlargest(most, rows) for idx, rows in found.items()}


def anchors(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """(id, idx, pos, token, score): up to three telling tokens of each sentence.

    Numbers and tokens of five letters or more that are not stop words, by score, then the later position.
    One shuffle, of texts by id; a task looks at one document at a time.
    """

    def work(texts):
        return [(idx, pos, t, score) for idx, rows in _anchors([sentences for (sentences,) in texts], most).items() for score, pos, t in rows]

    return map_documents(docs.select(id_col, text), id_col, [_sentence_tokens(text)], "idx int, pos int, token string, score double", work)


def ngrams(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, pos, bigram, two, three): each token with its followers, apart and run together; null at the end."""
    order = Window.partitionBy(id_col).orderBy("pos")
    after, second = F.lead("token", 1).over(order), F.lead("token", 2).over(order)
    return explode_tokens(docs.select(id_col, text).repartition(id_col), id_col, text).select(id_col, "pos", F.concat("token", F.lit(" "), after).alias("bigram"), F.concat("token", after).alias("two"), F.concat("token", after, second).alias("three"))


def derived_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", per_letter: int = 60, gap: int = 40) -> DataFrame:
    """(id, pos, word, start_ms, end_ms): a time line from the text alone, for texts without a recording. Rows are one text each, dealt out once; no word is shuffled or sorted."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                listed = part.column(1).flatten()
                sizes = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                took = pc.utf8_length(listed).to_numpy(zero_copy_only=False).astype(np.int64) * per_letter + gap
                ends, before = np.cumsum(took), np.cumsum(sizes) - sizes
                ends -= np.repeat(np.concatenate([[0], ends])[before], sizes)
                pos = np.arange(len(took)) - np.repeat(before, sizes)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), sizes)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(pos.astype(np.int32)), listed, pa.array(ends - took), pa.array(ends)], names=[id_col, "pos", "word", "start_ms", "end_ms"])

    rows = docs.select(id_col, text).repartition(id_col).select(id_col, tokens(F.col(text)).alias("_tokens"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, pos int, word string, start_ms long, end_ms long")


def band_candidates(sentences: DataFrame, words: DataFrame, id_col: str, gap: int = 10) -> DataFrame:
    """(id, idx, start, end): spans that start on a word equal to a sentence's first token, with ends up to gap off the expected one.

    The start is an equi-join; the band is a generated sequence, not a range join.
    """
    first = sentences.select(id_col, "idx", F.get("tokens", F.lit(0)).alias("word"), F.size("tokens").alias("n"))
    counts = words.groupBy(id_col).agg(F.count("*").alias("n_words"))
    met = first.join(words.select(id_col, "word", F.col("pos").alias("start")), [id_col, "word"]).join(counts, id_col)
    low = F.greatest(F.col("start"), F.col("start") + F.col("n") - 1 - gap)
    high = F.least(F.col("n_words").cast("int") - 1, F.col("start") + F.col("n") - 1 + gap)
    return met.where(low <= high).select(id_col, "idx", "start", F.explode(F.sequence(low, high)).alias("end"))


def anchor_ranges(docs: DataFrame, id_col: str = "doc_id", text: str = "text", reach: int = 500, most: int = 3) -> DataFrame:
    """(id, idx, low, high, n_found): first and last place of a sentence's anchors among the `reach` words from its own start, and how many are there.

    A sentence of more words is looked up in all of its own; one without an anchor in reach has no row. A token's places are sorted, so
    a sentence finds the first and the last in its range by bisection. Texts are shuffled once, by id; a task looks at one document at a time.
    """

    def work(texts):
        sentences, places, sizes = [s for s, _ in texts], {}, {}
        for _, stream in texts:
            for at, t in enumerate(stream):
                places.setdefault(t, []).append(at)
        if len(texts) > 1:
            places = {t: sorted(at) for t, at in places.items()}
        for s in sentences:
            for idx, t in enumerate(s, start=1):
                sizes.setdefault(idx, []).append(len(t))
        out, before, found = [], 0, _anchors(sentences, most)
        for idx in sorted(sizes):
            before += sum(sizes[idx])
            low, high, met = [], [], set()
            for n in sizes[idx]:
                start = before - n
                for t in {t for _, _, t in found[idx]}:
                    at = places.get(t, ())
                    first, behind = bisect_left(at, start), bisect_left(at, start + max(n, reach))
                    if first < behind:
                        low.append(at[first])
                        high.append(at[behind - 1])
                        met.add(t)
            if met:
                out.append((idx, min(low), max(high), len(met)))
        return out

    return map_documents(docs.select(id_col, text), id_col, [_sentence_tokens(text), tokens(F.col(text)).alias("_tokens")], "idx int, low int, high int, n_found long", work)


def vocabulary_matches(vocabulary: DataFrame, cutoff: float = 92.0, longest: int = 26) -> DataFrame:
    """(a, b, ratio): pairs a < b of distinct tokens with an indel ratio of at least cutoff, by equal remains after deletions.

    Tokens whose ratio reaches the cutoff share a common subsequence that each reaches by few deletions; all
    remains of so many deletions are generated and met by an equi-join. Tokens over `longest` letters would have too many
    remains: they meet through equal parts, of which one must survive so many deletions whole.
    """
    from ..functions.similarity import indel_ratio, may_reach

    lost = (100.0 - cutoff) / 100.0
    # a ratio of c needs i deletions of a with 2k / (2k + i) >= c, k = len - i
    share = 2 * lost / (1 + lost)
    words = vocabulary.select("token").distinct().withColumn("n", F.length("token"))
    levels = [F.array("token")]
    for i in range(1, int(longest * share) + 1):
        shorter = F.array_distinct(F.flatten(F.transform(levels[-1], lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda j: F.concat(F.substr(s, F.lit(1), j - 1), F.substr(s, j + 1))))))
        levels.append(F.when(F.col("n") * share >= i, shorter).otherwise(F.array().cast("array<string>")))
    short = words.where(F.col("n") <= longest).select("token", F.explode(F.array_distinct(F.flatten(F.array(*levels)))).alias("key"))
    # long tokens, and those short enough to meet them: every substring of the size of one of the long one's parts
    part = lambda n: F.greatest(F.lit(1), F.floor(n / (F.floor(n * share) * 2 + 2)).cast("int"))
    long = words.where(F.col("n") > longest)
    pieces = long.select("token", "n", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.col("n") / part(F.col("n"))).cast("int") - 1), lambda i: F.substr(F.col("token"), i * part(F.col("n")) + 1, part(F.col("n"))))).alias("key"))
    reach = F.filter(F.sequence(F.floor(F.col("n") * 0.8).cast("int"), F.ceil(F.col("n") * 1.25).cast("int")), lambda m: m > longest)
    near = words.select("token", "n", F.explode(F.array_distinct(F.transform(reach, lambda m: part(m)))).alias("size")).where("n >= size")
    grams = near.select("token", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1), lambda i: F.substr(F.col("token"), i, F.col("size")))).alias("key")).distinct()
    pair = lambda x, y: x.select(F.col("token").alias("x"), "key").join(y.select(F.col("token").alias("y"), "key"), "key").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    met = pair(short, short).unionByName(pair(pieces.select("token", "key"), grams)).where("a < b").distinct()
    met = met.where(may_reach(F.col("a"), F.col("b"), cutoff))
    return met.withColumn("ratio", indel_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= cutoff)
