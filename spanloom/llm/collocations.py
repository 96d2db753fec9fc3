"""Phrase collocations: n-grams of 1 to max_n words as rows, counted by hash aggregation per language, scored against their parts.

Each task cuts its texts into words and gives out the n-grams of a batch as rows (language, phrase, occurrences), added up within the
batch; Spark adds them up per language and phrase. A phrase occurs no more often than any of its parts, so the n-grams go out
in levels: all words; pairs of words that are both frequent enough; longer n-grams whose pairs all are. What is
frequent enough is told by a filter of hash bits of bounded size, sent to all tasks: it may let a rare n-gram through, to be
counted and found rare, and never holds back a frequent one, so counts are exact whatever its size. The parts of a candidate are as
frequent as itself, so l and r are joined from the table of frequent phrases; scores are whole-number division of decimals. A phrase inside
a longer candidate lies inside one that is one word longer and at least as frequent as that, so only extensions by one word are
looked at. Ranks are taken in parts of a language first, then among the leaders of its parts.

Defined results: null counts as the empty text and gives no words; a null language is `und`; repeated rows count as often as they
stand there; equal scores go by frequency, then by phrase in byte order; a text may be any length, and so may a word; an
empty table gives no rows; columns beside language and text are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_words import BREAK, GAP, as_bytes, map_batches, strings, text_slices, words
from .common import join_groups, staged

#: Marks between pieces, and white space between words.
PIECE_MARKS, WORD_GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[list(PIECE_MARKS)], KINDS[list(WORD_GAPS)] = BREAK, GAP

#: Bits a phrase in the filter of frequent phrases, and the most bits of all (64 MB), beyond which it holds back less.
BITS_A_PHRASE, MOST_BITS = 16, 29
#: Candidates of a language that are ranked in one task, in the mean.
RANKED_AT_ONCE = 200_000

_MIX, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(names: list[bytes], lang: str) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in names), dtype=np.uint64, count=len(names))


def phrase_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """The hash of each phrase, of the hashes of its first words, second words and so on."""
    found = parts[0]
    for part in parts[1:]:
        found = found * _MIX + part
    return (found ^ (found >> np.uint64(31))) * _LAST


class PhraseFilter:
    """Hash bits of phrases: says no only of phrases that aren't among them."""

    def __init__(self, slots: np.ndarray, bits: int):
        self.slots, self.bits = slots, bits

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        return (self.slots[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def phrase_filter(phrases: DataFrame) -> PhraseFilter:
    """Of a table (_lang, phrase) whose phrases all have as many words. The driver gets at most 2^MOST_BITS / 64 rows of 16 bytes."""
    bits = max(12, min(MOST_BITS, math.ceil(math.log2(1 + BITS_A_PHRASE * phrases.count()))))
    empty = PhraseFilter(np.zeros(1 << (bits - 6), dtype=np.uint64), bits)

    def make():
        def work(batch):
            if batch is None or not batch.num_rows:
                return
            langs = batch.column(0).to_pylist()
            order = sorted(range(len(langs)), key=langs.__getitem__)
            found = [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
            hashes, first = [], 0
            while first < len(order):
                last = first
                while last < len(order) and langs[order[last]] == langs[order[first]]:
                    last += 1
                group = [found[i] for i in order[first:last]]
                hashes.append(phrase_hashes([word_hashes(list(part), langs[order[first]]) for part in zip(*group, strict=True)]))
                first = last
            at = PhraseFilter(empty_slots, bits).places(np.concatenate(hashes))
            yield [(at >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64)]

        return work

    empty_slots = np.zeros(0, dtype=np.uint64)
    rows = map_batches(phrases, ["_lang", "phrase"], "slot long, bits long", make)
    got = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    empty.slots[got["slot"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return empty


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key stands first, and how often it stands."""
    _, first, counts = np.unique(keys, return_index=True, return_counts=True)
    return first, counts


def _phrases(names: pa.Array, codes: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    parts = [names.take(pa.array(codes[at + i])) for i in range(size)]
    return strings(pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if size > 1 else parts[0])


def ngrams(texts: DataFrame, sizes: range, kept: PhraseFilter | None = None) -> DataFrame:
    """(_lang, phrase, size, a) of texts (_lang, _text): n-grams of the sizes by the batches they stand in, added up in each.

    With sizes from 2 on, kept holds words; with sizes from 3 on, pairs of words.
    """
    known = texts.sparkSession.sparkContext.broadcast((kept.slots, kept.bits)) if kept else None
    least = sizes[0]

    def grams(lang, data, bounds):
        names, codes, rows, parts = words(data, bounds, KINDS)
        if not len(codes):
            return
        if least == 1:
            counts = np.bincount(codes, minlength=len(names))
            yield names, None, counts, 1
            return
        filter_ = PhraseFilter(*known.value)
        hashes = word_hashes(as_bytes(names), lang)
        together = (rows[1:] == rows[:-1]) & (parts[1:] == parts[:-1])
        if least == 2:
            usual = filter_.may_hold(phrase_hashes([hashes]))[codes]
            together &= usual[1:] & usual[:-1]
        at = np.flatnonzero(together)
        keys = codes[at] * len(names) + codes[at + 1]
        if least > 2:  # a pair is looked up once for all its occurrences
            distinct, numbers = np.unique(keys, return_inverse=True)
            usual = filter_.may_hold(phrase_hashes([hashes[distinct // len(names)], hashes[distinct % len(names)]]))[numbers]
            at, keys = at[usual], numbers[usual]
        size = 2
        while len(at):
            if size in sizes:
                first, counts = _counts(keys)
                yield names, _phrases(names, codes, at[first], size), counts, size
            size += 1
            if size > sizes[-1]:
                break
            # an n-gram is one word longer than that before it where the next n-gram of this size begins at the next word
            longer = np.flatnonzero(at[1:] == at[:-1] + 1)
            keys = np.unique(keys, return_inverse=True)[1][longer] * len(names) + codes[at[longer] + size - 1]
            at = at[longer]

    def make():
        def work(batch):
            if batch is None or not batch.num_rows:
                return
            langs = batch.column(0).dictionary_encode()
            langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).filter(pc.equal(langs.indices, number))
                for _, data, bounds in text_slices(texts):
                    for names, phrases, counts, size in grams(lang, data, bounds):
                        phrases = strings(names) if phrases is None else phrases
                        same = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(counts), dtype=np.int32)), pa.array([lang])).cast(pa.string())
                        yield [same, phrases, np.full(len(counts), size, dtype=np.int32), counts.astype(np.int64)]

        return work

    return map_batches(texts, ["_lang", "_text"], "_lang string, phrase string, size int, a long", make)


def counted(texts: DataFrame, sizes: range, kept: PhraseFilter | None = None) -> DataFrame:
    return ngrams(texts, sizes, kept).groupBy("_lang", "phrase", "size").agg(F.sum("a").alias("a"))


def _joined(cuts: DataFrame, phrases: DataFrame, part: str, count: str, total: int) -> DataFrame:
    """cuts with the frequency of their column part, also where many cuts share one part."""
    sizes = cuts.groupBy("_lang", part).agg(F.count("*").alias("_size"))
    parts = phrases.select("_lang", F.col("phrase").alias(part), F.col("a").alias(count))
    groups = sizes.join(parts, ["_lang", part])
    return join_groups(cuts, groups, ["_lang", part], "_size", total, F.col("phrase")).drop("_size")


def score():
    """Of the columns a, l and r; exact beyond 64 bits, and at most 1000000 as l and r are at least a."""
    return F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, covered: int = 80, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of 2 to max_n words of each language.

    Phrases occur at least `least` times. covered: a phrase goes if a longer candidate around it occurs that many percent as often.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), F.col(text).alias("_text"))
    every = staged(counted(texts, range(1, 2)), "colloc-words")
    usual = [every.where(F.col("a") >= least)]
    if max_n >= 2:
        usual.append(staged(counted(texts, range(2, 3), phrase_filter(usual[0])).where(F.col("a") >= least), "colloc-pairs"))
    if max_n >= 3:
        usual.append(staged(counted(texts, range(3, max_n + 1), phrase_filter(usual[1])).where(F.col("a") >= least), "colloc-longer"))
    phrases = usual[0]
    for more in usual[1:]:
        phrases = phrases.unionByName(more)

    candidates = phrases.where("size >= 2")
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.withColumn("_head", F.expr("substring_index(phrase, ' ', k)")).withColumn("_tail", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = staged(cuts, "colloc-cuts")
    total = cuts.count()
    scored = _joined(_joined(cuts, phrases, "_head", "l", total), phrases, "_tail", "r", total)
    lowest = F.min(F.struct(score().alias("score"), "k", "l", "r"))
    scored = scored.groupBy("_lang", "phrase", "a").agg(lowest.alias("_cut"))

    longer = candidates.where("size >= 3").select("_lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
    longer = longer.groupBy("_lang", "phrase").agg(F.max("a").alias("_longer"))
    hidden = F.expr(f"100 * cast(_longer as decimal(19, 0)) >= {int(covered)} * cast(a as decimal(19, 0))")
    left = scored.join(longer.withColumnRenamed("_lang", "_l").withColumnRenamed("phrase", "_p"), (F.col("_lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")) & hidden, "left_anti")
    left = staged(left.select("_lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score"), "colloc-scored")

    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = 1 + left.count() // RANKED_AT_ONCE
    left = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("_lang", "_part").orderBy(*best))).where(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("_lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    sizes = every.groupBy("_lang").agg(F.sum("a").alias("n"))
    return left.join(sizes, "_lang").select(F.col("_lang").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
