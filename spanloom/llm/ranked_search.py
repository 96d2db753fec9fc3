"""Ranked lexical search of a stated query set against all documents, seeded by thresholds.

The index has one row a document: its number of terms, and the counts of those that queries ask for. From it come, per term, how many
documents hold it, its greatest part of a score and its k-th greatest. An item's k-th score is at least the k-th impact of any of
its terms, as so many documents reach that by this term alone; the best of these is the item's threshold. With an item's terms
in falling order of their greatest impacts, the terms behind the point where the sum of all that follow is below the threshold can't carry a
document alone: they are pruned from the candidate join. Documents whose sum over the other terms, and the bound of the pruned
ones, reaches the threshold are candidates; only for them the pruned terms are looked up, and the score is exact. Each task keeps k documents an
item, which raises its threshold as it goes; the last ranking is over these.

The index is narrow, stays where it was written and isn't shuffled; queries are sent to it in blocks of bounded size.

Defined results: null counts as the empty text and has no terms; items without terms, and documents without any, are in no result; rows
that share an item's id are one item, with the terms of all; repeated documents are ranked each for itself; equal scores
go by ascending id, null first; a text may be any length; empty tables give no rows; columns beside id and text are left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_words import GAP, as_bytes, map_batches, strings, text_slices, words
from .collocations import PhraseFilter, phrase_filter, phrase_hashes, word_hashes
from .common import staged

#: ASCII letters, digits and all bytes beyond ASCII are in terms.
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = GAP
#: Rows (item, term) of a block of queries, in the mean.
BLOCK = 100_000
#: Sums of documents and items that a task holds at once.
CELLS = 2_000_000


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(_item, phrase) of the items, each term once."""
    kind = items.schema[item_id].dataType.simpleString()

    def make():
        def work(batch):
            if batch is None or not batch.num_rows:
                return
            for first, data, bounds in text_slices(batch.column(1)):
                names, codes, rows, _ = words(data, bounds, KINDS)
                if len(codes):
                    found = np.unique(rows * len(names) + codes)
                    yield [batch.column(0).take(pa.array(first + found // len(names))), strings(names.take(pa.array(found % len(names))))]

        return work

    return map_batches(items, [item_id, text], f"_item {kind}, phrase string", make).distinct()


def document_index(docs: DataFrame, asked: PhraseFilter, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: _doc, n (terms with repeats), and terms and tfs of those that asked may hold."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((asked.slots, asked.bits))

    def make():
        filter_ = PhraseFilter(*sent.value)

        def work(batch):
            if batch is None or not batch.num_rows:
                return
            for first, data, bounds in text_slices(batch.column(1)):
                names, codes, rows, _ = words(data, bounds, KINDS)
                size = len(bounds) - 1
                kept = filter_.may_hold(phrase_hashes([word_hashes(as_bytes(names), "")]))[codes]
                keys, counts = np.unique(rows[kept] * max(1, len(names)) + codes[kept], return_counts=True)
                rows_of, codes_of = np.divmod(keys, max(1, len(names)))
                ends = pa.array(np.searchsorted(rows_of, np.arange(size + 1)).astype(np.int32))
                terms = pa.ListArray.from_arrays(ends, strings(names.take(pa.array(codes_of))).cast(pa.string()))
                tfs = pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64)))
                yield [batch.column(0).slice(first, size), np.bincount(rows, minlength=size).astype(np.int64), terms, tfs]

        return work

    return map_batches(docs, [id_col, text], f"_doc {kind}, n long, terms array<string>, tfs array<long>", make)


def term_table(index: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    """phrase, df, w, and the greatest and the k-th greatest part (null if fewer documents) that the term has in a document's score.

    Documents are added up by term and part before parts are ordered, and parts are whole numbers below a million, so a term that all
    documents hold is a bounded group.
    """
    held = index.select("n", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(F.col("t.terms").alias("phrase"), F.col("t.tfs").alias("tf"), "n")
    parts = held.select("phrase", part_of(documents, length).alias("part")).groupBy("phrase", "part").agg(F.count("*").alias("c"))
    reached = F.sum("c").over(Window.partitionBy("phrase").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("reached", reached)
    found = parts.groupBy("phrase").agg(F.sum("c").alias("df"), F.max("part").alias("top"), F.max(F.when(F.col("reached") >= k, F.col("part"))).alias("kth"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1)))
    return found.withColumn("w", weight.cast("long"))


def part_of(documents: int, length: int):
    """A term's part of the score, without its weight, of its count tf in a document of n terms."""
    m = f"(50 + (50 * n * {documents}L) div {length}L)"
    return F.expr(f"(1000000000L * tf) div (1000 * tf + 20 * {m})")


def seeded(terms: DataFrame, table: DataFrame) -> DataFrame:
    """terms with w, the item's threshold, whether the term finds candidates, and the bound of all terms that don't."""
    found = terms.join(table, "phrase").withColumn("_most", F.col("w") * F.col("top"))
    item = Window.partitionBy("_item")
    onwards = item.orderBy(F.col("_most").desc(), "phrase").rowsBetween(0, Window.unboundedFollowing)
    found = found.withColumn("_seed", F.coalesce(F.max(F.col("w") * F.col("kth")).over(item), F.lit(0)))
    found = found.withColumn("_finds", F.sum("_most").over(onwards) >= F.col("_seed"))
    return found.withColumn("_rest", F.coalesce(F.sum(F.when(~F.col("_finds"), F.col("_most"))).over(item), F.lit(0)))


class QueryBlock:
    """A block of seeded terms: for each term the items that ask for it, by whether it finds candidates there."""

    def __init__(self, rows: list[tuple]):
        # rows (item number, term, w, finds, seed, rest)
        self.numbers = {term: i for i, term in enumerate(sorted({r[1] for r in rows}))}
        size = 1 + max(r[0] for r in rows)
        self.seed, self.rest = np.zeros((2, size), dtype=np.int64)
        for item, _, _, _, seed, rest in rows:
            self.seed[item], self.rest[item] = seed, rest
        self.finding, self.pruned = (self._lists([r for r in rows if r[3] is finds]) for finds in (True, False))

    def _lists(self, rows):
        rows = sorted((self.numbers[term], item, w) for item, term, w, *_ in rows)
        terms, items, weights = np.array(rows, dtype=np.int64).reshape(-1, 3).T
        counts = np.bincount(terms, minlength=len(self.numbers))
        return np.cumsum(counts) - counts, counts, items, weights

    def add(self, lists, sums, docs, terms, parts):
        """Adds w * part of the terms' items to sums (documents x items, flat)."""
        starts, counts, items, weights = lists
        times = counts[terms]
        total = times.sum()
        if total:
            ends = np.cumsum(times)
            at = np.arange(total) + np.repeat(starts[terms] - ends + times, times)
            np.add.at(sums, np.repeat(docs, times) * len(self.seed) + items[at], weights[at] * np.repeat(parts, times))


def best_in_tasks(index: DataFrame, block: list[tuple], ids: list, item_kind: str, documents: int, length: int, k: int) -> DataFrame:
    """(_item, _doc, score): of every task at most k documents an item, among them all that are in the item's result."""
    sent = index.sparkSession.sparkContext.broadcast((block, ids))
    kind = index.schema["_doc"].dataType.simpleString()

    def make():
        rows, ids = sent.value
        queries = QueryBlock(rows)
        bar, held = queries.seed.copy(), []
        items = len(bar)

        def leaders():
            """The k best of each item, which raise its bar when there are k."""
            every = pa.concat_tables(held)
            every = every.take(pc.sort_indices(every, sort_keys=[("item", "ascending"), ("score", "descending"), ("doc", "ascending")], null_placement="at_start"))
            item = every["item"].to_numpy()
            turn = np.arange(len(item)) - np.searchsorted(item, item)
            last = turn == k - 1
            bar[item[last]] = np.maximum(bar[item[last]], every["score"].to_numpy()[last])
            held[:] = [every.filter(pa.array(turn < k))]

        def search(doc_ids, n, ends, terms, tfs):
            docs = np.repeat(np.arange(len(n)), np.diff(ends))
            known = terms >= 0
            docs, terms, tfs = docs[known], terms[known], tfs[known]
            parts = 1_000_000_000 * tfs // (1000 * tfs + 20 * (50 + 50 * n[docs] * documents // length))
            sums = np.zeros(len(n) * items, dtype=np.int64)
            queries.add(queries.finding, sums, docs, terms, parts)
            found = np.flatnonzero(sums)
            found = found[sums[found] + queries.rest[found % items] >= bar[found % items]]
            if not len(found):
                return
            open_ = np.zeros(len(n), dtype=bool)
            open_[found // items] = True
            wanted = open_[docs]
            queries.add(queries.pruned, sums, docs[wanted], terms[wanted], parts[wanted])
            found = found[sums[found] >= np.maximum(1, bar[found % items])]
            held.append(pa.table({"item": found % items, "score": sums[found], "doc": doc_ids.take(pa.array(found // items))}))
            leaders()

        def work(batch):
            if batch is None:
                if held:
                    yield [pa.array(ids).take(held[0]["item"].combine_chunks()), held[0]["doc"].combine_chunks(), held[0]["score"].combine_chunks()]
                return
            each = max(1, CELLS // items)
            for first in range(0, batch.num_rows, each):
                part = batch.slice(first, each)
                terms, tfs = part.column(2), part.column(3)
                ends = terms.offsets.to_numpy() - terms.offsets[0].as_py()
                names = terms.flatten().dictionary_encode()
                numbers = np.array([queries.numbers.get(name, -1) for name in names.dictionary.to_pylist()], dtype=np.int64)
                codes = names.indices.to_numpy()
                search(part.column(0), part.column(1).to_numpy(), ends, numbers[codes] if len(codes) else np.zeros(0, dtype=np.int64), tfs.flatten().to_numpy())

        return work

    return map_batches(index, ["_doc", "n", "terms", "tfs"], f"_item {item_kind}, _doc {kind}, score long", make)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item, with score above 0."""
    spark = docs.sparkSession
    item_kind = items.schema[item_id].dataType.simpleString()
    terms = staged(item_terms(items, item_id, item_text), "search-terms")
    asked = phrase_filter(terms.select(F.lit("").alias("_lang"), "phrase").distinct())
    index = staged(document_index(docs, asked, id_col, text), "search-index")
    documents, length = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = spark.createDataFrame([], f"_item {item_kind}, _doc {index.schema['_doc'].dataType.simpleString()}, score long")
    if documents:
        table = term_table(index, documents, length, k)
        blocks = 1 + terms.count() // BLOCK
        ready = seeded(terms, table).select("_item", "phrase", "w", "_finds", "_seed", "_rest", F.pmod(F.xxhash64("_item"), F.lit(blocks)).alias("_block"))
        ready = staged(ready, "search-seeded")
        made = []
        for block in range(blocks):
            rows = [tuple(r)[:-1] for r in ready.where(F.col("_block") == block).collect()]  # of bounded size, whatever the number of documents
            if rows:
                ids = sorted({r[0] for r in rows}, key=lambda i: (i is not None, i))
                numbers = {item: i for i, item in enumerate(ids)}
                made.append(best_in_tasks(index, [(numbers[r[0]], *r[1:]) for r in rows], ids, item_kind, documents, length, k))
        found = reduce(DataFrame.unionByName, made) if made else found
    order = Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("_doc"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select(F.col("_item").alias(item_id), "rank", F.col("_doc").alias(id_col), "score")
