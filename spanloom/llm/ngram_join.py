"""N-gram Jaccard self-join by token-combination prefixes.

A document's set holds its distinct shingles as 64-bit hashes. Shingles are ordered from rare to frequent, by classes from
a sketch of fixed size over all documents, then by hash. Of a set of n, a partner at similarity 3/4 must share
k shingles among the first n - ceil(3n/4) + k; with k = 2 the index takes single shingles of the rare class, and
pairs of shingles of the frequent class. Sets of over COMBINED shingles would have too many pairs: they index
frequent shingles singly, and sets up to 4/3 of that size do both, so any two that may link meet in one way.

Candidates are not all pairs that share an entry. In rounds each set meets one member of its entries, and links found are
closed to components. After the first round that member is the entry's most central set of about its size: the one that
shares the largest part of its prefix, as the common origin of edited copies does, so that one round ties all copies
near the origin. Only pairs from different components are then formed, and of these only those that two bounds allow:
an entry carries the number of shingles before it in its set's order, and where the entry is the first that two sets
share, only those behind it can be common (an edited copy too far from its origin starts with its own shingles, so it
meets no other there); and parity sketches of one or two bits a shingle, then of four, count differing shingles from below. What is left is
verified on the full sets. No link between different components is lost, so the components are exact.

Equal sets are one item throughout. Hashes count as the shingles: a collision within a pair is as likely as
(n^2 / 2^64). Equal 64-bit names of different sets are looked for, and another seed is taken if there are any.

Defined results: words are runs outside [\\x20\\x09-\\x0D] with A-Z lower-cased; fewer words than a shingle are one
shingle; null, empty and blank texts have an empty set and link with nothing; repeated rows are equal sets;
different texts under one id are documents of their own, as are rows with a null id: both link by their own text, and a
null id names a component only where no row of it has another; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_staged, join_groups, small_batches, staged
from .components import components

WIDTH = 5
#: similarity = NUM / DEN
NUM, DEN = 3, 4
SKETCH_BITS = 20
BLOCKS = 64
#: A shingle is frequent if its sketch count is at least so much, and so many times the upper spread (median to ninth decile) of
#: all counts over their median: what other shingles add to a count is about the same for all.
FREQUENT, FREQUENT_SPREADS = 16, 6
COMBINED = 64
#: Most bits of the parity sketches that go along with entries.
PARITY_BITS = 4096
#: Rounds of stars go on among entries of more than so many items of several labels, while a round links at least one in
#: STAR_GAIN of these items.
STAR_ITEMS, STAR_GAIN = 4, 200
#: Items (16 bytes each) whose list is sent to all executors instead of shuffling the texts.
FEW_ITEMS = 200_000


#: Words whose hashes a task remembers.
REMEMBERED = 200_000
#: Characters of texts whose words are hashed in one go.
AT_ONCE = 1_000_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` words in a row."""
    mixed = hashes[: max(0, len(hashes) - size + 1)] + np.uint64(size)
    for k in range(1, size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - size + 1 + k]
        mixed ^= mixed >> np.uint64(29)
    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed = mixed * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(29))


def shingle_sets(texts: list[str | None], words: WordHashes, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. The words of all texts are hashed in one go."""
    parts = [(text or "").encode().lower().split() for text in texts]  # bytes: only A-Z change, only ASCII white space parts
    stops = np.cumsum([len(p) for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
    hashes = np.fromiter(map(words.__getitem__, chain.from_iterable(parts)), dtype=np.uint64, count=int(stops[-1]) if len(stops) else 0)
    mixed, out, start = _mixed(hashes, width), [], 0
    for stop in stops.tolist():
        n = stop - start
        found = mixed[start : stop - width + 1] if n >= width else _mixed(hashes[start:stop], n) if n else hashes[:0]
        if n > width:
            found.sort()  # in place: the windows of a text are its own
            new = found[1:] != found[:-1]
            found = found.copy() if new.all() else np.concatenate((found[:1], found[1:][new]))
        out.append(found)
        start = stop
    return out


def shingle_set(text: str | None, words: WordHashes, width: int = WIDTH) -> np.ndarray:
    return shingle_sets([text], words, width)[0]


def in_groups(texts, width: int, words: WordHashes):
    """shingle_sets() of an Arrow column, as many texts at a time as have AT_ONCE bytes or so: (index, set)."""
    group, size, first = [], 0, 0
    for i, text in enumerate(texts):
        group.append(text.as_py())
        size += len(group[-1] or "")
        if size >= AT_ONCE:
            yield from enumerate(shingle_sets(group, words, width), first)
            group, size, first = [], 0, i + 1
    yield from enumerate(shingle_sets(group, words, width), first)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def index_entries(hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index entries of a set: singles are even, combinations odd; and the number of other shingles before each entry's last one. classes: of each hash, 0 for rare."""
    n = len(hashes)
    size = min(n, n - (-(-NUM * n // DEN)) + 2)
    if not classes.any():  # all rare: hashes are in order already
        entries, before = hashes[:size] & ~np.uint64(1), np.arange(size)
    else:
        order = np.argsort(classes, kind="stable")[:size]
        rare = classes[order] == 0
        frequent = hashes[order[~rare]]
        n_rare = int(rare.sum())
        singles = hashes[order[:n_rare]] if n <= COMBINED else hashes[order]
        out, before = [singles & ~np.uint64(1)], [np.arange(len(singles))]
        if NUM * n <= DEN * COMBINED and len(frequent) > 1:
            a, b = np.triu_indices(len(frequent), 1)
            mixed = (frequent[a] * np.uint64(0x9E3779B97F4A7C15)) ^ (frequent[b] * np.uint64(0xC2B2AE3D27D4EB4F))
            mixed ^= mixed >> np.uint64(31)
            out.append(mixed * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1))
            before.append(n_rare + b - 1)
        entries, before = np.concatenate(out), np.concatenate(before)
        by_entry = np.lexsort((before, entries))
        entries, before = entries[by_entry], before[by_entry]
    first = np.ones(len(entries), dtype=bool)
    first[1:] = entries[1:] != entries[:-1]
    return entries[first], before[first]


def parity(hashes: np.ndarray) -> np.ndarray:
    """A sketch, as bytes, of at least four bits a shingle: bits are set where an odd number of shingles fall. The bits in which two sets differ are at most as many as the shingles in which they do."""
    size = max(512, 1 << (4 * len(hashes)).bit_length())
    at = (hashes >> np.uint64(20)) & np.uint64(size - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=size) & 1).astype(np.uint8))


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set with fewer bytes."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def small_parity(sketch: np.ndarray, n: int) -> np.ndarray:
    """One or two bits a shingle, and the same folded once for sets of the size class below, as words of 64 bits."""
    bits = min(max(128, min(512, 1 << (2 * n - 1).bit_length()), 1 << max(0, n - 1).bit_length()), PARITY_BITS)
    own = folded(sketch, bits // 8)
    return np.concatenate((own, folded(own, bits // 16))).view(np.int64)


def differing(x: str, y: str) -> Column:
    """Bits in which two small_parity() columns differ; classes are neighbours at most."""
    words = lambda c, d: F.slice(c, F.when(F.size(c) > F.size(d), F.size(d) * 4 / 3 + 1).otherwise(1).cast("int"), (F.least(F.size(c), F.size(d)) * 2 / 3).cast("int"))
    return F.aggregate(F.zip_with(words(x, y), words(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, d: n + d)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def describe(docs: DataFrame, id_col: str, text: str, width: int) -> tuple[DataFrame, np.ndarray, int]:
    """(id, sub, n, item, bits, wide) of all documents, the sketch's classes, and the seed of the items' names. wide is the parity sketch, bits its small_parity()."""
    def run(batches, seed):
        import pyarrow as pa
        import xxhash

        words, counts = WordHashes(), np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        names = ["id", "sub", "n", "item", "bits", "wide", "proof", "block", "counts"]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes, items, bits, wides, proofs = [], [], [], [], []
            for _, hashes in in_groups(batch.column(1), width, words):
                np.add.at(counts, _bucket(hashes), np.uint32(1))
                data = hashes.tobytes()
                sizes.append(len(hashes))
                items.append(xxhash.xxh3_64_intdigest(data, seed=seed))
                wide = parity(hashes)
                bits.append(small_parity(wide, len(hashes)))
                wides.append(wide.tobytes())
                proofs.append(xxhash.xxh3_128_digest(data))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(id_type), batch.column(2), pa.array(sizes, pa.int64()), pa.array(np.array(items, dtype=np.uint64).view(np.int64)), pa.array(bits, pa.list_(pa.int64())), pa.array(wides, pa.binary()), pa.array(proofs, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=names,
            )
        blocks = counts.reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(BLOCKS, id_type), *(pa.nulls(BLOCKS, pa.int64()) for _ in range(3)), pa.nulls(BLOCKS, pa.list_(pa.int64())), *(pa.nulls(BLOCKS, pa.binary()) for _ in range(2)), pa.array(range(BLOCKS), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())],
            names=names,
        )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("sub"))
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    for seed in range(8):
        made = staged(rows.mapInArrow(lambda batches, seed=seed: run(batches, seed), f"id {kind.simpleString()}, sub long, n long, item long, bits array<long>, wide binary, proof binary, block int, counts binary"), "ngram-sets")
        sets = made.where("block is null")
        clash = sets.groupBy("item").agg(F.min("proof").alias("a"), F.max("proof").alias("b")).where("a <> b")
        if clash.isEmpty():
            break
    else:
        raise RuntimeError("different sets have one name under every seed")

    def summed(table):
        import pyarrow as pa

        total = np.zeros((1 << SKETCH_BITS) // BLOCKS, dtype=np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), dtype=np.uint32)
        data = np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([data], pa.binary())})

    blocks = made.where("block is not null").select("block", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("deal"))
    blocks = blocks.groupBy("block", "deal").applyInArrow(summed, "block int, counts binary").groupBy("block").applyInArrow(summed, "block int, counts binary")
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32).reshape(BLOCKS, -1)
    for block, data in blocks.collect():  # BLOCKS rows of a fixed size
        counts[block] = np.frombuffer(data, dtype=np.uint32)
    counts = counts.reshape(-1)
    median, ninth = np.quantile(counts, (0.5, 0.9))
    least = max(FREQUENT, FREQUENT_SPREADS * float(ninth - median))
    over = counts - median
    classes = np.where(over >= least, 1 + np.log2(np.maximum(over / least, 1)), 0).astype(np.uint8)
    return sets.select("id", "sub", "n", "item", "bits", "wide"), classes, seed


def index_rows(docs: DataFrame, classes: np.ndarray, seed: int, id_col: str, text: str, width: int) -> DataFrame:
    """(entry, item, size): the entries of all sets; a set that a task meets again is not repeated. size holds n and, in its lower half, the shingles before the entry."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # 2 ** SKETCH_BITS bytes

    def run(batches):
        import pyarrow as pa
        import xxhash

        words, seen, of = WordHashes(), set(), shared.value
        for batch in batches:
            entries, items, sizes, held = [], [], [], 0
            for _, hashes in in_groups(batch.column(0), width, words):
                item = xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=seed)
                if not len(hashes) or item in seen:
                    continue
                seen.add(item)
                found, before = index_entries(hashes, of[_bucket(hashes)])
                entries.append(found)
                items.append(np.full(len(found), item, dtype=np.uint64))
                sizes.append((np.int64(len(hashes)) << 32) | before.astype(np.int64))
                held += len(found)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(entries))), pa.array(_signed(np.concatenate(items))), pa.array(np.concatenate(sizes))], names=["entry", "item", "size"])
                    entries, items, sizes, held = [], [], [], 0
            if entries:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(entries))), pa.array(_signed(np.concatenate(items))), pa.array(np.concatenate(sizes))], names=["entry", "item", "size"])

    return docs.select(text).mapInArrow(run, "entry long, item long, size long")


def shared_entries(rows: DataFrame) -> DataFrame:
    """(entry, item, size, leader, leader_size) of entries with two items or more; rows are dealt and sorted by entry and read as a stream, so no entry's rows are held together."""

    def run(batches):
        import pyarrow as pa

        held = None  # the last row, until it is known whether its entry goes on
        leader = None  # (entry, item, size) of the entry that the last row belongs to
        names = ["entry", "item", "size", "leader", "leader_size"]

        def out(entry, item, n, lead, lead_n):
            return pa.RecordBatch.from_arrays([pa.array(entry, pa.int64()), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(lead, pa.int64()), pa.array(lead_n, pa.int64())], names=names)

        for batch in batches:
            entry, item, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if held is not None:
                entry, item, n = (np.concatenate(([h], x)) for h, x in zip(held, (entry, item, n), strict=True))
            if not len(entry):
                continue
            keep = np.ones(len(entry), dtype=bool)
            keep[1:] = (entry[1:] != entry[:-1]) | (item[1:] != item[:-1])
            entry, item, n = entry[keep], item[keep], n[keep]
            first = np.ones(len(entry), dtype=bool)
            first[1:] = entry[1:] != entry[:-1]
            at = np.maximum.accumulate(np.where(first, np.arange(len(entry)), 0))
            lead, lead_n = item[at], n[at].copy()
            if leader is not None and leader[0] == entry[0]:
                lead, same = lead.copy(), at == 0
                lead[same], lead_n[same] = leader[1], leader[2]
            goes_on = np.zeros(len(entry), dtype=bool)
            goes_on[:-1] = entry[1:] == entry[:-1]
            multi = goes_on | (lead != item) | (~first)
            multi[-1] = False  # held back
            if multi.any():
                yield out(entry[multi], item[multi], n[multi], lead[multi], lead_n[multi])
            held, leader = (entry[-1], item[-1], n[-1]), (entry[-1], lead[-1], lead_n[-1])
        if held is not None and leader[1] != held[1]:
            yield out([held[0]], [held[1]], [held[2]], [leader[1]], [leader[2]])

    return rows.repartition("entry").sortWithinPartitions("entry", "item").mapInArrow(run, "entry long, item long, size long, leader long, leader_size long")


def sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, n1, n2, la, lb) whose whole parity sketches, a sixteenth of the sets, let them be linked."""

    def close(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for i, (n, m) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.uint8) for c in (6, 7))
                size = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                keep.append(differ <= n + m - 2 * -(-NUM * (n + m) // (NUM + DEN)))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1, 4, 5)], names=["a", "b", "la", "lb"])

    needed = pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct()
    wides = staged(sets.select("item", "wide").join(needed, "item", "left_semi").dropDuplicates(["item"]), "ngram-sketches")
    both = pairs.join(wides.select(F.col("item").alias("a"), F.col("wide").alias("x")), "a").join(wides.select(F.col("item").alias("b"), F.col("wide").alias("y")), "b")
    return both.select("a", "b", "n1", "n2", "la", "lb", "x", "y").mapInArrow(close, "a long, b long, la long, lb long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, la, lb) of items and their labels whose sets (item, hashes) are similar enough; joins are split by the planner where an item is in many pairs."""
    names = ["a", "b", "la", "lb"]

    def linked(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            left, right = batch.column(4), batch.column(5)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), dtype=np.uint64), np.frombuffer(right[i].as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DEN * common >= NUM * (len(x) + len(y) - common))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(chosen) for i in range(4)], names=names)

    both = pairs.join(sets.select(F.col("item").alias("b"), F.col("hashes").alias("y")), "b").join(sets.select(F.col("item").alias("a"), F.col("hashes").alias("x")), "a")
    return both.select(*names, "x", "y").mapInArrow(linked, "a long, b long, la long, lb long")


def set_bytes(docs: DataFrame, needed: DataFrame, seed: int, id_col: str, text: str, width: int) -> DataFrame:
    """(item, hashes) of the needed (item, at): the sets of their representative rows, found by id and a hash of the text; a row counts if its set bears the item's name."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [hashes.tobytes() for _, hashes in in_groups(part.column(1), width, words)]
                names = np.array([xxhash.xxh3_64_intdigest(d, seed=seed) for d in data], dtype=np.uint64)
                same = pa.array(_signed(names) == part.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(same), pa.array(data, pa.binary()).filter(same)], names=["item", "hashes"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("sub"))
    needed = staged(needed.select("item", F.col("at.id").alias("rep"), F.col("at.sub").alias("rep_sub")), "ngram-needed")
    if needed.count() <= FEW_ITEMS:  # no text travels
        needed = F.broadcast(needed)
    met = texts.join(needed, F.col("id").eqNullSafe(F.col("rep")) & (F.col("sub") == F.col("rep_sub")))
    return met.select("item", "text").mapInArrow(run, "item long, hashes binary").dropDuplicates(["item"])


def relabelled(rows: DataFrame, tied: DataFrame) -> DataFrame:
    """rows (entry, item, size, label) with the labels that tied (node, component) gives and the entry's number of items, without entries that are of one label."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("n_rows"))
    names = tied.select(F.col("node").alias("label"), "component").join(sizes, "label")
    rows = join_groups(rows, names, ["label"], "n_rows", rows.count(), F.struct("entry", "item"))
    rows = staged(rows.select("entry", "item", "size", F.coalesce("component", "label").alias("label")), "ngram-labelled")
    several = rows.groupBy("entry").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("held")).where("lo <> hi").select("entry", "held")
    out = staged(rows.join(several, "entry"), "ngram-open")
    drop_staged(rows)
    return out


def n_of(size: str | Column) -> Column:
    return F.shiftright(size, 32).cast("int")


def stars(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b, la, lb): each item b with the leader a of another label that it shares most entries with.

    An entry has a leader for each class of sizes (a factor of 4/3), and items meet those of their own and the two neighbouring classes, so
    all that may link with a leader meet it. The leader is the item with the largest part of its shingles among open entries; from the
    second turn on parts are weighed at random, so that others have a turn.
    """
    part = F.count("*") / F.first(n_of("size"))
    if turn:
        part = part * (0.5 + F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(1 << 20)) / float(2 << 20))
    central = rows.groupBy("item").agg(part.alias("part"))
    band = F.floor(F.log(n_of("size")) / math.log(DEN / NUM)).cast("int")
    rows = rows.join(central, "item").withColumn("n", n_of("size")).withColumn("band", band)
    drawn = F.max(F.struct("part", "item", "n", "label"))
    leaders = rows.groupBy("entry", "band").agg(drawn.alias("lead"))
    leaders = leaders.withColumn("band", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))))
    met = rows.join(leaders, ["entry", "band"]).where(F.col("label") != F.col("lead.label")).where(close_enough("n", "lead.n"))
    shared = met.groupBy(F.col("lead.item").alias("a"), F.col("item").alias("b")).agg(F.count("*").alias("c"), F.max("lead.label").alias("la"), F.max("label").alias("lb"), F.max(F.least("n", "lead.n")).alias("n"))
    best = shared.where("c * 20 >= n").groupBy("b").agg(F.max(F.struct("c", "a", "la", "lb")).alias("m"))
    return best.select("m.a", "b", "m.la", "m.lb")


def close_enough(a: str, b: str):
    """Sizes that allow a link."""
    return (F.col(a) * NUM <= F.col(b) * DEN) & (F.col(b) * NUM <= F.col(a) * DEN)


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: id, n_shingles and component_id, the least id reachable over links."""
    small_batches(docs.sparkSession)
    sets, classes, seed = describe(docs, id_col, text, width)
    items = staged(sets.where("n > 0").groupBy("item").agg(F.min("id").alias("rep"), F.min(F.struct("id", "sub")).alias("at"), F.max("n").alias("n"), F.count("*").alias("n_docs"), F.first("bits").alias("bits")), "ngram-items")
    multi = staged(shared_entries(index_rows(docs, classes, seed, id_col, text, width)), "ngram-entries")

    links: list[DataFrame] = []
    held: DataFrame | None = None

    def check(pairs: DataFrame) -> DataFrame:
        """The links among the pairs; sets are fetched once."""
        nonlocal held
        pairs = staged(pairs, "ngram-pairs")
        needed = pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct()
        if held is not None:
            needed = needed.join(held.select("item"), "item", "left_anti")
        more = staged(set_bytes(docs, needed.join(items.select("item", "at"), "item"), seed, id_col, text, width), "ngram-hashes")
        held = more if held is None else held.unionByName(more)
        links.append(staged(verified(pairs, held), "ngram-links"))
        return links[-1]

    # each item and one other: first the entries' first items, then leaders among what is still apart
    met = multi.select(F.col("item").alias("b"), F.col("leader").alias("a"), n_of("size").alias("n"), n_of("leader_size").alias("leader_n"))
    met = met.where("a <> b").where(close_enough("n", "leader_n")).groupBy("b", "a").agg(F.count("*").alias("c"), F.max(F.least("n", "leader_n")).alias("n"))
    pairs = met.where("c * 20 >= n").groupBy("b").agg(F.max(F.struct("c", "a")).alias("m")).select(F.col("m.a").alias("a"), "b", F.col("m.a").alias("la"), F.col("b").alias("lb"))
    rows = multi.select("entry", "item", "size", F.col("item").alias("label"))
    turn = 0
    while True:
        found = check(pairs)
        before, rows = rows, relabelled(rows, components(found.select(F.col("la").alias("a"), F.col("lb").alias("b"))))
        drop_staged(before)
        hot = rows.where(F.col("held") > STAR_ITEMS)
        n_hot = hot.select("item").distinct().count()
        if not n_hot or (turn and found.count() * STAR_GAIN < n_hot):
            break  # what is left is few, or not for leaders to tie
        pairs = stars(hot, turn)
        turn += 1

    # pairs of different labels that the shingles before their entry and the parity sketches allow
    rows = rows.join(items.select("item", "bits"), "item").withColumn("n", n_of("size")).withColumn("before", F.col("size").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    one, two = (rows.select("entry", *(F.col(c).alias(f"{c}{i}") for c in ("item", "n", "before", "label", "bits"))) for i in (1, 2))
    size = F.col("n1") + F.col("n2")
    overlap = F.ceil(size * NUM / (NUM + DEN))  # the least that linked sets of these sizes have in common
    met = one.join(two, (one["entry"] == two["entry"]) & (one["item1"] < two["item2"]) & (one["label1"] != two["label2"]) & close_enough("n1", "n2") & (F.col("n1") - F.col("before1") >= overlap) & (F.col("n2") - F.col("before2") >= overlap) & (differing("bits1", "bits2") <= size - 2 * overlap))
    met = met.groupBy(F.col("item1").alias("a"), F.col("item2").alias("b")).agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max("label1").alias("la"), F.max("label2").alias("lb"))
    check(sketched(staged(met, "ngram-candidates"), sets))

    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    # items are the nodes, as ids may be null or stand for several
    tied = staged(components(every.select("a", "b")).join(items.select(F.col("item").alias("node"), "rep"), "node"), "ngram-components")
    least = tied.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n_items"))
    tied = join_groups(tied, least, ["component"], "n_items", tied.count(), F.col("node"))
    named = items.join(tied.select(F.col("node").alias("item"), "least"), "item", "left").select("item", "n_docs", F.coalesce("least", "rep").alias("component"))
    out = join_groups(sets.select("id", "n", "item"), named, ["item"], "n_docs", sets.count(), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
