"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece the last token of its encoding is unique: it is the one token that ends the prefix
and stays apart from the last token of the prefix before it, that is, whose pair encodes to just these two
tokens. Storing that token per prefix makes appends exact and cheap and lets an edit stop early, as
soon as the stored tokens agree with the old ones over the length of the longest token.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded each for itself; an empty table
gives no rows; a very long text is encoded like any other, and not remembered for long; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame

from .common import map_rows

#: Entries of a worker's memory of pieces, and of pairs, and characters of the pieces; it starts anew when full.
REMEMBERED, REMEMBERED_CHARACTERS = 800_000, 50_000_000


class Vocabulary:
    """Ranks by bytes, as in a rank file; the pattern splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.longest = max(map(len, ranks), default=0)
        self.never = len(self.bytes)
        self.find = regex.compile(pattern).findall
        self._pairs: dict[int, bool] = {}
        self._edges: dict[int, tuple[list, list] | None] = {}
        self.usable = {t: r for t, r in ranks.items() if self.edges(r) is not None}

    def merged(self, piece: bytes, until: int = 1) -> list[bytes]:
        """The encoding by definition, for short strings: merge the neighbours of lowest rank, leftmost first, down to `until` parts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            ranks = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, token: int) -> tuple[list, list] | None:
        """What stands at the left and at the right edge of the token while it is merged, each with the rank of the merge that ends it; None if the token's bytes don't merge into it."""
        if token not in self._edges:
            whole = self.bytes[token]
            parts = self.merged(whole, 2) if len(whole) > 1 else []
            found = ([(whole, self.never)], [(whole, self.never)])
            if len(parts) > 2:
                found = None
            elif parts:
                inner = self.edges(self.ranks[parts[0]]), self.edges(self.ranks[parts[1]])
                for side in (0, 1):
                    (outer, _), *rest = inner[side][side]
                    found[side].extend([(outer, token), *rest])
            self._edges[token] = found
        return self._edges[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens' joined bytes encode to just these two.

        Each side merges by itself in order of rank, until a merge across the boundary comes first: before the
        left neighbour is merged away (of equal ranks the leftmost goes first) and no later than the right one.
        """
        key = left * self.never + right
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) >= REMEMBERED // 2:
                self._pairs.clear()
            rank = self.ranks.get
            known = True
            for a, a_ends in self.edges(left)[1]:
                for b, b_ends in self.edges(right)[0]:
                    if (m := rank(a + b)) is not None and m < a_ends and m <= b_ends:
                        known = False
                        break
                if not known:
                    break
            self._pairs[key] = known
        return known

    def extend(self, data: bytes, last: list[int], ends: range):
        """Appends to last, and yields, the last token of the encoding of data[:end] for each end; last holds those of all shorter prefixes."""
        rank, pair, apart, longest, n = self.usable.get, self._pairs.get, self.apart, self.longest, self.never
        for end in ends:
            for start in range(end - longest if end > longest else 0, end):
                if (token := rank(data[start:end])) is not None:
                    if start == 0:
                        break
                    if (known := pair(last[start] * n + token)) is None:
                        known = apart(last[start], token)
                    if known:
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
            yield token

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return PrefixEncoding(self, piece).ids()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_piece(p.encode()) for p in self.find(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class PrefixEncoding:
    """One piece with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.data += more
        for _ in self.vocabulary.extend(self.data, self.last, range(len(self.last), len(self.data) + 1)):
            pass

    def become(self, data: bytes) -> None:
        """The encoding of data, with the prefixes that it shares kept."""
        same = next((i for i, (a, b) in enumerate(zip(self.data, data, strict=False)) if a != b), min(len(self.data), len(data)))
        self.data, self.last = data[:same], self.last[: same + 1]
        self.append(data[same:])

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces data[start:stop]; returns how many prefixes were encoded again."""
        old, shift, agree = self.last, len(new) - (stop - start), 0
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        for token in self.vocabulary.extend(self.data, self.last, range(start + 1, len(self.data) + 1)):
            before = len(self.last) - 1 - shift
            # beyond the edit, equal tokens over the reach of the longest token make all later ones equal
            agree = agree + 1 if before > stop and old[before] == token else 0
            if agree >= self.vocabulary.longest:
                self.last += old[before + 1 :]
                return before + shift - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end, tokens = [], len(self.data), self.vocabulary.bytes
        while end:
            out.append(self.last[end])
            end -= len(tokens[out[-1]])
        return out[::-1]


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Of a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}, pattern)


class Encoder:
    """Encodes texts with a memory of their parts, bounded by REMEMBERED entries.

    A text whose white space is single blanks and line ends between other characters is taken apart before each of
    these, if the pattern parts pieces there whatever stands around (tried with letters, digits and marks). The pieces that are new are encoded in sorted order, so each takes
    over the stored prefixes that it shares with the one before.
    """

    #: Characters of texts that are encoded together.
    AT_ONCE = 2_000_000

    def __init__(self, words: Vocabulary):
        self.words, self.parts, self.known = words, {}, {}
        self.held = self.held_known = 0
        around = ["a", "Z", "é", "日", "7", "!", "'", "-", "_", "'s", "a!", "!!", "1a", "\u0301", "😀"]
        self.parted = all(words.find(f"{x}{c}{y}") == [*words.find(x), *words.find(f"{c}{y}")] for x in around for c in " \n" for y in around)
        self.uneven = re.compile(r"\s\s|[^\S \n]|^\s|\s\Z|\x00").search

    def apart(self, text: str) -> list[str]:
        if not self.parted or self.uneven(text):
            return self.words.find(text)
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")

    def learn(self, parts: set[str]) -> None:
        new = parts.difference(self.parts)
        self.held += sum(map(len, new))
        if len(self.parts) + len(new) > REMEMBERED or self.held > REMEMBERED_CHARACTERS:
            self.parts.clear()
            new, self.held = parts, sum(map(len, parts))
        cut = {part: self.words.find(part) for part in new}
        pieces = set(chain.from_iterable(cut.values()))
        unknown = pieces.difference(self.known)
        self.held_known += sum(map(len, unknown))
        if len(self.known) + len(unknown) > REMEMBERED or self.held_known > REMEMBERED_CHARACTERS:
            self.known.clear()
            unknown, self.held_known = pieces, sum(map(len, pieces))
        before = PrefixEncoding(self.words)
        for piece in sorted(unknown):
            data = piece.encode()
            if (whole := self.words.ranks.get(data)) is not None:
                self.known[piece] = (whole,)
            else:
                before.become(data)
                self.known[piece] = tuple(before.ids())
        for part, found in cut.items():
            self.parts[part] = tuple(chain.from_iterable(map(self.known.__getitem__, found)))

    def encode(self, texts: list[str | None]):
        """Yields the ids of each text; null counts as empty."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < self.AT_ONCE:
                text = texts[at] or ""
                group.append(self.apart(text))
                size, at = size + len(text), at + 1
            self.learn(set(chain.from_iterable(group)))
            for parts in group:
                yield list(chain.from_iterable(map(self.parts.__getitem__, parts)))


@lru_cache(maxsize=1)
def encoder_of(path: str, pattern: str) -> Encoder:
    """One encoder, with its memory, for all tasks that a worker runs."""
    return Encoder(vocabulary(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id and ids (array<int>) of the whole text, without special tokens."""

    def make():
        encoder = encoder_of(path, pattern)
        return lambda keys, texts: (keys, list(encoder.encode(texts)))

    return map_rows(docs, [id_col, text], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>", make)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """One row per row of encode_documents(): id and the decoded bytes."""

    def make():
        words = vocabulary(path, pattern)
        return lambda keys, ids: (keys, [words.decode(x or ()) for x in ids])

    return map_rows(encoded, [id_col, "ids"], f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, decoded binary", make)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """encode_documents() and decode_documents() in one pass, reduced to digests of the ids and of the decoded bytes."""

    def make():
        words = vocabulary(path, pattern)
        encoder = encoder_of(path, pattern)
        names = list(map(str, range(len(words.bytes))))

        def work(keys, texts):
            counts, ids_hex, back_hex = [], [], []
            for ids in encoder.encode(texts):
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back_hex.append(hashlib.sha256(words.decode(ids)).hexdigest())
            return keys, counts, ids_hex, back_hex

        return work

    return map_rows(docs, [id_col, text], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
