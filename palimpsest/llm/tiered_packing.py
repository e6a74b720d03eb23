"""Hierarchical packing of tokenised documents into sequences of several lengths.

Documents are tokenised, closed with an end token, and cut into whole windows
of the longest context; what remains of each is routed to the smallest tier
that holds it. From the longest tier down, each window opens with the longest
piece of its tier; its gap is filled with the longest pieces of this and the
shorter tiers that fit, and, where none fits whole, with the head of the
shortest piece. So every sequence is full: its length is a tier, a power of
two. What is left below the shortest tier becomes sequences of smaller powers
of two. The sequences of a pool are then dealt to step groups of nearly equal
tokens, longest first.

Packing runs where documents are read, in pools of a bounded number of tokens:
no shuffle, and no more than a pool in memory. A pool's sequences are numbered
by its partition and place, so a task that runs again gives the same rows.

Defined cases: a null text is an empty one, whose only token is the end token;
rows that repeat an identifier are packed one by one; an empty table gives an
empty result; columns of the input beside identifier and text are not read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Callable, Iterator
from unicodedata import normalize

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import table

TIERS = (2048, 1024, 512, 256)
END_ID = 1
POOL_TOKENS = 2_000_000
GROUP_TOKENS = 65_536
#: Words whose ids a worker remembers, long ones aside; it starts anew beyond.
REMEMBERED_WORDS, LONG_WORD = 1_000_000, 100
_MARKS = ".,;:!?)"

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
    "sequence_length long, step_group long, ids binary"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _normal(word: str) -> str:
    """As the tokenizer normalises it: letter by letter, so a sigma at the end of a word is like any other."""
    return word.lower() if word.isascii() else "".join(map(str.lower, normalize("NFC", word)))


class WordEncoder:
    """Ids of a text, as little-endian 32-bit bytes, by the words between blanks.

    A word that is all letters once it is normalised as the tokenizer does it (NFC, then
    lower case) is one piece to it, and so are the marks after it; other words are left to it.
    The tokenizer drops white space and never joins what stands on both sides
    of it, so a text's ids are those of its words, one after another.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a core for each task is Spark's to give
        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[str, bytes] = {}
        vocabulary = self._tokenizer.get_vocab()
        #: by id: whether it ends a word
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def __call__(self, texts: list[str]) -> list[bytes]:
        # white space at which every step of the tokenizer breaks
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self._known) > REMEMBERED_WORDS:
            self._known.clear()
        known = self._known
        fresh = set().union(*split).difference(known)
        words = {w: (piece, w[len(core) :]) for w in fresh if (core := w.rstrip(_MARKS)).isalpha() and (piece := _normal(core)).isalpha()}
        cores = list({core for core, _ in words.values()}.difference(known))
        known.update(zip(cores, self._of_pieces(cores), strict=True))
        others = list({m for _, m in words.values()}.union(fresh.difference(words)).difference(known))
        for word, one in zip(others, self._tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            known[word] = np.array(one.ids, "<u4").tobytes()
        for word, (core, marks) in words.items():
            known[word] = known[core] + known[marks]
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for word in [w for w in fresh if len(w) > LONG_WORD]:
            del known[word]
        return out

    def _of_pieces(self, words: list[str]) -> list[bytes]:
        """Ids of words that are one piece each to the tokenizer: encoded together, cut after each id that ends a word."""
        if not words:
            return []
        ids = np.array(self._tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
        if len(ends) != len(words):  # a letter that the tokenizer knows otherwise: each by itself
            return [np.array(one.ids, "<u4").tobytes() for one in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        data = ids.tobytes()
        return [data[begin:end] for begin, end in zip([0, *ends[:-1]], ends, strict=True)]


class _Shelf:
    """Pieces (document, start, length) by length; the longest that fits is found by bit arithmetic."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.mask = 0

    def put(self, doc: int, start: int, length: int) -> None:
        if length:
            self.by_length.setdefault(length, []).append((doc, start))
            self.mask |= 1 << length

    def take(self, length: int) -> tuple[int, int, int]:
        held = self.by_length[length]
        doc, start = held.pop()
        if not held:
            del self.by_length[length]
            self.mask &= ~(1 << length)
        return doc, start, length

    def longest(self, most: int) -> int:
        """The greatest length up to ``most``, or 0."""
        return (self.mask & (1 << most + 1) - 1).bit_length() - 1 if self.mask & (1 << most + 1) - 1 else 0

    def shortest(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1 if self.mask else 0


Piece = tuple[int, int, int]


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of (document, start, length) that hold every token of every document once."""
    longest, shelf = tiers[0], _Shelf()
    out: list[list[Piece]] = []
    for doc, n in enumerate(lengths):
        full = n // longest * longest
        out += [[(doc, start, longest)] for start in range(0, full, longest)]
        shelf.put(doc, full, n - full)
    tokens = sum(n % longest for n in lengths)
    for tier, shorter in zip(tiers, (*tiers[1:], 0), strict=True):
        # a window opens while this tier has pieces of its own; the shortest tier takes all that is left
        while tokens >= tier and shelf.longest(tier) > shorter:
            tokens -= tier
            out.append(_window(shelf, tier))
        n = shelf.longest(tier)
        if shorter and n > shorter:  # too little is left for a window: the one piece is cut for the next tier
            doc, start, _ = shelf.take(n)
            shelf.put(doc, start, shorter)
            shelf.put(doc, start + shorter, n - shorter)
    size = tiers[-1]
    while tokens:
        size = min(size, 1 << tokens.bit_length() - 1)
        out.append(_window(shelf, size))
        tokens -= size
    return out


def _window(shelf: _Shelf, size: int) -> list[Piece]:
    pieces: list[Piece] = []
    gap = size
    while gap:
        n = shelf.longest(gap)
        if n:
            pieces.append(shelf.take(n))
        else:
            doc, start, length = shelf.take(shelf.shortest())
            pieces.append((doc, start, gap))
            shelf.put(doc, start + gap, length - gap)
            n = gap
        gap -= n
    return pieces


def balance(lengths: list[int], group_tokens: int = GROUP_TOKENS) -> list[int]:
    """A step group for each sequence: the longest first, always to the group with fewest tokens."""
    groups = [(0, g) for g in range(max(1, -(-sum(lengths) // group_tokens)))]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        held, g = heapq.heappop(groups)
        out[i] = g
        heapq.heappush(groups, (held + lengths[i], g))
    return out


def _pool_rows(docs: list[tuple[int | None, bytes]], first: int, with_ids: bool) -> tuple[pd.DataFrame, int]:
    sequences = pack([len(b) // 4 for _, b in docs])
    sizes = [sum(p[2] for p in s) for s in sequences]
    groups = balance(sizes)
    rows = []
    for i, pieces in enumerate(sequences):
        offset = 0
        for doc, start, length in pieces:
            doc_id, data = docs[doc]
            ids = data[4 * start : 4 * (start + length)]
            rows.append(
                (doc_id, start, length, zlib.crc32(ids), len(data) // 4, first + i, offset, sizes[i], first + groups[i], ids if with_ids else None)
            )
            offset += length
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group", "ids"]
    return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"}), len(sequences)


def pack_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    with_ids: bool = True,
    encoder: Callable[[str], Callable[[list[str]], list[bytes]]] = WordEncoder,
) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence, and its token ids."""
    path = tokenizer or default_tokenizer()
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, number = encoder(path), TaskContext.get().partitionId() << 32
        pool: list[tuple[int | None, bytes]] = []
        tokens = 0
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.iloc[at : at + 64]
                coded = encode([t if isinstance(t, str) else "" for t in some["text"]])
                for doc, data in zip(some["doc_id"], coded, strict=True):
                    pool.append((None if pd.isna(doc) else int(doc), data + end))
                    tokens += len(data) // 4 + 1
                if tokens >= POOL_TOKENS:
                    rows, n = _pool_rows(pool, number, with_ids)
                    yield rows
                    pool, tokens, number = [], 0, number + n
        if pool:
            yield _pool_rows(pool, number, with_ids)[0]

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)


def op7_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in full sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


QUERIES = {"op7_tiered_packing": op7_tiered_packing}
ORACLE_SQL: dict[str, str] = {}
