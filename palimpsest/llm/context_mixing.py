"""Language-model scoring by online logistic context mixing.

A text is a stream of bytes: its tokens with one blank between them and a line
feed as the end token. Each byte is a few base-16 digits (its rank among the
corpus's bytes, with escapes), and each digit four binary decisions. For every
decision several predictors, each with its own hashed context, give a log-odds;
they are summed under weights that a gate selects by how much the two strongest
contexts have seen, and the weights are refined by the coding error as a text
goes on, in stretches that double in length.

The token counts are a second predictor, of whole tokens with the blank or line
feed after them: at each token the bytes' probability and the token's share of
the training tokens are mixed, and a text's probability is the mean over several
shares of that mixture, the bytes alone among them.

Counts come from all training texts: every task counts its share into hashed
tables, meanwhile trains the weights on texts that its tables have not counted
yet, and sends the tables on in slices, which are summed slice by slice. The
summed tables are log-odds of one byte each, a fixed number of bytes whatever
the corpus. Token counts are a table of their own that grows with it: the
commonest tokens, a bounded number, are looked up where a text is read, the
others are joined, and both count in the score.

Defined cases: a null text is empty, its only token is the end; without any
training text all counts are 0 and every decision is even; rows that repeat
identifier and text score alike; a null identifier is never held out; an empty
table gives an empty result; columns of the input beside identifier and text are
not read. A text longer than a window is coded window by window, by the same
rule and at the same cost as in one: no context looks further back than a window
begins, and stretches go on from one window to the next.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import discard, materialize, table

FOLDS = 10
ROW_BITS = 18
SLICE_ROWS = 128
CONTEXTS = 4
GATES = 25
CHUNK_BYTES = WINDOW_BYTES = 1 << 17
#: A word counts by so many of its last bytes, and the word before it for so many bytes; a window begins so far back.
WORD_BYTES, WORD_REACH, REACH = 32, 512, 1024
TASK_BYTES = 128 << 20
#: Digits that are mixed together; chunks after which a task renews the log-odds that it trains weights under, doubling up to it.
BLOCK_DIGITS, RENEWED = 8192, 64
#: Tokens that are looked up in memory: the commonest, of 64 bytes at most.
COMMON_TOKENS, COMMON_BYTES = 100_000, 64
#: Tokens, repeats among them, that a task holds until it counts them; rows of a batch that are read at once.
HELD_TOKENS, ROWS_AT_ONCE = 1_600_000, 200
#: Rows and bytes of texts that a task is handed at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
PRIOR, LIMIT, SCALE = 0.4, 7.9, 16.0
FIRST_WEIGHT, RATE = 0.35, 0.02
#: The bytes' shares of the mixtures with the token counts.
SHARES = (1.0, 0.98, 0.9, 0.6)

_PAD = b"\n\n\n\n"
_ROWS = 1 << ROW_BITS
_MULTIPLIER, _INVERSE = np.uint32(0x9E3779B1), np.uint32(pow(0x9E3779B1, -1, 1 << 32))
_SALTS = np.array([0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def log_base(count: float, total: int, distinct: int) -> float:
    return math.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))


def in_fold(id_col: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def stream_of(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


def _values(strings: pa.Array) -> list[bytes]:
    return strings.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[bytes]]:
    """The words of all texts one after another, how many each text has, and the streams; a text without words has one, which is empty."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    streams = [text + b"\n" for text in _values(pc.binary_join(words, " "))]
    return words.flatten().cast(pa.binary()), np.diff(words.offsets.to_numpy()).astype(np.intp), streams


class Coder:
    """Digits and context rows of byte streams, for a ranking of the bytes."""

    def __init__(self, ranks: np.ndarray) -> None:
        #: by byte: how many digits; by byte and place: the digit, and a mark for the place
        self.length = np.where(ranks < 15, 1, np.where(ranks < 30, 2, 4)).astype(np.intp)
        digits, marks = np.zeros((256, 4), np.uint32), np.zeros((256, 4), np.uint32)
        for byte, r in enumerate(ranks.tolist()):
            path = [r] if r < 15 else [15, r - 15] if r < 30 else [15, 15, r >> 4, r & 15]
            for i, d in enumerate(path):
                digits[byte, i] = d
                marks[byte, i] = i if i < 3 else 3 + path[2]
        self.digits, self.marks = digits.ravel(), marks.ravel() * _SALTS[2]
        self.powers = self.back = np.ones(1, np.uint32)

    def __call__(self, data: np.ndarray, chosen: np.ndarray) -> Digits:
        """The digits of the chosen bytes of a padded stream."""
        n = len(data)
        wide = np.zeros(n + 4, np.uint32)
        wide[4:] = data
        order2 = wide[3:-1] | wide[2:-2] << np.uint32(8)
        order4 = order2 | wide[1:-3] << np.uint32(16) | wide[:-4] << np.uint32(24)
        word, before = self._words(data, wide[4:], n)
        before *= _SALTS[3]
        before += word
        hashed = [order2, order4, word, before]
        for h, salt in zip(hashed, _SALTS, strict=True):
            h += np.uint32(1)
            h *= salt
        byte = data.take(chosen)
        ends = np.cumsum(self.length.take(byte))
        nth = np.zeros(ends[-1] if len(ends) else 0, np.intp)
        nth[ends[:-1]] = 1
        np.cumsum(nth, out=nth)
        # a byte's first digit lies at four times the byte, its others behind
        head = byte.astype(np.intp)
        head *= 4
        head[1:] -= ends[:-1]
        place = head.take(nth)
        place += np.arange(len(place))
        return Digits(self, hashed, chosen.take(nth), place)

    def _words(self, data: np.ndarray, wide: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Before each byte: the hash of its word so far, and of the word before that, both of bounded reach."""
        if len(self.powers) <= n:
            self.powers = np.full(2 * n + 1, _MULTIPLIER)
            self.back = np.full(2 * n + 1, _INVERSE)
            self.powers[0] = self.back[0] = 1
            self.powers, self.back = np.cumprod(self.powers, dtype=np.uint32), np.cumprod(self.back, dtype=np.uint32)
        sums = np.zeros(n + 1, np.uint32)
        np.cumsum((wide + np.uint32(1)) * self.powers[:n], dtype=np.uint32, out=sums[1:])
        gap = (data == 32) | (data == 10)
        here = np.arange(n)
        begin = np.zeros(n, np.intp)
        np.maximum.accumulate(np.where(gap[:-1], here[1:], 0), out=begin[1:])
        near = np.maximum(begin, here - WORD_BYTES)
        word = (sums[:-1] - sums.take(near)) * self.back.take(near)
        # the word before: what stood when the gap before this word came
        before = word.take(np.maximum(begin - 1, 0))
        before[(begin == 0) | (here - begin > WORD_REACH)] = 0
        return word, before


class Digits:
    """Digits of a chunk: of each, its byte's place ``at`` and where its coder has it."""

    def __init__(self, coder: Coder, hashed: list[np.ndarray], at: np.ndarray, place: np.ndarray) -> None:
        self.coder, self.hashed, self.at, self.place = coder, hashed, at, place

    def taken(self, order: np.ndarray) -> Digits:
        return Digits(self.coder, self.hashed, self.at.take(order), self.place.take(order))

    def leaves(self) -> list[np.ndarray]:
        """By context, 16 times the row of each digit's table, and the digit."""
        digit, mark, found = self.coder.digits.take(self.place), self.coder.marks.take(self.place), []
        for hashed in self.hashed:
            mixed = hashed.take(self.at)
            mixed ^= mark
            mixed *= _MULTIPLIER
            mixed >>= np.uint32(32 - ROW_BITS)
            mixed <<= np.uint32(4)
            mixed |= digit
            found.append(mixed.astype(np.intp))
        return found


def _levels(counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """From leaf counts (16 x rows), the log-odds of the inner nodes at each depth, and how much a row has seen, 0 to 4."""
    level, out = counts.astype(np.float32), []
    for _ in range(4):
        zeros, ones = level[::2], level[1::2]
        odds = (ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR))
        np.log(odds, out=odds)
        np.clip(odds, -LIMIT, LIMIT, out=odds)
        odds *= np.float32(SCALE)
        out.append(np.rint(odds, out=odds).astype(np.int8))
        level = zeros + ones
    return out[::-1], sum((level[0] > least).astype(np.int8) for least in (0.5, 2.5, 8.5, 64.5))


def node_table(counts: np.ndarray) -> np.ndarray:
    """Log-odds of each inner node (1 to 15) from leaf counts (rows x 16), and at 0 how much a row has seen, 0 to 4."""
    levels, seen = _levels(np.ascontiguousarray(counts.T))
    return np.ascontiguousarray(np.concatenate([seen[None], *levels]).T)


class Leaves:
    """Log-odds as a digit asks for them: by context, row and digit, those of its four decisions in favour of it, a byte each, and gates by row."""

    def __init__(self, tables: np.ndarray | None = None) -> None:
        rows = _ROWS if tables is None else len(tables[0])
        self.odds = np.zeros((CONTEXTS, rows * 16), np.int32)
        self.gate1, self.gate2 = np.zeros(rows, np.int8), np.zeros(rows, np.int8)
        for c in range(CONTEXTS) if tables is not None else ():
            for at in range(0, rows, 4096):
                nodes = np.ascontiguousarray(tables[c][at : at + 4096].T)
                self._put(c, slice(at, at + 4096), [nodes[1 << depth : 2 << depth] for depth in range(4)], nodes[0])

    def renew(self, counts: np.ndarray) -> None:
        """Take the leaf counts of all contexts; rows that are empty stay at even odds."""
        for c in range(CONTEXTS):
            held = counts[c].reshape(-1, 16)
            used = np.flatnonzero(held.any(axis=1))
            for at in range(0, len(used), 4096):
                some = used[at : at + 4096]
                self._put(c, some, *_levels(np.ascontiguousarray(held[some].T)))

    def _put(self, c: int, rows: slice | np.ndarray, levels: list[np.ndarray], seen: np.ndarray) -> None:
        packed = np.zeros((1, len(seen)), np.int32)
        for depth, odds in enumerate(levels):
            both = np.empty((len(odds), 2, len(seen)), np.int32)
            both[:, 0], both[:, 1] = (-odds).view(np.uint8), odds.view(np.uint8)
            both <<= 8 * depth
            both |= packed[:, None]
            packed = both.reshape(2 << depth, -1)
        self.odds[c].reshape(-1, 16)[rows] = packed.T
        if c == 1:
            self.gate1[rows] = seen * np.int8(5)
        elif c == 2:
            self.gate2[rows] = seen


class Weights:
    """The weights of some texts: for each input, one for each text and gate. What a stretch asks for is applied when it is over."""

    def __init__(self, first: np.ndarray, docs: int) -> None:
        self.now = np.ascontiguousarray(np.tile(first, (docs, 1)).T)
        self.squares = np.full((CONTEXTS, docs * GATES), 4.0, np.float32)
        self.pull, self.turn, self.done = np.zeros((CONTEXTS, docs * GATES)), 0, 0
        self.scaled = self.now * np.float32(-1 / SCALE)

    def apply(self) -> None:
        gradient = (self.pull / SCALE).astype(np.float32)
        self.squares += gradient**2
        self.now += np.float32(RATE) * gradient / np.sqrt(self.squares)
        self.pull[:] = 0
        np.multiply(self.now, np.float32(-1 / SCALE), out=self.scaled)


def _turns(first: int, n: int) -> np.ndarray:
    """The stretch that each of ``n`` digits lies in, the first of which is a text's digit ``first``: of 128, 128, 256, 512, ... digits."""
    turn, at = np.empty(n, np.uint8), 0
    while at < n:
        nth = max((first + at).bit_length() - 7, 0)
        end = min(n, (128 << nth) - first)
        turn[at:end], at = nth, end
    return turn


def _stretches(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The order that the digits of texts of these sizes are mixed in, the text of each, and (turn, start, end) of the stretches in that order."""
    begins, texts = np.cumsum(sizes) - sizes, np.arange(len(sizes))
    starts, lengths, owners, cuts, done = [], [], [], [], 0
    for turn in range(len(sizes) and max(int(sizes.max() - 1).bit_length() - 6, 1)):
        first = 64 << turn if turn else 0
        its = texts[sizes > first]
        starts.append(begins[its] + first)
        lengths.append(np.minimum(sizes[its], 128 << turn) - first)
        owners.append(its)
        cuts.append((turn, done, done := done + int(lengths[-1].sum())))
    if not done:
        return np.zeros(0, np.intp), np.zeros(0, np.intp), []
    start, length = np.concatenate(starts), np.concatenate(lengths)
    order = np.repeat(start - (np.cumsum(length) - length), length)
    order += np.arange(done)
    return order, np.repeat(np.concatenate(owners), length), cuts


class Mixer:
    """Gated weights, one set for each text, refined after every stretch of its digits."""

    def __init__(self, first: np.ndarray) -> None:
        self.first = first

    def cost(self, tables, rows: np.ndarray, digit: np.ndarray, doc: np.ndarray, docs: int, state: Weights | None = None, each: np.ndarray | None = None):
        """The weights after these digits; ``each`` takes the nats of every digit.

        ``tables``: ``Leaves``, or for each context, (row, 16) log-odds. ``doc``: each digit's text, ascending. ``state``:
        of a single text, where its digits before have left it.
        """
        leaves = tables if isinstance(tables, Leaves) else Leaves(tables)
        leaf = rows.astype(np.intp) * 16 + digit
        if docs == 1:
            return self.mix(leaves, leaf, state=state, each=each)
        order, own, cuts = _stretches(np.diff(np.searchsorted(doc, np.arange(docs + 1))))
        nats = None if each is None else np.empty(len(digit))
        state = self.mix(leaves, leaf[:, order], own, cuts, docs, each=nats)
        if each is not None:
            each[order] = nats
        return state

    def mix(
        self, leaves: Leaves, leaf: np.ndarray | list[np.ndarray], text: np.ndarray | None = None, cuts: list | None = None, texts: int = 1,
        *, state: Weights | None = None, each: np.ndarray | None = None,
    ) -> Weights:
        """As ``cost``, of digits that come stretch by stretch, of which ``leaf`` has the leaves by context."""
        state = state or Weights(self.first, texts)
        if cuts is None:  # a single text
            turns = _turns(state.done, n := len(leaf[0]))
            ends = [*(np.flatnonzero(turns[1:] != turns[:-1]) + 1).tolist(), n] if n else []
            cuts = [(int(turns[start]), start, end) for start, end in zip([0, *ends[:-1]], ends, strict=bool(ends))]
            state.done += n
        # one table after the other, as each is larger than what stays near the core
        held = [leaves.odds[c].take(leaf[c]) for c in range(CONTEXTS)]
        gate = leaves.gate1.take(leaf[1] >> 4)
        gate += leaves.gate2.take(leaf[2] >> 4)
        own = gate.astype(np.intp)
        if text is not None:
            own += text * GATES
        for turn, start, end in cuts:
            if turn != state.turn:
                state.apply()
                state.turn = turn
            for at in range(start, end, BLOCK_DIGITS):
                some = slice(at, min(at + BLOCK_DIGITS, end))
                loss = self._block(np.array([h[some] for h in held]), own[some], state, each is not None)
                if each is not None:
                    each[some] = loss
        return state

    @staticmethod
    def _block(held: np.ndarray, own: np.ndarray, state: Weights, with_loss: bool) -> np.ndarray | None:
        """Digits of one stretch, few enough that what is computed of them stays near the core."""
        # by context, decision, digit
        inputs, byte = np.empty((CONTEXTS, 4, len(own)), np.float32), np.empty_like(held)
        for k in range(3):
            np.left_shift(held, 24 - 8 * k, out=byte)
            byte >>= 24
            inputs[:, k] = byte
        held >>= 24
        inputs[:, 3] = held
        z = np.einsum("ckn,cn->kn", inputs, state.scaled.take(own, axis=1))
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
        z += np.float32(1)
        p = np.divide(np.float32(1 - 1 / 2048), z, out=z)
        p += np.float32(1 / 4096)
        loss = -np.log(p[0] * p[1] * p[2] * p[3]) if with_loss else None
        off, size = np.subtract(np.float32(1), p, out=p), len(state.pull[0])
        for c, pull in enumerate(np.einsum("ckn,kn->cn", inputs, off)):
            state.pull[c] += np.bincount(own, pull, size)
        return loss


def _chunks(texts: Iterator[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes, int]]]:
    """Groups of (text, bytes, how many of them are context only); a long text comes in windows, each a group of its own."""
    held, size = [], 0
    for key, data in texts:
        if len(data) > WINDOW_BYTES:
            for at in range(0, len(data), WINDOW_BYTES):
                back = min(at, REACH)
                yield [(key, data[at - back : at + WINDOW_BYTES], back)]
            continue
        held.append((key, data, 0))
        size += len(data)
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _coded(coder: Coder, chunk: list[tuple[int, bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digit, rows, text's place in the chunk) of all digits that are to be coded."""
    digits, sizes, _ = _digits(coder, chunk)
    leaf = np.array(digits.leaves())
    return leaf[0] & 15, leaf >> 4, np.repeat(np.arange(len(chunk)), sizes)


def _digits(coder: Coder, chunk: list[tuple[int, bytes, int]]) -> tuple[Digits, np.ndarray, np.ndarray]:
    """The digits that are to be coded, how many of each text, and for each byte how many of the chunk's tokens end before it."""
    data = np.frombuffer(b"".join(_PAD + d for _, d, _ in chunk), np.uint8)
    coded, heads, at = np.ones(len(data), bool), [], 0
    for _, d, skipped in chunk:
        coded[at : at + len(_PAD) + skipped] = False
        heads.append(at)
        at += len(_PAD) + len(d)
    digits = coder(data, np.flatnonzero(coded))
    ends = ((data == 32) | (data == 10)) & coded
    sizes = np.diff(np.append(np.searchsorted(digits.at, heads), len(digits.at)))
    return digits, sizes, np.cumsum(ends) - ends


def first_weights() -> np.ndarray:
    return np.full((GATES, CONTEXTS), FIRST_WEIGHT, np.float32)


PARTIAL = "kind string, token binary, slice int, n long, data binary"
PARTIAL_NAMES, PARTIAL_TYPES = ["kind", "token", "slice", "n", "data"], [pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]


def _gather(ranks: np.ndarray):
    """A task's share of the corpus as token counts, table slices and trained weights."""

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PARTIAL_TYPES, strict=True)], PARTIAL_NAMES)

    def tokens_of(held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        found = pa.chunked_array(held, pa.binary()).value_counts()
        held.clear()
        tokens, n = found.field(0), found.field(1)
        kind, zeros, nothing = pa.repeat("token", len(n)), pa.repeat(pa.scalar(0, pa.int32()), len(n)), pa.nulls(len(n), pa.binary())
        whole = pa.RecordBatch.from_arrays([kind, tokens, zeros, n, nothing], PARTIAL_NAMES)
        yield from (whole.slice(at, 20_000) for at in range(0, len(n), 20_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, mixer = Coder(ranks), Mixer(first_weights())
        counts = np.zeros((CONTEXTS, _ROWS * 16), np.int32)
        leaves = Leaves()
        held: list[pa.Array] = []
        texts, coded = 0, 0

        def streams(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                words, _, found = _split(batch.column(0).slice(at, ROWS_AT_ONCE))
                held.append(words.filter(pc.greater(pc.binary_length(words), 0)))
                yield from enumerate(found, at)

        for batch in batches:
            texts += batch.num_rows
            for chunk in _chunks(streams(batch)):
                digits = _digits(coder, chunk)[0]
                leaf = digits.leaves()
                after = mixer.mix(leaves, leaf)
                after.apply()
                mixer.first = after.now.T
                coded += 1
                for c in range(CONTEXTS):
                    np.add.at(counts[c], leaf[c], np.int32(1))
                if coded % RENEWED == 0 or coded & coded - 1 == 0:
                    leaves.renew(counts)
                if sum(map(len, held)) > HELD_TOKENS:
                    yield from tokens_of(held)
            pa.default_memory_pool().release_unused()
        del leaves
        if not texts:
            return
        yield from tokens_of(held)
        yield frame([("texts", None, 0, texts, None)])
        if coded:
            yield frame([("weights", None, 0, coded, (mixer.first.astype(np.float64) * coded).tobytes())])
        sliced = counts.reshape(-1, SLICE_ROWS * 16)
        for at in range(0, len(sliced), 1024):
            some = at + np.flatnonzero(sliced[at : at + 1024].any(axis=1))
            if len(some):
                yield frame([("slice", None, int(s), 0, zlib.compress(sliced[s].tobytes(), 1)) for s in some])
        pa.default_memory_pool().release_unused()  # the process is kept for other tasks

    return run


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed slices as log-odds; rows come sorted by slice."""
    key, total = None, None

    def done(key: int | None, total: np.ndarray) -> pa.RecordBatch:
        data = node_table(total.reshape(-1, 16)).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([data], pa.binary())], ["slice", "data"])

    for batch in batches:
        for s, data in zip(batch.column(0), batch.column(1), strict=True):
            if s.as_py() != key:
                if key is not None:
                    yield done(key, total)
                key, total = s.as_py(), np.zeros(SLICE_ROWS * 16, np.int64)
            total += np.frombuffer(zlib.decompress(data.as_buffer()), np.int32)
    if key is not None:
        yield done(key, total)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """What Spark hands to a task's Python at once is small beside the tables that it holds; jobs that run meanwhile get such batches."""
    wanted = {"maxRecordsPerBatch": str(BATCH_ROWS), "maxBytesPerBatch": str(BATCH_BYTES)}
    before = {f"spark.sql.execution.arrow.{k}": (v, spark.conf.get(f"spark.sql.execution.arrow.{k}")) for k, v in wanted.items()}
    try:
        for key, (value, _) in before.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, (_, value) in before.items():
            spark.conf.set(key, value)


def byte_ranks(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Each byte's rank by how often it occurs in the lower-cased texts, and their bytes altogether."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                if text.is_valid:
                    total += np.bincount(np.frombuffer(text.as_buffer(), np.uint8), minlength=256)
        upper, lower = slice(65, 91), slice(97, 123)
        total[lower] += total[upper]
        total[upper] = 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total)], ["byte", "n"])

    found = docs.select(F.col(text_col)).mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    n = np.zeros(256, np.int64)
    for row in found.collect():
        n[row["byte"]] = row["n"]
    ranks = np.empty(256, np.int64)
    ranks[np.argsort(-n, kind="stable")] = np.arange(256)
    return ranks, int(n.sum())


class Model:
    """What scoring needs: byte ranks, log-odds tables, first weights, and token counts."""

    def __init__(self, ranks, tables, weights, vocabulary: DataFrame, words: int, distinct_words: int, texts: int) -> None:
        self.ranks, self.tables, self.weights = ranks, tables, weights
        self.vocabulary, self.texts = vocabulary, texts
        #: with the end tokens, one for each text
        self.train_tokens, self.distinct = words + texts, distinct_words + (texts > 0)


def train(docs: DataFrame, *, text_col: str = "text") -> Model:
    """The model from all rows of ``docs``."""
    spark = docs.sparkSession
    with _small_batches(spark):
        ranks, size = byte_ranks(docs, text_col)
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    gathered = docs.select(F.col(text_col).alias("text")).coalesce(tasks).mapInArrow(_gather(ranks), PARTIAL)
    with _small_batches(spark):
        parts = materialize(gathered, "lm-counts")
    texts = parts.filter("kind = 'texts'").agg(F.sum("n")).first()[0] or 0
    vocabulary = parts.filter("kind = 'token'").groupBy("token").agg(F.sum("n").alias("c"))
    vocabulary = materialize(vocabulary, "lm-vocabulary")
    words = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()

    slices = parts.filter("kind = 'slice'").select("slice", "data")
    summed = slices.repartition("slice").sortWithinPartitions("slice").mapInArrow(_sum_slices, "slice int, data binary")
    tables = np.zeros((CONTEXTS * _ROWS // SLICE_ROWS, SLICE_ROWS * 16), np.int8)
    for row in summed.collect():  # a fixed number of slices
        tables[row["slice"]] = np.frombuffer(row["data"], np.int8)
    weights = _mean_weights(parts)
    discard(parts)
    return Model(ranks, tables.reshape(CONTEXTS, _ROWS, 16), weights, vocabulary, words["n"] or 0, words["v"], texts)


def _mean_weights(parts: DataFrame) -> np.ndarray:
    """The tasks' weights, averaged by how many chunks each has trained on."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(GATES * CONTEXTS)
        for batch in batches:
            for one, data in zip(batch["n"], batch["data"], strict=True):
                n, total = n + int(one), total + np.frombuffer(data, np.float64)
        yield pd.DataFrame({"at": np.arange(len(total) + 1), "x": [*total, float(n)]})

    found = parts.filter("kind = 'weights'").select("n", "data").mapInPandas(add, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    sums = {r["at"]: r["x"] for r in found.collect()}
    n = sums.get(GATES * CONTEXTS, 0.0)
    if not n:
        return first_weights()
    return np.array([sums[i] / n for i in range(GATES * CONTEXTS)], np.float32).reshape(GATES, CONTEXTS)


def _common_tokens(vocabulary: DataFrame) -> dict[bytes, int]:
    """The commonest tokens, ``COMMON_TOKENS`` at most: those above the count that so many have at most."""
    short = vocabulary.filter(F.octet_length("token") <= COMMON_BYTES)
    step = F.floor(F.log2("c") * 8).cast("int")
    steps = sorted(((r["step"], r["count"]) for r in short.groupBy(step.alias("step")).count().collect()), reverse=True)
    n, least = 0, None
    for at, more in steps:
        if n + more > COMMON_TOKENS:
            break
        n, least = n + more, at
    if least is None:
        return {}
    return {bytes(r["token"]): r["c"] for r in short.filter(step >= least).collect()}


SCORED = (
    "row_no long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, mixed array<double>, "
    "n_bytes long, rare array<struct<token: binary, cost: double, gap: double>>"
)
_RARE = pa.struct([("token", pa.binary()), ("cost", pa.float64()), ("gap", pa.float64())])


def gap_logs(words: int, texts: int) -> tuple[float, float]:
    """Log-probability that a blank, or the line feed, comes after a token."""
    end = min(max(texts / (words + texts), 1e-6), 0.5) if texts else 0.5
    return math.log(1 - end), math.log(end)


def _log_mixed(cost: Column, known: Column, gap: Column, share: float, log_all: float) -> Column:
    """Log-probability of a token: of its bytes, and of its count where it has one."""
    if share == 1:
        return -cost
    here = math.log(share) - cost
    there = F.log(known + 0.1) + gap + F.lit(math.log(1 - share) - log_all)
    return F.when(known > 0, F.greatest(here, there) + F.log1p(F.exp(-F.abs(here - there)))).otherwise(here)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score, bits_per_byte) for every row of ``docs``."""
    spark = docs.sparkSession
    total, distinct = model.train_tokens, model.distinct
    # of fixed size: tables of CONTEXTS * 2**ROW_BITS * 16 bytes, and COMMON_TOKENS tokens of COMMON_BYTES at most
    shared = spark.sparkContext.broadcast((model.ranks, model.tables.tobytes(), model.weights, _common_tokens(model.vocabulary)))
    end_count = model.texts
    gaps = gap_logs(total - end_count, end_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, data, weights, common = shared.value
        leaves = Leaves(np.frombuffer(data, np.int8).reshape(CONTEXTS, _ROWS, 16))
        coder, mixer = Coder(ranks), Mixer(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield _scored(batch.slice(at, ROWS_AT_ONCE), leaves, coder, mixer, common, total, distinct, end_count, gaps)
            pa.default_memory_pool().release_unused()

    rows = docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        in_fold(F.col(id_col)).alias("held_out"),
    )
    with _small_batches(spark):
        scored = materialize(rows.mapInArrow(run, SCORED), "lm-scored")
    rare = scored.select("row_no", F.explode("rare").alias("r")).select("row_no", "r.*").join(model.vocabulary, "token", "left")
    known = F.coalesce("c", F.lit(0))
    each = F.log10((known + 0.1) / F.lit(total + 0.1 * (distinct + 1)))
    log_all = math.log(total + 0.1 * (distinct + 1))
    more = [F.sum(_log_mixed(F.col("cost"), known, F.col("gap"), share, log_all)).alias(f"more_{k}") for k, share in enumerate(SHARES)]
    rare = rare.groupBy("row_no").agg(F.sum(each).alias("more"), F.count_if(known > 0).alias("more_known"), *more)
    zero = F.lit(0)
    sums = [F.col("mixed")[k] + F.coalesce(f"more_{k}", F.lit(0.0)) for k in range(len(SHARES))]
    most = F.greatest(*sums)
    mean = most + F.log(sum((F.exp(x - most) for x in sums), F.lit(0.0)) / len(SHARES))
    return scored.join(rare, "row_no", "left").withColumn("score", mean / math.log(10)).select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", zero)).alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _scored(batch: pa.RecordBatch, leaves, coder, mixer, common, total, distinct, end_count, gaps) -> pa.RecordBatch:
    words, lengths, streams = _split(batch.column("text"))
    n, sizes = len(streams), list(map(len, streams))
    # a text without words is one token, which has no count
    ends = np.cumsum(lengths)
    begins, begun, nats = ends - lengths, np.zeros(n, np.int64), np.zeros(lengths.sum())

    state: dict[int, Weights] = {}
    for chunk in _chunks(enumerate(streams)):
        digits, parts, token = _digits(coder, chunk)
        key, each, text, cuts = chunk[0][0], np.empty(len(digits.at)), None, None
        if len(chunk) > 1:
            order, text, cuts = _stretches(parts)
            digits = digits.taken(order)
        after = mixer.mix(leaves, digits.leaves(), text, cuts, len(chunk), state=None if text is not None else state.get(key), each=each)
        if len(chunk) == 1:
            state = {key: after}
        first = begins[key] + begun[key]
        found = np.bincount(token.take(digits.at), each)
        nats[first : first + len(found)] += found
        for i, data, skipped in chunk:
            begun[i] += data.count(b" ", skipped)

    coded = words.dictionary_encode()
    counts = np.array([common.get(w, math.nan) for w in _values(coded.dictionary)], float).take(coded.indices.to_numpy())  # NaN: not in memory
    empty = np.array(sizes) == 1
    counts[begins[empty]] = 0
    rare, known = np.isnan(counts), counts > 0
    gap = np.full(len(nats), gaps[0])
    gap[ends - 1] = gaps[1]
    log_all, mixed = math.log(total + 0.1 * (distinct + 1)), np.empty((n, len(SHARES)))
    there = np.log(np.where(known, counts, 1) + 0.1) - log_all
    for k, share in enumerate(SHARES):
        here = math.log(share) - nats
        if share < 1:
            other = there + gap + math.log(1 - share)
            here = np.where(known, np.maximum(here, other) + np.log1p(np.exp(-np.abs(here - other))), here)
        mixed[:, k] = np.add.reduceat(np.where(rare, 0, here), begins) if n else 0
    end_base = (math.log(end_count + 0.1) - log_all) / math.log(10)
    bases = np.add.reduceat(np.where(known, there, 0), begins) / math.log(10) + end_base if n else np.zeros(0)
    seen = np.add.reduceat(known.astype(np.int64), begins) + (end_count > 0) if n else np.zeros(0, np.int64)
    tokens = (lengths + 1 - empty).astype(np.int64)
    where = np.flatnonzero(rare)
    owner = np.searchsorted(ends, where, "right")
    fields = [words.take(pa.array(where)), pa.array(nats[where]), pa.array(gap[where])]
    others = pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32), pa.StructArray.from_arrays(fields, fields=list(_RARE)))
    shares = pa.ListArray.from_arrays(np.arange(0, len(SHARES) * (n + 1), len(SHARES), dtype=np.int32), pa.array(mixed.ravel()))
    held = [batch.column(c) for c in ("row_no", "doc_id", "held_out")]
    figures = [
        pa.array(tokens), pa.array(seen), pa.array(bases), shares, pa.array(sizes, pa.int64()), others,
    ]
    return pa.RecordBatch.from_arrays(held + figures, ["row_no", "doc_id", "held_out", "n_tokens", "n_known", "base", "mixed", "n_bytes", "rare"])


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under the model of the nine folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(~in_fold(F.col("doc_id"))))
    return score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES = {"op4_context_mixing": op4_context_mixing}
ORACLE_SQL: dict[str, str] = {}
