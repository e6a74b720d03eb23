"""Exact top-k inner-product search over a bit-sliced index.

The index holds blocks of rows. In a block each attribute (vector component,
quantised to an integer) is stored as bitmaps: slice j of attribute i has one
bit per row, bit j of the row's value less the attribute's least value there.
A query's scores are a weighted sum of attributes, so the slices, or their
complements for negative weights, are added with carry-save adders on packed
words: no row is touched one by one. The best rows are then selected from the
most significant slice of the sums downward, and the rows that the slices
leave at the boundary are resolved by their exact scores and identifiers.

The index is a table: each block with its slices, its identifiers, and the values
that boundary rows are resolved by. A block is sent to one task once; the query
blocks, a small share of the rows, are sent to every block and pass by it one
after another. Each meeting gives at most k rows for each query.

Defined cases: vectors that are null or hold a null or non-finite component take
no part; an empty vector takes part, and every score with it is 0; shorter vectors
count as padded with zeros; rows that repeat an identifier are rows of their own,
as candidates and as queries; a row without identifier is a candidate, after all
others in a tie; scores beyond 64 bits are clipped to its range; an empty table
gives an empty result; columns of the input beside identifier and vector are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.storage import discard, materialize, table

#: Rows of an index block: so many at least, and at most, with several blocks for each core between.
LEAST_BLOCK, MOST_BLOCK, BLOCKS_PER_CORE = 8192, 65_536, 2
#: Values of a block at most, whatever the vectors' width.
BLOCK_CELLS = 1 << 22
QUERY_ROWS = 256
MOST_SLICES = 12  # attributes that need more are quantised further; the boundary rows take care of it
#: Stands for a missing identifier, and comes after all others.
NO_ID = (1 << 63) - 1

BLOCK_SCHEMA = "block long, kind int, q_block long, rows int, width int, shift int, slices int, ids binary, row_nos binary, least binary, bits binary, cells binary"
BLOCK_NAMES = [c.strip().split(" ")[0] for c in BLOCK_SCHEMA.split(",")]
PAIR_SCHEMA = "query_no long, query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector of double): the rows with whole finite vectors."""
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("v").isNotNull() & finite)


def _cells(rows: pd.DataFrame) -> np.ndarray:
    width = max(1, int(rows["q"].map(len).max()))
    cells = np.zeros((len(rows), width), np.int64)
    for r, q in enumerate(rows["q"]):
        cells[r, : len(q)] = q
    return cells


def _narrow(cells: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    low, high = int(cells.min(initial=0)), int(cells.max(initial=0))
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return cells.astype(kind)
    return cells


def _packed(kind: int):
    """A group of rows as one row of the index (kind 0, with its slices) or of the queries (kind 1)."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_no")
        cells = _cells(rows)
        ids = rows["vec_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
        shift = slices = 0
        least = bits = b""
        if kind == 0:
            block = SlicedBlock.of(ids, rows["row_no"].to_numpy(np.int64), cells)
            shift, slices, least, bits = block.shift, block.slices, block.least.tobytes(), block.bits.tobytes()
        block_no, q_block = (key[0], -1) if kind == 0 else (-1, key[0])
        held = (block_no, kind, q_block, len(ids), cells.shape[1], shift, slices, ids.tobytes(), rows["row_no"].to_numpy(np.int64).tobytes(), least, bits)
        return pd.DataFrame([(*held, _narrow(cells).tobytes())], columns=BLOCK_NAMES)

    return pack


def blocks(vectors: DataFrame, count: int, kind: int) -> DataFrame:
    """Rows packed by a hash of their number: a block is a bounded share of them."""
    keyed = vectors.withColumn("block", F.pmod(F.xxhash64("row_no"), F.lit(count)))
    return keyed.groupBy("block").applyInPandas(_packed(kind), BLOCK_SCHEMA)


def _table_of(row: dict) -> np.ndarray:
    size = len(row["cells"]) // (row["rows"] * row["width"])
    return np.frombuffer(row["cells"], {2: np.int16, 4: np.int32, 8: np.int64}[size]).reshape(row["rows"], row["width"])


class SlicedBlock:
    """The bitmaps of one block of rows."""

    def __init__(self, ids, row_nos, cells, least, shift: int, slices: int, bits) -> None:
        self.ids, self.row_nos, self.cells = ids, row_nos, cells
        self.least, self.shift, self.slices = least, shift, slices
        self.words = -(-len(ids) // 64)
        #: by attribute, slice, word
        self.bits = bits
        full = np.zeros(self.words * 64, np.uint8)
        full[: len(ids)] = 1
        self.all_rows = np.packbits(full, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray, row_nos: np.ndarray, cells: np.ndarray) -> SlicedBlock:
        least = cells.min(axis=0)
        # values over int64 can't come from floor() of a scaled float within range; spans are taken as floats
        span = float((cells.max(axis=0).astype(float) - least.astype(float)).max())
        slices = max(1, int(span).bit_length())
        shift = max(0, slices - MOST_SLICES)
        slices -= shift
        offset = ((cells - least) >> shift).astype(np.uint16)
        padded = np.zeros((-(-len(ids) // 64) * 64, cells.shape[1]), np.uint16)
        padded[: len(ids)] = offset
        planes = [np.packbits((padded >> j & 1).astype(np.uint8), axis=0, bitorder="little") for j in range(slices)]
        bits = np.ascontiguousarray(np.stack(planes).transpose(2, 0, 1)).view(np.uint64)
        return cls(ids, row_nos, cells, least, shift, slices, bits)

    @classmethod
    def stored(cls, row: dict) -> SlicedBlock:
        words = -(-row["rows"] // 64)
        bits = np.frombuffer(row["bits"], np.uint64).reshape(row["width"], row["slices"], words)
        ids, row_nos, least = (np.frombuffer(row[c], np.int64) for c in ("ids", "row_nos", "least"))
        return cls(ids, row_nos, _table_of(row), least, row["shift"], row["slices"], bits)

    def sums(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of sum |w| * (value or its complement), least significant first, and the sum's error bound."""
        columns: list[list[np.ndarray]] = []
        for sign in (1, -1):
            size = np.where(weights * sign > 0, np.abs(weights), 0)
            for t in range(int(size.max(initial=0)).bit_length()):
                chosen = np.flatnonzero(size >> t & 1)
                if not len(chosen):
                    continue
                for j in range(self.slices):
                    while len(columns) <= t + j:
                        columns.append([])
                    plane = self.bits[chosen, j]
                    columns[t + j].append(plane if sign > 0 else ~plane)
        out: list[np.ndarray] = []
        p = 0
        while p < len(columns):
            stack = np.concatenate(columns[p]) if columns[p] else np.zeros((0, self.words), np.uint64)
            while len(stack) > 1:
                carry, stack = _add(stack)
                if p + 1 == len(columns):
                    columns.append([])
                columns[p + 1].append(carry)
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            p += 1
        error = int(np.abs(weights).sum()) * ((1 << self.shift) - 1)
        return out, error

    def best(self, query_no: int, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The block's k best (vec_id, score) for a query, its own row aside, ties to the smaller identifier."""
        # attributes that only one of the two has add nothing
        weights = np.pad(weights[: self.cells.shape[1]], (0, max(0, self.cells.shape[1] - len(weights))))
        rows = self.all_rows.copy()
        own = int(np.searchsorted(self.row_nos, query_no))  # row numbers are in order
        if own < len(self.row_nos) and self.row_nos[own] == query_no:
            rows[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        slices, error = self.sums(weights)
        sure, edge, left = np.zeros_like(rows), rows, k
        if error == 0:
            for plane in reversed(slices):
                high = edge & plane
                n = int(np.bitwise_count(high).sum())
                if n > left:
                    edge = high
                else:
                    sure, edge, left = sure | high, edge & ~plane, left - n
                if not left:
                    break
            picked = sure | edge if left else sure
        else:
            picked = self._near(slices, rows, k, error)
        index = np.flatnonzero(np.unpackbits(picked.view(np.uint8), bitorder="little"))
        return exact(self.ids[index], self.cells[index], weights, k)

    def _near(self, slices: list[np.ndarray], rows: np.ndarray, k: int, error: int) -> np.ndarray:
        """All rows whose coarse sum is within the error of the k-th best one."""
        edge, left, kth = rows, k, 0
        for p in range(len(slices) - 1, -1, -1):
            high = edge & slices[p]
            n = int(np.bitwise_count(high).sum())
            if n >= left:
                edge, kth = high, kth | 1 << p
            else:
                edge, left = edge & ~slices[p], left - n
        floor = max(0, kth - (error >> self.shift) - 2)
        above, equal = np.zeros_like(rows), rows
        for p in range(len(slices) - 1, -1, -1):
            if floor >> p & 1:
                equal = equal & slices[p]
            else:
                above, equal = above | equal & slices[p], equal & ~slices[p]
        return above | equal


def _add(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full adders on threes of bitmaps (half adders on a last two): carries, and what stays in this column."""
    threes = len(stack) // 3
    a, b, c = stack[:threes], stack[threes : 2 * threes], stack[2 * threes : 3 * threes]
    rest = stack[3 * threes :]
    if not threes:
        return (rest[:1] & rest[1:2]), rest[:1] ^ rest[1:2]
    half = a ^ b
    return (a & b) | (c & half), np.concatenate([half ^ c, rest])


def exact(ids: np.ndarray, cells: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
    if not len(ids):
        return []
    cells = cells.astype(np.int64)
    bound = float(np.abs(cells).max()) * float(np.abs(weights).sum())
    if bound < 2**62:
        scores = [int(s) for s in cells @ weights]
    else:
        plain = [int(w) for w in weights]
        scores = [min(max(sum(int(c) * w for c, w in zip(row, plain, strict=True)), -(2**63)), 2**63 - 1) for row in cells]
    best = sorted(zip(scores, ids.tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:k]
    return [(i, s) for s, i in best]


def _search(k: int):
    """Each block's best rows for the queries that come after it; rows are sorted by block, the block itself first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in BLOCK_NAMES}
                if row["kind"] == 0:
                    number, held = row["block"], SlicedBlock.stored(row)
                    continue
                if row["block"] != number:
                    continue  # a block that no row has been dealt to
                queries = _table_of(row).astype(np.int64)
                asked = zip(*(np.frombuffer(row[c], np.int64).tolist() for c in ("row_nos", "ids")), queries, strict=True)
                out = [(no, q, None if i == NO_ID else i, s) for no, q, w in asked for i, s in held.best(no, w, k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_no", "query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame,
    query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    k: int = 5,
    block_rows: int | None = None,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row for which ``query`` (over vec_id) holds."""
    spark = vectors.sparkSession
    whole = usable(vectors, id_col, vector_col).select(F.monotonically_increasing_id().alias("row_no"), "vec_id", quantised(F.col("v"), scale).alias("q"))
    whole = materialize(whole, "quantised")
    asked = whole.filter(query)
    held = whole.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).first()
    n, width, n_asked = held["n"], held["width"] or 1, asked.count()
    if block_rows is None:
        most = max(1, min(MOST_BLOCK, BLOCK_CELLS // max(1, width)))
        block_rows = min(most, max(LEAST_BLOCK, n // (BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism)))
    n_blocks, q_blocks = max(1, -(-n // block_rows)), max(1, -(-n_asked // query_rows))
    index = materialize(blocks(whole, n_blocks, 0), "bit-sliced")
    queries = materialize(blocks(asked, q_blocks, 1).drop("block"), "bit-sliced-queries")
    discard(whole)
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    meet = index.unionByName(queries.withColumn("block", everywhere))
    found = meet.repartitionById(n_blocks, F.col("block").cast("int")).sortWithinPartitions("block", "kind", "q_block").mapInArrow(_search(k), PAIR_SCHEMA)
    found = materialize(found, "found")
    discard(index, queries)
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 50th vector's five best others by integer inner product."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op10_bit_sliced_topk": op10_bit_sliced_topk}
ORACLE_SQL = {
    "op10_bit_sliced_topk": """
        WITH usable AS (
            SELECT row_number() OVER () AS row_no, vec_id,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.row_no AS query_no, a.vec_id AS query_id, b.vec_id AS vec_id,
                   CASE WHEN len(a.q) = 0 OR len(b.q) = 0 THEN 0
                        ELSE CAST(list_inner_product(a.q[:least(len(a.q), len(b.q))], b.q[:least(len(a.q), len(b.q))]) AS BIGINT) END AS score
            FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.row_no <> b.row_no),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_no ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank
            FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """
}
