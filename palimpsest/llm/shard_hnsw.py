"""Approximate nearest neighbours by inner product: a hierarchical small-world graph for each shard.

Equal vectors are one vertex that knows the smallest identifiers of its rows: as many
as a result can ever name, chosen before anything is gathered, so a vector that a third
of all rows hold is one vertex. Vertices are dealt to shards by a hash of the vector.

A shard is one row of a table with flat arrays. Vertices are in order of falling level,
so the vertices of a layer are the first ones of the shard, and a layer is an array of
neighbour numbers of fixed width. A layer is built on the finished one above: its first
vertices, those of the layer above among them, are linked by exact comparison, the
others come in groups, descend from the top layer, meet their candidates by a beam
search over what is linked already, and keep those that are nearer to them than to a
neighbour kept before. Neighbours link back; a full list is chosen anew. Vertices that
the lowest layer's links don't lead to are noted, and every search compares them too.

Inner products are turned into nearness by one more component, which gives all vertices
the same length; a query has 0 there. The graph proposes vertices; scores are inner
products of the original vectors in double precision. A shard that proposes fewer rows
than wanted, though it has them, is compared whole for that query. Query blocks are sent
to every shard, and each meeting gives at most k rows for each query, which are merged.

Defined cases: vectors that are null, zero or hold a null or non-finite component take no
part; shorter vectors count as padded with zeros; rows that repeat an identifier are rows
of their own, as candidates and as queries; a row without identifier is a candidate, after
all others in a tie, and no query; products beyond the range of doubles are infinite and
order as such; an empty table gives an empty result; columns of the input beside
identifier and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.storage import discard, materialize, table

#: Vertices of a shard: so many at least, and at most, with several shards for each core between.
LEAST_SHARD, MOST_SHARD, SHARDS_PER_CORE = 2048, 65_536, 2
#: Values of a shard at most, whatever the vectors' width.
SHARD_CELLS = 1 << 23
#: Neighbours in upper layers and, twice as many, in the lowest; beam of building and of searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 96, 160
GROUP, QUERY_ROWS, EXPANDED = 256, 256, 4
NO_ID = (1 << 63) - 1

SHARD_SCHEMA = "shard long, kind int, q_block long, rows int, width int, cells binary, row_nos binary, ids binary, spans binary, layers binary, links binary, apart binary"
SHARD_NAMES = [c.strip().split(" ")[0] for c in SHARD_SCHEMA.split(",")]
PAIR_SCHEMA = "query_no long, query_id long, vec_id long, score double"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row_no, vec_id, v): rows whose vector can be compared; equal vectors are equal bit by bit."""
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.filter(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return whole.select(F.monotonically_increasing_id().alias("row_no"), "vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def vertices(rows: DataFrame, most: int) -> DataFrame:
    """(v, holders): each vector with its ``most`` rows of smallest identifier; others can be in no result.

    The rank's limit is applied where rows are read, before they are exchanged, so a hot vector is a few rows of each task.
    """
    order = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last(), "row_no")
    first = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
    holder = F.struct("nth", "row_no", F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"))
    return first.groupBy("v").agg(F.array_sort(F.collect_list(holder)).alias("holders"))


class Graph:
    """Layers over the first vertices of a shard: ``links[l]`` has a row of neighbours, or -1, for each vertex of layer l."""

    def __init__(self, points: np.ndarray, links: list[np.ndarray]) -> None:
        self.points, self.links = points, links

    @classmethod
    def of(cls, points: np.ndarray, counts: list[int], width: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
        graph = cls(points, [np.full((n, 2 * width if not level else width), -1, np.int32) for level, n in enumerate(counts)])
        for level in reversed(range(len(counts))):
            graph._fill(level, beam)
        return graph

    def _fill(self, level: int, beam: int) -> None:
        n = len(self.links[level])
        above = len(self.links[level + 1]) if level + 1 < len(self.links) else 0
        first = min(n, max(above, GROUP))
        for begin in range(0, first, GROUP):
            own = np.arange(begin, min(first, begin + GROUP))
            sims = self.points[own] @ self.points[:first].T
            sims[np.arange(len(own)), own] = -np.inf
            self._link(level, own, *_best(np.broadcast_to(np.arange(first), sims.shape), sims, beam))
        for begin in range(first, n, GROUP):
            own = np.arange(begin, min(n, begin + GROUP))
            found, sims = self.search(self.points[own], beam, level)
            # those of one group don't find each other in the graph
            among = self.points[own] @ self.points[own].T
            among[np.arange(len(own)), np.arange(len(own))] = -np.inf
            found = np.concatenate([found, np.broadcast_to(own, among.shape)], axis=1)
            self._link(level, own, *_best(found, np.concatenate([sims, among], axis=1), beam))

    def _chosen(self, found: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of candidates, best first, those nearer to their vertex than to one chosen before; then the best of the others."""
        held = self.points[np.maximum(found, 0)]
        between = held @ held.transpose(0, 2, 1)
        real = np.isfinite(sims)
        barred, taken = ~real, np.zeros(found.shape, bool)
        for c in range(found.shape[1]):
            now = ~barred[:, c] & (taken.sum(axis=1) < width)
            taken[:, c] = now
            barred |= now[:, None] & (between[:, c] >= sims)
        order = np.argsort(np.where(taken, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(np.where(real, found, -1), order, axis=1)
        return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)

    def _link(self, level: int, own: np.ndarray, found: np.ndarray, sims: np.ndarray) -> None:
        links = self.links[level]
        width = links.shape[1]
        links[own] = self._chosen(found, sims, width)
        source, target = np.repeat(own, width), links[own].ravel()
        source, target = source[target >= 0], target[target >= 0]
        # as many that link to a vertex are weighed with its list as the list has places, best first; the lists of the others name it
        sims = np.einsum("ij,ij->i", self.points[source], self.points[target])
        order = np.lexsort((source, -sims, target))
        source, target = source[order], target[order]
        begin = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
        nth = np.arange(len(target)) - np.repeat(begin, np.diff(np.r_[begin, len(target)]))
        for part in range(0, len(begin), 4 * GROUP):
            mine = begin[part : part + 4 * GROUP]
            end = begin[part + 4 * GROUP] if part + 4 * GROUP < len(begin) else len(target)
            at = slice(mine[0], end)
            news = np.full((len(mine), width), -1, np.int64)
            row, col = np.searchsorted(mine, np.arange(at.start, at.stop), side="right") - 1, nth[at]
            news[row[col < width], col[col < width]] = source[at][col < width]
            vertex = target[mine]
            old = links[vertex].astype(np.int64)
            news[(news[:, :, None] == old[:, None, :]).any(axis=2)] = -1
            both = np.concatenate([old, news], axis=1)
            sims = np.einsum("ijk,ik->ij", self.points[np.maximum(both, 0)], self.points[vertex])
            sims[both < 0] = -np.inf
            links[vertex] = self._chosen(*_best(both, sims, both.shape[1]), width)

    def search(self, queries: np.ndarray, beam: int, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``beam`` best vertices met in a layer, best first, with their products; -inf where there are fewer."""
        entry = np.zeros((len(queries), 1), np.int64)
        for upper in reversed(range(level + 1, len(self.links))):
            entry, _ = self._beam(queries, entry, 1, upper)
        return self._beam(queries, entry, beam, level)

    def _beam(self, queries: np.ndarray, entry: np.ndarray, beam: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        links = self.links[level]
        n_queries = len(queries)
        met = np.zeros((n_queries, len(links)), bool)
        pool = np.concatenate([entry, np.full((n_queries, beam - 1), -1, np.int64)], axis=1)
        sims = np.full((n_queries, beam), -np.inf, np.float32)
        sims[:, 0] = np.einsum("ij,ij->i", queries, self.points[entry[:, 0]])
        met[np.arange(n_queries), entry[:, 0]] = True
        closed = np.zeros((n_queries, beam), bool)
        wide = min(EXPANDED, beam)
        rows = np.arange(n_queries)
        while len(rows):
            open_sims = np.where(closed[rows], -np.inf, sims[rows])
            rows, open_sims = rows[keep := open_sims.max(axis=1) > -np.inf], open_sims[keep]
            if not len(rows):
                break
            best = np.argpartition(-open_sims, wide - 1, axis=1)[:, :wide]
            real = np.take_along_axis(open_sims, best, axis=1) > -np.inf
            at = rows[:, None]
            closed[at, best] |= real
            near = links[np.maximum(pool[at, best], 0)].astype(np.int64)
            near[~real] = -1
            near = near.reshape(len(rows), -1)
            # a vertex that two lists name counts once
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[met[at, np.maximum(near, 0)]] = -1
            fresh = near >= 0
            met[np.repeat(rows, fresh.sum(axis=1)), near[fresh]] = True
            new_sims = np.einsum("ijk,ik->ij", self.points[np.maximum(near, 0)], queries[rows])
            new_sims[~fresh] = -np.inf
            all_pool, all_sims = np.concatenate([pool[rows], near], axis=1), np.concatenate([sims[rows], new_sims], axis=1)
            all_closed = np.concatenate([closed[rows], ~fresh], axis=1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            pool[rows], sims[rows], closed[rows] = (np.take_along_axis(x, keep, axis=1) for x in (all_pool, all_sims, all_closed))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(pool, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def apart(self) -> np.ndarray:
        """Vertices that the lowest layer's links don't lead to from the entry."""
        links = self.links[0]
        met = np.zeros(len(links), bool)
        front = np.zeros(1, np.int64)
        while len(front):
            met[front] = True
            near = np.unique(links[front])
            near = near[near >= 0]
            front = near[~met[near]]
        return np.flatnonzero(~met)


def _best(found: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(found, order, axis=1), np.take_along_axis(sims, order, axis=1)


def levels(n: int, width: int = LINKS) -> list[int]:
    """How many of n vertices each layer has: a share of 1 / width of those below, as independent levels would give on average."""
    counts = [n]
    while counts[-1] > width:
        counts.append(-(-counts[-1] // width))
    return counts


def lifted(cells: np.ndarray) -> np.ndarray:
    """Vectors of one length whose products with a query that has 0 at the end are in the order of the originals'."""
    scaled = cells / max(float(np.abs(cells).max(initial=0)), 5e-324)
    squares = (scaled * scaled).sum(axis=1)
    last = np.sqrt(np.maximum(squares.max() - squares, 0))
    return np.concatenate([scaled, last[:, None]], axis=1).astype(np.float32)


def products(cells: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each row's summed in the same order whatever rows are beside it."""
    width = min(cells.shape[1], len(query))
    with np.errstate(over="ignore", invalid="ignore"):
        out = (cells[:, :width].astype(float) * query[:width]).sum(axis=1)
    return np.nan_to_num(out, nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def _cells(vectors: pd.Series) -> np.ndarray:
    cells = np.zeros((len(vectors), max(map(len, vectors))))
    for r, v in enumerate(vectors):
        cells[r, : len(v)] = v
    small = cells.astype(np.float32)
    return small if (small == cells).all() else cells


def _grown(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's vertices as one row: in an order that a hash of the vectors has dealt, with graph and holders."""
    rows = rows.sort_values(["dealt", "first_no"])
    cells = _cells(rows["v"])
    graph = Graph.of(lifted(cells), levels(len(cells)))
    holders = [h for holder in rows["holders"] for h in holder]
    spans = np.cumsum([0, *map(len, rows["holders"])])
    row_nos, ids = (np.array([h[name] for h in holders], np.int64) for name in ("row_no", "vec_id"))
    layers = np.array([x.shape for x in graph.links], np.int64)
    links = np.concatenate([x.ravel() for x in graph.links])
    parts = (cells, row_nos, ids, spans, layers, links, graph.apart())
    return pd.DataFrame([(key[0], 0, -1, len(cells), cells.shape[1], *(x.tobytes() for x in parts))], columns=SHARD_NAMES)


def _asked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("row_no")
    cells = _cells(rows["v"])
    row_nos, ids = (rows[c].to_numpy(np.int64) for c in ("row_no", "vec_id"))
    return pd.DataFrame([(-1, 1, key[0], len(cells), cells.shape[1], cells.tobytes(), row_nos.tobytes(), ids.tobytes(), b"", b"", b"", b"")], columns=SHARD_NAMES)


def _table_of(row: dict) -> np.ndarray:
    size = len(row["cells"]) // (row["rows"] * row["width"])
    return np.frombuffer(row["cells"], np.float32 if size == 4 else np.float64).reshape(row["rows"], row["width"])


class Shard:
    def __init__(self, row: dict) -> None:
        self.cells = _table_of(row)
        self.row_nos, self.ids, self.spans = (np.frombuffer(row[c], np.int64) for c in ("row_nos", "ids", "spans"))
        self.apart = np.frombuffer(row["apart"], np.int64)
        flat, links, at = np.frombuffer(row["links"], np.int32), [], 0
        for n, width in np.frombuffer(row["layers"], np.int64).reshape(-1, 2):
            links.append(flat[at : at + n * width].reshape(n, width))
            at += n * width
        self.graph = Graph(lifted(self.cells), links)

    def best(self, row_nos: np.ndarray, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, list[int], list[float]]]:
        """(number of the query, identifiers, scores) of the k best rows that the graph finds, the query's own row aside."""
        size = queries.astype(float) / np.maximum(np.abs(queries).max(axis=1, keepdims=True), 5e-324)
        width = self.cells.shape[1]
        narrow = np.zeros((len(size), width + 1), np.float32)
        narrow[:, : min(width, size.shape[1])] = size[:, :width]
        found, sims = self.graph.search(narrow, min(max(beam, k + 1), len(self.cells)))
        for q in range(len(queries)):
            near = np.unique(np.concatenate([found[q][np.isfinite(sims[q])], self.apart]))
            out = self._ranked(near, int(row_nos[q]), queries[q], k)
            if len(out[0]) < k and len(near) < len(self.cells):
                out = self._ranked(np.arange(len(self.cells)), int(row_nos[q]), queries[q], k)
            yield q, *out

    def _ranked(self, near: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[list[int], list[float]]:
        scores = products(self.cells[near], query)
        if len(near) > k + 1:
            # ties of the last one stay: the identifiers decide
            last = -np.partition(-scores, k)[k]
            near, scores = near[scores >= last], scores[scores >= last]
        spans = [(self.spans[v], self.spans[v + 1]) for v in near]
        rows = np.concatenate([np.arange(b, e) for b, e in spans])
        scores = np.repeat(scores, [e - b for b, e in spans])
        rows, scores = rows[keep := self.row_nos[rows] != own], scores[keep]
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[order]].tolist(), scores[order].tolist()


def _search(k: int, beam: int):
    """Each shard's best rows for the queries that come after it; rows are sorted by shard, the shard itself first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in SHARD_NAMES}
                if row["kind"] == 0:
                    number, held = row["shard"], Shard(row)
                    continue
                if row["shard"] != number:
                    continue  # a shard that no vertex has been dealt to
                numbers, ids = (np.frombuffer(row[c], np.int64) for c in ("row_nos", "ids"))
                out = [(int(numbers[q]), int(ids[q]), None if v == NO_ID else v, s) for q, found, scores in held.best(numbers, _table_of(row), k, beam) for v, s in zip(found, scores, strict=True)]
                if out:
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_no", "query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame,
    query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    beam: int = SEARCH_BEAM,
    shard_rows: int | None = None,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``query`` (over vec_id) holds, the k best that the graphs find."""
    spark = vectors.sparkSession
    whole = materialize(usable(vectors, id_col, vector_col), "comparable")
    asked = whole.filter(query)
    # a row's own place in its vector's list may be taken from the result, so there is one place more
    points = materialize(vertices(whole, k + 1), "vertices")
    held = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width, n_asked = held["n"], held["width"] or 1, asked.count()
    if shard_rows is None:
        most = max(1, min(MOST_SHARD, SHARD_CELLS // width))
        shard_rows = min(most, max(LEAST_SHARD, n // (SHARDS_PER_CORE * spark.sparkContext.defaultParallelism)))
    n_shards, q_blocks = max(1, -(-n // shard_rows)), max(1, -(-n_asked // query_rows))
    dealt = points.select("v", "holders", F.xxhash64("v").alias("dealt"), F.col("holders")[0]["row_no"].alias("first_no"))
    shards = dealt.withColumn("shard", F.pmod(F.hash("v"), F.lit(n_shards)).cast("long")).groupBy("shard").applyInPandas(_grown, SHARD_SCHEMA)
    shards = materialize(shards, "shard-graphs")
    blocks = asked.withColumn("q_block", F.pmod(F.xxhash64("row_no"), F.lit(q_blocks))).groupBy("q_block").applyInPandas(_asked, SHARD_SCHEMA)
    blocks = materialize(blocks.drop("shard"), "shard-queries")
    discard(whole, points)
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")))
    meet = shards.unionByName(blocks.withColumn("shard", everywhere))
    found = meet.repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "kind", "q_block").mapInArrow(_search(k, beam), PAIR_SCHEMA)
    found = materialize(found, "shard-found")
    discard(shards, blocks)
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_shard_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 20th vector's twenty nearest others that the graphs find."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op11_shard_hnsw": op11_shard_hnsw}
#: What a graph finds is not what SQL finds; recall is tested against brute force.
ORACLE_SQL: dict[str, str] = {}
