"""Centroid clustering by filtering ball trees, in exact integers.

Vectors are quantised to integers, and each task packs the rows that it reads into
blocks of bounded size with a metric tree each: a ball has a centre (the rounded
mean of its vectors), the squared radius around it, the count and the integer sum
of its vectors. The trees are a table. A round sends the centroids, a few small
vectors, to every tree. A ball drops each centroid that the triangle inequality
rules out for all its vectors; a ball with one centroid left adds its count and sum
to that one as a whole, any other is opened, and leaves are compared exactly. What
tasks add to a centroid are integer sums, one row for each centroid and component,
so a round's result does not depend on how rows are dealt out.

A ball keeps centroid j beside the nearest one i while some vector p of it may be as
near to j. With centre c and radius r, |p-j|^2 - |p-i|^2 is at least
|c-j|^2 - |c-i|^2 - 2 r |i-j|; as |i-j| <= |c-i| + |c-j|, this also drops all that
|c-j| - |c-i| > 2 r drops. Squared distances are integers, compared exactly; the
bound's roots get a margin for rounding, on the side of opening a ball.

Defined cases: vectors that are null, have another width, or hold a null or
non-finite component take no part; quantised components beyond +-2^26 count as that,
so that squared distances stay in 64 bits; a null identifier hashes as the empty
string; equal hashes start in the order of their vectors; rows that repeat an
identifier are rows of their own; with fewer vectors than centroids each vector
starts one; a centroid without vectors stays, and is not in the result; sums beyond
64 bits are given as the largest long; an empty table gives an empty result; columns
beside identifier and vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import discard, materialize, table

WIDTH, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2:"
#: Vectors of a tree at most, and of a leaf.
BLOCK_ROWS, LEAF_ROWS = 16_384, 32
MOST = 1 << 26

TREE_SCHEMA = pa.schema(
    [("rows", pa.int64()), ("has_id", pa.binary()), ("ids", pa.binary()), ("cells", pa.binary()), ("nodes", pa.binary()), ("centres", pa.binary()), ("radii", pa.binary()), ("sums", pa.binary())]
)
TREE_DDL = "rows long, has_id binary, ids binary, cells binary, nodes binary, centres binary, radii binary, sums binary"
ADDED_DDL = "cluster int, component int, added long"
PLACED_DDL = "vec_id long, cluster int, distance long"


def kept(rows: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """(vec_id, q): whole finite vectors of the wanted width, quantised."""
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.filter(F.col("v").isNotNull() & (F.size("v") == width) & finite)

    def quantised(x: Column) -> Column:
        return F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(2.0**40)), F.lit(-(2.0**40))) * scale), F.lit(MOST)), F.lit(-MOST)).cast("int")

    return whole.select("vec_id", F.transform("v", quantised).alias("q"))


def first_centroids(vectors: DataFrame, clusters: int, seed: str, width: int) -> np.ndarray:
    """The vectors of the smallest hashes: as many rows as there are centroids come to the driver."""
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = vectors.select(hashed.alias("hash"), "q").orderBy("hash", "q").limit(clusters).collect()
    return np.array([r["q"] for r in chosen], np.int64).reshape(len(chosen), width)


class BallTree:
    """A block of vectors, reordered so that every ball is a range of rows."""

    def __init__(self, cells: np.ndarray, nodes: np.ndarray, centres: np.ndarray, radii: np.ndarray, sums: np.ndarray) -> None:
        #: nodes: first row, end, number of the first of two children or 0; radii are squared
        self.cells, self.nodes, self.centres, self.radii, self.sums = cells, nodes, centres, radii, sums

    @classmethod
    def of(cls, cells: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[BallTree, np.ndarray]:
        """The tree and the order that it puts the rows in."""
        order = np.arange(len(cells))
        nodes, centres, radii, sums = [[0, len(cells), 0]], [], [], []
        at = 0
        while at < len(nodes):
            begin, end, _ = nodes[at]
            own = cells[order[begin:end]].astype(np.int64)
            total = own.sum(axis=0)
            centre = np.rint(total / len(own)).astype(np.int64)
            away = ((own - centre) ** 2).sum(axis=1)
            centres.append(centre)
            radii.append(int(away.max()))
            sums.append(total)
            if len(own) > leaf_rows and radii[-1]:
                # halves by the nearness to two far vectors; a median, so that the depth stays logarithmic
                one = own[int(away.argmax())]
                other = own[int(((own - one) ** 2).sum(axis=1).argmax())]
                side = own @ (other - one).astype(float)
                middle = len(own) // 2
                order[begin:end] = order[begin:end][np.argpartition(side, middle)]
                nodes[at][2] = len(nodes)
                nodes += [[begin, begin + middle, 0], [begin + middle, end, 0]]
            at += 1
        return cls(cells[order], np.array(nodes, np.int64), np.array(centres), np.array(radii), np.array(sums)), order

    @classmethod
    def stored(cls, row: dict) -> BallTree:
        n = row["rows"]
        size = len(row["cells"]) // n
        nodes = np.frombuffer(row["nodes"], np.int64).reshape(-1, 3)
        centres, sums = (np.frombuffer(row[c], np.int64).reshape(len(nodes), -1) for c in ("centres", "sums"))
        cells = np.frombuffer(row["cells"], np.int16 if size == 2 * sums.shape[1] else np.int32).reshape(n, -1)
        return cls(cells, nodes, centres, np.frombuffer(row["radii"], np.int64), sums)

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(balls, their centroid, rows of opened leaves) level by level; a row or a ball comes once."""
        between = np.sqrt(squared(centroids, centroids).astype(float))
        balls, left = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(balls):
            away = squared(self.centres[balls], centroids)
            away[~left] = np.iinfo(np.int64).max
            near = away.argmin(axis=1)
            least = away[np.arange(len(balls)), near]
            reach = 2 * np.sqrt(self.radii[balls].astype(float))[:, None] * between[near]
            left &= (away - least[:, None]).astype(float) <= reach * (1 + 1e-9) + 0.5
            # all vectors of a ball without radius are its centre: the smallest of the nearest centroids has them
            whole = (left.sum(axis=1) == 1) | (self.radii[balls] == 0)
            child = self.nodes[balls, 2]
            leaf = ~whole & (child == 0)
            spans = [np.arange(b, e) for b, e, _ in self.nodes[balls[leaf]]]
            yield balls[whole], near[whole], np.concatenate(spans) if spans else np.zeros(0, np.int64)
            opened = ~whole & ~leaf
            balls = (child[opened][:, None] + np.array([0, 1])).ravel()
            left = np.repeat(left[opened], 2, axis=0)

    def added(self, centroids: np.ndarray) -> np.ndarray:
        """For each centroid the count and then the sums of the vectors that are nearest to it."""
        out = np.zeros((len(centroids), 1 + self.cells.shape[1]), np.int64)
        for balls, near, rows in self.filtered(centroids):
            counts = self.nodes[balls, 1] - self.nodes[balls, 0]
            np.add.at(out, near, np.concatenate([counts[:, None], self.sums[balls]], axis=1))
            if len(rows):
                own = self.cells[rows].astype(np.int64)
                np.add.at(out, squared(own, centroids).argmin(axis=1), np.concatenate([np.ones((len(rows), 1), np.int64), own], axis=1))
        return out

    def placed(self, centroids: np.ndarray) -> np.ndarray:
        """The number of each row's centroid."""
        out = np.empty(len(self.cells), np.int64)
        for balls, near, rows in self.filtered(centroids):
            for (begin, end, _), number in zip(self.nodes[balls], near, strict=True):
                out[begin:end] = number
            if len(rows):
                out[rows] = squared(self.cells[rows].astype(np.int64), centroids).argmin(axis=1)
        return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to the few of ``b``; in floats where these hold every sum exactly."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * a.shape[1] * most * most < 1 << 53:
        x, y = a.astype(float), b.astype(float)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def _tree_row(ids: list[int | None], cells: np.ndarray, leaf_rows: int) -> list:
    tree, order = BallTree.of(cells, leaf_rows)
    has = np.array([i is not None for i in ids])[order]
    numbers = np.array([i or 0 for i in ids], np.int64)[order]
    parts = (has, numbers, tree.cells, tree.nodes, tree.centres, tree.radii, tree.sums)
    return [len(ids), *(x.tobytes() for x in parts)]


def _plant(width: int, block_rows: int, leaf_rows: int):
    """A task's rows as trees of at most ``block_rows``."""

    def packed(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.concatenate(parts)
        cells = cells.astype(np.int16) if np.abs(cells).max(initial=0) < 1 << 15 else cells.astype(np.int32)
        row = _tree_row(ids, cells, leaf_rows)
        return pa.RecordBatch.from_arrays([pa.array([v], field.type) for v, field in zip(row, TREE_SCHEMA, strict=True)], schema=TREE_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[np.ndarray] = []
        for batch in batches:
            begin = 0
            cells = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            while begin < batch.num_rows:
                end = min(batch.num_rows, begin + block_rows - len(ids))
                ids += batch.column("vec_id")[begin:end].to_pylist()
                parts.append(cells[begin:end])
                begin = end
                if len(ids) == block_rows:
                    yield packed(ids, parts)
                    ids, parts = [], []
        if ids:
            yield packed(ids, parts)

    return run


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, BallTree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            yield row, BallTree.stored(row)


def _add(centroids: np.ndarray):
    """What a task's trees add to each centroid; component 0 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), 1 + centroids.shape[1]), np.int64)
        for _, tree in _stored(batches):
            if np.abs(total).max(initial=0) > 1 << 61:
                yield flat(total)
                total[:] = 0
            total += tree.added(centroids)
        yield flat(total)

    def flat(total: np.ndarray) -> pa.RecordBatch:
        cluster, component = np.nonzero(total)
        columns = [pa.array(cluster, pa.int32()), pa.array(component, pa.int32()), pa.array(total[cluster, component], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["cluster", "component", "added"])

    return run


def _place(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, tree in _stored(batches):
            cluster = tree.placed(centroids)
            away = ((tree.cells.astype(np.int64) - centroids[cluster]) ** 2).sum(axis=1)
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["has_id"], bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(away, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; one row for each centroid and component comes to the driver."""
    sums = trees.mapInArrow(_add(centroids), ADDED_DDL).groupBy("cluster", "component").agg(F.sum(F.col("added").cast("decimal(38,0)")).alias("added"))
    held = {(r["cluster"], r["component"]): int(r["added"]) for r in sums.collect()}
    out = centroids.copy()
    for j in range(len(centroids)):
        if count := held.get((j, 0), 0):
            out[j] = [held.get((j, d), 0) // count for d in range(1, out.shape[1] + 1)]
    return out


def cluster(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    width: int = WIDTH,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: str = SEED,
    block_rows: int = BLOCK_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector kept, and the final centroids."""
    usable = kept(vectors, id_col, vector_col, width, scale)
    centroids = first_centroids(usable, clusters, seed, width)
    if not len(centroids):
        return usable.sparkSession.createDataFrame([], PLACED_DDL), centroids
    trees = materialize(usable.mapInArrow(_plant(width, block_rows, leaf_rows), TREE_DDL), "ball-trees")
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    placed = materialize(trees.mapInArrow(_place(centroids), PLACED_DDL), "clustered")
    discard(trees)
    return placed, centroids


def with_inertia(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each row with its cluster's and all rows' sum of distances and a digest of its centroid: a few rows that are sent along."""
    spark = placed.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for j, row in enumerate(centroids.tolist())]
    told = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    total = sums.agg(F.sum("own").alias("whole"))

    def bounded(x: str) -> Column:
        return F.least(F.col(x).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")

    figures = told.join(sums, "cluster").crossJoin(F.broadcast(total))  # a row for each centroid
    figures = figures.select("cluster", bounded("own").alias("cluster_inertia"), bounded("whole").alias("inertia"), "centroid_sha256")
    return placed.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector of 64 components with its cluster after five rounds."""
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings")))


def _sql() -> str:
    """Rounds one after another, each over all pairs of a vector and a centroid."""
    parts = [
        f"""
        held AS MATERIALIZED (
            SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cells AS MATERIALIZED (SELECT row_no, d, q[d] AS x FROM held, range(1, {WIDTH + 1}) r(d)),
        z0 AS MATERIALIZED (
            SELECT n - 1 AS cluster, d, q[d] AS x
            FROM (SELECT q, row_number() OVER (ORDER BY sha256('{SEED}' || coalesce(CAST(vec_id AS VARCHAR), '')), q) AS n FROM held QUALIFY n <= {CLUSTERS}), range(1, {WIDTH + 1}) r(d))"""
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""
        a{i} AS MATERIALIZED (
            SELECT row_no, arg_min(cluster, (away, cluster)) AS cluster, min(away) AS away
            FROM (SELECT row_no, cluster, CAST(sum((c.x - z.x) * (c.x - z.x)) AS BIGINT) AS away FROM cells c JOIN z{i} z USING (d) GROUP BY row_no, cluster) GROUP BY row_no)""")
        if i < ROUNDS:
            parts.append(f"""
        z{i + 1} AS MATERIALIZED (
            SELECT z.cluster, z.d, coalesce(m.x, z.x) AS x
            FROM z{i} z LEFT JOIN (
                SELECT cluster, d, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x
                FROM a{i} JOIN cells USING (row_no) GROUP BY cluster, d) m ON z.cluster = m.cluster AND z.d = m.d)""")
    return (
        "WITH "
        + ",".join(parts)
        + f""",
        inert AS (SELECT cluster, CAST(sum(away) AS BIGINT) AS cluster_inertia FROM a{ROUNDS} GROUP BY cluster),
        told AS (SELECT cluster, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM z{ROUNDS} GROUP BY cluster)
        SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, away AS distance, cluster_inertia, (SELECT CAST(sum(away) AS BIGINT) FROM a{ROUNDS}) AS inertia, centroid_sha256
        FROM a{ROUNDS} a JOIN held USING (row_no) JOIN inert USING (cluster) JOIN told USING (cluster)"""
    )


QUERIES = {"op12_ball_tree_clusters": op12_ball_tree_clusters}
ORACLE_SQL = {"op12_ball_tree_clusters": _sql()}
