"""Neighbours by graphs, clusters by ball trees, and fill-in-middle cuts."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ball_tree_clusters, chunked_fim, shard_hnsw
from tests.oracle import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"


def _nearest(rows: list[tuple], k: int, every: int = 20) -> list[tuple]:
    """(query, rank, id, score) by comparing all rows."""
    usable = []
    for number, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.append((number, i, np.array(v, np.float32).astype(float)))
    out = []
    for number, i, v in usable:
        if i is None or i % every:
            continue
        others = []
        for other, j, w in usable:
            if other != number:
                width = min(len(v), len(w))
                others.append((-float((v[:width] * w[:width]).sum()), 1 << 63 if j is None else j))
        out += [(i, rank, None if j == 1 << 63 else j, -s) for rank, (s, j) in enumerate(sorted(others)[:k], 1)]
    return sorted(out, key=repr)


def _rounded(rows) -> list[tuple]:
    return sorted([(q, r, v, round(s, 9)) for q, r, v, s in rows], key=repr)


def _found(df) -> list[tuple]:
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()]


def test_graphs_find_what_brute_force_finds(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    wanted, got = _nearest(rows, 20), _found(shard_hnsw.op11_shard_hnsw(spark, "/root/testdata/sf0.1"))
    assert sorted((q, r) for q, r, *_ in got) == sorted((q, r) for q, r, *_ in wanted)
    pairs = {(q, v) for q, _, v, _ in wanted}
    assert len(pairs & {(q, v) for q, _, v, _ in got}) >= 0.97 * len(pairs)
    scores = {q: dict(rows)[q] for q, *_ in got}
    by_id = dict(rows)
    assert all(abs(s - float(np.dot(np.array(scores[q], float), np.array(by_id[v], float)))) < 1e-12 for q, _, v, s in got[:500])


@pytest.mark.parametrize("shard_rows", [1_000, 90])
def test_graphs_keep_ties_and_copies_in_order(spark, shard_rows):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.uniform(0.1, 3)]) for i in range(300)]
    rows += [(300 + i, [2.0, 1.0, *[0.0] * 6]) for i in range(150)]
    got = shard_hnsw.nearest(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % 20 == 0, k=7, shard_rows=shard_rows)
    wanted, found = _rounded(_nearest(rows, 7)), _rounded(_found(got))
    assert len(found) == len(wanted) and len(set(found) & set(wanted)) >= 0.98 * len(wanted)


def test_a_hot_vector_is_few_rows_before_the_exchange(spark):
    rows = spark.range(3000).select(F.col("id").alias("row_no"), F.col("id").alias("vec_id"), F.array(F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") * 1.0)).alias("v"))
    points = shard_hnsw.vertices(rows, 4)
    assert "WindowGroupLimit" in points._jdf.queryExecution().executedPlan().toString()
    held = {r.v[0]: [h.vec_id for h in r.holders] for r in points.collect()}
    assert held[1.0] == [0, 1, 3, 6] and len(held) == 2000


def test_graphs_of_odd_rows(spark):
    rows = [(None, [1.0, 0.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, None), (60, [0.0, -0.0]), (80, [1.0]), (100, [float("nan"), 1.0]), (3, [None, 1.0]), (4, []), (120, [-1e30, 1e30])]
    table = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).withColumn("shard", F.lit("clash"))
    assert _rounded(_found(shard_hnsw.nearest(table, F.col("vec_id") % 20 == 0, k=3))) == _rounded(_nearest(rows, 3))
    assert shard_hnsw.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert shard_hnsw.nearest(table.filter("vec_id = 80"), F.col("vec_id") % 20 == 0).count() == 0


def test_vertices_without_a_way_to_them_are_compared():
    points = shard_hnsw.lifted(np.random.default_rng(1).normal(size=(40, 4)))
    graph = shard_hnsw.Graph(points, [np.full((40, 4), -1, np.int32)])
    graph.links[0][0, 0] = 7
    assert graph.apart().tolist() == [i for i in range(40) if i not in (0, 7)]


@pytest.mark.parametrize("beam,least", [(24, 0.8), (160, 0.99)])
def test_a_wider_beam_finds_more(beam, least):
    rng = np.random.default_rng(2)
    cells, queries = rng.normal(size=(3000, 24)), rng.normal(size=(100, 24))
    graph = shard_hnsw.Graph.of(shard_hnsw.lifted(cells), shard_hnsw.levels(3000))
    assert [len(x) for x in graph.links] == [3000, 188, 12] and not len(graph.apart())
    found, _ = graph.search(np.pad(queries, ((0, 0), (0, 1))).astype(np.float32), beam)
    wanted = np.argsort(-(queries @ cells.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(found, wanted, strict=True)]) >= least


def _clustered(rows: list[tuple], clusters: int, rounds: int, width: int) -> list[tuple]:
    """Plain integers, row by row."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda x: (digest(x[0]), x[1]))[:clusters]]

    def assign():
        away = [[sum((a - b) ** 2 for a, b in zip(q, z, strict=True)) for z in centroids] for _, q in kept]
        return [(min(range(len(a)), key=lambda j: (a[j], j)), min(a)) for a in away]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            mine = [q for (_, q), (c, _) in zip(kept, own, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted([(i, c, d) for (i, _), (c, d) in zip(kept, assign(), strict=True)], key=repr)


def _placed(df) -> list[tuple]:
    return sorted([(r.vec_id, r["cluster"], r.distance) for r in df.collect()], key=repr)


@pytest.mark.parametrize("block_rows,leaf_rows", [(16_384, 32), (50, 2), (7, 1)])
def test_ball_trees_equal_plain_clustering(spark, block_rows, leaf_rows):
    rng = np.random.default_rng(7)
    hubs = rng.normal(size=(6, 3)) * 4
    rows = [(i, [float(np.float32(x)) for x in hubs[i % 6] + rng.normal(size=3) * 0.2]) for i in range(400)]
    rows += [(400 + i, [1.0, -1.0, 0.5]) for i in range(200)]
    got, _ = ball_tree_clusters.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), width=3, clusters=9, rounds=4, block_rows=block_rows, leaf_rows=leaf_rows)
    assert _placed(got) == _clustered(rows, 9, 4, 3)


def test_whole_balls_go_to_one_centroid():
    rng = np.random.default_rng(3)
    hubs = rng.integers(-4000, 4000, (20, 8))
    cells = (hubs[np.arange(5000) % 20] + rng.integers(-20, 20, (5000, 8))).astype(np.int32)
    tree, order = ball_tree_clusters.BallTree.of(cells)
    assert sorted(order) == list(range(5000)) and (tree.cells == cells[order]).all()
    for (begin, end, _), centre, radius, total in zip(tree.nodes, tree.centres, tree.radii, tree.sums, strict=True):
        own = tree.cells[begin:end].astype(np.int64)
        assert radius == ((own - centre) ** 2).sum(axis=1).max() and (total == own.sum(axis=0)).all()
    opened = sum(len(rows) for _, _, rows in tree.filtered(hubs.astype(np.int64)))
    assert opened < 500  # leaves at the border of two hubs
    assert (tree.placed(hubs.astype(np.int64)) == order % 20).all()


def test_ties_go_to_the_smaller_number_in_balls_and_leaves():
    cells = np.array([[0, 0]] * 100 + [[5, 0], [-5, 0], [0, 7]], np.int16)
    centroids = np.array([[10, 0], [-10, 0], [0, 10], [10, 0]], np.int64)
    tree, order = ball_tree_clusters.BallTree.of(cells, 2)
    wanted = ball_tree_clusters.squared(cells.astype(np.int64), centroids).argmin(axis=1)
    assert (tree.placed(centroids) == wanted[order]).all() and set(wanted) == {0, 1, 2}


def test_squares_beyond_what_floats_hold_are_exact():
    a, b = np.array([[1 << 26, -(1 << 26)], [3, 4]], np.int64), np.array([[-(1 << 26), (1 << 26) - 1]], np.int64)
    assert ball_tree_clusters.squared(a, b).tolist() == [[(1 << 54) + ((1 << 27) - 1) ** 2], [((1 << 26) + 3) ** 2 + (4 - (1 << 26) + 1) ** 2]]


def test_clusters_of_odd_rows(spark):
    rows = [(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [0.5, -2.0]), (2, None), (3, [1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, [3000.0, -3000.0])]
    table = spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit("clash")).withColumn("q", F.lit("clash"))
    got, centroids = ball_tree_clusters.cluster(table, width=2, clusters=3, rounds=2)
    assert _placed(got) == _clustered(rows, 3, 2, 2) and len(centroids) == 3
    figures = ball_tree_clusters.with_inertia(got, centroids).collect()
    assert {r.inertia for r in figures} == {sum(r.distance for r in figures)}
    few, centroids = ball_tree_clusters.cluster(table, width=2, clusters=40, rounds=2)
    assert len(centroids) == 5 and few.count() == 5
    assert ball_tree_clusters.with_inertia(*ball_tree_clusters.cluster(table.limit(0), width=2)).count() == 0


def test_huge_components_are_bounded(spark):
    got, _ = ball_tree_clusters.cluster(spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.0, 0.0])], VECTORS), width=2, clusters=1, rounds=1)
    assert got.count() == 2 and all(r.distance > 1 << 50 for r in got.collect())


UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def _cut(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return (doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


ODD = ["", None, "a", "A" * 50, "ab cd", "x\ny\r\nz", "é😀word😀😀", "<P> marked", "tail<M>", "<<S<P< near <M", ">S><", "1 2 3", " " * 30, "ab" * 64 + " ", "ünïcödé text, mixed With 123 numbers!", "\u0000nul\u0000", "a" * 4096 + " b", "é"]


@pytest.mark.parametrize("chunk_chars", [1, 2, 3, 7, 64, 1024])
def test_cuts_equal_plain_python_whatever_the_chunks(spark, chunk_chars):
    rows = [(i, text) for i, text in enumerate(ODD * 12)] + [(None, "some text here"), (5, "again"), (5, "again"), (-3, "negative id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("parts", F.lit("clash"))
    done = chunked_fim.fill_in_middle(docs, chunk_chars=chunk_chars)
    back = done.select("*", chunked_fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    got = sorted([tuple(r)[:6] for r in back], key=repr)
    assert got == sorted([_cut(*r) for r in rows], key=repr)
    assert sorted(r.back for r in back) == sorted(text or "" for _, text in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_cuts_of_a_very_long_text_and_of_none(spark):
    text = "lorem ipsum, dolor\n" * 60_000
    docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    done = chunked_fim.fill_in_middle(docs)
    assert sorted([tuple(r) for r in done.collect()], key=repr) == sorted([_cut(i, text) for i in range(4)], key=repr)
    assert chunked_fim.fill_in_middle(docs.limit(0)).count() == 0
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("module", [ball_tree_clusters, chunked_fim])
def test_new_queries_equal_their_sql(spark, module):
    for name, sql in module.ORACLE_SQL.items():
        assert rows_of(module.QUERIES[name](spark, SF)) == rows_of_sql(sql, SF)
