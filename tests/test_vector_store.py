"""The index in bytes against floats, its identity and its parts; first fit over thousands of hits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ranking
from palimpsest.operators.vector_store import IdentityMismatch, VectorStore

KIND = "vec_id long, embedding array<double>"


def _frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], KIND)


def _near(store, rows, k):
    asked = store.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "query_id long, embedding array<double>")
    found: dict[int, list] = {}
    for r in store.search(asked, k).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    return found


def test_recall_of_bytes_against_floats(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    store = VectorStore.create(spark, profile="raw", width=64, native=64)
    store.add(table, profile="raw")
    rows = table.collect()
    ids, matrix = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    matrix /= np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    asked = [(int(i), v) for i, v in zip(ids[:60], matrix[:60], strict=True)]
    found = _near(store, asked, 10)
    wanted = {i: set(ids[np.argsort(-(matrix @ v), kind="stable")[:10]].tolist()) for i, v in asked}
    assert np.mean([len(set(found[i]) & wanted[i]) / 10 for i, _ in asked]) >= 0.99


def test_parts_are_added_removed_and_pruned_in_place(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=128)) for i in range(200)]
    store = VectorStore.create(spark, profile="raw", width=128)
    store.add(_frame(spark, rows[:120]), profile="raw")
    store.add(_frame(spark, rows[120:]), profile="raw")
    asked = [(i, v) for i, v in rows[:5]]
    assert all(_near(store, asked, 3)[i][0] == i for i, _ in asked)
    store.remove(spark.createDataFrame([(i,) for i in range(0, 200, 2)], "vec_id long"))
    found = _near(store, asked, 3)
    assert all(len(v) == 3 and all(x % 2 for x in v) for v in found.values())
    store.add(_frame(spark, [(2, rows[2][1])]), profile="raw")
    assert _near(store, asked, 1)[2] == [2] and store.vectors().count() == 101
    before = _near(store, asked, 4)
    assert store.prune() == 101 and len(store.parts()) == 1 and _near(store, asked, 4) == before
    again = VectorStore(spark, store.folder)
    assert again.identity == {"profile": "raw", "width": 128, "dtype": "int8"} and _near(again, asked, 4) == before


def test_the_identity_decides(spark):
    with pytest.raises(IdentityMismatch):
        VectorStore.create(spark, profile="raw", width=100)
    store = VectorStore.create(spark, profile="raw", width=128)
    with pytest.raises(IdentityMismatch):
        store.add(_frame(spark, [(1, np.ones(128))]), profile="other")
    with pytest.raises(IdentityMismatch):
        store.add(_frame(spark, [(1, np.ones(64))]), profile="raw")
    wide = np.r_[np.ones(128), np.full(128, 9.0)]
    rows = [(1, wide), (2, -wide), (3, np.zeros(256)), (4, np.r_[np.nan, np.ones(255)])]
    store.add(_frame(spark, rows), profile="raw")
    assert sorted(r.vec_id for r in store.vectors().collect()) == [1, 2]
    assert _near(store, [(9, wide)], 5) == {9: [1, 2]}
    assert store.search(spark.createDataFrame([], "query_id long, embedding array<double>"), 5).count() == 0


def _plain(vectors, least):
    heads, out = [], []
    for i, v in enumerate(vectors):
        match = None if v is None else next((h for h in heads if vectors[h] is not None and len(vectors[h]) == len(v) and float(np.dot(vectors[h], v)) >= least), None)
        out.append(match)
        if match is None:
            heads.append(i)
    return out


@pytest.mark.parametrize("block", [1, 7, 256])
def test_first_fit_equals_one_after_another(block):
    rng = np.random.default_rng(block)
    hubs = rng.normal(size=(40, 16))
    rows = [hubs[rng.integers(40)] + rng.normal(size=16) * 0.25 for _ in range(600)]
    vectors = [None if i % 50 == 7 else v / np.linalg.norm(v) if i % 33 else np.ones(3) / np.sqrt(3) for i, v in enumerate(rows)]
    got = ranking.first_fit(vectors, 0.85, block)
    assert got == _plain(vectors, 0.85) and any(h is not None for h in got)


def test_thousands_of_hits_collapse(spark):
    rng = np.random.default_rng(9)
    hubs = rng.normal(size=(900, 24))
    vectors = [hubs[rng.integers(900)] + rng.normal(size=24) * 0.2 for _ in range(5000)]
    vectors = [v / np.linalg.norm(v) for v in vectors]
    heads = _plain(vectors, 0.85)
    rows = spark.createDataFrame([(0, 10_000 + i, i + 1, [float(x) for x in v]) for i, v in enumerate(vectors)], "query long, id long, pos long, embedding array<double>")
    got = {r.id: r for r in ranking.collapse(rows).collect()}
    first = [i for i, h in enumerate(heads) if h is None]
    assert [r.id for r in sorted(got.values(), key=lambda r: r.pos)][: len(first)] == [10_000 + i for i in first]
    assert {i - 10_000: r.similar for i, r in got.items() if r.head} == {i: sum(h == i for h in heads) for i in first}
    assert spark.range(1).select(F.lit(1)).count() == 1
