"""Document graphs, restored stores, similarity over odd vectors, and benches over short passages."""

from __future__ import annotations

import os

import pytest

from palimpsest.operators import evaluation, graphs, sync, vectors


def _edges(spark, *docs):
    return sorted((r.src, r.dst, r.kind) for r in graphs.document_graph(spark.createDataFrame(list(docs), "id string, text string")).collect())


def test_links_are_resolved_against_their_folder(spark):
    got = _edges(
        spark,
        ("docs/a.md", "[b](sub/b.md#x) [b](./sub/b.md) [self](a.md) [up](../README.md) [out](../../docs/a.md) [gone](c.md) [web](http://x/docs/sub/b.md)"),
        ("docs/sub/b.md", "[a](../a.md) [root](/docs/a.md) [wrong](a.md) [other](x.png)"),
        ("README.md", "[a](docs/./sub/../a.md) ![b](docs/sub/b.md)"),
        ("none.md", None),
    )
    ref = "references"
    assert got == [("README.md", "docs/a.md", ref), ("README.md", "docs/sub/b.md", ref), ("docs/a.md", "README.md", ref), ("docs/a.md", "docs/sub/b.md", ref), ("docs/sub/b.md", "docs/a.md", ref)]


def test_a_day_supersedes_where_it_names_one_entry(spark):
    log = "# Change log\n## [2024-01-01] — a\n## [2024-01-02] — b\n> 🔄 **Supersede:** 2024-01-01, 2024-01-05\nsupersede 2024-01-03\n## [2024-01-03] — c\nit supersedes 2024-01-01\n## [2024-01-03] — d\n> supersedes 2024-01-03 and 2024-01-02\n## [2024-01-04] — e\n> supersede 2024-01-03 2024-01-04\n"
    other = "# Change log\n## [2024-01-05] — elsewhere\n"
    got = _edges(spark, ("log.md", log), ("other.md", other))
    assert got == [("log.md:2024-01-02#0", "log.md:2024-01-01#0", "supersede"), ("log.md:2024-01-03#1", "log.md:2024-01-02#0", "supersede"), ("log.md:2024-01-03#1", "log.md:2024-01-03#0", "supersede")]


@pytest.mark.parametrize("path,normal", [("a/./b/../c", "a/c"), ("../a", "../a"), ("a/../../b", "../b"), ("a/../../../b/..", "../.."), ("", ""), ("a//b/", "a/b")])
def test_normal_paths(spark, path, normal):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(path,)], "p string").select(graphs.normal_path(F.col("p"))).first()[0] == normal


def test_restoring_keeps_what_was_there(spark, tmp_path):
    frame = lambda n: spark.createDataFrame([(i, f"row {i}") for i in range(n)], "id long, text string")
    saved, live = f"file://{tmp_path}/saved", f"file://{tmp_path}/live"
    with pytest.raises(FileNotFoundError):
        sync.restore(spark, saved, live)
    sync.backup(frame(5), saved)
    with pytest.raises(FileExistsError):
        sync.backup(frame(6), saved)
    assert sync.restore(spark, saved, live) is None and spark.read.parquet(live).count() == 5
    sync.backup(frame(6), saved, force=True)
    with pytest.raises(FileExistsError):
        sync.restore(spark, saved, live)
    assert spark.read.parquet(live).count() == 5
    kept = sync.restore(spark, saved, live, aside=f"{live}.1")
    assert spark.read.parquet(live).count() == 6 and spark.read.parquet(kept).count() == 5
    with pytest.raises(OSError):
        sync.restore(spark, saved, live, aside=kept)
    assert spark.read.parquet(live).count() == 6 and sorted(n for n in os.listdir(tmp_path) if "crc" not in n) == ["live", "live.1", "live.restoring", "saved"]


def test_similar_pairs_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0]), (None, [1.0]), (6, [1.0, 0.0, 0.0]), (7, [])]
    held = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in vectors.similar_pairs(held, held, 0.9, 5, block_rows=2).collect())
    assert got == [(1, 3, 1.0), (1, 6, 1.0), (3, 6, 1.0)]
    assert vectors.similar_pairs(held.limit(0), held, 0.9, 5).count() == vectors.similar_pairs(held, held.limit(0), 0.9, 5).count() == 0


def test_short_passages_are_ranked(spark):
    items = spark.createDataFrame([(1, "only three words"), (2, "one"), (3, "a b c d e"), (4, "two words")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "here are only three words in it"), (11, "one"), (12, "a b c d e f"), (13, "two words"), (14, "none of it two Words"), (15, None)], "doc_id long, text string")
    got = sorted((r.item_id, r.doc_id, r.n, r.pos) for r in evaluation.four_word_ranks(items, docs).collect())
    assert got == [(1, 10, 1, 1), (2, 11, 1, 1), (3, 12, 2, 1), (4, 13, 1, 1), (4, 14, 1, 2)]
