"""Exact deduplication and the chosen-path join against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chosen_path_join as J
from palimpsest.llm import digest_log, key_joins
from palimpsest.storage import materialize

KIND = "doc_id long, text string"
ROWS = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c"), (5, "c"), (None, "a b"), (6, "x " * 60_000)]


def test_exact_keeps_the_extreme_identifier(spark):
    docs = spark.createDataFrame(ROWS, KIND).withColumn("digest", F.lit("clash")).withColumn("kept", F.lit(1))
    got = sorted(((r.row_id, r.keep_id, r.copies, r.kept) for r in digest_log.deduplicate(docs, keep="largest").collect()), key=str)
    assert got == sorted([(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (5, 5, 2, True), (6, 6, 1, True)], key=str)
    least = {r.row_id: r.keep_id for r in digest_log.deduplicate(docs.filter("doc_id is not null")).collect()}
    assert least == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


def test_exact_compares_bytes_where_digests_clash(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "ab"), (4, "zz")], KIND)
    got = {r.row_id: (r.keep_id, r.copies) for r in digest_log.deduplicate(docs, digest=lambda t: F.left(t, F.lit(1))).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (2, 2), 4: (4, 1)}


def test_exact_on_an_empty_table(spark):
    assert digest_log.deduplicate(spark.createDataFrame([], KIND)).count() == 0


def _brute(rows):
    sets = []
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets.append((doc, {b" ".join(words)} if len(words) < 5 else {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)}))
    links, parent = defaultdict(int), list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets):
            if i != j and len(a & b) * 5 >= 4 * len(a | b):
                links[i] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        r = root(i)
        known = [x for x in (least.get(r), doc) if x is not None]
        least[r] = min(known) if known else None
    return sorted(((doc, least[root(i)], links[i]) for i, (doc, _) in enumerate(sets)), key=str)


def _corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(20)]
    rows = []
    for base in range(14):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 90]))]
        if base % 3 == 0:
            words += passage
        for copy in range(rng.choice([1, 2, 12])):
            changed = list(words)
            for _ in range(copy % 4):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(changed)))
    return rows


@pytest.mark.parametrize(("small", "block"), [(512, 512), (4, 3)])
def test_join_equals_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(J, "BLOCK_SETS", block)
    rows = [*_corpus(1), (1000, None), (1001, "  "), (1002, "few words"), (1003, "Few  words"), (None, "few words"), (1002, "few words")]
    docs = spark.createDataFrame(rows, KIND).withColumn("tokens", F.lit("clash"))
    got = sorted(((r.doc_id, r.class_id, r.links) for r in J.similar(docs, small_bucket=small).collect()), key=str)
    assert got == _brute(rows)


def test_one_of_each_class_keeps_clean_rows_and_columns(spark):
    rows = [(3, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l"), (9, "quite another text with enough words"), (9, "quite another text with enough words")]
    docs = spark.createDataFrame(rows, KIND).withColumn("sid", F.lit(0))
    got = J.one_of_each_class(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [2, 9]


def test_join_on_an_empty_table(spark):
    assert J.similar(spark.createDataFrame([], KIND)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y")], "sid string, other string")
    labels = defaultdict(set)
    for r in J.components(edges).collect():
        labels[r.label].add(r.sid)
    assert sorted(map(len, labels.values())) == [2, 61]


def test_exact_compacts_in_levels(spark):
    rows = [(i, f"text {i % 37}") for i in range(300)]
    docs = spark.createDataFrame(rows, KIND)
    got = {r.row_id: (r.keep_id, r.copies) for r in digest_log.deduplicate(docs, memtables=21).collect()}
    assert got == {i: (i % 37, sum(j % 37 == i % 37 for j in range(300))) for i in range(300)}


def test_join_says_when_it_misses_its_recall(spark, monkeypatch):
    """Where no number of runs is enough the join fails: no link is lost silently."""
    monkeypatch.setattr(J, "_RUN_MASK", 7)
    docs = spark.createDataFrame(_corpus(2), KIND)
    with pytest.raises(RuntimeError):
        J.similar(docs, target_recall=1.5)


def test_join_repeats_runs_until_the_recall_is_met(spark):
    rows = _corpus(3)
    docs = spark.createDataFrame(rows, KIND).withColumn("sid", F.lit("clash")).withColumn("path", F.lit(1))
    got = sorted(((r.doc_id, r.class_id, r.links) for r in J.similar(docs, runs=1).collect()), key=str)
    assert got == _brute(rows)


def test_no_link_met_is_no_proof_that_there_is_none(spark):
    """Tables with one pair each, at the least similarity: one run often misses it, and its silence must not end the join."""
    for seed in range(3):
        rng = random.Random(seed)
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        # of 100 n-grams each, 90 are shared: a similarity of 90 / 110
        rows = [(1, " ".join(words)), (2, " ".join([*words[:94], *(f"x{i}" for i in range(10))])), (3, "something else with six words")]
        got = sorted((r.doc_id, r.class_id, r.links) for r in J.similar(spark.createDataFrame(rows, KIND), runs=1).collect())
        assert got == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_a_digest_of_a_third_of_all_rows_is_no_large_task(spark):
    """Rows of a hot digest meet their partner where they are read, the others by an exchange, and none is lost."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise((F.col("id") / 2).cast("long"))
    rows = spark.range(0, 100_000, 1, 8).select("id", F.md5(hot.cast("string")).alias("digest"))
    partners = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("least")).filter("copies > 1")
    partners = materialize(partners, "test-partners")
    got = key_joins.join_by_digest(key_joins.marked(rows, partners).filter("known").drop("known"), partners)
    want = rows.join(partners, "digest")
    assert sorted(got.select("id", "least").collect()) == sorted(want.select("id", "least").collect())
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions would be one here
    spark.conf.set(coalesce, "false")
    try:
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset(coalesce)
    assert max(sizes) < 0.2 * sum(sizes) and sum(sizes) == want.count()
    # a left join keeps the rows without partner
    assert key_joins.join_by_digest(rows, partners, "left").count() == 100_000


def test_the_filter_knows_all_keys_and_few_others(spark):
    keys = spark.range(0, 5000).select(F.md5(F.col("id").cast("string")).alias("digest"))
    rows = spark.range(0, 50_000).select("id", F.md5(F.col("id").cast("string")).alias("digest"))
    known = {r.id for r in key_joins.marked(rows, keys).filter("known").collect()}
    assert known >= set(range(5000)) and len(known) < 7000
    assert key_joins.marked(rows, keys.limit(0)).filter("known").count() == 0
