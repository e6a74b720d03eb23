"""The trained embedding and the trained scorer: what they are for, held out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import embedding, evaluation, pair_scorer

TOPICS = [
    [("car", "auto"), ("engine", "motor"), ("road", "street"), ("drive", "steer")], [("doctor", "medic"), ("illness", "disease"), ("cure", "remedy"), ("clinic", "ward")],
    [("film", "movie"), ("actor", "player"), ("scene", "shot"), ("cinema", "theatre")], [("bread", "loaf"), ("bake", "roast"), ("flour", "dough"), ("oven", "stove")],
    [("ship", "boat"), ("harbour", "port"), ("wave", "swell"), ("sail", "cruise")], [("king", "ruler"), ("castle", "palace"), ("crown", "throne"), ("realm", "kingdom")],
]
FILLER = ["the", "a", "of", "and", "in", "was", "it", "for"]


def _text(rng, topic, side=None, n=24):
    out = []
    for _ in range(n):
        pair = TOPICS[topic][rng.integers(4)]
        out += [pair[rng.integers(2) if side is None else side], FILLER[rng.integers(len(FILLER))]]
    return " ".join(out)


def _best(vectors, asked):
    order = np.argsort(-(asked @ vectors.T), axis=1)
    return order[:, :3]


def test_other_words_for_the_same_thing_are_near(spark):
    """Queries use the synonyms that their document doesn't: hashed words find nothing, the trained embedding does."""
    rng = np.random.default_rng(1)
    corpus = spark.createDataFrame([(_text(rng, i % 6),) for i in range(900)] + [(None,), ("",)], "text string")
    held = embedding.train(corpus, dims=16)
    docs, queries = [_text(rng, t, 0) for t in range(6)], [_text(rng, t, 1, 6) for t in range(6)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs + queries)], "id long, text string")
    of = lambda column: np.array([r.v for r in frame.orderBy("id").select(column.alias("v")).collect()])
    trained, hashed = of(held.of(F.col("text"))), of(evaluation.embed(F.col("text")))
    assert (_best(trained[:6], trained[6:])[:, 0] == np.arange(6)).all()
    assert (_best(hashed[:6], hashed[6:])[:, 0] == np.arange(6)).sum() < 6
    assert np.allclose((trained**2).sum(axis=1), 1, atol=1e-5)
    odd = spark.createDataFrame([(None,), ("",), ("unheard of",), ("car",)], "text string").select(held.of(F.col("text")).alias("v")).collect()
    assert [r.v is None for r in odd] == [True, True, False, False] or [r.v is None for r in odd] == [True, True, True, False]


def test_the_iteration_finds_the_leading_directions(spark):
    """Against a dense decomposition of the same matrix."""
    rng = np.random.default_rng(2)
    texts = spark.createDataFrame([(_text(rng, i % 6),) for i in range(300)], "text string")
    words = embedding.vocabulary(texts)
    pairs = embedding.together(texts, words)
    counts = {(r.a, r.b): r.n for r in pairs.collect()}
    names = [r.word for r in words.orderBy("number").collect()]
    plain: dict = {}
    for r in texts.collect():
        at = [names.index(w) if w in names else -1 for w in r.text.split()]
        for i, a in enumerate(at):
            for b in at[i + 1 : i + 1 + embedding.WINDOW]:
                if a >= 0 and b >= 0:
                    plain[a, b] = plain.get((a, b), 0) + 1
                    plain[b, a] = plain.get((b, a), 0) + 1
    assert counts == plain
    dense = np.zeros((len(names), len(names)))
    for r in embedding.informative(pairs).collect():
        dense[r.a, r.b] = r.x
    held = embedding.train(texts, dims=8, rounds=12)
    assert np.abs(dense - dense.T).max() < 1e-5
    wanted = np.sort(np.abs(np.linalg.eigvalsh(dense)))[::-1][:8]
    assert np.allclose((held.vectors**2).sum(axis=0), wanted, rtol=0.03)


def test_no_text_no_embedding(spark):
    held = embedding.train(spark.createDataFrame([], "text string"))
    assert held.words == [] and spark.createDataFrame([("a b",)], "text string").select(held.of(F.col("text"))).first()[0] is None


def _candidates(spark, sf):
    """Benchmark passages, their words without every third, against the documents that share a run of words, in the order of identifiers."""
    items, docs = spark.read.parquet(f"{sf}/benchmark.parquet"), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    said = F.array_join(F.filter(F.split("text", " "), lambda w, i: i % 3 != 2), " ")
    near = evaluation.four_word_ranks(items, docs).filter("pos <= 20").select("item_id", "doc_id")
    some = docs.orderBy(F.xxhash64("doc_id")).limit(20).select("doc_id")
    pool = near.unionByName(items.select("item_id").join(F.broadcast(some))).distinct()
    held = pool.join(items.withColumnRenamed("text", "whole"), "item_id").join(docs.withColumnRenamed("text", "passage"), "doc_id")
    held = held.withColumn("query", F.array_join(F.filter(F.split("whole", " "), lambda w, i: i % 3 != 2), " ")).withColumn("good", F.contains("passage", "whole"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id")) - 1
    return items.select("item_id", said.alias("text")), docs, held.select(F.col("item_id").alias("query_id"), "query", "passage", place.alias("place"), "good")


def test_the_scorer_is_better_than_the_order_it_is_given(spark):
    queries, docs, candidates = _candidates(spark, "/root/testdata/sf0.001")
    rarity = pair_scorer.rarities(queries, docs)
    scorer = pair_scorer.fit(candidates.filter("query_id % 2 = 0"), rarity)
    other = candidates.filter("query_id % 2 = 1")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "place")
    ranked = other.withColumn("score", scorer.score(F.col("query"), F.col("passage"), F.col("place"))).withColumn("pos", F.row_number().over(by_score))
    given = pair_scorer.mean_reciprocal_rank(other.withColumn("pos", F.col("place") + 1))
    found = pair_scorer.mean_reciprocal_rank(ranked)
    answered = other.groupBy("query_id").agg(F.max("good").alias("any")).agg(F.avg(F.col("any").cast("double"))).first()[0]
    assert answered > 0 and found > 0.9 * answered > given
    nothing = pair_scorer.fit(candidates.limit(0), rarity)
    assert nothing.weights.argmax() == pair_scorer.NAMES.index("place")
    assert pair_scorer.features(None, "a", 0, {})[:5] == pair_scorer.features("a", None, 0, {})[:5] == [0.0] * 5
