"""A trained scorer of (query, passage) pairs: features of the pair, a logistic fit on pairs of a better and a worse passage.

Features compare words, neighbouring words, rarity and length; they are taken in Arrow batches. The fit sees a bounded
number of pairs (``most_pairs``, in hashed order), each the difference of two passages of one query. A scorer that fails
leaves the order as it was (``ranking.rerank``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


MOST_PAIRS, STEPS, RATE, DECAY = 20_000, 400, 0.5, 1e-3
#: Words of queries whose rarity is looked up, at most.
MOST_TERMS = 20_000
_WORD = re.compile(r"[^\W_]+")
NAMES = ("held", "held_by_rarity", "neighbours", "in_order", "length", "place")


def features(query: str | None, passage: str | None, place: int, rarity: dict[str, float]) -> list[float]:
    """What a passage has of a query: words, rare words, neighbouring words, words in order; its length and present place."""
    q, p = _WORD.findall((query or "").lower()), _WORD.findall((passage or "").lower())
    if not q or not p:
        return [0.0, 0.0, 0.0, 0.0, 0.0, 1.0 / (1 + place)]
    there, asked = set(p), set(q)
    weight = {w: rarity.get(w, 1.0) for w in asked}
    near, first = set(zip(p, p[1:], strict=False)), {}
    for i, w in enumerate(p):
        first.setdefault(w, i)
    pairs = list(zip(q, q[1:], strict=False))
    ordered = [first[a] < first[b] for a, b in pairs if a in first and b in first]
    return [
        len(asked & there) / len(asked), sum(weight[w] for w in asked & there) / sum(weight.values()), sum(x in near for x in pairs) / max(1, len(pairs)),
        sum(ordered) / max(1, len(pairs)), 1 / (1 + math.log1p(len(p))), 1.0 / (1 + place),
    ]


@dataclass
class PairScorer:
    weights: np.ndarray
    rarity: dict[str, float]

    def score(self, query: Column, passage: Column, place: Column) -> Column:
        weights, rarity = self.weights, self.rarity

        @F.pandas_udf(DoubleType())
        def scored(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for queries, passages, places in batches:
                yield pd.Series([float(np.dot(weights, features(q, p, int(n), rarity))) for q, p, n in zip(queries, passages, places, strict=True)], dtype="float64")

        return scored(query, passage, place)


def rarities(queries: DataFrame, corpus: DataFrame) -> dict[str, float]:
    """ln(1 + n / df) of the queries' words (text) in a corpus (text); at most ``MOST_TERMS`` words, the commonest among queries."""
    words = queries.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w")).filter("w <> ''")
    terms = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(MOST_TERMS).select("w")
    held = corpus.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w")).join(F.broadcast(terms), "w")
    n = corpus.count()
    return {r["w"]: math.log1p(n / r["df"]) for r in held.groupBy("w").agg(F.count("*").alias("df")).collect()}


def fit(candidates: DataFrame, rarity: dict[str, float], *, most_pairs: int = MOST_PAIRS) -> PairScorer:
    """From candidates (query_id, query, passage, place, good): the better of two passages of a query shall score higher."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def taken(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, passages, places in batches:
            yield pd.Series([features(q, p, int(n), rarity) for q, p, n in zip(queries, passages, places, strict=True)])

    rows = candidates.select("query_id", "good", taken("query", "passage", "place").alias("f"))
    better, worse = rows.filter("good").select("query_id", F.col("f").alias("b")), rows.filter("not good").select("query_id", F.col("f").alias("w"))
    pairs = better.join(worse, "query_id").orderBy(F.xxhash64("query_id", "b", "w")).limit(most_pairs).collect()
    if not pairs:
        return PairScorer(np.array([0.0] * (len(NAMES) - 1) + [1.0]), rarity)  # the present order
    x = np.array([r["b"] for r in pairs]) - np.array([r["w"] for r in pairs])
    weights = np.zeros(x.shape[1])
    for _ in range(STEPS):
        off = 1 / (1 + np.exp(np.clip(x @ weights, -30, 30)))
        weights += RATE * (x.T @ off / len(x) - DECAY * weights)
    return PairScorer(weights, rarity)


def mean_reciprocal_rank(ranked: DataFrame) -> float:
    """Of (query_id, good, pos): the mean over queries of one over the first good place, 0 where there is none."""
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col("good"), F.col("pos"))).alias("pos"))
    return float(first.agg(F.avg(F.coalesce(1.0 / F.col("pos"), F.lit(0.0)))).first()[0] or 0.0)
