"""A word embedding trained on the store's own texts, and texts as weighted means of it.

Words that stand within a few places of each other are counted in Spark; the counts' positive pointwise mutual
information is a symmetric matrix, held as sparse blocks of rows in a table. Its leading directions are found by
randomised block power iteration: each round multiplies all blocks, in tasks, with one matrix of vocabulary x dimensions,
which is sent along and comes back; that is orthogonalised on the driver. Vocabulary and dimensions are parameters, so
this matrix is bounded whatever the texts (20,000 x 64 floats: 5 MB). All texts are counted.

A text is the mean of its words' vectors, rare words weighing more, at unit length; one without known words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from palimpsest.functions.scalars import tokens
from palimpsest.storage import discard, materialize

DIMS, VOCABULARY, LEAST_COUNT = 64, 20_000, 3
WINDOW, ROUNDS, BLOCK_WORDS = 4, 4, 512
#: Words, or a text's if it has more, whose pairs are counted at a time.
PIECE_WORDS = 1 << 21
#: Share of all words at which a word's weight is a half.
HALF_WEIGHT = 1e-3
SEED = 7


@dataclass
class Embedding:
    """Vectors of a vocabulary, and the share that each word has of all words."""

    words: list[str]
    vectors: np.ndarray
    shares: np.ndarray

    def of(self, text: Column) -> Column:
        """Unit vectors of a column of texts, null where no word is known."""
        from pyspark.sql import SparkSession

        held = SparkSession.getActiveSession().sparkContext.broadcast((self.words, self.vectors.astype(np.float32), self.shares))

        @F.pandas_udf(ArrayType(FloatType()))
        def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words, vectors, shares = held.value
            place = {w: i for i, w in enumerate(words)}
            weighed = vectors * (HALF_WEIGHT / (HALF_WEIGHT + shares))[:, None].astype(np.float32)
            for batch in batches:
                yield batch.map(lambda row: _mean(row, place, weighed))

        return embedded(tokens(text))


def _mean(row, place: dict[str, int], weighed: np.ndarray) -> np.ndarray | None:
    if row is None:
        return None
    known = [place[w] for w in row if w in place]
    if not known:
        return None
    v = weighed[known].sum(axis=0)
    length = float(np.sqrt((v * v).sum()))
    return v / length if length else None


def vocabulary(texts: DataFrame, size: int = VOCABULARY, least: int = LEAST_COUNT) -> DataFrame:
    """(word, number, n): the commonest words of texts (text), numbered by falling count."""
    counts = texts.select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    held = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size).collect()  # as many as the vocabulary
    rows = [(r["word"], i, r["n"]) for i, r in enumerate(held)]
    return texts.sparkSession.createDataFrame(rows, "word string, number int, n long")


def together(texts: DataFrame, words: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a, b, n): how often two words of the vocabulary stand within ``window`` places of each other, both ways."""
    # in the order of their numbers
    known = texts.sparkSession.sparkContext.broadcast([r["word"] for r in words.orderBy("number").collect()])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(known.value, pa.string())
        for batch in batches:
            lists = batch.column("words")
            offsets = lists.offsets.to_numpy()
            # some texts at a time, so that their pairs are of bounded size
            cuts = np.unique(np.r_[np.searchsorted(offsets, np.arange(offsets[0], offsets[-1], PIECE_WORDS)), len(offsets) - 1])
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                here = lists.values.slice(offsets[first], offsets[last] - offsets[first])
                place = pc.fill_null(pc.index_in(here, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield _pairs(place, np.diff(offsets[first : last + 1]), len(vocabulary), window)

    pairs = texts.select(tokens(F.col("text")).alias("words")).filter("size(words) > 1").mapInArrow(counted, "a int, b int, n long")
    # a pair is exchanged one way and stands both ways then; a word beside itself counts for both
    summed = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    way = lambda a, b, n: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), n.alias("n"))
    both = F.when(F.col("a") == F.col("b"), F.array(way("a", "b", F.col("n") * 2))).otherwise(F.array(way("a", "b", F.col("n")), way("b", "a", F.col("n"))))
    return summed.select(F.explode(both).alias("p")).select("p.*")


def _pairs(place: np.ndarray, sizes: np.ndarray, size: int, window: int) -> pa.RecordBatch:
    """(a, b, n), a not above b, of texts whose words' numbers (-1: none) come one after another."""
    # texts lie as far apart as words of two texts must not meet
    row = np.full(len(place) + window * len(sizes), -1, np.int64)
    row[np.arange(len(place)) + np.repeat(window * np.arange(len(sizes)), sizes)] = place
    keys = []
    for step in range(1, window + 1):
        a, b = row[:-step], row[step:]
        both = (a >= 0) & (b >= 0)
        a, b = a[both], b[both]
        keys.append(np.minimum(a, b) * size + np.maximum(a, b))
    pair, n = np.unique(np.concatenate(keys), return_counts=True)
    return pa.RecordBatch.from_pydict({"a": (pair // size).astype(np.int32), "b": (pair % size).astype(np.int32), "n": n.astype(np.int64)})


def informative(pairs: DataFrame) -> DataFrame:
    """(block, a, b, x): positive pointwise mutual information, a symmetric matrix."""
    sums = pairs.groupBy("a").agg(F.sum("n").cast("double").alias("of_a"))
    total = sums.agg(F.sum("of_a").alias("all"))  # a single row
    held = pairs.join(sums, "a").join(sums.select(F.col("a").alias("b"), F.col("of_a").alias("of_b")), "b").crossJoin(F.broadcast(total))
    x = F.ln(F.col("n") * F.col("all") / (F.col("of_a") * F.col("of_b")))
    return held.select((F.col("a") / BLOCK_WORDS).cast("int").alias("block"), "a", "b", x.cast("float").alias("x")).filter("x > 0")


def _packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["a", "b"])
    parts = (rows["a"].to_numpy(np.int32), rows["b"].to_numpy(np.int32), rows["x"].to_numpy(np.float32))
    return pd.DataFrame({"block": [key[0]], **{c: [p.tobytes()] for c, p in zip("abx", parts, strict=True)}})


def product(blocks: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """The sparse matrix of the blocks times a dense one, block by block in tasks."""
    held = blocks.sparkSession.sparkContext.broadcast(matrix.astype(np.float32))

    def times(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = held.value
        for batch in batches:
            for row in batch.itertuples():
                a, b, x = np.frombuffer(row.a, np.int32), np.frombuffer(row.b, np.int32), np.frombuffer(row.x, np.float32)
                rows = np.unique(a)
                out = np.zeros((len(rows), dense.shape[1]), np.float64)
                # entries in pieces, so that a block of common words needs no more than its share of memory; they are in
                # order of their rows, so those of a row are summed as a stretch
                for at in range(0, len(a), 1 << 16):
                    piece = slice(at, at + (1 << 16))
                    heads = np.flatnonzero(np.r_[True, a[piece][1:] != a[piece][:-1]])
                    out[np.searchsorted(rows, a[piece][heads])] += np.add.reduceat(dense[b[piece]] * x[piece, None], heads, axis=0, dtype=np.float64)
                yield pd.DataFrame({"rows": [rows.astype(np.int32).tobytes()], "cells": [out.tobytes()]})

    out = np.zeros(matrix.shape)
    for row in blocks.mapInPandas(times, "rows binary, cells binary").collect():  # vocabulary x dimensions in all
        rows = np.frombuffer(row["rows"], np.int32)
        out[rows] = np.frombuffer(row["cells"]).reshape(len(rows), -1)
    return out


def train(texts: DataFrame, *, dims: int = DIMS, size: int = VOCABULARY, least: int = LEAST_COUNT, window: int = WINDOW, rounds: int = ROUNDS) -> Embedding:
    """An embedding from all texts (text)."""
    words = vocabulary(texts, size, least)
    held = words.orderBy("number").collect()
    names, counts = [r["word"] for r in held], np.array([r["n"] for r in held], float)
    if not names:
        return Embedding([], np.zeros((0, dims)), np.zeros(0))
    pairs = materialize(together(texts, words, window), "word-pairs")
    blocks = informative(pairs).groupBy("block").applyInPandas(_packed, "block int, a binary, b binary, x binary")
    blocks = materialize(blocks, "word-blocks")
    discard(pairs)
    width = min(len(names), dims + 8)
    base = np.linalg.qr(np.random.default_rng(SEED).normal(size=(len(names), width)))[0]
    for _ in range(rounds):
        base = np.linalg.qr(product(blocks, base))[0]
    small = base.T @ product(blocks, base)
    value, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(value))[:dims]
    vectors = (base @ turn[:, order]) * np.sqrt(np.abs(value[order]))
    discard(blocks)
    return Embedding(names, np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1]))), counts / counts.sum())
