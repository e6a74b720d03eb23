"""Vector search and upkeep of the embedding index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scalars import dot

WINDOW_CHARS, STEP_CHARS, MOST_CHUNKS = 6000, 5500, 8
# How each profile encodes (pooling, whether texts get a prompt, native width, type of stored numbers), the
# prompts, and the widths that an index may have.
PROFILES = {"raw": ("mean", False, 768, "fp32"), "gemma-prompt-v1": ("mean", True, 768, "fp32"), "bge-m3-v1": ("cls", False, 1024, "int8")}
QUERY_PROMPT, TEXT_PROMPT = "task: search result | query: ", "title: none | text: "
WIDTHS = (128, 256, 512, 768, 1024)


def embeddable(tools: list[str] | None = None) -> Column:
    """Non-empty content of prose or of an allowed tool; ``["all"]`` allows every tool."""
    allowed = F.lit(True) if tools == ["all"] else F.col("tool_name").isNull() | F.col("tool_name").isin(tools or [])
    return (F.coalesce("content", F.lit("")) != "") & F.coalesce(allowed, F.lit(False))


def chunks(text: Column) -> Column:
    """Overlapping windows of a text, the first eight; a short text is one."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - WINDOW_CHARS + STEP_CHARS - 1), F.lit(STEP_CHARS))
    return F.slice(F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(WINDOW_CHARS))), 1, MOST_CHUNKS)


def profile(name: Column) -> Column:
    """A struct (pooling, prompted, dims, dtype) of a profile; unknown ones are raw."""
    shape = lambda spec: F.struct(*(F.lit(v).alias(c) for v, c in zip(spec, ("pooling", "prompted", "dims", "dtype"), strict=True)))
    found = shape(PROFILES["raw"])
    for held, spec in PROFILES.items():
        found = F.when(name == held, shape(spec)).otherwise(found)
    return found


def prompted(text: Column, is_query: Column, wanted: Column) -> Column:
    return F.when(wanted, F.concat(F.when(is_query, QUERY_PROMPT).otherwise(TEXT_PROMPT), text)).otherwise(text)


def target_dims(asked: Column, native: Column) -> Column:
    """The width asked for, if an index may have it and the model gives as much; else the model's own."""
    return F.when(asked.isin(*WIDTHS) & (asked <= native), asked).otherwise(native)


def distances(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Euclidean distance of unit vectors to the one query vector (``q``), which is a single row."""
    cosine = F.round(dot(F.col("embedding"), F.col("q")), 9)
    distance = F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - cosine * 2))
    return vectors.crossJoin(F.broadcast(query.limit(1))).withColumn("cosine", cosine).withColumn("distance", distance)


def nearest(vectors: DataFrame, query: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """The k nearest with their 0-based rank; ties to the smaller identifier."""
    top = distances(vectors, query).orderBy("distance", id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)) - 1)


def nearest_owners(vectors: DataFrame, owners: DataFrame, query: DataFrame, pool: int) -> DataFrame:
    """Twice the pool's chunks, each owner by its best one, orphans dropped, ranked anew."""
    hits = nearest(vectors, query, 2 * pool).join(owners, "vec_id")
    best = hits.groupBy("owner").agg(F.min("rank").alias("best"), F.min("distance").alias("distance"))
    return best.withColumn("rank", F.row_number().over(Window.orderBy("best", "owner")) - 1).filter(F.col("rank") < pool).drop("best")


def _packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id")
    matrix = np.zeros((len(rows), max(1, int(rows["embedding"].map(len).max()))))
    for i, v in enumerate(rows["embedding"]):
        matrix[i, : len(v)] = v
    return pd.DataFrame({"number": [key[0]], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "width": [matrix.shape[1]], "cells": [matrix.tobytes()]})


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): rows with an identifier and a whole finite vector; shorter vectors count as padded with zeros."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)


def _blocks(vectors: DataFrame, size: int) -> tuple[DataFrame, int]:
    n = max(1, -(-vectors.count() // size))
    keyed = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("number"))
    return keyed.groupBy("number").applyInPandas(_packed, "number long, ids binary, width int, cells binary"), n


def similar_pairs(vectors: DataFrame, queries: DataFrame, least: float, most: int, block_rows: int = 2048) -> DataFrame:
    """For each query vector its ``most`` best others of cosine ``least`` or more, as undirected pairs (a, b, cosine).

    A block of vectors goes to one task once; the blocks of queries, the smaller side, are copied to every one and pass
    by it. A meeting gives ``most`` rows for each query.
    """

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = held = None
        for batch in batches:
            for row in batch.itertuples():
                ids, cells = np.frombuffer(row.ids, np.int64), np.frombuffer(row.cells).reshape(-1, row.width)
                if not row.asks:
                    number, held = row.block, (ids, cells)
                    continue
                if row.block != number:
                    continue  # a block that no vector has been dealt to
                theirs, matrix = held
                width = min(row.width, matrix.shape[1])
                scores = np.round(cells[:, :width] @ matrix[:, :width].T, 6)
                scores[(ids[:, None] == theirs[None, :]) | (scores < least)] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, :most]  # identifiers ascend, so ties go to the smaller
                q, nth = np.nonzero(np.isfinite(np.take_along_axis(scores, best, axis=1)))
                found = best[q, nth]
                yield pd.DataFrame({"q": ids[q], "v": theirs[found], "cosine": scores[q, found]})

    held, n = _blocks(usable(vectors), block_rows)
    asked, _ = _blocks(usable(queries), block_rows)
    held = held.select(F.col("number").alias("block"), F.lit(False).alias("asks"), "number", "ids", "width", "cells")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block")
    asked = asked.select(everywhere, F.lit(True).alias("asks"), "number", "ids", "width", "cells")
    dealt = held.unionByName(asked).repartitionById(n, F.col("block").cast("int")).sortWithinPartitions("block", "asks", "number")
    hits = dealt.mapInPandas(meet, "q long, v long, cosine double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "v"))
    chosen = hits.withColumn("nth", nth).filter(F.col("nth") <= most)
    return chosen.select(F.least("q", "v").alias("a"), F.greatest("q", "v").alias("b"), "cosine").distinct()
