"""Ranked streams: rank, fuse, cap, blend, collapse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scalars import epoch, recency

RRF = 60


def stream(rows: DataFrame, pool: int, *order: Column | str) -> DataFrame:
    """The best ``pool`` rows with their 0-based rank; ranked after the limit, so over that many rows only."""
    return rows.orderBy(*order).limit(pool).withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(streams: list[tuple[DataFrame, float]], item: str = "item") -> DataFrame:
    """Weighted reciprocal rank fusion of ranked streams: sum of weight / (60 + rank)."""
    out = None
    for one, weight in streams:
        part = one.select(item, (F.lit(weight) / (RRF + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(item).agg(F.sum("part").alias("score"))


def fuse_lists(lists: list[DataFrame], item: str = "item") -> DataFrame:
    """Fusion of result lists: 1 / (61 + rank), and the first list that names an item."""
    out = None
    for nth, one in enumerate(lists):
        part = one.select(item, (1.0 / (RRF + 1 + F.col("rank"))).alias("part"), F.lit(nth).alias("list"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(item).agg(F.sum("part").alias("score"), F.min("list").alias("first_list"))


def capped(rows: DataFrame, by: str, most: int, *order: Column | str) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("nth") <= most).drop("nth")


def blend_recency(ranked: DataFrame, now: int, time_col: str = "timestamp") -> DataFrame:
    """Ranked rows by 1 / (1 + rank) times recency; ``pos`` counts from 1, ties keep their order."""
    blend = F.round(1.0 / (1 + F.col("rank")) * recency(epoch(F.col(time_col)), now), 12)
    return ranked.withColumn("pos", F.row_number().over(Window.orderBy(blend.desc(), "rank")))


def neighbours(rows: DataFrame, hit: Column, around: int) -> DataFrame:
    """(hit, id, away) for the rows of a hit's session up to ``around`` places away."""
    placed = rows.withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy("id")))
    near = placed.filter(hit).select("session_id", F.col("id").alias("hit"), F.col("rn").alias("at"))
    near = near.withColumn("rn", F.explode(F.sequence(F.col("at") - around, F.col("at") + around)))
    return near.join(placed, ["session_id", "rn"]).select("hit", "id", (F.col("rn") - F.col("at")).cast("long").alias("away"))


def margin(ranked: DataFrame) -> DataFrame:
    """How much farther the tenth hit (or the last) is than the first; null with fewer than three hits."""
    held = ranked.agg(F.array_sort(F.collect_list("distance")).alias("d"))
    tenth = F.element_at("d", F.least(F.lit(10), F.size("d")))
    return held.select(F.when(F.size("d") >= 3, tenth - F.element_at("d", 1)).alias("margin"))


def pinned_then_recent(sessions: DataFrame, most: int) -> DataFrame:
    order = [F.desc("pinned"), F.coalesce("ended_at", "started_at").desc(), F.col("id")]
    return sessions.orderBy(*order).limit(most).withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def thread_of(messages: DataFrame, session_id: str, most: int) -> DataFrame:
    """A session's first messages and whether there are more."""
    held = messages.filter(F.col("session_id") == session_id).select("id").orderBy("id").limit(most + 1)
    numbered = held.withColumn("nth", F.row_number().over(Window.orderBy("id"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    return numbered.filter(F.col("nth") <= most).select("id", (F.col("n") > most).alias("truncated"))


def abstains(top_distance: Column, margin_of: Column, far: float = 0.86, narrow: float = 0.05) -> Column:
    """Whether nothing is worth returning: the best is far and stands out little; without measurements, never."""
    return F.coalesce((top_distance > far) & (margin_of < narrow), F.lit(False))


def mix_by_cosine(ranked: DataFrame, cosine: str = "cosine") -> DataFrame:
    """Order by the fused ranks of the present order (``pos``) and of cosine; hits without a vector come last there."""
    by_cosine = F.row_number().over(Window.orderBy(F.coalesce(cosine, F.lit(-2.0)).desc(), "pos"))
    mixed = F.round(1.0 / (RRF + F.col("pos")) + 1.0 / (RRF + by_cosine), 12)
    ranked = ranked.withColumn("mixed", mixed)
    enough = F.count("*").over(Window.partitionBy()) >= 3
    order = F.when(enough, F.col("mixed")).otherwise(-F.col("pos").cast("double"))
    return ranked.withColumn("order", order).withColumn("mixed_pos", F.row_number().over(Window.orderBy(F.desc("order"), "pos"))).drop("order")


def first_fit(vectors: list, least: float, block: int = 256) -> list[int | None]:
    """For each vector in rank order the number of the first head that it repeats, or None where it is a head itself.

    Rows are compared with the heads so far a block at a time; within a block one after another. A null vector is a head
    that nothing repeats; vectors of another width are no likeness of each other.
    """
    out: list[int | None] = [None] * len(vectors)
    by_width: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None:
            by_width.setdefault(len(v), []).append(i)
    for width, rows in by_width.items():
        held = np.zeros((0, width))
        heads: list[int] = []
        for begin in range(0, len(rows), block):
            mine = rows[begin : begin + block]
            matrix = np.array([vectors[i] for i in mine], float).reshape(len(mine), width)
            old = matrix @ held.T >= least if len(heads) else np.zeros((len(mine), 0), bool)
            among = matrix @ matrix.T >= least
            fresh: list[int] = []
            for n, i in enumerate(mine):
                if old[n].any():
                    out[i] = heads[int(old[n].argmax())]
                elif fresh and among[n, fresh].any():
                    out[i] = mine[fresh[int(among[n, fresh].argmax())]]
                else:
                    fresh.append(n)
            heads += [mine[n] for n in fresh]
            held = np.concatenate([held, matrix[fresh]])
    return out


def collapse(ranked: DataFrame, least: float = 0.85, names: int = 5) -> DataFrame:
    """Near copies behind the hit they repeat: greedy first fit in rank order, over one query's hits, few or thousands.

    (query, id, pos, embedding) to (query, id, pos, head, similar, similar_ids): heads first, the others after them.
    """

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        ids = rows["id"].tolist()
        heads = first_fit([None if v is None else np.asarray(v, float) for v in rows["embedding"]], least)
        extra: dict[int, list] = {}
        for i, head in enumerate(heads):
            if head is not None:
                extra.setdefault(head, []).append(ids[i])
        ordered = [i for i, head in enumerate(heads) if head is None] + [i for i, head in enumerate(heads) if head is not None]
        return pd.DataFrame(
            [(key[0], ids[i], n, heads[i] is None, len(extra.get(i, [])), extra.get(i, [])[:names]) for n, i in enumerate(ordered, 1)],
            columns=["query", "id", "pos", "head", "similar", "similar_ids"],
        )

    return ranked.groupBy("query").applyInPandas(fit, "query long, id long, pos long, head boolean, similar long, similar_ids array<long>")


def rerank(ranked: DataFrame, scorer, *, head: int = 40, chars: int = 2000) -> DataFrame:
    """The first ``head`` hits by a scorer of texts, the others behind in their order; where it fails, the order stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                batch["relevance"] = [float(x) for x in scorer(batch["content"].str.slice(0, chars).tolist())]
            except Exception:  # a model that fails must not lose hits
                batch["relevance"] = float("nan")
            yield batch[["id", "pos", "relevance"]]

    first = ranked.filter(F.col("pos") <= head).select("id", "pos", "content").mapInPandas(run, "id long, pos long, relevance double")
    rest = ranked.filter(F.col("pos") > head).select("id", F.col("pos").cast("long").alias("pos"), F.lit(None).cast("double").alias("relevance"))
    usable = F.when(~F.isnan("relevance"), F.col("relevance"))
    both = first.unionByName(rest).withColumn("usable", usable).withColumn("tail", F.col("pos") > head)
    return both.select("id", F.row_number().over(Window.orderBy("tail", F.col("usable").desc_nulls_last(), "pos")).cast("long").alias("pos"))
