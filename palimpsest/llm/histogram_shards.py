"""Byte-balanced sharding by histogram sort.

Rows are ordered by a 128-bit key, the identifier followed by a hash of the
text. The cut points between shards are found without moving a row: in each
round every partition counts its exact bytes and rows below a list of candidate
keys, the counts are summed, and the bracket around each cut point is probed
anew until the bytes below a probe are within the tolerance of what is wanted.
Then all rows are exchanged once, to the part that the final keys give them.

A shard is cut into parts of a bounded number of bytes, so no task holds a whole
shard of a large input; the rows below each part are known exactly, so a row's
slot in its shard is its place in its sorted part plus a constant.

Rows with equal texts are a group by their ``text_crc32`` and size. The law of equal
bytes asks nothing of them: they lie where their identifiers put them, so a group
that holds a third of all rows is spread over a third of the shards.

Defined cases: a null text has no bytes and is hashed as empty; a null
identifier sorts first; rows that repeat identifier and text have one key and
stay in one part, in any order; an empty table gives an empty result; columns
of the input named like a result column are replaced by it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import discard, materialize, table

OVERHEAD_BYTES = 16
PART_BYTES = 256 << 20
RESULT = ("size", "shard", "slot")
PROBES = 8
_BIAS = 1 << 63


@dataclass(frozen=True)
class Cut:
    """A boundary: rows with smaller keys hold so many bytes and are so many."""

    key: int
    bytes_below: int
    rows_below: int


def _halves(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    high = np.array([(k >> 64) - _BIAS for k in keys], np.int64)
    low = np.array([(k & (1 << 64) - 1) - _BIAS for k in keys], np.int64)
    return high, low


def _interval(high: np.ndarray, low: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the sorted keys are at or below each row's key."""
    first, last = np.searchsorted(keys[0], high, "left"), np.searchsorted(keys[0], high, "right")
    out = first.copy()
    tied = np.flatnonzero(last > first)
    for start in np.unique(first[tied]):
        rows = tied[first[tied] == start]
        out[rows] = start + np.searchsorted(keys[1][start : last[rows[0]]], low[rows], "right")
    return out


def _counts(rows: DataFrame, keys: list[int]) -> list[tuple[int, int]]:
    """Bytes and rows between neighbouring keys: one more entry than keys, whatever the input's size."""
    halves = _halves(keys)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, number = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
        for batch in batches:
            at = _interval(batch["key_high"].to_numpy(), batch["key_low"].to_numpy(), halves)
            np.add.at(sizes, at, batch["size"].to_numpy())
            number += np.bincount(at, minlength=len(number))
        some = np.flatnonzero(number)
        yield pd.DataFrame({"at": some, "bytes": sizes[some], "number": number[some]})

    found = rows.mapInPandas(count, "at int, bytes long, number long")
    out = [(0, 0)] * (len(keys) + 1)
    for row in found.groupBy("at").agg(F.sum("bytes").alias("b"), F.sum("number").alias("n")).collect():
        out[row["at"]] = row["b"], row["n"]
    return out


def splitters(rows: DataFrame, wanted: list[float], tolerance: list[float]) -> list[Cut]:
    """For each wanted number of bytes below, the probed key that comes near enough, or as near as keys allow."""
    ends = rows.agg(
        F.min(F.struct("key_high", "key_low")).alias("least"), F.max(F.struct("key_high", "key_low")).alias("most"),
        F.sum("size").alias("bytes"), F.count("*").alias("rows"),
    ).first()
    if not ends["rows"]:
        return [Cut(0, 0, 0)] * len(wanted)
    whole = lambda x: (x["key_high"] + _BIAS << 64) | x["key_low"] + _BIAS
    cuts = [Cut(whole(ends["least"]), 0, 0), Cut(whole(ends["most"]) + 1, ends["bytes"], ends["rows"])]
    while True:
        below = [c.bytes_below for c in cuts]
        probes: set[int] = set()
        for want, near in zip(wanted, tolerance, strict=True):
            i = min(max(bisect_right(below, want), 1), len(cuts) - 1)
            left, right = cuts[i - 1], cuts[i]
            if min(abs(left.bytes_below - want), abs(right.bytes_below - want)) > near and right.key - left.key > 1:
                step = max(1, (right.key - left.key) // (PROBES + 1))
                probes.update(range(left.key + step, right.key, step))
        if not probes:
            break
        keys = sorted(probes | {c.key for c in cuts[1:-1]})
        held = _counts(rows, keys)
        b = n = 0
        fresh = []
        for key, (more_bytes, more_rows) in zip(keys, held, strict=False):
            b, n = b + more_bytes, n + more_rows
            fresh.append(Cut(key, b, n))
        cuts = [cuts[0], *fresh, cuts[-1]]
    below = [c.bytes_below for c in cuts]
    out = []
    for want in wanted:
        i = min(max(bisect_left(below, want), 1), len(cuts) - 1)
        out.append(min(cuts[i - 1], cuts[i], key=lambda c: abs(c.bytes_below - want)))
    return out


def shard_by_bytes(
    docs: DataFrame, shards: int, *, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002
) -> DataFrame:
    """All rows and columns of ``docs``, with ``size``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``parts`` comes from the bytes of the input: a multiple of ``shards``.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in RESULT)).alias("row"),
        (F.octet_length(body).cast("long") + OVERHEAD_BYTES).alias("size"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-_BIAS)).alias("key_high"), F.xxhash64(body).alias("key_low"),
    )
    slim = materialize(keyed.select("key_high", "key_low", "size"), "histogram-keys")

    total = slim.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-total // (shards * PART_BYTES))) if parts is None else max(1, parts // shards)
    n = shards * per_shard
    wanted = [total * i / n for i in range(1, n)]
    near = [total / shards * tolerance if i % per_shard == 0 else total / n / 4 for i in range(1, n)]
    cuts = splitters(slim, wanted, near)
    discard(slim)
    keys = _halves([c.key for c in cuts])
    below = [0, *(c.rows_below for c in cuts)]
    first_slot = np.array([below[i] - below[i - i % per_shard] for i in range(n)], np.int64)

    @F.pandas_udf("part int, before long")
    def place_of(key_high: pd.Series, key_low: pd.Series) -> pd.DataFrame:
        part = _interval(key_high.to_numpy(), key_low.to_numpy(), keys)
        return pd.DataFrame({"part": part, "before": first_slot[part]})

    dealt = keyed.withColumn("at", place_of("key_high", "key_low")).repartitionById(n, F.col("at.part"))
    dealt = dealt.sortWithinPartitions("key_high", "key_low")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    shard = F.floor(F.col("at.part") / per_shard).cast("int")
    return dealt.select("row.*", "size", shard.alias("shard"), (place + F.col("at.before")).alias("slot"))


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    sharded = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return sharded.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op1_histogram_shards": op1_histogram_shards}
ORACLE_SQL: dict[str, str] = {}
