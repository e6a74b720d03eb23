"""A stored vector index in eight bits: parts that are added and removed from, a coarse scan with bounds, and exact scores for what they leave.

An index has an identity (profile, width, type), written once and never guessed: vectors of another profile or a smaller
width are refused, wider ones are cut to the width and brought to unit length, as queries are. A vector is stored twice:
as bytes, each component by the vector's own scale, in blocks of bounded size by a hash of the identifier; and as it is.
A search multiplies the bytes of every block, which bounds each cosine from both sides, and takes the exact cosine of all
that the bounds leave among the nearest: it finds what a search of all vectors finds.

Removals are parts as well: a vector counts if no later part removes it, and can be added anew. ``prune`` rewrites all
parts into one, which takes the old ones' place when it is complete. Vectors that are null or hold a null or non-finite
component, or have no length, are not stored; identifiers are unique among vectors that are there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.scalars import dot
from palimpsest.operators.sync import recover, swap_in
from palimpsest.operators.vectors import WIDTHS
from palimpsest.storage import discard, materialize, new_path

BLOCK_ROWS, QUERY_ROWS = 4096, 512
ADDED, REMOVED = "a", "r"
BLOCK = ("ids", "scales", "codes", "errors", "exact")
CODES = "number long, of long, " + ", ".join(f"{name} binary" for name in BLOCK)
VECTORS = "vec_id long, v array<float>"


class IdentityMismatch(ValueError):
    """The index was built by another profile, or vectors are too short for it."""


def unit(vector: Column, width: int) -> Column:
    """The first ``width`` components at unit length, as floats."""
    head = F.slice(vector, 1, width).cast("array<double>")
    length = F.sqrt(dot(head, head))
    return F.transform(head, lambda x: x / length).cast("array<float>")


class VectorStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        recover(spark, folder)
        held = spark.read.text(f"{folder}/identity").first()
        self.identity = json.loads(held["value"])

    @classmethod
    def create(cls, spark: SparkSession, folder: str | None = None, *, profile: str, width: int, native: int | None = None) -> VectorStore:
        """A new index; the width must be one that an index may have, or the model's own."""
        if width not in WIDTHS and width != native:
            raise IdentityMismatch(f"an index has one of the widths {WIDTHS} or its model's own, not {width}")
        folder = folder or new_path(spark, "vector-store")
        line = json.dumps({"profile": profile, "width": width, "dtype": "int8"})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{folder}/identity")
        return cls(spark, folder)

    def _named(self, kind: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in system.listStatus(path))
        return [n for n in names if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/{n}/_SUCCESS"))]

    def parts(self) -> list[str]:
        """Complete parts in order: of an added one, the vectors are written last."""
        return sorted([n for n in self._named("vectors") if n.endswith(ADDED)] + self._named("removed"))

    def _next(self, kind: str) -> str:
        return f"part={1 + max((int(n[5:13]) for n in self.parts()), default=0):08d}{kind}"

    def _read(self, kind: str, schema: str, names: list[str]) -> DataFrame:
        full = f"{schema}, part string"
        if not names:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.folder}/{kind}").parquet(*(f"{self.folder}/{kind}/{n}" for n in names))

    def _gone(self) -> DataFrame:
        """(vec_id, since): removed identifiers with the last part that removed them."""
        removed = self._read("removed", "vec_id long", [n for n in self.parts() if n.endswith(REMOVED)])
        return removed.groupBy("vec_id").agg(F.max("part").alias("since"))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (vec_id, part, ..) that no later part has removed."""
        if not self._named("removed"):
            return rows
        held = rows.join(self._gone(), "vec_id", "left")
        return held.filter(F.col("since").isNull() | (F.col("part") > F.col("since"))).drop("since")

    def vectors(self) -> DataFrame:
        """(vec_id, v) of what is there."""
        names = [n for n in self.parts() if n.endswith(ADDED)]
        return self._live(self._read("vectors", VECTORS, names)).select("vec_id", "v")

    def usable(self, vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        width = self.identity["width"]
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists(F.slice("v", 1, width), lambda x: x != 0))
        return rows.select("vec_id", unit(F.col("v"), width).alias("v"))

    def add(self, vectors: DataFrame, *, profile: str, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        width = self.identity["width"]
        if profile != self.identity["profile"]:
            raise IdentityMismatch(f"the index holds {self.identity['profile']}, these vectors are {profile}")
        least = vectors.filter(F.col(vector_col).isNotNull()).agg(F.min(F.size(vector_col))).first()[0]
        if least is not None and least < width:
            raise IdentityMismatch(f"the index is {width} wide, some of these vectors {least}")
        self._write(self.usable(vectors, id_col, vector_col), self.folder, self._next(ADDED))

    def _write(self, rows: DataFrame, folder: str, part: str) -> None:
        rows = materialize(rows, "vectors")
        n = max(1, -(-rows.count() // BLOCK_ROWS))
        keyed = rows.withColumn("number", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
        keyed.groupBy("number").applyInPandas(_quantised(n), CODES).write.mode("overwrite").parquet(f"{folder}/codes/{part}")
        rows.write.mode("overwrite").parquet(f"{folder}/vectors/{part}")
        discard(rows)

    def remove(self, ids: DataFrame) -> None:
        """Take vectors (vec_id) out."""
        ids.select(F.col("vec_id").cast("long").alias("vec_id")).distinct().write.parquet(f"{self.folder}/removed/{self._next(REMOVED)}")

    def prune(self) -> int:
        """Rewrite the index without what was removed; the number of vectors."""
        fresh = f"{self.folder}.pruned"
        held = self.vectors()
        n = held.count()
        self._write(held, fresh, "part=00000001a")
        found = self.spark.read.schema(VECTORS).parquet(f"{fresh}/vectors/part=00000001a").count()
        if found != n:
            raise ValueError(f"pruning lost vectors: {n} before, {found} after")
        line = json.dumps(self.identity)
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{fresh}/identity")
        swap_in(self.spark, fresh, self.folder)
        return n

    def _dead(self, blocks: DataFrame) -> DataFrame:
        """(part, number, dead): of each block the identifiers that a later part has removed; ``blocks`` has part, number and of."""
        names = [n for n in self.parts() if n.endswith(ADDED)]
        there = self._read("vectors", VECTORS, names).select("vec_id", "part")
        dead = there.join(self._gone(), "vec_id").filter(F.col("since") > F.col("part"))
        sizes = blocks.select("part", "of").distinct()  # a row for each part
        numbered = dead.join(F.broadcast(sizes), "part").withColumn("number", F.pmod(F.xxhash64("vec_id"), F.col("of")))
        return numbered.groupBy("part", "number").agg(F.collect_list("vec_id").alias("dead"))

    def search(self, queries: DataFrame, k: int, *, id_col: str = "query_id", vector_col: str = "embedding", digits: int = 9) -> DataFrame:
        """(query_id, rank, vec_id, cosine): the k nearest of each query by exact cosine.

        Cosines are rounded once, to ``digits`` places; those that are equal then are ties, which go to the smaller identifier.
        """
        asked = materialize(self.usable(queries, id_col, vector_col), "asked")
        codes = self._read("codes", CODES, [n for n in self.parts() if n.endswith(ADDED)])
        n_codes, n_asked = codes.count(), asked.count()
        # blocks are numbered by their keys alone
        keys = codes.select("part", "number", "of")
        numbers = keys.withColumn("block", F.row_number().over(Window.orderBy("part", "number")).cast("long")).drop("of")
        held = codes.join(F.broadcast(numbers), ["part", "number"]).join(self._dead(keys), ["part", "number"], "left")
        held = held.select("block", F.lit(False).alias("asks"), "dead", *BLOCK)
        n_lots = max(1, -(-n_asked // QUERY_ROWS))
        q = asked.withColumn("number", F.pmod(F.xxhash64("vec_id"), F.lit(n_lots))).groupBy("number").applyInPandas(_quantised(n_lots), CODES)
        everywhere = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max(1, n_codes)).cast("long"))).alias("block")
        q = q.select(everywhere, F.lit(True).alias("asks"), F.lit(None).cast("array<bigint>").alias("dead"), *BLOCK)
        dealt = held.unionByName(q).repartitionById(max(1, n_codes), (F.col("block") - 1).cast("int")).sortWithinPartitions("block", "asks")
        near = dealt.mapInPandas(_nearest(k, digits), "query_id long, vec_id long, cosine double")
        order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
        return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")


def _quantised(of: int):
    """A block of vectors: bytes and scales, how far these are from the vectors, and the vectors themselves."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        matrix = np.stack(rows["v"].to_numpy()).astype(np.float32)
        scales = np.maximum(np.abs(matrix).max(axis=1), np.float32(1e-30)) / np.float32(127)
        codes = np.rint(matrix / scales[:, None]).astype(np.int8)
        errors = np.linalg.norm(matrix - codes * scales[:, None].astype(np.float64), axis=1)
        cells = {"ids": rows["vec_id"].to_numpy(np.int64), "scales": scales, "codes": codes, "errors": errors, "exact": matrix}
        return pd.DataFrame({"number": [key[0]], "of": [of]} | {name: [cell.tobytes()] for name, cell in cells.items()})

    return run


def _nearest(k: int, digits: int):
    """Each block's k nearest for the queries that come after it.

    Products of bytes say between which bounds a cosine lies. Those whose upper bound is below the k-th lower one can't
    be among the k; the others get their exact cosine.
    """
    step = 10.0**digits

    def opened(row):
        ids, scales, errors = np.frombuffer(row.ids, np.int64), np.frombuffer(row.scales, np.float32), np.frombuffer(row.errors)
        return ids, scales.astype(np.float64), errors, np.frombuffer(row.codes, np.int8).reshape(len(ids), -1).astype(np.float32), np.frombuffer(row.exact, np.float32).reshape(len(ids), -1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = held = None
        for batch in batches:
            for row in batch.itertuples():
                block = opened(row)
                if not row.asks:
                    if row.dead is not None and len(row.dead):
                        there = ~np.isin(block[0], row.dead)
                        block = tuple(x[there] for x in block)
                    number, held = row.block, block
                    continue
                if row.block != number or not len(held[0]):
                    continue
                (ids, scales, errors, codes, exact), (theirs, their_scales, their_errors, their_codes, their_exact) = block, held
                # products of bytes are whole numbers that floats of this size hold exactly
                scores = (codes @ their_codes.T).astype(np.float64) * their_scales * scales[:, None]
                # vectors are of unit length but for the last digit of a float; the rest is for that and for the rounding
                slack = errors[:, None] + (1 + errors[:, None]) * their_errors[None, :] + 1e-5 + 1 / step
                most = min(len(theirs), k)
                least = -np.partition(slack - scores, most - 1, axis=1)[:, most - 1]
                maybe = scores + slack >= least[:, None]
                out = []
                for i in range(len(ids)):
                    at = np.flatnonzero(maybe[i])
                    cosine = their_exact[at].astype(np.float64) @ exact[i].astype(np.float64)
                    cosine = np.copysign(np.floor(np.abs(cosine) * step + 0.5) / step, cosine)
                    best = np.lexsort((theirs[at], -cosine))[:most]
                    out.append(pd.DataFrame({"query_id": ids[i], "vec_id": theirs[at[best]], "cosine": cosine[best]}))
                yield pd.concat(out, ignore_index=True)

    return run
