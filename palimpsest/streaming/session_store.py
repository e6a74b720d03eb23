"""A message table in parts, each divided by a hash of the session.

``part=<number>-<source>-<batch>`` holds what one batch has added, in folders ``bucket=<n>``: a batch reads the buckets
of its own sessions, of all parts, and no others. A part counts once its write is complete, and a batch that is tried
again writes its own part anew, so it changes nothing. Many small parts are rewritten into one by ``compact``, which
compares counts and sums of row hashes before the new table takes the old one's place.

Where a file was begun anew, its session is replaced: a row of role ``anew`` in a part takes all rows of the session in
earlier parts out of sight. Such rows go when the table is compacted. Messages are known by (session, uuid), those
without uuid by content; what is known adds nothing. One writer at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.scalars import redact
from palimpsest.operators.store import new_messages
from palimpsest.operators.sync import fingerprint, recover, swap_in
from palimpsest.storage import discard, materialize, new_path

BUCKETS = 64
ANEW = "anew"
COLUMNS = ("session_id", "seq", "uuid", "role", "content", "tool_name", "timestamp")
SCHEMA = "session_id string, seq long, uuid string, role string, content string, tool_name string, timestamp string, part string, bucket int"


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def bucket_of(session_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(buckets)).cast("int")


class SessionStore:
    def __init__(self, spark: SparkSession, folder: str, *, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets
        recover(spark, folder)

    def parts(self) -> list[str]:
        """Names of the complete parts, in order; a list of as many as there were batches since the last ``compact``."""
        path, system = _path(self.spark, self.folder)
        if not system.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in system.listStatus(path) if s.isDirectory())
        return [n for n in names if n.startswith("part=") and system.exists(_path(self.spark, f"{self.folder}/{n}/_SUCCESS")[0])]

    def stored(self, parts: list[str] | None = None) -> DataFrame:
        """All rows as they lie, those out of sight included."""
        parts = self.parts() if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", self.folder).parquet(*(f"{self.folder}/{p}" for p in parts))

    def in_sight(self, rows: DataFrame) -> DataFrame:
        """The messages of stored rows: those of a session's last beginning. Few sessions ever begin anew."""
        begun = rows.filter(F.col("role") == ANEW).groupBy("session_id").agg(F.max("part").alias("since"))
        held = rows.filter(F.col("role") != ANEW).join(begun, "session_id", "left")
        return held.filter(F.col("since").isNull() | (F.col("part") >= F.col("since"))).select(*COLUMNS)

    def messages(self) -> DataFrame:
        return self.in_sight(self.stored())

    def sessions_of(self, wanted: DataFrame, parts: list[str] | None = None) -> DataFrame:
        """The messages of the sessions in ``wanted`` (session_id), from their buckets alone."""
        numbers = [r[0] for r in wanted.select(bucket_of(F.col("session_id"), self.buckets)).distinct().collect()]  # as many as buckets
        rows = self.stored(parts).filter(F.col("bucket").isin(numbers))
        return self.in_sight(rows.join(wanted.select("session_id").distinct(), "session_id", "left_semi"))

    def part_of(self, source: str, batch_id: int) -> str:
        """The part of a batch: its own one if it was tried before, else a new last one."""
        names = self._all_parts()
        mine = [n for n in names if n.endswith(f"-{source}-{batch_id:08d}")]
        return mine[0] if mine else f"part={1 + max((_number(n) for n in names), default=0):08d}-{source}-{batch_id:08d}"

    def _all_parts(self) -> list[str]:
        path, system = _path(self.spark, self.folder)
        return sorted(s.getPath().getName() for s in system.listStatus(path) if s.getPath().getName().startswith("part=")) if system.exists(path) else []

    def add(self, batch: DataFrame, source: str, batch_id: int) -> None:
        """Write a batch's new messages (and its ``anew`` rows) as its part. ``batch`` has the columns of a message."""
        if not re.fullmatch(r"[A-Za-z0-9_]+", source):
            raise ValueError("a source is named by letters, digits and underscores")
        part = self.part_of(source, batch_id)
        before = [p for p in self.parts() if p != part]
        # a batch is asked for its sessions, its replaced ones and its messages: its files are parsed once
        rows = materialize(batch.select(*COLUMNS), "batch")
        anew = rows.filter(F.col("role") == ANEW).select("session_id").distinct()
        fresh = rows.filter(F.col("role") != ANEW).withColumn("content", redact(F.col("content")))
        held = self.sessions_of(rows, before).join(anew, "session_id", "left_anti").select(*COLUMNS)
        new = new_messages(held, fresh, by_content=True)
        told = rows.filter(F.col("role") == ANEW).dropDuplicates(["session_id"])
        out = new.unionByName(told).withColumn("bucket", bucket_of(F.col("session_id"), self.buckets))
        # a few tasks for each bucket at most, so a part has few files
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{part}")
        discard(rows)

    def compact(self) -> int:
        """Rewrite all parts into one; the number of messages. Nothing is replaced unless every row is there."""
        parts = self.parts()
        if len(parts) < 2:
            return self.messages().count()
        fresh = f"{self.folder}.rewritten"
        held = self.messages()
        last = f"part={_number(parts[-1]):08d}-compact-00000000"
        out = held.withColumn("bucket", bucket_of(F.col("session_id"), self.buckets))
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{fresh}/{last}")
        again = self.spark.read.schema(SCHEMA).option("basePath", fresh).parquet(f"{fresh}/{last}").select(*COLUMNS)
        wanted, found = fingerprint(held), fingerprint(again)
        if wanted != found:
            raise ValueError(f"rewriting the store lost rows: {wanted} before, {found} after")
        swap_in(self.spark, fresh, self.folder)
        return wanted[0]


def _number(part: str) -> int:
    return int(part.removeprefix("part=").split("-")[0])


def scratch_store(spark: SparkSession, label: str = "session-store", **options) -> SessionStore:
    return SessionStore(spark, new_path(spark, label), **options)
