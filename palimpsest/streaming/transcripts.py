"""Transcripts that grow, as streams into a session store: whole folders, or single files that hook events name."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources import appended_lines as A
from palimpsest.sources import transcripts as T
from palimpsest.storage import discard, materialize
from palimpsest.streaming.ingest import drain
from palimpsest.streaming.session_store import ANEW, COLUMNS, SessionStore

Adapter = Callable[[DataFrame], DataFrame]

PARSER = "v1"
#: Adapters of files that grow, by the folder that tells them apart.
ADAPTERS: Mapping[str, Adapter] = {"log-a": T.append_log_a, "log-b": T.append_log_b}
#: Kinds of hook events after which a session's file is read on; others only pass by.
READING = ("stop", "session-end", "pre-compact")
STATES = "path string, at long, mtime long, generation long, told long, mark long, part string"


def session_of(path: Column) -> Column:
    """A session is named by its file."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def messages_of(lines: DataFrame, adapter: Adapter) -> DataFrame:
    """Lines as messages, and as rows of role ``anew`` where a file was begun anew."""
    named = lines.withColumn("path", session_of(F.col("path")))
    rows = adapter(named.filter("value is not null").select("path", F.col("start").alias("line_no"), "value")).select(*COLUMNS)
    nothing = F.lit(None).cast("string")
    begun = named.filter("value is null").select(
        F.col("path").alias("session_id"), F.col("start").alias("seq"), nothing.alias("uuid"), F.lit(ANEW).alias("role"),
        nothing.alias("content"), nothing.alias("tool_name"), nothing.alias("timestamp"),
    )
    return rows.unionByName(begun)


def by_folder(lines: DataFrame, adapters: Mapping[str, Adapter] = ADAPTERS) -> DataFrame:
    """Each file's lines by the adapter whose folder it lies in; files of no adapter give nothing."""
    out = None
    for folder, adapter in adapters.items():
        part = messages_of(lines.filter(F.contains(F.lower("path"), F.lit(f"/{folder}/"))), adapter)
        out = part if out is None else out.unionByName(part)
    return out


def ingest_folder(store: SessionStore, folder: str, *, source: str = "main", parser: str = PARSER, adapters: Mapping[str, Adapter] = ADAPTERS, **options) -> None:
    """Store what is new in a folder since the last run of this source."""
    progress = f"{store.folder}.progress/{source}"
    stream = A.appended_lines(store.spark, folder, progress, parser=parser, **options)

    def write(batch: DataFrame, number: int) -> None:
        _add(store, batch, adapters, source, number)

    drain(stream, write, progress=progress)


def _add(store: SessionStore, lines: DataFrame, adapters: Mapping[str, Adapter], source: str, number: int) -> None:
    """Store a batch of lines. Each adapter looks at them twice, so they are written first: every file is opened once."""
    held = materialize(lines, "lines")
    store.add(by_folder(held, adapters), source, number)
    discard(held)


def _states(store: SessionStore, paths: list[str], but: str) -> dict:
    """What earlier batches have read of these files, as an offset of the source."""
    held = store.spark.read.schema(STATES).option("recursiveFileLookup", True).parquet(f"{store.folder}.files")
    mine = held.filter(F.col("path").isin(paths) & (F.col("part") != but))
    last = mine.groupBy("path").agg(F.max_by(F.struct("at", "mtime", "generation", "told", "mark"), "part").alias("s")).select("path", "s.*")
    return {"parser": PARSER, "files": {r["path"]: [r["at"], r["mtime"], r["generation"], r["told"], r["mark"]] for r in last.collect()}}


def ingest_hooks(store: SessionStore, events: DataFrame, *, source: str = "hooks", adapters: Mapping[str, Adapter] = ADAPTERS, progress: str | None = None) -> None:
    """Read on in the files that events (kind, path) name, and in no others.

    Of each micro-batch the names of its files come to the driver, once each, whatever the number and order of events.
    How far each file was read is kept beside the store under the part of the batch, after the part itself: a batch
    that is tried again starts where the batches before it ended. A file that is gone, or lies in no adapter's folder,
    gives nothing.
    """
    spark = store.spark
    A.register(spark)

    def read_on(batch: DataFrame, batch_id: int) -> None:
        known = None
        for folder in adapters:
            here = F.contains(F.lower("path"), F.lit(f"/{folder}/"))
            known = here if known is None else known | here
        asked = batch.filter(F.col("kind").isin(*READING) & F.col("path").isNotNull() & known)
        paths = sorted(r["path"] for r in asked.select("path").distinct().collect())
        if not paths:
            return
        part = store.part_of(source, batch_id)
        inner = [A.file_system(p)[1] for p in paths]
        after = _states(store, inner, part) if _has(spark, f"{store.folder}.files") else {"parser": PARSER, "files": {}}
        options = {"files": json.dumps(paths), "path": paths[0], "parser": PARSER}
        until = A.Folder(options).state(after)
        lines = spark.read.format(A.NAME).options(after=json.dumps(after), until=json.dumps(until), **options).load()
        _add(store, lines, adapters, source, batch_id)
        states = [(path, *packed, part) for path, packed in until["files"].items()]
        spark.createDataFrame(states, STATES).write.mode("overwrite").parquet(f"{store.folder}.files/{part.removeprefix('part=')}")

    drain(events, read_on, progress=progress or f"{store.folder}.progress/{source}")


def _has(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
