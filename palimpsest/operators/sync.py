"""Synchronisation of stores through a shared folder of bundles, and moving a store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.store import new_messages
from palimpsest.storage import materialize, new_path

MOST_CHUNKS = 12
_MEMO = "bundle string, signature string"


@dataclass
class Machine:
    """What one machine keeps: its messages, the bundles that it has merged, and the last identifier that it has exported."""

    messages: DataFrame
    merged: DataFrame
    watermark: int = -1

    @classmethod
    def of(cls, messages: DataFrame) -> Machine:
        return cls(messages, messages.sparkSession.createDataFrame([], _MEMO))


@dataclass
class Synced:
    """The state after a synchronisation, how many bundles were merged and skipped, and what was pushed."""

    machine: Machine
    merged: int
    skipped: int
    kind: str
    pushed: int


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the bundles in a folder, as many as there are chunks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def signatures(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(bundle, signature) from sizes and times of a bundle's files; a bundle that is written anew has another one."""
    if not names:
        return spark.createDataFrame([], _MEMO)
    files = spark.read.format("binaryFile").load([f"{folder}/{n}/*.parquet" for n in names]).select("path", "length", "modificationTime")
    bundle = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    return files.groupBy(bundle.alias("bundle")).agg(F.concat_ws(":", F.sum("length"), F.max("modificationTime")).alias("signature"))


def _rows(spark: SparkSession, folder: str, names: list[str], like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(*(f"{folder}/{n}" for n in names))


def sync_folder(machine: Machine, folder: str, host: str, *, most_chunks: int = MOST_CHUNKS) -> Synced:
    """Merge the bundles that the machine has not merged yet, then add what it has exported to nobody as a chunk.

    Bundles are known by their signatures, so a bundle that is read again adds nothing and costs nothing. Merged rows
    get identifiers above the machine's own, so that the next chunk takes them along. A folder of ``most_chunks`` or
    more is folded into one baseline; the old chunks go once the new one is written.
    """
    spark = machine.messages.sparkSession
    names = _names(spark, folder)
    found = materialize(signatures(spark, folder, names), "signatures")
    fresh = [r.bundle for r in found.join(machine.merged, ["bundle", "signature"], "left_anti").select("bundle").collect()]  # names of chunks
    held = machine.messages
    if fresh:
        last = held.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last"))
        new = new_messages(held, _rows(spark, folder, fresh, held), by_content=True).crossJoin(F.broadcast(last))  # a single row
        new = new.withColumn("id", F.col("last") + 1 + F.monotonically_increasing_id()).select(held.columns)
        held = materialize(held.unionByName(new), "synced")

    folding = len(names) >= most_chunks
    since = -1 if folding or not names else machine.watermark
    chunk = held.filter(F.col("id") > since)
    pushed, top = chunk.agg(F.count("*"), F.max("id")).first()
    mine = found
    if pushed:
        name = f"{len(names):06d}-{host}-{new_path(spark, 'chunk')[-8:]}"
        chunk.write.parquet(f"{folder}/{name}")
        if folding:
            _delete(spark, [f"{folder}/{n}" for n in names])
        mine = found.unionByName(signatures(spark, folder, [name]))
    # the memo keeps the last signature of each bundle; those of folded ones do no harm
    memo = machine.merged.join(mine, "bundle", "left_anti").unionByName(mine)
    kind = "none" if not pushed else "compact" if folding else "delta" if names else "baseline"
    state = Machine(held, materialize(memo, "merged-bundles"), top if pushed else machine.watermark)
    return Synced(state, len(fresh), len(names) - len(fresh), kind, pushed)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for where in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fingerprint(df: DataFrame) -> tuple:
    """Count and order-free sums of row hashes."""
    row = F.xxhash64(*sorted(df.columns))
    return tuple(df.agg(F.count("*"), F.sum(F.shiftright(row, 32)), F.sum(row.bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def move_store(tables: dict[str, DataFrame], target: str) -> dict[str, DataFrame]:
    """Copy a store's tables below ``target``, verify them, and return the copies; the old store stays as it is.

    Raises where a copy differs, before anything points to it. An existing target is refused.
    """
    moved = {}
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.mode("errorifexists").parquet(f"{target}/{name}")
        moved[name] = spark.read.schema(df.schema).parquet(f"{target}/{name}")
        if fingerprint(df) != fingerprint(moved[name]):
            raise ValueError(f"the copy of {name} differs from its source")
    return moved


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def swap_in(spark: SparkSession, fresh: str, folder: str) -> None:
    """Put a verified folder in another's place by two renames; ``recover`` ends what was interrupted between them."""
    (new, system), (old, _), (aside, _) = _at(spark, fresh), _at(spark, folder), _at(spark, f"{folder}.before")
    if system.exists(aside):
        system.delete(aside, True)
    if system.exists(old) and not system.rename(old, aside):
        raise OSError(f"{folder} could not be set aside")
    if not system.rename(new, old):
        system.rename(aside, old)
        raise OSError(f"{fresh} could not take the place of {folder}")
    system.delete(aside, True)


def recover(spark: SparkSession, folder: str) -> None:
    """Where a swap was interrupted, the folder that was set aside comes back; a swap that was made is tidied up."""
    (old, system), (aside, _) = _at(spark, folder), _at(spark, f"{folder}.before")
    if system.exists(aside):
        if system.exists(old):
            system.delete(aside, True)
        else:
            system.rename(aside, old)


def backup(df: DataFrame, folder: str, *, force: bool = False) -> None:
    """Write a table to a folder of its own, and read it back to compare; an existing one is kept unless ``force``."""
    spark = df.sparkSession
    path, system = _at(spark, folder)
    if system.exists(path) and not force:
        raise FileExistsError(f"{folder} exists")
    _verified_copy(df, f"{folder}.writing")
    swap_in(spark, f"{folder}.writing", folder)


def restore(spark: SparkSession, saved: str, folder: str, *, aside: str | None = None) -> str | None:
    """Put a copy of a backup in a table's place; the table that was there goes to ``aside``, whose name is returned.

    An existing table is refused without ``aside``. The copy is verified before anything moves, and where the last
    rename fails the old table comes back.
    """
    (source, system), (target, _) = _at(spark, saved), _at(spark, folder)
    if not system.exists(source):
        raise FileNotFoundError(f"there is no backup in {saved}")
    there = system.exists(target)
    if there and aside is None:
        raise FileExistsError(f"{folder} exists, and there is no place to keep it")
    _verified_copy(spark.read.parquet(saved), f"{folder}.restoring")
    fresh, old = _at(spark, f"{folder}.restoring")[0], _at(spark, aside)[0] if there else None
    if there and (system.exists(old) or not system.rename(target, old)):
        raise OSError(f"{folder} could not be set aside as {aside}")
    if not system.rename(fresh, target):
        if there:
            system.rename(old, target)
        raise OSError(f"{folder} could not be restored")
    return aside if there else None


def _verified_copy(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").parquet(folder)
    if fingerprint(df) != fingerprint(df.sparkSession.read.schema(df.schema).parquet(folder)):
        raise ValueError(f"the copy in {folder} differs from its source")
