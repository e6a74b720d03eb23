"""Writes as plans: upserts, additive merges, forgetting and repair over DataFrames of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scalars import project_key, redact


def session_spans(messages: DataFrame) -> DataFrame:
    """Count and first and last time of every session that has messages."""
    return messages.groupBy("session_id").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at")
    )


def spellings(sessions: DataFrame) -> DataFrame:
    """Projects whose path is spelled in two ways or more; the spelling with most sessions leads."""
    each = sessions.filter("project_root <> ''").groupBy(project_key(F.col("project_root")).alias("key"), "project_root").agg(F.count("*").alias("n"))
    lead = F.max_by("project_root", F.struct("n", "project_root")).alias("lead")
    return each.groupBy("key").agg(F.count("*").alias("spellings"), F.sum("n").alias("sessions"), lead).filter("spellings >= 2")


def upsert_sessions(held: DataFrame, batch: DataFrame) -> DataFrame:
    """Sessions after a batch: new values win; cwd and title stay where the new ones are null, the project where it is pinned."""
    old, new = held.alias("o"), batch.alias("n")
    joined = old.join(new, F.col("o.id") == F.col("n.id"), "full_outer")
    known, fresh = F.col("o.id").isNotNull(), F.col("n.id").isNotNull()
    pick = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    keep = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    pinned = known & F.col("o.project_pinned")
    return joined.select(
        F.coalesce("n.id", "o.id").alias("id"), pick("source").alias("source"), pick("origin").alias("origin"), pick("host").alias("host"),
        F.when(pinned, F.col("o.project_root")).otherwise(pick("project_root")).alias("project_root"),
        F.coalesce("o.project_pinned", "n.project_pinned").alias("project_pinned"), keep("cwd").alias("cwd"), keep("title").alias("title"),
    )


def same_content(a: str, b: str) -> Column:
    """Messages without uuid are the same where session, role, time and content are, nulls included."""
    same = F.col(f"{a}.session_id") == F.col(f"{b}.session_id")
    for c in ("role", "timestamp", "content"):
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same


def new_messages(held: DataFrame, batch: DataFrame, *, by_content: bool) -> DataFrame:
    """Rows of the batch that an additive write takes: by (session, uuid), and without a uuid all, or by content."""
    named = batch.filter("uuid is not null").dropDuplicates(["session_id", "uuid"])
    named = named.join(held.filter("uuid is not null").select("session_id", "uuid"), ["session_id", "uuid"], "left_anti").select(batch.columns)
    loose = batch.filter("uuid is null")
    if by_content:
        loose = loose.dropDuplicates(["session_id", "role", "timestamp", "content"]).alias("b")
        loose = loose.join(held.filter("uuid is null").alias("h"), same_content("b", "h"), "left_anti")
    return named.unionByName(loose)


def insert_messages(held: DataFrame, batch: DataFrame) -> DataFrame:
    """The store's messages after a batch, redacted on the way in."""
    return held.unionByName(new_messages(held, batch, by_content=False).withColumn("content", redact(F.col("content"))))


def replace_sessions(held: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's sessions replaced as a whole."""
    return held.join(batch.select("session_id").distinct(), "session_id", "left_anti").select(held.columns).unionByName(batch)


def merge_stores(held: DataFrame, bundle: DataFrame) -> DataFrame:
    """Additive merge: merging the same bundle again adds nothing."""
    return held.unionByName(new_messages(held, bundle, by_content=True))


def delta(messages: DataFrame, sessions: DataFrame, watermark: int, excluded: Column) -> tuple[DataFrame, DataFrame]:
    """Messages above the watermark outside the excluded lanes, and their sessions."""
    wanted = sessions.filter(~excluded)
    rows = messages.filter(F.col("id") > watermark).join(wanted.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return rows, wanted.join(rows, wanted["id"] == rows["session_id"], "left_semi")


def count_gaps(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions that say to have more messages than there are."""
    held = messages.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("actual"))
    gap = (F.col("message_count") - F.coalesce("actual", F.lit(0))).alias("gap")
    return sessions.join(held, "id", "left").select("id", "message_count", F.coalesce("actual", F.lit(0)).alias("actual"), gap).filter("gap > 0")


def reopened(offsets: DataFrame, sessions: DataFrame, messages: DataFrame, *, everything: bool = False) -> DataFrame:
    """Offsets (file_path, session_id, last_line, parser) with the files of sessions that lack messages to be read from their start.

    Reading them again is harmless: what is known adds nothing. ``everything`` reopens all files, where counts can't be trusted either.
    """
    if everything:
        return offsets.withColumn("last_line", F.lit(0).cast("long"))
    gaps = count_gaps(sessions, messages).select(F.col("id").alias("session_id"), F.lit(True).alias("gap"))
    held = offsets.join(gaps, "session_id", "left")
    return held.withColumn("last_line", F.when(F.col("gap"), F.lit(0).cast("long")).otherwise(F.col("last_line"))).select(offsets.columns)


def reconciled(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with the number of messages that there are."""
    actual = messages.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("actual"))
    held = sessions.join(actual, "id", "left").withColumn("message_count", F.coalesce("actual", F.lit(0).cast("long")))
    return held.select(sessions.columns)


def forget_selector(
    *, session: str | None = None, project: str | None = None, source: str | None = None, before: str | None = None, message: int | None = None
) -> Column:
    """Rows of messages joined to sessions (as s) that all given parts select; refuses to select everything."""
    parts = []
    if session is not None:
        parts.append(F.col("session_id") == session)
    if project is not None:
        parts.append(project_key(F.col("s.project_root")) == project_key(F.lit(project)))
    if source is not None:
        parts.append(F.col("s.source") == source)
    if before is not None:
        parts.append(F.coalesce("timestamp", "s.ended_at", "s.started_at", F.lit("")) < before)
    if message is not None:
        parts.append(F.col("m.id") == message)
    if not parts:
        raise ValueError("an empty selector would forget everything")
    out = parts[0]
    for more in parts[1:]:
        out = out & more
    return out


def forgotten(messages: DataFrame, sessions: DataFrame, selector: Column) -> DataFrame:
    """The messages that a selector forgets."""
    joined = messages.alias("m").join(sessions.alias("s"), F.col("m.session_id") == F.col("s.id"))
    return joined.filter(selector).select("m.*")


def pending_files(offsets: DataFrame, lines: DataFrame, parser: str) -> DataFrame:
    """(file_path, start, last_line, parser) for each file of (file_path, line_no, complete): where reading goes on.

    ``offsets`` has (file_path, last_line, parser). A file is read on from its offset; one that has shrunk, or that
    another parser has read, from its first line. A last line that is not complete is left for the next time.
    """
    found = lines.groupBy("file_path").agg(F.count_if("complete").alias("last_line"))
    held = offsets.select("file_path", F.col("last_line").alias("held_line"), F.col("parser").alias("held_parser"))
    anew = F.col("held_line").isNull() | (F.col("held_parser") != parser) | (F.col("last_line") < F.col("held_line"))
    start = F.when(anew, F.lit(0)).otherwise(F.col("held_line")).cast("long")
    return found.join(held, "file_path", "left").select("file_path", start.alias("start"), "last_line", F.lit(parser).alias("parser"))


def pending_lines(pending: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines that are to be read; unchanged files have none."""
    ahead = pending.filter("last_line > start").select("file_path", "start")
    return lines.join(ahead, "file_path").filter(F.col("complete") & (F.col("line_no") >= F.col("start"))).select(lines.columns)


def upsert_offsets(offsets: DataFrame, pending: DataFrame) -> DataFrame:
    """The offsets after reading; those of files that were not there stay."""
    return offsets.join(pending, "file_path", "left_anti").unionByName(pending.select("file_path", "last_line", "parser"))


def advance(watermarks: DataFrame, exported: DataFrame) -> DataFrame:
    """(bundle, last_message_id) after an export: a watermark never goes back."""
    return watermarks.unionByName(exported).groupBy("bundle").agg(F.max("last_message_id").alias("last_message_id"))
