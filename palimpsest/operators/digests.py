"""Session digests: first tasks, decisions and errors, touched paths and the outcome of each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S

VERSION = 4
TASKS, DECISIONS, ERRORS, PATHS, PATHS_EACH, OUTCOME = 8, 6, 5, 12, 3, 2


def signature() -> Column:
    """Version, number of messages, and the last one's identifier and time."""
    last = F.max(F.struct(F.coalesce("timestamp", F.lit("")).alias("at"), "id"))
    return F.concat_ws(":", F.lit(f"v{VERSION}"), F.count("*"), last["id"], last["at"])


def signatures(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(signature().alias("source_sig"))


def _first(flag: str, most: int, chars: int) -> Column:
    """The first rows with a flag, as (text, id)."""
    found = F.array_sort(F.collect_list(F.when(F.col(flag) & (F.col(f"nth_{flag}") <= most), F.struct("seq", "content", "id"))))
    return F.transform(found, lambda m: F.struct(S.clip(m["content"], chars).alias("text"), m["id"].alias("id")))


def build(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """One digest for each session that has messages."""
    order = Window.partitionBy("session_id").orderBy(F.col("timestamp").asc_nulls_first(), "id")
    back = Window.partitionBy("session_id").orderBy(F.col("timestamp").desc_nulls_last(), F.desc("id"))
    content = F.coalesce("content", F.lit(""))
    held = messages.withColumn("seq", F.row_number().over(order)).withColumn("prose", S.is_prose(F.col("role"), F.col("tool_name"), F.col("content")))
    held = (
        held.withColumn("task", F.col("prose") & (F.col("role") == "user") & (S.flattened(content) != ""))
        .withColumn("decision", F.col("prose") & content.rlike(S.DIGEST_DECISION))
        .withColumn("error", S.is_tool_text(content) & content.rlike(S.TOOL_ERROR))
    )
    for flag in ("task", "decision", "error"):
        held = held.withColumn(f"nth_{flag}", F.sum(F.col(flag).cast("int")).over(order))
    held = held.withColumn("nth_last", F.sum(F.col("prose").cast("int")).over(back))
    paths = F.slice(F.regexp_extract_all(content, F.lit(S.PATH), F.lit(0)), 1, PATHS_EACH)
    paths = F.filter(F.transform(paths, S.clean_path), lambda p: F.length(p).between(6, 120))
    ordered = F.array_sort(F.collect_list(F.when(F.size("paths") > 0, F.struct("seq", "paths"))))
    last = F.array_sort(F.collect_list(F.when(F.col("prose") & (F.col("nth_last") <= OUTCOME), F.struct("seq", "content"))))
    grouped = held.withColumn("paths", paths).groupBy("session_id").agg(
        _first("task", TASKS, 160).alias("tasks"), _first("decision", DECISIONS, 160).alias("decisions"), _first("error", ERRORS, 160).alias("errors"),
        F.flatten(F.transform(ordered, lambda p: p["paths"])).alias("found"), F.transform(last, lambda m: S.clip(m["content"], 200)).alias("last"),
        signature().alias("source_sig"),
    )
    s = sessions.select(F.col("id").alias("session_id"), "source", "host", "project_root", "cwd", "started_at", "ended_at", "message_count")
    joined = grouped.join(s, "session_id")
    own = F.filter(F.array(F.nullif("project_root", F.lit("")), F.nullif("cwd", F.lit(""))), lambda p: p.isNotNull())
    joined = joined.withColumn("paths", F.slice(F.array_distinct(F.concat(own, "found")), 1, PATHS)).withColumn("outcome", F.array_join("last", " ⋯ "))
    texts = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "\n")
    some = lambda c: F.nullif(c, F.lit(""))
    host = F.coalesce("host", F.lit("unknown"))
    digest = F.concat_ws("\n", *(some(texts(c)) for c in ("tasks", "decisions", "errors")), some(F.col("outcome")), some(F.array_join("paths", " ")), "source", host, some(F.col("project_root")))
    meta = F.struct("source", host.alias("host"), "project_root", F.col("message_count").alias("messages"), F.col("started_at").alias("from"), F.col("ended_at").alias("to"))
    return joined.select("session_id", F.lit("extractive").alias("kind"), "tasks", "decisions", "errors", "paths", "outcome", meta.alias("meta"), "source_sig", digest.alias("digest_text"))


def stale(messages: DataFrame, digests: DataFrame) -> DataFrame:
    """Sessions to digest: none yet, or changed; what an agent wrote stays."""
    held = digests.select("session_id", F.col("source_sig").alias("old"), "kind")
    fresh = signatures(messages).join(held, "session_id", "left")
    return fresh.filter(F.col("kind").isNull() | ((F.col("kind") != "agent") & (F.col("old") != F.col("source_sig")))).select("session_id")
