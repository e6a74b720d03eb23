"""The memory model (sessions, messages, attachments, digest inputs) over the ``conversations`` table.

Identifiers, lanes, spellings and times follow from conversation and turn by
integer arithmetic, so that ``MODEL_SQL`` says the same in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import table

HOURS_APART = 17

MODEL_SQL = """
messages AS (
    SELECT conv_id * 1000 + turn AS id, 's' || conv_id AS session_id, conv_id, turn,
           CASE WHEN (conv_id * 1000 + turn) % 11 = 0 THEN NULL ELSE 'u' || (conv_id * 1000 + turn) END AS uuid,
           CASE WHEN turn % 5 = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN turn % 5 = 4 THEN '[tool_result] ' || text ELSE text END AS content,
           CASE WHEN turn % 5 = 4 THEN 'tool' || (conv_id % 3) END AS tool_name,
           CAST(DATE '2024-01-01' + CAST((conv_id * 17) // 24 AS INTEGER) AS VARCHAR) || 'T'
               || lpad(CAST((conv_id * 17) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ':00Z' AS timestamp
    FROM conversations),
sessions AS (
    SELECT session_id AS id, 'agent' || (conv_id % 5) AS source,
           CASE WHEN conv_id % 4 = 0 THEN 'web' WHEN conv_id % 9 = 0 THEN NULL ELSE 'local' END AS origin,
           CASE WHEN conv_id % 10 = 3 THEN NULL ELSE 'host' || (conv_id % 3) END AS host,
           CASE WHEN conv_id % 19 = 18 THEN '' WHEN conv_id % 2 = 0 THEN '/p/' || (conv_id % 7) ELSE '\\P\\' || (conv_id % 7) || '\\' END AS project_root,
           conv_id % 13 = 0 AS project_pinned, conv_id % 17 = 0 AS pinned,
           '/p/' || (conv_id % 7) || '/src' AS cwd, left(min_by(content, turn), 40) AS title,
           min(timestamp) AS started_at, CASE WHEN conv_id % 23 = 5 THEN NULL ELSE max(timestamp) END AS ended_at, count(*) AS message_count
    FROM messages GROUP BY session_id, conv_id),
links AS (
    SELECT id AS message_id, (id * 7) % 97 AS attachment_id, 'f' || (id % 5) || '.png' AS name FROM messages WHERE id % 6 = 0
    UNION ALL SELECT id, (id * 5) % 89 + 200, 'g' || (id % 3) || '.txt' FROM messages WHERE id % 14 = 0),
attachments AS (
    SELECT attachment_id AS id, sha256(CAST(attachment_id AS VARCHAR)) AS sha256, (attachment_id % 10) * 100 AS bytes,
           CASE WHEN attachment_id % 4 = 0 THEN 'ref' ELSE 'blob' END AS kind
    FROM (SELECT DISTINCT attachment_id FROM links)
    UNION ALL SELECT 1000 + i, sha256(CAST(1000 + i AS VARCHAR)), 50, 'text' FROM range(5) t(i))
"""


def model_sql(select: str, *ctes: str) -> str:
    """DuckDB SQL over the model's tables; ``ctes`` are further ones."""
    return "WITH RECURSIVE " + ", ".join([MODEL_SQL.strip(), *ctes]) + " " + select


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    tool = turn % 5 == 4
    hours = conv * HOURS_APART
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.expr(f"cast((conv_id * {HOURS_APART}) div 24 as int)")).cast("string")
    return table(spark, sf_dir, "conversations").select(
        (conv * 1000 + turn).alias("id"), F.concat(F.lit("s"), conv).alias("session_id"), "conv_id", "turn",
        F.when((conv * 1000 + turn) % 11 != 0, F.concat(F.lit("u"), conv * 1000 + turn)).alias("uuid"),
        F.when(tool, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(tool, F.concat(F.lit("[tool_result] "), "text")).otherwise(F.col("text")).alias("content"),
        F.when(tool, F.concat(F.lit("tool"), conv % 3)).alias("tool_name"),
        F.concat(day, F.lit("T"), _two(hours % 24), F.lit(":"), _two(turn % 60), F.lit(":00Z")).alias("timestamp"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    seven = conv % 7
    spans = messages(spark, sf_dir).groupBy("session_id", "conv_id").agg(
        F.min_by("content", "turn").alias("first"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.count("*").alias("n")
    )
    return spans.select(
        F.col("session_id").alias("id"), F.concat(F.lit("agent"), conv % 5).alias("source"),
        F.when(conv % 4 == 0, "web").when(conv % 9 != 0, "local").alias("origin"),
        F.when(conv % 10 != 3, F.concat(F.lit("host"), conv % 3)).alias("host"),
        F.when(conv % 19 == 18, "").when(conv % 2 == 0, F.concat(F.lit("/p/"), seven))
        .otherwise(F.concat(F.lit("\\P\\"), seven, F.lit("\\"))).alias("project_root"),
        (conv % 13 == 0).alias("project_pinned"), (conv % 17 == 0).alias("pinned"),
        F.concat(F.lit("/p/"), seven, F.lit("/src")).alias("cwd"), F.left("first", F.lit(40)).alias("title"),
        F.col("lo").alias("started_at"), F.when(conv % 23 != 5, F.col("hi")).alias("ended_at"), F.col("n").alias("message_count"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = messages(spark, sf_dir).select("id")
    images = ids.filter("id % 6 = 0").selectExpr("id as message_id", "(id * 7) % 97 as attachment_id", "concat('f', id % 5, '.png') as name")
    texts = ids.filter("id % 14 = 0").selectExpr("id as message_id", "(id * 5) % 89 + 200 as attachment_id", "concat('g', id % 3, '.txt') as name")
    return images.unionByName(texts)


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = links(spark, sf_dir).select(F.col("attachment_id").alias("id")).distinct()
    sha = F.sha2(F.col("id").cast("string"), 256).alias("sha256")
    linked = used.select("id", sha, (F.col("id") % 10 * 100).alias("bytes"), F.when(F.col("id") % 4 == 0, "ref").otherwise("blob").alias("kind"))
    loose = spark.range(1000, 1005).select("id", sha, F.lit(50).cast("long").alias("bytes"), F.lit("text").alias("kind"))
    return linked.unionByName(loose)
