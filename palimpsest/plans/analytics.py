"""Aggregations over sessions, messages and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.functions.scalars import canonical_path, project_key, token_estimate
from palimpsest.sources.conversation_store import attachments, links, messages, model_sql, sessions
from palimpsest.storage import table

KEY_SQL = r"regexp_replace(lower(replace(project_root, '\', '/')), '/+$', '')"
LAST = "coalesce(ended_at, started_at)"


def _first(n: int, *order: Column | str, of: DataFrame) -> DataFrame:
    return of.orderBy(*order).limit(n)


@query("AGG-01_source_summary", model_sql("""
    SELECT source, count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages, min(started_at) AS first_at, max(ended_at) AS last_at
    FROM sessions GROUP BY source"""))
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("sessions"), F.sum("message_count").alias("messages"),
        F.min("started_at").alias("first_at"), F.max("ended_at").alias("last_at"),
    )


@query("AGG-02_host_summary", model_sql("""
    SELECT coalesce(host, 'unknown') AS host, count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages FROM sessions GROUP BY 1"""))
def host_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.coalesce("host", F.lit("unknown")).alias("host")
    return sessions(spark, sf_dir).groupBy(host).agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages"))


@query("AGG-03_totals", model_sql("""
    SELECT count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages, count(DISTINCT source) AS sources,
           count(DISTINCT coalesce(host, 'unknown')) AS hosts, min(started_at) AS first_at, max(ended_at) AS last_at FROM sessions"""))
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).agg(
        F.count("*").alias("sessions"), F.sum("message_count").alias("messages"), F.count_distinct("source").alias("sources"),
        F.count_distinct(F.coalesce("host", F.lit("unknown"))).alias("hosts"),
        F.min("started_at").alias("first_at"), F.max("ended_at").alias("last_at"),
    )


@query("AGG-04_host_source_project_rollup", model_sql("""
    SELECT host, source, project, CAST(grouping(host, source, project) AS BIGINT) AS level, count(*) AS sessions,
           CAST(sum(message_count) AS BIGINT) AS messages
    FROM (SELECT coalesce(host, 'unknown') AS host, source, coalesce(nullif(project_root, ''), '(none)') AS project, message_count FROM sessions)
    GROUP BY ROLLUP (host, source, project)"""))
def project_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(spark, sf_dir).select(
        F.coalesce("host", F.lit("unknown")).alias("host"), "source",
        F.coalesce(F.nullif("project_root", F.lit("")), F.lit("(none)")).alias("project"), "message_count",
    )
    return rows.rollup("host", "source", "project").agg(
        F.grouping_id().alias("level"), F.count("*").alias("sessions"), F.sum("message_count").alias("messages")
    )


@query("AGG-05_lane_tree", model_sql("""
    SELECT origin, host, source, count(*) AS sessions, bool_and(excluded) AS excluded
    FROM (SELECT coalesce(origin, 'local') AS origin, CASE WHEN origin = 'web' THEN '' ELSE coalesce(host, 'unknown') END AS host, source,
                 coalesce(origin, 'local') = 'web' AND source = 'agent0' OR source = 'agent3' AS excluded FROM sessions)
    GROUP BY GROUPING SETS ((origin), (origin, host), (origin, host, source))"""))
def lane_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.functions.scalars import in_any_lane

    lanes = [{"origin": "web", "source": "agent0"}, {"source": "agent3"}]
    rows = sessions(spark, sf_dir).withColumn("excluded", in_any_lane(lanes)).select(
        F.coalesce("origin", F.lit("local")).alias("origin"),
        F.when(F.col("origin") == "web", "").otherwise(F.coalesce("host", F.lit("unknown"))).alias("host"), "source", "excluded",
    )
    sets = [[F.col("origin")], [F.col("origin"), F.col("host")], [F.col("origin"), F.col("host"), F.col("source")]]
    return rows.groupingSets(sets, "origin", "host", "source").agg(F.count("*").alias("sessions"), F.bool_and("excluded").alias("excluded"))


@query("AGG-06_store_info", model_sql("""
    SELECT 'sessions' AS what, count(*) AS n FROM sessions UNION ALL SELECT 'messages', count(*) FROM messages
    UNION ALL SELECT 'attachments', count(*) FROM attachments UNION ALL SELECT 'links', count(*) FROM links
    UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'vectors', count(*) FROM embeddings
    UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'sessions:' || source, count(*) FROM sessions GROUP BY source"""))
def store_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda name, df: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    held = sessions(spark, sf_dir)
    parts = [count("sessions", held), count("messages", messages(spark, sf_dir)), count("attachments", attachments(spark, sf_dir)), count("links", links(spark, sf_dir))]
    parts += [count(n, table(spark, sf_dir, t)) for n, t in (("documents", "documents"), ("vectors", "embeddings"), ("pages", "pages"))]
    parts.append(held.groupBy(F.concat(F.lit("sessions:"), "source").alias("what")).agg(F.count("*").alias("n")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query("AGG-07_daily_activity", "SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("ts").cast("date").cast("string").alias("day")
    return table(spark, sf_dir, "events").groupBy(day).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


@query("AGG-07_daily_messages", model_sql("""
    SELECT left(timestamp, 10) AS day, count(*) AS messages FROM messages WHERE timestamp >= '2024-01-10' GROUP BY 1"""))
def daily_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).filter("timestamp >= '2024-01-10'").groupBy(F.left("timestamp", F.lit(10)).alias("day")).agg(F.count("*").alias("messages"))


@query("AGG-08_top_agents", model_sql("""
    SELECT source, CAST(sum(message_count) AS BIGINT) AS messages FROM sessions GROUP BY source ORDER BY messages DESC, source LIMIT 12"""))
def top_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = sessions(spark, sf_dir).groupBy("source").agg(F.sum("message_count").alias("messages"))
    return _first(12, F.desc("messages"), "source", of=held)


@query("AGG-09_monthly", model_sql(f"""
    SELECT left({LAST}, 7) AS month, count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages
    FROM sessions WHERE {LAST} <> '' GROUP BY 1"""))
def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.coalesce("ended_at", "started_at")
    return sessions(spark, sf_dir).filter(at != "").groupBy(F.left(at, F.lit(7)).alias("month")).agg(
        F.count("*").alias("sessions"), F.sum("message_count").alias("messages")
    )


@query("AGG-10_top_projects", model_sql("""
    SELECT coalesce(nullif(project_root, ''), '(no project)') AS project, count(*) AS sessions FROM sessions GROUP BY 1
    ORDER BY sessions DESC, project LIMIT 8"""))
def top_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.coalesce(F.nullif("project_root", F.lit("")), F.lit("(no project)")).alias("project")
    return _first(8, F.desc("sessions"), "project", of=sessions(spark, sf_dir).groupBy(name).agg(F.count("*").alias("sessions")))


@query("AGG-11_coverage", model_sql(rf"""
    SELECT coalesce(host, 'unknown') AS host, {KEY_SQL} AS path, count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages,
           count(DISTINCT source) AS agents, max({LAST}) AS last_seen
    FROM sessions GROUP BY 1, 2"""))
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).groupBy(F.coalesce("host", F.lit("unknown")).alias("host"), project_key(canonical_path(F.col("project_root"))).alias("path")).agg(
        F.count("*").alias("sessions"), F.sum("message_count").alias("messages"), F.count_distinct("source").alias("agents"),
        F.max(F.coalesce("ended_at", "started_at")).alias("last_seen"),
    )


@query("AGG-12_attachments_per_session", model_sql("""
    SELECT m.session_id, count(DISTINCT l.attachment_id) AS attachments FROM links l JOIN messages m ON l.message_id = m.id GROUP BY 1"""))
def attachments_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = links(spark, sf_dir).join(messages(spark, sf_dir).select(F.col("id").alias("message_id"), "session_id"), "message_id")
    return held.groupBy("session_id").agg(F.count_distinct("attachment_id").alias("attachments"))


_LIVE = "(SELECT DISTINCT attachment_id FROM links)"


@query("AGG-13_attachment_stats", model_sql(f"""
    SELECT (SELECT count(*) FROM attachments WHERE id IN {_LIVE}) AS live,
           (SELECT CAST(sum(DISTINCT bytes) AS BIGINT) FROM attachments WHERE id IN {_LIVE}) AS distinct_bytes,
           (SELECT count(*) FROM attachments WHERE id NOT IN {_LIVE}) AS orphans,
           (SELECT count(*) FROM links WHERE attachment_id NOT IN (SELECT id FROM attachments)) AS orphan_links"""))
def attachment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the reference's sum over distinct sizes; AGG-13_attachment_bytes sums every attachment."""
    held, used = attachments(spark, sf_dir), links(spark, sf_dir)
    ids = used.select(F.col("attachment_id").alias("id")).distinct().withColumn("linked", F.lit(True))
    live = F.coalesce("linked", F.lit(False))
    stats = held.join(ids, "id", "left").agg(
        F.count_if(live).alias("live"), F.sum_distinct(F.when(live, F.col("bytes"))).alias("distinct_bytes"), F.count_if(~live).alias("orphans")
    )
    lost = used.join(held, used["attachment_id"] == held["id"], "left_anti").agg(F.count("*").alias("orphan_links"))
    return stats.crossJoin(lost)  # two rows of one


@query("AGG-13_attachment_bytes", model_sql(f"SELECT kind, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM attachments WHERE id IN {_LIVE} GROUP BY kind"))
def attachment_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = attachments(spark, sf_dir)
    live = held.join(links(spark, sf_dir), F.col("id") == F.col("attachment_id"), "left_semi")
    return live.groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("AGG-14_session_maintenance", model_sql("""
    SELECT session_id, count(*) AS n, min(timestamp) AS started_at, max(timestamp) AS ended_at FROM messages
    WHERE tool_name IS NULL GROUP BY session_id"""))
def session_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.store import session_spans

    return session_spans(messages(spark, sf_dir).filter("tool_name is null"))


@query("AGG-15_sync_progress", model_sql("""
    SELECT count(*) FILTER (WHERE id <= 50000) AS synced, count(*) AS total, count(*) FILTER (WHERE id > 50000) AS pending,
           CASE WHEN count(*) = 0 THEN 100.0 ELSE round(100.0 * count(*) FILTER (WHERE id <= 50000) / count(*), 1) END AS percent,
           max(timestamp) AS newest FROM messages"""))
def sync_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync_state(messages(spark, sf_dir), 50_000)


def sync_state(held: DataFrame, watermark: int) -> DataFrame:
    done = F.count_if(F.col("id") <= watermark)
    percent = F.when(F.count("*") == 0, 100.0).otherwise(F.round(F.lit(100.0) * done / F.count("*"), 1))
    return held.agg(
        done.alias("synced"), F.count("*").alias("total"), F.count_if(F.col("id") > watermark).alias("pending"),
        percent.alias("percent"), F.max("timestamp").alias("newest"),
    )


@query("AGG-16_token_estimate", model_sql("SELECT session_id, CAST(round(sum(length(content)) / 4) AS BIGINT) AS tokens FROM messages GROUP BY session_id"))
def tokens_of_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy("session_id").agg(F.round(F.sum(F.length("content")) / 4).cast("long").alias("tokens"))


@query("PRJ-05_token_estimate", model_sql("SELECT id, CAST(round(length(content) / 4) AS BIGINT) AS tokens, CAST(ceil(length(content) / 4) AS BIGINT) AS ceiling FROM messages"))
def tokens_of_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", token_estimate(F.col("content")).alias("tokens"), F.ceil(F.length("content") / 4).alias("ceiling"))


_SCOPE = "content <> '' AND (tool_name IS NULL OR tool_name IN ('tool0', 'tool1'))"


@query("AGG-17_vector_coverage", model_sql(f"""
    SELECT count(*) FILTER (WHERE in_scope) AS in_scope, count(*) FILTER (WHERE in_scope AND has) AS embedded,
           count(*) FILTER (WHERE in_scope AND NOT has) AS remaining, count(*) FILTER (WHERE NOT in_scope AND has) AS out_of_scope
    FROM (SELECT {_SCOPE} AS in_scope, id IN (SELECT vec_id * 250 + vec_id % 6 FROM embeddings) AS has FROM messages)"""))
def vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.vectors import embeddable

    ids = table(spark, sf_dir, "embeddings").selectExpr("vec_id * 250 + vec_id % 6 as id").distinct().withColumn("vector", F.lit(True))
    held = messages(spark, sf_dir).select("id", embeddable(["tool0", "tool1"]).alias("in_scope")).join(ids, "id", "left")
    has = F.coalesce("vector", F.lit(False))
    return held.agg(
        F.count_if("in_scope").alias("in_scope"), F.count_if(F.col("in_scope") & has).alias("embedded"),
        F.count_if(F.col("in_scope") & ~has).alias("remaining"), F.count_if(~F.col("in_scope") & has).alias("out_of_scope"),
    )


@query("AGG-18_split_projects", model_sql(rf"""
    SELECT key, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS sessions, arg_max(project_root, (n, project_root)) AS lead
    FROM (SELECT {KEY_SQL} AS key, project_root, count(*) AS n FROM sessions WHERE project_root <> '' GROUP BY ALL)
    GROUP BY key HAVING count(*) >= 2"""))
def split_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.store import spellings

    return spellings(sessions(spark, sf_dir))


@query("AGG-19_prior_context", model_sql(rf"""
    SELECT count(DISTINCT s.id) AS sessions, CAST(sum(length(m.content)) AS BIGINT) AS chars
    FROM messages m JOIN sessions s ON m.session_id = s.id WHERE {KEY_SQL} = '/p/3'"""))
def prior_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = sessions(spark, sf_dir).filter(project_key(F.col("project_root")) == "/p/3").select(F.col("id").alias("session_id"))
    return messages(spark, sf_dir).join(wanted, "session_id").agg(
        F.count_distinct("session_id").alias("sessions"), F.sum(F.length("content")).alias("chars")
    )


_TOKENS_SQL = r"""tokens AS (
    SELECT id AS doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda t: t <> ''))) AS token FROM messages)"""


@query("AGG-21_document_frequency", model_sql("SELECT token, count(*) AS df FROM tokens GROUP BY token", _TOKENS_SQL))
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.functions.scalars import tokens

    words = F.explode(F.array_distinct(tokens(F.col("content")))).alias("token")
    return messages(spark, sf_dir).select(words).groupBy("token").agg(F.count("*").alias("df"))


@query("AGG-22_feedback_counts", model_sql("""
    SELECT token, count(*) AS docs FROM tokens WHERE length(token) BETWEEN 3 AND 40 GROUP BY token HAVING count(*) >= 2""", _TOKENS_SQL))
def feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that two messages at least hold."""
    from palimpsest.functions.scalars import tokens

    words = F.explode(F.array_distinct(tokens(F.col("content")))).alias("token")
    held = messages(spark, sf_dir).select(words).filter(F.length("token").between(3, 40))
    return held.groupBy("token").agg(F.count("*").alias("docs")).filter("docs >= 2")


@query("AGG-25_ledger", model_sql("""
    SELECT coalesce(kind, '(all)') AS kind, CAST(sum(baseline) AS BIGINT) AS baseline, CAST(sum(actual) AS BIGINT) AS actual,
           CAST(sum(baseline) - sum(actual) AS BIGINT) AS saved,
           CASE WHEN sum(baseline) > 0 THEN round(100.0 * (sum(baseline) - sum(actual)) / sum(baseline), 1) ELSE 0 END AS pct
    FROM (SELECT coalesce(tool_name, 'prose') AS kind, length(content) AS baseline, least(length(content), 200) AS actual FROM messages)
    GROUP BY ROLLUP (kind)"""))
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select(
        F.coalesce("tool_name", F.lit("prose")).alias("kind"), F.length("content").cast("long").alias("baseline"),
        F.least(F.length("content"), F.lit(200)).cast("long").alias("actual"),
    )
    sums = rows.rollup("kind").agg(F.sum("baseline").alias("baseline"), F.sum("actual").alias("actual"))
    saved = F.col("baseline") - F.col("actual")
    pct = F.when(F.col("baseline") > 0, F.round(F.lit(100.0) * saved / F.col("baseline"), 1)).otherwise(0.0)
    return sums.select(F.coalesce("kind", F.lit("(all)")).alias("kind"), "baseline", "actual", saved.alias("saved"), pct.alias("pct"))


@query("AGG-26_archive_groups", """
    SELECT sha256(text) AS sha256, count(*) AS refs, max(doc_id) AS newest, bool_or(doc_id % 50 = 0) AS pinned,
           max(octet_length(encode(text))) AS bytes FROM documents GROUP BY 1""")
def archive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(
        F.count("*").alias("refs"), F.max("doc_id").alias("newest"), F.bool_or(F.col("doc_id") % 50 == 0).alias("pinned"),
        F.max(F.octet_length("text")).cast("long").alias("bytes"),
    )


@query("AGG-28_connections", model_sql("""
    SELECT s.source, coalesce(s.origin, 'local') AS origin, count(m.id) AS messages, count(DISTINCT s.id) AS sessions
    FROM sessions s LEFT JOIN messages m ON m.session_id = s.id AND m.tool_name IS NOT NULL GROUP BY 1, 2"""))
def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = messages(spark, sf_dir).filter("tool_name is not null").select(F.col("session_id").alias("id"), F.col("id").alias("message"))
    held = sessions(spark, sf_dir).join(tools, "id", "left")
    return held.groupBy("source", F.coalesce("origin", F.lit("local")).alias("origin")).agg(
        F.count("message").alias("messages"), F.count_distinct("id").alias("sessions")
    )
