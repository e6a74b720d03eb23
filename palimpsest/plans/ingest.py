"""Transcript sources: raw records are made of ``conversations`` and read back by the adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.sources import transcripts as T
from palimpsest.storage import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("f"), c).alias("path"), (t + 1).alias("line_no"), F.concat(F.lit("u"), c, F.lit("-"), t).alias("uuid"), "role", "text", "turn", "conv_id"
    )


def log_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of log A: plain strings, block lists with a tool call, a title at turn 3 and a broken line at turn 6."""
    call = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.lit("grep").alias("name"), F.struct(F.col("turn").alias("q")).alias("input")))
    text = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    blocks = F.concat(F.lit("["), text, F.lit(","), call, F.lit("]"))
    quoted = F.regexp_replace(F.to_json(F.struct("text")), F.lit(r'^\{"text":|\}$'), F.lit(""))
    message = F.concat(F.lit('{"type":"'), "role", F.lit('","uuid":"'), "uuid", F.lit('","timestamp":"2024-01-01T00:00:00Z","message":{"role":"'), "role",
                       F.lit('","content":'), F.when(F.col("turn") % 2 == 1, blocks).otherwise(quoted), F.lit("}}"))
    title = F.concat(F.lit('{"type":"custom-title","customTitle":"title '), "conv_id", F.lit('"}'))
    value = F.when(F.col("turn") == 3, title).when(F.col("turn") == 6, "{broken").otherwise(message)
    return _turns(spark, sf_dir).select("path", "line_no", value.alias("value"))


@query("SRC-03_append_log_a", """
    SELECT 'f' || conv_id AS session_id, CASE WHEN turn = 3 THEN 'title' ELSE role END AS role, CASE WHEN turn = 3 THEN NULL ELSE 'u' || conv_id || '-' || turn END AS uuid,
           CASE WHEN turn = 3 THEN 'title ' || conv_id WHEN turn % 2 = 1 THEN trim(text || chr(10) || '[tool_use:grep] {"q":' || turn || '}') ELSE trim(text) END AS content,
           CASE WHEN turn % 2 = 1 AND turn <> 3 THEN 'grep' END AS tool_name
    FROM conversations WHERE turn <> 6 AND (role IN ('user', 'assistant') OR turn = 3)""")
def append_log_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.append_log_a(log_a(spark, sf_dir)).select("session_id", "role", "uuid", "content", "tool_name")


@query("SRC-04_append_log_b", """
    SELECT 'f' || conv_id AS session_id, 'u' || conv_id || '-' || turn AS uuid, role, trim(text) || CASE WHEN turn % 2 = 1 THEN chr(10) || '[input_file]' ELSE '' END AS content
    FROM conversations WHERE role IN ('user', 'assistant')""")
def append_log_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "struct<type:string,text:string>"
    parts = F.array(F.struct(F.lit("text").alias("type"), F.trim("text").alias("text")).cast(kind))
    parts = F.when(F.col("turn") % 2 == 1, F.concat(parts, F.array(F.struct(F.lit("input_file").alias("type"), F.lit(None).cast("string").alias("text")).cast(kind)))).otherwise(parts)
    payload = F.struct(F.lit("message").alias("type"), F.col("uuid").alias("id"), "role", parts.alias("content"))
    lines = _turns(spark, sf_dir).select("path", "line_no", F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload"))).alias("value"))
    return T.append_log_b(lines).select("session_id", "uuid", "role", "content")


_WHOLE = "SELECT 'f' || conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS seq, role, trim(text) AS content FROM conversations"


def _grouped(spark: SparkSession, sf_dir: str, item) -> DataFrame:
    """(path, items): each conversation's turns in order as structs."""
    held = _turns(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "uuid"))).alias("turns"))
    return held.select("path", F.transform("turns", item).alias("items"))


@query("SRC-05_whole_history", f"SELECT * FROM ({_WHOLE}) WHERE role IN ('user', 'assistant')")
def whole_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _grouped(spark, sf_dir, lambda t, i: F.struct(F.struct(t["role"].alias("role"), t["text"].alias("content")).alias("message")))
    files = items.select("path", F.to_json(F.struct(F.col("items").alias("history"))).alias("value"), F.lit("2024-01-01T00:00:00Z").alias("modified"))
    return T.whole_history(files).select("session_id", "seq", "role", "content")


@query("SRC-06_versioned", f"SELECT * FROM ({_WHOLE})")
def versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second version is the selected one; every third message has its text in a step."""
    part = lambda t: F.array(F.struct(F.lit("text").alias("type"), t.alias("text")))

    def item(t, i):
        old = F.struct(t["role"].alias("role"), part(F.lit("old")).alias("content"), F.array(F.struct(part(F.lit("old")).alias("content"))).alias("steps"))
        empty = i % 3 == 2
        new = F.struct(t["role"].alias("role"), part(F.when(~empty, t["text"]).otherwise("")).alias("content"), F.array(F.struct(part(t["text"]).alias("content"))).alias("steps"))
        return F.struct(F.lit(1).alias("currentlySelected"), F.array(old, new).alias("versions"))

    files = _grouped(spark, sf_dir, item).select("path", F.to_json(F.struct(F.col("items").alias("messages"))).alias("value"), F.lit("2024-01-01T00:00:00Z").alias("modified"))
    return T.versioned(files).select("session_id", "seq", "role", "content")


@query("SRC-07_conversation_tree", """
    SELECT 'f' || conv_id AS session_id, 'n' || turn AS uuid, role, trim(text) AS content, '2024-01-01T00:0' || turn || ':00Z' AS timestamp FROM conversations WHERE role IN ('user', 'assistant') AND turn <= 7""")
def conversation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn follows the one before; a side branch hangs off the first."""
    turns = _turns(spark, sf_dir).filter("turn <= 7").groupBy("path").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"), F.max("turn").alias("last"), F.min("turn").alias("first"))

    def node(key, parent, role, text, turn):
        message = F.struct(F.struct(role.alias("role")).alias("author"), (F.lit(1704067200.0) + turn * 60).alias("create_time"), F.struct(F.array(text).alias("parts")).alias("content"))
        return F.struct(key.alias("key"), F.struct(parent.alias("parent"), message.alias("message")).alias("value"))

    main = F.transform("turns", lambda t: node(F.concat(F.lit("n"), t["turn"]), F.when(t["turn"] > F.col("first"), F.concat(F.lit("n"), t["turn"] - 1)), t["role"], t["text"], t["turn"]))
    side = F.array(node(F.lit("x"), F.lit("n0"), F.lit("user"), F.lit("abandoned"), F.lit(9).cast("long")))
    doc = F.struct(F.col("path").alias("conversation_id"), F.concat(F.lit("n"), "last").alias("current_node"), F.map_from_entries(F.concat(main, side)).alias("mapping"))
    return T.conversation_tree(turns.select(F.to_json(doc).alias("value"))).select("session_id", "uuid", "role", "content", "timestamp")


@query("SRC-08_message_list", """
    SELECT 'f' || conv_id AS session_id, role, CASE WHEN turn % 2 = 1 THEN trim(text || chr(10) || '[tool_result]' || chr(10) || 'ok') ELSE text END AS content FROM conversations""")
def message_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "struct<type:string,text:string,content:string>"
    block = lambda k, text, content: F.struct(F.lit(k).alias("type"), text.alias("text"), content.alias("content")).cast(kind)
    none = F.lit(None).cast("string")

    def item(t, i):
        blocks = F.when(t["turn"] % 2 == 1, F.array(block("text", t["text"], none), block("tool_result", none, F.lit("ok")))).otherwise(F.array().cast(f"array<{kind}>"))
        return F.struct(t["uuid"].alias("uuid"), F.when(t["role"] == "user", "human").otherwise(t["role"]).alias("sender"), t["text"].alias("text"), blocks.alias("content"))

    docs = _grouped(spark, sf_dir, item).select(F.to_json(F.struct(F.col("path").alias("uuid"), F.col("items").alias("chat_messages"))).alias("value"))
    return T.message_list(docs).select("session_id", "role", "content")


@query("SRC-09_event_log", "SELECT 'f' || conv_id AS session_id, 'u' || conv_id || '-' || turn AS uuid, role, trim(text) AS content FROM conversations WHERE role IN ('user', 'assistant')")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    def item(t, i):
        payload = F.struct(t["uuid"].alias("uuid"), F.struct(t["role"].alias("role"), t["text"].alias("content")).alias("message"))
        return F.struct(i.cast("string").alias("event_id"), t["role"].alias("event_type"), payload.alias("payload"))

    docs = _grouped(spark, sf_dir, item).select(F.to_json(F.struct(F.col("path").alias("id"), F.col("items").alias("events"))).alias("value"))
    return T.event_log(docs).select("session_id", "uuid", "role", "content")


@query("SRC-10_project_names", "SELECT conv_id, CASE WHEN conv_id % 7 < 5 THEN 'Project ' || conv_id % 7 ELSE 'p' || conv_id % 7 END AS project FROM (SELECT DISTINCT conv_id FROM conversations)")
def project_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from a side file, joined while parsing; unknown ones keep their identifier."""
    names = spark.createDataFrame([(f"p{i}", f"Project {i}") for i in range(5)], "project string, name string")
    held = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("p"), F.col("conv_id") % 7).alias("project")).distinct()
    return held.join(F.broadcast(names), "project", "left").select("conv_id", F.coalesce("name", "project").alias("project"))  # five rows


@query("SRC-11_attachments", """
    SELECT page_id AS owner, CASE WHEN page_id % 5 = 0 THEN sha256('asset:file-' || page_id) ELSE sha256(html) END AS sha256,
           CASE WHEN page_id % 5 = 0 THEN 0 ELSE octet_length(encode(html)) END AS bytes, CASE WHEN page_id % 5 = 0 THEN 'ref' ELSE 'blob' END AS kind FROM pages""")
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pointer = F.col("page_id") % 5 == 0
    blocks = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("owner"), F.lit("text/html").alias("mime"), F.when(~pointer, F.base64(F.col("html").cast("binary"))).alias("base64"),
        F.when(pointer, F.concat(F.lit("file-"), "page_id")).alias("pointer"),
    )
    return T.decoded_attachments(blocks).select("owner", "sha256", "bytes", "kind")


_FILES = "files AS (SELECT '/home/U' || (o_custkey % 90) || CASE WHEN o_orderkey % 11 = 0 THEN '/node_modules/x' ELSE '/store' END || '/' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.jsonl' WHEN 1 THEN '.json' ELSE '.txt' END AS path, o_custkey % 90 AS u, o_orderkey AS k FROM orders)"


@query("SRC-02_deep_discovery", f"WITH {_FILES} SELECT '/home/u' || u || '/store' AS root, count(*) AS files FROM files WHERE k % 11 <> 0 AND k % 3 <> 2 GROUP BY 1 HAVING count(*) >= 3")
def deep_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.store_folders(_found(spark, sf_dir))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    end = F.when(k % 3 == 0, ".jsonl").when(k % 3 == 1, ".json").otherwise(".txt")
    path = F.concat(F.lit("/home/U"), F.col("o_custkey") % 90, F.when(k % 11 == 0, "/node_modules/x").otherwise("/store"), F.lit("/"), k, end)
    return table(spark, sf_dir, "orders").select(path.alias("path"))


@query("SRC-01_fast_discovery", f"""WITH {_FILES}
    SELECT 'log' AS source, '/home/U' || u || '/store' AS root, count(*) AS files FROM files WHERE k % 11 <> 0 AND k % 3 <> 2 AND u < 5 GROUP BY u
    UNION ALL SELECT 'web', '/home/U7/store', count(*) FROM files WHERE k % 11 <> 0 AND k % 3 <> 2 AND u = 7 HAVING count(*) > 0
    UNION ALL SELECT 'old', '/home/U9', count(*) FROM files WHERE k % 3 <> 2 AND u = 9 HAVING count(*) > 0""")
def fast_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures below five roots, an import folder of a web source, and stores from before, one of them known already."""
    adapters = [("log", "store", False), ("web", "captured/store", True)]
    known = [("old", "/home/u3/STORE"), ("old", "/home/U9"), ("old", "/home/U9/store")]
    return T.known_stores(_found(spark, sf_dir), adapters, [f"/home/U{u}" for u in range(5)], "/home/U7", known)


@query("SRC-16_late_titles", "SELECT 'f' || conv_id AS path, 'title ' || conv_id AS title FROM conversations WHERE turn = 3")
def late_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.late_titles(log_a(spark, sf_dir))


@query("SRC-17_context_usage", """
    SELECT 'f' || conv_id AS path, max_by(length(text) + 500 + turn, turn) AS tokens, round(max_by(length(text) + 500 + turn, turn) * 100.0 / 200000, 1) AS percent FROM conversations GROUP BY conv_id""")
def context_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = F.struct(F.length("text").alias("input_tokens"), F.lit(500).alias("cache_read_input_tokens"), F.col("turn").alias("cache_creation_input_tokens"))
    value = F.to_json(F.struct(F.struct(usage.alias("usage")).alias("message")))
    return T.context_usage(_turns(spark, sf_dir).select("path", "line_no", value.alias("value")))


@query("SRC-18_last_compaction", "SELECT 'f' || conv_id AS path, max('2024-01-01T00:0' || turn || ':00Z') AS at FROM conversations WHERE turn % 3 = 1 GROUP BY conv_id")
def last_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("turn") == 8, "never").otherwise(F.concat(F.lit("2024-01-01T00:0"), "turn", F.lit(":00Z")))
    kind = F.when(F.col("turn") % 3 == 1, "compact_boundary").otherwise("other")
    return T.last_compaction(_turns(spark, sf_dir).select("path", F.to_json(F.struct(kind.alias("subtype"), at.alias("timestamp"))).alias("value")))


@query("SRC-21_salvage", "SELECT count(*) FILTER (WHERE event_id % 50 = 0) AS lost, count(*) AS read FROM events")
def salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 50 == 0, F.left("props", F.lit(4))).otherwise(F.col("props"))
    return T.salvaged(table(spark, sf_dir, "events").select(raw.alias("value")), "k long")[1]
