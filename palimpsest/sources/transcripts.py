"""Transcript adapters: raw records as text to (session_id, uuid, role, content, tool_name, timestamp) rows.

Every adapter is a plan over JSON text; a line that is no JSON gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOB_BYTES = 8 << 20

_BLOCK = "struct<type:string,text:string,name:string,input:string,content:string,source:struct<type:string,media_type:string,data:string>>"
COLUMNS = ("session_id", "seq", "uuid", "role", "content", "tool_name", "timestamp")


def _joined(parts: Column) -> Column:
    return F.trim(F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n"))


def image_bytes(block: Column) -> Column:
    return F.when((block["source"]["type"] == "base64") & (block["source"]["data"] != ""), F.unbase64(block["source"]["data"]))


def image_label(mime: Column, data: Column) -> Column:
    size = F.format_number(F.octet_length(data) / 1024, 0)
    return F.concat(F.lit("[image:"), F.coalesce(mime, F.lit("?")), F.lit(" "), size, F.lit("KB "), F.left(F.sha2(data, 256), F.lit(12)), F.lit("]"))


def _text_of_content(content: Column) -> Column:
    """Text of a tool result: a string as it is, else the text blocks of a list, a line each."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    listed = F.array_join(F.transform(blocks, lambda b: F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).otherwise("")), "\n")
    return F.when(F.startswith(F.ltrim(content), F.lit("[{")), F.coalesce(listed, content)).otherwise(F.coalesce(content, F.lit("")))


def blocks_text(blocks: Column, sep: str = " ") -> Column:
    """Blocks flattened: text, tool calls and results with their marks, images as labels; anything else is left out."""

    def one(b: Column) -> Column:
        data = image_bytes(b)
        return (
            F.when(b["type"] == "text", b["text"])
            .when(b["type"] == "tool_use", F.concat(F.lit("[tool_use:"), b["name"], F.lit("]" + sep), F.coalesce(b["input"], F.lit("{}"))))
            .when(b["type"] == "tool_result", F.concat(F.lit("[tool_result]" + sep), _text_of_content(b["content"])))
            .when((b["type"] == "image") & data.isNotNull(), image_label(b["source"]["media_type"], data))
        )

    return _joined(F.transform(blocks, one))


def append_log_a(lines: DataFrame) -> DataFrame:
    """JSONL of typed records (path, line_no, value): messages with blocks, and titles as rows of role ``title``."""
    record = f"type string, uuid string, timestamp string, customTitle string, message struct<role:string,content:string>"
    r = F.from_json("value", record)
    held = lines.select("path", "line_no", r.alias("r")).filter("r.type is not null")
    blocks = F.from_json("r.message.content", f"array<{_BLOCK}>")
    is_list = F.startswith(F.ltrim("r.message.content"), F.lit("["))
    tools = F.filter(blocks, lambda b: b["type"] == "tool_use")
    content = F.when(is_list, blocks_text(blocks)).otherwise(F.trim("r.message.content"))
    title = F.col("r.type") == "custom-title"
    rows = held.filter(F.col("r.type").isin("user", "assistant", "custom-title")).select(
        F.col("path").alias("session_id"), F.col("line_no").alias("seq"), F.col("r.uuid").alias("uuid"),
        F.when(title, "title").otherwise(F.coalesce("r.message.role", "r.type")).alias("role"),
        F.when(title, F.col("r.customTitle")).otherwise(content).alias("content"),
        F.when(is_list & (F.size(tools) > 0), F.get(tools, F.lit(0))["name"]).alias("tool_name"), F.col("r.timestamp").alias("timestamp"),
    )
    return rows.filter(F.coalesce("content", F.lit("")) != "")


def append_log_b(lines: DataFrame) -> DataFrame:
    """JSONL of envelopes (path, line_no, value): response items of user and assistant."""
    r = F.from_json("value", "type string, timestamp string, payload struct<type:string,id:string,role:string,cwd:string,content:string>")
    held = lines.select("path", "line_no", r.alias("r"))
    held = held.filter((F.col("r.type") == "response_item") & (F.col("r.payload.type") == "message") & F.col("r.payload.role").isin("user", "assistant"))
    blocks = F.from_json("r.payload.content", "array<struct<type:string,text:string>>")
    listed = _joined(F.transform(blocks, lambda b: F.when(b["text"].isNotNull(), b["text"]).when(b["type"] != "text", F.concat(F.lit("["), b["type"], F.lit("]")))))
    content = F.when(F.startswith(F.ltrim("r.payload.content"), F.lit("[")), listed).otherwise(F.trim("r.payload.content"))
    rows = held.select(
        F.col("path").alias("session_id"), F.col("line_no").alias("seq"), F.col("r.payload.id").alias("uuid"), F.col("r.payload.role").alias("role"),
        content.alias("content"), F.lit(None).cast("string").alias("tool_name"), F.col("r.timestamp").alias("timestamp"),
    )
    return rows.filter("content <> ''")


def session_folders(lines: DataFrame) -> DataFrame:
    """(session_id, cwd) from the metadata records of log B; the last one counts."""
    r = F.from_json("value", "type string, payload struct<cwd:string>")
    held = lines.select(F.col("path").alias("session_id"), "line_no", r.alias("r")).filter("r.type = 'session_meta' and r.payload.cwd is not null")
    return held.groupBy("session_id").agg(F.max_by("r.payload.cwd", "line_no").alias("cwd"))


def whole_history(files: DataFrame) -> DataFrame:
    """JSON files (path, value, modified) with ``history[].message``; identifiers by place, the file's time."""
    doc = F.from_json("value", "history array<struct<message:struct<id:string,role:string,content:string>>>")
    each = files.select("path", "modified", F.posexplode(doc["history"]).alias("seq", "h"))
    blocks = F.from_json("h.message.content", f"array<{_BLOCK}>")
    content = F.when(F.startswith(F.ltrim("h.message.content"), F.lit("[{")), blocks_text(blocks)).otherwise(F.trim("h.message.content"))
    rows = each.select(
        F.col("path").alias("session_id"), F.col("seq").cast("long").alias("seq"), F.coalesce("h.message.id", F.concat(F.lit("i"), "seq")).alias("uuid"),
        F.col("h.message.role").alias("role"), content.alias("content"), F.lit(None).cast("string").alias("tool_name"), F.col("modified").alias("timestamp"),
    )
    return rows.filter("content <> '' and role in ('user', 'assistant')")


def versioned(files: DataFrame) -> DataFrame:
    """JSON files (path, value, modified) whose messages have versions: the selected one, its steps where it has no content."""
    part = "array<struct<type:string,text:string>>"
    doc = F.from_json("value", f"messages array<struct<currentlySelected:int,versions:array<struct<role:string,content:{part},steps:array<struct<content:{part}>>>>>>")
    each = files.select("path", "modified", F.posexplode(doc["messages"]).alias("seq", "m"))
    each = each.withColumn("v", F.get("m.versions", F.coalesce("m.currentlySelected", F.lit(0))))
    text = lambda parts: _joined(F.transform(parts, lambda b: b["text"]))
    steps = _joined(F.transform("v.steps", lambda s: F.nullif(text(s["content"]), F.lit(""))))
    content = F.coalesce(F.nullif(text(F.col("v.content")), F.lit("")), steps, F.lit(""))
    rows = each.select(
        F.col("path").alias("session_id"), F.col("seq").cast("long").alias("seq"), F.concat(F.lit("i"), "seq").alias("uuid"), F.col("v.role").alias("role"),
        content.alias("content"), F.lit(None).cast("string").alias("tool_name"), F.col("modified").alias("timestamp"),
    )
    return rows.filter("content <> ''")


_NODE = "struct<parent:string,message:struct<author:struct<role:string>,create_time:double,content:struct<parts:array<string>>,metadata:struct<is_visually_hidden_from_conversation:boolean>>>"


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """Exported conversations (value) as trees: the branch from the current node to the root, or all nodes where there is none."""
    doc = F.from_json("value", f"conversation_id string, current_node string, mapping map<string,{_NODE}>")
    held = conversations.select(doc.alias("d")).select("d.*")
    n = F.size("mapping")
    walk = F.aggregate(
        F.sequence(F.lit(1), n), F.struct(F.col("current_node").alias("at"), F.array().cast("array<string>").alias("seen")),
        lambda s, _: F.when(s["at"].isNotNull() & F.map_contains_key("mapping", s["at"]) & ~F.array_contains(s["seen"], s["at"]),
                            F.struct(F.element_at("mapping", s["at"])["parent"].alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen"))).otherwise(s),
    )["seen"]
    path = F.when(F.map_contains_key("mapping", F.coalesce("current_node", F.lit(""))), F.reverse(walk)).otherwise(F.array_sort(F.map_keys("mapping")))
    each = held.select(F.col("conversation_id").alias("session_id"), "mapping", F.posexplode(path).alias("seq", "uuid"))
    each = each.withColumn("m", F.element_at("mapping", F.col("uuid"))["message"])
    content = F.trim(F.array_join("m.content.parts", "\n"))
    rows = each.filter(F.col("m.author.role").isin("user", "assistant") & ~F.coalesce("m.metadata.is_visually_hidden_from_conversation", F.lit(False))).select(
        "session_id", F.col("seq").cast("long").alias("seq"), "uuid", F.col("m.author.role").alias("role"), content.alias("content"),
        F.lit(None).cast("string").alias("tool_name"), iso(F.col("m.create_time")).alias("timestamp"),
    )
    return rows.filter("content <> ''")


def iso(seconds: Column) -> Column:
    """ISO text in UTC of seconds since 1970, whatever the session's zone."""
    whole = F.floor(seconds).cast("long")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(whole / 86400).cast("int")).cast("string")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    rest = F.pmod(whole, F.lit(86400))
    hour, minute = F.floor(rest / 3600), F.floor(rest % 3600 / 60)
    return F.when(seconds.isNotNull(), F.concat(day, F.lit("T"), two(hour), F.lit(":"), two(minute), F.lit(":"), two(rest % 60), F.lit("Z")))


def message_list(conversations: DataFrame) -> DataFrame:
    """Exported conversations (value) with ``chat_messages``; blocks where there are any, else the flat text."""
    doc = F.from_json("value", f"uuid string, chat_messages array<struct<uuid:string,sender:string,text:string,created_at:string,content:array<{_BLOCK}>>>")
    each = conversations.select(doc.alias("d")).select(F.col("d.uuid").alias("session_id"), F.posexplode("d.chat_messages").alias("seq", "m"))
    content = F.coalesce(F.nullif(blocks_text(F.col("m.content"), "\n"), F.lit("")), "m.text", F.lit(""))
    rows = each.select(
        "session_id", F.col("seq").cast("long").alias("seq"), F.col("m.uuid").alias("uuid"),
        F.when(F.col("m.sender") == "human", "user").otherwise(F.col("m.sender")).alias("role"), content.alias("content"),
        F.lit(None).cast("string").alias("tool_name"), F.col("m.created_at").alias("timestamp"),
    )
    return rows.filter("content <> ''")


def event_log(conversations: DataFrame) -> DataFrame:
    """Exported event logs (value): user and assistant events, control events dropped."""
    doc = F.from_json("value", "id string, events array<struct<event_id:string,event_type:string,created_at:string,payload:struct<uuid:string,message:struct<role:string,content:string>>>>")
    each = conversations.select(doc.alias("d")).select(F.col("d.id").alias("session_id"), F.posexplode("d.events").alias("seq", "e"))
    blocks = F.from_json("e.payload.message.content", f"array<{_BLOCK}>")
    raw = F.col("e.payload.message.content")
    content = F.when(F.startswith(F.ltrim(raw), F.lit("[{")), blocks_text(blocks, "\n")).otherwise(F.trim(raw))
    rows = each.filter(F.col("e.event_type").isin("user", "assistant")).select(
        "session_id", F.col("seq").cast("long").alias("seq"), F.coalesce("e.payload.uuid", "e.event_id").alias("uuid"),
        F.coalesce("e.payload.message.role", "e.event_type").alias("role"), content.alias("content"),
        F.lit(None).cast("string").alias("tool_name"), F.col("e.created_at").alias("timestamp"),
    )
    return rows.filter("content <> ''")


def decoded_attachments(blocks: DataFrame) -> DataFrame:
    """(owner, mime, base64, pointer) to (owner, sha256, bytes, kind, blob): over-size content and pointers as references."""
    data = F.when(F.coalesce("base64", F.lit("")) != "", F.unbase64("base64"))
    held = blocks.withColumn("data", data).filter(F.col("data").isNotNull() | F.col("pointer").isNotNull())
    big = F.octet_length("data") > MAX_BLOB_BYTES
    return held.select(
        "owner", F.coalesce(F.sha2("data", 256), F.sha2(F.concat(F.lit("asset:"), "pointer"), 256)).alias("sha256"),
        F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("bytes"),
        F.when(F.col("data").isNull() | big, "ref").otherwise("blob").alias("kind"), F.when(~big, F.col("data")).alias("blob"),
    )


def store_folders(files: DataFrame, least: int = 3, depth: int = 8) -> DataFrame:
    """Folders of (path) that hold enough JSON files to be a store; known build folders and deep ones are skipped."""
    held = files.filter(F.lower("path").rlike(r"\.jsonl?$") & ~F.col("path").rlike("/(node_modules|dist|build|\\.git)/"))
    held = held.filter(F.size(F.split("path", "/")) <= depth + 1).dropDuplicates(["path"])
    return held.groupBy(F.lower(F.regexp_replace("path", F.lit("/[^/]*$"), F.lit(""))).alias("root")).agg(F.count("*").alias("files")).filter(F.col("files") >= least)


def known_stores(files: DataFrame, adapters: list[tuple[str, str, bool]], roots: list[str], imports: str, known: list[tuple[str, str]]) -> DataFrame:
    """(source, root, files) of the stores at known places, without a walk: files of (path) are looked up by their folders.

    ``adapters`` are (source, signature, web): a signature below each root, and for web sources its last step below
    ``imports``; then the stores known from before. Of places that differ in case only the first counts, and of a
    file's places the first.
    """
    places = [(source, f"{root}/{sign}") for source, sign, _ in adapters for root in roots]
    places += [(source, f"{imports}/{sign.rsplit('/', 1)[-1]}") for source, sign, web in adapters if web]
    first: dict[str, tuple[int, str, str]] = {}
    for nth, (source, root) in enumerate([*places, *known]):
        first.setdefault(root.lower(), (nth, source, root))
    wanted = files.sparkSession.createDataFrame([(low, *rest) for low, rest in first.items()], "low string, nth int, source string, root string")
    steps = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.lower(F.array_join(F.slice(steps, F.lit(1), n), "/")))
    held = files.filter(F.lower("path").rlike(r"\.jsonl?$")).dropDuplicates(["path"]).select("path", F.explode(folders).alias("low"))
    # as many places as the caller names
    place = held.join(F.broadcast(wanted), "low").groupBy("path").agg(F.min(F.struct("nth", "source", "root")).alias("place"))
    return place.groupBy("place.source", "place.root").agg(F.count("*").alias("files"))


def late_titles(lines: DataFrame) -> DataFrame:
    """The newest custom title of each file."""
    r = F.from_json("value", "type string, customTitle string")
    held = lines.select("path", "line_no", r.alias("r")).filter("r.type = 'custom-title' and r.customTitle <> ''")
    return held.groupBy("path").agg(F.max_by("r.customTitle", "line_no").alias("title"))


def context_usage(lines: DataFrame, window: int = 200_000) -> DataFrame:
    """Tokens of the last record that states its usage, and their share of the window."""
    r = F.from_json("value", "message struct<model:string,usage:struct<input_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>>")
    held = lines.select("path", "line_no", r["message"]["usage"].alias("u"), r["message"]["model"].alias("model")).filter("u is not null")
    last = held.groupBy("path").agg(F.max_by(F.struct("u", "model"), "line_no").alias("last"))
    zero = F.lit(0)
    used = F.coalesce("last.u.input_tokens", zero) + F.coalesce("last.u.cache_read_input_tokens", zero) + F.coalesce("last.u.cache_creation_input_tokens", zero)
    size = F.when(F.col("last.model").contains("1m"), 1_000_000).otherwise(window)
    return last.select("path", used.alias("tokens"), F.round(used * 100 / size, 1).alias("percent"))


def last_compaction(lines: DataFrame) -> DataFrame:
    """Time of each file's last boundary record."""
    r = F.from_json("value", "subtype string, timestamp string")
    held = lines.select("path", r.alias("r")).filter("r.subtype = 'compact_boundary'")
    return held.filter(F.try_to_timestamp("r.timestamp").isNotNull()).groupBy("path").agg(F.max("r.timestamp").alias("at"))


def salvaged(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Readable rows of damaged JSON text and how many were lost."""
    held = lines.withColumn("row", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    return held.filter(~bad).select("row.*").drop("_corrupt"), held.agg(F.count_if(bad).alias("lost"), F.count("*").alias("read"))
