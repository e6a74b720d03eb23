"""Filters, projections, joins, windows, sorts and set operations over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.functions import scalars as S
from palimpsest.operators import store
from palimpsest.operators import vectors as V
from palimpsest.sources.conversation_store import attachments, links, messages, model_sql, sessions
from palimpsest.storage import table

KEY = r"regexp_replace(lower(replace({}, '\', '/')), '/+$', '')"


def _with_sessions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    held = sessions(spark, sf_dir).select(F.col("id").alias("session_id"), *columns)
    return messages(spark, sf_dir).join(held, "session_id")


# Filters


@query("FLT-02_project_scope", model_sql(rf"SELECT m.id FROM messages m JOIN sessions s ON m.session_id = s.id WHERE {KEY.format('s.project_root')} = '/p/5'"))
def project_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = sessions(spark, sf_dir).filter(S.project_key(F.col("project_root")) == S.project_key(F.lit("\\P\\5\\")))
    return messages(spark, sf_dir).join(wanted.select(F.col("id").alias("session_id")), "session_id").select("id")


@query("FLT-03_source_origin", model_sql("SELECT id FROM sessions WHERE source = 'agent1' AND coalesce(origin, 'local') = 'local'"))
def source_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).filter((F.col("source") == "agent1") & (F.coalesce("origin", F.lit("local")) == "local")).select("id")


@query("FLT-04_derived_role", model_sql(r"""
    SELECT CASE WHEN role = 'user' AND regexp_matches(content, '(?i)^\s*\[tool[_ ]result') THEN 'tool' ELSE role END AS role, count(*) AS n
    FROM messages GROUP BY 1"""))
def derived_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy(S.derived_role(F.col("role"), F.col("content")).alias("role")).agg(F.count("*").alias("n"))


@query("FLT-05_lane_exclusion", model_sql("""
    SELECT id FROM sessions WHERE NOT ((coalesce(origin, 'local') = 'local' AND coalesce(host, '') = 'host1') OR source = 'agent4')"""))
def lane_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).filter(~S.in_any_lane([{"origin": "local", "host": "host1"}, {"source": "agent4"}, {}])).select("id")


@query("FLT-06_since", model_sql("""
    SELECT id FROM (SELECT id, CASE WHEN id % 29 = 0 THEN 'not a time' ELSE timestamp END AS t FROM messages)
    WHERE TRY_CAST(t AS TIMESTAMP) >= TIMESTAMP '2024-01-20 00:00:00'"""))
def since(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = messages(spark, sf_dir).select("id", F.when(F.col("id") % 29 == 0, "not a time").otherwise(F.col("timestamp")).alias("t"))
    return held.filter(S.epoch(F.col("t")) >= 1705708800).select("id")


@query("FLT-07_has_attachment", model_sql("SELECT id FROM messages WHERE id IN (SELECT message_id FROM links)"))
@query("JN-02_semi", model_sql("SELECT id FROM messages m WHERE EXISTS (SELECT 1 FROM links l WHERE l.message_id = m.id)"))
def has_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).join(links(spark, sf_dir), F.col("id") == F.col("message_id"), "left_semi").select("id")


@query("FLT-08_forget_selector", model_sql("""
    SELECT m.id FROM messages m JOIN sessions s ON m.session_id = s.id
    WHERE s.source = 'agent2' AND coalesce(m.timestamp, s.ended_at, s.started_at, '') < '2024-02-01'"""))
def forget_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = store.forget_selector(source="agent2", before="2024-02-01")
    return store.forgotten(messages(spark, sf_dir), sessions(spark, sf_dir), chosen).select("id")


@query("FLT-09_recent_messages", model_sql(rf"""
    SELECT m.id FROM messages m JOIN sessions s ON m.session_id = s.id
    WHERE {KEY.format('s.project_root')} = '/p/2' AND m.timestamp >= '2024-01-05' AND m.role = 'assistant' AND coalesce(s.origin, 'local') = 'local'
      AND m.id NOT IN (SELECT message_id FROM links) ORDER BY m.id DESC LIMIT 40"""))
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _with_sessions(spark, sf_dir, "project_root", "origin").filter(
        (S.project_key(F.col("project_root")) == "/p/2") & (F.col("timestamp") >= "2024-01-05") & (F.col("role") == "assistant")
        & (F.coalesce("origin", F.lit("local")) == "local")
    )
    return held.join(links(spark, sf_dir), F.col("id") == F.col("message_id"), "left_anti").orderBy(F.desc("id")).select("id").limit(40)


@query("FLT-10_session_list", model_sql("""
    SELECT id FROM sessions WHERE (lower(title) LIKE '%th%' OR lower(project_root) LIKE '%th%' OR lower(source) LIKE '%th%')
      AND coalesce(ended_at, started_at) >= '2024-01-08' AND host = 'host0'"""))
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.lower("title").contains("th") | F.lower("project_root").contains("th") | F.lower("source").contains("th")
    return sessions(spark, sf_dir).filter(found & (F.coalesce("ended_at", "started_at") >= "2024-01-08") & (F.col("host") == "host0")).select("id")


@query("FLT-11_embeddable", model_sql("SELECT id FROM messages WHERE content <> '' AND (tool_name IS NULL OR tool_name IN ('tool1'))"))
def embeddable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).filter(V.embeddable(["tool1"])).select("id")


@query("FLT-12_trigram_membership", model_sql("SELECT id FROM messages WHERE lower(content) NOT LIKE '[tool_result]%'"))
def trigram_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).filter(~F.lower("content").startswith("[tool_result]")).select("id")


_CONTROLS_SQL = """marked AS (
    SELECT id, CASE WHEN id % 40 = 1 THEN content || chr(8238) ELSE content END || CASE WHEN id % 60 = 1 THEN chr(8294) ELSE '' END AS content FROM messages)"""


@query("FLT-13_hidden_controls", model_sql("""
    SELECT id, concat_ws(', ', CASE WHEN contains(content, chr(8237)) THEN 'U+202D LEFT-TO-RIGHT OVERRIDE' END,
                         CASE WHEN contains(content, chr(8238)) THEN 'U+202E RIGHT-TO-LEFT OVERRIDE' END,
                         CASE WHEN contains(content, chr(8294)) THEN 'U+2066 LEFT-TO-RIGHT ISOLATE' END) AS chars
    FROM marked WHERE contains(content, chr(8237)) OR contains(content, chr(8238)) OR contains(content, chr(8294))
    ORDER BY id LIMIT 50""", _CONTROLS_SQL))
@query("PRV-03_hidden_controls", model_sql("""
    SELECT id, concat_ws(', ', CASE WHEN contains(content, chr(8238)) THEN 'U+202E RIGHT-TO-LEFT OVERRIDE' END,
                         CASE WHEN contains(content, chr(8294)) THEN 'U+2066 LEFT-TO-RIGHT ISOLATE' END) AS chars
    FROM marked WHERE contains(content, chr(8238)) OR contains(content, chr(8294)) ORDER BY id LIMIT 50""", _CONTROLS_SQL))
def hidden_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted controls are found; the report names 50 messages, as the audit does."""
    text = F.concat(
        F.when(F.col("id") % 40 == 1, F.concat("content", F.lit(chr(0x202E)))).otherwise(F.col("content")), F.when(F.col("id") % 60 == 1, chr(0x2066)).otherwise("")
    )
    held = messages(spark, sf_dir).select("id", S.hidden_controls(text).alias("found")).filter(F.size("found") > 0)
    return held.orderBy("id").limit(50).select("id", F.array_join("found", ", ").alias("chars"))


@query("FLT-14_decisions", r"""
    SELECT doc_id FROM (SELECT doc_id, text || CASE doc_id % 9 WHEN 1 THEN ' We decided so.' WHEN 2 THEN ' undecided' WHEN 3 THEN ' use it instead  of' WHEN 4 THEN ' deprecated' ELSE '' END AS t FROM documents)
    WHERE regexp_matches(t, '(?i)\bwe (decided|will not|no longer)\b|\bdecision\b|\binstead of\b|\bdeprecat|\bsupersede\b')""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nine = F.col("doc_id") % 9
    more = F.when(nine == 1, " We decided so.").when(nine == 2, " undecided").when(nine == 3, " use it instead  of").when(nine == 4, " deprecated").otherwise("")
    return table(spark, sf_dir, "documents").filter(S.is_decision(F.concat("text", more))).select("doc_id")


@query("FLT-15_prose", model_sql("SELECT id FROM messages WHERE role IN ('user', 'assistant') AND tool_name IS NULL AND content <> '' AND NOT starts_with(content, '[tool_')"))
def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).filter(S.is_prose(F.col("role"), F.col("tool_name"), F.col("content"))).select("id")


_DRIVES = "drives AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'c:\\Work\\' ELSE 'C:/work' END || (id % 4) AS path FROM messages)"


@query("FLT-16_canonical_path", model_sql(r"SELECT CASE WHEN regexp_matches(path, '^[a-z]:') THEN upper(left(path, 1)) || substr(path, 2) ELSE path END AS path, count(*) AS n FROM drives GROUP BY 1", _DRIVES))
def canonical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("id") % 2 == 0, "c:\\Work\\").otherwise("C:/work"), F.col("id") % 4)
    return messages(spark, sf_dir).groupBy(S.canonical_path(path).alias("path")).agg(F.count("*").alias("n"))


@query("FLT-17_like_within", "SELECT doc_id, n FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: contains(lower(l), '%a_'))) AS n, len(list_filter(string_split(text, chr(10)), lambda l: contains(lower(l), 'th of'))) AS m FROM documents) WHERE n > 0 OR m > 0")
def like_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    hits = lambda needle: F.size(F.filter(lines, lambda line: F.contains(F.lower(line), F.lit(needle)))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", hits("%a_").alias("n"), hits("th of").alias("m")).filter("n > 0 or m > 0").select("doc_id", "n")


# Projections


_FLAT = r"trim(regexp_replace(content, '[\s\x{00a0}]+', ' ', 'g'))"


@query("PRJ-01_snippet", model_sql(f"""
    SELECT id, CASE WHEN hit IS NULL THEN left(flat, 180)
        ELSE CASE WHEN greatest(1, hit - 90) > 1 THEN '…' ELSE '' END
             || substr(flat, greatest(1, hit - 90), least(length(flat), hit - 1 + 90) - greatest(1, hit - 90) + 1)
             || CASE WHEN least(length(flat), hit - 1 + 90) < length(flat) THEN '…' ELSE '' END END AS snippet
    FROM (SELECT id, flat, nullif(least(CASE WHEN p1 > 0 THEN p1 ELSE 1000000000 END, CASE WHEN p2 > 0 THEN p2 ELSE 1000000000 END), 1000000000) AS hit
          FROM (SELECT id, flat, instr(lower(flat), 'with') AS p1, instr(lower(flat), 'from') AS p2 FROM (SELECT id, {_FLAT} AS flat FROM messages)))"""))
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", S.snippet(F.col("content"), ["with", "from"]).alias("snippet"))


@query("PRJ-03_recent_snippet", model_sql(f"SELECT id, left({_FLAT}, 220) AS snippet FROM messages"))
def recent_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", F.left(S.flattened(F.col("content")), F.lit(220)).alias("snippet"))


@query("PRJ-04_clip", model_sql(f"SELECT id, CASE WHEN length({_FLAT}) > 160 THEN left({_FLAT}, 160) || '…' ELSE {_FLAT} END AS text FROM messages"))
def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", S.clip(F.col("content"), 160).alias("text"))


@query("PRJ-06_point_lookup", model_sql("SELECT m.id, m.content, s.title, s.source FROM messages m JOIN sessions s ON m.session_id = s.id WHERE m.id IN (1001, 2003)"))
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_sessions(spark, sf_dir, "title", "source").filter(F.col("id").isin(1001, 2003)).select("id", "content", "title", "source")


# Joins


@query("JN-01_inner", model_sql("SELECT m.id, s.source, s.project_root FROM messages m JOIN sessions s ON m.session_id = s.id"))
def inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_sessions(spark, sf_dir, "source", "project_root").select("id", "source", "project_root")


@query("JN-03_anti", model_sql("SELECT id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id * 250 + e.vec_id % 6 = m.id)"))
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).join(table(spark, sf_dir, "embeddings").selectExpr("vec_id * 250 + vec_id % 6 as id"), "id", "left_anti").select("id")


@query("JN-04_orphans", model_sql("SELECT id FROM attachments WHERE id NOT IN (SELECT attachment_id FROM links)"))
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attachments(spark, sf_dir).join(links(spark, sf_dir), F.col("id") == F.col("attachment_id"), "left_anti").select("id")


_BUNDLE = """bundle AS (
    SELECT id + 7000000 AS id, session_id, uuid, role, CASE WHEN id % 33 = 0 THEN content || '!' ELSE content END AS content,
           CASE WHEN id % 44 = 0 THEN NULL ELSE timestamp END AS timestamp FROM messages WHERE id % 3 = 0)"""


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the messages under new identifiers, some of them changed."""
    return messages(spark, sf_dir).filter("id % 3 = 0").selectExpr(
        "id + 7000000 as id", "session_id", "uuid", "role", "case when id % 33 = 0 then concat(content, '!') else content end as content",
        "case when id % 44 != 0 then timestamp end as timestamp",
    )


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", "session_id", "uuid", "role", "content", "timestamp")


_NEW_LOOSE = """SELECT b.id FROM bundle b WHERE uuid IS NULL AND NOT EXISTS (
    SELECT 1 FROM messages m WHERE m.uuid IS NULL AND m.session_id = b.session_id AND m.role IS NOT DISTINCT FROM b.role
      AND m.timestamp IS NOT DISTINCT FROM b.timestamp AND m.content IS NOT DISTINCT FROM b.content)"""


@query("JN-05_null_safe_anti", model_sql(_NEW_LOOSE, _BUNDLE))
def null_safe_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.new_messages(plain(spark, sf_dir), bundle(spark, sf_dir).filter("uuid is null"), by_content=True).select("id")


@query("JN-06_left_count", model_sql("SELECT s.id, count(l.attachment_id) AS links FROM sessions s LEFT JOIN messages m ON m.session_id = s.id LEFT JOIN links l ON l.message_id = m.id GROUP BY s.id"))
def left_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_message = links(spark, sf_dir).groupBy(F.col("message_id").alias("id")).agg(F.count("*").alias("n"))
    per_session = messages(spark, sf_dir).join(per_message, "id").groupBy(F.col("session_id").alias("id")).agg(F.sum("n").alias("n"))
    return sessions(spark, sf_dir).join(per_session, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("links"))


@query("JN-07_count_gap", model_sql("""
    SELECT s.id, s.message_count, count(m.id) AS actual, s.message_count - count(m.id) AS gap
    FROM sessions s LEFT JOIN (SELECT * FROM messages WHERE id % 7 <> 0) m ON m.session_id = s.id GROUP BY s.id, s.message_count HAVING s.message_count - count(m.id) > 0"""))
def count_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.count_gaps(sessions(spark, sf_dir), messages(spark, sf_dir).filter("id % 7 <> 0"))


@query("JN-08_null_safe_left", model_sql("""
    SELECT b.id, count(m.id) AS matches FROM bundle b LEFT JOIN messages m ON m.session_id = b.session_id AND m.uuid IS NOT DISTINCT FROM b.uuid GROUP BY b.id""", _BUNDLE))
def null_safe_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = messages(spark, sf_dir).groupBy("session_id", "uuid").agg(F.count("*").alias("n")).alias("m")
    joined = bundle(spark, sf_dir).alias("b").join(held, (F.col("b.session_id") == F.col("m.session_id")) & F.col("b.uuid").eqNullSafe(F.col("m.uuid")), "left")
    return joined.select(F.col("b.id").alias("id"), F.coalesce("n", F.lit(0)).alias("matches"))


@query("JN-09_multi_way", model_sql("SELECT l.message_id, l.name, a.sha256, m.session_id FROM links l JOIN attachments a ON l.attachment_id = a.id JOIN messages m ON l.message_id = m.id"))
def multi_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = attachments(spark, sf_dir).select(F.col("id").alias("attachment_id"), "sha256")
    owners = messages(spark, sf_dir).select(F.col("id").alias("message_id"), "session_id")
    return links(spark, sf_dir).join(held, "attachment_id").join(owners, "message_id").select("message_id", "name", "sha256", "session_id")


@query("JN-10_last_sessions", model_sql("""
    SELECT project_root, id, ended_at FROM sessions s WHERE ended_at = (SELECT max(ended_at) FROM sessions t WHERE t.project_root = s.project_root)"""))
def last_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties on the last time stay, as in the reference."""
    held = sessions(spark, sf_dir).filter("ended_at is not null")
    last = held.groupBy("project_root").agg(F.max("ended_at").alias("ended_at"))
    return held.join(last, ["project_root", "ended_at"]).select("project_root", "id", "ended_at")


_ENTRIES = "entries AS (SELECT o_orderkey AS id, o_custkey AS topic, o_orderdate AS d, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 2 END AS supersedes FROM orders)"


@query("JN-11_latest_superseding", f"""WITH {_ENTRIES}
    SELECT e.id, arg_max(n.id, (n.d, n.id)) AS superseded_by FROM entries e LEFT JOIN entries n ON n.supersedes = e.id GROUP BY e.id""")
def latest_superseding(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_orderdate as d", "case when o_orderkey % 3 = 0 then o_orderkey - 2 end as supersedes")
    newest = entries.filter("supersedes is not null").groupBy("supersedes").agg(F.max_by("id", F.struct("d", "id")).alias("superseded_by"))
    newest = newest.select(F.col("supersedes").alias("old"), "superseded_by")
    return entries.select("id").join(newest, F.col("id") == F.col("old"), "left").select("id", "superseded_by")


_DOT = "round(list_inner_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[])), 9)"
_NEAREST = f"""nearest AS (
    SELECT e.vec_id, e.label, sqrt(greatest(0, 2 - 2 * {_DOT.format('e.embedding', 'q.embedding')})) AS distance
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"""


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


@query("JN-12_nearest", f"WITH {_NEAREST} SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id) - 1 AS rank FROM nearest ORDER BY distance, vec_id LIMIT 60")
@query("SRT-02_knn", f"WITH {_NEAREST} SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id) - 1 AS rank FROM nearest ORDER BY distance, vec_id LIMIT 60")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nearest(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 60).select("vec_id", "distance", F.col("rank").cast("long").alias("rank"))


_OWNED = f"""{_NEAREST}, top AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) - 1 AS rank FROM nearest ORDER BY distance, vec_id LIMIT 120),
    owned AS (SELECT vec_id // 3 AS owner, min(rank) AS best, min(distance) AS distance FROM top WHERE vec_id % 10 <> 0 GROUP BY 1)"""


@query("JN-13_owner_lookup", f"WITH {_OWNED} SELECT owner, distance, row_number() OVER (ORDER BY best, owner) - 1 AS rank FROM owned ORDER BY rank LIMIT 60")
@query("RET-09_knn_stream", f"WITH {_OWNED} SELECT owner, distance, row_number() OVER (ORDER BY best, owner) - 1 AS rank FROM owned ORDER BY rank LIMIT 60")
def owner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings")
    owners = held.filter("vec_id % 10 <> 0").select("vec_id", F.expr("vec_id div 3").alias("owner"))
    return V.nearest_owners(held, owners, _query_vector(spark, sf_dir), 60).select("owner", "distance", F.col("rank").cast("long").alias("rank"))


_PAIRS = """pairs AS (
    SELECT q.vec_id AS q, v.vec_id AS v, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS cosine
    FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
    best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, v) AS nth FROM pairs WHERE cosine >= 0.1)"""


@query("JN-14_similar_pairs", f"WITH {_PAIRS} SELECT DISTINCT least(q, v) AS a, greatest(q, v) AS b, cosine FROM best WHERE nth <= 3")
@query("GRF-13_semantic_edges", f"WITH {_PAIRS} SELECT DISTINCT least(q, v) AS a, greatest(q, v) AS b, cosine FROM best WHERE nth <= 3")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return V.similar_pairs(held, held.filter("vec_id % 20 = 0"), 0.1, 3)


@query("JN-20_range_pair", model_sql("""
    SELECT n.id AS newest, o.id AS older FROM (SELECT * FROM messages ORDER BY timestamp DESC, id DESC LIMIT 1) n
    JOIN messages o ON o.id <> n.id AND epoch(CAST(n.timestamp AS TIMESTAMP)) - epoch(CAST(o.timestamp AS TIMESTAMP)) >= 7 * 86400
    ORDER BY o.timestamp DESC, o.id DESC LIMIT 8"""))
def range_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = messages(spark, sf_dir).select("id", "timestamp")
    newest = held.orderBy(F.desc("timestamp"), F.desc("id")).limit(1).select(F.col("id").alias("newest"), F.col("timestamp").alias("at"))
    old = held.crossJoin(F.broadcast(newest))  # one row
    apart = S.epoch(F.col("at")) - S.epoch(F.col("timestamp")) >= 7 * 86400
    return old.filter((F.col("id") != F.col("newest")) & apart).orderBy(F.desc("timestamp"), F.desc("id")).limit(8).select("newest", F.col("id").alias("older"))


@query("JN-21_neighbourhood", model_sql("""
    SELECT h.id AS hit, r.id, r.rn - h.rn AS away FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rn FROM messages) r
    JOIN (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rn FROM messages) h
      ON r.session_id = h.session_id AND abs(r.rn - h.rn) <= 2 WHERE h.id % 50 = 3"""))
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.ranking import neighbours

    return neighbours(messages(spark, sf_dir).select("id", "session_id"), F.col("id") % 50 == 3, 2)


@query("JN-22_rank_fusion", """
    SELECT vec_id AS item, round(sum(w / (60 + r)), 9) AS score FROM (
        SELECT vec_id, 1.0 AS w, row_number() OVER (ORDER BY label, vec_id) - 1 AS r FROM embeddings QUALIFY r < 60
        UNION ALL SELECT vec_id, 0.3, row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS r FROM embeddings QUALIFY r < 60) GROUP BY 1""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.ranking import fuse, stream

    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "label")
    streams = [(stream(held, 60, "label", "item"), 1.0), (stream(held, 60, F.desc("label"), "item"), 0.3)]
    return fuse(streams).select("item", F.round("score", 9).alias("score"))


@query("JN-23_scalar_subqueries", model_sql("SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM messages) AS messages, (SELECT count(DISTINCT project_root) FROM sessions) AS projects"))
def scalar_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = sessions(spark, sf_dir).agg(F.count("*").alias("sessions"), F.count_distinct("project_root").alias("projects"))
    return held.crossJoin(messages(spark, sf_dir).agg(F.count("*").alias("messages")))  # two rows of one


# Windows


@query("WIN-01_stream_rank", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents ORDER BY n_chars DESC, doc_id LIMIT 60")
def stream_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.ranking import stream

    held = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return stream(held, 60, F.desc("n_chars"), "doc_id").select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("WIN-02_session_cap", model_sql("SELECT id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY length(content) DESC, id) AS nth FROM messages) WHERE nth <= 2"))
def session_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.ranking import capped

    return capped(messages(spark, sf_dir), "session_id", 2, F.desc(F.length("content")), "id").select("id", "session_id")


NOW = 1709251200  # 2024-03-01T00:00:00Z
_RECENCY = "coalesce(greatest(0.15, pow(0.5, greatest(0, (1709251200 - epoch(CAST({} AS TIMESTAMP))) / 86400.0) / 30)), 0.5)"


@query("WIN-03_recency_reorder", model_sql(f"""
    SELECT id, row_number() OVER (ORDER BY round(1.0 / (1 + r0) * {_RECENCY.format('timestamp')}, 12) DESC, r0) AS pos
    FROM (SELECT *, row_number() OVER (ORDER BY length(content) DESC, id) - 1 AS r0 FROM messages QUALIFY r0 < 200)"""))
@query("RET-14_recency_blend", model_sql(f"""
    SELECT id, row_number() OVER (ORDER BY round(1.0 / (1 + r0) * {_RECENCY.format('timestamp')}, 12) DESC, r0) AS pos
    FROM (SELECT *, row_number() OVER (ORDER BY length(content) DESC, id) - 1 AS r0 FROM messages QUALIFY r0 < 200)"""))
def recency_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.ranking import blend_recency, stream

    top = stream(messages(spark, sf_dir), 200, F.desc(F.length("content")), "id")
    return blend_recency(top, NOW).select("id", F.col("pos").cast("long").alias("pos"))


@query("WIN-06_run_length", r"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    marked AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AND trim(line) <> '' THEN 0 ELSE 1 END AS fresh FROM lines),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked)
    SELECT doc_id, min(pos) AS pos, count(*) AS n FROM runs GROUP BY doc_id, run HAVING count(*) > 1""")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.compression import lines, runs

    return runs(lines(table(spark, sf_dir, "documents"), "doc_id", "text")).filter("n > 1").select(F.col("key").alias("doc_id"), (F.col("pos") + 1).cast("long").alias("pos"), "n")


@query("WIN-07_blank_collapse", r"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    marked AS (SELECT doc_id, trim(line) = '' AND coalesce(trim(lag(line) OVER (PARTITION BY doc_id ORDER BY pos)) = '', false) AS gone FROM lines)
    SELECT doc_id, count(*) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id""")
def blank_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.compression import collapse_blanks, lines

    kept = collapse_blanks(lines(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return kept.groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("kept"))


@query("WIN-10_date_sequence", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) - 1 AS seq FROM orders")
def date_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy(F.col("o_orderdate").cast("date")).orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.row_number().over(order) - 1).cast("long").alias("seq"))


@query("WIN-12_margin", f"""WITH {_NEAREST}, top AS (SELECT distance, row_number() OVER (ORDER BY distance, vec_id) AS r FROM nearest QUALIFY r <= 60)
    SELECT round((SELECT distance FROM top WHERE r = least(10, (SELECT count(*) FROM top))) - (SELECT distance FROM top WHERE r = 1), 6) AS margin""")
def margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.ranking import margin as margin_of

    return margin_of(V.nearest(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 60)).select(F.round("margin", 6).alias("margin"))


@query("WIN-13_last_rows", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 3")
def last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.ranking import capped

    return capped(table(spark, sf_dir, "events"), "user_id", 3, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "ts")


@query("WIN-14_pinned_first", model_sql("""
    SELECT id, row_number() OVER (ORDER BY pinned DESC, coalesce(ended_at, started_at) DESC, id) AS pos FROM sessions ORDER BY pos LIMIT 5"""))
@query("SET-03_pinned_and_recent", model_sql("""
    SELECT id, row_number() OVER (ORDER BY pinned DESC, coalesce(ended_at, started_at) DESC, id) AS pos FROM sessions ORDER BY pos LIMIT 5"""))
def pinned_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.ranking import pinned_then_recent

    return pinned_then_recent(sessions(spark, sf_dir), 5).select("id", F.col("pos").cast("long").alias("pos"))


# Sorts


@query("SRT-03_session_page", model_sql("SELECT id, (SELECT count(*) FROM sessions) AS total FROM sessions ORDER BY coalesce(ended_at, started_at) DESC, id LIMIT 20 OFFSET 40"))
def session_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = sessions(spark, sf_dir)
    page = held.orderBy(F.coalesce("ended_at", "started_at").desc(), "id").offset(40).limit(20).select("id")
    return page.crossJoin(held.agg(F.count("*").alias("total")))


@query("SRT-04_recents", model_sql("SELECT id FROM messages ORDER BY id DESC LIMIT 50"))
def recents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id").orderBy(F.desc("id")).limit(50)


@query("SRT-05_embed_backlog", "SELECT doc_id FROM documents ORDER BY length(text), doc_id LIMIT 200")
def embed_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").orderBy(F.length("text"), "doc_id").limit(200).select("doc_id")


@query("SRT-06_thread", model_sql("SELECT id, (SELECT count(*) FROM messages WHERE session_id = 's3') > 5 AS truncated FROM messages WHERE session_id = 's3' ORDER BY id LIMIT 5"))
def thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.ranking import thread_of

    return thread_of(messages(spark, sf_dir), "s3", 5)


@query("SRT-07_top_hubs", "SELECT n AS node, count(*) AS degree FROM (SELECT l_partkey AS n FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY n ORDER BY degree DESC, node LIMIT 20")
def top_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "lineitem").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(20)


# Sets


@query("SET-01_union", model_sql("SELECT id FROM messages WHERE tool_name IS NOT NULL UNION SELECT message_id FROM links"))
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = messages(spark, sf_dir).filter("tool_name is not null").select("id")
    return tools.union(links(spark, sf_dir).select("message_id")).distinct()


@query("SET-02_additive_merge", model_sql(f"""
    SELECT session_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (
        SELECT session_id, id FROM messages UNION ALL SELECT session_id, id FROM bundle WHERE id IN ({_NEW_LOOSE})) GROUP BY 1""", _BUNDLE))
@query("MRG-01_additive_merge", model_sql(f"""
    SELECT session_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (
        SELECT session_id, id FROM messages UNION ALL SELECT session_id, id FROM bundle WHERE id IN ({_NEW_LOOSE})) GROUP BY 1""", _BUNDLE))
def additive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = store.merge_stores(plain(spark, sf_dir), bundle(spark, sf_dir))
    return merged.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SET-04_ordered_dedupe", "SELECT DISTINCT o_custkey || ' -> ' || o_orderpriority AS edge FROM orders")
def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat("o_custkey", F.lit(" -> "), "o_orderpriority").alias("edge")).dropDuplicates(["edge"])


@query("SET-05_list_fusion", """
    WITH lists AS (SELECT vec_id AS item, 0 AS list, row_number() OVER (ORDER BY vec_id DESC) - 1 AS i FROM embeddings QUALIFY i < 40
        UNION ALL SELECT vec_id, 1, row_number() OVER (ORDER BY vec_id % 7, vec_id DESC) - 1 AS i FROM embeddings QUALIFY i < 40)
    SELECT item, round(sum(1.0 / (61 + i)), 9) AS score, min(list) AS first_list FROM lists GROUP BY item""")
@query("RET-20_multi_query", """
    WITH lists AS (SELECT vec_id AS item, 0 AS list, row_number() OVER (ORDER BY vec_id DESC) - 1 AS i FROM embeddings QUALIFY i < 40
        UNION ALL SELECT vec_id, 1, row_number() OVER (ORDER BY vec_id % 7, vec_id DESC) - 1 AS i FROM embeddings QUALIFY i < 40)
    SELECT item, round(sum(1.0 / (61 + i)), 9) AS score, min(list) AS first_list FROM lists GROUP BY item""")
def list_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.ranking import fuse_lists, stream

    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"))
    lists = [stream(held, 40, F.desc("item")), stream(held, 40, F.col("item") % 7, F.desc("item"))]
    return fuse_lists(lists).select("item", F.round("score", 9).alias("score"), "first_list")
