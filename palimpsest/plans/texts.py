"""Chunks, digests, scalar functions, redaction, compression, markdown and governance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.functions import scalars as S
from palimpsest.operators import compression, digests, store, vectors
from palimpsest.sources import markdown
from palimpsest.sources.conversation_store import messages, model_sql, sessions
from palimpsest.storage import materialize, table


@query("EMB-01_chunks", """
    SELECT doc_id, i AS seq, md5(substr(text, CAST(i * 5500 + 1 AS INTEGER), 6000)) AS chunk FROM documents, range(8) r(i)
    WHERE i = 0 OR i * 5500 < length(text) - 500""")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(vectors.chunks(F.col("text"))).alias("seq", "chunk"))
    return parts.select("doc_id", F.col("seq").cast("long").alias("seq"), F.md5(F.col("chunk").cast("binary")).alias("chunk"))


@query("EMB-02_backlog", """
    WITH pending AS (SELECT doc_id, sha1(text) AS hash FROM documents WHERE doc_id % 4 <> 0),
    done AS (SELECT DISTINCT sha1(text) AS hash FROM documents WHERE doc_id % 4 = 0)
    SELECT doc_id, CASE WHEN hash IN (SELECT hash FROM done) THEN 'copy' WHEN doc_id = min(doc_id) OVER (PARTITION BY hash) THEN 'embed' ELSE 'twin' END AS how FROM pending""")
def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to be embedded, what takes the vector of the same text, what waits for its twin."""
    held = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("hash"))
    done = held.filter("doc_id % 4 = 0").select("hash").distinct().withColumn("known", F.lit(True))
    pending = held.filter("doc_id % 4 <> 0")
    first = pending.groupBy("hash").agg(F.min("doc_id").alias("first"))
    how = F.when(F.col("known"), "copy").when(F.col("doc_id") == F.col("first"), "embed").otherwise("twin")
    return pending.join(first, "hash").join(done, "hash", "left").select("doc_id", how.alias("how"))


@query("EMB-03_chunk_keys", "SELECT count(*) AS chunks, count(DISTINCT doc_id) AS docs, count(*) FILTER (WHERE i > 0) AS further FROM documents, range(8) r(i) WHERE i = 0 OR i * 5500 < length(text) - 500")
def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(vectors.chunks(F.col("text"))).alias("seq", "chunk"))
    return parts.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("docs"), F.count_if(F.col("seq") > 0).alias("further"))


@query("EMB-04_index_identity", "SELECT len(embedding) AS dims, count(*) AS n, bool_and(len(embedding) = 64) AS usable FROM embeddings GROUP BY 1")
def index_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = F.size("embedding").cast("long")
    return table(spark, sf_dir, "embeddings").groupBy(dims.alias("dims")).agg(F.count("*").alias("n"), F.bool_and(F.size("embedding") == 64).alias("usable"))


@query("EMB-07_prune", model_sql("SELECT vec_id FROM embeddings WHERE vec_id * 250 + vec_id % 6 NOT IN (SELECT id FROM messages)"))
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "embeddings").withColumn("id", F.expr("vec_id * 250 + vec_id % 6"))
    return keyed.join(messages(spark, sf_dir), "id", "left_anti").select("vec_id")


@query("EMB-08_ship_keys", model_sql("SELECT session_id, coalesce(uuid, 'h:' || left(sha256(coalesce(timestamp, '') || chr(10) || content), 32)) AS mkey FROM messages"))
def ship_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = F.concat(F.lit("h:"), F.left(F.sha2(F.concat(F.coalesce("timestamp", F.lit("")), F.lit("\n"), "content"), 256), F.lit(32)))
    return messages(spark, sf_dir).select("session_id", F.coalesce("uuid", loose).alias("mkey"))


# Digests

_FLAT = r"trim(regexp_replace(content, '[\s\x{00a0}]+', ' ', 'g'))"
_CLIP = f"CASE WHEN length({_FLAT}) > #n THEN left({_FLAT}, #n) || '…' ELSE {_FLAT} END"
_PROSE = "role IN ('user', 'assistant') AND tool_name IS NULL AND content <> '' AND NOT starts_with(content, '[tool_')"
_DIGEST = f"""prose AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id) AS seq FROM messages WHERE {_PROSE}),
    tasks AS (SELECT session_id, list(id ORDER BY timestamp, id) AS task_ids, string_agg(c, chr(10) ORDER BY timestamp, id) AS tasks FROM (
        SELECT *, {_CLIP.replace('#n', '160')} AS c, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id) AS nth FROM prose WHERE role = 'user') WHERE nth <= 8 GROUP BY session_id),
    dec AS (SELECT session_id, list(id ORDER BY timestamp, id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id) AS nth FROM prose
        WHERE regexp_matches(content, '(?i)\\b(chot|decide[dr]?|use\\b|drop\\b|chon)\\b')) WHERE nth <= 6 GROUP BY session_id),
    last2 AS (SELECT session_id, string_agg({_CLIP.replace('#n', '200')}, ' ⋯ ' ORDER BY seq) AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS b FROM prose) WHERE b <= 2 GROUP BY session_id)"""


@query("EXT-01_digests", model_sql("""
    SELECT s.id AS session_id, coalesce(t.task_ids, []) AS task_ids, coalesce(d.ids, []) AS decision_ids, coalesce(l.outcome, '') AS outcome,
           concat_ws(chr(10), nullif(t.tasks, '')) AS task_text FROM sessions s LEFT JOIN tasks t ON s.id = t.session_id LEFT JOIN dec d ON d.session_id = s.id LEFT JOIN last2 l ON l.session_id = s.id""", _DIGEST))
@query("AGG-20_digests", model_sql("""
    SELECT s.id AS session_id, coalesce(t.task_ids, []) AS task_ids, coalesce(d.ids, []) AS decision_ids, coalesce(l.outcome, '') AS outcome,
           concat_ws(chr(10), nullif(t.tasks, '')) AS task_text FROM sessions s LEFT JOIN tasks t ON s.id = t.session_id LEFT JOIN dec d ON d.session_id = s.id LEFT JOIN last2 l ON l.session_id = s.id""", _DIGEST))
@query("WIN-04_first_of_session", model_sql("""
    SELECT s.id AS session_id, coalesce(t.task_ids, []) AS task_ids, coalesce(d.ids, []) AS decision_ids, coalesce(l.outcome, '') AS outcome,
           concat_ws(chr(10), nullif(t.tasks, '')) AS task_text FROM sessions s LEFT JOIN tasks t ON s.id = t.session_id LEFT JOIN dec d ON d.session_id = s.id LEFT JOIN last2 l ON l.session_id = s.id""", _DIGEST))
def session_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digests.build(messages(spark, sf_dir), sessions(spark, sf_dir))
    ids = lambda c: F.transform(c, lambda x: x["id"])
    return found.select(
        "session_id", ids("tasks").alias("task_ids"), ids("decisions").alias("decision_ids"), "outcome",
        F.array_join(F.transform("tasks", lambda x: x["text"]), "\n").alias("task_text"),
    )


@query("WIN-05_outcome", model_sql("SELECT session_id, outcome FROM last2", _DIGEST))
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.build(messages(spark, sf_dir), sessions(spark, sf_dir)).filter("outcome <> ''").select("session_id", "outcome")


@query("EXT-02_digest_signature", model_sql("SELECT session_id, 'v4:' || count(*) || ':' || arg_max(id, (timestamp, id)) || ':' || max(timestamp) AS source_sig FROM messages GROUP BY session_id"))
def digest_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.signatures(messages(spark, sf_dir))


@query("EXT-05_stale_digests", model_sql("SELECT DISTINCT session_id FROM messages WHERE conv_id % 3 = 0 OR (conv_id % 3 = 2 AND turn = 4)"))
def stale_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the first third have no digest, those of the last were digested before their fifth turn came."""
    held = messages(spark, sf_dir)
    old = digests.signatures(held.filter("conv_id % 3 = 1 or (conv_id % 3 = 2 and turn <> 4)")).withColumn("kind", F.lit("extractive"))
    return digests.stale(held, old)


_PATHS = "SELECT doc_id, 'see /srv/data' || (doc_id % 50) || '/file' || (doc_id % 7) || '.txt now, then.' AS t FROM documents"


@query("EXT-03_clean_path", f"SELECT doc_id, '/srv/data' || (doc_id % 50) || '/file' || (doc_id % 7) || '.txt' AS path FROM ({_PATHS})")
def clean_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("/srv/data"), F.col("doc_id") % 50, F.lit("/file"), F.col("doc_id") % 7, F.lit(".txt now, then."))
    return table(spark, sf_dir, "documents").select("doc_id", S.clean_path(raw).alias("path"))


@query("EXT-04_paths_in_text", "SELECT DISTINCT '/srv/data' || (doc_id % 50) || '/file' || (doc_id % 7) || '.txt' AS path FROM documents")
def paths_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see /srv/data"), F.col("doc_id") % 50, F.lit("/file"), F.col("doc_id") % 7, F.lit(".txt (and a/b/c)"))
    return table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(text, F.lit(S.PATH), F.lit(0))).alias("path")).distinct()


# Scalars

_SECRET = "text || ' AKIA' || upper(left(md5(CAST(doc_id AS VARCHAR)), 16)) || ' Bearer ' || md5(text) || ' pw: password = \"' || left(md5(text), 12) || '\" x'"
_REDACTED = rf"""regexp_replace(regexp_replace(regexp_replace({_SECRET}, 'AKIA[0-9A-Z]{{16}}', '[REDACTED]', 'g'), '(\b[Bb]earer\s)[A-Za-z0-9._~+/=-]{{20,}}', '\1[REDACTED]', 'g'),
    '(?i)(\b(?:password|secret|api[_-]?key)["'']?\s*[:=]\s*["''])[^"''\n]{{6,}}(["''])', '\1[REDACTED]\2', 'g')"""


def _with_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    md5 = F.md5(F.col("text").cast("binary"))
    key = F.upper(F.left(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(16)))
    text = F.concat("text", F.lit(" AKIA"), key, F.lit(" Bearer "), md5, F.lit(' pw: password = "'), F.left(md5, F.lit(12)), F.lit('" x'))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query("SCL-01_redact", f"SELECT doc_id, md5({_REDACTED}) AS redacted FROM documents")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_secrets(spark, sf_dir).select("doc_id", F.md5(S.redact(F.col("text")).cast("binary")).alias("redacted"))


@query("PRV-02_re_redact", f"SELECT count(*) AS scanned, count(*) FILTER (WHERE {_REDACTED} <> {_SECRET}) AS changed FROM documents")
def re_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_secrets(spark, sf_dir).agg(F.count("*").alias("scanned"), F.count_if(S.redact(F.col("text")) != F.col("text")).alias("changed"))


@query("SCL-02_slug", r"SELECT doc_id, left(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM documents")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.slug(F.col("text")).alias("slug"))


@query("SCL-03_edge_id", "SELECT DISTINCT left(sha1(l_partkey || '|' || l_suppkey || '|supplies|' || l_returnflag), 12) AS eid FROM lineitem")
def edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = S.edge_id(F.col("l_partkey"), F.col("l_suppkey"), F.lit("supplies"), F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select(eid.alias("eid")).distinct()


@query("SCL-04_content_keys", "SELECT doc_id, sha1(text) AS content_key, sha256(text) AS sha256 FROM documents")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("content_key"), F.sha2("text", 256).alias("sha256"))


@query("SCL-05_source_signature", """
    WITH leaf AS (SELECT lang, sha256(concat_ws(':', source, doc_id)) AS d FROM documents),
    six AS (SELECT lang, left(d, 6) AS six, count(*) AS n, sha256(string_agg(d, chr(10) ORDER BY d)) AS h FROM leaf GROUP BY ALL),
    four AS (SELECT lang, left(six, 4) AS four, sum(n) AS n, sha256(string_agg(six || ':' || h, chr(10) ORDER BY six)) AS h FROM six GROUP BY ALL),
    two AS (SELECT lang, left(four, 2) AS two, sum(n) AS n, sha256(string_agg(four || ':' || h, chr(10) ORDER BY four)) AS h FROM four GROUP BY ALL)
    SELECT lang, CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(two || ':' || h, chr(10) ORDER BY two)) AS signature FROM two GROUP BY lang""")
def source_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent of the order in which files are listed: a tree of digests over all digests of the files, whole and sorted.

    Digests meet by their first six digits, and their groups' digests by four, by two and by language: a group has 256 parts at most.
    """
    digest = F.sha2(F.concat_ws(":", "source", "doc_id"), 256)
    joined = lambda part: F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "\n"), 256).alias("h")
    held = table(spark, sf_dir, "documents").select("lang", digest.alias("d"))
    held = held.groupBy("lang", F.left("d", F.lit(6)).alias("p")).agg(F.count("*").alias("n"), joined("d"))
    for digits in (4, 2):
        held = held.groupBy("lang", F.left("p", F.lit(digits)).alias("q")).agg(F.sum("n").alias("n"), joined(F.concat_ws(":", "p", "h"))).withColumnRenamed("q", "p")
    return held.groupBy("lang").agg(F.sum("n").alias("files"), joined(F.concat_ws(":", "p", "h"))).withColumnRenamed("h", "signature")


@query("SCL-07_least_greatest", model_sql("SELECT id, least(started_at, ended_at) AS lo, greatest(started_at, ended_at) AS hi FROM sessions"))
def least_greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).select("id", F.least("started_at", "ended_at").alias("lo"), F.greatest("started_at", "ended_at").alias("hi"))


@query("SCL-08_lane_keys", model_sql("SELECT DISTINCT coalesce(origin, 'local') || '/' || coalesce(host, '') || '/' || source AS lane FROM sessions"))
def lane_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lane = F.concat_ws("/", F.coalesce("origin", F.lit("local")), F.coalesce("host", F.lit("")), "source")
    return sessions(spark, sf_dir).select(lane.alias("lane")).distinct()


@query("SCL-09_safe_names", r"SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 80) || '.html' AS name FROM pages")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.left(F.regexp_replace("url", F.lit("[^A-Za-z0-9._-]+"), F.lit("_")), F.lit(80))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(name, F.lit(".html")).alias("name"))


@query("SCL-10_links", r"SELECT page_id, unnest(regexp_extract_all(html, 'href=[\x22'']([^\x22''#]+)', 1)) AS target FROM pages")
@query("GRF-08_page_links", r"SELECT page_id, unnest(regexp_extract_all(html, 'href=[\x22'']([^\x22''#]+)', 1)) AS target FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("href=[\"']([^\"'#]+)"), F.lit(1))).alias("target"))


@query("SCL-11_sentences", r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS sentences FROM documents")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: s != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("sentences"))


@query("SCL-12_json_fallback", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(CASE WHEN event_id % 50 = 0 THEN '{}' ELSE props END, '$.k') AS BIGINT), -1) AS k FROM events")
def json_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(F.col("props"))
    k = F.coalesce(F.from_json(raw, "k long")["k"], F.lit(-1))
    return table(spark, sf_dir, "events").select("event_id", k.cast("long").alias("k"))


@query("SCL-13_day_and_epoch", model_sql("SELECT id, left(timestamp, 10) AS day, CAST(epoch(CAST(timestamp AS TIMESTAMP)) AS BIGINT) AS seconds FROM messages"))
def day_and_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", F.left("timestamp", F.lit(10)).alias("day"), S.epoch(F.col("timestamp")).alias("seconds"))


# Compression and artifacts


# Tool output made of 300 orders each: some of it noise, repeats and blanks, and errors in every third.
_OUTPUT = """output AS (SELECT id, string_agg(CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'same line' WHEN 2 THEN 'same line' WHEN 3 THEN '/-\\' WHEN 4 THEN 'Fetching pack 40 %'
        WHEN 5 THEN chr(27) || '[31mred ' || o_orderkey || chr(27) || '[0m  ' WHEN 6 THEN CASE WHEN id % 3 = 0 THEN 'ERROR at ' ELSE 'step ' END || o_orderkey ELSE o_orderpriority || ' ' || o_orderkey END, chr(10)
        ORDER BY o_orderkey) AS text FROM (SELECT o_orderkey // 300 AS id, o_orderkey, o_orderpriority FROM orders) GROUP BY 1)"""


def _compressed_sql(source: str) -> str:
    """The compression of (id, text) in DuckDB, as ``parts`` (id, pos, line, any_bad, part) and ``short`` (id, before, after, text)."""
    say = lambda shape: "'" + shape.replace("'", "''") + "'"
    ansi, error, progress, spinner = map(say, (compression.ANSI, compression.ERROR, compression.PROGRESS, compression.SPINNER))
    return f"""plain AS (SELECT id, string_split(regexp_replace(coalesce(text, ''), {ansi}, '', 'g'), chr(10)) AS lines FROM {source}),
    each AS (SELECT id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM plain),
    clean AS (SELECT id, pos, regexp_replace(replace(line, chr(13), ''), '[ \t]+$', '') AS line FROM each),
    useful AS (SELECT * FROM clean WHERE NOT regexp_matches(line, {progress}) AND NOT regexp_matches(line, {spinner})),
    blanks AS (SELECT *, lag(line) OVER (PARTITION BY id ORDER BY pos) AS last FROM useful),
    single AS (SELECT id, pos, line FROM blanks WHERE NOT (trim(line) = '' AND coalesce(trim(last) = '', false))),
    fresh AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY id ORDER BY pos) AND trim(line) <> '' THEN 0 ELSE 1 END AS f FROM single),
    numbered AS (SELECT *, sum(f) OVER (PARTITION BY id ORDER BY pos) AS run FROM fresh),
    runs AS (SELECT id, min(pos) AS pos, min(line) || CASE WHEN count(*) > 1 THEN '  (×' || count(*) || ')' ELSE '' END AS line FROM numbered GROUP BY id, run),
    placed AS (SELECT *, regexp_matches(line, {error}) AS bad, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth, count(*) OVER (PARTITION BY id) AS n,
        bool_or(regexp_matches(line, {error})) OVER (PARTITION BY id) AS any_bad FROM runs),
    sized AS (SELECT *, CASE WHEN any_bad THEN 30 ELSE 14 END AS head, CASE WHEN any_bad THEN 20 ELSE 8 END AS tail FROM placed),
    rough AS (SELECT *, CASE WHEN n <= 50 OR n <= head + tail THEN 'whole' WHEN nth <= head THEN 'head' WHEN nth > n - tail THEN 'tail' WHEN bad THEN 'error' ELSE 'omitted' END AS place FROM sized),
    parts AS (SELECT id, pos, line, any_bad, CASE WHEN place = 'error' AND count(*) FILTER (WHERE place = 'error') OVER (PARTITION BY id ORDER BY pos) > 60 THEN 'omitted' ELSE place END AS part FROM rough),
    pieces AS (SELECT id, CASE part WHEN 'error' THEN 2 WHEN 'tail' THEN 3 ELSE 0 END AS rank, pos, line FROM parts WHERE part <> 'omitted' UNION ALL
        SELECT id, 1, 0, '… [' || count(*) FILTER (WHERE part = 'omitted') || ' line(s) omitted' || CASE WHEN bool_or(any_bad) THEN '; error lines kept' ELSE '' END || '] …' FROM parts GROUP BY id HAVING bool_or(part = 'head')),
    joined AS (SELECT id, count(*) AS after, string_agg(line, chr(10) ORDER BY rank, pos) AS text FROM pieces GROUP BY id),
    short AS (SELECT id, len(lines) AS before, coalesce(after, 0) AS after, coalesce(text, '') AS text FROM plain LEFT JOIN joined USING (id))"""


def _output(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.expr("o_orderkey div 300")
    kinds = ["", "same line", "same line", "/-\\", "Fetching pack 40 %", F.concat(F.lit("\x1b[31mred "), k, F.lit("\x1b[0m  ")),
             F.concat(F.when(c % 3 == 0, "ERROR at ").otherwise("step "), k), F.concat("o_orderpriority", F.lit(" "), k)]
    line = F.lit(None).cast("string")
    for n, kind in enumerate(kinds):
        line = F.when(k % 8 == n, kind if isinstance(kind, Column) else F.lit(kind)).otherwise(line)
    lines = table(spark, sf_dir, "orders").groupBy(c.alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("held"))
    return lines.select("id", F.array_join(F.transform("held", lambda x: x["line"]), "\n").alias("text"))


@query("ATT-01_compress", f"""WITH {_compressed_sql("documents_")} SELECT id AS doc_id, before, after, CASE WHEN before > 0 THEN CAST(round((1 - after / before) * 100) AS BIGINT) ELSE 0 END AS saved_pct, sha256(text) AS text
    FROM short""".replace("WITH ", "WITH documents_ AS (SELECT doc_id AS id, text FROM documents), ", 1))
def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes before and after; short texts lose nothing but noise."""
    out = compression.compress(table(spark, sf_dir, "documents"), "doc_id", "text")
    saved = F.when(F.col("before") > 0, F.round((1 - F.col("after") / F.col("before")) * 100)).otherwise(0)
    return out.select(F.col("key").alias("doc_id"), "before", "after", saved.cast("long").alias("saved_pct"), F.sha2("text", 256).alias("text"))


@query("WIN-08_head_and_tail", f"WITH {_OUTPUT}, {_compressed_sql('output')} SELECT id, part, count(*) AS lines, min(pos) AS first, max(pos) AS last FROM parts GROUP BY ALL")
def head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of long outputs lie in each part of the window, and where."""
    raw = _output(spark, sf_dir).withColumn("text", F.regexp_replace("text", F.lit(compression.ANSI), F.lit("")))
    return compression.windows(raw, "id", "text").groupBy(F.col("key").alias("id"), "part").agg(
        F.count("*").alias("lines"), F.min("pos").cast("long").alias("first"), F.max("pos").cast("long").alias("last")
    )


@query("EVL-04_compression_replay", f"""WITH {_OUTPUT}, {_compressed_sql('output')}, both_ AS (SELECT id, o.text AS long, s.text AS short,
        ['same line', 'ERROR at ' || (id * 300 + 6), '5-LOW'] AS signals FROM output o JOIN short s USING (id))
    SELECT id AS key, CAST(round((1 - length(short) / length(long)) * 100) AS BIGINT) AS saved_chars_pct,
           CAST(round((1 - (CASE WHEN short = '' THEN 0 ELSE len(string_split(short, chr(10))) END) / len(string_split(long, chr(10)))) * 100) AS BIGINT) AS saved_lines_pct,
           CAST(greatest(0, ceil(length(long) / 4) - ceil(length(short) / 4)) AS BIGINT) AS tokens_avoided,
           len(list_filter(signals, lambda s: NOT contains(short, s))) = 0 AS signals_kept, list_filter(signals, lambda s: NOT contains(short, s)) AS missing FROM both_""")
def compression_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs with lines that must survive, a third of which hold an error."""
    signals = F.array(F.lit("same line"), F.concat(F.lit("ERROR at "), F.col("id") * 300 + 6), F.lit("5-LOW"))
    return compression.replay(_output(spark, sf_dir).withColumn("signals", signals), "id", "text", "signals")


@query("ATT-02_envelope", "SELECT doc_id, 'artifact ' || left(sha256(text), 12) || chr(10) || len(string_split(text, chr(10))) || ' lines, ' || octet_length(encode(text)) || ' bytes' AS card FROM documents")
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.concat(F.size(F.split("text", "\n")), F.lit(" lines, "), F.octet_length("text"), F.lit(" bytes"))
    card = F.concat_ws("\n", F.concat(F.lit("artifact "), F.left(F.sha2("text", 256), F.lit(12))), size)
    return table(spark, sf_dir, "documents").select("doc_id", card.alias("card"))


@query("ATT-03_retention", """
    WITH a AS (SELECT sha256(text) AS sha256, max(doc_id) AS newest, bool_or(doc_id % 50 = 0) AS pinned, max(octet_length(encode(text))) AS bytes FROM documents GROUP BY 1)
    SELECT sha256, CASE WHEN pinned THEN 'keep' WHEN newest < 200 THEN 'archive' ELSE 'keep' END AS fate,
           sum(bytes) OVER (PARTITION BY newest % 64 ORDER BY newest, sha256 ROWS UNBOUNDED PRECEDING) > 20000 AS over_quota FROM a""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned artifacts stay, old ones are archived; quotas are per shard, so no task holds them all."""
    held = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(
        F.max("doc_id").alias("newest"), F.bool_or(F.col("doc_id") % 50 == 0).alias("pinned"), F.max(F.octet_length("text")).alias("bytes")
    )
    fate = F.when(~F.col("pinned") & (F.col("newest") < 200), "archive").otherwise("keep")
    order = Window.partitionBy(F.col("newest") % 64).orderBy("newest", "sha256").rowsBetween(Window.unboundedPreceding, 0)
    return held.select("sha256", fate.alias("fate"), (F.sum("bytes").over(order) > 20_000).alias("over_quota"))


@query("SNK-16_artifact_index")
def artifact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of every artifact, one artifact for each content."""
    held = table(spark, sf_dir, "documents").select("text").distinct()
    lines = held.select(F.sha2("text", 256).alias("sha256"), F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return lines.select("sha256", F.col("ordinal").cast("long").alias("ordinal"), S.redact(F.col("line")).alias("line"))


# Markdown


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown file for each page: headings, a fence, links and a check list."""
    p = F.col("page_id")
    text = F.concat(
        F.lit("intro "), p, F.lit("\n# Page "), p, F.lit("\nbody [x](other"), p % 7, F.lit(".md#a)\n```\n# not a heading\n```\n## Part A\na\n### Deep\nd\n## Part B\n- [x] done "), p,
        F.lit("\n  more\n- [~] doing\n- [ ] open "), p % 3, F.lit("\n"),
    )
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"))


_SECTIONS = """sections AS (SELECT page_id, ordinal, level, heading, anchor FROM pages, (VALUES (0, 0, NULL, NULL), (1, 1, 'Page ', 'page-'), (2, 2, 'Part A', 'part-a'), (3, 3, 'Deep', 'deep'), (4, 2, 'Part B', 'part-b')) v(ordinal, level, heading, anchor))"""


@query("SRC-12_markdown", f"WITH {_SECTIONS} SELECT page_id, ordinal, level, CASE WHEN ordinal = 1 THEN heading || page_id ELSE heading END AS heading, CASE WHEN ordinal = 1 THEN anchor || page_id ELSE anchor END AS anchor FROM sections")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.sections(_notes(spark, sf_dir), "page_id", "text").select(F.col("key").alias("page_id"), "ordinal", "level", "heading", "anchor")


@query("WIN-09_parents", f"WITH {_SECTIONS} SELECT page_id, ordinal, CASE ordinal WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1 END AS parent FROM sections")
@query("SNK-06_doc_sections", f"WITH {_SECTIONS} SELECT page_id, ordinal, CASE ordinal WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1 END AS parent FROM sections")
def section_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.with_parents(markdown.sections(_notes(spark, sf_dir), "page_id", "text")).select(F.col("key").alias("page_id"), "ordinal", "parent")


@query("SNK-12_round_trip", "SELECT page_id, true AS same FROM pages")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _notes(spark, sf_dir)
    back = markdown.render(markdown.sections(notes, "page_id", "text")).withColumnRenamed("text", "back")
    return notes.join(back, notes["page_id"] == back["key"]).select("page_id", (F.col("text") == F.col("back")).alias("same"))


@query("GOV-06_toc", f"WITH {_SECTIONS} SELECT page_id, count(*) AS sections, string_agg(repeat('  ', level - 1) || heading || CASE WHEN ordinal = 1 THEN CAST(page_id AS VARCHAR) ELSE '' END, chr(10) ORDER BY ordinal) FILTER (WHERE level > 0) AS toc FROM sections GROUP BY page_id")
def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = markdown.sections(_notes(spark, sf_dir), "page_id", "text")
    line = F.when(F.col("level") > 0, F.struct("ordinal", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "heading").alias("t")))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"])
    return held.groupBy(F.col("key").alias("page_id")).agg(F.count("*").alias("sections"), F.array_join(lines, "\n").alias("toc"))


@query("SRC-14_backlog", "SELECT page_id, line, status, CASE WHEN status = 'done' THEN 'done ' || page_id WHEN status = 'doing' THEN 'doing' ELSE 'open ' || page_id % 3 END AS title FROM pages, (VALUES (12, 'done'), (14, 'doing'), (15, 'open')) v(line, status)")
def backlog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.items(_notes(spark, sf_dir), "page_id", "text").select(F.col("key").alias("page_id"), F.col("line").cast("int").alias("line"), "status", "title")


@query("GOV-01_broken_links", "SELECT page_id, 'other' || (page_id % 7) || '.md' AS target FROM pages WHERE page_id % 7 NOT IN (0, 1, 2)")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = spark.createDataFrame([(f"other{i}.md",) for i in range(3)], "target string")
    found = markdown.links(_notes(spark, sf_dir), "page_id", "text").join(there, "target", "left_anti")
    return found.select(F.col("key").alias("page_id"), "target")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    text = F.concat(
        F.lit("# Change Log\n## [2024-01-"), F.lpad((p % 28 + 1).cast("string"), 2, "0"), F.lit("] — entry "), p,
        F.lit("\nbody\n## inner\n## 2024-02-01b — second\nsupersedes it\n\n"),
    )
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"))


@query("SRC-13_changelog", """
    SELECT page_id, 0 AS nth, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS date, 'entry ' || page_id AS title, 'body' || chr(10) || '## inner' AS body FROM pages
    UNION ALL SELECT page_id, 1, '2024-02-01b', 'second', 'supersedes it' FROM pages""")
def changelog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.changelog(_log(spark, sf_dir), "page_id", "text").select(F.col("key").alias("page_id"), F.col("nth").cast("int").alias("nth"), "date", "title", "body")


@query("SNK-07_changelog_import", "SELECT page_id, 1 AS new_entries FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 2 FROM pages WHERE page_id % 2 = 1")
def changelog_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert if absent: of even pages the first entry is known already."""
    fresh = markdown.changelog(_log(spark, sf_dir), "page_id", "text").alias("f")
    held = fresh.filter("key % 2 = 0 and nth = 0").select("key", "date", "title").alias("h")
    same = (F.col("f.key") == F.col("h.key")) & F.col("f.date").eqNullSafe(F.col("h.date")) & (F.col("f.title") == F.col("h.title"))
    return fresh.join(held, same, "left_anti").groupBy(F.col("key").alias("page_id")).agg(F.count("*").cast("int").alias("new_entries"))


@query("GRF-09_supersede_links", """
    WITH e AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE)::VARCHAR AS date, o_custkey % 40 AS project FROM orders),
    refs AS (SELECT id, project, date, CAST(CAST(date AS DATE) - 3 AS VARCHAR) AS target FROM e WHERE id % 5 = 0)
    SELECT r.id, any_value(t.id) AS supersedes FROM refs r JOIN e t ON t.project = r.project AND t.date = r.target GROUP BY r.id HAVING count(*) = 1""")
def supersede_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date names an entry only where it is the project's only one of that day."""
    held = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_custkey") % 40).alias("project"))
    single = held.groupBy("project", "date").agg(F.count("*").alias("n"), F.min("id").alias("supersedes")).filter("n = 1")
    refs = held.filter("id % 5 = 0").select("id", "project", F.date_sub("date", 3).alias("date"))
    return refs.join(single, ["project", "date"]).select("id", "supersedes")


# Merging, forgetting and writing


@query("MRG-03_delta", model_sql("""
    SELECT m.session_id, count(*) AS n, min(m.id) AS first_id FROM messages m JOIN sessions s ON m.session_id = s.id
    WHERE m.id > 30000 AND NOT (coalesce(s.origin, 'local') = 'web') GROUP BY 1"""))
@query("SNK-08_delta_export", model_sql("""
    SELECT m.session_id, count(*) AS n, min(m.id) AS first_id FROM messages m JOIN sessions s ON m.session_id = s.id
    WHERE m.id > 30000 AND NOT (coalesce(s.origin, 'local') = 'web') GROUP BY 1"""))
def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = store.delta(messages(spark, sf_dir), sessions(spark, sf_dir), 30_000, S.in_any_lane([{"origin": "web"}]))
    return rows.groupBy("session_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("MRG-04_watermark", model_sql("SELECT conv_id % 4 AS bundle, max(id) AS last_message_id, count(*) AS n FROM messages GROUP BY 1"))
def watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy((F.col("conv_id") % 4).alias("bundle")).agg(F.max("id").alias("last_message_id"), F.count("*").alias("n"))


@query("STR-05_watermark", model_sql(
    "SELECT bundle, max(id) AS last_message_id, count(*) FILTER (WHERE id > coalesce(held, -1)) AS n FROM keyed GROUP BY 1",
    "keyed AS (SELECT conv_id % 4 AS bundle, id, max(id) FILTER (WHERE id % 3 = 1) OVER (PARTITION BY conv_id % 4) AS held FROM messages)"))
def advanced_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watermark is stored after each of three exports; the second is an old one, and the last takes what lies above it."""
    rows = messages(spark, sf_dir).select((F.col("conv_id") % 4).alias("bundle"), "id")
    exported = lambda some, pick: some.groupBy("bundle").agg(pick("id").alias("last_message_id"))
    held = materialize(exported(rows.filter("id % 3 = 1"), F.max), "watermark")
    held = materialize(store.advance(held, exported(rows.filter("id % 3 = 1"), F.min)), "watermark")
    above = rows.join(held, "bundle", "left").filter(F.col("id") > F.coalesce("last_message_id", F.lit(-1))).select("bundle", "id")
    after = materialize(store.advance(held, exported(above, F.max)), "watermark")
    counts = above.groupBy("bundle").agg(F.count("*").alias("n"))
    return after.join(counts, "bundle", "left").select("bundle", "last_message_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("MRG-06_repoint", model_sql(
    "SELECT id, target AS project_root, true AS project_pinned FROM keyed JOIN lead USING (key) WHERE project_root <> target",
    r"keyed AS (SELECT id, project_root, project_pinned, regexp_replace(lower(replace(project_root, '\', '/')), '/+$', '') AS key FROM sessions WHERE project_root <> '')",
    "lead AS (SELECT key, arg_max(project_root, (n, project_root)) AS target FROM (SELECT key, project_root, count(*) AS n FROM keyed GROUP BY ALL) GROUP BY key)"))
def repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that move to the leading spelling of their project, pinned there."""
    held = sessions(spark, sf_dir).filter("project_root <> ''").withColumn("key", S.project_key(F.col("project_root")))
    lead = store.spellings(sessions(spark, sf_dir)).select("key", "lead")
    return held.join(lead, "key").filter(F.col("project_root") != F.col("lead")).select("id", F.col("lead").alias("project_root"), F.lit(True).alias("project_pinned"))


@query("MRG-07_lane_snapshot", model_sql("SELECT m.id FROM messages m JOIN sessions s ON m.session_id = s.id WHERE s.source <> 'agent2'"))
def lane_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = sessions(spark, sf_dir).filter(S.in_any_lane([{"source": "agent2"}])).select(F.col("id").alias("session_id"))
    return messages(spark, sf_dir).join(gone, "session_id", "left_anti").select("id")


@query("MRG-08_retire", model_sql("""
    SELECT conv_id % 5 AS machine, bool_and(turn < 7) AND max(id) <= 90000 AS retire FROM messages GROUP BY 1"""))
def retire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine's bundles go when all of them are merged here and the watermark has passed them."""
    return messages(spark, sf_dir).groupBy((F.col("conv_id") % 5).alias("machine")).agg((F.bool_and(F.col("turn") < 7) & (F.max("id") <= 90_000)).alias("retire"))


@query("MRG-09_reconcile", model_sql("SELECT s.id, count(m.id) AS message_count FROM sessions s LEFT JOIN (SELECT * FROM messages WHERE id % 7 <> 0) m ON m.session_id = s.id GROUP BY s.id"))
@query("SNK-17_reconcile", model_sql("SELECT s.id, count(m.id) AS message_count FROM sessions s LEFT JOIN (SELECT * FROM messages WHERE id % 7 <> 0) m ON m.session_id = s.id GROUP BY s.id"))
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = store.session_spans(messages(spark, sf_dir).filter("id % 7 <> 0")).select(F.col("session_id").alias("id"), "n")
    return sessions(spark, sf_dir).select("id").join(spans, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("message_count"))


@query("SNK-17_repair", model_sql("""
    SELECT s.id, s.message_count, EXISTS (SELECT 1 FROM messages m WHERE m.session_id = s.id AND m.id % 7 = 0) AS reopened,
           (SELECT count(*) FROM messages m WHERE m.session_id = s.id AND m.id % 7 = 0) AS read_again FROM sessions s"""))
def repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that has lost every seventh message: files of sessions with a gap are reopened, read again, and the counts set right."""
    whole, held = messages(spark, sf_dir), sessions(spark, sf_dir)
    left = materialize(whole.filter("id % 7 <> 0"), "damaged")
    per_file = whole.groupBy("session_id").agg(F.count("*").alias("last_line")).select(F.concat("session_id", F.lit(".jsonl")).alias("file_path"), "session_id", "last_line", F.lit("v1").alias("parser"))
    offsets = store.reopened(per_file, held, left)
    again = whole.join(offsets.filter("last_line = 0").select("session_id"), "session_id", "left_semi")
    # identifiers are the store's own, so lines without uuid are known by content
    fresh = materialize(store.new_messages(left, again.select(left.columns), by_content=True), "read-again")
    fixed = store.reconciled(held.withColumn("message_count", F.lit(-1).cast("long")), left.unionByName(fresh))
    counts = fresh.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("read_again"))
    opened = offsets.select(F.col("session_id").alias("id"), (F.col("last_line") == 0).alias("reopened"))
    return fixed.select("id", "message_count").join(opened, "id").join(counts, "id", "left").select("id", "message_count", "reopened", F.coalesce("read_again", F.lit(0)).alias("read_again"))


@query("MRG-10_prune_missing", "SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def prune_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "pages").select("page_id", "url")
    there = held.filter("page_id % 3 <> 0").select("url")
    return held.join(there, "url", "left_semi").select("page_id")


@query("PRV-01_forget_preview", model_sql("""
    SELECT (SELECT count(*) FROM gone) AS messages, (SELECT count(DISTINCT session_id) FROM gone) AS sessions,
           (SELECT count(*) FROM sessions s WHERE id IN (SELECT session_id FROM gone) AND NOT EXISTS (SELECT 1 FROM messages m WHERE m.session_id = s.id AND m.id NOT IN (SELECT id FROM gone))) AS emptied,
           (SELECT count(*) FROM links WHERE message_id IN (SELECT id FROM gone)) AS links""",
    "gone AS (SELECT m.id, m.session_id FROM messages m JOIN sessions s ON m.session_id = s.id WHERE s.source = 'agent2' AND coalesce(m.timestamp, s.ended_at, s.started_at, '') < '2024-02-01')"))
def forget_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.sources.conversation_store import links

    held = messages(spark, sf_dir)
    gone = store.forgotten(held, sessions(spark, sf_dir), store.forget_selector(source="agent2", before="2024-02-01")).select("id", "session_id")
    left = held.join(gone, "id", "left_anti").select("session_id")
    emptied = gone.select("session_id").distinct().join(left, "session_id", "left_anti").agg(F.count("*").alias("emptied"))
    cut = links(spark, sf_dir).join(gone, F.col("message_id") == F.col("id"), "left_semi").agg(F.count("*").alias("links"))
    return gone.agg(F.count("*").alias("messages"), F.count_distinct("session_id").alias("sessions")).crossJoin(emptied).crossJoin(cut)  # single rows


@query("SNK-01_session_upsert", model_sql("""
    SELECT s.id, CASE WHEN CAST(substr(s.id, 2) AS BIGINT) % 2 = 0 THEN 'new' ELSE s.source END AS source,
           CASE WHEN CAST(substr(s.id, 2) AS BIGINT) % 2 = 0 AND NOT project_pinned THEN '/moved' ELSE project_root END AS project_root, title
    FROM sessions s UNION ALL SELECT 'fresh', 'new', '/moved', NULL"""))
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even sessions come again without a title and in another place; one is new."""
    held = sessions(spark, sf_dir).drop("pinned", "started_at", "ended_at", "message_count")
    moved = [F.lit("new").alias("source"), "origin", "host", F.lit("/moved").alias("project_root"), F.lit(False).alias("project_pinned"), "cwd", F.lit(None).cast("string").alias("title")]
    batch = held.filter(F.substring("id", 2, 20).cast("long") % 2 == 0).select("id", *moved)
    fresh = spark.range(1).select(F.lit("fresh").alias("id"), F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("cwd"))
    return store.upsert_sessions(held, batch.unionByName(fresh.select("id", *moved))).select("id", "source", "project_root", "title")


@query("SNK-02_message_insert", model_sql("""
    SELECT session_id, count(*) AS n FROM (SELECT session_id FROM messages UNION ALL SELECT session_id FROM messages WHERE id % 3 = 0 AND uuid IS NULL) GROUP BY 1"""))
def message_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a uuid come once, rows without one always."""
    held = messages(spark, sf_dir).select("id", "session_id", "uuid", "role", "content", "timestamp")
    return store.insert_messages(held, held.filter("id % 3 = 0")).groupBy("session_id").agg(F.count("*").alias("n"))


@query("SNK-04_attachment_write", model_sql("SELECT a.sha256, count(l.message_id) AS links FROM attachments a JOIN links l ON l.attachment_id = a.id GROUP BY 1"))
def attachment_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content once for each digest, one link for each message and name."""
    from palimpsest.sources.conversation_store import attachments, links

    incoming = links(spark, sf_dir).join(attachments(spark, sf_dir).select(F.col("id").alias("attachment_id"), "sha256"), "attachment_id")
    stored = incoming.select("sha256").dropDuplicates(["sha256"])
    return stored.join(incoming, "sha256").groupBy("sha256").agg(F.count("*").alias("links"))


@query("SNK-11_rotation", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5 AS keep FROM orders")
def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest of each owner stay."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.row_number().over(order) <= 5).alias("keep"))


@query("SNK-14_history_append", "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row is appended only where the signature differs from the last one."""
    last = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("last", last).filter(~F.col("last").eqNullSafe(F.col("event_type"))).select("user_id", "event_id")
