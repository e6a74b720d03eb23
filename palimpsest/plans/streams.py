"""Streaming queries over ``events`` and ``conversations``, and what is written along the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.functions import scalars as S
from palimpsest.operators import retrieval, store, sync
from palimpsest.sources.conversation_store import messages, model_sql, sessions
from palimpsest.plans.ingest import log_a
from palimpsest.storage import materialize, new_path, table
from palimpsest.streaming import ingest as I
from palimpsest.streaming import transcripts
from palimpsest.streaming.session_store import scratch_store


def _last_state(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest batch of a state table."""
    held = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path).withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "/([0-9]{8})/", 1))
    last = held.agg(F.max("batch").alias("last"))
    return held.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("batch", "last")  # one row


def _write_transcripts(rows: DataFrame, folder: str) -> None:
    """A file of log A for each conversation, line after line from the tasks; ``rows`` has path, line_no, value and half.

    A line of which only half is there yet has no line break. Files are written anew as a whole, as a host's would be
    after a restore; that they begin with what was there before is what the reader finds out.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        at, out, lines = None, None, 0
        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{inner}/log-a", recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != at:
                    if out:
                        out.close()
                    at, out = row["path"], system.open_output_stream(f"{inner}/log-a/{row['path']}.jsonl")
                data = row["value"].encode()
                out.write(data[: len(data) // 2] if row["half"] else data + b"\n")
                lines += 1
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"lines": [lines]})

    written = rows.repartition("path").sortWithinPartitions("path", "line_no").mapInArrow(run, "lines long")
    written.agg(F.sum("lines")).collect()  # one row: the writing is what counts


def _by_session(held: DataFrame) -> DataFrame:
    return held.groupBy("session_id").agg(F.count("*").alias("n"), F.count_distinct("content", "uuid").alias("different"), F.max("seq").isNotNull().alias("placed"))


# Of log A: turn 6 is no record; turn 3 a title; other messages are of user and assistant.
_STORED = """
    SELECT 'f' || conv_id AS session_id, count(*) AS n, count(DISTINCT CASE WHEN turn = 3 THEN NULL ELSE turn END) AS different, true AS placed
    FROM conversations WHERE turn <> 6 AND (role IN ('user', 'assistant') OR turn = 3) AND (turn = 3 OR trim(text) <> '' OR turn % 2 = 1) AND {kept} GROUP BY 1"""


@query("STR-01_incremental_ingest", _STORED.replace("{kept}", "(conv_id % 10 <> 0 OR turn < 1)"))
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real files, three runs: they grow and end in half a line, every fifth is written anew with a line, every tenth stays so.

    Each run reads on where the last one ended, and every line is stored once.
    """
    rows = log_a(spark, sf_dir).withColumn("conv_id", F.substring("path", 2, 20).cast("long")).withColumn("turn", F.col("line_no") - 1)
    inbox, held = new_path(spark, "inbox"), scratch_store(spark)
    shrunk, always = F.col("conv_id") % 5 == 0, F.col("conv_id") % 10 == 0
    one = F.col("turn") < 1
    for there, half in (
        (F.col("turn") <= 3, F.col("turn") == 3),
        (F.when(shrunk, one).otherwise(F.col("turn") < 6), F.lit(False)),
        (F.when(always, one).otherwise(F.lit(True)), F.lit(False)),
    ):
        _write_transcripts(rows.filter(there).withColumn("half", half), inbox)
        transcripts.ingest_folder(held, inbox)
    held.compact()
    return _by_session(held.messages())


@query("STR-03_idempotent_replay", _STORED.replace("{kept}", "true"))
def idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files are read again by a source without progress: every message is known by its identifier, or by its content."""
    inbox, held = new_path(spark, "inbox"), scratch_store(spark)
    _write_transcripts(log_a(spark, sf_dir).withColumn("half", F.lit(False)), inbox)
    for source in ("first", "again", "again"):
        transcripts.ingest_folder(held, inbox, source=source)
    return _by_session(held.messages())


@query("STR-02_hook_events", _STORED.replace("{kept}", "conv_id % 3 = 1 AND (conv_id % 2 = 1 OR turn < 4)"))
def hook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events name every third conversation's file, once in the middle and, of every second of these, at the end; others are not read."""
    rows = log_a(spark, sf_dir).withColumn("conv_id", F.substring("path", 2, 20).cast("long"))
    inbox, events, held = new_path(spark, "inbox"), new_path(spark, "hook-events"), scratch_store(spark)
    at = rows.select("conv_id", "path").distinct().select(
        "conv_id", F.when(F.col("conv_id") % 3 == 1, "stop").otherwise("prompt").alias("kind"), F.concat(F.lit(f"{inbox}/log-a/"), "path", F.lit(".jsonl")).alias("path")
    )
    for there, told in ((F.col("line_no") <= 4, F.lit(True)), (F.lit(True), F.col("conv_id") % 2 == 1)):
        _write_transcripts(rows.filter(there).withColumn("half", F.lit(False)), inbox)
        at.filter(told).select("kind", "path").write.mode("append").json(events)
        stream = spark.readStream.schema("kind string, path string").option("maxFilesPerTrigger", 64).json(events)
        transcripts.ingest_hooks(held, stream)
    return _by_session(held.messages())


@query("STR-04_spans", "SELECT user_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY user_id")
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "spans")
    state = I.spans(I.file_stream(spark, f"{sf_dir}/events.parquet", files_per_trigger=1), "user_id", "ts")
    I.latest(state, path, "complete")
    return _last_state(spark, path, state.schema)


@query("STR-06_warnings", """
    WITH e AS (SELECT *, event_id % 13 = 0 AS boundary, sum(CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, cycle ORDER BY ts, event_id) AS nth FROM e WHERE NOT boundary AND value > 50)
    SELECT user_id AS key, event_id, value FROM f WHERE nth = 1""")
def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warnings")
    # what is there comes as one batch, as the order of time holds within a batch
    stream = I.file_stream(spark, f"{sf_dir}/events.parquet", files_per_trigger=None).select(F.col("user_id").alias("key"), F.col("ts").alias("at"), "event_id", "value", (F.col("event_id") % 13 == 0).alias("boundary"))
    I.warnings(stream, 50.0, path)
    return spark.read.option("recursiveFileLookup", True).schema(I.WARNED).parquet(f"{path}/warned")


@query("STR-07_learned_maximum", "SELECT event_type, max(value) AS learned FROM events GROUP BY event_type")
def learned_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "maximum")
    state = I.file_stream(spark, f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.max("value").alias("learned"))
    I.latest(state, path, "complete")
    return _last_state(spark, path, state.schema)


# Bundles and backups


def _bundles(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three overlapping bundles, written one by one."""
    rows = messages(spark, sf_dir).select("id", "session_id", "uuid", "role", "content", "timestamp")
    return [materialize(rows.filter(f"id % 3 = {i} or id % 7 = 0"), f"bundle-{i}") for i in range(3)]


@query("SRC-19_bundle_scan", model_sql("""
    SELECT chunk, count(*) AS messages, count(DISTINCT session_id) AS sessions, min(id) AS first_id, max(id) AS last_id
    FROM messages, range(0, 3) r(chunk) WHERE id % 3 = chunk OR id % 7 = 0 GROUP BY 1"""))
def bundle_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a bundle as a source: what each holds, and the identifiers that it spans."""
    chunks = [c.withColumn("chunk", F.lit(i).cast("long")) for i, c in enumerate(_bundles(spark, sf_dir))]
    held = chunks[0].unionByName(chunks[1]).unionByName(chunks[2])
    return held.groupBy("chunk").agg(
        F.count("*").alias("messages"), F.count_distinct("session_id").alias("sessions"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query("SNK-09_bundle_merge", model_sql("SELECT session_id, count(*) AS n FROM messages GROUP BY 1"))
@query("MRG-02_container_merge", model_sql("SELECT session_id, count(*) AS n FROM messages GROUP BY 1"))
def container_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping bundles are written, read back and merged in order."""
    chunks = _bundles(spark, sf_dir)
    merged = chunks[0]
    for more in chunks[1:]:
        merged = store.merge_stores(merged, more)
    return merged.groupBy("session_id").agg(F.count("*").alias("n"))


@query("SNK-10_backup_restore", model_sql("SELECT count(*) AS n, CAST(sum(message_count) AS BIGINT) AS messages FROM sessions"))
def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(sessions(spark, sf_dir), "backup").agg(F.count("*").alias("n"), F.sum("message_count").alias("messages"))


@query("SNK-10_restore", model_sql("""
    SELECT 'restored' AS name, count(*) AS n, CAST(sum(message_count) AS BIGINT) AS messages FROM sessions
    UNION ALL SELECT 'set aside', count(*), CAST(sum(message_count) AS BIGINT) FROM sessions WHERE host IS NOT NULL"""))
def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup of all sessions takes the place of a store that has lost some, by renames; what was there is kept."""
    whole, live, saved = sessions(spark, sf_dir), new_path(spark, "live"), new_path(spark, "backup")
    sync.backup(whole, saved)
    whole.filter("host is not null").write.parquet(live)
    aside = sync.restore(spark, saved, live, aside=f"{live}.kept")
    count = lambda name, path: spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("message_count").alias("messages"))
    return count("restored", live).unionByName(count("set aside", aside))


@query("MRG-05_folder_sync", model_sql("""
    SELECT * FROM (SELECT 1 AS step, 'a' AS machine, 0 AS merged, 0 AS skipped, 'baseline' AS kind, a AS pushed, a AS held FROM n
    UNION ALL SELECT 2, 'b', 1, 0, 'delta', a + b, a + b FROM n UNION ALL SELECT 3, 'a', 1, 1, 'delta', b, a + b FROM n
    UNION ALL SELECT 4, 'c', 3, 0, 'compact', a + b + c, a + b + c FROM n UNION ALL SELECT 5, 'a', 1, 0, 'delta', c, a + b + c FROM n
    UNION ALL SELECT 6, 'a', 0, 2, 'none', 0, a + b + c FROM n)""",
    "n AS (SELECT count(*) FILTER (WHERE conv_id % 3 = 0) AS a, count(*) FILTER (WHERE conv_id % 3 = 1) AS b, count(*) FILTER (WHERE conv_id % 3 = 2) AS c FROM messages)"))
def folder_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three machines, each with a third of the conversations, take turns at one folder that is folded at three chunks."""
    rows = messages(spark, sf_dir).select("id", "session_id", "uuid", "role", "content", "timestamp", "conv_id")
    machines = {m: sync.Machine.of(materialize(rows.filter(f"conv_id % 3 = {i}").drop("conv_id"), "machine")) for i, m in enumerate("abc")}
    folder, out = new_path(spark, "sync-folder"), []
    for step, m in enumerate("abacaa", 1):
        done = sync.sync_folder(machines[m], folder, m, most_chunks=3)
        machines[m] = done.machine
        out.append((step, m, done.merged, done.skipped, done.kind, done.pushed, done.machine.messages.count()))
    return spark.createDataFrame(out, "step int, machine string, merged int, skipped int, kind string, pushed long, held long")


@query("SNK-15_move_store", model_sql("SELECT 'messages' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS checked FROM messages UNION ALL SELECT 'sessions', count(*), CAST(sum(message_count) AS BIGINT) FROM sessions"))
def move_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store copied to another folder, verified row by row, and read from there."""
    moved = sync.move_store({"messages": messages(spark, sf_dir), "sessions": sessions(spark, sf_dir)}, new_path(spark, "moved-store"))
    count = lambda name, c: moved[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(c).alias("checked"))
    return count("messages", "id").unionByName(count("sessions", "message_count"))


# Of the second pass: every fifth file has shrunk to two lines, every seventh is read by a new parser, and the last line
# of every third is not complete.
_PASSES = """first AS (SELECT conv_id, count(*) AS held FROM conversations WHERE turn < 4 GROUP BY 1),
    lines AS (SELECT conv_id, turn, NOT (conv_id % 3 = 0 AND turn = max(turn) OVER (PARTITION BY conv_id)) AS complete FROM conversations WHERE conv_id % 5 <> 0 OR turn < 2),
    found AS (SELECT conv_id, count(*) FILTER (WHERE complete) AS last_line FROM lines GROUP BY 1),
    pending AS (SELECT conv_id, last_line, CASE WHEN held IS NULL OR conv_id % 7 = 0 OR last_line < held THEN 0 ELSE held END AS start FROM found LEFT JOIN first USING (conv_id))"""


def _passes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Offsets after a first pass, what the second one has to do, and its lines."""
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("f"), "conv_id").alias("file_path"), "conv_id", F.col("turn").alias("line_no"))
    first = rows.filter("line_no < 4").withColumn("complete", F.lit(True))
    no_offsets = spark.createDataFrame([], "file_path string, last_line long, parser string")
    offsets = materialize(store.upsert_offsets(no_offsets, store.pending_files(no_offsets, first, "v1")), "offsets")
    now = rows.filter("conv_id % 5 <> 0 or line_no < 2")
    last = now.groupBy("conv_id").agg(F.max("line_no").alias("last"))
    now = now.join(last, "conv_id").withColumn("complete", ~((F.col("conv_id") % 3 == 0) & (F.col("line_no") == F.col("last"))))
    changed, same = (now.filter(f).select("file_path", "line_no", "complete") for f in ("conv_id % 7 = 0", "conv_id % 7 <> 0"))
    pending = store.pending_files(offsets, changed, "v2").unionByName(store.pending_files(offsets, same, "v1"))
    return offsets, pending, changed.unionByName(same)


@query("SNK-03_ingest_file", f"""WITH {_PASSES}
    SELECT 'f' || conv_id AS file_path, start AS from_line, count(*) AS lines FROM lines JOIN pending USING (conv_id) WHERE complete AND turn >= start GROUP BY ALL""")
def ingest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second pass reads of each file: the lines that were appended, or all of a file that shrank or has a new parser."""
    _, pending, lines = _passes(spark, sf_dir)
    read = store.pending_lines(pending, lines).groupBy("file_path").agg(F.count("*").alias("lines"))
    return read.join(pending, "file_path").select("file_path", F.col("start").alias("from_line"), "lines")


@query("SNK-05_offsets", f"""WITH {_PASSES}
    SELECT 'f' || conv_id AS file_path, coalesce(last_line, held) AS last_line, CASE WHEN last_line IS NOT NULL AND conv_id % 7 = 0 THEN 'v2' ELSE 'v1' END AS parser
    FROM pending FULL JOIN first USING (conv_id)""")
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offsets after both passes."""
    held, pending, _ = _passes(spark, sf_dir)
    return store.upsert_offsets(held, pending)


@query("SRT-09_clamped", model_sql("SELECT id FROM messages ORDER BY id LIMIT 50"))
def clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of 900 asked for, 50 given."""
    return messages(spark, sf_dir).select("id").orderBy("id").limit(clamp(900, 1, 50))


def clamp(value: int, least: int, most: int) -> int:
    return max(least, min(most, value))


# Searching digests and the change log


_ONE = r"""one AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w FROM src),
    fig AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean, (count(*) FILTER (WHERE list_contains(w, 'with')))::DOUBLE AS df FROM one),
    hit AS (SELECT id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 9) AS score
            FROM (SELECT id, len(w)::DOUBLE AS dl, len(list_filter(w, lambda t: t = 'with'))::DOUBLE AS tf FROM one), fig WHERE tf > 0)"""


@query("RET-21_digest_search", model_sql("SELECT id, score FROM hit ORDER BY score DESC, id LIMIT 20", "src AS (SELECT id, title || ' ' || source AS text FROM sessions)", _ONE))
def digest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(spark, sf_dir).select("id", F.concat_ws(" ", "title", "source").alias("content"))
    return retrieval.word_stream(rows, ["with"], every=True).orderBy(F.desc("score"), "id").limit(20).select("id", "score")


@query("RET-23_log_search", f"""WITH src AS (SELECT doc_id AS id, text FROM documents), {_ONE},
    newer AS (SELECT doc_id - 1 AS old, max(doc_id) AS new FROM documents WHERE doc_id % 4 = 3 GROUP BY 1)
    SELECT id, score, new AS superseded_by FROM (SELECT * FROM hit ORDER BY score DESC, id LIMIT 20) LEFT JOIN newer ON old = id""")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the newest entry that supersedes them."""
    docs = table(spark, sf_dir, "documents")
    hits = retrieval.word_stream(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), ["with"], every=True)
    newer = docs.filter("doc_id % 4 = 3").groupBy((F.col("doc_id") - 1).alias("old")).agg(F.max("doc_id").alias("superseded_by"))
    top = hits.orderBy(F.desc("score"), "id").limit(20).select("id", "score")
    return top.join(newer, F.col("id") == F.col("old"), "left").select("id", "score", "superseded_by")


@query("PRJ-02_marked_snippet")
def marked_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text around its first hit, wherever that is; a word that the cut halves goes, so it is no hit."""
    shape, around = r"(?i)\b(with|from)\b", 90
    flat = S.flattened(F.col("text"))
    at = F.length(F.split("flat", shape, 2)[0]) + 1
    begin, end = F.greatest(F.lit(1), F.col("at") - around), F.least(F.length("flat"), F.col("at") - 1 + around)
    middle = F.substring(F.col("flat"), begin, end - begin + 1)
    middle = F.when(begin > 1, F.concat(F.lit("…"), F.regexp_replace(middle, r"^\w+", ""))).otherwise(middle)
    middle = F.when(end < F.length("flat"), F.concat(F.regexp_replace(middle, r"\w+$", ""), F.lit("…"))).otherwise(middle)
    hits = table(spark, sf_dir, "documents").filter(F.col("text").rlike(shape)).select("doc_id", flat.alias("flat")).withColumn("at", at)
    return hits.select("doc_id", F.regexp_replace(middle, F.lit(shape), F.lit("[$1]")).alias("snippet"))


# Evaluation


_GRAMS = r"""qs AS (SELECT item_id, regexp_split_to_array(lower(text), '\s+') AS w FROM benchmark), ds AS (SELECT doc_id, regexp_split_to_array(lower(text), '\s+') AS w FROM documents),
    qg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM qs),
    dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM ds),
    shared AS (SELECT item_id, doc_id, count(*) AS n FROM qg JOIN dg USING (g) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS pos FROM shared),
    gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    best AS (SELECT g.item_id, min(pos) AS pos FROM gold g LEFT JOIN ranked r ON g.item_id = r.item_id AND g.doc_id = r.doc_id GROUP BY g.item_id)"""
_METRICS = f"""WITH {_GRAMS} SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, count(*) AS queries, round(avg(CASE WHEN pos <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1,
    round(avg(CASE WHEN pos <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_3, round(avg(CASE WHEN pos <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_10, round(avg(CASE WHEN pos <= 40 THEN 1.0 ELSE 0 END), 6) AS hit_40,
    round(avg(coalesce(1.0 / pos, 0)), 6) AS mrr FROM best GROUP BY 1"""


def _gold(items: DataFrame, docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Documents that hold a passage; they share its first run of words, so they are looked for among the ranked only."""
    # ranks first, as what is ranked may be small enough to leave the texts where they are
    held = docs.withColumnRenamed("text", "body").join(ranked, "doc_id").join(items, "item_id")
    return held.filter(F.contains("body", "text")).select("item_id", "doc_id", "pos")


@query("AGG-27_recall_metrics", _METRICS)
def recall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries, documents that hold them as gold, ranked by shared runs of four words."""
    from palimpsest.operators.evaluation import four_word_ranks, metrics

    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")
    best = _gold(items, docs, four_word_ranks(items, docs)).groupBy("item_id").agg(F.min("pos").alias("pos"))
    return metrics(best.withColumn("kind", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd")))


_BENCH = f"""WITH {_GRAMS}, first AS (SELECT * FROM ranked WHERE pos <= 40), vecs AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    near AS (SELECT f.item_id, f.pos, f.doc_id = g.doc_id AS same, coalesce(round(list_inner_product(a.v, b.v), 9) >= 0.85, false) AS alike
        FROM first f JOIN gold g USING (item_id) LEFT JOIN vecs a ON a.doc_id = f.doc_id LEFT JOIN vecs b ON b.doc_id = g.doc_id),
    ranks AS (SELECT item_id, min(pos) FILTER (WHERE same) AS strict, min(pos) FILTER (WHERE same OR alike) AS equal FROM near GROUP BY 1),
    shown AS (SELECT item_id, count(*) AS hits, max(n) AS top FROM first GROUP BY 1),
    held AS (SELECT item_id, CASE WHEN item_id NOT IN (SELECT item_id FROM gold) THEN 'negative' WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, strict, equal, hits, top
        FROM benchmark LEFT JOIN ranks USING (item_id) LEFT JOIN shown USING (item_id))
    SELECT kind, count(*) AS queries, {", ".join(f"round(avg(CASE WHEN {c} <= {k} THEN 1.0 ELSE 0 END), 6) AS {n}_{k}" for c, n in (("strict", "hit"), ("equal", "equal")) for k in (1, 3, 10, 40))},
        round(avg(coalesce(1.0 / strict, 0)), 6) AS mrr, round(avg(coalesce(1.0 / equal, 0)), 6) AS equal_mrr,
        round(avg(CASE WHEN hits IS NULL THEN 1.0 ELSE 0 END), 6) AS empty, round(avg(coalesce(hits, 0)), 6) AS hits, round(avg(coalesce(top, 0)), 6) AS top_score FROM held GROUP BY 1"""


@query("EVL-01_recall_bench", _BENCH)
def recall_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict ranks, ranks of what is as good as an answer, and what passages that nothing holds bring up."""
    from palimpsest.operators.evaluation import bench, four_word_ranks

    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")
    ranked = materialize(four_word_ranks(items, docs), "bench-ranks")
    gold = _gold(items, docs, ranked).select("item_id", "doc_id")
    answered = items.select("item_id").join(gold.select("item_id", F.lit(True).alias("answered")).distinct(), "item_id", "left")
    kind = F.when(F.col("answered").isNull(), "negative").when(F.col("item_id") % 2 == 0, "even").otherwise("odd")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return bench(answered.select("item_id", kind.alias("kind")), ranked, gold, vectors)


@query("EVL-02_paraphrase_bench")
def paraphrase_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages without every fifth word as queries: recall at three by words, by words and vectors, and reranked."""
    from palimpsest.operators.evaluation import four_word_ranks, lanes, recall_at

    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")
    said = items.select("item_id", F.array_join(F.filter(F.split("text", " "), lambda w, i: i % 5 != 4), " ").alias("text"))
    # passages and what is said of them are looked for in one reading of the documents
    of = lambda df, is_said: df.select(F.struct("item_id", F.lit(is_said).alias("is_said")).alias("item_id"), "text")
    ranks = materialize(four_word_ranks(of(items, False).unionByName(of(said, True)), docs), "ranks")
    part = lambda is_said: ranks.filter(F.col("item_id.is_said") == is_said).withColumn("item_id", F.col("item_id.item_id"))
    whole, said_ranks = materialize(part(False), "ranks-of-passages"), part(True)
    gold = materialize(_gold(items, docs, whole).select("item_id", "doc_id"), "gold")
    ranked = materialize(lanes(said, docs, ranked=said_ranks), "lanes")
    return recall_at(ranked, gold, 3)


@query("EVL-03_corpora", """
    SELECT item_id, CASE WHEN count(d.doc_id) > 0 THEN 'positive' ELSE 'negative' END AS kind,
           CASE WHEN item_id % 2 = 0 THEN 'tune' ELSE 'hold-out' END AS split, count(d.doc_id) AS gold
    FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id""")
def corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled queries: passages that some document holds, and negatives, that none does; half of each are held out."""
    from palimpsest.operators.evaluation import four_word_ranks

    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")
    gold = _gold(items, docs, four_word_ranks(items, docs)).groupBy("item_id").agg(F.count("*").alias("n"))
    held = items.select("item_id").join(gold, "item_id", "left").withColumn("gold", F.coalesce("n", F.lit(0)))
    kind, split = F.when(F.col("gold") > 0, "positive").otherwise("negative"), F.when(F.col("item_id") % 2 == 0, "tune").otherwise("hold-out")
    return held.select("item_id", kind.alias("kind"), split.alias("split"), "gold")


@query("EMB-06_hash_embedding", r"SELECT doc_id, 64 AS dims, CASE WHEN regexp_matches(text, '\S') THEN 1.0 ELSE 0.0 END AS norm FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pluggable default: a deterministic embedding, 64 dimensions at unit length, null where a text fails."""
    from palimpsest.operators.evaluation import embed

    held = table(spark, sf_dir, "documents").select("doc_id", embed(F.col("text")).alias("v"))
    return held.select("doc_id", F.size("v").alias("dims"), F.round(S.dot(F.col("v"), F.col("v")), 4).alias("norm"))


@query("EMB-05_profiles", """
    WITH p(nth, profile, pooling, native, dtype, prompted) AS (VALUES (0, 'raw', 'mean', 768, 'fp32', false), (1, 'gemma-prompt-v1', 'mean', 768, 'fp32', true), (2, 'bge-m3-v1', 'cls', 1024, 'int8', false)),
    d AS (SELECT doc_id, text, [128, 256, 512, 768, 1024, 300, NULL][1 + doc_id % 7] AS asked, doc_id % 2 = 0 AS is_query, doc_id % 3 AS nth FROM documents)
    SELECT doc_id, profile, pooling, dtype, CASE WHEN asked <= native AND asked <> 300 THEN asked ELSE native END AS dims,
           md5(CASE WHEN NOT prompted THEN '' WHEN is_query THEN 'task: search result | query: ' ELSE 'title: none | text: ' END || text) AS prompt FROM d JOIN p USING (nth)""")
def embedding_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each text would be embedded: the profile's pooling, type and prompt, and the width that was asked for or its own."""
    from palimpsest.operators import vectors as V

    k = F.col("doc_id")
    asked = F.element_at(F.array(*(F.lit(n).cast("int") for n in (128, 256, 512, 768, 1024, 300, None))), (k % 7 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, V.PROFILES)), (k % 3 + 1).cast("int"))
    held = table(spark, sf_dir, "documents").select("doc_id", "text", asked.alias("asked"), name.alias("profile"), (k % 2 == 0).alias("is_query"))
    spec = V.profile(F.col("profile"))
    prompt = V.prompted(F.col("text"), F.col("is_query"), spec["prompted"])
    return held.select(
        "doc_id", "profile", spec["pooling"].alias("pooling"), spec["dtype"].alias("dtype"), V.target_dims(F.col("asked"), spec["dims"]).alias("dims"), F.md5(prompt.cast("binary")).alias("prompt")
    )


@query("EMB-09_vector_salvage", "SELECT len(embedding) AS dims, count(*) AS readable, 0 AS lost FROM embeddings GROUP BY 1")
def vector_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").cast("long").alias("dims")).agg(F.count_if(good).alias("readable"), F.count_if(~good).cast("int").alias("lost"))


@query("ATT-04_policy", "SELECT doc_id, CASE WHEN n_chars > 6000 THEN 'head_tail' WHEN n_chars > 1000 THEN 'light' ELSE 'verbatim' END AS mode FROM documents")
def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("n_chars") > 6000, "head_tail").when(F.col("n_chars") > 1000, "light").otherwise("verbatim")
    return table(spark, sf_dir, "documents").select("doc_id", mode.alias("mode"))


@query("WIN-11_oldest_first_eviction", """
    SELECT o_orderkey AS id, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 500000 AS evict FROM orders""")
def eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each owner's budget the newest stay."""
    from pyspark.sql import Window

    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.sum("o_totalprice").over(newest) > 500_000).alias("evict"))


