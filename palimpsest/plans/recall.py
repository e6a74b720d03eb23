"""Recall queries: single streams, their fusion, and the whole hybrid recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.functions import scalars as S
from palimpsest.operators import ranking as R
from palimpsest.operators import retrieval as T
from palimpsest.operators import vectors as V
from palimpsest.sources.conversation_store import messages, model_sql, sessions
from palimpsest.storage import materialize, table

QUERY = 'the "with" thing:'
TERMS = ["the", "with", "thing"]
NOW = 1709251200  # 2024-03-01T00:00:00Z

_TOK = r"""tok AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS token FROM messages),
    dls AS (SELECT m.id, count(t.token) AS dl FROM messages m LEFT JOIN tok t ON m.id = t.id GROUP BY m.id),
    figures AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM dls),
    tfs AS (SELECT id, token, count(*)::DOUBLE AS tf FROM tok WHERE token IN ('the', 'with', 'thing') GROUP BY id, token),
    dfs AS (SELECT token, count(*)::DOUBLE AS df FROM tfs GROUP BY token),
    scores AS (SELECT t.id, count(*) AS terms, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score
               FROM tfs t JOIN dfs USING (token) JOIN dls d ON d.id = t.id CROSS JOIN figures GROUP BY t.id),
    word_and AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM scores WHERE terms = 3 QUALIFY rank < 60),
    word_or AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM scores QUALIFY rank < 60)"""
_TRI = r"""lane AS (SELECT id, lower(content) AS c, greatest(length(content) - 2, 0)::DOUBLE AS dl FROM messages WHERE NOT starts_with(lower(content), '[tool_result]')),
    tri_figures AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM lane),
    tri_tfs AS (SELECT id, dl, t AS term, floor((length(c) - length(replace(c, t, ''))) / length(t))::DOUBLE AS tf FROM lane, (SELECT unnest(['the', 'with', 'thing']) AS t)),
    tri_dfs AS (SELECT term, count(*)::DOUBLE AS df FROM tri_tfs WHERE tf > 0 GROUP BY term),
    tri_scores AS (SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score
               FROM tri_tfs JOIN tri_dfs USING (term) CROSS JOIN tri_figures WHERE tf > 0 GROUP BY id),
    tri AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM tri_scores QUALIFY rank < 60)"""
_FUSED = """fused AS (SELECT id, round(sum(w / (60 + rank)), 12) AS score FROM (
        SELECT id, rank, 1.0 AS w FROM word_and UNION ALL SELECT id, rank, 0.3 FROM tri UNION ALL SELECT id, rank, 0.3 FROM word_or) GROUP BY id)"""


def lexical_streams(rows: DataFrame, terms: list[str]) -> list[tuple[DataFrame, float]]:
    kept = rows.select("id", "content")
    return [
        (T.best(T.word_stream(kept, terms, every=True)), T.WEIGHTS["and"]),
        (T.best(T.trigram_stream(kept, terms)), T.WEIGHTS["trigram"]),
        (T.best(T.word_stream(kept, terms, every=False)), T.WEIGHTS["or"]),
    ]


def _hits(df: DataFrame) -> DataFrame:
    return df.select("id", "score", F.col("rank").cast("long").alias("rank"))


@query("RET-01_query_terms", r"""
    SELECT item_id, CAST(unnest(range(0, len(terms))) AS INTEGER) AS pos, unnest(terms) AS term
    FROM (SELECT item_id, list_filter(list_transform(u, lambda t: t.w), lambda w: w <> '') AS terms
          FROM (SELECT item_id, list_sort(list({'i': i, 'w': w})) AS u
                FROM (SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i
                      FROM (SELECT item_id, list_transform(regexp_split_to_array(lower('"' || text || '": (' || text || ')'), '[ \t\n\v\f\r]+'), lambda w: regexp_replace(w, '["()*:^]', '', 'g')) AS ws FROM benchmark))
                      GROUP BY item_id, w) GROUP BY item_id))""")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of each benchmark passage, asked for twice with query syntax around it: each once, in order."""
    asked = F.concat(F.lit('"'), "text", F.lit('": ('), "text", F.lit(")"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.terms_of(asked)).alias("pos", "term"))


@query("RET-02_word_and", model_sql("SELECT id, score, rank FROM word_and", _TOK))
@query("SRT-01_top_pool", model_sql("SELECT id, score, rank FROM word_and", _TOK))
def word_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(T.best(T.word_stream(messages(spark, sf_dir).select("id", "content"), TERMS, every=True)))


@query("RET-03_trigram", model_sql("SELECT id, score, rank FROM tri", _TRI))
def trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(T.best(T.trigram_stream(messages(spark, sf_dir).select("id", "content"), TERMS)))


@query("RET-04_word_or", model_sql("SELECT id, score, rank FROM word_or", _TOK))
def word_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(T.best(T.word_stream(messages(spark, sf_dir).select("id", "content"), TERMS, every=False)))


_SCOPED = r"""scoped AS (SELECT m.* FROM messages m JOIN sessions s ON m.session_id = s.id WHERE regexp_replace(lower(replace(s.project_root, '\', '/')), '/+$', '') = '/p/3')"""


@query("FLT-01_scope_before_limit", model_sql("SELECT w.id FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM scores WHERE id IN (SELECT id FROM scoped)) w WHERE r <= 60", _TOK, _SCOPED))
def scope_before_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project's hits, not what is left of it in everyone's best: scores are the whole corpus's."""
    wanted = sessions(spark, sf_dir).filter(S.project_key(F.col("project_root")) == "/p/3").select(F.col("id").alias("session_id"))
    found = T.word_stream(messages(spark, sf_dir).select("id", "session_id", "content"), TERMS, every=False)
    return T.best(found.join(wanted, "session_id", "left_semi")).select("id")


@query("RET-05_rare_terms", model_sql(r"""
    SELECT token AS term, count(DISTINCT id) AS df FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS token FROM messages)
    WHERE token IN ('the', 'with', 'thing', 'from', 'zzzz') GROUP BY token ORDER BY df, term LIMIT 3"""))
def rare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.rare_terms(messages(spark, sf_dir), [*TERMS, "from", "zzzz"])


_RM3 = r"""ft AS (SELECT id, left(content, 2000) AS head, content FROM messages),
    corpus AS (SELECT id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(content), '[^\p{L}\p{N}_.\-/]+'), lambda t: regexp_replace(t, '^[.\-/]+|[.\-/]+$', '', 'g')), lambda t: length(t) BETWEEN 3 AND 40))) AS term FROM ft),
    seed AS (SELECT id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(head), '[^\p{L}\p{N}_.\-/]+'), lambda t: regexp_replace(t, '^[.\-/]+|[.\-/]+$', '', 'g')), lambda t: length(t) BETWEEN 3 AND 40))) AS term
             FROM ft WHERE id IN (SELECT id FROM word_or WHERE rank < 10)),
    cand AS (SELECT term, count(*) AS docs FROM seed GROUP BY term HAVING count(*) >= 2 ORDER BY docs DESC, term LIMIT 40),
    cdf AS (SELECT c.term, any_value(docs) AS docs, count(*) AS df FROM corpus JOIN cand c USING (term) GROUP BY c.term)"""


@query("RET-06_feedback_terms", model_sql("""
    SELECT term, docs, df, round(docs * ln((SELECT count(*) FROM messages)::DOUBLE / df), 6) AS score FROM cdf
    WHERE df <= (SELECT count(*) FROM messages) * 0.05 ORDER BY score DESC, term LIMIT 8""", _TOK, _RM3))
def feedback_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select("id", "content")
    seeds = T.best(T.word_stream(rows, TERMS, every=False)).filter("rank < 10")
    return T.feedback_terms(rows, seeds)


@query("RET-07_feedback_tokens", r"""
    SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_.\-/]+'), lambda t: regexp_replace(t, '^[.\-/]+|[.\-/]+$', '', 'g')),
        lambda t: len(t) BETWEEN 3 AND 40), ' ') AS tokens FROM documents""")
def feedback_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of whole documents as feedback takes them: paths and dotted names in one piece."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.feedback_tokens(F.col("text")), " ").alias("tokens"))


@query("RET-08_slice_normalize", """
    SELECT vec_id, list_transform(h, lambda x: round(x / sqrt(list_inner_product(h, h)), 6)) AS v
    FROM (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS h FROM embeddings)""")
@query("SCL-06_slice_normalize", """
    SELECT vec_id, list_transform(h, lambda x: round(x / sqrt(list_inner_product(h, h)), 6)) AS v
    FROM (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS h FROM embeddings)""")
def slice_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    # small negative numbers become -0.0, as in the SQL; Spark's own rounding has no such zero
    short = F.transform(S.slice_normalize(F.col("embedding"), 32), lambda x: F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6)
    return table(spark, sf_dir, "embeddings").select("vec_id", short.alias("v"))


@query("RET-10_fused", model_sql("SELECT id, score FROM fused", _TOK, _TRI, _FUSED))
def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(lexical_streams(messages(spark, sf_dir), TERMS), "id").select("id", F.round("score", 12).alias("score"))


_DIST = """nearest AS (SELECT sqrt(greatest(0, 2 - 2 * round(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9))) AS d
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 9) q WHERE e.vec_id <> 9 ORDER BY d LIMIT 60)"""


@query("RET-11_abstention", f"""WITH {_DIST}
    SELECT round(min(d), 6) AS top, coalesce(min(d) > 0.86 AND (SELECT d FROM nearest ORDER BY d OFFSET 9 LIMIT 1) - min(d) < 0.05, false) AS abstain FROM nearest""")
def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a vector of the table is near to any other; at no distance from itself, it would never be told to abstain."""
    held = table(spark, sf_dir, "embeddings")
    near = V.nearest(held.filter("vec_id <> 9"), held.filter("vec_id = 9").select(F.col("embedding").alias("q")), V.MOST_CHUNKS * 7 + 4)
    top = near.agg(F.min("distance").alias("top")).crossJoin(R.margin(near))
    return top.select(F.round("top", 6).alias("top"), R.abstains(F.col("top"), F.col("margin")).alias("abstain"))


_DEMOTED = r"""demoted AS (SELECT m.*, round(CASE WHEN m.tool_name IS NOT NULL OR (m.role = 'user' AND regexp_matches(left(m.content, 16), '(?i)^\s*\[tool[_ ]result'))
        THEN f.score * {factor} ELSE f.score END, 12) AS score FROM fused f JOIN messages m ON m.id = f.id),
    placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM demoted)"""


@query("RET-13_tool_demotion", model_sql("SELECT id, score, rank FROM placed", _TOK, _TRI, _FUSED, _DEMOTED.replace("{factor}", "0.3")))
def tool_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.fuse(lexical_streams(messages(spark, sf_dir), TERMS), "id").withColumn("score", F.round("score", 12))
    return _hits(T.demote_tools(found.join(messages(spark, sf_dir), "id"), 0.3))


_BLENDED = """blended AS (SELECT *, row_number() OVER (ORDER BY round(1.0 / (1 + rank) * coalesce(greatest(0.15, pow(0.5, greatest(0, (1709251200 - epoch(CAST(timestamp AS TIMESTAMP))) / 86400.0) / 30)), 0.5), 12) DESC, rank) AS pos FROM placed),
    hydrated AS (SELECT b.id, b.session_id, b.score, s.source, b.pos FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS nth FROM blended) b
        JOIN sessions s ON b.session_id = s.id WHERE nth <= 2)"""


def fts_recall(spark: SparkSession, sf_dir: str, terms: list[str], limit: int) -> DataFrame:
    """Lexical recall: fused streams, tool output demoted, recency, two hits a session at most."""
    rows = messages(spark, sf_dir)
    found = R.fuse(lexical_streams(rows, terms), "id").withColumn("score", F.round("score", 12))
    placed = T.demote_tools(found.join(rows, "id"), 0.3)
    return hydrate(R.blend_recency(placed, NOW), sessions(spark, sf_dir), limit)


def hydrate(ranked: DataFrame, held: DataFrame, limit: int, cap: int = 2) -> DataFrame:
    """Ranked hits with their session, ``cap`` for each, the first ``limit``; ``pos`` counts anew."""
    lanes = held.select(F.col("id").alias("session_id"), "source", "project_root", "origin")
    return R.stream(R.capped(ranked.drop("rank").join(lanes, "session_id"), "session_id", cap, "pos"), limit, "pos").withColumn("pos", F.col("rank").cast("long") + 1)


@query("RET-15_hydrate", model_sql("SELECT id, session_id, score, source, row_number() OVER (ORDER BY pos) AS pos FROM hydrated ORDER BY pos LIMIT 12", _TOK, _TRI, _FUSED, _DEMOTED.replace("{factor}", "0.3"), _BLENDED))
@query("RET-19_fts_recall", model_sql("SELECT id, session_id, score, source, row_number() OVER (ORDER BY pos) AS pos FROM hydrated ORDER BY pos LIMIT 12", _TOK, _TRI, _FUSED, _DEMOTED.replace("{factor}", "0.3"), _BLENDED))
def lexical_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts_recall(spark, sf_dir, T.query_terms(QUERY), 12).select("id", "session_id", "score", "source", "pos")


_VEC = """vecs AS (SELECT m.id, CAST(e.embedding AS DOUBLE[]) AS v FROM messages m JOIN embeddings e ON e.vec_id = (m.id * 7919) % (SELECT count(*) FROM embeddings)),
    qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3),
    vec_top AS (SELECT id, round(list_inner_product(v, q), 9) AS cosine, row_number() OVER (ORDER BY sqrt(greatest(0, 2 - 2 * round(list_inner_product(v, q), 9))), id) - 1 AS rank FROM vecs, qv QUALIFY rank < 60)"""
_HYBRID = """fused AS (SELECT id, round(sum(w / (60 + rank)), 12) AS score FROM (
        SELECT id, rank, 1.0 AS w FROM word_and UNION ALL SELECT id, rank, 0.3 FROM tri UNION ALL SELECT id, rank, 0.3 FROM word_or
        UNION ALL SELECT id, rank, 1.6 FROM vec_top) GROUP BY id)"""
_MIXED = """top48 AS (SELECT *, row_number() OVER (ORDER BY pos) AS p FROM hydrated QUALIFY p <= 48),
    cosines AS (SELECT t.*, (SELECT round(list_inner_product(v, q), 9) FROM vecs, qv WHERE vecs.id = t.id) AS cosine FROM top48 t),
    mixed AS (SELECT *, row_number() OVER (ORDER BY coalesce(cosine, -2) DESC, p) AS c FROM cosines)"""


def _message_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every message; there are more messages than vectors, so some share one."""
    held = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = held.agg(F.count("*").alias("n"))  # a single row
    keyed = messages(spark, sf_dir).select("id").crossJoin(F.broadcast(n)).select("id", (F.col("id") * 7919 % F.col("n")).alias("vec_id"))
    return keyed.join(held, "vec_id").select("id", "embedding")


def hybrid_hits(spark: SparkSession, sf_dir: str, terms: list[str], query_vector: DataFrame, limit: int = 12) -> DataFrame:
    """Hybrid recall before collapsing: four times the limit, mixed by cosine (``mixed_pos``), with vectors."""
    rows, vectors = messages(spark, sf_dir), _message_vectors(spark, sf_dir)
    near = V.nearest(vectors, query_vector, T.POOL, "id")
    streams = [*lexical_streams(rows, terms), (near, T.WEIGHTS["vector"])]
    found = R.fuse(streams, "id").withColumn("score", F.round("score", 12))
    placed = T.demote_tools(found.join(rows, "id"), 0.7)
    top = materialize(hydrate(R.blend_recency(placed, NOW), sessions(spark, sf_dir), 4 * limit), "hybrid-hits")
    scored = V.distances(vectors.join(F.broadcast(top.select("id")), "id"), query_vector).select("id", "embedding", "cosine")
    return R.mix_by_cosine(top.join(scored, "id", "left"))


@query("RET-16_cosine_mix", model_sql("SELECT id, row_number() OVER (ORDER BY round(1.0 / (60 + p) + 1.0 / (60 + c), 12) DESC, p) AS pos FROM mixed", _TOK, _TRI, _VEC, _HYBRID, _DEMOTED.replace("{factor}", "0.7"), _BLENDED, _MIXED))
def cosine_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "embeddings").filter("vec_id = 3").select(F.col("embedding").alias("q"))
    return hybrid_hits(spark, sf_dir, TERMS, asked).select("id", F.col("mixed_pos").cast("long").alias("pos"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 3").select(F.col("embedding").alias("q"))


def _collapsed(hits: DataFrame) -> DataFrame:
    ranked = hits.select(F.lit(0).cast("long").alias("query"), "id", F.col("mixed_pos").alias("pos"), "embedding")
    return R.collapse(ranked).drop("query")


@query("RET-17_collapse")
def collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of the over-fetch with the head or copy that each is; none is dropped."""
    hits = materialize(hybrid_hits(spark, sf_dir, TERMS, _asked(spark, sf_dir)), "mixed-hits")
    return _collapsed(hits).join(hits.select("id", "mixed_pos"), "id").select("pos", "id", F.col("mixed_pos").cast("long").alias("mixed_pos"), "head", "similar", "similar_ids")


@query("RET-18_finish")
def finish(spark: SparkSession, sf_dir: str, limit: int = 5) -> DataFrame:
    """From four times the limit, mixed and collapsed, to the limit."""
    hits = materialize(hybrid_hits(spark, sf_dir, TERMS, _asked(spark, sf_dir), limit), "mixed-hits")
    return _collapsed(hits).filter(F.col("pos") <= limit).select("pos", "id")


@query("RET-19_hybrid_recall")
def hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole recall: near copies collapse behind the hit they repeat, then the first twelve with snippets."""
    hits = materialize(hybrid_hits(spark, sf_dir, TERMS, _asked(spark, sf_dir)), "mixed-hits")
    kept = _collapsed(hits).filter("pos <= 12")
    return kept.join(hits.drop("pos", "embedding"), "id").select(
        "pos", "id", "session_id", "source", "score", "head", "similar", "similar_ids", S.snippet(F.col("content"), TERMS).alias("snippet")
    )


@query("RET-12_rerank", model_sql("""
    SELECT id, row_number() OVER (ORDER BY r > 40, CASE WHEN r <= 40 THEN length(left(content, 2000)) END DESC NULLS LAST, r) AS pos
    FROM (SELECT id, content, row_number() OVER (ORDER BY id DESC) AS r FROM messages QUALIFY r <= 60)"""))
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pluggable scorer reorders the first forty; here it scores by length."""
    ranked = R.stream(messages(spark, sf_dir).select("id", "content"), 60, F.desc("id")).withColumn("pos", F.col("rank").cast("long") + 1)
    return R.rerank(ranked, lambda texts: [len(t) for t in texts])


_SEC = r"""fields AS (SELECT page_id AS id, regexp_extract(html, '<title>(.*?)</title>', 1) AS heading, html AS body FROM pages),
    ht AS (SELECT id, len(list_filter(w, lambda t: t <> ''))::DOUBLE AS dl, len(list_filter(w, lambda t: t = 'the'))::DOUBLE AS tf FROM (SELECT id, regexp_split_to_array(lower(heading), '[^\p{L}\p{N}]+') AS w FROM fields)),
    bt AS (SELECT id, len(list_filter(w, lambda t: t <> ''))::DOUBLE AS dl, len(list_filter(w, lambda t: t = 'the'))::DOUBLE AS tf FROM (SELECT id, regexp_split_to_array(lower(body), '[^\p{L}\p{N}]+') AS w FROM fields)),
    f AS (SELECT (SELECT count(*) FROM ht)::DOUBLE AS n, (SELECT count(*) FROM ht WHERE tf > 0)::DOUBLE AS hdf, (SELECT count(*) FROM bt WHERE tf > 0)::DOUBLE AS bdf, (SELECT avg(dl) FROM ht) AS hm, (SELECT avg(dl) FROM bt) AS bm)"""
_SECTIONS = f"""WITH {_SEC} SELECT id, round(5 * CASE WHEN ht.tf > 0 THEN greatest(ln((n - hdf + 0.5) / (hdf + 0.5)), 1e-6) * ht.tf * 2.2 / (ht.tf + 1.2 * (0.25 + 0.75 * ht.dl / hm)) ELSE 0 END
        + CASE WHEN bt.tf > 0 THEN greatest(ln((n - bdf + 0.5) / (bdf + 0.5)), 1e-6) * bt.tf * 2.2 / (bt.tf + 1.2 * (0.25 + 0.75 * bt.dl / bm)) ELSE 0 END, 6) AS score
    FROM ht JOIN bt USING (id) CROSS JOIN f WHERE ht.tf > 0 OR bt.tf > 0 ORDER BY score DESC, id LIMIT 20"""


@query("RET-22_section_search", _SECTIONS)
@query("SRT-08_weighted_fields", _SECTIONS)
def section_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields, the heading at five times the weight."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("heading"), F.col("html").alias("body"))
    heads = T.word_stream(rows.select("id", "heading"), ["the"], every=True, text="heading").select("id", (F.col("score") * 5).alias("part"))
    bodies = T.word_stream(rows.select("id", "body"), ["the"], every=True, text="body").select("id", F.col("score").alias("part"))
    both = heads.unionByName(bodies).groupBy("id").agg(F.round(F.sum("part"), 6).alias("score"))
    return both.orderBy(F.desc("score"), "id").limit(20)


@query("RET-24_conflicts", r"""
    WITH d AS (SELECT doc_id AS id, text || CASE WHEN doc_id % 9 = 1 THEN ' We decided so.' ELSE '' END AS content, doc_id * 86400 AS day FROM documents),
    dec AS (SELECT * FROM d WHERE regexp_matches(content, '(?i)\bwe (decided|will not|no longer)\b|\bdecision\b|\binstead of\b|\bdeprecat|\bsupersede\b')),
    newest AS (SELECT * FROM dec ORDER BY day DESC, id DESC LIMIT 1)
    SELECT n.id AS newest, o.id AS older FROM newest n JOIN dec o ON o.id <> n.id AND n.day - o.day >= 7 * 86400 ORDER BY o.day DESC, o.id DESC LIMIT 8""")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.when(F.col("doc_id") % 9 == 1, " We decided so.").otherwise(""))
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("content"), (F.col("doc_id") * 86400).alias("at"))
    held = held.filter(S.is_decision(F.col("content"))).select("id", "at")
    newest = held.orderBy(F.desc("at"), F.desc("id")).limit(1).select(F.col("id").alias("newest"), F.col("at").alias("last"))
    older = held.crossJoin(F.broadcast(newest)).filter((F.col("id") != F.col("newest")) & (F.col("last") - F.col("at") >= 7 * 86400))  # one row
    return older.orderBy(F.desc("at"), F.desc("id")).limit(8).select("newest", F.col("id").alias("older"))


@query("RET-25_continuity_card", model_sql(r"""
    SELECT s.id, s.title, s.pinned, (SELECT count(*) FROM sessions t WHERE regexp_replace(lower(replace(t.project_root, '\', '/')), '/+$', '') = '/p/4') AS sessions,
           row_number() OVER (ORDER BY pinned DESC, coalesce(ended_at, started_at) DESC, id) AS pos
    FROM sessions s WHERE regexp_replace(lower(replace(project_root, '\', '/')), '/+$', '') = '/p/4' ORDER BY pos LIMIT 5"""))
def continuity_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = sessions(spark, sf_dir).filter(S.project_key(F.col("project_root")) == "/p/4")
    card = R.pinned_then_recent(held, 5).crossJoin(held.agg(F.count("*").alias("sessions")))
    return card.select("id", "title", "pinned", "sessions", F.col("pos").cast("long").alias("pos"))


@query("RET-26_pinned", model_sql("SELECT id, title FROM sessions WHERE pinned OR id = 's3' ORDER BY id"))
def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pin one session more, then list all pinned."""
    held = sessions(spark, sf_dir).withColumn("pinned", F.col("pinned") | (F.col("id") == "s3"))
    return held.filter("pinned").select("id", "title")


@query("RET-27_artifact_lines", """
    SELECT doc_id, i - 1 AS ordinal, string_split(text, chr(10))[i] AS line FROM documents, range(3, 6) r(i) WHERE i <= len(string_split(text, chr(10)))""")
def artifact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 4 of every artifact."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return lines.filter("ordinal between 2 and 4").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "line")
