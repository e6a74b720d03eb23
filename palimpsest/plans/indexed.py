"""Recall from stored indexes, and recall that says why it is empty."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.operators import ranking as R
from palimpsest.operators import retrieval as T
from palimpsest.operators import vectors as V
from palimpsest.operators.text_index import GramIndex, WordIndex
from palimpsest.plans import recall as P
from palimpsest.sources.conversation_store import messages, model_sql, sessions
from palimpsest.storage import materialize, table

#: Built in this application, by kind and the table's files and their times: a table that is written anew is indexed anew.
_BUILT: dict[tuple, WordIndex | GramIndex] = {}


def _signature(spark: SparkSession, sf_dir: str) -> tuple:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf_dir}/conversations.parquet").select("length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime")).first())


def index_of(kind: type[WordIndex] | type[GramIndex], spark: SparkSession, sf_dir: str) -> WordIndex | GramIndex:
    """An index of the messages: added in three lots, of which one has old texts that are removed and added as they are now."""
    key = (kind, spark.sparkContext.applicationId, sf_dir, _signature(spark, sf_dir))
    if key not in _BUILT:
        rows = messages(spark, sf_dir).select("id", "conv_id", "content")
        changed = F.col("id") % 7 == 0
        old = rows.withColumn("content", F.when(changed, F.concat(F.lit("with stale words, the thing "), "content")).otherwise(F.col("content")))
        index = kind.scratch(spark)
        index.add(old.filter("conv_id % 2 = 0"))
        index.add(old.filter("conv_id % 2 = 1"))
        index.remove(old.filter(changed))
        index.add(rows.filter(changed))
        if kind is GramIndex:
            index.merge()
        _BUILT[key] = index
    return _BUILT[key]


def indexes(spark: SparkSession, sf_dir: str) -> tuple[WordIndex, GramIndex]:
    return index_of(WordIndex, spark, sf_dir), index_of(GramIndex, spark, sf_dir)


def _ranked(found: DataFrame) -> DataFrame:
    return P._hits(T.best(found))


@query("RET-02_stored_words", model_sql("SELECT id, score, rank FROM word_and", P._TOK))
def stored_words_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(index_of(WordIndex, spark, sf_dir).search(P.TERMS, every=True, pool=T.POOL))


@query("RET-04_stored_words", model_sql("SELECT id, score, rank FROM word_or", P._TOK))
def stored_words_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(index_of(WordIndex, spark, sf_dir).search(P.TERMS, every=False, pool=T.POOL))


@query("RET-03_stored_grams", model_sql("SELECT id, score, rank FROM tri", P._TRI))
def stored_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(index_of(GramIndex, spark, sf_dir).search(P.TERMS))


@query("AGG-21_stored_words", model_sql("SELECT token AS term, count(DISTINCT id) AS df FROM tok WHERE token IN ('the', 'with', 'thing') GROUP BY 1 UNION ALL SELECT 'zzzz', 0", P._TOK))
def stored_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies from the blocks' counts; no posting is read."""
    held = index_of(WordIndex, spark, sf_dir).frequencies([*P.TERMS, "zzzz"])
    return spark.createDataFrame(list(held.items()), "term string, df long")


def stored_streams(spark: SparkSession, sf_dir: str, terms: list[str]) -> list[tuple[DataFrame, float]]:
    """The lexical streams of a query; one that has no term is left out."""
    words, grams = indexes(spark, sf_dir)
    streams = []
    if terms:
        streams.append((T.best(words.search(terms, every=True, pool=T.POOL)), T.WEIGHTS["and"]))
        streams.append((T.best(words.search(terms, every=False, pool=T.POOL)), T.WEIGHTS["or"]))
    if any(len(t) >= 3 for t in terms):
        streams.append((T.best(grams.search(terms)), T.WEIGHTS["trigram"]))
    return streams


@dataclass
class Recalled:
    """Hits in order, and why there are none: ``no terms``, ``nothing found`` or ``abstained``; else ``found``."""

    hits: DataFrame
    reason: str
    top_distance: float | None = None


def recall_checked(spark: SparkSession, sf_dir: str, text: str, *, vector: DataFrame | None = None, vectors: DataFrame | None = None, limit: int = 12, abstain: bool = True) -> Recalled:
    """Recall that never fails for want of words: whatever the query, hits or the reason for none.

    ``vector`` is a single row (q), ``vectors`` (id, embedding) are the messages'; without either the recall is lexical.
    """
    rows = messages(spark, sf_dir)
    terms = T.query_terms(text)
    top = margin = None
    near = None
    if vector is not None and vectors is not None:
        near = materialize(V.nearest(vectors, vector, T.POOL, "id"), "nearest")
        top, margin = near.agg(F.min("distance").alias("top")).crossJoin(R.margin(near)).first()
    nothing = rows.limit(0).select("id", "session_id", F.lit(0.0).alias("score"), F.lit("").alias("source"), F.lit(0).cast("long").alias("pos"))
    # before any index is asked: what abstains has no hits, whatever words say
    if abstain and top is not None and margin is not None and top > 0.86 and margin < 0.05:
        return Recalled(nothing, "abstained", top)
    streams = stored_streams(spark, sf_dir, terms)
    if top is not None:
        streams.append((near.select("id", "rank"), T.WEIGHTS["vector"]))
    if not streams:
        return Recalled(nothing, "no terms")
    found = R.fuse(streams, "id").withColumn("score", F.round("score", 12))
    placed = T.demote_tools(found.join(rows, "id"), 0.3 if top is None else 0.7)
    hits = P.hydrate(R.blend_recency(placed, P.NOW), sessions(spark, sf_dir), limit).select("id", "session_id", "score", "source", "pos")
    hits = materialize(hits, "recalled")
    return Recalled(hits, "found" if hits.count() else "nothing found", top)


@query("RET-19_stored_recall", model_sql("SELECT id, session_id, score, source, row_number() OVER (ORDER BY pos) AS pos FROM hydrated ORDER BY pos LIMIT 12", P._TOK, P._TRI, P._FUSED, P._DEMOTED.replace("{factor}", "0.3"), P._BLENDED))
def stored_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical recall from the stored indexes: a few buckets are read, and the texts of the hits."""
    return recall_checked(spark, sf_dir, P.QUERY).hits


ASKED = ("the with thing", "to be", "ui", "", '"( ): *^"', "zzzzqq xxyyzz", '"THE"')


@query("RET-19_recall_checked", model_sql("""
    SELECT q AS query, CASE WHEN terms = [] THEN 'no terms' WHEN n = 0 THEN 'nothing found' ELSE 'found' END AS reason, n > 0 AS hits
    FROM (SELECT q, terms, (SELECT count(*) FROM messages m WHERE len(list_filter(terms, lambda t: list_contains(regexp_split_to_array(lower(m.content), '[^\\p{L}\\p{N}]+'), t)
              OR (len(t) >= 3 AND NOT starts_with(lower(m.content), '[tool_result]') AND contains(lower(m.content), t)))) > 0) AS n
          FROM (SELECT q, list_filter(list_transform(string_split(lower(q), ' '), lambda w: regexp_replace(w, '["()*:^]', '', 'g')), lambda w: w <> '') AS terms
                FROM (SELECT unnest(['the with thing', 'to be', 'ui', '', '"( ): *^"', 'zzzzqq xxyyzz', '"THE"']) AS q)))"""))
def checked_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short, empty and quoted-only queries, each with its reason."""
    out = []
    for text in ASKED:
        found = recall_checked(spark, sf_dir, text)
        out.append((text, found.reason, not found.hits.isEmpty()))
    return spark.createDataFrame(out, "query string, reason string, hits boolean")


@query("RET-19_abstained", """
    WITH d AS (SELECT sqrt(greatest(0, 2 - 2 * round(list_inner_product(CAST(e.embedding AS DOUBLE[]), [CASE WHEN i = 1 THEN 1.0 ELSE 0.0 END FOR i IN range(1, len(e.embedding) + 1)]), 9))) AS d FROM embeddings e
               WHERE vec_id IN (SELECT id % 1000 FROM (SELECT conv_id * 1000 + turn AS id FROM conversations)) ORDER BY d LIMIT 60)
    SELECT CASE WHEN (SELECT min(d) FROM d) > 0.86 AND (SELECT d FROM d ORDER BY d OFFSET 9 LIMIT 1) - (SELECT min(d) FROM d) < 0.05 THEN 'abstained' ELSE 'found' END AS reason,
           round((SELECT min(d) FROM d), 6) AS top_distance FROM range(1)""")
def abstained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query along the first axis: near to nothing, so the recall says that it abstains, and from how far."""
    held = table(spark, sf_dir, "embeddings")
    # each vector is held once, by the first message whose turn has its number
    owners = messages(spark, sf_dir).groupBy((F.col("id") % 1000).alias("vec_id")).agg(F.min("id").alias("id"))
    vectors = owners.join(held, "vec_id").select("id", "embedding")
    axis = held.orderBy("vec_id").limit(1).select(F.transform("embedding", lambda x, i: F.when(i == 0, 1.0).otherwise(0.0)).alias("q"))
    found = recall_checked(spark, sf_dir, "the with thing", vector=axis, vectors=vectors)
    return spark.createDataFrame([(found.reason, round(found.top_distance, 6))], "reason string, top_distance double")


_NEAR = """unit AS (SELECT vec_id, list_transform(h, lambda x: CAST(x / sqrt(list_inner_product(h, h)) AS FLOAT)) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS h FROM embeddings)),
    pairs AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(CAST(a.u AS DOUBLE[]), CAST(b.u AS DOUBLE[])), 6) AS cosine FROM unit a, unit b WHERE a.vec_id % 20 = 0 AND b.vec_id % 9 <> 4)"""


@query("EMB-05_quantised_store", f"""WITH {_NEAR}
    SELECT query_id, vec_id, cosine FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 10""")
@query("RET-08_quantised_store", f"""WITH {_NEAR}
    SELECT query_id, vec_id, cosine FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 10""")
def quantised_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest by an index in bytes that was added to twice, removed from twice, and added to again."""
    from palimpsest.operators.vector_store import VectorStore

    held = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    width = held.agg(F.max(F.size("embedding"))).first()[0]
    store = VectorStore.create(spark, profile="raw", width=width, native=width)
    store.add(held.filter("vec_id % 2 = 0"), profile="raw")
    store.add(held.filter("vec_id % 2 = 1"), profile="raw")
    store.remove(held.filter("vec_id % 9 = 4 or vec_id % 5 = 3"))
    store.add(held.filter("vec_id % 5 = 3 and vec_id % 9 <> 4"), profile="raw")
    asked = held.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return store.search(asked, 10, digits=6).select("query_id", "vec_id", "cosine")


@query("EMB-06_trained_embedding", r"""
    WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w FROM documents),
    v AS (SELECT w FROM t GROUP BY w HAVING count(*) >= 3 ORDER BY count(*) DESC, w LIMIT 20000),
    k AS (SELECT DISTINCT doc_id FROM t SEMI JOIN v USING (w))
    SELECT doc_id, CASE WHEN k.doc_id IS NOT NULL THEN 64 END AS dims, CASE WHEN k.doc_id IS NOT NULL THEN 1.0 END AS norm FROM documents LEFT JOIN k USING (doc_id)""")
def trained_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by an embedding that is trained on all of them: unit vectors, null where no word is known."""
    from palimpsest.operators import embedding

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = docs.select("doc_id", embedding.train(docs).of(F.col("text")).alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return held.select("doc_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("dims"), F.round(length, 4).alias("norm"))


@query("RET-12_trained_rerank")
def trained_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of odd benchmark items in the order of a scorer that was fitted on the even ones."""
    from palimpsest.operators import evaluation, pair_scorer

    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")
    said = F.array_join(F.filter(F.split("text", " "), lambda w, i: i % 5 != 4), " ")
    queries = items.select("item_id", said.alias("text"))
    near = evaluation.four_word_ranks(queries, docs).filter("pos <= 40").select("item_id", "doc_id", (F.col("pos") - 1).alias("place"))
    held = near.join(items.select("item_id", F.col("text").alias("whole"), said.alias("query")), "item_id").join(docs.withColumnRenamed("text", "passage"), "doc_id")
    held = materialize(held.select(F.col("item_id").alias("query_id"), "doc_id", "query", "passage", "place", F.contains("passage", "whole").alias("good")), "rerank-candidates")
    scorer = pair_scorer.fit(held.filter("query_id % 2 = 0"), pair_scorer.rarities(queries, docs))
    scored = held.filter("query_id % 2 = 1").withColumn("score", scorer.score(F.col("query"), F.col("passage"), F.col("place")))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "place")).cast("long")
    return scored.select(F.col("query_id").alias("item_id"), "doc_id", F.col("place").cast("long").alias("place"), pos.alias("pos"), "good")
