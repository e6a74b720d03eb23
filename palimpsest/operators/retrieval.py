"""Full-text streams over messages: BM25 over the query's terms, in two scans and without a stored index."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scalars import is_tool_text, tokens
from palimpsest.operators.ranking import stream

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
POOL = 60
# Weights of the streams that are fused.
WEIGHTS = {"and": 1.0, "trigram": 0.3, "or": 0.3, "rare": 0.45, "feedback": 0.35, "vector": 1.6}


def query_terms(query: str) -> list[str]:
    """Lower-case words without query syntax."""
    words = (re.sub(r'["()*:^]', "", w) for w in query.lower().split())
    return list(dict.fromkeys(w for w in words if w))


def terms_of(query: Column) -> Column:
    """As ``query_terms``, of a column of queries."""
    words = F.transform(F.split(F.lower(query), r"[ \t\n\x0B\f\r]+"), lambda w: F.regexp_replace(w, F.lit(r'["()*:^]'), F.lit("")))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _bm25(tf: Column, df: Column, n: Column, dl: Column, mean: Column) -> Column:
    idf = F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def scored(rows: DataFrame, counts: list[Column], length: Column, *, every: bool, weight: list[float] | None = None) -> DataFrame:
    """Rows that hold one of the counted terms (or every), with their BM25 ``score``.

    One scan sums the corpus's figures into a single row, which a second scan takes along. Without terms there are no rows.
    """
    if not counts:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    n = range(len(counts))
    held = rows.select("*", length.cast("double").alias("dl"), *(c.cast("double").alias(f"tf_{i}") for i, c in enumerate(counts)))
    figures = held.agg(
        F.count("*").cast("double").alias("n"), F.avg("dl").alias("mean"), *(F.count_if(F.col(f"tf_{i}") > 0).cast("double").alias(f"df_{i}") for i in n)
    )
    present = [F.col(f"tf_{i}") > 0 for i in n]
    keep = present[0]
    for more in present[1:]:
        keep = keep & more if every else keep | more
    score = F.lit(0.0)
    for i in n:
        score = score + (weight[i] if weight else 1.0) * _bm25(F.col(f"tf_{i}"), F.col(f"df_{i}"), F.col("n"), F.col("dl"), F.col("mean"))
    out = held.filter(keep).crossJoin(F.broadcast(figures))  # a single row
    return out.withColumn("score", F.round(score, 9)).drop("dl", "n", "mean", *(f"tf_{i}" for i in n), *(f"df_{i}" for i in n))


def _count_of(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda t: t == term))


def word_stream(rows: DataFrame, terms: list[str], *, every: bool, text: str = "content") -> DataFrame:
    words = tokens(F.col(text))
    return scored(rows, [_count_of(words, t) for t in terms], F.size(words), every=every)


def trigram_stream(rows: DataFrame, terms: list[str], text: str = "content") -> DataFrame:
    """Rows other than tool results that hold a term of three characters or more as a substring."""
    low = F.lower(F.col(text))
    held = rows.filter(~low.startswith("[tool_result]"))
    long = [t for t in terms if len(t) >= 3]
    counts = [F.floor((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)) for t in long]
    return scored(held, counts, F.greatest(F.length(low) - 2, F.lit(0)), every=False)


def best(scored_rows: DataFrame, pool: int = POOL, id_col: str = "id") -> DataFrame:
    return stream(scored_rows, pool, F.desc("score"), id_col)


def document_frequencies(rows: DataFrame, terms: list[str], text: str = "content") -> DataFrame:
    words = tokens(F.col(text))
    counts = rows.agg(*(F.count_if(F.array_contains(words, t)).alias(f"df_{i}") for i, t in enumerate(terms)))
    pairs = F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"df_{i}").alias("df")) for i, t in enumerate(terms)))
    return counts.select(F.explode(pairs).alias("p")).select("p.term", "p.df")


def rare_terms(rows: DataFrame, terms: list[str], most: int = 3, text: str = "content") -> DataFrame:
    """The terms in fewest documents; only for queries of more than three terms."""
    held = document_frequencies(rows, terms, text).filter("df > 0")
    return held.filter(F.lit(len(terms) > 3)).orderBy("df", "term").limit(most)


def feedback_terms(
    rows: DataFrame, seeds: DataFrame, *, chars: int = 2000, candidates: int = 40, most: int = 8, share: float = 0.05, least: int = 3, text: str = "content"
) -> DataFrame:
    """Terms that the best hits share and the corpus holds seldom: documents times ln(N/df); none with too few seeds."""
    words = F.explode(F.array_distinct(feedback_tokens(F.left(text, F.lit(chars))))).alias("term")
    enough = seeds.agg((F.count("*") >= least).alias("enough"))
    held = seeds.crossJoin(F.broadcast(enough)).filter("enough").select(words).groupBy("term").agg(F.count("*").alias("docs"))
    held = held.filter("docs >= 2").orderBy(F.desc("docs"), "term").limit(candidates)
    corpus = rows.select(F.explode(F.array_distinct(feedback_tokens(F.col(text)))).alias("term"))
    df = corpus.join(F.broadcast(held), "term").groupBy("term", "docs").agg(F.count("*").alias("df"))  # at most ``candidates`` rows
    n = rows.agg(F.count("*").alias("n"))
    common = df.crossJoin(F.broadcast(n)).filter(F.col("df") <= F.col("n") * share)
    return common.withColumn("score", F.round(F.col("docs") * F.ln(F.col("n") / F.col("df")), 6)).orderBy(F.desc("score"), "term").limit(most).select("term", "docs", "df", "score")


def feedback_tokens(text: Column) -> Column:
    words = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}_.\-/]+"), lambda t: F.regexp_replace(t, F.lit(r"^[.\-/]+|[.\-/]+$"), F.lit("")))
    return F.filter(words, lambda t: F.length(t).between(3, 40))


def demote_tools(ranked: DataFrame, factor: float) -> DataFrame:
    """Scores of tool output times a factor, everything ranked anew; nothing is dropped."""
    tool = F.col("tool_name").isNotNull() | ((F.col("role") == "user") & is_tool_text(F.left("content", F.lit(16))))
    held = ranked.withColumn("score", F.round(F.when(tool, F.col("score") * factor).otherwise(F.col("score")), 12))
    return held.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)
