"""A training corpus from ``documents``: five stages, each reading what the one before has written.

Toxic documents go, windows of lines that repeat go, one document of each class
of near copies stays, sources are mixed to their target weights, and what is
left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import chosen_path_join, counterfactual_toxicity, curriculum_mix, line_windows, tiered_packing
from palimpsest.storage import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of this corpus, does not call toxic."""
    return counterfactual_toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of three-line windows."""
    return line_windows.cleaned_documents(docs)


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of similar ones."""
    return chosen_path_join.one_of_each_class(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, whole or in part; ``n_chars`` counts what is taken, other columns go along."""
    beside = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    taken = curriculum_mix.training_order(curriculum_mix.mix(docs.select("doc_id", "source", "text", beside.alias("beside"))))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return taken.select(*(own.get(c, F.col(f"beside.`{c}`")).alias(c) for c in docs.columns))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of token ids."""
    return tiered_packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _toxicity),
    ("line_dedup", _line_dedup),
    ("ngram_jaccard_join", _near_copies),
    ("mix_sources", _mix),
    ("pack", _pack),
]

#: A classifier and a tokenizer decide here, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every other stage's are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return last(spark, docs, sf_dir)
