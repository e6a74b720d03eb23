"""Exact deduplication over a log-structured merge index of text digests.

Rows are dealt to memtables of a bounded number of rows; each memtable is flushed
as one run of (digest, identifier, copies), sorted by digest, beside a bitmap
filter of its digests. Compaction goes by levels: a few neighbouring runs at a
time, it asks the filters which digests may also stand in another of them, merges
only those, and keeps the extreme identifier of each digest, until one run is
left. Rows of a digest with more than one copy, the hits, are then compared byte
for byte with the text that stays; where bytes differ, the digest's rows are
grouped by text.

Everything is built-in DataFrame functions. Hot digests shrink to one row per
memtable and task before any shuffle; the joins that carry every row have digests
and identifiers only, and adaptive execution splits them. Texts of hits alone are
exchanged: a filter of bounded size says which rows may be hits where they are
read, and digests with more than a thousandth of the hits meet the index there,
by a broadcast of under a thousand rows. All meet the text that stays under a salt
that grows with the group.

Defined cases: a null text counts as empty; a null identifier is smaller than
any other; rows that repeat both identifier and text are the same document and
share one verdict; an empty table gives an empty result; columns of the input
beside identifier and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.key_joins import BITS_PER_ENTRY, FILTER_BITS, has_bit, join_by_digest, marked, slotted
from palimpsest.storage import discard, materialize, table

MEMTABLE_ROWS, LEAST_MEMTABLES = 50_000_000, 4
#: Runs that one compaction merges.
FAN_IN = 4
MEMBERS_PER_KEEPER_COPY = 64


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


def flush(rows: DataFrame, keep: str) -> DataFrame:
    """Level 0: for each memtable its sorted run of (run, digest, keep_id, copies)."""
    extreme = F.max if keep == "largest" else F.min
    runs = rows.groupBy("run", "digest").agg(extreme("row_id").alias("keep_id"), F.count("*").alias("copies"))
    return materialize(runs.sortWithinPartitions("run", "digest"), "memtables")


def filters(runs: DataFrame) -> DataFrame:
    """One row for each set of runs and bitmap, with each run's bits, from rows that know their place."""
    held = [F.bitmap_construct_agg(F.when(F.col("member") == r, F.bitmap_bit_position(F.col("bit") + 1))).alias(f"bits_{r}") for r in range(FAN_IN)]
    return runs.groupBy("merged", "bucket").agg(*held)


def compact(runs: DataFrame, keep: str, bitmaps: int) -> DataFrame:
    """One level: each FAN_IN runs become one; digests that no other of them knows by its filter are passed on as they are."""
    extreme = F.max if keep == "largest" else F.min
    placed = slotted(runs, bitmaps).withColumn("merged", F.expr(f"run div {FAN_IN}")).withColumn("member", F.pmod("run", F.lit(FAN_IN)))
    elsewhere = F.lit(False)
    for r in range(FAN_IN):
        elsewhere = elsewhere | ((F.col("member") != r) & F.coalesce(has_bit(F.col(f"bits_{r}"), F.col("bit")), F.lit(False)))
    probed = placed.join(filters(placed), ["merged", "bucket"]).select(F.col("merged").alias("run"), "digest", "keep_id", "copies", elsewhere.alias("elsewhere"))
    probed = materialize(probed, "probed")
    columns = ["run", "digest", "keep_id", "copies"]
    alone = probed.filter(~F.col("elsewhere")).select(columns)
    merged = probed.filter("elsewhere").groupBy("run", "digest").agg(extreme("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
    out = materialize(alone.unionByName(merged).sortWithinPartitions("run", "digest"), "compacted")
    discard(probed)
    return out


def deduplicate(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    memtables: int | None = None,
    digest=sha256_of,
) -> DataFrame:
    """Every row of ``docs`` as (row_id, digest, keep_id, copies, kept).

    ``keep`` says which identifier of equal texts stays. ``memtables`` comes from
    the number of rows. ``digest`` may be any function of the text column: texts
    are equal only where their bytes are.
    """
    texts = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    texts = texts.withColumn("digest", digest(F.col("body")))
    if memtables is None:
        memtables = max(LEAST_MEMTABLES, -(-docs.count() // MEMTABLE_ROWS))
    dealt = texts.select("row_id", "digest", F.pmod(F.xxhash64("row_id"), F.lit(memtables)).alias("run"))
    index = flush(dealt, keep)
    bitmaps = max(1, -(-index.count() * BITS_PER_ENTRY // (FILTER_BITS * memtables)))
    while memtables > 1:
        merged = compact(index, keep, bitmaps)
        discard(index)
        index, memtables, bitmaps = merged, -(-memtables // FAN_IN), bitmaps * FAN_IN
    index = index.drop("run")

    columns = ["row_id", "digest", "keep_id", "copies", "same"]
    single = texts.select("row_id", "digest").join(index.filter("copies = 1"), "digest").withColumn("same", F.lit(True))
    spread = F.ceil(F.col("copies") / MEMBERS_PER_KEEPER_COPY).cast("int")
    copied = index.filter("copies > 1")
    hits = join_by_digest(marked(texts, copied).filter("known").drop("known"), copied).withColumn("salt", F.pmod(F.xxhash64("row_id", F.lit(1)), spread))
    keepers = (
        hits.filter(F.col("row_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest", "copies")
        .agg(F.max("body").alias("kept_body"))
        .select("digest", F.explode(F.sequence(F.lit(0).cast("long"), spread.cast("long") - 1)).alias("salt"), "kept_body")
    )
    verified = hits.join(keepers, ["digest", "salt"]).withColumn("same", F.col("body") == F.col("kept_body"))
    verdict = materialize(single.select(columns).unionByName(verified.select(columns)), "verdict")

    broken = verdict.filter("not same").select("digest").distinct()
    if not broken.isEmpty():
        verdict = verdict.join(broken, "digest", "left_anti").unionByName(
            _by_bytes(texts.join(broken, "digest", "left_semi"), keep)
        )
    return verdict.select(
        "row_id", "digest", "keep_id", "copies", F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept")
    )


def _by_bytes(rows: DataFrame, keep: str) -> DataFrame:
    """For digests that different texts share: the same verdict, by text."""
    extreme = F.max if keep == "largest" else F.min
    groups = rows.groupBy("digest", "body").agg(extreme("row_id").alias("keep_id"), F.count("*").alias("copies"))
    return rows.join(groups, ["digest", "body"]).select(
        "row_id", "digest", "keep_id", "copies", F.lit(True).alias("same")
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; one row per document."""
    return deduplicate(table(spark, sf_dir, "documents"), keep="largest").select(
        F.col("row_id").alias("doc_id"),
        "keep_id",
        F.col("copies").alias("group_size"),
        "kept",
        F.col("digest").alias("text_sha256"),
    )


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLE_SQL = {
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same_text AS keep_id,
               count(*) OVER same_text AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same_text AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same_text AS (PARTITION BY coalesce(text, ''))
    """
}
