"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight that moves linearly from a start to an end value over
training time 0..1. Its integral gives the source's share of all words; a
source that would need more than ``most_passes`` passes over its documents
stops there and its excess goes to the others by weight. A source's documents,
in a hashed order, are laid end to end, pass after pass, along its demand; the
integrated schedule is inverted at each document's middle to give its training
position, and rows are range-sorted by position.

Running sums over a source are taken in two steps (buckets of the hashed order,
then rows in a bucket), so no source, however large, meets in one task. Texts are
exchanged twice: to their bucket, and to their position. Targets are found from
one row for each source, in one task.

Defined cases: a null text has no words; a null source is a source of its own,
last in order; the hashed order is by identifier and text, so rows that share an
identifier, null or not, are spread by their texts, and rows that repeat both are
ordered by size; documents without words are taken for 0 words and have no
position; an empty table gives an empty result; columns of the input named like a
result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.storage import discard, materialize, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: How far each weight lies above its mean at the start, and below it at the end, as a share of it.
TILT = (0.25, 0.0, -0.5)
SHARE = 1.5
MOST_PASSES = 2
#: Rows of a source in a bucket of the hashed order, roughly, and its least digits in base 16.
BUCKET_ROWS, LEAST_DIGITS = 4096, 3
RESULT = ("size", "source_size", "target", "taken", "first_words", "second_words", "position", "second_position")


def least_digits(rows: int) -> int:
    digits = LEAST_DIGITS
    while rows > BUCKET_ROWS << 4 * digits:
        digits += 1
    return digits


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most_passes: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, target, tilt) from (source, source_size): weights 3, 1, 2 repeating in source order.

    A source stops at ``most_passes`` times its size where the common level
    (words a unit of weight) would take it above; the level is that of the
    first source, by size a unit of weight, that stays below.
    """
    in_order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod("nth", F.lit(3)) + 1).cast("int"))
    ranked = sizes.withColumn("nth", in_order).withColumn("weight", pick(WEIGHTS)).withColumn("tilt", pick(TILT))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * most_passes)
    by_room = Window.orderBy((F.col("cap") / F.col("weight")), "nth")
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("capped", F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    stays = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), "nth", "level"))
    levels = levels.withColumn("at", F.min(stays).over(everything)["level"])
    return levels.select("source", "source_size", F.least("cap", F.col("at") * F.col("weight")).alias("target"), "tilt")


def _when(share: Column, tilt: Column) -> Column:
    """Training time at which a source's integrated schedule reaches a share of its demand.

    The weight a(1 + tilt(1 - 2t)) integrates to t + tilt(t - t^2).
    """
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + tilt) * (1 + tilt) - 4 * tilt * share))  # never asked for a null share
    return F.when(tilt == 0, share).otherwise((1 + tilt - root) / (2 * tilt))


def mix(docs: DataFrame, *, carry: list[str] | None = None, share: float = SHARE, digits: int | None = None) -> DataFrame:
    """Every row of ``docs`` with its source's target, the words the mix takes of it, and the positions of the two times.

    ``carry`` names the input's columns to keep (all). ``digits`` of the hashed
    order, in base 16, make a bucket: as many as leave BUCKET_ROWS rows or so in
    each, however large the input; the result does not depend on them.
    """
    if digits is None:
        digits = least_digits(docs.count())
    kept = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    identity = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    sized = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"),
        F.col("source"),
        # never null, so that windows and joins are dealt alike
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src"),
        F.col("doc_id"),
        words(F.col("text")).alias("size"),
        F.md5(identity.cast("binary")).alias("hashed"),
    ).withColumn("bucket", F.substring("hashed", 1, digits))
    buckets = materialize(sized.groupBy("source", "src", "bucket").agg(F.sum("size").alias("held")), "mix-buckets")
    plan = targets(buckets.groupBy("source").agg(F.sum("held").alias("source_size")), share)
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("before", F.coalesce(F.sum("held").over(ahead), F.lit(0)))
    offsets = materialize(
        offsets.alias("o").join(plan.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source")))
        .select("src", "bucket", "before", "source_size", "target", "tilt"),
        "mix-offsets",
    )
    discard(buckets)

    inside = Window.partitionBy("src", "bucket").orderBy("hashed", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["src", "bucket"])
    start, size, whole = F.col("before") + F.col("inside"), F.col("size"), F.floor("target")
    zero = F.lit(0).cast("long")
    first = F.greatest(zero, F.least(size, whole - start))
    second = F.greatest(zero, F.least(size, whole - F.col("source_size") - start))
    at = lambda begin, taken: F.when(taken > 0, _when((begin + taken / 2) / F.col("target"), F.col("tilt")))
    return laid.select(
        "row.*", "size", "source_size", "target", (first + second).alias("taken"),
        first.alias("first_words"), second.alias("second_words"),
        at(start, first).alias("position"), at(start + F.col("source_size"), second).alias("second_position"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each time that a document is taken, range-sorted by position; a document taken in part gives its first words."""
    once = F.struct(F.col("position").alias("at"), F.col("first_words").alias("n"))
    again = F.struct(F.col("second_position").alias("at"), F.col("second_words").alias("n"))
    times = F.explode(F.filter(F.array(once, again), lambda p: p["n"] > 0))
    taken = mixed.select(F.struct(*(F.col(f"`{c}`") for c in mixed.columns)).alias("m"), times.alias("p"))
    body, n = F.col("m.text"), F.col("p.n")
    head = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), F.lit(1), n.cast("int")), " ")
    text = F.when(n < F.col("m.size"), head).otherwise(body)
    kept = [c for c in mixed.columns if c not in RESULT]
    out = taken.select(*(text.alias("text") if c == "text" else F.col(f"m.`{c}`") for c in kept), F.col("p.at").alias("position"))
    return out.repartitionByRange("position").sortWithinPartitions("position")


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, range-sorted by the training positions that the schedule gives them."""
    mixed = mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    slim = mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "second_position")
    order = ["position", "second_position", "doc_id"]
    return slim.repartitionByRange(*order).sortWithinPartitions(*order)


QUERIES = {"op3_curriculum_mix": op3_curriculum_mix}
ORACLE_SQL = {
    "op3_curriculum_mix": r"""
        WITH sized AS (
            SELECT doc_id, source,
                   CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                   md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS hashed
            FROM documents),
        sizes AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth
            FROM sized GROUP BY source),
        weighted AS (
            SELECT *, CAST([3, 1, 2][CAST(nth % 3 AS INTEGER) + 1] AS DOUBLE) AS weight,
                   CAST([0.25, 0, -0.5][CAST(nth % 3 AS INTEGER) + 1] AS DOUBLE) AS tilt,
                   CAST(source_size AS DOUBLE) * 2 AS cap
            FROM sizes),
        levels AS (
            SELECT *, (CAST((SELECT sum(source_size) FROM sizes) AS DOUBLE) * 1.5
                       - (sum(cap) OVER (ORDER BY cap / weight, nth ROWS UNBOUNDED PRECEDING) - cap))
                      / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighted),
        chosen AS (
            SELECT arg_min(level, (cap / weight, nth)) AS level FROM levels WHERE cap / weight >= level),
        plan AS (
            SELECT l.source, l.source_size, l.tilt, least(l.cap, c.level * l.weight) AS target FROM levels l CROSS JOIN chosen c),
        laid AS (
            SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY hashed, doc_id, size
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM sized),
        parts AS (
            SELECT doc_id, size, source_size, target, tilt, start,
                   CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - start)) AS BIGINT) AS n1,
                   CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size - start)) AS BIGINT) AS n2
            FROM laid JOIN plan ON laid.source IS NOT DISTINCT FROM plan.source),
        shares AS (
            SELECT *, CASE WHEN n1 > 0 THEN (CAST(start AS DOUBLE) + CAST(n1 AS DOUBLE) / 2) / target END AS s1,
                   CASE WHEN n2 > 0 THEN (CAST(start + source_size AS DOUBLE) + CAST(n2 AS DOUBLE) / 2) / target END AS s2
            FROM parts)
        SELECT doc_id, size, source_size, target, n1 + n2 AS taken,
               CASE WHEN s1 IS NULL OR tilt = 0 THEN s1 ELSE (1 + tilt - sqrt(greatest(0, (1 + tilt) * (1 + tilt) - 4 * tilt * s1))) / (2 * tilt) END AS position,
               CASE WHEN s2 IS NULL OR tilt = 0 THEN s2 ELSE (1 + tilt - sqrt(greatest(0, (1 + tilt) * (1 + tilt) - 4 * tilt * s2))) / (2 * tilt) END AS second_position
        FROM shares
    """
}
