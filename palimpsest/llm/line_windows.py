"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines that are not blank make a window; windows are
hashed and counted over the whole corpus. Of a window that occurs more than
once the first occurrence, by identifier and place, stays; the lines that any
later occurrence covers are removed, overlapping ones once. A removed line
always stands in an earlier window, so no line is lost altogether.

The exchange carries hashes and places, never lines; the first occurrence is
found by a combining aggregate. Windows that a bounded filter knows not to repeat
are not exchanged again, and those with more than a thousandth of all repetitions
meet their first occurrence where they are read. Texts move only where the filter
says that lines of them may be covered.

Defined cases: a null text counts as empty; blank lines (of blanks, tabs and
carriage returns alone) belong to no window and stay; an empty table gives an
empty result; texts of fewer than three lines are left as they are; rows that repeat
identifier and text are one document and lose the same lines; a null identifier
comes first; columns of the input beside the text are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.key_joins import join_by_digest, marked
from palimpsest.storage import discard, materialize, table

WINDOW = 3
#: What a blank line may hold, a carriage return before the line feed among it.
BLANK = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, nth, at, digest): each window's place among its document's windows, its lines' places and its hash."""
    hashed = F.transform(_lines(F.col(text_col)), lambda line, i: F.struct(i.alias("i"), F.md5(line.cast("binary")).alias("h"), F.trim(line, F.lit(BLANK)).alias("t")))
    solid = F.filter(hashed, lambda line: line["t"] != "")
    lines = docs.select(
        F.col(id_col).alias("doc"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("tag"),
        F.transform(solid, lambda line: F.struct(line["i"].alias("i"), line["h"].alias("h"))).alias("solid"),
    ).filter(F.size("solid") >= WINDOW)
    place = F.sequence(F.lit(1), F.size("solid") - (WINDOW - 1))
    # windows are made before they are exploded: a row carries its own three lines only
    three = lambda n, field: F.transform(F.slice("solid", n, F.lit(WINDOW)), lambda line: line[field])
    window = lambda n: F.struct(n.alias("nth"), three(n, "i").alias("at"), F.md5(F.array_join(three(n, "h"), "").cast("binary")).alias("digest"))
    return lines.select("doc", "tag", F.explode(F.transform(place, window)).alias("w")).select("doc", "tag", "w.nth", "w.at", "w.digest")


def later_lines(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc, tag, covered): the lines of each document that later occurrences of ``repeated`` windows cover."""
    met = join_by_digest(marked(found, repeated).filter("known").drop("known"), repeated)
    later = met.filter(~F.struct("doc", "tag", "nth").eqNullSafe(F.col("first")))
    return later.groupBy("doc", "tag").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("covered"))


def drop_repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` as structs ``row``, with ``cleaned`` text and the numbers of ``lines`` and ``removed`` ones."""
    found = materialize(windows(docs, id_col, text_col), "line-windows")
    first = F.min(F.struct("doc", "tag", "nth")).alias("first")
    repeated = materialize(found.groupBy("digest").agg(first, F.count("*").alias("copies")).filter("copies > 1"), "repeated-windows")
    covered = materialize(later_lines(found, repeated), "covered-lines")
    discard(found, repeated)
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(id_col).alias("id"), F.col(text_col).alias("body"),
        F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"),
    )
    rows = marked(rows, covered.select(F.col("tag").alias("digest")))
    # what is covered has no bound, so it is never broadcast
    met = rows.filter("known").join(covered.hint("merge"), (F.col("digest") == F.col("tag")) & F.col("id").eqNullSafe(F.col("doc")), "left")
    untouched = rows.filter(~F.col("known")).withColumn("covered", F.lit(None).cast("array<int>"))
    joined = met.select(untouched.columns).unionByName(untouched)
    lines = _lines(F.col("body"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
    cleaned = F.array_join(F.transform(kept, lambda i: F.element_at(F.col("line_list"), i + 1)), "\n")
    return joined.withColumn("line_list", lines).select(
        "row",
        F.when(F.col("covered").isNull(), F.col("body")).otherwise(cleaned).alias("cleaned"),
        F.size("line_list").cast("long").alias("lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("removed"),
    )


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of every document, and a digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_windows(docs).select(
        "row.doc_id", "lines", F.greatest("removed", F.lit(0)).cast("long").alias("removed_lines"),
        F.sha2(F.coalesce("cleaned", F.lit("")), 256).alias("cleaned_sha256"),
    )


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """The documents without repeated windows; those of which nothing is left go."""
    out = drop_repeated_windows(docs).filter((F.col("removed") <= 0) | (F.trim(F.regexp_replace("cleaned", r"\s+", " ")) != ""))
    kept = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return out.select(*(kept.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


QUERIES = {"op5_line_windows": op5_line_windows}
ORACLE_SQL = {
    "op5_line_windows": """
        WITH split_up AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (
            SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split_up),
        solid AS (
            SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth
            FROM lines WHERE trim(line, concat(' ', chr(9), chr(13), chr(11), chr(12))) <> ''),
        three AS (
            SELECT doc_id, nth, pos AS p1,
                   lead(pos, 1) OVER w AS p2, lead(pos, 2) OVER w AS p3,
                   md5(md5(line) || lead(md5(line), 1) OVER w || lead(md5(line), 2) OVER w) AS digest
            FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY nth)),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id, nth) AS occurrence
            FROM three WHERE p3 IS NOT NULL),
        covered AS (
            SELECT DISTINCT doc_id, unnest([p1, p2, p3]) AS pos FROM numbered WHERE occurrence > 1)
        SELECT l.doc_id, count(*) AS lines, count(c.pos) AS removed_lines,
               sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '')) AS cleaned_sha256
        FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos
        GROUP BY l.doc_id
    """
}
