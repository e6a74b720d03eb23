"""Fill-in-middle transformation by overlapping chunks.

A text is a row of units (runs of ASCII letters, or any other single character),
and two random unit ranks cut it into prefix, middle and suffix. A text is never
cut into all its units at once: it is decomposed into chunks of ``chunk_chars``
characters, each with the first character of the next one, so that every pair of
adjacent characters lies in exactly one chunk. A unit ends where a character and
the next are not both letters; every chunk counts its ends by that predicate
alone. Running sums of the counts say which chunk owns each of the two cut ranks,
and only those chunks are scanned again for the place of the cut.

All of it is column functions inside the scan: nothing is shuffled, a task holds
one text at a time, and a lost task is read again.

Defined cases: a null text is empty, and an empty text is plain with no units; a
null identifier draws from the hash of the seed alone; rows that repeat an
identifier draw the same numbers and are rows of their own; an empty table gives
an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.storage import table

CHUNK_CHARS = 1024
#: Percent of documents that are cut at all, and of those, percent with the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
SEED = "1:"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: A letter that another follows: all characters but these end a unit.
INNER = "[A-Za-z]+(?=[A-Za-z])"


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32 from the identifier."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def chunks(text: Column, chunk_chars: int) -> Column:
    """Pieces of ``chunk_chars`` characters with the first character of the next one; the last has none to take."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{chunk_chars + 1}}})).{{1,{chunk_chars}}}"), F.lit(1))


def ends(chunk: Column, chunk_chars: int) -> Column:
    """Units that end in a chunk: what is left without inner letters, less the next chunk's character."""
    borrowed = (F.length(chunk) > chunk_chars).cast("int")
    return F.length(F.regexp_replace(chunk, F.lit(INNER), F.lit(""))) - borrowed


def _route(counts: Column, low: Column, high: Column) -> Column:
    """Running sums over the chunks' counts: for each rank its chunk and the units before that chunk, from one pass."""
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).cast("long").alias("seen"), low.alias("low"), high.alias("high"),
        F.lit(0).alias("low_at"), F.lit(0).cast("long").alias("low_seen"), F.lit(0).alias("high_at"), F.lit(0).cast("long").alias("high_seen"),
    )

    def step(acc: Column, n: Column) -> Column:
        past = acc["seen"] + n
        low_here, high_here = (acc["low"] > acc["seen"]) & (acc["low"] <= past), (acc["high"] > acc["seen"]) & (acc["high"] <= past)
        return F.struct(
            (acc["at"] + 1).alias("at"), past.alias("seen"), acc["low"].alias("low"), acc["high"].alias("high"),
            F.when(low_here, acc["at"]).otherwise(acc["low_at"]).alias("low_at"), F.when(low_here, acc["seen"]).otherwise(acc["low_seen"]).alias("low_seen"),
            F.when(high_here, acc["at"]).otherwise(acc["high_at"]).alias("high_at"), F.when(high_here, acc["seen"]).otherwise(acc["high_seen"]).alias("high_seen"),
        )

    return F.aggregate(counts, start, step)


def _place(parts: Column, at: Column, within: Column, chunk_chars: int) -> Column:
    """Characters before the end of the ``within``-th unit of a chunk: the only scan of its units."""
    units = F.regexp_extract_all(F.get(parts, at), F.lit(UNIT), F.lit(0))
    inside = F.length(F.array_join(F.slice(units, F.lit(1), within.cast("int")), ""))
    return F.when(within > 0, at.cast("long") * chunk_chars + inside).otherwise(F.lit(0).cast("long"))


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form; the text of a form that is not plain holds no marker."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring(F.substring_index(head, SUFFIX, 1), 4, 2**31 - 1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring(F.substring_index(head, PREFIX, 1), 4, 2**31 - 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    cut_percent: int = CUT_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every document, cut or plain."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= cut_percent), "plain").when(h4 % 100 < suffix_first_percent, "spm").otherwise("psm")
    rows = rows.select("*", form.alias("form"), chunks(F.col("text"), chunk_chars).alias("parts"))
    rows = rows.withColumn("counts", F.transform("parts", lambda c: ends(c, chunk_chars).cast("long")))
    rows = rows.withColumn("n", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    first, second = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = F.col("form") != "plain"
    rows = rows.withColumn("owner", F.when(cut, _route(F.col("counts"), F.least(first, second), F.greatest(first, second))))
    places = [_place(F.col("parts"), F.col(f"owner.{x}_at"), F.col(f"owner.{x}") - F.col(f"owner.{x}_seen"), chunk_chars) for x in ("low", "high")]
    rows = rows.select("doc_id", "text", "n", "form", *(F.when(cut, place).alias(x) for place, x in zip(places, ("low", "high"), strict=True)))
    low, high = F.col("low").cast("int"), F.col("high").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), low), F.substring("text", low + 1, high - low), F.substring("text", high + 1, F.lit(2**31 - 1))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(~cut, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select("doc_id", "n", "form", F.col("low").alias("prefix_chars"), (F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))


def op13_chunked_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and cuts, with digests of the output and of the text rebuilt from it."""
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {"op13_chunked_fim": op13_chunked_fim}
ORACLE_SQL = {
    "op13_chunked_fim": """
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
            FROM documents),
        numbers AS (
            SELECT doc_id, text, units, len(units) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
                   CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4
            FROM drawn),
        forms AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM numbers),
        parts AS (
            SELECT *, array_to_string(units[1:lo], '') AS p, array_to_string(units[lo + 1:hi], '') AS m, array_to_string(units[hi + 1:], '') AS s FROM forms)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """
}
