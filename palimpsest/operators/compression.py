"""Compression of tool output, line by line: noise, blanks, repeats, then head and tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

LIGHT, MOST_ERRORS = 50, 60
WITH_ERRORS, WITHOUT = (30, 20), (14, 8)

# Terminal escapes, error lines, progress lines and spinners.
ANSI = r"\x1b\[[0-9;?]*[A-Za-z]"
ERROR = (
    r"(?i)\b(error|errors|fail(ed|ure|s)?|exception|traceback|fatal|panic|denied|refused|cannot|unable|undefined|null pointer|segfault)\b"
    r"|✗|✘|\bERR\b|\bE\d{3,}\b"
)
PROGRESS = (
    r"(?i)^\s*(\d{1,3}%|\[=*>?\.* *\]|[#█▓▒░]+ *\d|\.{3,}|"
    r"(downloading|fetching|resolving|extracting|building|compiling|installing)\b.*\d+\s*%)"
)
SPINNER = r"^[\s|/\-\\]+$"

def _in_order() -> WindowSpec:
    return Window.partitionBy("key").orderBy("pos")


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line), pos from 0."""
    return rows.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def clean(held: DataFrame) -> DataFrame:
    """Without carriage returns, closing blanks, progress bars and spinners."""
    line = F.regexp_replace(F.regexp_replace("line", F.lit("\r"), F.lit("")), F.lit("[ \t]+$"), F.lit(""))
    return held.withColumn("line", line).filter(~F.col("line").rlike(PROGRESS) & ~F.col("line").rlike(SPINNER))


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def collapse_blanks(held: DataFrame) -> DataFrame:
    again = _blank(F.col("line")) & F.coalesce(_blank(F.lag("line").over(_in_order())), F.lit(False))
    return held.withColumn("again", again).filter(~F.col("again")).drop("again")


def runs(held: DataFrame) -> DataFrame:
    """(key, pos, line, n): equal neighbours as one row; blank lines each for itself."""
    same = (F.col("line") == F.lag("line").over(_in_order())) & ~_blank(F.col("line"))
    numbered = held.withColumn("fresh", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(_in_order()))
    return numbered.groupBy("key", "run").agg(F.min("pos").alias("pos"), F.first("line").alias("line"), F.count("*").alias("n")).drop("run")


def windows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, part): the lines left of each text, and the part that each is in.

    ``whole`` is a text short enough to stay; of others ``head`` and ``tail`` stay, longer where there are errors, and
    between them at most 60 ``error`` lines; the rest is ``omitted``.
    """
    held = runs(collapse_blanks(clean(lines(rows, key, text))))
    held = held.withColumn("line", F.when(F.col("n") > 1, F.concat("line", F.lit("  (×"), "n", F.lit(")"))).otherwise(F.col("line")))
    everyone = Window.partitionBy("key")
    held = (
        held.withColumn("bad", F.col("line").rlike(ERROR)).withColumn("nth", F.row_number().over(_in_order()))
        .withColumn("count", F.count("*").over(everyone)).withColumn("any_bad", F.max("bad").over(everyone))
    )
    head = F.when(F.col("any_bad"), WITH_ERRORS[0]).otherwise(WITHOUT[0])
    tail = F.when(F.col("any_bad"), WITH_ERRORS[1]).otherwise(WITHOUT[1])
    place = F.when((F.col("count") <= LIGHT) | (F.col("count") <= head + tail), "whole").when(F.col("nth") <= head, "head")
    held = held.withColumn("part", place.when(F.col("nth") > F.col("count") - tail, "tail").when(F.col("bad"), "error").otherwise("omitted"))
    nth_bad = F.sum((F.col("part") == "error").cast("int")).over(_in_order())
    part = F.when((F.col("part") == "error") & (nth_bad > MOST_ERRORS), "omitted").otherwise(F.col("part"))
    return held.select("key", "pos", "line", "any_bad", part.alias("part"))


def compress(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, before, after, text): each text compressed; a short one nearly as it is."""
    raw = rows.withColumn("plain", F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(ANSI), F.lit("")))
    sizes = raw.select(F.col(key).alias("key"), F.size(F.split("plain", "\n")).cast("long").alias("before"))
    of = lambda *parts: F.transform(F.sort_array(F.collect_list(F.when(F.col("part").isin(*parts), F.struct("pos", "line")))), lambda x: x["line"])
    out = windows(raw, key, "plain").groupBy("key").agg(
        of("whole", "head").alias("top"), of("error").alias("errors"), of("tail").alias("end"), F.count_if(F.col("part") == "omitted").alias("omitted"),
        F.bool_or(F.col("part") == "head").alias("cut"), F.max("any_bad").alias("any_bad"),
    )
    note = F.concat(F.lit("… ["), "omitted", F.lit(" line(s) omitted"), F.when(F.col("any_bad"), "; error lines kept").otherwise(""), F.lit("] …"))
    parts = F.concat("top", F.when(F.col("cut"), F.array(note)).otherwise(F.array().cast("array<string>")), "errors", "end")
    done = out.select("key", F.array_join(parts, "\n").alias("text"), F.size(parts).cast("long").alias("after"))
    return sizes.join(done, "key", "left").select("key", "before", F.coalesce("after", F.lit(0)).alias("after"), F.coalesce("text", F.lit("")).alias("text"))


def _sizes(text: Column) -> tuple[Column, Column, Column]:
    chars = F.length(text).cast("long")
    lines_of = F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    return chars, lines_of, F.ceil(chars / 4)


def replay(rows: DataFrame, key: str, text: str, signals: str) -> DataFrame:
    """What compression saves and whether it keeps what it must: sizes, saved percents and the signals that were lost.

    Tokens are estimates, a quarter of the characters. ``signals`` is an array of strings that have to survive.
    """
    out = compress(rows, key, text).select("key", F.col("text").alias("short"))
    held = rows.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("long"), F.col(signals).alias("signals")).join(out, "key")
    (chars, n_lines, tokens), (chars_left, lines_left, tokens_left) = _sizes(F.col("long")), _sizes(F.col("short"))
    saved = lambda a, b: F.when(a > 0, F.round((1 - b / a) * 100)).otherwise(0).cast("long")
    missing = F.filter("signals", lambda s: ~F.contains(F.col("short"), s))
    return held.select(
        "key", saved(chars, chars_left).alias("saved_chars_pct"), saved(n_lines, lines_left).alias("saved_lines_pct"),
        F.greatest(F.lit(0), tokens - tokens_left).alias("tokens_avoided"), (F.size(missing) == 0).alias("signals_kept"), missing.alias("missing"),
    )
