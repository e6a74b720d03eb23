"""Markdown, change logs and check lists as tables: one row for each section, entry or item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from palimpsest.functions.scalars import slug

# How fences, headings, dated entries and check list items look.
FENCE = r"^[ \t]*(```|~~~)"
HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"
ENTRY = r"^## (.*?)[ \t]*$"
DATED = r"^\[([^\]]+)\][ \t]*[—-]*[ \t]*(.*)$"
DATED_BARE = r"^(\d{4}-\d{2}-\d{2}[a-z]?)(?:[ \t]*[—–-]+[ \t]*(.*)|[ \t]*)$"
LOG_TITLE = r"(?im)^#[ \t]+.*change[ \t]*log"
ITEM = r"^-\s+(?:\[( |~|x)\]|(✅|⏸))\s*(.*)$"
LINK = r"\[[^\]]*\]\(([^)\s]+)\)"

def _in_order() -> WindowSpec:
    return Window.partitionBy("key").orderBy("pos")


def _numbered(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, fenced): lines and whether they are, or stand in, a fence."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    lines = rows.select(F.col(key).alias("key"), F.posexplode(F.split(whole, "\n")).alias("pos", "line"))
    mark = F.col("line").rlike(FENCE)
    inside = F.sum(mark.cast("int")).over(_in_order()) % 2 == 1
    return lines.withColumn("fenced", mark | inside)


def _blocks(lines: DataFrame, head: Column) -> DataFrame:
    """(key, block, head line, body lines): lines from each head to the next; block 0 is what stands before."""
    held = lines.withColumn("head", head).withColumn("block", F.sum(F.col("head").cast("int")).over(_in_order()))
    grouped = held.groupBy("key", "block").agg(
        F.max(F.when(F.col("head"), F.col("line"))).alias("head_line"),
        F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))).alias("body"),
    )
    return grouped.withColumn("body", F.array_join(F.transform("body", lambda x: x["line"]), "\n"))


def sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, level, heading, anchor, body); what stands before the first heading is a section of level 0."""
    found = _blocks(_numbered(rows, key, text), ~F.col("fenced") & F.col("line").rlike(HEADING))
    found = found.filter((F.col("block") > 0) | (F.col("body") != ""))
    level = F.when(F.col("block") > 0, F.length(F.regexp_extract("head_line", HEADING, 1))).otherwise(0)
    heading = F.when(F.col("block") > 0, F.regexp_extract("head_line", HEADING, 2))
    ordinal = (F.row_number().over(Window.partitionBy("key").orderBy("block")) - 1).alias("ordinal")
    return found.select("key", ordinal, level.alias("level"), heading.alias("heading"), slug(heading).alias("anchor"), "body")


def with_parents(held: DataFrame) -> DataFrame:
    """Sections with the ordinal of the nearest heading above of a smaller level."""
    before = Window.partitionBy("key").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == n, F.col("ordinal"))).over(before).alias(f"last_{n}") for n in range(1, 6)]
    above = F.greatest(*(F.when(F.col("level") > n, F.col(f"last_{n}")) for n in range(1, 6)))
    return held.select("*", *last).withColumn("parent", above).drop(*(f"last_{n}" for n in range(1, 6)))


def render(held: DataFrame) -> DataFrame:
    """The text of each document from its sections."""
    mark = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "heading", F.lit("\n"), "body")
    block = F.when(F.col("level") > 0, mark).otherwise(F.col("body"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", block.alias("block"))))
    return held.groupBy("key").agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n").alias("text"))


def changelog(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, date, title, body): dated entries; without any, all of them where the title says change log."""
    lines = _numbered(rows, key, text)
    entry = F.when(~F.col("fenced"), F.regexp_extract("line", ENTRY, 1))
    is_entry = ~F.col("fenced") & F.col("line").rlike(ENTRY)
    dated = is_entry & (entry.rlike(DATED) | entry.rlike(DATED_BARE))
    whole = Window.partitionBy("key")
    lines = lines.withColumn("dated", dated).withColumn("any_dated", F.max("dated").over(whole))
    lines = lines.withColumn("is_log", F.max(F.col("line").rlike(LOG_TITLE)).over(whole))
    head = F.when(F.col("any_dated"), F.col("dated")).otherwise(F.col("is_log") & is_entry)
    found = _blocks(lines, head).filter("block > 0").withColumn("entry", F.regexp_extract("head_line", ENTRY, 1))
    bare, bracket = F.col("entry").rlike(DATED_BARE), F.col("entry").rlike(DATED)
    pick = lambda n: F.when(bracket, F.regexp_extract("entry", DATED, n)).when(bare, F.regexp_extract("entry", DATED_BARE, n))
    return found.select(
        "key", (F.col("block") - 1).alias("nth"), pick(1).alias("date"), F.coalesce(pick(2), "entry").alias("title"),
        F.regexp_replace("body", F.lit(r"\s+$"), F.lit("")).alias("body"),
    )


def items(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, status, title, body): check list items with the indented lines that go on."""
    lines = _numbered(rows, key, text)
    head = F.col("line").rlike(ITEM)
    stop = ~head & F.col("line").rlike(r"^\S")
    held = lines.withColumn("head", head).withColumn("block", F.sum((head | stop).cast("int")).over(_in_order()))
    grouped = held.filter(head | F.col("line").rlike(r"^\s+\S")).groupBy("key", "block").agg(
        F.max(F.when(F.col("head"), F.col("line"))).alias("first"), F.max(F.when(F.col("head"), F.col("pos") + 1)).alias("line"),
        F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))).alias("more"),
    ).filter("first is not null")
    sign = F.concat(F.regexp_extract("first", ITEM, 1), F.regexp_extract("first", ITEM, 2))
    status = F.when(sign.isin("x", "✅"), "done").when(sign == "~", "doing").otherwise("open")
    title = F.regexp_extract("first", ITEM, 3)
    body = F.array_join(F.concat(F.array(title), F.transform("more", lambda m: m["line"])), "\n")
    return grouped.select("key", F.col("line").cast("long").alias("line"), status.alias("status"), F.left(title, F.lit(110)).alias("title"), body.alias("body"))


def links(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, target): links within the project, without anchors."""
    found = rows.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(text, F.lit(LINK), F.lit(1))).alias("target"))
    inner = found.filter(~F.col("target").rlike("^([a-z]+:|#)"))
    return inner.withColumn("target", F.regexp_replace("target", F.lit("#.*$"), F.lit("")))
