"""Joins by a ``digest`` that few rows share, and that one text, line or page may hold a third of.

Before anything is exchanged a bitmap filter of bounded size says which rows can
have a partner, and digests with more than a thousandth of all rows, of which
there are under a thousand, meet their partner where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 32768  # what one bitmap of bitmap_construct_agg holds
BITS_PER_ENTRY = 64
#: Bitmaps of a filter that is broadcast, at most: 4 MB. Where keys are too many for them, more rows pass that have no partner.
MOST_BITMAPS = 1024
#: A key with more than this part of all rows meets its partner by a broadcast of fewer rows than this.
HOT_PARTS = 1000


def slotted(rows: DataFrame, bitmaps: int) -> DataFrame:
    """Rows with the bitmap and the bit that their digest has in a filter of so many bitmaps."""
    slot = F.pmod(F.xxhash64("digest"), F.lit(bitmaps * FILTER_BITS))
    return rows.withColumn("slot", slot).withColumn("bucket", F.expr(f"slot div {FILTER_BITS}")).withColumn("bit", F.pmod("slot", F.lit(FILTER_BITS))).drop("slot")


def has_bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``known``: true for all whose digest is one of ``keys``, and for few others."""
    bitmaps = min(MOST_BITMAPS, max(1, -(-keys.count() * BITS_PER_ENTRY // FILTER_BITS)))
    bits = slotted(keys, bitmaps).groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
    found = slotted(rows, bitmaps).join(F.broadcast(bits), "bucket", "left")
    return found.select(*rows.columns, F.coalesce(has_bit(F.col("bits"), F.col("bit")), F.lit(False)).alias("known"))


def join_by_digest(rows: DataFrame, partners: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with their partner; ``partners`` has each digest once, with the number of its rows as ``copies``."""
    total = partners.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.col("copies") > -(-total // HOT_PARTS)
    few = F.broadcast(partners.filter(hot))  # the copies of each are over a thousandth of the sum
    others = rows.join(few, "digest", "left_anti").join(partners.filter(~hot).hint("merge"), "digest", how)
    return rows.join(few, "digest").select(others.columns).unionByName(others)
