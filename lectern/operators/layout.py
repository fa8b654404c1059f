"""Geometry of page blocks: regions, page layout and reading order, with windows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADER, FOOTER, WIDE, CENTRED, NARROWEST, SIDE_CHARACTERS = 0.09, 0.93, 0.35, 0.03, 0.08, 50
_PAGE = ["source_record_id", "page_number"]


def region(header: float = HEADER, footer: float = FOOTER) -> Column:
    """Region of a block from ``x0 y0 x1 y1`` and its page's ``width`` and ``height``."""
    x0, x1, w, h = F.col("x0"), F.col("x1"), F.col("width"), F.col("height")
    middle, page = (x0 + x1) / 2, w / 2
    wide = (x0 < page) & (page < x1) & (x1 - x0 >= w * WIDE)
    heading = (F.abs(middle - page) <= w * CENTRED) & (x1 - x0 >= w * NARROWEST)
    return F.when(F.col("y1") <= h * header, "header").when(F.col("y0") >= h * footer, "footer").when(wide | heading, "body_full").when(middle < page, "body_left").otherwise("body_right")


def page_layout(blocks: DataFrame) -> DataFrame:
    """``single_column``, ``two_column`` or ``mixed`` for every page; both sides have to hold enough text."""
    side = lambda name: F.coalesce(F.sum(F.when(F.col("region") == name, F.length("text"))), F.lit(0)) >= SIDE_CHARACTERS
    full = F.count_if(F.col("region") == "body_full") > 0
    return blocks.groupBy(*_PAGE).agg(F.when(~(side("body_left") & side("body_right")), "single_column").when(full, "mixed").otherwise("two_column").alias("layout"))


def reading_order(blocks: DataFrame, header: float = HEADER, footer: float = FOOTER) -> DataFrame:
    """Add ``region``, ``layout`` and ``reading_order`` (from 1).

    Headers, body, footers.  On pages with columns, full-width blocks cut the body
    into bands, and a band is read left column first.  A side block level with a
    full-width block's centre lies in no band and is read after the last one.
    """
    placed = blocks.withColumn("region", region(header, footer))
    placed = placed.join(page_layout(placed), _PAGE)
    cy = (F.col("y0") + F.col("y1")) / 2
    cuts = F.when((F.col("region") == "body_full") & (F.col("layout") != "single_column"), F.struct(F.col("y0"), F.col("x0"), F.col("raw_block_number"), cy.alias("cy")))
    page = W.partitionBy(*_PAGE)
    # a page's full-width blocks, in their order; a page is bounded
    placed = placed.withColumn("cuts", F.array_sort(F.collect_list(cuts).over(page)))
    above = F.size(F.filter("cuts", lambda c: c["cy"] < cy))
    level = F.exists("cuts", lambda c: c["cy"] == cy)
    own = F.size(F.filter("cuts", lambda c: (c["y0"] < F.col("y0")) | ((c["y0"] == F.col("y0")) & ((c["x0"] < F.col("x0")) | ((c["x0"] == F.col("x0")) & (c["raw_block_number"] < F.col("raw_block_number")))))))
    split = F.col("layout") != "single_column"
    side = F.col("region").isin("body_left", "body_right")
    # the first full-width block that lies lower closes a side block's band
    before = F.array_position(F.transform("cuts", lambda c: c["cy"] > cy), True)
    band = F.when(~split, 0).when(F.col("region") == "body_full", 2 * own + 1).when(level, 2 * F.size("cuts")).when(before > 0, 2 * (before - 1)).otherwise(2 * F.size("cuts"))
    zone = F.when(F.col("region") == "header", 0).when(F.col("region") == "footer", 2).otherwise(1)
    column = F.when(split & side & (zone == 1), F.when((F.col("x0") + F.col("x1")) / 2 < F.col("width") / 2, 0).otherwise(1)).otherwise(0)
    order = page.orderBy("_z", "_b", "_c", "y0", "x0", "raw_block_number")
    out = placed.withColumns({"_z": zone, "_b": F.when(zone == 1, band).otherwise(0), "_c": column, "_above": above})
    return out.withColumn("reading_order", F.row_number().over(order)).drop("cuts", "_z", "_b", "_c", "_above")


def page_statistics(blocks: DataFrame) -> DataFrame:
    """Text of each page in reading order, characters, words, and flags of empty and thin pages."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda b: b["text"]), "\n\n")
    out = blocks.groupBy(*_PAGE).agg(F.count("*").alias("text_block_count"), text.alias("text"))
    return out.withColumn("character_count", F.length("text")).withColumn("word_count", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).withColumn("is_empty", F.col("character_count") == 0).withColumn("is_thin", F.col("character_count") < 50)
