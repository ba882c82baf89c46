"""Types of layout blocks after the densities that a pixel plug-in measures in them, for pages that hold forms.

A block is a row with doc_id (its page), seq, type, box, the densities d_text,
d_line, d_horizontal, d_vertical and d_stroke, and well_formed (whether a table's
lines look like one). Every rule but the last reads its own row; the last
compares a new table with the page's tables by a join on the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions import geometry as G

#: Shares of the page's area, and how many tables are too many (fixed values).
CROWDED, TINY, SMALL, MEDIUM, THIRD_RULE, LARGE, WIDEST = 120, 0.02, 0.05, 0.10, 0.18, 0.35, 0.45
#: A new table that overlaps a table more than this is none.
SAME_TABLE = 0.65


def _of_form_table(share: Column) -> Column:
    """A large table with text or lines in it, and a small one without lines, are parts of a form."""
    return F.when((share > MEDIUM) & ((F.col("d_text") > 0.02) | (F.col("d_line") > 0.015)) | (share < SMALL) & (F.col("d_line") < 0.01), "form")


def _of_area(share: Column, before: Column, tall: Column, strictness: float) -> Column:
    """Pictures stay; grids are tables or forms; text without lines is a title or text; strokes on much area are a form."""
    text, line, stroke = F.col("d_text"), F.col("d_line"), F.col("d_stroke")
    ink = 0.06 + 0.04 * strictness
    picture = (stroke > ink) & (text < 0.08 - 0.03 * strictness) & (share < 0.15)
    grid = (line > 0.015) & (F.col("d_horizontal") > 0.010) & (F.col("d_vertical") > 0.010)
    return (
        F.when(picture, F.lit(None).cast("string"))
        .when(grid, F.when((share > LARGE) | (text >= 0.45), "form").otherwise("table"))
        .when((text > 0.08) & (line < 0.02), F.when(tall, "text").otherwise("title"))
        .when((stroke > ink) & (share > ink) & (text < 0.05 - 0.02 * strictness), "form")
        .otherwise(before)
    )


def reclassified(blocks: DataFrame, width: float, height: float, strictness: float = 0.7) -> DataFrame:
    """blocks with column new_type. Blocks that became tables are compared with the tables found before, not with each other."""
    box, t = G.box(), F.col("type")
    share = F.greatest(G.area(box), F.lit(1.0)) / (width * height)
    tables = F.count_if(t == "table").over(Window.partitionBy("doc_id"))
    b = blocks.withColumn("__share", share).withColumn("__type", F.when((t == "table") & (tables > CROWDED) & (share < TINY), "form").otherwise(t))
    share, t = F.col("__share"), F.col("__type")
    first = F.when(t == "table", _of_form_table(share))
    broken = ~F.col("well_formed")
    blank = (F.col("d_text") < 0.02) & (F.col("d_line") < 0.01)
    tall = box[3] - box[1] >= height * 0.12
    new = (
        F.when(first.isNull() & (t == "table") & (share > LARGE), "form")
        .when(first.isNull() & (t == "table") & (share > MEDIUM), F.when(broken, F.when(blank, "figure").otherwise("form")))
        .when(t.isin("figure", "unknown") | ((t == "table") & (share <= THIRD_RULE)), _of_area(share, first, tall, strictness))
        .otherwise(first)
    )
    b = b.withColumn("__new", new).withColumn("__new", F.when((F.col("__new") == "table") & (share > WIDEST), "form").otherwise(F.col("__new")))
    known = blocks.where("type = 'table'").select("doc_id", F.col("seq").alias("k_seq"), *G.named(box, "k_")).alias("k")
    fresh = b.where("__new = 'table' AND __type <> 'table'").select("doc_id", "seq", *G.named(box)).alias("f")
    on = (F.col("f.doc_id") == F.col("k.doc_id")) & (F.col("f.seq") != F.col("k.k_seq")) & (G.iou(G.box(), G.box("k_")) > SAME_TABLE)
    taken = fresh.join(known, on, "left_semi").select("doc_id", "seq", F.lit(True).alias("__taken"))
    kept = F.when(F.col("__taken"), F.col("__type")).otherwise(F.coalesce("__new", "__type"))
    return b.join(taken, ["doc_id", "seq"], "left").withColumn("new_type", kept).drop("__share", "__type", "__new", "__taken")
