"""Words to form zones. Zones are a constant, small table; they are laid on a grid of cells, and each cell carries the zones that reach into it.

A word finds its cell by arithmetic, meets the cell's zones by a broadcast hash
join on the cell, and picks among them within its own row: words are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 100
#: Padding of a zone: this share of its side, this many pixels at least.
RATIO, LEAST = 0.15, 8
PAGE = (2550, 3300)


def padded(zones: DataFrame, pad: float | None = None, page: tuple[int, int] = PAGE) -> DataFrame:
    """Zones with their padded boxes px0 to py1: by the share of each side and within the page, or by a fixed number of pixels."""
    box = [F.col(c) for c in ("zx0", "zy0", "zx1", "zy1")]
    if pad is not None:
        wide = [c + pad * (1 if i > 1 else -1) for i, c in enumerate(box)]
    else:
        by = [F.greatest(F.floor((box[i + 2] - box[i]) * RATIO), F.lit(LEAST)).cast("double") for i in (0, 1)]
        wide = [F.greatest(F.lit(0.0), box[i] - by[i]) for i in (0, 1)] + [F.least(F.lit(float(page[i])), box[i + 2] + by[i]) for i in (0, 1)]
    return zones.select("ord", "zone", *box, *(w.alias(n) for w, n in zip(wide, ("px0", "py0", "px1", "py1"))))


def by_cell(zones: DataFrame, pad: float | None = None) -> DataFrame:
    """cx, cy, zones: array of (ord, zone, box, padded box) for each cell that a padded zone reaches into."""
    z = padded(zones, pad)
    cell = lambda c: F.floor(F.col(c) / CELL).cast("int")
    z = z.withColumn("cx", F.explode(F.sequence(cell("px0"), cell("px1")))).withColumn("cy", F.explode(F.sequence(cell("py0"), cell("py1"))))
    return z.groupBy("cx", "cy").agg(F.collect_list(F.struct("ord", "zone", "zx0", "zy0", "zx1", "zy1", "px0", "py0", "px1", "py1")).alias("zones"))


def anchor() -> tuple[Column, Column]:
    """Point of a word that decides its zone: the middle across, just below the top."""
    return (F.col("x0") + F.col("x1")) / 2, F.col("y0") + F.least(F.lit(2.0), 0.2 * F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")))


def match_unique(words: DataFrame, zones: DataFrame, pad: float | None = None) -> DataFrame:
    """Words with the zone they belong to: zones that hold the anchor before padded ones, then the smallest (padded ones by their padded box), then the first declared."""
    ax, ay = anchor()
    at = words.withColumn("ax", ax).withColumn("ay", ay).withColumn("cx", F.floor(F.col("ax") / CELL).cast("int")).withColumn("cy", F.floor(F.col("ay") / CELL).cast("int"))
    hit = at.join(F.broadcast(by_cell(zones, pad)), ["cx", "cy"])

    def candidate(z: Column) -> Column:
        inside = F.col("ax").between(z["zx0"], z["zx1"]) & F.col("ay").between(z["zy0"], z["zy1"])
        near = F.col("ax").between(z["px0"], z["px1"]) & F.col("ay").between(z["py0"], z["py1"])
        area = lambda b: F.greatest((z[b + "x1"] - z[b + "x0"]) * (z[b + "y1"] - z[b + "y0"]), F.lit(1.0))
        size = F.when(inside, area("z")).otherwise(area("p"))
        return F.when(near, F.struct(F.when(inside, 1).otherwise(2).alias("priority"), size.alias("size"), z["ord"].alias("ord"), z["zone"].alias("zone")))

    best = F.array_min(F.filter(F.transform("zones", candidate), lambda c: c.isNotNull()))
    return hit.withColumn("best", best).where("best is not null").select(*words.columns, F.col("best.zone").alias("zone"), F.col("best.ord").alias("ord"), F.col("best.priority").alias("priority"))


def match_overlap(words: DataFrame, zones: DataFrame, pad: float | None = None) -> DataFrame:
    """Every (word, zone) whose padded box shares area with the word's."""
    cell = lambda c: F.floor(F.col(c) / CELL).cast("int")
    at = words.withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("cy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    hit = at.join(F.broadcast(by_cell(zones, pad)), ["cx", "cy"]).withColumn("z", F.explode("zones"))
    left, top = F.greatest("x0", "z.px0"), F.greatest("y0", "z.py0")
    shared = (F.least("x1", "z.px1") > left) & (F.least("y1", "z.py1") > top)
    # a pair meets in several cells; it counts in the one that holds the corner of its intersection
    once = (F.floor(left / CELL) == F.col("cx")) & (F.floor(top / CELL) == F.col("cy"))
    return hit.where(shared & once).select(*words.columns, F.col("z.zone").alias("zone"), F.col("z.ord").alias("ord"))


def zone_text(matched: DataFrame) -> DataFrame:
    """Text (by line, then across), mean confidence and number of words of each zone of each page."""
    g = matched.groupBy("doc_id", "page_id", "zone").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "pos", "token"))).alias("w"), F.count("*").alias("n_words"), F.sum("confidence").alias("total"))
    return g.select("doc_id", "page_id", "zone", F.array_join("w.token", " ").alias("text"), "n_words", "total")
