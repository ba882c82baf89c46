"""Queries of the greedy layout operators and of the folds over a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwork.operators import layout as L
from leafwork.plans.joins import label_cost
from leafwork.plans.registry import query
from leafwork.sources import fixtures as X

for _f in (L.merge_overlapping, L.merge_vertical_tables, L.merge_text_lines, L.merge_fragments, L.nms, L.clean_layout, L.resolve_overlaps, L.ensemble_merge):
    query(_f.__name__)(lambda spark, d, f=_f: L.over_pages(X.blocks(spark, d), f))


@query("segment_pages")
def segment_pages(spark, d):
    return L.over_pages(X.blocks(spark, d), L.segment)


@query("hungarian_label")
def hungarian_label(spark, d):
    return L.optimal_labels(label_cost(spark, d))


def leaders(values, far):
    """Array of (first, n) for values in order: one opens a new group if it is farther than `far` from the first of the group before."""
    start = F.array().cast("array<struct<first:double,n:int>>")

    def step(groups, v):
        last = F.element_at(groups, -1)
        grown = F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(F.struct(last["first"].alias("first"), (last["n"] + 1).alias("n"))))
        opened = F.concat(groups, F.array(F.struct(v.alias("first"), F.lit(1).alias("n"))))
        return F.when(F.size(groups) == 0, opened).when(v - last["first"] <= far, grown).otherwise(opened)

    return F.aggregate(values, start, step)


_REC = """WITH RECURSIVE {src}, v AS (SELECT doc_id, {value} AS v, row_number() OVER (PARTITION BY doc_id ORDER BY {value}) AS i FROM {frm}),
r AS (SELECT doc_id, i, v AS first FROM v WHERE i = 1 UNION ALL SELECT v.doc_id, v.i, CASE WHEN v.v - r.first <= {far} THEN r.first ELSE v.v END FROM r JOIN v ON v.doc_id = r.doc_id AND v.i = r.i + 1)
SELECT doc_id, first, count(*) AS n FROM r GROUP BY ALL"""


@query("assign_columns", _REC.format(src=X.BLOCKS, value="(x0 + x1) / 2", frm="blocks", far="191.25"))
def assign_columns(spark, d, far: float = 1.5 * max(10, 0.05 * X.PAGE_W)):
    """Columns of a page: block centres in order, a column's place is that of its first member."""
    g = X.blocks(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list((F.col("x0") + F.col("x1")) / 2)).alias("c"))
    return g.select("doc_id", F.explode(leaders(F.col("c"), far)).alias("g")).select("doc_id", "g.first", F.col("g.n").cast("long").alias("n"))


@query("group_words_lines")
def group_words_lines(spark, d, far: float = 15.0):
    """Lines of a page: word centres in order, compared with the first word of the line."""
    g = X.words(spark, d).groupBy("doc_id", "page_id").agg(F.array_sort(F.collect_list((F.col("y0") + F.col("y1")) / 2)).alias("c"))
    return g.select("doc_id", "page_id", F.explode(leaders(F.col("c"), far)).alias("g")).select("doc_id", "page_id", "g.first", F.col("g.n").cast("long").alias("n"))
