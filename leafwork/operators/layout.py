"""Greedy layout operators, one page at a time.

A page's blocks are gathered into one array (a page holds tens to hundreds) in
input order, and a function from list to list runs over the arrays in Arrow
batches. All greedy merging is one routine: a seed, in a given order, absorbs
every later free block that a test accepts, given the seed and the hull so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_AREA = 2550.0 * 3300.0
GROUPS = {"text": "textual", "title": "textual", "list": "textual", "table": "table", "figure": "figure", "form": "form"}


@dataclass(frozen=True)
class Block:
    seq: int
    type: str
    x0: float
    y0: float
    x1: float
    y1: float
    confidence: float
    members: int = 1

    @property
    def area(self) -> float:
        return (self.x1 - self.x0) * (self.y1 - self.y0)


Page = list[Block]
_OUT = "doc_id long, seq long, type string, x0 double, y0 double, x1 double, y1 double, confidence double, members int"
_FIELDS = ("seq", "type", "x0", "y0", "x1", "y1", "confidence", "members")


def shared(a: Block, b: Block) -> float:
    w, h = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
    return w * h if w > 0 and h > 0 else 0.0


def iou(a: Block, b: Block) -> float:
    both = shared(a, b)
    union = a.area + b.area - both
    return both / union if both > 0 and union > 0 else 0.0


def hull(a: Block, b: Block) -> Block:
    return replace(a, x0=min(a.x0, b.x0), y0=min(a.y0, b.y0), x1=max(a.x1, b.x1), y1=max(a.y1, b.y1))


def absorb(page: Page, accepts: Callable[[Block, Block, Block], bool], seeds: Callable[[Block], bool] = lambda b: True) -> Iterator[tuple[Page, Block]]:
    """(members, hull) for each seed in the order of page; accepts gets seed, hull and candidate."""
    free = [True] * len(page)
    for i, seed in enumerate(page):
        if not free[i]:
            continue
        members, box = [seed], seed
        if seeds(seed):
            for j in range(i + 1, len(page)):
                if free[j] and accepts(seed, box, page[j]):
                    free[j] = False
                    members.append(page[j])
                    box = hull(box, page[j])
        yield members, box


def merged(groups: Iterator[tuple[Page, Block]], kind: str | None = None) -> Page:
    """One block a group: the hull, with identity, type and confidence of the surest member (the first of equals)."""
    out = []
    for members, box in groups:
        best = max(members, key=lambda b: b.confidence)
        out.append(members[0] if len(members) == 1 else replace(box, seq=best.seq, type=kind or best.type, confidence=best.confidence, members=len(members)))
    return out


def by_place(page: Page) -> Page:
    return sorted(page, key=lambda b: (b.y0, b.x0))


def merge_overlapping(page: Page, least: float = 0.5) -> Page:
    return merged(absorb(page, lambda s, _, b: GROUPS.get(s.type, "other") == GROUPS.get(b.type, "other") and iou(s, b) > least))


def merge_vertical_tables(page: Page) -> Page:
    def below(seed: Block, box: Block, b: Block) -> bool:
        if b.type != "table" or seed.type not in ("table", "text", "title"):
            return False
        across = min(box.x1, b.x1) - max(box.x0, b.x0)
        return across / min(box.x1 - box.x0, b.x1 - b.x0) >= 0.5 and b.y0 - box.y1 < 100

    return merged(absorb(sorted(page, key=lambda b: b.y0), below), "table")


def merge_text_lines(page: Page) -> Page:
    def beside(seed: Block, box: Block, b: Block) -> bool:
        if b.type != seed.type:
            return False
        down, low = min(box.y1, b.y1) - max(box.y0, b.y0), min(box.y1 - box.y0, b.y1 - b.y0)
        return down > 0 and (low <= 0 or down / low >= 0.3) and 0 <= b.x0 - box.x1 < 600

    return merged(absorb(by_place(page), beside, lambda b: b.type in ("text", "title", "list")))


def merge_fragments(page: Page, tiny: float = 0.02) -> Page:
    small = lambda b: b.area / PAGE_AREA <= tiny

    def next_to(seed: Block, box: Block, b: Block) -> bool:
        return b.type == seed.type and small(b) and abs((seed.y0 + seed.y1) / 2 - (b.y0 + b.y1) / 2) <= 15 and -10 <= b.x0 - box.x1 <= 30

    return merged(absorb(by_place(page), next_to, small))


def nms(page: Page, most: float = 0.1) -> Page:
    """The surest blocks that overlap no surer one."""
    kept: Page = []
    for b in sorted(page, key=lambda b: -b.confidence):
        if all(iou(b, k) <= most for k in kept):
            kept.append(b)
    return kept


def clean_layout(page: Page) -> Page:
    """Containers against their contents, from the largest down: one of the two goes; then overlaps are resolved."""
    order = sorted(page, key=lambda b: -b.area)
    gone: set[int] = set()
    for i, c in enumerate(order):
        if i in gone:
            continue
        inside = [j for j, b in enumerate(order) if j != i and j not in gone and b.area > 0 and shared(b, c) / b.area > 0.65]
        kinds = {order[j].type for j in inside}
        vague = c.area / PAGE_AREA > 0.5 and kinds & {"table", "figure", "title", "form"}
        mixed = c.type in ("form", "table") and kinds & {"figure", "table"}
        odd = c.type == "figure" and kinds - {"figure"}
        if inside:
            gone |= {i} if vague or mixed or odd else set(inside)
    return nms([b for i, b in enumerate(order) if i not in gone])


def resolve_overlaps(page: Page, most: float = 0.86, part: float = 0.06) -> Page:
    """Nothing is dropped: of two much alike blocks of a type the less sure one shrinks, once."""
    out: Page = []
    for kind in dict.fromkeys(b.type for b in page):
        kept: Page = []
        for b in sorted((b for b in page if b.type == kind), key=lambda b: -b.confidence):
            if any(iou(k, b) >= most for k in kept):
                dx, dy = max(1.0, b.x1 - b.x0) * part, max(1.0, b.y1 - b.y0) * part
                b = replace(b, x0=b.x0 + dx, y0=b.y0 + dy, x1=b.x1 - dx, y1=b.y1 - dy)
            kept.append(b)
        out += kept
    return out


def ensemble_merge(page: Page, least: float = 0.5) -> Page:
    """Of blocks of a type that overlap a seed, the surest."""
    return [max(members, key=lambda b: b.confidence) for members, _ in absorb(page, lambda s, _, b: b.type == s.type and iou(s, b) >= least)]


def reading_order(page: Page) -> Page:
    return sorted(page, key=lambda b: (int((b.x0 + b.x1) / 400), (b.y0 + b.y1) / 2, b.x0))


def segment(page: Page) -> Page:
    """The block clean-up in its fixed order."""
    for step in (merge_overlapping, clean_layout, merge_vertical_tables, merge_text_lines, merge_fragments, resolve_overlaps, reading_order):
        page = step(page)
    return page


def over_pages(blocks: DataFrame, function: Callable[[Page], Page]) -> DataFrame:
    """function applied to each page (doc_id), its blocks in the order of seq."""
    pages = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "x0", "y0", "x1", "y1", "confidence"))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for doc, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for b in function([Block(**x) for x in page]):
                    ids.append(doc)
                    rows.append(b)
            columns = [pa.array(ids, pa.int64())] + [pa.array([getattr(b, f) for b in rows], t) for f, t in zip(_FIELDS, (pa.int64(), pa.string(), *[pa.float64()] * 5, pa.int32()))]
            yield pa.record_batch(columns, names=["doc_id", *_FIELDS])

    return pages.mapInArrow(run, _OUT)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of least total cost (rows to columns), by shortest augmenting paths with potentials."""
    if cost.size == 0:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        least, seen, back = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            seen[col] = True
            free = ~seen[1:]
            reach = c[owner[col] - 1] - u[owner[col]] - v[1:]
            better = free & (reach < least[1:])
            least[1:][better], back[1:][better] = reach[better], col
            nearest = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            step = least[nearest]
            u[owner[seen]] += step
            v[seen] -= step
            least[1:][free] -= step
            col = nearest
            if owner[col] == 0:
                break
        while col:
            owner[col] = owner[back[col]]
            col = back[col]
    out = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) for a, b in out) if flip else sorted(out)


def optimal_labels(costs: DataFrame, most: float = 220.0) -> DataFrame:
    """(doc_id, field_seq, label_seq, cost): labels given to the fields of a page so that the total cost is least; dear pairs go."""
    pages = costs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field_seq", "label_seq", "cost"))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, cols = sorted({c["field_seq"] for c in cells}), sorted({c["label_seq"] for c in cells})
                table = np.full((len(rows), len(cols)), 4 * most)
                for c in cells:
                    table[rows.index(c["field_seq"]), cols.index(c["label_seq"])] = c["cost"]
                out += [(doc, rows[i], cols[j], float(table[i, j])) for i, j in assign(table) if table[i, j] <= most]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "field_seq", "label_seq", "cost"])

    return pages.mapInArrow(run, "doc_id long, field_seq long, label_seq long, cost double")
