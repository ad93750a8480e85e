"""Redaction: which boxes a mask covers, the text that is left, masks from detections, and page geometry.

Boxes and masks are joined on their document. Within a document a grid of cells bounds the pairs: a box and a mask
that intersect share a cell, so a page of many boxes and many masks is not compared all by all. What covers more than
WIDE cells is not dealt to them but meets everything of its document, so no box makes more rows than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .pii import has_pii

CELL = 256.0
WIDE = 64


def cells(box: Column, cell: float, small: int, *wide: int) -> Column:
    """Join keys of a box: the cells that it touches and the mark ``small``, or only the marks ``wide`` if there are too many."""
    low = lambda side: F.floor(box[side] / cell).cast("long")
    mark = lambda k: F.struct(F.lit(k).alias("kind"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
    across, down = F.sequence(low("left"), low("right")), F.sequence(low("top"), low("bottom"))
    grid = F.flatten(F.transform(across, lambda x: F.transform(down, lambda y: F.struct(F.lit(0).alias("kind"), x.alias("cx"), y.alias("cy")))))
    count = (F.abs(low("right") - low("left")) + 1.0) * (F.abs(low("bottom") - low("top")) + 1.0)
    return F.when(count > WIDE, F.array(*map(mark, wide))).otherwise(F.concat(grid, F.array(mark(small))))


def covered(boxes: DataFrame, mask: DataFrame, doc: str = "doc_id", ordinal: str = "ordinal", cell: float = CELL) -> DataFrame:
    """(doc, ordinal) of the boxes that intersect any box of the document's mask; edges that touch do not."""
    # Mark 1: any box and a wide mask's; mark 2: a wide box's and any mask's.
    near = mask.select(doc, F.col("box").alias("mask_box"), F.explode(cells(F.col("box"), cell, 2, 1)).alias("_cell"))
    own = boxes.select(doc, ordinal, "box", F.explode(cells(F.col("box"), cell, 1, 1, 2)).alias("_cell"))
    return own.join(near, [doc, "_cell"]).where(G.intersects(F.col("box"), F.col("mask_box"))).select(doc, ordinal).distinct()


def redacted(boxes: DataFrame, mask: DataFrame, doc: str = "doc_id", ordinal: str = "ordinal") -> DataFrame:
    return boxes.join(covered(boxes, mask, doc, ordinal), [doc, ordinal], "left_semi")


def visible(boxes: DataFrame, mask: DataFrame, doc: str = "doc_id", ordinal: str = "ordinal") -> DataFrame:
    return boxes.join(covered(boxes, mask, doc, ordinal), [doc, ordinal], "left_anti")


def flagged(boxes: DataFrame, mask: DataFrame, doc: str = "doc_id", ordinal: str = "ordinal", column: str = "highlighted") -> DataFrame:
    hit = covered(boxes, mask, doc, ordinal).withColumn(column, F.lit(True))
    return boxes.join(hit, [doc, ordinal], "left").withColumn(column, F.coalesce(column, F.lit(False)))


def mask_of_words(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The mask that hides every word with personal data."""
    return words.where(has_pii(F.col("text"))).select(doc, "box")


def scaled_mask(pages: DataFrame, mask: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Mask rectangles in pixels on each rendered page (page_no, page and bitmap sizes); the one mask holds for every page."""
    sx, sy = F.col("bitmap_width") / F.col("page_width"), F.col("bitmap_height") / F.col("page_height")
    b = G.scale(F.col("box"), sx, sy)
    return pages.join(mask, doc).select(doc, "page_no", *[G.trunc(b[k]).alias(k) for k in ("left", "top", "right", "bottom")])
