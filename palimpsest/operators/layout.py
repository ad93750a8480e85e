"""From words with boxes to lines, blocks and text; confidence and box aggregates.

Words are rows (doc_id, ordinal, text, confidence 0-100, box). All windows are partitioned by document, so a plan has
one shuffle; a document's words are bounded by the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions.text import fix_digits_everywhere, is_blank, trim

GARBAGE = r"[|\[\]{}~`^\\]{2,}"
EDGE = r"^[|\[\]{}~`^\\]+|[|\[\]{}~`^\\]+$"
MIN_CONFIDENCE = 15


def confident(confidence: Column) -> Column:
    return confidence >= MIN_CONFIDENCE


def not_noise(text: Column) -> Column:
    x = trim(text)
    return (x != "") & ~((F.char_length(x) == 1) & ~x.rlike(r"^[\p{L}\p{Nd}]$"))


def not_garbage(text: Column) -> Column:
    return ~text.rlike(GARBAGE)


def clean_word(text: Column) -> Column:
    return fix_digits_everywhere(F.regexp_replace(trim(text), EDGE, ""))


def filter_words(words: DataFrame) -> DataFrame:
    kept = words.where(confident(F.col("confidence")) & not_noise(F.col("text")) & not_garbage(F.col("text")))
    return kept.withColumn("text", clean_word(F.col("text"))).where(~is_blank(F.col("text")))


def number_lines(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """words with line_no and word_no (from 1). Sorted by (top, left), a word starts a line if its top is further from the
    word before than half of the taller of the two (at least half a pixel)."""
    order = W.partitionBy(doc).orderBy("box.top", "box.left", "ordinal")
    h = G.height(F.col("box"))
    gap = F.abs(F.col("box.top") - F.lag("box.top").over(order)) > 0.5 * F.greatest(h, F.lag(h).over(order), F.lit(1.0))
    marked = words.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("line_no", F.sum("_new").over(order).cast("int"))
    return marked.withColumn("word_no", F.row_number().over(order)).drop("_new")


def box_of(*prefix: str) -> list[Column]:
    return [F.min("box.left").alias("left"), F.min("box.top").alias("top"), F.max("box.right").alias("right"), F.max("box.bottom").alias("bottom")]


def ordered_text(order: str, text: str, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator)


def lines(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, line_no, text, confidence 0-1, n_words, left, top, right, bottom)."""
    numbered = number_lines(words, doc)
    return numbered.groupBy(doc, "line_no").agg(ordered_text("word_no", "text", " ").alias("text"), F.avg(F.col("confidence") / 100).alias("confidence"), F.count("*").alias("n_words"), *box_of())


def blocks(line_rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One block for each document: text of its lines, mean of the line means, union of the boxes."""
    return line_rows.groupBy(doc).agg(
        ordered_text("line_no", "text", "\n").alias("text"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_lines"),
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
    )


def reading_order(boxes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, text): boxes sorted by (top, left) and joined by a space on one line, a newline, or an empty line after a wide gap."""
    order = W.partitionBy(doc).orderBy("box.top", "box.left", "ordinal")
    top, bottom = F.lag("box.top").over(order), F.lag("box.bottom").over(order)
    tall = bottom - top
    same = F.least(bottom, F.col("box.bottom")) - F.greatest(top, F.col("box.top")) > 0.5 * tall
    separator = F.when(top.isNull(), "").when(same, " ").when(F.col("box.top") - bottom > 1.5 * tall, "\n\n").otherwise("\n")
    placed = boxes.select(doc, F.row_number().over(order).alias("at"), F.concat(separator, "text").alias("piece"))
    return placed.groupBy(doc).agg(ordered_text("at", "piece", "").alias("text"))


def full_text(blocks_: Column) -> Column:
    """Text of a tree (array of blocks of lines): blocks by an empty line, lines by a newline."""
    return F.array_join(F.transform(blocks_, lambda b: F.array_join(F.transform(b["lines"], lambda x: x["text"]), "\n")), "\n\n")


def tree_confidence(blocks_: Column) -> Column:
    """Mean over words; a block without words counts once with its own confidence; 0 for an empty tree."""
    words = lambda b: F.flatten(F.transform(b["lines"], lambda x: F.transform(x["words"], lambda w: w["confidence"].cast("double"))))
    values = F.flatten(F.transform(blocks_, lambda b: F.when(F.size(words(b)) > 0, words(b)).otherwise(F.array(b["confidence"].cast("double")))))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(F.lit(0.0))


def tree_counts(blocks_: Column) -> Column:
    return F.struct(F.size(blocks_).alias("blocks"), F.aggregate(blocks_, F.lit(0), lambda a, b: a + F.size(b["lines"])).alias("lines"))


def project(results: DataFrame) -> DataFrame:
    """What a screen shows of a result: cleaned text, blocks and lines with whole-pixel boxes, no words."""
    from ..functions.text import clean

    pixel = lambda b: F.struct(*[b[k].cast("int").alias(k) for k in ("left", "top", "right", "bottom")])
    line = lambda x: F.struct(x["text"].alias("text"), pixel(x["box"]).alias("box"), x["confidence"].alias("confidence"), F.lit(0).alias("indent"))
    block = lambda b: F.struct(b["text"].alias("text"), pixel(b["box"]).alias("box"), F.transform(b["lines"], line).alias("lines"))
    return results.withColumn("text", clean(F.col("full_text"))).withColumn("blocks", F.transform("blocks", block)).drop("full_text")


def mean_confidence(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    return words.groupBy(doc).agg(F.coalesce(F.avg(F.col("confidence") / 100), F.lit(0.0)).alias("confidence"))


def summary(engine: Column, words: Column, n_blocks: Column, confidence: Column, ms: Column, lang: Column) -> Column:
    return F.format_string("OCR[%s]: %d words, %d blocks, %d%% conf, %dms, lang=%s", engine, words, n_blocks, (confidence * 100).cast("int"), ms, lang)


def error_of(n_blocks: Column, text: Column) -> Column:
    return F.when((n_blocks == 0) | F.coalesce(is_blank(text), F.lit(True)), "NoTextFound")


def first_hit(boxes: DataFrame, points: DataFrame, doc: str = "doc_id", cell: float = 256.0) -> DataFrame:
    """(doc, point_id, ordinal, text) of the first box, by ordinal, that holds each point. Points meet the boxes of their
    grid cell and those that are too wide for the grid."""
    from .redact import cells

    own = boxes.select(doc, "ordinal", "text", "box", F.explode(cells(F.col("box"), cell, 2, 1)).alias("_cell")).where("_cell.kind <> 2")
    mark = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), F.floor(x / cell).cast("long").alias("cx"), F.floor(y / cell).cast("long").alias("cy"))
    asked = points.select(doc, "point_id", "x", "y", F.explode(F.array(mark(0, F.col("x"), F.col("y")), mark(1, F.lit(0.0), F.lit(0.0)))).alias("_cell"))
    inside = asked.join(own, [doc, "_cell"]).where(G.contains(F.col("box"), F.col("x"), F.col("y")))
    return inside.groupBy(doc, "point_id").agg(F.min(F.struct("ordinal", "text")).alias("hit")).select(doc, "point_id", "hit.*")
