"""Queries over boxes, sizes, events and pixels, with the SQL that says the same.

Boxes, images and payloads are composed from table keys, so that both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..operators import images as I
from ..operators import layout as L
from ..operators import licences as K
from ..operators import pii, ranking
from ..operators import redact as R
from ..streaming import rates as S
from .registry import query, table
from .text_queries import CODES_SQL, codes, sql_all

# --- word boxes: one for each lineitem
BOXES_SQL = """(SELECT l_orderkey AS doc_id, l_linenumber * 1000000000::BIGINT + l_partkey * 10000 + l_suppkey AS ordinal, l_returnflag || l_suppkey AS text, (l_partkey % 101)::INT AS confidence,
  (l_partkey % 97 * 10)::DOUBLE AS lft, (l_linenumber // 3 * 20 + l_suppkey % 7)::DOUBLE AS top, (l_partkey % 97 * 10 + 10 + l_suppkey % 40)::DOUBLE AS rgt, (l_linenumber // 3 * 20 + l_suppkey % 7 + 6 + l_partkey % 9)::DOUBLE AS bot FROM lineitem)"""


#: Lines of an order may share their number.
ORDINAL = "cast(l_linenumber as bigint) * 1000000000 + l_partkey * 10000 + l_suppkey"


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    left, top = F.expr("cast(l_partkey % 97 * 10 as double)"), F.expr("cast(l_linenumber div 3 * 20 + l_suppkey % 7 as double)")
    box = G.box(left, top, left + F.expr("10 + l_suppkey % 40"), top + F.expr("6 + l_partkey % 9"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.expr(ORDINAL).alias("ordinal"), F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("text"),
        F.expr("cast(l_partkey % 101 as int)").alias("confidence"), box.alias("box"),
    )


LINES_SQL = f"""
b AS (SELECT * FROM {BOXES_SQL}),
g AS (SELECT *, CASE WHEN abs(top - lag(top) OVER w) <= 0.5 * greatest(bot - top, lag(bot - top) OVER w, 1) THEN 0 ELSE 1 END AS fresh, row_number() OVER w AS word_no FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY top, lft, ordinal)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY word_no) AS line_no FROM g),
l AS (SELECT doc_id, line_no::INT AS line_no, string_agg(text, ' ' ORDER BY word_no) AS text, avg(confidence / 100::DOUBLE) AS confidence, count(*) AS n_words, min(lft) AS l, min(top) AS t, max(rgt) AS r, max(bot) AS b FROM n GROUP BY ALL)"""


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, text, n_words, round(confidence, 9) AS confidence, l AS \"left\", t AS top, r AS \"right\", b AS bottom FROM l")
def layout_lines(spark, sf):
    return L.lines(boxes(spark, sf)).withColumn("confidence", F.round("confidence", 9))


@query(f"WITH {LINES_SQL} SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS text, round(avg(confidence), 9) AS confidence, count(*) AS n_lines, min(l) AS \"left\", min(t) AS top, max(r) AS \"right\", max(b) AS bottom FROM l GROUP BY doc_id")
def layout_text(spark, sf):
    return L.blocks(L.lines(boxes(spark, sf))).withColumn("confidence", F.round("confidence", 9))


@query(f"""
WITH b AS (SELECT *, lag(top) OVER w AS pt, lag(bot) OVER w AS pb, row_number() OVER w AS pos FROM {BOXES_SQL} WINDOW w AS (PARTITION BY doc_id ORDER BY top, lft, ordinal))
SELECT doc_id, string_agg(CASE WHEN pt IS NULL THEN '' WHEN least(pb, bot) - greatest(pt, top) > 0.5 * (pb - pt) THEN ' ' WHEN top - pb > 1.5 * (pb - pt) THEN chr(10) || chr(10) ELSE chr(10) END || text, '' ORDER BY pos) AS text FROM b GROUP BY doc_id
""")
def layout_reading_order(spark, sf):
    return L.reading_order(boxes(spark, sf))


@query(f"SELECT doc_id, round(avg(confidence / 100::DOUBLE), 9) AS confidence FROM {BOXES_SQL} GROUP BY doc_id")
def conf_average(spark, sf):
    return L.mean_confidence(boxes(spark, sf)).withColumn("confidence", F.round("confidence", 9))


def trees(spark, sf) -> DataFrame:
    """One tree for each order: a block for each return flag; N blocks keep no words, only their own confidence."""
    b = boxes(spark, sf).withColumn("flag", F.substring("text", 1, 1))
    word = F.struct("ordinal", "text", "box", (F.col("confidence") / 100).alias("confidence"))
    block = b.groupBy("doc_id", "flag").agg(F.array_sort(F.collect_list(word)).alias("w"), F.avg(F.col("confidence") / 100).alias("c"))
    words = F.when(F.col("flag") == "N", F.slice("w", 1, 0)).otherwise(F.col("w"))
    line = F.struct(F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), F.col("w")[0]["box"].alias("box"), F.col("c").alias("confidence"), words.alias("words"))
    tree = F.struct("flag", line["text"].alias("text"), F.col("w")[0]["box"].alias("box"), F.col("c").alias("confidence"), F.array(line).alias("lines"))
    return block.groupBy("doc_id").agg(F.array_sort(F.collect_list(tree)).alias("blocks"))


@query(f"""
WITH b AS (SELECT *, text[1] AS flag FROM {BOXES_SQL}), k AS (SELECT doc_id, flag, string_agg(text, ' ' ORDER BY ordinal) AS text, avg(confidence / 100::DOUBLE) AS c FROM b GROUP BY ALL),
v AS (SELECT doc_id, confidence / 100::DOUBLE AS c FROM b WHERE flag <> 'N' UNION ALL SELECT doc_id, c FROM k WHERE flag = 'N'),
t AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY flag) AS full_text, count(*)::INT AS n_blocks FROM k GROUP BY doc_id)
SELECT doc_id, round(avg(c), 9) AS confidence, any_value(full_text) AS full_text, any_value(n_blocks) AS blocks, any_value(n_blocks) AS lines FROM v JOIN t USING (doc_id) GROUP BY doc_id
""")
def tree_text_and_confidence(spark, sf):
    t = trees(spark, sf)
    return t.select("doc_id", F.round(L.tree_confidence(F.col("blocks")), 9).alias("confidence"), L.full_text(F.col("blocks")).alias("full_text"), L.tree_counts(F.col("blocks")).alias("n")).select("doc_id", "confidence", "full_text", "n.*")


@query(f"""
WITH b AS (SELECT *, text[1] AS flag FROM {BOXES_SQL}),
k AS (SELECT doc_id, flag, string_agg(text, ' ' ORDER BY ordinal) AS block_text, avg(confidence / 100::DOUBLE) AS c, min_by(struct_pack(lft, top, rgt, bot), ordinal) AS box FROM b GROUP BY ALL),
t AS (SELECT doc_id, string_agg(block_text, chr(10) || chr(10) ORDER BY flag) AS text FROM k GROUP BY doc_id)
SELECT doc_id, t.text, NULL::VARCHAR AS error, (row_number() OVER (PARTITION BY doc_id ORDER BY flag))::INT AS block_no, block_text, trunc(box.lft)::INT AS "left", trunc(box.bot)::INT AS bottom, 1 AS n_lines, block_text AS line_text, trunc(box.top)::INT AS line_top, round(c, 9) AS confidence, 0 AS indent FROM k JOIN t USING (doc_id)
""")
def ui_projection(spark, sf):
    shown = L.project(trees(spark, sf).withColumn("full_text", L.full_text(F.col("blocks"))))
    rows = shown.select("doc_id", "text", L.error_of(F.size("blocks"), F.col("text")).alias("error"), F.posexplode("blocks").alias("at", "b"))
    line = F.col("b.lines")[0]
    return rows.select(
        "doc_id", "text", "error", (F.col("at") + 1).alias("block_no"), F.col("b.text").alias("block_text"), F.col("b.box.left").alias("left"), F.col("b.box.bottom").alias("bottom"), F.size("b.lines").alias("n_lines"),
        line["text"].alias("line_text"), line["box"]["top"].alias("line_top"), F.round(line["confidence"], 9).alias("confidence"), line["indent"].alias("indent"),
    )


@query(f"SELECT doc_id, min(lft) AS \"left\", min(top) AS top, max(rgt) AS \"right\", max(bot) AS bottom FROM {BOXES_SQL} GROUP BY doc_id")
def box_union(spark, sf):
    return boxes(spark, sf).groupBy("doc_id").agg(*L.box_of())


@query(f"""
SELECT doc_id, ordinal, rgt - lft AS width, bot - top AS height, (rgt - lft) * (bot - top) AS area, (lft + rgt) / 2 AS cx, (top + bot) / 2 AS cy, rgt <= lft OR bot <= top AS empty,
  CASE WHEN confidence / 100::DOUBLE > 0.8 THEN 'GREEN' WHEN confidence / 100::DOUBLE > 0.5 THEN 'YELLOW' ELSE 'RED' END AS band, lft * 2 AS sl, bot * 0.5::DOUBLE AS sb, least(lft, 100) AS ul, greatest(bot, 30) AS ub FROM {BOXES_SQL}
""")
def box_measures(spark, sf):
    b = F.col("box")
    scaled, joined = G.scale(b, F.lit(2.0), F.lit(0.5)), G.union(b, G.box(F.lit(100.0), F.lit(10.0), F.lit(200.0), F.lit(30.0)))
    return boxes(spark, sf).select("doc_id", "ordinal", G.width(b).alias("width"), G.height(b).alias("height"), G.area(b).alias("area"), G.center(b)["x"].alias("cx"), G.center(b)["y"].alias("cy"), G.is_empty(b).alias("empty"),
                                   G.confidence_band(F.col("confidence") / 100).alias("band"), scaled["left"].alias("sl"), scaled["bottom"].alias("sb"), joined["left"].alias("ul"), joined["bottom"].alias("ub"))


# --- redaction: a mask box for every third order line
MASK_SQL = "(SELECT l_orderkey AS doc_id, (l_suppkey % 90 * 10)::DOUBLE AS ml, (l_partkey % 60)::DOUBLE AS mt, (l_suppkey % 90 * 10 + 60)::DOUBLE AS mr, (l_partkey % 60 + 15)::DOUBLE AS mb FROM lineitem WHERE l_partkey % 3 = 0)"
HIT = "EXISTS (SELECT 1 FROM m WHERE m.doc_id = b.doc_id AND b.lft < m.mr AND b.rgt > m.ml AND b.top < m.mb AND b.bot > m.mt)"


def masks(spark, sf) -> DataFrame:
    left, top = F.expr("cast(l_suppkey % 90 * 10 as double)"), F.expr("cast(l_partkey % 60 as double)")
    return table(spark, sf, "lineitem").where("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("doc_id"), G.box(left, top, left + 60, top + 15).alias("box"))


@query(f"WITH m AS (SELECT * FROM {MASK_SQL}) SELECT doc_id, ordinal, text FROM {BOXES_SQL} b WHERE {HIT}")
def redact_semi(spark, sf):
    return R.redacted(boxes(spark, sf), masks(spark, sf)).select("doc_id", "ordinal", "text")


@query(f"WITH m AS (SELECT * FROM {MASK_SQL}) SELECT doc_id, ordinal, text FROM {BOXES_SQL} b WHERE NOT {HIT}")
def redact_anti(spark, sf):
    return R.visible(boxes(spark, sf), masks(spark, sf)).select("doc_id", "ordinal", "text")


@query(f"WITH m AS (SELECT * FROM {MASK_SQL}) SELECT doc_id, ordinal, {HIT} AS highlighted FROM {BOXES_SQL} b")
def redact_highlight(spark, sf):
    return R.flagged(boxes(spark, sf), masks(spark, sf)).select("doc_id", "ordinal", "highlighted")


@query(f"""
WITH m AS (SELECT * FROM {MASK_SQL}), v AS (SELECT * FROM {BOXES_SQL} b WHERE NOT {HIT}),
b AS (SELECT *, lag(top) OVER w AS pt, lag(bot) OVER w AS pb, row_number() OVER w AS pos FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY top, lft, ordinal))
SELECT doc_id, string_agg(CASE WHEN pt IS NULL THEN '' WHEN least(pb, bot) - greatest(pt, top) > 0.5 * (pb - pt) THEN ' ' WHEN top - pb > 1.5 * (pb - pt) THEN chr(10) || chr(10) ELSE chr(10) END || text, '' ORDER BY pos) AS text FROM b GROUP BY doc_id
""")
def redact_text(spark, sf):
    return L.reading_order(R.visible(boxes(spark, sf), masks(spark, sf)))


@query(f"""
WITH f AS (SELECT doc_id, match FROM ({sql_all('documents', 'doc_id', 'text')})), n AS (SELECT doc_id, count(*)::INT AS n, list_distinct(list(match)) AS found FROM f GROUP BY doc_id),
o AS (SELECT doc_id, n, list_transform(list_reverse_sort(list_transform(found, lambda m: {{'size': length(m), 'match': m}})), lambda m: m.match) AS found FROM n)
SELECT d.doc_id, coalesce(n, 0) AS n_found, sha256(list_reduce(coalesce(found, []), lambda t, m: replace(t, m, repeat('█', length(m)::INT)), text)) AS sha256 FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
""")
def redact_documents(spark, sf):
    """The flow from text to redacted text: detect, mask what was found, and keep counts."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(pii.detections(F.col("text"))).alias("n_found"), F.sha2(pii.mask(F.col("text")).cast("binary"), 256).alias("sha256"))


def pages(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.expr("array(1L, 2L)")).alias("page_no"), F.lit(595.0).alias("page_width"), F.expr("cast(800 + o_custkey % 50 as double)").alias("page_height"), F.lit(1654.0).alias("bitmap_width"), F.lit(2339.0).alias("bitmap_height"))


@query(f"""
WITH p AS (SELECT o_orderkey AS doc_id, unnest(range(1, 3)) AS page_no, 595.0::DOUBLE AS pw, (800 + o_custkey % 50)::DOUBLE AS ph FROM orders)
SELECT p.doc_id, page_no, trunc(ml * (1654 / pw))::INT AS "left", trunc(mt * (2339 / ph))::INT AS top, trunc(mr * (1654 / pw))::INT AS "right", trunc(mb * (2339 / ph))::INT AS bottom FROM p JOIN {MASK_SQL} m ON p.doc_id = m.doc_id
""")
def redact_pages(spark, sf):
    return R.scaled_mask(pages(table(spark, sf, "orders")), masks(spark, sf))


@query(f"""
SELECT b.doc_id, point_id, min_by(ordinal, ordinal) AS ordinal, min_by(text, ordinal) AS text FROM {BOXES_SQL} b JOIN (SELECT l_orderkey AS doc_id, l_linenumber * 1000000000::BIGINT + l_partkey * 10000 + l_suppkey AS point_id, (l_partkey % 97 * 10 + 10)::DOUBLE AS x, (l_linenumber // 3 * 20 + 8)::DOUBLE AS y FROM lineitem) p
ON b.doc_id = p.doc_id AND x BETWEEN lft AND rgt AND y BETWEEN top AND bot GROUP BY b.doc_id, point_id
""")
def point_in_box(spark, sf):
    points = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr(ORDINAL).alias("point_id"), F.expr("cast(l_partkey % 97 * 10 + 10 as double)").alias("x"), F.expr("cast(l_linenumber div 3 * 20 + 8 as double)").alias("y"))
    return L.first_hit(boxes(spark, sf), points)


@query()
def redact_pdf(spark, sf):
    from ..sources import pdf_text

    b = boxes(spark, sf)
    size = b.select("doc_id").distinct().select("doc_id", F.lit(1000.0).alias("width"), (700 + F.col("doc_id") % 900).cast("double").alias("height"))
    return pdf_text.redacted_pdfs(b, masks(spark, sf), size).select("doc_id", F.length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


# --- geometry over sizes made of order numbers
SIZES_SQL = "(SELECT o_orderkey AS id, (o_orderkey * 37 % 5000 + 5)::INT AS w, (o_custkey * 53 % 4000 + 5)::INT AS h FROM orders)"


def sizes(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr("cast(o_orderkey * 37 % 5000 + 5 as int)").alias("w"), F.expr("cast(o_custkey * 53 % 4000 + 5 as int)").alias("h"))


@query(f"""
WITH c AS (SELECT id, w, h, least(greatest(trunc((id % 700 - 20) * 1.5::DOUBLE)::INT, 0), w - 1) AS x, least(greatest(trunc((id % 300)::DOUBLE)::INT, 0), h - 1) AS y FROM {SIZES_SQL}),
d AS (SELECT *, least((id % 900)::INT, w - x) AS cw, least((id % 50)::INT, h - y) AS ch FROM c)
SELECT id, CASE WHEN cw <= 10 OR ch <= 10 THEN 0 ELSE x END AS x, CASE WHEN cw <= 10 OR ch <= 10 THEN 0 ELSE y END AS y, CASE WHEN cw <= 10 OR ch <= 10 THEN w ELSE cw END AS width, CASE WHEN cw <= 10 OR ch <= 10 THEN h ELSE ch END AS height FROM d
""")
def crop_clamp(spark, sf):
    i = F.col("id")
    return sizes(spark, sf).select("id", G.crop_clamp((i % 700 - 20) * 1.5, (i % 300).cast("double"), i % 900, i % 50, F.col("w"), F.col("h")).alias("c")).select("id", "c.*")


@query(f"""
WITH s AS (SELECT *, least(w, h) AS lo, greatest(w, h) AS hi FROM {SIZES_SQL}),
u AS (SELECT *, trunc(w * least(600 / lo, 3))::INT AS uw, trunc(h * least(600 / lo, 3))::INT AS uh FROM s)
SELECT id, CASE WHEN lo < 400 AND uw::BIGINT * uh <= 8000000 THEN uw WHEN hi > 3000 THEN greatest(trunc(w * (3000 / hi))::INT, 1) ELSE w END AS width, CASE WHEN lo < 400 AND uw::BIGINT * uh <= 8000000 THEN uh WHEN hi > 3000 THEN greatest(trunc(h * (3000 / hi))::INT, 1) ELSE h END AS height,
  CASE WHEN hi < 800 THEN 800 WHEN hi > 2048 THEN 2048 ELSE hi END AS side, hi < 800 AS binarize,
  trunc(w * CASE WHEN lo < 300 THEN 300 / lo WHEN hi > 2500 THEN 2500 / hi ELSE 1 END)::INT AS pw, trunc(h * CASE WHEN lo < 300 THEN 300 / lo WHEN hi > 2500 THEN 2500 / hi ELSE 1 END)::INT AS ph FROM u
""")
def resize_plan(spark, sf):
    w, h = F.col("w"), F.col("h")
    p = sizes(spark, sf).select("id", G.plan_recognition(w, h).alias("a"), G.plan_app(w, h).alias("b"), G.plan_preprocess(w, h, 300, 2500).alias("c"))
    return p.select("id", "a.*", "b.*", F.col("c.width").alias("pw"), F.col("c.height").alias("ph"))


@query(f"SELECT id, CASE WHEN NOT (w / h BETWEEN 0.08 AND 12) THEN 'SINGLE_LINE' WHEN NOT (w / h BETWEEN 0.25 AND 4) THEN 'SINGLE_BLOCK' WHEN greatest(w, h) < 500 THEN 'SINGLE_BLOCK' ELSE 'AUTO' END AS mode FROM {SIZES_SQL}")
def page_mode(spark, sf):
    return sizes(spark, sf).select("id", G.page_mode(F.col("w"), F.col("h")).alias("mode"))


QUAD_SQL = f"""(SELECT id, w, h, (id % 11)::DOUBLE AS x1, (id % 7)::DOUBLE AS y1, (id % 13 + CASE WHEN id % 5 = 0 THEN 0 ELSE 200 END)::DOUBLE AS x2, (id % 3)::DOUBLE AS y2, (id % 17 + CASE WHEN id % 5 = 0 THEN 0 ELSE 210 END)::DOUBLE AS x3, (id % 19 + 120)::DOUBLE AS y3, CASE WHEN id % 5 = 0 THEN (id % 11)::DOUBLE ELSE (id % 23)::DOUBLE END AS x4, CASE WHEN id % 5 = 0 THEN (id % 7)::DOUBLE ELSE 100 + (id % 29)::DOUBLE END AS y4 FROM {SIZES_SQL})"""
AREA = "abs(x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y4 - x4 * y3 + x4 * y1 - x1 * y4) / 2"
VALID = f"(len(list_distinct([x1 || ',' || y1, x2 || ',' || y2, x3 || ',' || y3, x4 || ',' || y4])) = 4 AND {AREA} > 0.1)"


def quads(spark, sf) -> DataFrame:
    p = lambda x, y: F.struct(F.expr(f"cast({x} as double)").alias("x"), F.expr(f"cast({y} as double)").alias("y"))
    flat = "CASE WHEN id % 5 = 0 THEN {0} ELSE {1} END"
    points = F.array(p("id % 11", "id % 7"), p("id % 13 + " + flat.format(0, 200), "id % 3"), p("id % 17 + " + flat.format(0, 210), "id % 19 + 120"), p(flat.format("id % 11", "id % 23"), flat.format("id % 7", "100 + id % 29")))
    return sizes(spark, sf).select("id", "w", "h", points.alias("q"))


@query(f"SELECT id, {AREA} AS area, {VALID} AS valid, CASE WHEN {VALID} THEN trunc(least(x1, x2, x3, x4))::INT ELSE 0 END AS \"left\", CASE WHEN {VALID} THEN trunc(greatest(y1, y2, y3, y4))::INT ELSE h END AS bottom FROM {QUAD_SQL}")
def quad_area(spark, sf):
    q = F.col("q")
    r = quads(spark, sf).select("id", G.quad_area(q).alias("area"), G.quad_valid(q).alias("valid"), G.quad_bounds(q, F.col("w"), F.col("h")).alias("b"))
    return r.select("id", "area", "valid", "b.left", "b.bottom")


@query(f"""
WITH p AS (SELECT id, list_sort([{{'s': x1 + y1, 'k': 1, 'x': x1, 'y': y1}}, {{'s': x2 + y2, 'k': 2, 'x': x2, 'y': y2}}, {{'s': x3 + y3, 'k': 3, 'x': x3, 'y': y3}}, {{'s': x4 + y4, 'k': 4, 'x': x4, 'y': y4}}]) AS c FROM {QUAD_SQL})
SELECT id, c[1].x AS x1, CASE WHEN c[2].x <= c[3].x THEN c[2].x ELSE c[3].x END AS x2, c[4].x AS x3, CASE WHEN c[2].x <= c[3].x THEN c[3].x ELSE c[2].x END AS x4, CASE WHEN c[2].x <= c[3].x THEN c[2].y ELSE c[3].y END AS y2 FROM p
""")
def quad_corners(spark, sf):
    c = quads(spark, sf).select("id", G.order_corners(F.col("q")).alias("c"))
    return c.select("id", *[F.col("c")[k]["x"].alias(f"x{k + 1}") for k in range(4)], F.col("c")[1]["y"].alias("y2"))


@query(f"""
WITH f AS (SELECT *, least({G.A4_WIDTH}::DOUBLE / 1000, {G.A4_HEIGHT}::DOUBLE / (700 + doc_id % 900)) AS s FROM {BOXES_SQL})
SELECT doc_id, ordinal, round(({G.A4_WIDTH}::DOUBLE - 1000 * s) / 2 + lft * s, 4) AS x, round(({G.A4_HEIGHT}::DOUBLE - (700 + doc_id % 900) * s - 20) + ((700 + doc_id % 900) * s - bot * s), 4) AS y, lft AS plain_x, {G.A4_HEIGHT}::DOUBLE - top AS plain_y FROM f
""")
def pdf_coords(spark, sf):
    fit = G.page_fit(F.lit(1000.0), (700 + F.col("doc_id") % 900).cast("double"))
    at = G.to_page(F.col("box"), fit)
    return boxes(spark, sf).select("doc_id", "ordinal", F.round(at["x"], 4).alias("x"), F.round(at["y"], 4).alias("y"), F.col("box.left").alias("plain_x"), (G.A4_HEIGHT - F.col("box.top")).alias("plain_y"))


@query(f"SELECT id, round(least(1080::DOUBLE / w, 1920::DOUBLE / h), 9) AS scale, round((1080 - w * least(1080::DOUBLE / w, 1920::DOUBLE / h)) / 2, 9) + 0 AS offset_x, round((1920 - h * least(1080::DOUBLE / w, 1920::DOUBLE / h)) / 2, 9) + 0 AS offset_y FROM {SIZES_SQL}")
def aspect_fit(spark, sf):
    f = sizes(spark, sf).select("id", G.aspect_fit(F.lit(1080), F.lit(1920), F.col("w"), F.col("h")).alias("f"))
    return f.select("id", F.round("f.scale", 9).alias("scale"), (F.round("f.offset_x", 9) + 0.0).alias("offset_x"), (F.round("f.offset_y", 9) + 0.0).alias("offset_y"))


# --- benchmark ranking and event rates
RUNS_SQL = """(SELECT event_type AS engine, (user_id % 6)::VARCHAR AS case_name, event_id AS run_no, (trunc(value * 20))::BIGINT AS run_ms, value < 180 AS success FROM events)"""


def bench_runs(spark, sf) -> DataFrame:
    actual = F.when(F.col("event_id") % 3 == 0, "hello wurld").otherwise("hello world")
    return table(spark, sf, "events").select(F.col("event_type").alias("engine"), (F.col("user_id") % 6).cast("string").alias("case_name"), F.lit("hello world").alias("expected"), actual.alias("actual"), F.expr("cast(value * 20 as bigint)").alias("run_ms"), F.col("event_id").alias("run_no"), (F.col("value") < 180).alias("success"))


@query(f"""
WITH r AS (SELECT *, CASE WHEN run_no % 3 = 0 THEN 'hello wurld' ELSE 'hello world' END AS actual FROM {RUNS_SQL}),
c AS (SELECT engine, case_name, bool_or(success) AS ok, floor(avg(run_ms) FILTER (success)) AS ms, max_by(actual, run_no) FILTER (success) AS actual FROM r GROUP BY ALL),
e AS (SELECT engine, coalesce(avg(1 - levenshtein('hello world', actual)::DOUBLE / 11) FILTER (ok), 0) AS char_accuracy, floor(coalesce(avg(ms) FILTER (ok), 0))::BIGINT AS ms, avg(ok::INT) AS success_rate FROM c GROUP BY engine)
SELECT engine, round(char_accuracy, 9) AS char_accuracy, ms, round(success_rate, 9) AS success_rate, engine = (SELECT engine FROM e WHERE success_rate > 0 ORDER BY 0.6 * char_accuracy + 0.3 * (1 - ms / 5000) + 0.1 * success_rate DESC, engine LIMIT 1) AS best FROM e
""")
def bench_ranking(spark, sf):
    rows = ranking.engines(ranking.cases(bench_runs(spark, sf)))
    best = ranking.best(rows).withColumn("best", F.lit(True))
    out = rows.join(F.broadcast(best), "engine", "left")  # one row
    return out.select("engine", F.round("char_accuracy", 9).alias("char_accuracy"), "ms", F.round("success_rate", 9).alias("success_rate"), F.coalesce("best", F.lit(False)).alias("best"))


@query(f"""
WITH r AS (SELECT *, CASE WHEN run_no % 3 = 0 THEN 'hello wurld' ELSE 'hello world' END AS actual FROM {RUNS_SQL}),
c AS (SELECT engine, case_name, bool_or(success) AS ok, coalesce(floor(avg(run_ms) FILTER (success)), 0) AS ms, coalesce(max_by(actual, run_no) FILTER (success), '') AS actual FROM r GROUP BY ALL),
a AS (SELECT *, CASE WHEN ok THEN 1 - levenshtein('hello world', actual)::DOUBLE / 11 ELSE 0 END AS ca, CASE WHEN ok THEN CASE WHEN actual = 'hello world' OR actual = 'hello wurld' THEN 1 ELSE 0 END ELSE 0 END AS wa FROM c),
e AS (SELECT engine, coalesce(avg(ca) FILTER (ok), 0) AS ca, coalesce(avg(wa) FILTER (ok), 0) AS wa, floor(coalesce(avg(ms) FILTER (ok), 0))::BIGINT AS ms, avg(ok::INT) AS rate FROM a GROUP BY engine)
SELECT 0 AS part, NULL::VARCHAR AS engine, NULL::VARCHAR AS case_name, '{ranking.REPORT_HEAD}' AS line UNION ALL SELECT 2, NULL, NULL, '{ranking.REPORT_FOOT}'
UNION ALL SELECT 1, engine, NULL, printf('│ %-12s │ %5.1f%% │ %5.1f%% │ %5dms │   %3d%%      │', left(engine, 12), ca * 100, wa * 100, ms, trunc(rate * 100)::INT) FROM e
UNION ALL SELECT 3, engine, NULL, chr(10) || '═══ ' || engine || ' ═══' FROM e
UNION ALL SELECT 3, engine, case_name, '  ' || CASE WHEN NOT ok THEN '💥' WHEN ca >= 0.9 THEN '✅' WHEN ca >= 0.7 THEN '⚠️' ELSE '❌' END || ' ' || case_name || ': ' || trunc(ca * 100)::INT || '%' || CASE WHEN ok AND ca < 0.9 THEN chr(10) || '     Ожидание: "hello world"' || chr(10) || '     Получено: "' || actual || '"' ELSE '' END FROM a
UNION ALL (SELECT 4, engine, NULL, chr(10) || '🏆 Рекомендация: ' || engine FROM e WHERE rate > 0 ORDER BY 0.6 * ca + 0.3 * (1 - ms / 5000) + 0.1 * rate DESC, engine LIMIT 1)
""")
def bench_report(spark, sf):
    cases = ranking.cases(bench_runs(spark, sf))
    return ranking.full_report(cases, ranking.engines(cases))


FOLD_SQL = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(user_id, n, event_id, last, kept) AS (SELECT user_id, n, event_id, t, true FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.t - f.last {op} {gap} THEN e.t ELSE f.last END, e.t - f.last {op} {gap} FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT event_id, user_id FROM f WHERE kept
"""
HOUR = 3_600_000_000


@query(FOLD_SQL.format(op=">=", gap=HOUR))
def throttle(spark, sf):
    return S.throttle(table(spark, sf, "events"), "user_id", "ts", "event_id", HOUR).select("event_id", "user_id")


@query(FOLD_SQL.format(op=">", gap=24 * HOUR))
def dedup_window(spark, sf):
    return S.dedup_window(table(spark, sf, "events"), "user_id", "ts", "event_id", 24 * HOUR).select("event_id", "user_id")


@query(f"SELECT event_id, user_id FROM (SELECT *, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) AS gap FROM events) WHERE gap IS NULL OR gap >= {HOUR}")
def debounce(spark, sf):
    return S.debounce(table(spark, sf, "events"), "user_id", "ts", "event_id", HOUR).select("event_id", "user_id")


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, trunc(value)::BIGINT * 60000000 AS busy, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'error'),
f(user_id, n, event_id, free, kept) AS (SELECT user_id, n, event_id, t + busy, true FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.t >= f.free THEN e.t + e.busy ELSE f.free END, e.t >= f.free FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT event_id, user_id FROM f WHERE kept
""")
def busy_gate(spark, sf):
    """An event keeps its user busy for as many minutes as its value; errors stand for what comes while paused."""
    busy = F.expr("cast(value as bigint) * 60000000")
    return S.busy_gate(table(spark, sf, "events"), "user_id", "ts", "event_id", busy, F.col("event_type") == "error").select("event_id", "user_id")


KEYED_SQL = "(SELECT event_id, user_id || '/' || event_type || '/' || ts::DATE AS value FROM events)"
HALVES_SQL = f"SELECT event_id, value FROM {KEYED_SQL} WHERE event_id % 2 = 1 AND value NOT IN (SELECT value FROM {KEYED_SQL} WHERE event_id % 2 = 0)"


def keyed(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Every event is in one of two inputs: the odd ids are the batch, the even ones are accepted. A user's events of a type and day are one value."""
    e = table(spark, sf, "events").select("event_id", F.concat_ws("/", "user_id", "event_type", F.to_date("ts")).alias("value"))
    return e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0")


@query(HALVES_SQL)
def batch_dedup(spark, sf):
    return S.batch_dedup(*keyed(spark, sf), "value")


@query(f"{HALVES_SQL} UNION ALL SELECT event_id, value FROM {KEYED_SQL} WHERE event_id % 2 = 0")
def scan_batch_mode(spark, sf):
    return S.scan_mode(*keyed(spark, sf), "BATCH", "value", "event_id")


@query("SELECT event_id, props FROM events ORDER BY event_id LIMIT 1")
def scan_single_mode(spark, sf):
    e = table(spark, sf, "events").select("event_id", "props")
    return S.scan_mode(e, e.limit(0), "SINGLE", "props", "event_id")


# --- images: 40 x 30 pixels for each nation
PIXELS_SQL = "(SELECT n_nationkey::INT AS image_id, x::INT AS x, y::INT AS y, (-16777216 + (x * 7 + n_nationkey * 11 + x * y) % 256 * 65536 + (y * 5 + x * 3 + n_nationkey) % 256 * 256 + (x * x + y) % 256 % CASE WHEN n_nationkey % 2 = 0 THEN 60 ELSE 256 END)::INT AS argb FROM nation, range(0, 40) a(x), range(0, 30) b(y))"
GRAY_SQL = f"(SELECT image_id, x, y, argb, trunc(0.299::DOUBLE * ((argb >> 16) & 255) + 0.587::DOUBLE * ((argb >> 8) & 255) + 0.114::DOUBLE * (argb & 255))::INT AS gray FROM {PIXELS_SQL})"


def pixels(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("image_id"))
    at = n.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(29))))
    argb = "cast(-16777216 + (x * 7 + image_id * 11 + x * y) % 256 * 65536 + (y * 5 + x * 3 + image_id) % 256 * 256 + (x * x + y) % 256 % CASE WHEN image_id % 2 = 0 THEN 60 ELSE 256 END as int)"
    return at.withColumn("argb", F.expr(argb))


def quads_of(p: DataFrame) -> DataFrame:
    """A quadrilateral inside each image but every sixth, which has none."""
    n = p.select("image_id").distinct().where("image_id % 6 > 0")
    return n.selectExpr("image_id", "image_id % 5 x1", "image_id % 3 y1", "39 - image_id % 4 x2", "image_id % 6 y2", "37 x3", "28 - image_id % 7 y3", "image_id % 8 x4", "29 y4")


def _image(name: str, sql: str | None, f) -> None:
    query(sql, name)(lambda spark, sf: f(pixels(spark, sf)))


_channels = "((argb >> 16) & 255) AS r, ((argb >> 8) & 255) AS g, (argb & 255) AS b"
_pack = "(-16777216 + ({0}) * 65536 + ({1}) * 256 + ({2}))::INT"
_clamp = "greatest(0, least(255, trunc({0})::INT))"
_image("img_luma", f"SELECT image_id, x, y, gray FROM {GRAY_SQL}", I.gray)
_image("img_threshold", f"SELECT image_id, x, y, CASE WHEN gray > 120 THEN 255 ELSE 0 END AS v FROM {GRAY_SQL}", lambda p: I.threshold(p, 120))
_image("img_contrast", f"SELECT image_id, x, y, {_pack.format(*[_clamp.format(f'round({c} * 1.5::DOUBLE - 63.75::DOUBLE)') for c in 'rgb'])} AS argb FROM (SELECT *, {_channels} FROM {PIXELS_SQL})", lambda p: I.contrast(p, 1.5))
_image("img_preview", f"SELECT image_id, x, y, {_pack.format(*[_clamp.format(f'round({c} * 1.5::DOUBLE + 10 - 64)') for c in 'rgb'])} AS argb FROM (SELECT *, {_channels} FROM {PIXELS_SQL})", lambda p: I.contrast_brightness(p, 1.5, 10.0))
_image("img_invert", f"WITH g AS (SELECT *, {_channels}, avg(gray) OVER (PARTITION BY image_id) < 120 AS dark FROM {GRAY_SQL}) SELECT image_id, x, y, CASE WHEN dark THEN {_pack.format('255 - r', '255 - g', '255 - b')} ELSE argb END AS argb FROM g", lambda p: I.invert_dark(p, 120.0))
BLUR_SQL = f"""(SELECT image_id, x, y, gray, floor(sum(h) OVER w / count(*) OVER w)::INT AS blur FROM (SELECT image_id, x, y, gray, floor(sum(gray) OVER w / count(*) OVER w)::INT AS h FROM {GRAY_SQL} WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))"""
_image("img_blur", f"SELECT image_id, x, y, gray, blur FROM {BLUR_SQL}", lambda p: I.box_blur(I.gray(p), 5))
_image("img_background", f"SELECT image_id, x, y, greatest(0, least(255, 255 - greatest(0, least(255, 255 + greatest(-255, least(255, blur - gray)))) + gray))::INT AS v FROM {BLUR_SQL}", lambda p: I.remove_background(p, 5))
_around = "lag({0}) OVER r AS {0}w, lead({0}) OVER r AS {0}e, lag({0}) OVER c AS {0}n, lead({0}) OVER c AS {0}s"
_sharp = [_clamp.format(f"5 * {c} - {c}w - {c}e - {c}n - {c}s") for c in "rgb"]
_image("img_sharpen", f"WITH k AS (SELECT *, {_channels} FROM {PIXELS_SQL}), a AS (SELECT *, {', '.join(_around.format(c) for c in 'rgb')} FROM k WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)) SELECT image_id, x, y, CASE WHEN rw IS NULL OR re IS NULL OR rn IS NULL OR rs IS NULL THEN argb ELSE {_pack.format(*_sharp)} END AS argb FROM a", I.sharpen)
_mid = [f"list_sort(list(({c})))[5]" for c in ("(q.argb >> 16) & 255", "(q.argb >> 8) & 255", "q.argb & 255")]
_image("img_median", f"WITH p AS (SELECT * FROM {PIXELS_SQL}) SELECT p.image_id, p.x, p.y, CASE WHEN count(*) < 9 THEN p.argb ELSE {_pack.format(*_mid)} END AS argb FROM p JOIN p q ON p.image_id = q.image_id AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 GROUP BY p.image_id, p.x, p.y, p.argb", I.median)
_image("img_integral", f"SELECT image_id, x, y, (sum(s) OVER w)::BIGINT AS integral, (sum(q) OVER w)::BIGINT AS integral_sq FROM (SELECT *, sum(gray) OVER w AS s, sum(gray * gray) OVER w AS q FROM {GRAY_SQL} WINDOW w AS (PARTITION BY image_id, y ORDER BY x)) WINDOW w AS (PARTITION BY image_id, x ORDER BY y)", lambda p: I.integral(I.gray(p)))
_frame = "ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING"
_image("img_adaptive", f"""WITH h AS (SELECT *, sum(gray) OVER w AS s, sum(gray * gray) OVER w AS q, count(*) OVER w AS n FROM {GRAY_SQL} WINDOW w AS (PARTITION BY image_id, y ORDER BY x {_frame})),
v AS (SELECT image_id, x, y, gray, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(n) OVER w AS n FROM h WINDOW w AS (PARTITION BY image_id, x ORDER BY y {_frame}))
SELECT image_id, x, y, CASE WHEN gray > s::DOUBLE / n::DOUBLE * (1 + 0.08::DOUBLE * (sqrt(greatest(0, q::DOUBLE / n::DOUBLE - (s::DOUBLE / n::DOUBLE) * (s::DOUBLE / n::DOUBLE))) / 128 - 1)) THEN 255 ELSE 0 END AS v FROM v""", I.adaptive_threshold)
_image("img_otsu", f"""WITH h AS (SELECT image_id, gray, count(*) AS n FROM {GRAY_SQL} GROUP BY ALL),
s AS (SELECT *, sum(n) OVER o AS n0, sum(n * gray) OVER o AS s0, sum(n) OVER e AS n1, sum(n * gray) OVER e AS s1 FROM h WINDOW o AS (PARTITION BY image_id ORDER BY gray), e AS (PARTITION BY image_id)),
v AS (SELECT image_id, gray, round(coalesce(n0::DOUBLE * (n1 - n0)::DOUBLE * pow(s0::DOUBLE / n0 - (s1 - s0)::DOUBLE / nullif(n1 - n0, 0), 2), 0), 6) AS v FROM s),
t AS (SELECT image_id, gray AS t FROM v QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY v DESC, gray) = 1)
SELECT g.image_id, x, y, CASE WHEN g.gray > t THEN 255 ELSE 0 END AS v FROM {GRAY_SQL} g JOIN t ON g.image_id = t.image_id""", I.binarize_otsu)
_image("img_desaturate", f"SELECT image_id, x, y, {_pack.format('v', 'v', 'v')} AS argb FROM (SELECT image_id, x, y, (213 * r + 715 * g + 72 * b + 500) // 1000 AS v FROM (SELECT *, {_channels} FROM {PIXELS_SQL}))", I.desaturate)
_image("img_unwarp", f"""WITH p AS (SELECT * FROM {PIXELS_SQL}),
q AS (SELECT DISTINCT image_id, (image_id % 5)::DOUBLE AS x1, (image_id % 3)::DOUBLE AS y1, (39 - image_id % 4)::DOUBLE AS x2, (image_id % 6)::DOUBLE AS y2, 37::DOUBLE AS x3, (28 - image_id % 7)::DOUBLE AS y3, (image_id % 8)::DOUBLE AS x4, 29::DOUBLE AS y4 FROM p WHERE image_id % 6 > 0),
m AS (SELECT *, ((x1 - x2 + x3 - x4) * (y4 - y3) - (x4 - x3) * (y1 - y2 + y3 - y4)) / ((x2 - x3) * (y4 - y3) - (x4 - x3) * (y2 - y3)) AS g, ((x2 - x3) * (y1 - y2 + y3 - y4) - (x1 - x2 + x3 - x4) * (y2 - y3)) / ((x2 - x3) * (y4 - y3) - (x4 - x3) * (y2 - y3)) AS k FROM q),
b AS (SELECT p.image_id, x, y, floor(((x2 - x1 + g * x2) * (x / 40::DOUBLE) + (x4 - x1 + k * x4) * (y / 30::DOUBLE) + x1) / (g * (x / 40::DOUBLE) + k * (y / 30::DOUBLE) + 1) * 32 + 0.5::DOUBLE)::BIGINT AS u, floor(((y2 - y1 + g * y2) * (x / 40::DOUBLE) + (y4 - y1 + k * y4) * (y / 30::DOUBLE) + y1) / (g * (x / 40::DOUBLE) + k * (y / 30::DOUBLE) + 1) * 32 + 0.5::DOUBLE)::BIGINT AS v FROM p JOIN m ON p.image_id = m.image_id),
n AS (SELECT b.image_id, b.x, b.y, (CASE i WHEN 1 THEN u & 31 ELSE 32 - (u & 31) END) * (CASE j WHEN 1 THEN v & 31 ELSE 32 - (v & 31) END) AS w, argb FROM b, range(2) a(i), range(2) c(j) , p s WHERE s.image_id = b.image_id AND s.x = (b.u >> 5) + i AND s.y = (b.v >> 5) + j),
t AS (SELECT b.image_id, b.x, b.y, (coalesce(sum(w * 255), 0) + 512) // 1024 AS a, (coalesce(sum(w * ((argb >> 16) & 255)), 0) + 512) // 1024 AS r, (coalesce(sum(w * ((argb >> 8) & 255)), 0) + 512) // 1024 AS g, (coalesce(sum(w * (argb & 255)), 0) + 512) // 1024 AS bl FROM b LEFT JOIN n ON b.image_id = n.image_id AND b.x = n.x AND b.y = n.y GROUP BY ALL)
SELECT image_id, x, y, ((CASE WHEN a > 127 THEN a - 256 ELSE a END) * 16777216 + r * 65536 + g * 256 + bl)::INT AS argb FROM t UNION ALL SELECT image_id, x, y, argb FROM p WHERE image_id % 6 = 0""", lambda p: I.unwarp(p, quads_of(p)))
_mean = "floor(sum({0}) OVER w / count(*) OVER w)::INT AS {1}"
_image("img_document", f"""
WITH h AS (SELECT *, {_mean.format('gray', 'h')} FROM {GRAY_SQL} WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)),
b AS (SELECT *, {_mean.format('h', 'blur')} FROM h WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)),
c AS (SELECT image_id, x, y, {_clamp.format(f'round(greatest(0, least(255, 255 - greatest(0, least(255, 255 + blur - gray)) + gray)) * 1.3::DOUBLE + {(1 - 1.3) / 2 * 255!r}::DOUBLE)')} AS v FROM b),
m AS (SELECT c.image_id, c.x, c.y, CASE WHEN count(*) < 9 THEN c.v ELSE list_sort(list(d.v))[5] END AS v FROM c JOIN c d ON c.image_id = d.image_id AND abs(c.x - d.x) <= 1 AND abs(c.y - d.y) <= 1 GROUP BY c.image_id, c.x, c.y, c.v),
a AS (SELECT *, {_around.format('v')} FROM m WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
s AS (SELECT image_id, x, y, CASE WHEN vw IS NULL OR ve IS NULL OR vn IS NULL OR vs IS NULL THEN v ELSE greatest(0, least(255, 5 * v - vw - ve - vn - vs)) END AS v FROM a)
SELECT image_id, x, y, CASE WHEN trunc(0.299::DOUBLE * v + 0.587::DOUBLE * v + 0.114::DOUBLE * v) > 128 THEN -1 ELSE -16777216 END AS argb FROM s""", lambda p: I.document_pipeline(p, background=True, binarize=128))
_image("img_rotate", f"SELECT image_id, (CASE image_id % 4 WHEN 1 THEN 29 - y WHEN 2 THEN 39 - x WHEN 3 THEN y ELSE x END)::INT AS x, (CASE image_id % 4 WHEN 1 THEN x WHEN 2 THEN 29 - y WHEN 3 THEN 39 - x ELSE y END)::INT AS y, argb FROM {PIXELS_SQL}", lambda p: I.rotate(p, F.col("image_id") % 4 * 90))


@query(f"""
WITH y AS (SELECT image_id, x, y, argb & 255 AS yv FROM {PIXELS_SQL}), c AS (SELECT DISTINCT image_id, x >> 1 AS cx, y >> 1 AS cy, (image_id * 3 + (x >> 1) * 11) % 256 - 128 AS u, ((y >> 1) * 13 + image_id) % 256 - 128 AS v FROM {PIXELS_SQL})
SELECT y.image_id, x, y, {_pack.format(_clamp.format("yv + 1.370705::DOUBLE * v"), _clamp.format("yv - 0.337633::DOUBLE * u - 0.698001::DOUBLE * v"), _clamp.format("yv + 1.732446::DOUBLE * u"))} AS argb FROM y JOIN c ON y.image_id = c.image_id AND x >> 1 = cx AND y >> 1 = cy
""")
def img_yuv(spark, sf):
    p = pixels(spark, sf)
    y = p.select("image_id", "x", "y", F.col("argb").bitwiseAND(255).alias("yv"))
    c = p.where("x % 2 = 0 and y % 2 = 0").select("image_id", F.shiftright("x", 1).alias("cx"), F.shiftright("y", 1).alias("cy"))
    c = c.select("*", ((F.col("image_id") * 3 + F.col("cx") * 11) % 256).alias("u"), ((F.col("cy") * 13 + F.col("image_id")) % 256).alias("v"))
    return I.yuv_to_rgb(y, c)


@query("SELECT user_id AS image_id, CASE WHEN abs(m) > 0.5 THEN round(m, 9) END AS angle FROM (SELECT user_id, list_sort(list(d))[len(list(d)) // 2 + 1] AS m FROM (SELECT user_id, (value * 0.9::DOUBLE) % 180 - 90 AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 20 AND abs(d) < 45 GROUP BY user_id)")
def img_skew(spark, sf):
    from pyspark.sql import Window as W

    e = table(spark, sf, "events").select(F.col("user_id").alias("image_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("line_no"), (F.col("value") * 0.9 % 180).alias("theta"))
    return I.skew(e).withColumn("angle", F.round("angle", 9))


# --- licences and identifiers
@query("""
WITH l AS (SELECT c_custkey AS id, DATE '2024-01-01' + (c_custkey * 37 % 1500 - 700)::INT AS expiry FROM customer)
SELECT id, CASE WHEN id % 11 = 0 THEN 'soon' ELSE strftime(expiry, '%Y-%m-%d') END AS expiry_date, CASE WHEN id % 11 = 0 THEN false ELSE TIMESTAMP '2024-06-01 12:00:00' <= expiry END AS valid, CASE WHEN id % 3 = 0 THEN 'redact,scan' ELSE '' END AS features FROM l
""")
def license_valid(spark, sf):
    i = F.col("c_custkey")
    expiry = F.when(i % 11 == 0, "soon").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i * 37 % 1500 - 700).cast("int")), "yyyy-MM-dd"))
    features = F.when(i % 3 == 0, "{'features': ['scan', 'redact']}").when(i % 3 == 1, "scan").otherwise("[]")
    text = F.to_json(F.struct(F.concat(F.lit("dev"), i).alias("device_id"), F.lit("x").alias("signature"), expiry.alias("expiry_date"), features.alias("features")))
    c = table(spark, sf, "customer").select(i.alias("id"), K.fields(text).alias("f"))
    return c.select("id", F.col("f.expiry_date").alias("expiry_date"), K.in_date(F.col("f.expiry_date"), F.lit("2024-06-01 12:00:00").cast("timestamp")).alias("valid"), F.array_join(F.array_sort(K.features(F.col("f.features"))), ",").alias("features"))


@query("SELECT c_custkey AS id, translate(to_base64(unhex(sha256(c_name))), '+/', '-_') AS device_id FROM customer")
def license_device_id(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), K.device_id(F.col("c_name")).alias("device_id"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def license_round_trip(spark, sf):
    """AES-GCM there and back: what comes out is what went in (the ciphertext itself is random)."""
    key = F.unhex(F.sha2(F.lit("key"), 256))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), K.decrypt(K.encrypt(F.col("c_name"), key), key).alias("name"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS file_name FROM orders")
def file_timestamp(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), K.file_timestamp(F.col("o_orderdate")).alias("file_name"))
