"""PDF text layers of many small pages and of pages longer than a batch: no call for each page, and one order."""

import random

from palimpsest.plans import layout_queries, text_queries  # noqa: F401  (they register their queries)
from palimpsest.plans.registry import QUERIES
from palimpsest.sources import pdf_text

SF = "/root/testdata/sf0.001"
PLACED = "doc_id long, x double, y double, text string, font_size double"


def layers(spark, rows, parts=3):
    return {r.doc_id: bytes(r.content) for r in pdf_text.text_layers(spark.createDataFrame(rows, PLACED).repartition(parts), "doc_id").collect()}


def test_no_call_for_each_page(spark):
    plan = QUERIES["redact_pdf"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_ties_are_drawn_by_text(spark):
    rows = [(1, 5.0, 7.0, t, 10.0) for t in "abcdefghij"] + [(1, 1.0, 7.0, "first", 10.0), (1, 0.0, 3.0, "last", 10.0)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        assert pdf_text.texts(layers(spark, rows, 1 + seed)[1]) == ["first", *"abcdefghij", "last"]


def test_pages_over_batches_and_pieces(spark):
    sizes = {1: 25_000, 2: 1, 3: 9_999, **dict.fromkeys(range(4, 3000), 2)}
    rows = [(d, float(k % 7), float(-k), f"{d}.{k}", 10.0 + d % 3) for d, n in sizes.items() for k in range(n)]
    got = layers(spark, rows)
    assert set(got) == set(sizes)
    for d in (1, 2, 3, 4, 2999):
        assert got[d] == pdf_text.pdf([r[1:4] for r in rows if r[0] == d], 10.0 + d % 3)
    assert all(pdf_text.texts(c) == [f"{d}.{k}" for k in range(sizes[d])] for d, c in got.items() if d > 3)
