"""Wide boxes, which the grid does not hold, against all pairs."""

import random

from palimpsest.operators import layout, redact

BOX = "struct<left: double, top: double, right: double, bottom: double>"


def some(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.uniform(-3000, 9000), r.uniform(-3000, 9000)
        size = r.choice([5, 300, 2500, 50_000])
        out.append((i % 2, i, f"t{i}", (x, y, x + r.uniform(0, size), y + r.uniform(0, size))))
    return out


def test_covered(spark):
    boxes, masks = some(120, 1), some(40, 2)
    frame = lambda rows: spark.createDataFrame(rows, f"doc_id int, ordinal int, text string, box {BOX}")
    hit = lambda a, b: a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]
    want = {(d, i) for d, i, _, a in boxes if any(d == e and hit(a, b) for e, _, _, b in masks)}
    got = redact.covered(frame(boxes), frame(masks)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) < len(boxes)


def test_first_hit(spark):
    boxes = some(120, 3)
    points = [(d, i, b[0], b[1]) for d, i, _, b in some(60, 4)] + [(0, 900, boxes[0][3][2], boxes[0][3][3])]
    frame = spark.createDataFrame(boxes, f"doc_id int, ordinal int, text string, box {BOX}")
    got = layout.first_hit(frame, spark.createDataFrame(points, "doc_id int, point_id int, x double, y double"))
    want = {}
    for d, p, x, y in points:
        inside = [(i, t) for e, i, t, b in boxes if d == e and b[0] <= x <= b[2] and b[1] <= y <= b[3]]
        if inside:
            want[d, p] = min(inside)
    assert {(r.doc_id, r.point_id): (r.ordinal, r.text) for r in got.collect()} == want
