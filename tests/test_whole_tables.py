"""Queries over whole tables against plain versions."""

from palimpsest.plans import layout_queries, text_queries  # noqa: F401  (they register their queries)
from palimpsest.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_corners_with_ties(spark):
    def plain(i):
        tie = i % 5 == 0
        q = [(i % 11, i % 7), (i % 13 + (0 if tie else 200), i % 3), (i % 17 + (0 if tie else 210), i % 19 + 120), (i % 11, i % 7) if tie else (i % 23, 100 + i % 29)]
        c = sorted(q, key=sum)  # stable, as in the reference
        small, large = (c[1], c[2]) if c[1][0] <= c[2][0] else (c[2], c[1])
        return c[0][0], small[0], c[3][0], large[0], small[1]

    ids = [r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()]
    got = {r.id: (r.x1, r.x2, r.x3, r.x4, r.y2) for r in QUERIES["quad_corners"](spark, SF).collect()}
    assert got == {i: plain(i) for i in ids} and any(i % 5 == 0 for i in ids)


def test_char_accuracy_of_whole_texts(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text}
    odd = sorted((i for i, t in texts.items() if not t.isascii()), key=lambda i: len(texts[i]))[:20]
    got = {r.item_id: r.accuracy for r in QUERIES["char_accuracy"](spark, SF).collect()}
    for i in odd:
        e = texts[i].lower().strip()
        a = texts[i].translate(str.maketrans("aeo", "ecu")).replace("th", "t").lower().strip()
        assert got[i] == round(max(0, 1 - distance(e, a) / max(len(e), len(a))), 9)
    assert odd and set(texts) <= set(got)
