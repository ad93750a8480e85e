"""Queries that SQL does not express, over their whole tables, against plain versions."""

import hashlib
import re

import numpy as np

from palimpsest.functions.patterns import DETECTORS
from palimpsest.operators import ranking
from palimpsest.plans import layout_queries, text_queries  # noqa: F401  (they register their queries)
from palimpsest.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
# Java's \d and \s are ASCII, its \b is not.
PATTERNS = {c: re.compile(re.sub(r"\[\\s-\]", "[ \t-\r-]", p).replace(r"\s", "[ \t-\r]").replace(r"\d", "[0-9]")) for c, p in DETECTORS.items()}


def is_card(match):
    digits = [int(c) for c in re.sub(r"[ \t-\r-]", "", match)]
    doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def redacted(text):
    found = []
    for category, pattern in PATTERNS.items():
        found += [m[0] for m in pattern.finditer(text or "") if category != "credit_card" or is_card(m[0])]
    if text is not None:
        for m in sorted(dict.fromkeys(found), key=len, reverse=True):
            text = text.replace(m, "█" * len(m))
    return len(found), None if text is None else hashlib.sha256(text.encode()).hexdigest()


def test_redact_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: redacted(r.text) for r in rows}
    got = {r.doc_id: (r.n_found, r.sha256) for r in QUERIES["redact_documents"](spark, SF).collect()}
    assert got == want and any(n for n, _ in want.values())


def near(a, b):
    """Whether one edit at most makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def test_word_accuracy(spark):
    rows = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {r.item_id: r.accuracy for r in QUERIES["word_accuracy"](spark, SF).collect()}
    assert set(got) == {r.item_id for r in rows}
    for r in rows:
        if r.text is None:
            continue
        words, left, matched = r.text.lower().split(), r.text.replace("th", "t").lower().split(), 0
        total = len(left)
        for w in words:
            at = next((i for i, x in enumerate(left) if near(x, w)), None)
            if at is not None:
                matched += 1
                del left[at]
        assert got[r.item_id] == round(matched / len(words) if words else float(not total), 9)


def test_img_document(spark):
    """Background, contrast, median, sharpening and threshold of whole images, in NumPy."""

    def clipped_mean(v, r):
        sums, n = np.zeros(v.shape), np.zeros(v.shape)
        for d in range(-r, r + 1):
            to, of = slice(max(0, -d), max(0, v.shape[1] - max(0, d))), slice(max(0, d), max(0, v.shape[1] + min(0, d)))
            sums[:, to] += v[:, of]
            n[:, to] += 1
        return np.floor(sums / n)

    def inner(v, f):
        out = v.copy()
        out[1:-1, 1:-1] = f(v)
        return out

    shifted = lambda v, i, j: v[1 + i : v.shape[0] - 1 + i, 1 + j : v.shape[1] - 1 + j]
    pixels = layout_queries.pixels(spark, SF).toPandas()
    got = QUERIES["img_document"](spark, SF).toPandas()
    assert len(got) == len(pixels)
    for k, image in pixels.groupby("image_id"):
        argb = image.pivot(index="y", columns="x", values="argb").to_numpy()
        gray = np.trunc(0.299 * (argb >> 16 & 255) + 0.587 * (argb >> 8 & 255) + 0.114 * (argb & 255))
        blur = clipped_mean(clipped_mean(gray, 30).T, 30).T
        v = np.clip(255 - np.clip(255 + blur - gray, 0, 255) + gray, 0, 255)
        v = np.clip(np.round(v * 1.3 - 38.25), 0, 255)
        v = inner(v, lambda v: np.median([shifted(v, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0))
        v = inner(v, lambda v: np.clip(5 * shifted(v, 0, 0) - shifted(v, 0, 1) - shifted(v, 0, -1) - shifted(v, 1, 0) - shifted(v, -1, 0), 0, 255))
        want = np.where(np.trunc(0.299 * v + 0.587 * v + 0.114 * v) > 128, -1, -16777216)
        mine = got[got.image_id == k].pivot(index="y", columns="x", values="argb").to_numpy()
        assert (mine == want).all()


def test_full_report(spark):
    rows = [("b", "one", "abcd", "abcd", 10, 1, True), ("b", "two", "abcdefghij", "abcdefgxyz", 20, 1, True), ("a", "one", "abcd", "", 10, 1, False)]
    cases = ranking.cases(spark.createDataFrame(rows, "engine string, case_name string, expected string, actual string, run_ms long, run_no long, success boolean"))
    lines = [r.line for r in ranking.full_report(cases, ranking.engines(cases)).orderBy("part", "engine", "case_name").collect()]
    assert lines[1:] == [
        "│ a            │   0.0% │   0.0% │     0ms │     0%      │", "│ b            │  85.0% │  50.0% │    15ms │   100%      │", ranking.REPORT_FOOT,
        "\n═══ a ═══", "  💥 one: 0%", "\n═══ b ═══", "  ✅ one: 100%", '  ⚠️ two: 70%\n     Ожидание: "abcdefghij"\n     Получено: "abcdefgxyz"', "\n🏆 Рекомендация: b",
    ]
    none = cases.limit(0)
    assert [r.part for r in ranking.full_report(none, ranking.engines(none)).orderBy("part").collect()] == [0, 2]
