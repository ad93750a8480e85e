"""Word order of the line sets in very long pieces, frequent words, cells and further rounds."""

import random

import numpy as np
import pytest

from palimpsest.llm import line_dedup

from . import brute


def test_one_word_order_for_all_sizes(spark):
    lines = [" ".join(f"w{i}x{k}" for k in range(10)) for i in range(30)]
    classes = np.full(1 << line_dedup.BUCKET_BITS, 3, np.uint8)  # equal rarity
    got = []
    for more in ([], ["x"] * (1 << 20)):
        df = spark.createDataFrame([(1, 2, "\n".join(lines + more))], "id long, hash long, text string")
        rows = line_dedup.line_sets(df, classes, 80).where(f"line < {len(lines)}").select("line", "keys").collect()
        got.append({r.line: bytes(r["keys"]) for r in rows})
    assert len(got[0]) == len(lines) and got[0] == got[1]


def near_lines(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    family = rng.sample(words, 20)
    rows = []
    for k in range(120):
        out = []
        for _ in range(4):
            w = list(family) if rng.random() < 0.6 else rng.sample(words, rng.choice([4, 5, 9, 14, 20]))
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
        rows.append((k, "\n".join(out)))
    return rows


@pytest.mark.parametrize("hot, cell, pairs", [(17, 14, 1 << 21), (2, 14, 1 << 21), (17, 3, 1 << 21), (4, 2, 500)])
def test_frequent_words_cells_and_rounds(spark, monkeypatch, hot, cell, pairs):
    monkeypatch.setattr(line_dedup, "HOT_CLASS", hot)
    monkeypatch.setattr(line_dedup, "CELL_BITS", cell)
    monkeypatch.setattr(line_dedup, "PAIRS", pairs)
    monkeypatch.setattr(line_dedup, "MORE_K", 3)
    rows = near_lines(hot * 100 + cell)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.lines.n_lines, r.lines.n_removed, brute.sha(r.text or "")) for r in got} == brute.op7(rows)


def test_repeated_ids_with_other_texts(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j\nq"), (2, "v w x y z zz"), (2, "v w x y z zz"), (None, "one two three four"), (None, "k l m n o p")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.lines.n_removed) for r in got if r.doc_id) == [(1, rows[0][1], 0), (2, "q", 1), (2, rows[2][1], 0), (2, rows[2][1], 0)]
    assert {r.text for r in got if r.doc_id is None} == {rows[4][1], rows[5][1]}


def test_clashing_columns(spark):
    names = "id, hash, stay, kept_id, kept_hash, gone, line, _id, n, role, part"
    df = spark.createDataFrame([(1, "a b c d e\na b c d e")], "doc_id long, text string").selectExpr("*", *[f"'x' as {c.strip()}" for c in names.split(",")])
    got = line_dedup.dedup_lines(df).first()
    assert got.text == "a b c d e" and got.hash == "x" and got.stay == "x"
