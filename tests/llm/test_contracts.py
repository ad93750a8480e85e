"""The queries against plain versions: on the small tables, and on planted rows."""

import random

import pytest

from palimpsest.llm import decontaminate, line_dedup, near_dup, quality, queries, substring

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def planted(seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, None), (3, ""), (4, " \n\t"), (5, "one"), (6, "One"), (7, "one two"), (8, "ONE two\n")]
    for k in range(10, 40):  # near copies, some of which are near only to some of the others
        w = list(base)
        for _ in range(rng.choice([1, 4, 6, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((k, " ".join(w)))
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    for k in range(40, 60):
        own = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 40]))) for _ in range(6)]
        own.insert(2, passage)
        rows.append((k, "\n".join(own)))
    rows += [(60, "und " * 300), (61, "und " * 34), (62, ("a b c d e f g " * 400) + passage), (63, "é à\n\né à\r\n tail\n"), (64, "x" * 5000 + " y")]
    lines = [" ".join(rng.sample(vocabulary, 12)) for _ in range(5)]
    for k in range(70, 90):
        w = [" ".join(rng.sample(x.split(), 12)[: rng.choice([10, 11, 12])] + rng.sample(vocabulary, rng.choice([0, 1]))) for x in lines]
        rows.append((k, "\n".join(w)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("which", ["table", "planted"])
def test_near_duplicates(spark, docs, which):
    rows = docs if which == "table" else planted()
    got = near_dup.near_duplicates(frame(spark, rows), shingle=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.op2(rows)


@pytest.mark.parametrize("which", ["table", "planted"])
def test_substring(spark, docs, which):
    rows = docs if which == "table" else planted()
    got = substring.remove_repeats(frame(spark, rows)).collect()
    assert {r.doc_id: (r.dedup.n_words, r.dedup.n_removed, brute.sha(r.dedup.kept)) for r in got} == brute.op5(rows)


@pytest.mark.parametrize("which", ["table", "planted"])
def test_lines(spark, docs, which):
    rows = docs if which == "table" else planted()
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert {r.doc_id: (r.lines.n_lines, r.lines.n_removed, brute.sha(r.text or "")) for r in got} == brute.op7(rows)


def test_quality(spark, docs):
    rows = docs + [(10_000 + i, t) for i, t in planted()]
    frame_ = frame(spark, rows).selectExpr("*", "cast(null as string) lang", "1 as n_words")
    got = {r.doc_id: r.quality for r in quality.judge(frame_).collect()}
    for i, text in rows:
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute.op3(text)
        assert not (q.base_failed and q.kept)


def test_decontaminate(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op9_prefix_join(spark, SF).collect()}
    want = brute.op9(docs, items)
    assert got == want and any(x[4] for x in want.values())


@pytest.mark.parametrize("bits", [22, 6])
def test_decontaminate_odd(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "MAX_BITS", bits)  # 6: a bitmap that lets nearly all through
    rows = planted() + [(100, "Zürich ONE-two, three " * 3 + "w1"), (101, "the end É x"), (102, "w1 " * 3000)]
    items = [(1, None), (2, ""), (3, "one two"), (4, "ONE"), (5, "one"), (6, rows[0][1]), (7, rows[0][1]), (None, "É x"), (9, "w1 " * 20)]
    found = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, brute.sha(",".join(r["items"])), r.contaminated) for r in found}
    want = brute.op9(rows, items)
    assert got == want and got[101][1:4] == (2, 1, brute.sha(""))


def test_empty_tables(spark):
    none = frame(spark, [])
    assert near_dup.near_duplicates(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert quality.judge(none.selectExpr("*", "'en' lang")).count() == 0
    assert decontaminate.contamination(none, none.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert decontaminate.contamination(frame(spark, planted()[:5]), none.withColumnRenamed("doc_id", "item_id")).where("n_hit > 0").count() == 0


def test_nulls_repeats_and_clashes(spark):
    text = " ".join(f"t{k}" for k in range(60))
    rows = [(None, text), (None, text), (None, None), (5, text), (5, text), (6, "short")]
    df = frame(spark, rows).selectExpr("*", "'a' as id", "'b' as key", "1 as kept", "2 as component", "'c' as lang", "3 as start", "4 as line")
    got = sorted(map(tuple, near_dup.near_duplicates(df).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(None, None, True)] * 3 + [(5, 5, True)] * 2 + [(6, 6, True)], key=str)
    assert sorted(r.dedup.n_removed for r in substring.remove_repeats(df).collect()) == [0, 0, 60, 60, 60, 60]
    assert sorted(r.lines.n_removed for r in line_dedup.dedup_lines(df).collect()) == [0, 0, 0, 0, 1, 1]
    assert quality.judge(df).count() == 6
    assert decontaminate.decontaminated(df, spark.createDataFrame([(1, "short"), (2, "t0 t1")], "item_id long, text string")).count() == 5
    for make in (substring.remove_repeats, line_dedup.dedup_lines):
        with pytest.raises(ValueError):
            make(df.selectExpr("*", "1 as dedup", "1 as lines"))
