"""The logged correction chain holds a piece of its output at a time, and reads each text once."""

import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.operators import corrections as C
from palimpsest.plans import text_queries  # noqa: F401  (registers its queries)
from palimpsest.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_pieces(monkeypatch):
    texts = ["Пpивет  , мир - да", None, "", "слово ,слово", "A1o2 2o2"] * 40
    whole = [C.correct(t, "TABLE", "ru") if t is not None else (None, []) for t in texts]
    monkeypatch.setattr(C, "PIECE", 100)
    batch = (pa.array(texts), pa.array(["TABLE"] * len(texts)), pa.array(["ru"] * len(texts)))
    made = list(C.pieces([batch, tuple(x[:0] for x in batch)]))
    rows = [r for p in made for r in p.to_pylist()]
    assert [(r["text"], [tuple(c.values()) for c in r["changes"]]) for r in rows] == whole
    assert len(made) > 10 and max(map(len, made)) < 20


def test_each_text_is_read_once(spark):
    df = QUERIES["post_changes_by_processor"](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_more_texts_than_a_batch(spark):
    n = 25_000
    df = spark.range(0, n, 1, 2).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("Пpивет  , "), F.col("id").cast("string"))).alias("t"))
    rows = df.select("id", C.corrected(F.col("t")).alias("r")).select("id", "r.text", F.size("r.changes").alias("n")).collect()
    assert {r.id: (r.text, r.n) for r in rows} == {k: (f"Привет, {k}", 3) if k % 7 else (None, 0) for k in range(n)}
