"""Matches of one length that overlap: the masked text depends on which comes first, and is that of the SQL."""

import duckdb

from palimpsest.plans import layout_queries, text_queries  # noqa: F401  (they register their queries)
from palimpsest.plans.registry import QUERIES, SQL

TEXTS = [
    "02.19.31 aneand. +1 (208) 555-1177 4284896609045836",
    "kfslg.71@mail0.example.com +1 (578) 555-6437 4918187128635271 eredth",
    "555-9177 4284896609045836 and 1177 4284896609045836",
    "no match", "", None,
]


def test_mask_as_in_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {k: (n, h) for k, n, h in db.execute(f"SELECT doc_id, n_found, sha256 FROM ({SQL['redact_documents']})").fetchall()}
    got = {r.doc_id: (r.n_found, r.sha256) for r in QUERIES["redact_documents"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == len(TEXTS)
