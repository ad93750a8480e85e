"""What the quality rules catch, held against the labels of a whole table."""

from palimpsest.llm import queries

SF = "/root/testdata/sf0.01"


def test_rates(spark):
    rows = queries.queries()["op3_distribution_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    bad, good = ([r for r in rows if r.quality == k] for k in (0, 1))
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)
    assert all(r.kept or r.base_failed for r in good) and len(good) > len(bad)
