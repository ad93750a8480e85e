"""The stages against plain versions, each on its own input, over the smallest tables."""

import base64

import corpus_pipeline
from palimpsest.llm.queries import tokenizer_file

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
        if k < 4:
            assert docs.columns == columns
    text = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    quality, lines, near, clean = (text(d) for d in kept[:4])

    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    source = text(spark.read.parquet(f"{SF}/documents.parquet"))
    fine = {i for i, t in source.items() if not brute.op3(t)[-1]}
    assert set(quality) <= fine and len(good & fine - set(quality)) <= 0.01 * len(good & fine)
    want = brute.op7(list(quality.items()))
    assert {i: brute.sha(t or "") for i, t in lines.items()} == {i: w[2] for i, w in want.items()}
    want = brute.op2(list(lines.items()), k=5)
    assert set(near) == {i for i, w in want.items() if w[2]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute.op9(list(near.items()), items)
    assert set(clean) == {i for i, w in want.items() if not w[4]}

    rank_file, _ = tokenizer_file()
    token = {int(n): base64.b64decode(t) for t, n in map(bytes.split, open(rank_file, "rb"))}
    last = kept[4].collect()
    assert {r.doc_id for r in last} == set(clean) and all(r.round_trip for r in last)
    assert all(b"".join(token[i] for i in r.token_ids).decode() == (clean[r.doc_id] or "") for r in last)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
