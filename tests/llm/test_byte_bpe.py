import hashlib

import pytest

from palimpsest.llm import byte_bpe
from palimpsest.llm.queries import op6_byte_bpe, tokenizer_file


@pytest.fixture(scope="module")
def enc():
    return byte_bpe.encoder(*tokenizer_file())


def test_matches_library_on_documents(spark, enc):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op6_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = enc.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


@pytest.mark.parametrize("text", ["a b " * 500 + "x", "Don't, 12 ok.  \n\n zwei　drei \xa0\xa0 e" * 300, " \n\t" * 900 + "x y", "   " * 900])
def test_pieces_change_nothing(enc, monkeypatch, text):
    whole = enc.encode_ordinary(text)
    monkeypatch.setattr(byte_bpe, "_long_blank", byte_bpe.re.compile(f"[{byte_bpe._BLANK}]{{40,}}"))
    monkeypatch.setattr(byte_bpe.safe_pieces, "__defaults__", (50,))
    assert byte_bpe.encode_text(enc, text) == whole


def test_runs_that_the_library_cannot_match(enc):
    text = "a" + " " * 1_200_000 + "b"
    ids = byte_bpe.encode_text(enc, text)
    assert enc.decode_bytes(ids).decode() == text
    assert ids[-1] == enc.encode_ordinary(" b")[-1]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "é👍", None)], "doc_id long, text string, n_tokens string")
    out = byte_bpe.decode(byte_bpe.encode(df, *tokenizer_file()), *tokenizer_file()).collect()
    assert sorted((len(r.token_ids) > 0, bytes(r.decoded).decode()) for r in out) == [(False, "")] * 3 + [(True, "é👍")]
    assert byte_bpe.encode(df.limit(0), *tokenizer_file()).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(df.withColumnRenamed("n_tokens", "token_ids"), *tokenizer_file())
