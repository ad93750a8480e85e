import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import settings as S
from palimpsest.functions import text as X
from palimpsest.operators import licences as K


def test_bounds_and_presets():
    for bad in ({"contrast": 0.05}, {"brightness": 300}, {"sharpen": 6}, {"confidence_threshold": 1.1}):
        with pytest.raises(ValueError):
            S.ScanSettings(**bad)
    assert not S.SCAN_PRESETS["SCREENSHOT"].has_filters and S.SCAN_PRESETS["DOCUMENT"].has_filters and S.ScanSettings().forced_binarize().binarize


def test_engines_and_steps(spark):
    df = spark.createDataFrame([("mlkit", "a  b", "TABLE"), ("x", "a  b", None), (None, "a  b", "GENERAL")], "name string, text string, kind string")
    assert [r.e for r in df.select(S.engine_of_name(F.col("name")).alias("e")).collect()] == ["mlkit", "hybrid", "hybrid"]

    class Spaces:
        name = "spaces"

        def applies(self, kind):
            return kind != "TABLE"

        def process(self, text):
            return X.fix_spaces(text)

    assert [r.t for r in df.select(S.run_steps(F.col("text"), F.col("kind"), [Spaces()]).alias("t")).collect()] == ["a  b", "a b", "a b"]


def test_preparation(spark):
    pixels = spark.range(25).selectExpr("1 as image_id", "cast(id % 5 as int) x", "cast(id div 5 as int) y", "cast(-16777216 + id * 65793 as int) argb")
    assert S.PREPARATIONS["SIGN"].apply(pixels).count() == S.PREPARATIONS["RECEIPT"].apply(pixels).count() == 25


def test_signature(spark):
    # A toy key of two primes; its DER form is put together by hand.
    p, q = 2**521 - 1, 2**607 - 1
    n, e = p * q, 65537
    d = pow(e, -1, (p - 1) * (q - 1))
    size = (n.bit_length() + 7) // 8

    def der(tag, body):
        length = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
        return bytes([tag]) + length + body

    number = lambda v: der(2, b"\0" + v.to_bytes((v.bit_length() + 7) // 8, "big"))
    key = der(0x30, der(0x30, bytes.fromhex("06092a864886f70d0101010500")) + der(3, b"\0" + der(0x30, number(n) + number(e))))
    tail = b"\0" + K.SHA256_PREFIX + hashlib.sha256(b"dev|2030-12-31|scan").digest()
    block = b"\0\1" + b"\xff" * (size - 2 - len(tail)) + tail
    seal = base64.b64encode(pow(int.from_bytes(block, "big"), d, n).to_bytes(size, "big")).decode()
    df = spark.createDataFrame([("dev", seal), ("other", seal), ("dev", "???"), ("dev", None)], "device string, seal string")
    signed = K.signed_text(F.col("device"), F.lit("2030-12-31"), F.lit("scan"))
    assert [r.v for r in df.select(K.verified(signed, F.col("seal"), key).alias("v")).collect()] == [True, False, False, False]
