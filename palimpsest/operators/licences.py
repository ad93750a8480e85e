"""Licence files as rows: fields, expiry, features, device ids and sealed values."""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = "device_id string, signature string, expiry_date string, features string"


def fields(text: Column) -> Column:
    return F.from_json(text, FIELDS)


def in_date(expiry_date: Column, as_of: Column) -> Column:
    """Valid until midnight at the start of the day of expiry; a date that can't be read is not valid."""
    return F.coalesce(as_of <= F.try_to_timestamp(expiry_date, F.lit("yyyy-MM-dd")), F.lit(False))


def features(text: Column) -> Column:
    """Names in the ``features`` array of a JSON object (single quotes pass for double ones); anything else has none."""
    read = F.from_json(F.replace(F.coalesce(text, F.lit("[]")), F.lit("'"), F.lit('"')), "features array<string>")
    return F.array_distinct(F.coalesce(read["features"], F.expr("cast(array() as array<string>)")))


def device_id(public_key: Column) -> Column:
    return F.translate(F.base64(F.unhex(F.sha2(public_key.cast("binary"), 256))), "+/", "-_")


def encrypt(value: Column, key: Column) -> Column:
    """Base64 of IV, ciphertext and tag (AES-GCM, a random IV of 12 bytes)."""
    return F.base64(F.aes_encrypt(value.cast("binary"), key, F.lit("GCM")))


def decrypt(sealed: Column, key: Column) -> Column:
    """The value, or an empty string if it can't be opened."""
    return F.coalesce(F.try_aes_decrypt(F.unbase64(sealed), key, F.lit("GCM")).cast("string"), F.lit(""))


def signed_text(device_id_: Column, expiry_date: Column, features_: Column) -> Column:
    """What a licence's signature covers."""
    return F.concat_ws("|", device_id_, expiry_date, F.coalesce(features_, F.lit("")))


def file_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


# Fixed value: DER prefix of a SHA-256 digest in a PKCS #1 v1.5 signature.
SHA256_PREFIX = bytes.fromhex("3031300d060960864801650304020105000420")


def _der(data: bytes, at: int) -> tuple[int, int, int]:
    """(tag, start, end) of the value at ``at``."""
    tag, size, start = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        size, start = int.from_bytes(data[start : start + n], "big"), start + n
    return tag, start, start + size


def rsa_key(der: bytes) -> tuple[int, int]:
    """(modulus, exponent) of an X.509 public key."""
    _, at, _ = _der(der, 0)
    _, _, at = _der(der, at)  # the algorithm
    _, at, _ = _der(der, at)  # a bit string
    _, at, _ = _der(der, at + 1)
    _, start, end = _der(der, at)
    _, start2, end2 = _der(der, end)
    return int.from_bytes(der[start:end], "big"), int.from_bytes(der[start2:end2], "big")


def signature_valid(data: bytes, signature: bytes, key: tuple[int, int]) -> bool:
    modulus, exponent = key
    size = (modulus.bit_length() + 7) // 8
    if len(signature) != size:
        return False
    opened = pow(int.from_bytes(signature, "big"), exponent, modulus).to_bytes(size, "big")
    tail = b"\0" + SHA256_PREFIX + hashlib.sha256(data).digest()
    return opened == b"\0\1" + b"\xff" * (size - 2 - len(tail)) + tail


def verified(signed: Column, signature: Column, public_key: bytes) -> Column:
    """Whether the Base64 signature (RSA, SHA-256) covers the text; anything unreadable is not valid."""
    key = rsa_key(public_key)

    @F.pandas_udf(T.BooleanType())
    def check(texts: pd.Series, signatures: pd.Series) -> pd.Series:
        def one(text, sealed) -> bool:
            try:
                return signature_valid(text.encode(), base64.b64decode(sealed, validate=True), key)
            except (AttributeError, TypeError, ValueError):
                return False

        return pd.Series([one(t, s) for t, s in zip(texts, signatures, strict=True)], dtype=bool)

    return check(signed, signature)
