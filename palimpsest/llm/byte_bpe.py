"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

encode(df) adds ``token_ids``, decode(df) adds ``decoded`` (bytes). Whole texts; a null or empty text has no ids
and decodes to no bytes. Extra columns are kept; a column that already bears the output name is an error.

The library's pattern matcher fails on white space runs of about a million characters, and holds a whole text's matches at
once, so long texts are cut first at safe boundaries: between an ASCII letter, digit or punctuation character and a
following space or newline. No match of the pattern spans such a place, and no match depends on what stands before
it. A run of white space too long for the matcher is matched here by the pattern's two last alternatives.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters of a piece that is given to the matcher; white space runs from this length on are matched here.
PIECE_CHARS = 1 << 16
LONG_BLANK = 1 << 15
ROWS = 256

_safe = re.compile(r"[0-9A-Za-z.,;:!?](?=[ \n])")
#: The characters of the pattern's \s (Unicode White_Space).
_BLANK = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_long_blank = re.compile(f"[{_BLANK}]{{{LONG_BLANK},}}")


@lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("rank_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        found = _safe.search(text, at + size)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def encode_text(enc, text: str) -> list[int]:
    ids: list[int] = []
    for piece in safe_pieces(text):
        at = 0
        for run in _long_blank.finditer(piece):
            # Before a further character \s+(?!\S) leaves one blank, which the next match takes.
            end = run.end() if run.end() == len(piece) else run.end() - 1
            ids += enc.encode_ordinary(piece[at : run.start()])
            ids += enc._encode_single_piece(piece[run.start() : end])
            at = end
        ids += enc.encode_ordinary(piece[at:])
    return ids


def _with(df: DataFrame, column: str, kind: T.DataType, arrow: pa.DataType, of: str, make) -> DataFrame:
    if column in df.columns:
        raise ValueError(f"the input already has a column {column!r}")
    at = df.columns.index(of)

    def run(batches):
        work = make()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                out = pa.array([work(x) for x in part.column(at).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, column])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, kind)]))


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", column: str = "token_ids") -> DataFrame:
    def make():
        enc = encoder(rank_file, pattern)
        return lambda x: encode_text(enc, x) if x else []

    return _with(df, column, T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32()), text, make)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids", column: str = "decoded") -> DataFrame:
    def make():
        enc = encoder(rank_file, pattern)
        return lambda x: enc.decode_bytes(x) if x else b""

    return _with(df, column, T.BinaryType(), pa.binary(), ids, make)
