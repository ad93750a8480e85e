"""Placement by a permutation-filled lookup table (consistent hashing with constant-time lookup).

Each shard has a permutation of the slots of a prime-sized table, offset + k * skip modulo its size. The shards take
turns, each claiming the next slot of its permutation that is still free, until the table is full: shares differ by one slot at
most, and when a shard joins or leaves few slots change hands. A row's slot is a hash of its key modulo the size, and
the table (``slots`` rows, a parameter, so of a known size) is broadcast.

Cases: a null key is replaced by a hash of the row's text, so that such rows spread too. Equal keys go to one shard.
An empty table gives an empty result. Input columns are kept, and ``slot`` and ``shard`` may not be among them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SLOTS = 1_000_003
HEX = 15


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX], 16)


def filled_table(shards: list[str], slots: int) -> list[int]:
    """Index of the shard that holds each slot."""
    if not shards or len(set(shards)) != len(shards) or not len(shards) <= slots <= MAX_SLOTS or not _prime(slots):
        raise ValueError(f"shards must be distinct and slots a prime from their number to {MAX_SLOTS}")
    place = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    held = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while held[place[i]] >= 0:
            place[i] = (place[i] + skip[i]) % slots
        held[place[i]] = i
    return held


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard), one row for each slot; built from literals, without Python workers."""
    held = [shards[i] for i in filled_table(shards, slots)]
    return spark.range(1).select(F.posexplode(F.split(F.lit(",".join(held)), ",")).alias("slot", "shard"))


def slot_of(key: Column, slots: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, HEX), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: list[str], slots: int = 65537, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ``slot`` and ``shard``."""
    if any("," in s for s in shards):
        raise ValueError("a shard's name may not hold a comma")
    if clash := {"slot", "shard"} & set(docs.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    of = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    return docs.withColumn("slot", slot_of(of, slots)).join(F.broadcast(lookup_table(docs.sparkSession, shards, slots)), "slot").select(*docs.columns, "slot", "shard")
