"""Removal of repeated word windows by a log-structured fingerprint index.

A fingerprint is the hash of the least word 5-gram of a window (its minimiser). Neighbouring windows mostly share
one, so a document has a fingerprint for about every sixteenth word, and equal windows have equal fingerprints
wherever they stand. A block is all words of the neighbouring windows that share the fingerprint.

Each batch adds an immutable run, whose files are each sorted by fingerprint: its postings (fingerprint, block hash, row, start, windows), and
a summary (fingerprint, times, least and greatest block hash). Summaries are merged by compaction once there are more
than ``fanout``. The batch's summary is joined with the earlier ones; only fingerprints seen twice or more in all can
belong to repeated windows, and only those that the batch has are looked at. Their postings, the batch's and the earlier
ones, are verified on whole windows: equal blocks have all windows equal; of blocks that differ, one holder each is
read again and its windows are hashed one by one (with the fingerprint, 128 bits) and counted. ``add`` returns what the
batch has made repeated: its own spans, and those of earlier rows that are hit now.

Parquet runs carry no partitioning that Spark knows, so a join of runs deals them out again by fingerprint. A
fingerprint or block with over a thousandth of all postings is joined apart, by broadcast: there are at most 1,000.

Cases: null and empty texts have no words. A text of fewer words than the window loses nothing. A row is known by its id
(null: none) and the hash of its text, so rows that repeat an id with another text are rows of their own, and rows
repeated as a whole repeat each other's windows. Degenerate texts (one word thousands of times) are fingerprinted at
every word, which is still linear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .store import Store, fresh, refuse

GRAM = 5
LOW = 24
ROW = ["id", "hash"]
PRINTS = "fp long, block long, id long, hash long, start int, n int"
#: A key with over 1 / HOT of all postings is joined by broadcast; there are at most HOT.
HOT = 1000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def piece_prints(words: vec.Words, window: int) -> tuple[np.ndarray, ...]:
    """(text, fingerprint, block, first window, windows) of each run of windows with one minimiser."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n = len(words) - window + 1
    if n <= 0:
        return none
    h, texts = words.hashes(), words.text_of
    starts = np.flatnonzero(texts[:n] == texts[window - 1 :])
    if not len(starts):
        return none
    grams = vec.windows(h, GRAM)
    low = np.uint64((1 << LOW) - 1)
    ranked = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    least = (sliding_least(ranked, window - GRAM + 1)[starts] & low).astype(np.int64)
    anchor = starts + ((least - starts) & ((1 << LOW) - 1))
    first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    size = np.diff(np.append(first, len(starts)))
    begin, text = starts[first], texts[starts[first]]
    blocks = vec.range_hashes(h, begin, size + window - 1)
    return text, grams[anchor[first]].view(np.int64), blocks.view(np.int64), begin - words.first[text], size


def rows_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, hash, text): a null id is one that no other row has with that text."""
    return docs.select(row_id(F.col(id)).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).cast("string").alias("text"))


def row_id(id: Column) -> Column:
    return F.coalesce(id.cast("long"), F.lit(-(1 << 63)))


def fingerprints(docs: DataFrame, window: int) -> DataFrame:
    """PRINTS of docs (id, hash, text)."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in vec.pieces(batch.column(2)):
                ids, hashes = (batch.column(k).slice(row, len(offsets) - 1).to_numpy() for k in (0, 1))
                which, *rest = piece_prints(vec.Words(data, offsets, vec.WHITE), window)
                fp, block, start, n = rest
                columns = [pa.array(fp), pa.array(block), pa.array(ids[which]), pa.array(hashes[which]), pa.array(start, pa.int32()), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["fp", "block", *ROW, "start", "n"])

    return docs.select(*ROW, "text").mapInArrow(vec.tidy(run), PRINTS)


def joined_by(many: DataFrame, few: DataFrame, on: list[str], total: int) -> DataFrame:
    """many joined with few, whose rows (one for each key) say in ``times`` how often many has the key, of total rows."""
    often = F.col("times") * HOT > total
    hot = F.broadcast(few.where(often))
    rest = many.join(F.broadcast(few.where(often).select(*on)), on, "left_anti").join(few.where(~often), on)
    return many.join(hot, on).unionByName(rest)


class FingerprintIndex:
    """Sorted immutable runs in the shared folder; ``add`` a batch to learn what it repeats."""

    def __init__(self, spark: SparkSession, window: int, fanout: int = 4):
        self.window, self.fanout = window, fanout
        self.store = Store(spark, "fingerprints", frugal=True)
        self.summaries: list[str] = []
        self.postings: list[str] = []
        self.batches: list[DataFrame] = []
        self.made = self.total = 0

    def _union(self, names: list[str]) -> DataFrame:
        out = self.store.spark.read.parquet(self.store.path(names[0]))
        for name in names[1:]:
            out = out.unionByName(self.store.spark.read.parquet(self.store.path(name)))
        return out

    @staticmethod
    def _merged(summaries: DataFrame) -> DataFrame:
        return summaries.groupBy("fp").agg(F.sum("times").alias("times"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def compact(self) -> None:
        """Merge the summaries into one."""
        if len(self.summaries) > 1:
            self.made += 1
            old, name = self.summaries, f"summary-{self.made}"
            self.store.write(self._merged(self._union(old)).sortWithinPartitions("fp"), name)
            self.summaries = [name]
            for gone in old:
                self.store.drop(gone)

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch (id, hash, text) and return spans (id, hash, start, to): words of windows that it has made repeated.

        The batch is read again, now and when later batches repeat it, so it should be a written table.
        """
        store, window, step = self.store, self.window, len(self.postings)
        run = store.write(fingerprints(docs, window).sortWithinPartitions("fp"), f"run-{step}")
        own = run.groupBy("fp").agg(F.count("*").alias("times"), F.min("block").alias("lo"), F.max("block").alias("hi"))
        own = store.write(own.sortWithinPartitions("fp"), f"own-{step}")
        self.total += run.count()

        all_ = own.select("fp", "times", "lo", "hi", F.lit(0).cast("long").alias("before"))
        if self.summaries:
            earlier = self._merged(self._union(self.summaries)).select("fp", F.col("times").alias("before"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"))
            before = F.coalesce("before", F.lit(0).cast("long"))
            all_ = own.join(earlier, "fp", "left").select("fp", (F.col("times") + before).alias("times"), F.least("lo", "lo_").alias("lo"), F.greatest("hi", "hi_").alias("hi"), before.alias("before"))
        again = all_.where("times > 1").select("fp", "times", "before", (F.col("lo") == F.col("hi")).alias("alike"))
        again = store.write(again, f"again-{step}")

        places = joined_by(run, again.drop("before"), ["fp"], self.total)
        if self.postings:
            hit = again.where("before > 0").drop("before")
            places = places.unionByName(joined_by(self._union(self.postings), hit, ["fp"], self.total))
        places = store.write(places.drop("times"), f"places-{step}")
        self.postings.append(f"run-{step}")
        self.summaries.append(f"own-{step}")
        self.batches.append(docs)

        mixed = places.where("not alike")
        blocks = mixed.groupBy("fp", "block").agg(F.count("*").alias("times"), F.min(F.struct(*ROW, "start", "n")).alias("holder"))
        blocks = store.write(blocks, f"blocks-{step}")
        to = F.col("start") + F.col("n") + F.lit(window - 1)
        twice = joined_by(mixed, blocks.where("times > 1").select("fp", "block", "times"), ["fp", "block"], self.total)
        sure = places.where("alike").select(*ROW, "start", to.alias("to")).unionByName(twice.select(*ROW, "start", to.alias("to")))

        asked = blocks.select("holder.*", "fp").groupBy(*[F.col(c).alias(f"asked_{c}") for c in ROW]).agg(F.collect_list(F.struct("fp", "start", "n")).alias("asked"))
        texts = self.batches[0]
        for more in self.batches[1:]:
            texts = texts.unionByName(more)
        found = self._window_hashes(texts.join(asked, (F.col("id") == F.col("asked_id")) & (F.col("hash") == F.col("asked_hash"))))
        found = store.write(found, f"windows-{step}")
        counted = found.groupBy("fp", "window").agg(F.count("*").alias("times")).where("times > 1")
        proven = joined_by(found, store.write(counted, f"proven-{step}"), ["fp", "window"], max(1, found.count()))
        spans = store.write(sure.unionByName(proven.select(*ROW, "start", (F.col("start") + window).alias("to"))), f"spans-{step}")
        for name in ("again", "places", "blocks", "windows", "proven"):
            store.drop(f"{name}-{step}")
        if len(self.summaries) > self.fanout:
            self.compact()
        return spans

    def _window_hashes(self, docs: DataFrame) -> DataFrame:
        """(fp, window, id, hash, start): each window of the asked runs of windows."""
        window = self.window

        def run(batches):
            for batch in batches:
                id_, hash_, texts, asked = batch.columns
                for row, data, offsets in vec.pieces(texts):
                    words = vec.Words(data, offsets, vec.WHITE)
                    part = asked.slice(row, len(offsets) - 1)
                    flat = part.flatten()
                    fp, start, n = (flat.field(k).to_numpy() for k in ("fp", "start", "n"))
                    which = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
                    one = np.repeat(np.arange(len(n)), n)
                    first = start[one].astype(np.int64) + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
                    hashes = vec.range_hashes(words.hashes(), words.first[which[one]] + first, np.full(len(first), window))
                    own = [c.slice(row, len(part)).to_numpy()[which[one]] for c in (id_, hash_)]
                    yield pa.RecordBatch.from_arrays([pa.array(fp[one]), pa.array(hashes.view(np.int64)), *map(pa.array, own), pa.array(first, pa.int32())], ["fp", "window", *ROW, "start"])

        return docs.select(*ROW, "text", "asked").mapInArrow(vec.tidy(run), "fp long, window long, id long, hash long, start int")


def without_repeats(docs: DataFrame, spans: DataFrame, id: str, text: str, column: str) -> DataFrame:
    """docs with ``column``: struct(n_words, n_removed, kept): the words outside the spans, joined by one space."""
    by_row = spans.groupBy(*ROW).agg(F.collect_set(F.struct("start", "to")).alias("spans"))
    own_id, own_hash, span_id, span_hash, found = fresh(docs, "own_id", "own_hash", "span_id", "span_hash", "spans")
    by_row = by_row.select(F.col("id").alias(span_id), F.col("hash").alias(span_hash), F.col("spans").alias(found))
    left = docs.withColumns({own_id: row_id(F.col(id)), own_hash: F.xxhash64(F.col(text))})
    joined = left.join(by_row, (F.col(own_id) == F.col(span_id)) & (F.col(own_hash) == F.col(span_hash)), "left").drop(own_id, own_hash, span_id, span_hash)
    at, spans_at = joined.columns.index(text), joined.columns.index(found)
    fields = [f for f in joined.schema.fields if f.name != found]
    keep = [joined.columns.index(f.name) for f in fields]
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def cut(body: str | None, span_list: pa.Scalar) -> dict:
        words = (body or "").encode().split()
        total, removed = len(words), 0
        if span_list.is_valid:
            start, to = (span_list.values.field(k).to_numpy() for k in ("start", "to"))
            depth = np.zeros(total + 1, np.int64)
            np.add.at(depth, np.minimum(start, total), 1)
            np.add.at(depth, np.minimum(to, total), -1)
            free = np.cumsum(depth[:-1]) == 0
            words = [words[i] for i in np.flatnonzero(free)]
            removed = total - len(words)
        return {"n_words": total, "n_removed": removed, "kept": b" ".join(words).decode()}

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts, found = part.column(at).to_pylist(), part.column(spans_at)
                out = pa.array([cut(t, found[k]) for k, t in enumerate(texts)], pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), out], [*(f.name for f in fields), column])

    return joined.mapInArrow(vec.tidy(run), T.StructType([*fields, T.StructField(column, kind)]))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 35, batches: int = 2, column: str = "dedup") -> DataFrame:
    """Add docs to an index batch by batch, then take out every word of a span that an add has returned."""
    refuse(docs, column)
    rows = rows_of(docs, id, text)
    index = FingerprintIndex(docs.sparkSession, window)
    spans = None
    for k in range(batches):
        found = index.add(rows.where(F.pmod(F.xxhash64(*ROW), F.lit(batches)) == k))
        spans = found if spans is None else spans.unionByName(found)
    index.store.close(*[f"spans-{k}" for k in range(batches)])  # this index was for one table
    return without_repeats(docs, spans, id, text, column)
