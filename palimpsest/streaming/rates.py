"""Throttle, time-window dedup, debounce and batch dedup, on event time.

The greedy rules depend on the last *accepted* event of a key, so they are folds. In batch, events are spread and
sorted by key and time and folded as they stream by: a task holds one number for the key at hand, however many events
it has. In streams, the same fold keeps that number as the key's state, which times out. A debounce depends on gaps alone,
so on a stream it is a session window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROS, GAP = "_micros", "_gap"


def _accepts(last: int | None, now: int, gap: int, strict: bool) -> bool:
    return last is None or (now - last > gap if strict else now - last >= gap)


def _fold(events: DataFrame, key: str, ts: str, ordinal: str, gap_us: int | Column, strict: bool) -> DataFrame:
    """Accept what comes the gap of the last accepted event after it, or later; a null gap is none."""
    gap = gap_us if isinstance(gap_us, Column) else F.lit(gap_us)
    ready = events.withColumns({MICROS: F.unix_micros(F.col(ts).cast("timestamp")), GAP: F.coalesce(gap.cast("long"), F.lit(0).cast("long"))})
    ready = ready.repartition(F.col(key)).sortWithinPartitions(key, MICROS, ordinal)
    at, when, wait = (ready.columns.index(c) for c in (key, MICROS, GAP))

    def run(batches):
        held, last, gap = None, None, 0
        for batch in batches:
            keep = []
            for k, now, own in zip(*(batch.column(c).to_pylist() for c in (at, when, wait)), strict=True):
                if last is None or k != held:
                    held, last = k, None
                fine = now is not None and _accepts(last, now, gap, strict)
                if fine:
                    last, gap = now, own
                keep.append(fine)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ready.mapInArrow(run, ready.schema).drop(MICROS, GAP)


def throttle(events: DataFrame, key: str, ts: str, ordinal: str, gap_us: int = 250_000) -> DataFrame:
    """Accept an event if at least the gap has passed since the last accepted one; equality is enough."""
    return _fold(events, key, ts, ordinal, gap_us, strict=False)


def dedup_window(events: DataFrame, key: str, ts: str, ordinal: str, window_us: int = 2_000_000) -> DataFrame:
    """Emit a key again only if more than the window has passed since it was last emitted; equality is not enough."""
    return _fold(events, key, ts, ordinal, window_us, strict=True)


def busy_gate(events: DataFrame, key: str, ts: str, ordinal: str, busy_us: Column, paused: Column | None = None) -> DataFrame:
    """Drop what comes while the last accepted event is still in process (for ``busy_us`` from its time), or while paused."""
    if paused is not None:
        events = events.where(~F.coalesce(paused, F.lit(False)))
    return _fold(events, key, ts, ordinal, busy_us, strict=False)


def debounce(events: DataFrame, key: str, ts: str, ordinal: str, quiet_us: int = 350_000) -> DataFrame:
    """The last event of each burst: what is followed by at least that much silence, or by nothing."""
    following = F.lead(F.unix_micros(F.col(ts).cast("timestamp"))).over(W.partitionBy(key).orderBy(ts, ordinal))
    quiet = following.isNull() | (following - F.unix_micros(F.col(ts).cast("timestamp")) >= quiet_us)
    return events.withColumn("_quiet", quiet).where("_quiet").drop("_quiet")


def stream_debounce(events: DataFrame, key: str, ts: str, quiet_us: int = 350_000) -> DataFrame:
    """debounce on a stream with a watermark on ``ts``: the last event of each session of a key, once the watermark has passed
    the silence after it. Late events still count within the watermark's delay. Of events at the same time any is the last."""
    columns = events.columns
    # Sessions that touch are one, and silence of just quiet_us parts two.
    session = F.session_window(F.col(ts), f"{quiet_us - 1} microseconds")
    last = events.groupBy(session.alias("_session"), F.col(key)).agg(F.max_by(F.struct(*[F.col(c) for c in columns]), F.col(ts)).alias("_last"))
    return last.select("_last.*")


def batch_dedup(batch: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """What of a batch is new against everything accepted before; repeats inside the batch stay."""
    return batch.join(accepted.select(key).distinct(), key, "left_anti").select(*batch.columns)


def scan_mode(batch: DataFrame, accepted: DataFrame, mode: str, key: str, ordinal: str) -> DataFrame:
    """What is shown after a batch: SINGLE its first row, CONTINUOUS the batch, BATCH everything so far and what is new."""
    if mode == "SINGLE":
        return batch.orderBy(ordinal).limit(1)
    return batch if mode == "CONTINUOUS" else accepted.unionByName(batch_dedup(batch, accepted, key))


def stream_fold(events: DataFrame, key: str, ts: str, gap_us: int, strict: bool, keep_s: int = 60) -> DataFrame:
    """The fold on a stream with a watermark on ``ts``: each micro-batch's events of a key in time order, with the time of the last
    accepted one as state. State goes once the watermark is ``keep_s`` past it. Late events are dropped by the watermark."""
    schema = events.schema

    def step(_key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(ts, kind="stable")
        keep = []
        for now in rows[ts].astype("datetime64[us]").astype("int64"):
            fine = _accepts(last, int(now), gap_us, strict)
            if fine:
                last = int(now)
            keep.append(fine)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + gap_us // 1000 + keep_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    return events.groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def accumulate(stream: DataFrame, table: str, key: str, checkpoint: str):
    """BATCH mode as a sink: each micro-batch adds to the Parquet table at ``table`` what it has not yet. The batch's own
    folder is written again if the batch is, so a retry adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            before = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(table)
            before = before.where(~F.input_file_name().contains(f"/batch={number}/"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            before = batch.limit(0)
        batch_dedup(batch, before, key).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
