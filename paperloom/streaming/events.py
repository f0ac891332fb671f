"""Event streams: debounce, change gate, and normalisation with a dead-letter sink."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from paperloom import constants as C
from paperloom.operators.changes import content_hash
from paperloom.operators.ordered import with_neighbour
from paperloom.session import write_through
from paperloom.sources.buckets import BucketedTable
from paperloom.sources.deadletter import split_errors
from paperloom.sources.versioned import append_version
from paperloom.streaming.trigger import ONCE, triggered

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def debounce_stream(
    events: DataFrame, key: str, ts: str, payload: str, *, gap: str = C.DEBOUNCE_GAP,
    lateness: str = "1 minute",
) -> DataFrame:
    """Last payload of every burst, sent once the watermark has passed its silence: a later event must move it.

    Bursts are combined inside each task before the shuffle when
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is on.
    """
    bursts = events.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap).alias("w"))
    return bursts.agg(
        F.max_by(payload, ts).alias(payload), F.max(ts).alias("sent_at"), F.count("*").alias("n")
    ).select(key, F.col("w.start").alias("started_at"), "sent_at", payload, "n")


def _bursts(rows: pd.DataFrame, gap: float) -> pd.DataFrame:
    """(started, sent, payload, n) rows joined where less than ``gap`` lies between them; each may stand for many events."""
    rows = rows.sort_values(["started", "sent"], kind="stable")
    reached = rows["sent"].cummax().shift()
    burst = (rows["started"] >= reached + gap).cumsum()
    last = rows.groupby(burst)["sent"].transform("max") == rows["sent"]
    out = rows.groupby(burst).agg(started=("started", "min"), sent=("sent", "max"), n=("n", "sum"))
    out["payload"] = rows[last].groupby(burst[last])["payload"].last()
    return out[["started", "sent", "payload", "n"]]


class _Silence(StatefulProcessor):
    """Holds a key's open burst until ``gap`` passes without an event, by the clock or between events."""

    def __init__(self, key: str, ts: str, payload: str, gap_ms: int):
        self.key, self.ts, self.payload, self.gap_ms = key, ts, payload, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started long, sent long, payload string, n long")

    def _sent(self, key: tuple, bursts: pd.DataFrame) -> pd.DataFrame:
        at = lambda column: pd.to_datetime(column, unit="us", utc=True).dt.tz_localize(None)
        return pd.DataFrame({
            self.key: [key[0]] * len(bursts), "started_at": at(bursts["started"]), "sent_at": at(bursts["sent"]),
            self.payload: bursts["payload"].to_numpy(), "n": bursts["n"].astype("int64").to_numpy(),
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [pd.DataFrame([self.open.get()], columns=["started", "sent", "payload", "n"])] if self.open.exists() else []
        for frame in rows:
            when = frame[self.ts].to_numpy("datetime64[us]").astype("int64")
            events = pd.DataFrame({"started": when, "sent": when, "payload": frame[self.payload], "n": 1})
            # a row per burst is kept, not one per event
            held = [_bursts(pd.concat([*held, events]), 1000 * self.gap_ms)]
        bursts = held[0]
        if len(bursts) > 1:
            yield self._sent(key, bursts.iloc[:-1])
        started, sent, payload, n = bursts.iloc[-1]
        self.open.update((int(started), int(sent), payload, int(n)))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            last = pd.DataFrame([self.open.get()], columns=["started", "sent", "payload", "n"])
            self.open.clear()
            yield self._sent(key, last)

    def close(self) -> None:
        pass


def debounce_timers(events: DataFrame, key: str, ts: str, payload: str, *, gap_ms: int = C.DEBOUNCE_MS) -> DataFrame:
    """Last payload of every burst, sent once ``gap_ms`` has passed by the clock without another event of the key.

    A burst that ends a quiet stream is sent too, since a timer, not a later event, sends it. Open bursts and
    timers are state, so a restart loses neither; a timer that expired meanwhile fires at once. Events at least the gap
    apart by their own time are bursts of their own, also when they arrive together. An event without a time starts no burst
    and is dropped. Needs the RocksDB state store (``ROCKSDB``) and a trigger that keeps running.
    """
    rows = events.where(F.col(ts).isNotNull()).select(key, ts, F.col(payload).cast("string").alias(payload))
    out = StructType([rows.schema[key], *StructType.fromDDL("started_at timestamp, sent_at timestamp"), rows.schema[payload],
                      *StructType.fromDDL("n long")])
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Silence(key, ts, payload, gap_ms), outputStructType=out, outputMode="Append", timeMode="ProcessingTime")


def gate_batch(
    batch: DataFrame, last: BucketedTable, version: int, key: str, order: list[str], content: list[str], *, bucket: Column,
) -> DataFrame:
    """Rows of a batch that change the content last seen for their key, in it or before it; notes the last of each key.

    Rows are ordered by key, bucket and order as (key, order, hash) only, so a hot key fills many tasks and no payload is ordered;
    the rows that pass are then looked up. ``last(gate_key, content_hash)`` is read in the batch's own buckets.
    """
    spark = batch.sparkSession
    named = F.to_json(F.struct(F.col(key).alias("k")))  # a null key is a key
    rows = write_through(
        batch.withColumn("content_hash", content_hash(*content)).withColumn("gate_key", named)
        .withColumn("_row", F.monotonically_increasing_id()).withColumn("_b", bucket))
    narrow = rows.select("gate_key", *order, "_b", "content_hash", "_row")
    seen = with_neighbour(narrow, ["gate_key"], order, "content_hash", "_last", bucket=F.col("_b"))
    known = last.current(spark, version, last.buckets_of(rows)).select("gate_key", F.col("content_hash").alias("_known"))
    passed = seen.join(known, "gate_key", "left").where(
        ~F.coalesce("_last", "_known").eqNullSafe(F.col("content_hash"))).select("_row")
    ends = narrow.groupBy("gate_key").agg(F.max_by("content_hash", F.struct(*order)).alias("content_hash"))
    last.write(ends, version)
    return rows.join(passed, "_row", "left_semi").drop("_row", "_b", "gate_key")


def last_hashes(root: str, buckets: int = 64) -> BucketedTable:
    return BucketedTable(f"{root}/last", "gate_key string, content_hash string", ("gate_key",), "gate_key", buckets)


def change_gate_stream(
    events: DataFrame, key: str, order: list[str], content: list[str], out: str, root: str, checkpoint: str, *,
    bucket: Column | None = None, trigger: dict = ONCE, fold_every: int = 50, buckets: int = 64,
) -> StreamingQuery:
    """Rows that change the content last seen for their key (A, A, B, A -> 1, 3, 4), to the versioned table ``out``.

    The last hash of every key is a bucketed table under ``root``; a micro-batch is one distributed job, so a key with
    very many rows in it is ordered by ``bucket``, not gathered. A batch that runs again gives the same rows once.
    """
    last = last_hashes(root, buckets)

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % fold_every == 0:
            last.fold(batch.sparkSession, batch_id - 1)
        passed = gate_batch(batch, last, batch_id, key, order, content, bucket=F.lit(0) if bucket is None else bucket)
        append_version(passed, out, batch_id)

    query = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return triggered(query, trigger).start()


def split_stream(
    rows: DataFrame, step: Callable[[DataFrame], DataFrame], good: str, dead: str, checkpoint: str,
    trigger: dict = ONCE,
) -> StreamingQuery:
    """Run ``step`` per micro-batch; good rows and failures go to two versioned tables.

    A batch that is run again after a failure replaces its own two folders, so every
    row arrives once in exactly one of them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        done = step(batch).persist()
        passed, failed = split_errors(done)
        append_version(passed, good, batch_id)
        append_version(failed, dead, batch_id)
        done.unpersist()

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return triggered(query, trigger).start()


def table_sink(rows: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once."""
    query = rows.writeStream.format("parquet").option("path", path)
    return triggered(query.option("checkpointLocation", checkpoint), trigger).start()
