"""Stateful streams by ``transformWithState``: state in RocksDB, timers of event time, time to live, and repeatable sinks.

``limited`` decides hits as ``limiter.limit`` does over a table, whatever order they arrive in within the watermark: hits
wait in a list state until the watermark has passed them, a timer of event time wakes the key, and what is due is decided
in order of time. ``first_seen`` lets each key through once; its marks go after a time to live.

Keys are grouped as strings and rows go to Python one by one in batches of many keys: a frame for each key would cost more
than its state.

A query is run to the end of what its source has (``available``), so it may be stopped and started again: the checkpoint
has offsets and state, and a sink keyed by batch writes a batch that is run again over itself.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .limiter import MOST, WINDOW_MS, decide

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of the whole input that one partition of the state may hold, about: a key costs Python most of a millisecond.
ROWS = 10_000
#: Hits of a key that are handed to its state at once.
AT_ONCE = 10_000


@contextmanager
def state_store(spark: SparkSession, rows: int | None = None, timers: bool = True) -> Iterator[None]:
    """RocksDB as the state store, and as many partitions of state as ``rows`` ask for, but no more than the session has.
    A checkpoint keeps the number that it was begun with. Without ``timers`` no batch runs without data: a query of
    processing time that is run to the end of its source would go on waiting for its clock."""
    keys = ["spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions", "spark.sql.streaming.noDataMicroBatches.enabled"]
    before = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(keys[0], ROCKSDB)
    spark.conf.set(keys[2], str(timers).lower())
    if rows is not None:
        spark.conf.set(keys[1], str(max(1, min(int(before[keys[1]] or 200), -(-rows // ROWS)))))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Limiter(StatefulProcessor):
    """Rows ms, place (ties of ms); gives key, ms, place, allowed, retry_after_sec once the watermark has passed ms."""

    def __init__(self, key: str, window_ms: int, most: int) -> None:
        self.key, self.window_ms, self.most = key, window_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, place long")
        self.allowed = handle.getValueState("allowed", "times array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        first = None
        while came := [(row["ms"], row["place"]) for row in islice(rows, AT_ONCE)]:
            self.waiting.appendList(came)
            first = min([m for m, _ in came] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        hits = sorted((int(m), int(p)) for m, p in self.waiting.get())
        due, left = [h for h in hits if h[0] <= now], [h for h in hits if h[0] > now]
        kept = deque(self.allowed.get()[0] if self.allowed.exists() else [])
        told = decide([m for m, _ in due], kept, self.window_ms, self.most)
        self.waiting.put(left) if left else self.waiting.clear()
        # a key sleeps until its next hit is due, or until its last allowed one no longer counts
        if left:
            self.handle.registerTimer(left[0][0])
        if kept and kept[-1] + self.window_ms > now:
            self.allowed.update((list(kept),))
            if not left:
                self.handle.registerTimer(kept[-1] + self.window_ms)
        else:
            self.allowed.clear()
        for (ms, place), (allowed, wait) in zip(due, told):
            yield Row(**{self.key: key[0], "ms": ms, "place": place, "allowed": allowed, "retry_after_sec": wait})

    def close(self) -> None:
        pass


class FirstSeen(StatefulProcessor):
    """Rows key, place; gives a key's row of the smallest place of the first batch that has the key, and none after it."""

    def __init__(self, key: str, ttl_ms: int) -> None:
        self.key, self.ttl_ms = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "place long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        place = min(row["place"] for row in rows)
        if not self.seen.exists():
            self.seen.update((place,))
            yield Row(**{self.key: key[0], "place": place})

    def close(self) -> None:
        pass


def limited(hits: DataFrame, key: str, ts: str, place: str, window_ms: int = WINDOW_MS, most: int = MOST, late: str = "1 minute") -> DataFrame:
    """(key, ms, place, allowed, retry_after_sec) of a stream of hits, each once the watermark, ``late`` behind the newest
    hit, has passed it. Ties of ms go by ``place``, an integer. Hits without a time, or behind the watermark, are dropped."""
    kind = hits.schema[key].dataType.simpleString()
    own = hits.where(F.col(ts).isNotNull()).select(F.col(key).cast("string").alias(key), F.col(ts).cast("timestamp").alias("at"), F.col(place).cast("long").alias("place"))
    own = own.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    schema = f"{key} string, ms long, place long, allowed boolean, retry_after_sec int"
    told = own.groupBy(key).transformWithState(Limiter(key, window_ms, most), schema, "Append", "EventTime")
    return told.withColumn(key, F.col(key).cast(kind))


def first_seen(rows: DataFrame, key: str, place: str, ttl_ms: int = 30 * 86_400_000) -> DataFrame:
    """(key, place): each key's first row. A key that stays away for ``ttl_ms`` of the clock counts as new again."""
    kind = rows.schema[key].dataType.simpleString()
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), F.col(place).cast("long").alias("place"))
    told = own.groupBy(key).transformWithState(FirstSeen(key, ttl_ms), f"{key} string, place long", "Append", "ProcessingTime")
    return told.withColumn(key, F.col(key).cast(kind))


def available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that its source has now. Each batch is a folder of ``out`` (column ``batch``), written over
    if the batch is run again."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(out: DataFrame, keys: list[str]) -> DataFrame:
    """Of what an update-mode stream has put out, the last batch's row of each key."""
    names = [c for c in out.columns if c not in (*keys, "batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("r")).select(*keys, "r.*")
