"""Sliding-window rate limiting over a table; ``stateful`` has the same over a stream.

A hit is allowed when fewer than ``most`` allowed hits of its key lie less than a window before it; rejected hits are
not remembered, so they never lengthen a block, and a hit exactly one window old no longer counts. That takes state in
order: a count over a range of rows would count rejected hits, too.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_MS, MOST = 60_000, 10


def decide(times: Iterable[int], kept: deque, window_ms: int, most: int) -> list[tuple[bool, int]]:
    """(allowed, seconds to wait) of hits in order of time; ``kept`` holds the allowed times and is updated."""
    out = []
    for t in times:
        while kept and kept[0] <= t - window_ms:
            kept.popleft()
        if len(kept) >= most:
            out.append((False, max(1, -((t - kept[0] - window_ms) // 1000))))
        else:
            kept.append(t)
            out.append((True, 0))
    return out


def limit(hits: DataFrame, key: str, ts: str, order: str, window_ms: int = WINDOW_MS, most: int = MOST) -> DataFrame:
    """Adds allowed and retry_after_sec to a table of hits; ties in time go by ``order``.

    Streams each key's rows in order of time with ``most`` numbers of state, so a hot key costs time but no memory.
    """
    import pyarrow as pa

    schema = hits.schema.simpleString()
    out_type = schema.removeprefix("struct<").removesuffix(">")
    names = hits.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = object(), deque()
        for batch in batches:
            keys, times = batch.column(names.index(key)).to_pylist(), batch.column(len(names)).to_pylist()
            told = []
            for k, t in zip(keys, times):
                if k != now:
                    now, kept = k, deque()
                told += decide([t], kept, window_ms, most)
            columns = [*batch.columns[: len(names)], pa.array([a for a, _ in told], pa.bool_()), pa.array([r for _, r in told], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "allowed", "retry_after_sec"])

    ms = F.unix_millis(F.col(ts).cast("timestamp")).alias("__gm_ms")
    ordered = hits.select(*names, ms).repartition(key).sortWithinPartitions(key, "__gm_ms", order)
    return ordered.mapInArrow(run, f"{out_type}, allowed boolean, retry_after_sec int")


def counts_by_window(events: DataFrame, ts: str, label: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts per label with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), label).agg(F.count("*").alias("n"))


def append_new(batch: DataFrame, path: str, keys: list[str]) -> int:
    """For ``foreachBatch``: appends the rows whose keys the table at ``path`` lacks; says how many. Safe to repeat."""
    from pyspark.errors import AnalysisException

    try:
        done = batch.sparkSession.read.parquet(path).select(*keys)
        fresh = batch.join(done, keys, "left_anti")
    except AnalysisException:
        fresh = batch
    fresh = fresh.dropDuplicates(keys).persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(path)
    finally:
        fresh.unpersist()
    return n
