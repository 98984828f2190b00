"""Streaming queries over the driver's clicks and sales: each is stopped and started again from its checkpoint, reads what
has arrived in the meantime, and gives what a query over the whole table gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import Workspace
from ..streaming import limiter, stateful
from .tables import table

WINDOW, MOST, RUNS = 3_600_000, 5, 2


def _streamed(rows: DataFrame, arrived: str, ws: Workspace, make: Callable[[DataFrame], DataFrame], mode: str = "append", last: DataFrame | None = None, timers: bool = True) -> DataFrame:
    """What ``make`` gives over the rows, which come in as many parts as there are runs, by time of arrival; ``last`` rows
    come in a run of their own."""
    spark, source, out = ws.spark, ws.path("in"), ws.path("out")
    lo, hi, n = rows.agg(F.min(F.unix_micros(arrived)), F.max(F.unix_micros(arrived)), F.count("*")).first()
    part = F.least(F.floor((F.unix_micros(arrived) - (lo or 0)) * RUNS / ((hi or 0) - (lo or 0) + 1)), F.lit(RUNS - 1))
    part = F.coalesce(part, F.lit(RUNS - 1))  # rows without a time of arrival come last
    parts = [rows.where(part == k) for k in range(RUNS)] + ([last] if last is not None else [])
    schema: StructType = rows.schema
    with stateful.state_store(spark, n, timers):
        for rows_now in parts:
            rows_now.write.mode("append").parquet(source)
            stateful.available(make(spark.readStream.schema(schema).parquet(source)), out, ws.path("checkpoint"), mode)
    return spark.read.parquet(out)


def _clicks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clicks").select("click_id", "client_id", "kind", F.col("ts").cast("timestamp").alias("ts"), F.col("arrived_at").cast("timestamp").alias("arrived_at"))


def streamed_limits(spark: SparkSession, d: str) -> DataFrame:
    """Clicks by client, five an hour, as they arrive, up to three days late: allowed or not, decided by their own time."""
    clicks = _clicks(spark, d)
    # one row far ahead lets the watermark pass all others
    end = clicks.limit(1).select(F.lit(-1).cast("long").alias("click_id"), F.lit(-1).cast("long").alias("client_id"), F.lit(None).cast("string").alias("kind"), F.lit("2200-01-01").cast("timestamp").alias("ts"), F.lit(None).cast("timestamp").alias("arrived_at"))
    make = lambda s: stateful.limited(s, "client_id", "ts", "click_id", WINDOW, MOST, "120 days")
    told = _streamed(clicks, "arrived_at", Workspace(spark, "limits"), make, last=end)
    return told.select(F.col("place").alias("click_id"), "client_id", "ms", "allowed", "retry_after_sec")


def streamed_resume(spark: SparkSession, d: str) -> DataFrame:
    """Each sale once, at its first arrival, though deliveries repeat and the work is stopped in between."""
    sales = table(spark, d, "sales").select("sale_id", F.col("arrived_at").cast("timestamp").alias("arrived_at"))
    sales = sales.where("arrived_at is not null").withColumn("us", F.unix_micros("arrived_at"))
    told = _streamed(sales, "arrived_at", Workspace(spark, "resume"), lambda s: stateful.first_seen(s, "sale_id", "us"), timers=False)
    return told.select("sale_id", F.col("place").alias("first_us"))


def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Clicks by day and kind in update mode: the last figure of each window."""
    make = lambda s: limiter.counts_by_window(s, "ts", "kind", "1 day", "120 days").select(F.col("window.start").alias("start"), "kind", "n")
    told = _streamed(_clicks(spark, d), "arrived_at", Workspace(spark, "counts"), make, "update")
    return stateful.latest(told, ["start", "kind"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind", "n")


QUERIES = {f.__name__: f for f in (streamed_limits, streamed_resume, streamed_counts)}

ORACLE_SQL = {
    "streamed_limits": f"""WITH RECURSIVE e AS (SELECT click_id, client_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY client_id ORDER BY epoch_us(ts) // 1000, click_id) AS nth FROM clicks WHERE ts IS NOT NULL),
      r AS (SELECT *, [ms] AS kept, true AS allowed, 0 AS wait FROM e WHERE nth = 1 UNION ALL
        SELECT click_id, client_id, ms, nth, CASE WHEN len(live) >= {MOST} THEN live ELSE list_append(live, ms) END, len(live) < {MOST}, CASE WHEN len(live) >= {MOST} THEN greatest(1, CAST(ceil((live[1] + {WINDOW} - ms) / 1000.0) AS BIGINT)) ELSE 0 END
        FROM (SELECT e.*, list_filter(r.kept, lambda x: x > e.ms - {WINDOW}) AS live FROM r JOIN e ON e.client_id IS NOT DISTINCT FROM r.client_id AND e.nth = r.nth + 1))
      SELECT click_id, client_id, ms, allowed, CAST(wait AS INTEGER) AS retry_after_sec FROM r""",
    "streamed_resume": "SELECT sale_id, min(epoch_us(arrived_at)) AS first_us FROM sales WHERE sale_id IS NOT NULL AND arrived_at IS NOT NULL GROUP BY sale_id",
    "streamed_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, kind, count(*) AS n FROM clicks WHERE ts IS NOT NULL GROUP BY 1, 2",
}
