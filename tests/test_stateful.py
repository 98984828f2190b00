"""Stateful streams: restarts from a checkpoint, hits that arrive out of order, batches that run again, time to live."""

import random

from pyspark.sql import functions as F

from grainmill.streaming import limiter, stateful

START = 1_700_000_000_000


def run(spark, parts, folder, make, timers=True):
    source, out = str(folder / "in"), str(folder / "out")
    with stateful.state_store(spark, 100, timers):
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(source)
            stateful.available(make(spark.readStream.schema(part.schema).parquet(source)), out, str(folder / "checkpoint"))
    return spark.read.parquet(out)


def test_hits_out_of_order_are_decided_as_in_the_table(spark, tmp_path):
    rng = random.Random(1)
    hits = [(rng.choice([None, 1, 2, 3]), START + rng.randrange(20_000), i) for i in range(400)]
    df = spark.createDataFrame(hits, "key long, ms long, place long").withColumn("ts", F.timestamp_millis("ms"))
    # each run has hits of all ten seconds around its own
    parts = [df.where((F.col("ms") + F.pmod(F.xxhash64("place"), F.lit(5_000)) - START).between(lo, lo + 8_332)) for lo in (0, 8_333, 16_666)]
    end = spark.createDataFrame([(-1, START + 10**9, -1)], "key long, ms long, place long").withColumn("ts", F.timestamp_millis("ms"))
    told = run(spark, [*parts, end], tmp_path, lambda s: stateful.limited(s, "key", "ts", "place", 1_000, 3, "6 seconds"))
    got = sorted(((r["key"], r["ms"], r["place"], r["allowed"], r["retry_after_sec"]) for r in told.collect()), key=str)
    want = limiter.limit(df.select("key", "ms", "place", "ts"), "key", "ts", "place", 1_000, 3).collect()
    assert got == sorted(((r["key"], r["ms"], r["place"], r["allowed"], r["retry_after_sec"]) for r in want), key=str)
    assert 0 < sum(not r[3] for r in got) < 400


def test_first_seen_over_restarts(spark, tmp_path):
    make = lambda s: stateful.first_seen(s, "k", "place")
    frame = lambda rows: spark.createDataFrame(rows, "k string, place long")
    told = run(spark, [frame([("a", 5), ("a", 3), (None, 1), ("b", 9)]), frame([("a", 1), ("c", 7)])], tmp_path, make, timers=False)
    assert sorted((r["k"], r["place"]) for r in told.collect()) == [("a", 3), ("b", 9), ("c", 7)]


def test_marks_go_after_their_time_to_live(spark, tmp_path):
    frame = lambda place: spark.createDataFrame([("a", place)], "k string, place long")
    told = run(spark, [frame(1), frame(2)], tmp_path, lambda s: stateful.first_seen(s, "k", "place", ttl_ms=1), timers=False)
    assert sorted(r["place"] for r in told.collect()) == [1, 2]


def test_a_batch_that_runs_again_is_written_over_itself(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "k long")
    for checkpoint in ("one", "two"):  # a lost checkpoint: batch 0 runs again
        df.write.mode("overwrite").parquet(str(tmp_path / "in"))
        stateful.available(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / checkpoint))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 3, 2), ("b", 2, 1), ("a", 2, 1)], "k string, n long, batch int")
    assert sorted(map(tuple, stateful.latest(df, ["k"]).collect())) == [("a", 3), ("b", 2)]


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with stateful.state_store(spark, 1):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_partitions_of_state_follow_the_rows(spark):
    # a key costs Python most of a millisecond: 100,000 keys in one task took minutes
    with stateful.state_store(spark, 100_000):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    with stateful.state_store(spark, 1_000):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1"


def test_a_key_of_many_hits_is_handed_over_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "AT_ONCE", 7)
    hits = spark.createDataFrame([(1, START + i * 100, i) for i in range(50)], "key long, ms long, place long").withColumn("ts", F.timestamp_millis("ms"))
    end = spark.createDataFrame([(-1, START + 10**9, -1)], "key long, ms long, place long").withColumn("ts", F.timestamp_millis("ms"))
    told = run(spark, [hits, end], tmp_path, lambda s: stateful.limited(s, "key", "ts", "place", 1_000, 3, "6 seconds"))
    got = sorted((r["ms"], r["place"], r["allowed"]) for r in told.where("key = 1").collect())
    want = limiter.limit(hits, "key", "ts", "place", 1_000, 3).collect()
    assert got == sorted((r["ms"], r["place"], r["allowed"]) for r in want)
