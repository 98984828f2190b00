import hashlib
import math
from collections import defaultdict

import pytest

from grainmill.llm import mixing
from tests.llm.conftest import MESSY


def brute(items, weights=(5, 2, 1), most=3):
    size = lambda t: len([w for w in (t or "").encode().split() if w])
    by = defaultdict(list)
    for i, t, _, s in items:
        by[s].append((hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest(), -1 if i is None else i, size(t)))
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    sizes = {s: sum(x[2] for x in by[s]) for s in names}
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            break
        full |= over
    for s in names:
        target[s] = float(most * sizes[s]) if s in full else level * w[s]
    out = []
    for s in names:
        before, length = 0, math.floor(target[s] + 1e-9)
        for _, i, n in sorted(by[s]):
            out.append((None if i == -1 else i, n, sizes[s], round(target[s], 6), sum(max(0, min(length - before - e * sizes[s], n)) for e in range(most))))
            before += n
    return sorted(out, key=str)


def told(df):
    return sorted([(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect()], key=str)


def test_equals_brute_force(messy, ws):
    assert told(mixing.mix(messy, ws, rows_per_bucket=2).taken) == brute(MESSY)


def test_near_targets_on_documents(documents, ws, spark):
    from grainmill.storage import Workspace

    got = mixing.mix(documents, ws).taken
    rows = got.collect()
    assert told(got) == brute([(r["doc_id"], r["text"], None, r["source"]) for r in documents.collect()])
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    again = mixing.mix(documents, Workspace(spark, "again"), rows_per_bucket=5).taken
    assert told(again) == told(got)


def test_positions_follow_schedules(messy, ws):
    m = mixing.mix(messy, ws)
    rows = m.curriculum.collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows) and all(r["take"] > 0 for r in rows)
    assert all(0 <= r["position"] <= 1 for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["sid"]].append((r["epoch"], r["position"]))
    for seen in by.values():
        seen.sort()
        assert [p for _, p in seen][0] == 0


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_inverse_of_the_integral(spark, knots):
    from pyspark.sql import functions as F

    df = spark.range(0, 101).select((F.col("id") / 100).alias("u")).withColumn("t", mixing.inverse(knots, F.col("u")))
    for r in df.collect():
        area = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            x = min(max(r["t"] - t0, 0), t1 - t0)
            area += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        assert area / mixing.integral(knots) == pytest.approx(r["u"], abs=1e-9)


def test_empty(empty, ws):
    assert mixing.mix(empty, ws).taken.count() == 0


def test_apply_keeps_columns_and_words(messy, ws):
    out = mixing.apply_mix(messy, ws)
    assert out.columns == messy.columns
    words = sum(len(r["text"].encode().split()) for r in out.collect())
    assert words == sum(r[4] for r in brute(MESSY))


def test_mix_is_in_training_order(documents, spark, tmp_path):
    """Files in the order of their names hold the curriculum: copies by position, each cut to what is due."""
    from pyspark.sql import functions as F

    from grainmill.storage import Workspace

    wide = documents.union(documents.where("doc_id < 40")).union(documents.where("doc_id < 20")).withColumn("h", F.lit("x")).withColumn("position", F.lit(1))
    mixing.apply_mix(wide, Workspace(spark, "a"), words_per_file=3000).write.parquet(str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    files = back.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")).orderBy("file", "at").collect()
    assert len({r["file"] for r in files}) > 3
    plain = [f.name for f in wide.schema.fields]
    want = mixing.mix(wide, Workspace(spark, "b"), h=F.xxhash64(*plain)).curriculum.collect()
    got = [(r["doc_id"], r["source"], len(r["text"].encode().split())) for r in files]
    assert sorted(got, key=str) == sorted(((r["doc_id"], r["source"], r["take"]) for r in want), key=str)
    places = {}
    for r in want:
        places.setdefault((r["doc_id"], r["source"], r["take"]), []).append(r["position"])
    at = [places[x].pop(0) for x in got]
    assert at == sorted(at)


def test_equal_rows_share_one_hash(frame, ws):
    items = [(1, "a few words that are the same", "en", "a")] * 9000 + [(2, "others in a second source here", "en", "b")]
    got = told(mixing.mix(frame(items), ws).taken)
    assert len(got) == 9001 and got == brute(items)
