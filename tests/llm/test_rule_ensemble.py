import zlib

import numpy as np

from grainmill.llm import rule_ensemble
from tests.llm.conftest import MESSY

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark, ws):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    got = rule_ensemble.score(spark.read.parquet(f"{D}/documents.parquet"), labels, ws)
    rows = got.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 40 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) > 0.97


def test_columns_score_as_numpy(spark, documents, ws):
    stats = documents.select("doc_id", rule_ensemble.statistics(documents["text"]).alias("s")).select("doc_id", "s.*").toPandas()
    x = stats[list(rule_ensemble.FEATURES)].to_numpy(float)
    y = (x[:, 0] > np.median(x[:, 0])) ^ (x[:, 1] > np.quantile(x[:, 1], 0.8)) ^ (np.arange(len(x)) % 11 == 0)
    model = rule_ensemble.fit(x, y.astype(float))
    df = spark.createDataFrame(stats)
    got = df.select("doc_id", model.score(lambda c: df[c]).alias("p")).toPandas()
    assert model.rules and len(model.rules) < model.tried
    assert np.allclose(got["p"], model.predict(x), atol=1e-6)


def test_messy_labels(spark, messy, empty, ws):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (4, None, 1), (11, 7, 0)], "doc_id long, quality int, toxic int")
    got = rule_ensemble.score(messy, labels, ws)
    assert got.count() == len(MESSY) and got.where("score is null or held_out is null").count() == 0
    assert rule_ensemble.score(empty, labels, ws).count() == 0
    none = rule_ensemble.score(messy, labels.limit(0), ws).collect()
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {1}


def test_one_class_is_its_share():
    x = np.zeros((30, len(rule_ensemble.FEATURES)))
    assert rule_ensemble.fit(x, np.ones(30)).predict(x)[0] > 0.9


def test_keep_good_keeps_columns(spark, ws):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    kept = rule_ensemble.keep_good(docs, labels, ws)
    assert kept.columns == docs.columns
    scored = {r["doc_id"] for r in rule_ensemble.score(docs, labels, ws).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == scored
