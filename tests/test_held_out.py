"""Predictions of all vectors with the whole grid; the bootstrap with the operator's number of resamples."""

import inspect

from grainmill.operators import measure, vectors
from grainmill.plans import evaluation


def test_every_vector_is_predicted(spark, sf, monkeypatch):
    grids = []

    def tune(self, train, validation, grid=vectors.VectorClassifier.GRID, metric="macro_f1"):
        grids.append(tuple(grid))
        self.strength = 1.0
        assert train.join(validation, "vec_id").count() == 0

    monkeypatch.setattr(vectors.VectorClassifier, "tune", tune)
    told = [r["vec_id"] for r in evaluation.embedding_classifier(spark, sf).collect()]
    want = [r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()]
    assert sorted(told) == sorted(want) and grids == [vectors.VectorClassifier.GRID] * 5


def test_bootstrap_makes_the_default_number(spark, sf, monkeypatch):
    made, own = [], measure.bootstrap
    monkeypatch.setattr(measure, "bootstrap", lambda pairs, *a, **k: made.append(inspect.signature(own).bind(pairs, *a, **k)) or own(pairs, *a, **k))
    assert evaluation.arm_bootstrap(spark, sf).count() == 1
    made[0].apply_defaults()
    assert made[0].arguments["rounds"] == 4_000
