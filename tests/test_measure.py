import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from grainmill.operators import measure


def cells(spark, pairs, kinds):
    df = spark.createDataFrame([(i, a, b, 0.5) for i, (a, b) in enumerate(pairs)], "ordinal long, true_kind string, predicted_kind string, confidence double")
    return df, measure.confusion(df, spark.createDataFrame([(k,) for k in kinds], "kind string"))


def test_zero_support_and_never_predicted(spark):
    _, m = cells(spark, [("a", "a"), ("a", "b"), ("b", "b")], "abc")
    assert m.count() == 9
    got = {r["kind"]: (r["precision"], r["recall"], r["f1"]) for r in measure.per_class(m).collect()}
    assert got["c"] == (0.0, 0.0, 0.0) and got["a"] == (1.0, 0.5, pytest.approx(2 / 3))
    assert measure.summary(m).first()["macro_f1"] == pytest.approx((2 / 3 + 2 / 3) / 3)
    assert measure.summary(m, present_only=True).first()["macro_f1"] == pytest.approx(2 / 3)


def test_unknown_label_fails(spark):
    with pytest.raises(PySparkException):
        cells(spark, [("a", "z")], "ab")[1].collect()


@pytest.mark.parametrize("a_only,b_only", [(0, 0), (5, 5), (1, 9), (0, 4), (40, 61), (300, 500)])
def test_mcnemar_is_the_binomial_test(spark, a_only, b_only):
    rows = [(True, False)] * a_only + [(False, True)] * b_only + [(True, True)] * 3 + [(None, True)]
    r = measure.mcnemar(spark.createDataFrame(rows, "a boolean, b boolean")).first()
    m, k = a_only + b_only, min(a_only, b_only)
    want = 1.0 if not m else min(1.0, 2 * sum(math.comb(m, i) for i in range(k + 1)) / 2**m)
    assert (r["n"], r["a_only"], r["b_only"]) == (m + 3, a_only, b_only) and r["p"] == pytest.approx(want, rel=1e-9)


def test_unequal_arms_fail(spark):
    a, b = spark.createDataFrame([(1, True), (2, True)], "id int, v boolean"), spark.createDataFrame([(1, True)], "id int, v boolean")
    with pytest.raises(PySparkException):
        measure.paired(a, b, "id", "v").collect()


def test_bootstrap_band(spark):
    df = spark.createDataFrame([(i, float(i % 2), float(i % 2) + 0.5 + (i % 5) / 10) for i in range(200)], "id long, a double, b double")
    r = measure.bootstrap(df, 500).first()
    assert r["supported"] and r["lo"] < r["delta"] < r["hi"] and r["delta"] == pytest.approx(0.7)
    assert measure.bootstrap(df, 500).first() == r


def test_verdicts(spark):
    rows = [("x", "g1", True, True), ("x", "g2", False, False), ("y", "g1", True, None), ("y", "g2", True, False), ("z", "g1", True, False)]
    got = {r["arm"]: r["verdict"] for r in measure.verdicts(spark.createDataFrame(rows, "arm string, gate string, blocking boolean, passed boolean")).collect()}
    assert got == {"x": "PASS", "y": "INCOMPLETE", "z": "FAIL"}


def test_upper_median(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    assert measure.upper_median(df.selectExpr("1 as k", "v"), "k", "v").first()["median"] == 3


def test_bootstrap_agrees_with_resamples_of_pairs(spark):
    import numpy as np

    rows = [(i, float(i % 3 == 0), (i * 37 % 101) / 100) for i in range(600)]
    df = spark.createDataFrame([*rows, (600, None, 1.0)], "id int, a double, b double")
    got = measure.bootstrap(df, 4_000).first()
    d = np.array([b - a for _, a, b in rows])
    means = np.sort(np.random.default_rng(1).choice(d, (4_000, len(d))).mean(axis=1))
    assert got["n"] == 601 and got["delta"] == pytest.approx(d.mean())
    assert got["lo"] == pytest.approx(means[100], abs=0.004) and got["hi"] == pytest.approx(means[3_900], abs=0.004)
    again = measure.bootstrap(df.repartition(7), 4_000).first()
    assert (again["lo"], again["hi"]) == (got["lo"], got["hi"])  # the mean's last digit may differ
    empty = measure.bootstrap(df.limit(0), 50).first()
    assert empty["n"] == 0 and empty["delta"] is None
