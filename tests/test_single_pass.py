"""Queries over generations read them once, and what replaced joins and repeated passes tells the same."""

import json
import random

import pytest
from pyspark.sql import functions as F

from grainmill.operators import actions, measure, release, suites
from grainmill.plans import suites as plans


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_does_not_repeat_the_reading(spark, sf):
    """filters on what was read went below it, where generations were made and parsed for each of their uses."""
    plan = _plan(plans.action_rates(spark, sf))
    assert plan.count("parseJson") + plan.lower().count("parse_json(") <= 1 and plan.count("StructsToJsonEvaluator") <= 1, plan


def test_metrics_of_one_pass(spark, sf):
    """one scan of the lines, or only of what was written of the generations."""
    assert _plan(plans.one_topic_metrics(spark, sf)).count("l_orderkey") <= _plan(plans.many_topic_metrics(spark, sf)).count("l_orderkey")
    for query in (plans.faithful_means, plans.decode_grid, plans.success_criteria, plans.release_matrix):
        assert "l_orderkey" not in _plan(query(spark, sf)), query


def test_rate_without_a_filter(spark):
    topics = "array<struct<requested_action:string>>"
    df = spark.createDataFrame([("a", [("x",)]), ("a", [("",)]), ("a", None), ("b", None), ("c", [])], f"arm string, topics {topics}")
    assert sorted(map(tuple, actions.rate(df, "arm").collect())) == [("a", 2, 1, 0.5), ("c", 1, 0, 0.0)]
    assert [tuple(r) for r in actions.rate(df).collect()] == [(3, 1, 0.3333)] and [tuple(r) for r in actions.rate(df.where("false")).collect()] == [(0, 0, None)]


def test_one_topic_summary(spark):
    """Means and F1 from pairs of classes are those of the cases."""
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice(["water", "roads", "x"]), rng.choice(["water", "roads", "NO_TOPIC"]), rng.random() if rng.random() < 0.9 else None, rng.random() < 0.5) for _ in range(300)]
    cases = spark.createDataFrame(rows, "arm string, true_domain string, predicted_domain string, likeness double, flag boolean")
    want = {r["arm"]: r for r in cases.groupBy("arm").agg(F.count("*").alias("n"), F.avg("likeness").alias("l"), F.avg(F.col("flag").cast("double")).alias("f")).collect()}
    f1 = {r["arm"]: r["value"] for r in suites.macro_f1(cases, "true_domain", "predicted_domain", "arm").collect()}
    for r in suites.one_topic_summary(cases, "arm", digits=9, metrics=("likeness", "flag")).collect():
        w = want[r["arm"]]
        assert (r["n"], r["likeness"], r["flag"], r["domain_macro_f1"]) == (w["n"], pytest.approx(w["l"], abs=1e-8), pytest.approx(w["f"], abs=1e-8), pytest.approx(f1[r["arm"]], abs=1e-8))
    none, = suites.one_topic_summary(cases.where("false"), metrics=("flag",)).collect()
    assert (none["n"], none["flag"], none["domain_macro_f1"]) == (0, None, None)


def test_paired_columns(spark):
    """an arm's cases meet a reference's once for all columns; counts are those of a join for each column."""
    rng = random.Random(4)
    keys = [f"k{i}" for i in range(40)]
    rows = [(arm, i, *[rng.choice([None, 0.0, 1.0, 1.0]) if k != "k7" else None for k in keys]) for arm in "abc" for i in range(60) if rng.random() < 0.9]
    cases = spark.createDataFrame(rows, "arm string, id long, " + ", ".join(f"{k} double" for k in keys))
    long = release._long(cases, "arm", "id").select("arm", "id", "key", (F.col("value") != 0).alias("b"))
    pairs = long.join(long.where("arm in ('a', 'b')").select(F.col("arm").alias("reference"), "id", "key", F.col("b").alias("a")), ["id", "key"])
    tell = lambda df: sorted((r["key"], r["arm"], r["reference"], r["a_only"], r["b_only"], round(r["p"], 9)) for r in df.collect())
    assert tell(release.paired(cases, keys, ("a", "b"))) == tell(measure.mcnemar_by(pairs, "key", "arm", "reference"))
    with pytest.raises(ValueError):
        release.paired(cases, keys * 2, ("a",))


def test_written_texts_read_as_any(spark):
    """Texts as models write them take a path of their own: a blank before them sends the same text down the other."""
    topic = lambda **x: {"domain": "water", "issue": "x is y", "object": "", "requested_action": "", "attributes": {}} | x
    texts = [json.dumps({"topics": t}, ensure_ascii=False, separators=s) for s in ((",", ":"), (", ", ": ")) for t in (
        [], [topic()], [topic(attributes={"a": "b"}), topic(domain="nowhere")], [topic(issue=" ")], [topic(issue=" ")], [topic(object='a"b')], [topic(object="ключ {}[]")], [topic(attributes={"a": "b", "c": "d"})], [topic(attributes={"a": 1})],
        [topic(issue=None)], [topic()] * 3000)]
    texts += [texts[1].replace('"attributes":{}', '"attributes":{"a":"b","a":"c"}'), texts[1].replace('"object":""', '"object":"","object":"x"'), texts[1][:-1], texts[1].replace("x is", "x\tis")]
    df = spark.createDataFrame([(i, v, x) for i, t in enumerate(texts) for v, x in enumerate((t, " " + t))], "i int, v int, raw string")
    got = {(r["i"], r["v"]): (r["parsed"], r["topics"], r["schema_ok"]) for r in suites.read(df).collect()}
    assert all(got[i, 0] == got[i, 1] for i in range(len(texts)))
    assert got[1, 0][2] and len(got[10, 0][1]) == 3000 and not got[3, 0][2] and not got[4, 0][2] and df.where((F.col("v") == 0) & F.col("raw").rlike(suites._WRITTEN)).count() == 14
