"""Reading of generations: what it costs and what it tells."""

import pytest
from pyspark.sql import functions as F

from grainmill.functions.text import BLANK_CHARS, WS, strip
from grainmill.operators import actions, reconcile, suites

GOOD = '{"domain":"water","issue":"x is y","object":"","requested_action":"","attributes":{}}'


def told(spark, *raws):
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    return [(r.parsed, len(r.topics), r.schema_ok) for r in suites.read(df).orderBy("id").collect()]


@pytest.mark.parametrize("used", [["parsed", "topics", "schema_ok"], ["topics"], ["schema_ok"]])
def test_a_generation_is_parsed_once(spark, tmp_path, used):
    spark.createDataFrame([(GOOD,)], "raw string").write.parquet(str(tmp_path / "t"))
    df = suites.read(spark.read.parquet(str(tmp_path / "t"))).select(*used)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json(") + plan.count("parseJson") <= 1, plan


def test_whether_a_generation_parses_types_no_topic(spark, tmp_path):
    spark.createDataFrame([(GOOD,)], "raw string").write.parquet(str(tmp_path / "t"))
    df = suites.read(spark.read.parquet(str(tmp_path / "t")))
    plan = lambda *used: df.select(*used)._jdf.queryExecution().optimizedPlan().toString()
    assert "StringType" in plan("topics") and "requested_action" not in plan("parsed"), plan("parsed")


def test_topics_without_attributes_are_made_whole(spark):
    raws = ['{"topics":[' + t + "]}" for t in (GOOD + ',{"issue":"x"}', "5", "null", GOOD)] + ['{"topics":null}', '{"topics":5}', '{"topics":{}}']
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    got = [[t.attributes for t in r.topics] for r in suites.read(df).orderBy("id").collect()]
    assert got == [[{}, {}], [{}], [{}], [{}], [], [], []]


def test_contract(spark):
    wrap = lambda t: '{"topics":[' + t + "]}"
    bad = [GOOD.replace('"water"', '"nowhere"'), GOOD.replace('"object":"",', ""), GOOD.replace('"object":""', '"object":5'), GOOD.replace('"x is y"', '" \\u00a0"'), GOOD.replace("{}", "[]"), GOOD[:-1] + ',"more":1}', GOOD + ",null"]
    fine = [GOOD, GOOD.replace("{}", '{"a":"b"}'), GOOD.replace("{}", '{"ключ":{"a":1}}'), GOOD.replace('"object":""', '"object":null'), GOOD + "," + GOOD, ""]
    assert [x[::2] for x in told(spark, *map(wrap, fine))] == [(True, True)] * len(fine)
    assert [x[::2] for x in told(spark, *map(wrap, bad))] == [(True, False)] * len(bad)
    assert told(spark, "so: " + wrap(GOOD) + " end", wrap(GOOD)[:-1], "{}", "[1]", "", None, "}{") == [(True, 1, True), (False, 0, False), (True, 0, False), (False, 0, False), (False, 0, False), (False, 0, False), (False, 0, False)]


def test_strict_json_is_one_value(spark):
    raws = ["1", "1,2", '1,"#end-of-json#"', "", " ", "{} x", "null"]
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw string").select("id", reconcile.strict_json(F.col("raw")).cast("string").alias("v"), reconcile.strict_json(F.col("raw")).isNull().alias("n"))
    assert [r.n for r in df.orderBy("id").collect()] == [False, True, True, True, True, True, False]


def test_strip_takes_all_blanks(spark):
    assert len(BLANK_CHARS) == 29
    df = spark.createDataFrame([(c + "a b" + c * 2,) for c in BLANK_CHARS], "x string")
    assert {r[0] for r in df.select(strip(F.col("x"))).collect()} == {"a b"}
    assert df.where(F.regexp_replace("x", f"^[{WS}]+|[{WS}]+$", "") != strip(F.col("x"))).count() == 0


def test_copies(spark):
    df = spark.createDataFrame([("Please  Replace the RING!", ["x", "replace, the ring"]), ("replace the ring", ["ring"]), ("", None), (None, ["replace the ring"])], "text string, a array<string>")
    topics = F.transform("a", lambda a: F.struct(a.alias("requested_action")))
    assert [r[0] for r in df.select(actions.copied(topics, F.col("text"))).collect()] == [True, False, False, False]


def test_generations_shuffle_lines_once(spark, sf):
    """Cases and generations come from one grouping of the lines: no join of generations with their cases."""
    from grainmill.plans import suites as plans

    plan = plans.generations(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 0, plan


def test_likeness_of_texts(spark):
    from grainmill.operators import scoring

    df = spark.createDataFrame([(["a b  c", ""], ["a c", "x"]), (["a b"], [" a b "]), (["a b"], []), ([], []), (["", "q"], [None])], "e array<string>, g array<string>")
    topics = lambda c: F.transform(c, lambda x: F.struct(x.alias("issue")))
    got = [r[0] for r in df.select(scoring.best_issue_rouge(topics("e"), topics("g"))).collect()]
    assert got == pytest.approx([0.4, 1.0, 0.0, 1.0, 0.5])


def test_action_clause_does_not_repeat_its_search(spark):
    from grainmill.operators import labels

    df = spark.createDataFrame([("Прошу замінити двері.",)], "content string")
    plan = df.select(labels.action_clause(F.col("content")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("якомогашвидше") <= 4, plan.count("якомогашвидше")

def test_measured_values_are_made_once(spark, sf):
    """Gates list the arms and look values up: both read the few measured rows, not the generations behind them."""
    from grainmill.plans import suites as plans

    plan = plans.gate_table(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "generations" not in plan and "topics" not in plan, plan
