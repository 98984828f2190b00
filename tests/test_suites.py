"""Suites, decoding matrices, annotation files, streams, the suite builder, selection: against small brute-force versions."""

import json
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.functions import patterns
from grainmill.operators import annotation, audit, augment, baseline, builder, curate, decoding, labels, release, sample, scoring, streams, suites
from grainmill.plans import suite_cases
from grainmill.storage import Workspace

T = "struct<domain:string,issue:string,object:string,requested_action:string,attributes:map<string,string>>"


def topic(domain="water", issue="x", obj="", act="", **attributes):
    return {"domain": domain, "issue": issue, "object": obj, "requested_action": act, "attributes": attributes}


def test_read_generations(spark):
    good = {"topics": [topic(a="1"), topic("roads", "y")]}
    raws = {
        "plain": (json.dumps(good), True, 2, True), "wrapped": ("Here: " + json.dumps(good) + " ok", True, 2, True), "cut": (json.dumps(good)[:-1], False, 0, False), "none": ("nothing", False, 0, False),
        "empty": ('{"topics":[]}', True, 0, True), "no topics": ('{"a":1}', True, 0, False), "list": ("[1]", False, 0, False), "domain": (json.dumps({"topics": [topic("nowhere")]}), True, 1, False),
        "extra": ('{"topics":[{"domain":"water"}]}', True, 1, False), "null": (None, False, 0, False),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in raws.items()], "id string, raw string")
    got = {r["id"]: (r["parsed"], len(r["topics"]), r["schema_ok"]) for r in suites.read(df).collect()}
    assert got == {k: v[1:] for k, v in raws.items()}


def test_fields_flags_and_chats(spark):
    rows = [("a", '"t"'), ("b", '{"x":"1","y":2}'), ("c", "null"), ("d", None), ("e", "true")]
    df = spark.createDataFrame(rows, "k string, j string").withColumn("v", F.parse_json("j"))
    assert {r["k"]: r["t"] for r in df.select("k", suites.field_text(F.col("v")).alias("t")).collect()} == {"a": "t", "b": "1 2", "c": "", "d": "", "e": "true"}
    assert [r["f"] for r in df.where("k in ('c','d','e')").orderBy("k").select(suites.flag(F.col("v")).alias("f")).collect()] == [None, None, True]
    with pytest.raises(Exception, match="not a flag"):
        df.where("k = 'a'").select(suites.flag(F.col("v"))).collect()
    chat = spark.createDataFrame([("u", [("system", "s"), ("user", " hi "), ("assistant", json.dumps({"topics": [topic()]}))])], "uid string, messages array<struct<role:string,content:string>>")
    r, = suites.targets_of_chats(chat).collect()
    assert (r["uid"], r["text"], len(r["expected"]), r["expected"][0]["domain"]) == ("u", "hi", 1, "water")


def test_smoke(spark):
    c = spark.createDataFrame([(1, "Multi-Topic", ["water", "light"]), (2, "Other", ["roads"])], "id int, category string, expected_domains array<string>")
    r = spark.createDataFrame([(1, [topic("water"), topic("electricity")], True), (2, [topic("roads"), topic("water", "")], True)], f"id int, topics array<{T}>, schema_ok boolean")
    got = {x["id"]: x for x in suites.smoke(c, r, F.create_map(F.lit("light"), F.array(F.lit("electricity")))).collect()}
    assert got[1]["passed"] and not got[2]["passed"] and got[2]["extra"] == ["water"] and got[1]["uncovered"] == []


def test_decoding_parts(spark):
    loop = " ".join(["one two three four five six"] * 12)
    rows = spark.createDataFrame([("m", "a", 1, loop, "JSONFAIL", ["control"]), ("m", "b", 1, "fine", "SPLIT", ["control"]), ("m", "a", 2, "fine", "SPLIT", ["control", "x"]), ("m", "b", 2, "fine", "SPLIT", None)], "model string, setting string, id int, raw string, behaviour string, tags array<string>")
    cells = decoding.loops(rows)
    assert {(r["setting"], r["loops"]) for r in cells.collect()} == {("a", 1), ("b", 0)}
    assert [(r["off"], r["on"]) for r in decoding.isolated(cells, {"k": ("b", "a")}).collect()] == [(0, 1)]
    assert {r["id"]: r["invariant"] for r in decoding.controls(rows).collect()} == {1: False, 2: True}
    base = spark.createDataFrame([("m", 1, False, True, 1, 0), ("m", 2, True, True, 2, 2), ("m", 3, True, False, 2, 1), ("m", 4, True, True, 1, 2)], "model string, id int, json_ok boolean, schema_ok boolean, expected_topic_count int, predicted_topic_count int")
    told = decoding.baseline_behaviour(base, spark.createDataFrame([("m", 3, "MERGE")], "model string, id int, behaviour string")).collect()
    assert {r["id"]: (r["behaviour"], r["recorded"]) for r in told} == {1: ("JSONFAIL", False), 2: ("SPLIT", False), 3: ("MERGE", True), 4: ("OVER", False)}
    got = decoding.with_fallback(base.select("model", "id"), spark.createDataFrame([("m", 1, "v")], "model string, id int, x string"), ["model", "id"], "x", F.lit("d")).orderBy("id").collect()
    assert [(r["x"], r["source"]) for r in got] == [("v", "recorded")] + [("d", "derived")] * 3


def test_annotation_files(spark):
    expected = spark.createDataFrame([(b, f"{b}-{i}", f"text {i}") for b in ("b1", "b2", "b3") for i in range(2)], "batch_id string, id string, text string")
    item = lambda i, **more: {"id": i, "annotation": {"topics": [topic()]}} | more
    files = [("b1", json.dumps({"batch_id": "b1", "annotations": [item("b1-0"), item("b1-1", text="text 1")]})), ("b2", json.dumps([item("b2-0"), item("b2-0"), {"id": 5}, "x", item("b2-1", text="other", annotation={"topics": [{"domain": "water"}], "more": 1})])), ("b9", "[]")]
    got = sorted((r["batch_id"] or "", r["category"], r["id"] or "", r["path"] or "") for r in annotation.errors(spark.createDataFrame(files, "batch_id string, raw string"), expected).collect())
    kinds = sorted((b, c) for b, c, *_ in got)
    assert kinds == sorted([("", "incomplete"), ("b2", "changed_text"), ("b2", "duplicate_id"), ("b2", "format"), ("b2", "missing_id"), ("b2", "schema"), ("b2", "schema"), ("b2", "schema"), ("b3", "missing_batch"), ("b9", "unknown_batch")])
    assert ("b2", "missing_id", "", "[2]") in got and ("b2", "format", "", "[3]") in got
    assert annotation.merged(expected, spark.createDataFrame(files, "batch_id string, raw string")).count() == 5
    all_good = [(b, json.dumps([item(f"{b}-0"), item(f"{b}-1")])) for b in ("b1", "b2", "b3")]
    assert annotation.errors(spark.createDataFrame(all_good, "batch_id string, raw string"), expected).count() == 0


def test_case_checks(spark):
    rows = [(1, json.dumps({"topics": [topic(act="do")]}), 1, ["water"], False), (2, "```" + json.dumps({"topics": []}), 1, ["water"], True), (3, json.dumps({"topics": [topic(), topic("roads")]}), 2, ["roads", "water"], True)]
    got = {r["id"]: (r["fatal"], r["notes"]) for r in annotation.case_checks(spark.createDataFrame(rows, "id int, raw string, n_topics int, domains array<string>, wants_action boolean")).collect()}
    assert got[1] == (["topic 0: invented action"], [])
    assert "markdown fence" in got[2][0] and got[3] == ([], ["domains", "equal issues", "no action"])


KINDS = list(patterns.KIND_TO_DOMAIN)


def complaints(n=120):
    rng = random.Random(6)
    things = ["не працює ліфт у під'їзді", "на дорозі глибокі ями після дощу", "немає гарячої води третій тиждень", "не вивозять сміття з контейнера", "холодні батареї в квартирі"]
    out = []
    for i in range(n):
        kind = KINDS[i % 5]
        text = f"По вул. {rng.choice(['Шевченка', 'Київська', 'Садова'])} {rng.choice(things)}, номер справи {i}. Прошу відновити роботу {i} якнайшвидше. Заявник надає згоду на обробку персональних даних."
        out.append((i, f"u{i}", kind, text, "validation" if i % 2 else "test"))
    return out


def test_streams(spark):
    df = spark.createDataFrame(complaints(), "row_id int, uid string, kind string, content string, split string")
    ws = Workspace(spark, "streams")
    frozen = df.where("row_id % 10 = 0")
    pool = streams.pooled(df, frozen, ws)
    assert pool.join(frozen.select("uid"), "uid").count() == 0
    for style in ("registry", "joined", "note"):
        got = streams.paired(pool, frozen, 6, style, Workspace(spark, style)).collect()
        again = streams.paired(pool, frozen, 6, style, Workspace(spark, style)).collect()
        assert 0 < len(got) <= 6 and got == again
        for r in got:
            assert len(r["topics"]) == 2 and r["domains"][0] != r["domains"][1] and r["a_uid"] < r["b_uid"] and "{" not in r["text"]
    real = spark.createDataFrame([("MT-REAL-1", "a text", [topic(), topic("roads")])], f"uid string, text string, topics array<{T}>")
    made = streams.multitopic_set(df, frozen, real, {"registry": 6, "joined": 6}, Workspace(spark, "set"))
    assert made.where("leaks").count() == 0 and made.where("held and not synthetic").count() == 1 and made.where("held").count() == 8


def test_relabelled_and_terse(spark):
    text = "Не працює ліфт. Прошу відремонтувати ліфт. Заявник надає згоду на обробку персональних даних."
    rows = [("s", text, [topic(issue=text)]), ("m", "a b", [topic(issue="Ями на дорозі. Прошу усунути ями."), topic(issue="Ліфт стоїть")]), ("n", "x", [])]
    got = {r["uid"]: r for r in streams.relabelled(spark.createDataFrame(rows, f"uid string, text string, topics array<{T}>"), F.size("topics") > 1).collect()}
    assert [t["requested_action"] for t in got["s"]["topics"]] == ["відремонтувати ліфт"] and "згоду" not in got["s"]["topics"][0]["issue"] and got["s"]["changed_issues"] == 1
    assert [t["issue"] for t in got["m"]["topics"]][1] == "Ліфт стоїть" and got["m"]["empty_actions"] == 1 and got["n"]["topics"] == []
    pool = spark.createDataFrame([(0, "k", "Не працює ліфт у будинку на вулиці вже тиждень"), (1, "k", "коротко")], "row_id int, kind string, content string")
    short = streams.terse_pool(pool, F.col("content"))
    assert [r["row_id"] for r in short.collect()] == [0]
    r, = streams.terse_examples(short, "row_id").collect()
    assert r["uid"] == "V3-TERSE-00000" and r["topics"][0]["domain"] == "other"


def test_same_object_stream_is_checked(spark):
    schema = f"uid string, text string, topics array<{T}>"
    base = streams.corpus(*[spark.createDataFrame([(u, "t", [topic()])], schema) for u in "abc"])
    with pytest.raises(Exception, match="not two topics"):
        streams.with_same_object(base, spark.createDataFrame([("z", "t", [topic()])], schema)).collect()
    with pytest.raises(Exception, match="in both"):
        streams.with_same_object(base, spark.createDataFrame([("a", "t", [topic(), topic()])], schema)).collect()
    same = audit.records_fingerprint(base, ("uid", "text")).first()["fingerprint"]
    assert streams.same_corpus(base, same).count() == base.count()
    with pytest.raises(ValueError):
        streams.same_corpus(base.limit(1), same)


def test_evaluation_suite(spark):
    df = spark.createDataFrame(complaints(), "row_id int, uid string, kind string, content string, split string")
    cases = builder.finish(builder.suite(df, Workspace(spark, "suite")), df.where("1 = 0").select(F.col("content").alias("text")))
    rows = cases.collect()
    assert {"A", "B", "C", "D", "E", "F", "V"} <= {r["category"] for r in rows} and [r["id"] for r in rows] == sorted(r["id"] for r in rows)
    assert all(r["expected_topic_count"] == builder.TOPIC_COUNT[r["category"]] == len(r["expected_topics"]) and len(r["splits"]) == 1 for r in rows)
    assert len({" ".join(r["text"].lower().split()) for r in rows}) == len(rows)
    used = [r["sources"][0] for r in rows if len(r["sources"]) == 1]
    assert len(used) == len(set(used))
    quotas = {letter: n for letter, _, _, n, _ in builder.CATEGORIES}
    for letter, n in quotas.items():
        own = [r for r in rows if r["category"] == letter]
        assert len(own) <= n
        if letter in "BCDFG":  # no record twice in one form
            assert len({u for r in own for u in r["sources"]}) == 2 * len(own)
    for r in rows:
        assert len(r["sources"]) == 1 or len(r["expected_domains"]) == 2
        assert all(t["issue"].strip() and "згоду" not in t["issue"] for t in r["expected_topics"])
    with pytest.raises(Exception, match="a training text"):
        builder.finish(cases, cases.select("text").limit(1)).collect()


def test_singles_fill_scarce_categories_first(spark):
    rng = random.Random(3)
    rows = [(f"u{i}", [c for c in "AHIJLM" if rng.random() < {"A": 0.9, "H": 0.5, "I": 0.05, "J": 0.3, "L": 0.02, "M": 0.0}[c]]) for i in range(400)]
    quotas = {"A": 300, "H": 20, "I": 10, "J": 6, "L": 4, "M": 5}
    df = spark.createDataFrame(rows, "uid string, eligible array<string>")
    got = [tuple(r) for r in builder.dealt_singles(df, quotas, Workspace(spark, "deal")).collect()]
    assert sorted(got) == sorted(tuple(r) for r in builder.dealt_singles(df.repartition(7), quotas, Workspace(spark, "deal")).collect())
    fits = dict(rows)
    assert len({u for u, _ in got}) == len(got) and all(c in fits[u] for u, c in got)
    taken, left = {c: sum(k == c for _, k in got) for c in quotas}, set(fits) - {u for u, _ in got}
    for c, n in quotas.items():  # full, or no record that fits is free
        assert taken[c] == n or (taken[c] < n and not any(c in fits[u] for u in left))
    assert builder.dealt_singles(df.limit(0), quotas, Workspace(spark, "deal")).count() == 0


def test_baseline_report(spark):
    rows = [(i, f"ліфт поломка дім {i}" if i % 2 else f"дорога яма асфальт {i}", "a" if i % 2 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, content string, kind string")
    told = baseline.run_tfidf(df.where("row_id < 30"), df.where("row_id >= 30"), Workspace(spark, "tfidf"), rounds=40)
    assert told.where("true_kind = predicted_kind").count() == 10
    mixed = told.withColumn("predicted_kind", F.when(F.col("row_id") < 33, "a").otherwise(F.col("predicted_kind"))).withColumnRenamed("row_id", "ordinal")
    r = baseline.report(mixed)
    assert (r["n_test"], r["n_errors"]) == (10, 2) and sum(map(sum, r["matrix"])) == 10 and len(r["by_label"]["b"]) == 2
    text = baseline.markdown(r)
    assert "2 of 10 wrong" in text and "## Errors of b" in text
    cells = spark.createDataFrame([("a", "a", 1)], "true_label string, pred_label string, n long")
    assert not baseline.report(mixed, cells)["reproduces_saved"]
    with pytest.raises(Exception, match="unknown label"):
        baseline.run_tfidf(df.where("kind = 'a'").union(df.where("kind = 'b' and row_id < 9")), df.limit(2).withColumn("kind", F.lit("c")), Workspace(spark, "tfidf"), rounds=1).collect()


def test_export(spark, tmp_path):
    baseline.export_run("s", spark.createDataFrame([(2, "x"), (1, "y")], "id int, raw string"), {"n": 2}, str(tmp_path))
    assert [r["id"] for r in spark.read.json(str(tmp_path / "predictions")).collect()] == [1, 2]
    assert json.loads(spark.read.text(str(tmp_path / "metrics")).first()[0])["metrics"] == {"n": 2}


def test_large_kinds_are_clustered_over_all_rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 6)) * 8
    rows = [(i, "k", [float(v) for v in centres[i % 4] + rng.normal(size=6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id int, kind string, vector array<double>")
    seats = spark.createDataFrame([("k", 400, 4)], "kind string, support long, quota long")
    parts = sample.cluster(df, seats, "kind", "row_id", "vector")
    local = sample.kmeans(np.array([r[2] for r in rows]), 4, 0)
    cost = ((np.array([r[2] for r in rows]) - local[1][local[0]]) ** 2).sum()
    assert parts.count() == 400 and parts.agg(F.sum("distance")).first()[0] <= 1.05 * cost
    again = sample.cluster(df.repartition(5), seats, "kind", "row_id", "vector")  # sums may differ in their last digits
    assert {(r["row_id"], r["cluster"]) for r in parts.collect()} == {(r["row_id"], r["cluster"]) for r in again.collect()}
    groups = {}
    for r in parts.collect():
        groups.setdefault(r["cluster"], set()).add(r["row_id"] % 4)
    assert sorted(map(len, groups.values())) == [1, 1, 1, 1]
    with pytest.raises(Exception, match="clusters of"):
        sample.cluster(df.limit(3), spark.createDataFrame([("k", 3, 4)], "kind string, support long, quota long"), "kind", "row_id", "vector").collect()


def test_selection_takes_no_text_twice(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], f"Text  {i % 37}", [float(v) for v in rng.normal(size=4)], float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id int, kind string, text string, vector array<double>, s double")
    got = sample.select_gold(df, 30, least=3, extra=4, score=F.col("s")).collect()
    texts = [rows[r["row_id"]][2] for r in got]
    assert len(got) == 30 and len(set(texts)) == 30 and {r["method"] for r in got} <= {"centroid", "outlier", "multi", "fill"} and sum(r["method"] == "multi" for r in got) <= 4
    with pytest.raises(ValueError):
        sample.select_gold(df, 38, least=3)


def test_behaviour_is_told_row_by_row(spark):
    topic = "struct<domain:string,issue:string,object:string,requested_action:string,attributes:map<string,string>>"
    t = lambda *issues: [("roads", x, "", "", {}) for x in issues]
    two = t("the road is broken", "no water at home")
    rows = [
        (1, two, t("the road is broken")), (1, two, t("no water at home")), (2, t("the road is broken", "the road is very broken"), t("the road is broken")),
        (3, two, t("x", "y")), (4, two, t("x", "y", "z")), (5, two, None), (6, two, []), (7, t("", "a"), t("")), (8, t("A b c", "c B a", "x"), t("b c d")),
    ]
    got = scoring.behaviour(spark.createDataFrame(rows, f"id int, expected array<{topic}>, topics array<{topic}>").coalesce(1)).collect()
    assert [(r["id"], r["behaviour"]) for r in got] == [(1, "STOP"), (1, "STOP"), (2, "MERGE"), (3, "SPLIT"), (4, "OVER"), (5, "JSONFAIL"), (6, "STOP"), (7, "STOP"), (8, "MERGE")]


def _counted(spark, df):
    """The frame and a counter of the rows that are made of it."""
    made = spark.sparkContext.accumulator(0)

    def run(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    return df.mapInPandas(run, df.schema), made


def test_statistics_read_their_cases_once(spark):
    rows = [(str(i), "A", "real", ["test"], "x" * n, 1, ["roads"]) for i, n in enumerate((3, 3, 5, 9, 9, 9, 12))]
    df, made = _counted(spark, spark.createDataFrame(rows, "id string, category string, kind string, splits array<string>, text string, expected_topic_count int, expected_domains array<string>"))
    got = {(r["statistic"], r["value"]): r["n"] for r in builder.statistics(df).collect()}
    assert made.value == 7
    assert {v: n for (s, v), n in got.items() if s == "length"} == {"min": 3, "p25": 3, "median": 9, "p75": 9, "max": 12}
    assert got["cases", "all"] == got["domain", "roads"] == 7 and len(got) == 11
    assert {r["value"] for r in builder.statistics(df.where("id = '0'")).where("statistic = 'length'").collect()} == {"min", "p25", "median", "p75"}
    assert builder.statistics(df.where("id = ''")).count() == 0


def test_annotation_files_are_read_once(spark):
    raw = '{"batch_id":"b1","annotations":[{"id":"x","text":"t","annotation":{"topics":[]}},{"id":"x","annotation":7},3]}'
    df, made = _counted(spark, spark.createDataFrame([("b1", raw), ("b2", "[")], "batch_id string, raw string"))
    expected = spark.createDataFrame([("b1", "x", "t"), ("b1", "y", "t"), ("b2", "z", "t"), ("b3", "w", "t")], "batch_id string, id string, text string")
    got = sorted((r["batch_id"] or "", r["category"], r["id"] or "") for r in annotation.errors(df, expected).collect())
    assert got == [("", "incomplete", ""), ("b1", "duplicate_id", "x"), ("b1", "format", ""), ("b1", "missing_annotation", "x"), ("b1", "missing_id", "y"), ("b2", "json_parse", ""), ("b3", "missing_batch", "")]
    assert made.value == 2


def test_cases_are_finished_in_two_readings(spark):
    topic = "struct<domain:string,issue:string,object:string,requested_action:string,attributes:map<string,string>>"
    rows = [(f"c{i}", f"Text {i // 2}", 1, [("roads", "x", "", "", {})]) for i in range(10)] + [("d0", "text  0", 1, [("roads", " ", "", "", {})])]
    df, made = _counted(spark, spark.createDataFrame(rows, f"id string, text string, expected_topic_count int, expected_topics array<{topic}>"))
    assert sorted(r["id"] for r in builder.distinct_cases(df).collect()) == ["c0", "c2", "c4", "c6", "c8"]
    assert made.value <= 2 * len(rows)
    with pytest.raises(Exception, match="d0: empty expected issue"):
        builder.finish(df.where("id = 'd0'")).collect()


def test_selection_reads_its_records_once(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], f"Text {i}", [float(v) for v in rng.normal(size=3)]) for i in range(60)]
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    df = spark.createDataFrame(rows, "row_id int, kind string, text string, vector array<double>")
    assert len(sample.select_gold(df.mapInPandas(counted, df.schema), 10, least=2).collect()) == 10
    assert made.value == 60


def test_dangling_identity_words_go_to_the_last(spark):
    one = re.compile(r"(?:^|[\s.;,])за(?:явник|явниц|явники|явницям|явкою|я)\w*\s*$", re.IGNORECASE)

    def brute(x):
        before, x = None, x.strip(" .,;:-«»")
        while before != x:
            before, x = x, one.sub("", x).strip(" .,;:-«»")
        return x

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["яма", "заявник", "заявниці,", "за", "завод", "заявники.", "- «", "ліфт;", "Заявниця"]) for _ in range(rng.randrange(1, 12))) for _ in range(200)] + ["яма " + "заявник " * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", labels._trim(F.regexp_replace(labels._trim(F.col("t")), patterns.DANGLING_IDENTITY, "")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [brute(t) for t in texts]


def test_contained_passages(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("ab cd ef gh".split())
    passages = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 9, 12, 0])]
    docs = [(k, " ".join(word() for _ in range(60)) + (" " + passages[k % 5][1].upper() + "!" if k % 2 else "")) for k in range(20)] + [(99, None)]
    got = {tuple(r) for r in audit.contained(spark.createDataFrame(passages, "p int, text string"), "p", spark.createDataFrame(docs, "d int, text string"), "d").collect()}
    words = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    assert got == {(p, d) for p, x in passages if x for d, t in docs if words(x) in words(t)}


def test_firsts_by_hash(spark):
    rows = [(i, ["x", None, "y", "null", "=x"][i % 5], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id int, a string, b int")
    first = {}
    for i, a, b in rows:
        first.setdefault((a, b), i)
    assert sorted(r["row_id"] for r in curate.first_of(df, ["a", "b"]).collect()) == sorted(first.values())


def test_named_ids_and_expectations(spark):
    body = spark.createDataFrame([("s", "text `a1` more\n| a2 | x |\n|---|---|\n| `a3` | y |")], "section string, body string")
    ids = spark.createDataFrame([("s", "a1"), ("s", "a2"), ("s", "a4")], "section string, id string")
    got = {(r["id"], r["side"]) for r in release.named_in(ids, body).collect()}
    assert {("a1", "both"), ("a2", "both"), ("a3", "extra"), ("a4", "missing")} <= got
    e = spark.createDataFrame([("c1", "SPLIT"), ("c2", "MERGE"), ("c3", "STOP")], "id string, behaviour string")
    b = spark.createDataFrame([("c1", "SPLIT"), ("c2", "STOP")], "id string, behaviour string")
    assert {r["id"]: r["ok"] for r in release.expectations(e, b, ["id"]).collect()} == {"c1": True, "c2": False, "c3": False}


def test_vectors_come_from_the_cache_or_the_model(spark, tmp_path):
    from grainmill.sources import io

    records = spark.createDataFrame([(f"i{k}", f"u{k}", "k", "ab" * k) for k in range(7)], "id string, uid string, kind string, content string")
    factory = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    got = {r["id"]: r["vector"] for r in io.cached_vectors(records, str(tmp_path), "m", "train", factory, batch=3).collect()}
    assert got == {f"i{k}": [2.0 * k, 1.0] for k in range(7)}
    fail = lambda: lambda texts: 1 / 0
    assert io.cached_vectors(records, str(tmp_path), "m", "train", fail).count() == 7
    with pytest.raises(Exception, match="ZeroDivisionError"):
        io.cached_vectors(records, str(tmp_path), "other", "train", fail)


def test_schema_and_selection_statistics(spark):
    from grainmill.operators import reconcile

    schema = reconcile.annotation_schema()
    assert schema["definitions"]["topic"]["required"] == list(reconcile.FIELDS) and not schema["additionalProperties"]
    records = spark.createDataFrame([("a", "train", "x"), ("a", "test", "y"), ("b", "train", "z")], "kind string, split string, text string")
    picked = spark.createDataFrame([("a", "train", "fill", "x"), ("a", "test", "centroid", " X ")], "kind string, split string, method string, text string")
    got = {(r["statistic"], r["value"]): r["n"] for r in sample.selection_statistics(records, picked, ["a", "b", "c"], ["train", "validation", "test"]).collect()}
    assert got["selected by kind", "c"] == 0 and got["support", "a"] == 2 and got["selected by split", "validation"] == 0 and got["method", "outlier"] == 0 and got["total", "repeated texts"] == 1


def test_mechanism(spark):
    from grainmill.operators import scoring

    rows = [(1, "D", "Яма на дорозі. А також стоїть ліфт.", [topic(issue="яма на дорозі"), topic("housing", "яма на дорозі")]), (2, "A", "Тихо", [topic(issue="тихо")])]
    got = {r["id"]: r for r in scoring.mechanism(spark.createDataFrame(rows, f"id int, category string, text string, expected array<{T}>")).collect()}
    assert got[1]["explicit_additive_marker"] and got[1]["boundary_marked"] and got[1]["issue_sim"] == 1.0 and got[1]["issue_sim_ge_60"] and got[1]["sentences"] == 2
    assert not got[2]["punct_boundary"] and got[2]["issue_sim"] == 0.0 and got[2]["sentences"] == 1


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_runs_without_a_partition(spark, chunk):
    import itertools

    rng = random.Random(chunk)
    rows = [(i * rng.randrange(1, 3) + 3 * i, rng.choice(["a", "b", None])) for i in range(60)]
    rows = sorted({k: v for k, v in rows}.items())
    want, k = [], 0
    for n, (label, group) in enumerate(itertools.groupby(rows, key=lambda r: r[1]), 1):
        group = list(group)
        want.append((n, label, len(group), group[0][0]))
    got = curate.run_lengths(spark.createDataFrame(rows, "at int, l string"), "l", "at", chunk=chunk).orderBy("run").collect()
    assert [(r["run"], r["label"], r["length"], r["first"]) for r in got] == want


def test_dense_ordinals(spark):
    from grainmill.sources import io

    rows = [(i * 7 % 101, "x") for i in range(101)]
    df = spark.createDataFrame(rows, "k int, part string").repartition(5)
    got = io.dense(df, "k", Workspace(spark, "dense")).orderBy("k").collect()
    assert [(r["k"], r["ordinal"], r["part"]) for r in got] == [(i, i, "x") for i in range(101)]


def test_scores_of_a_grid_are_those_of_the_summary(spark):
    from grainmill.operators import measure, vectors

    rng = random.Random(3)
    pairs = [(rng.randrange(4), rng.randrange(5)) for _ in range(80)]
    df = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(pairs)], "ordinal int, true_kind string, predicted_kind string")
    cells = measure.confusion(df, spark.createDataFrame([(str(k),) for k in range(5)], "kind string"))
    want = measure.summary(cells, present_only=True).first()
    counts = {(r["true_label"], r["pred_label"]): r["n"] for r in cells.collect() if r["n"]}
    assert vectors.f1_of(counts, "macro_f1") == pytest.approx(want["macro_f1"]) and vectors.f1_of(counts, "weighted_f1") == pytest.approx(want["weighted_f1"])
    rows = [(i, [float(i % 3 == k) + rng.random() / 4 for k in range(3)], i % 3) for i in range(90)]
    v = spark.createDataFrame(rows, "id int, vector array<double>, label int")
    model = vectors.VectorClassifier()
    scores = model.tune(v.where("id < 60"), v.where("id between 60 and 74"), (0.1, 10.0), "weighted_f1")
    assert [s for s, _ in scores] == [0.1, 10.0] and model.fit(v.where("id < 75")).predict(v.where("id >= 75")).where("prediction <> label").count() == 0


def _documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    return suite_cases._pool(spark, str(folder))


def test_suite_moves_texts_of_chosen_records_only(spark, tmp_path):
    """2.4 MB of texts that do not compress; what is written on the way to two cases a category is a part of them."""
    rng = random.Random(4)
    rows = [(i, "s", " ".join(rng.randbytes(6).hex() for _ in range(460))) for i in range(400)]
    ws = Workspace(spark, "moved")
    cases = builder.assemble(_documents(spark, tmp_path, rows), ws, {letter: 1 for letter, *_ in builder.CATEGORIES})
    assert {"B", "C", "D", "E", "F", "G", "K", "I"} <= {r["category"] for r in cases.collect()}
    assert sum(p.stat().st_size for p in Path(ws.root.removeprefix("file://")).rglob("*.parquet")) < 1_500_000


def test_suite_takes_one_record_a_uid(spark, tmp_path):
    """Of a uid that stands for several texts the least one is taken, also where another uid has the other text."""
    words = " and some more words of it"
    rows = [(1, "s", "bb" + words), (1, "s", "aa" + words), (1, "s", "aa" + words), (2, "s", "bb" + words), (3, "s", None), (3, "s", " \n")]
    ws = Workspace(spark, "uids")
    cases = builder.assemble(_documents(spark, tmp_path, rows), ws).collect()
    assert sorted(r["uid"] for r in spark.read.parquet(ws.path("own")).collect()) == ["1", "2"]
    assert {(r["sources"][0], r["text"]) for r in cases if r["kind"] == "real"} <= {("1", "aa" + words), ("2", "bb" + words)}
    assert {u for r in cases for u in r["sources"]} == {"1", "2"}


def test_reference_topics_give_all_fields(spark, tmp_path):
    """The request, the object and the attributes are part of the result; a request is the first sentence that asks, however
    far behind, and is cut at 200 characters as where this comes from."""
    from grainmill.plans import texts

    late = "Води немає. " * 400 + "Прошу відремонтувати трубу на вулиці Шевченка, буд.5. Прошу ще."
    rows = [(1, late, "Теплопостачання"), (2, "Прошу " + "прибрати сміття " * 40, "x"), (3, "Please mend the pipe.", "x"), (4, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i,) for i in range(1, 5)], "o_orderkey long").withColumn("o_orderdate", F.timestamp_seconds(F.lit(0))).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["row_id"]: r for r in texts.reference_topics(spark, str(tmp_path)).collect()}
    assert (got[1]["domain"], got[1]["object"], got[1]["issue_chars"]) == ("heating", "вулиці Шевченка", 400) and got[1]["requested_action"] == "відремонтувати трубу на вулиці Шевченка, буд.5"
    assert json.loads(got[1]["attributes"]) == {"street": "вулиці Шевченка", "building": "5"}
    assert "прибрати сміття" in got[2]["requested_action"] and 190 < len(got[2]["requested_action"]) <= 200
    assert [(got[i]["requested_action"], got[i]["object"], got[i]["attributes"]) for i in (3, 4)] == [("", "", "{}")] * 2
