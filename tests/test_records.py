from collections import deque

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from grainmill.operators import audit, augment, labels, reconcile, sample, scoring
from grainmill.sources import io
from grainmill.streaming import limiter

RAWS = [
    ('{"topics": []}', ""), (' {"topics": [1]} ', ""), ("", "empty output"), (None, "empty output"), ('{"topics": []} tail', "not strict JSON"), ('{"a": 1}]', "not strict JSON"), ("[1]", "top level is array"),
    ('{"a": 1}', "missing 'topics' array"), ('{"topics": {}}', "missing 'topics' array"), ("{'topics': []}", "not strict JSON"), ('{"topics": []}, 1', "not strict JSON"),
]


def test_strict_json(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(RAWS)], "i int, raw string")
    assert [r["e"] for r in df.select("i", reconcile.parse_error(F.col("raw")).alias("e")).orderBy("i").collect()] == [e for _, e in RAWS]


def test_contract_errors(spark):
    good = '{"topics":[{"domain":"water","issue":"x","object":"","requested_action":"","attributes":{"a":"b"}}]}'
    bad = '{"topics":[{"domain":"sea","issue":" ","object":5,"attributes":[],"more":1}, 7]}'
    got = sorted((r["id"], r["topic"], r["error"]) for r in reconcile.contract_errors(spark.createDataFrame([(1, good), (2, bad)], "id int, raw string")).collect())
    assert got == [(2, 0, e) for e in ("attributes is not an object", "blank issue", "missing requested_action", "object is not a string", "unexpected more", "unknown domain")] + [(2, 1, "not an object")]


def test_reconcile(spark):
    want = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, text string")
    got = spark.createDataFrame([("a", "x"), ("b", "changed"), ("b", "y"), ("q", "x")], "id string, text string")
    assert sorted((r["category"], r["id"]) for r in reconcile.reconcile(want, got).collect()) == [("changed_text", "b"), ("duplicate_id", "b"), ("missing_id", "c"), ("unknown_id", "q")]


def test_merge_in_order_fails_on_gaps(spark):
    a, b = spark.createDataFrame([("a", 1), ("b", 0)], "id string, o int"), spark.createDataFrame([("a", "x"), ("b", "y")], "id string, v string")
    assert [r["v"] for r in reconcile.merge_in_order(a, b, "id", "o").collect()] == ["y", "x"]
    with pytest.raises(PySparkException):
        reconcile.merge_in_order(a, b.limit(1), "id", "o").collect()


def test_prefix_reason(spark):
    paths, reasons = spark.createDataFrame([("a/b/c",), ("a/x",), ("z",)], "path string"), spark.createDataFrame([("a/", "dir"), ("a/b", "sub")], "prefix string, reason string")
    assert {r["path"]: r["reason"] for r in reconcile.prefix_reason(paths, reasons).collect()} == {"a/b/c": "sub", "a/x": "dir", "z": None}


def test_weak_label(spark):
    text = "Заявник повідомляє, що немає води. По вул. Соборна немає води другий день, буд. 5а. Прошу відновити водопостачання!"
    r = spark.createDataFrame([(text, "Гаряче та холодне водопостачання")], "t string, k string").select(labels.label(F.col("t"), F.col("k")).alias("l")).first()["l"]
    assert r["domain"] == "water" and "Заявник" not in r["issue"] and r["object"].startswith("вул. Соборна") and r["attributes"]["building"] == "5а"
    assert "відновити водопостачання" in r["requested_action"]


def test_redaction_spares_streets():
    assert labels.redact_text("вул. Соборна, Іваненко 067-123-45-67") == "вул. Соборна,  "
    assert labels.redact_text(None) is None


def test_clean_issue_and_action(spark):
    texts = ["Немає тепла в будинку. Надає згоду на обробку персональних даних.", "Прошу прибрати сміття.", "Прошу вжити заходи.", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", labels.clean_issue(F.col("t")).alias("c"), labels.action_clause(F.col("t")).alias("a")).orderBy("i").collect()
    assert [r["c"] for r in rows] == ["Немає тепла в будинку", "Прошу прибрати сміття", "", ""]
    assert [r["a"] for r in rows] == ["", "прибрати сміття", "", ""]


def topic(issue="", action="", domain="water", obj=""):
    return {"domain": domain, "issue": issue, "object": obj, "requested_action": action, "attributes": {}}


def test_fill_and_repair():
    text = "Немає води. Прошу полагодити кран та прибрати сміття."
    got = labels.fill_actions([topic("a"), topic("b")], text)
    assert [t["requested_action"] for t in got] == ["полагодити кран", "прибрати сміття."] or [t["requested_action"] for t in got] == ["полагодити кран", "прибрати сміття"]
    cut = labels.repair_actions([topic("Немає води. Прошу.", "полагодити кран та прибрати смі")], text)
    assert cut[0]["requested_action"] == "полагодити кран та прибрати сміття"


def test_find_topics():
    one = '{"domain":"water","issue":"i","object":"","requested_action":"","attributes":{}}'
    assert len(labels.find_topics(f"noise {{x}} {one}, {one} tail")) == 2
    assert len(labels.find_topics('{"topics":[' + one + "]}")) == 1
    assert labels.find_topics('{"domain":"sea"}') is None and labels.find_topics(None) is None
    assert labels.balanced_json('x {"a": "}\\""} y') == ('{"a": "}\\""}', 14)


def test_clean_topic_moves_requests(spark):
    df = spark.createDataFrame([(topic("Немає води заявниця. Прошу полагодити."),)], spark_type())
    r = df.select(labels.clean_topic(F.col("t")).alias("t")).first()["t"]
    assert r["requested_action"] == "полагодити." and "Прошу" not in r["issue"]


def spark_type():
    from pyspark.sql.types import StructField, StructType

    return StructType([StructField("t", scoring.TOPIC)])


def test_render(spark):
    from pyspark.sql.types import ArrayType, StructField, StructType

    df = spark.createDataFrame([([topic("Немає води", "полагодити")],), ([],)], StructType([StructField("ts", ArrayType(scoring.TOPIC))]))
    a, b = [r[0] for r in df.select(labels.render(F.col("ts"), contact=F.lit("x"))).collect()]
    assert "1. Проблема: Немає води\n   Сфера: water\n   Прошу: полагодити\n\n" in a and "Контактні дані для відповіді: x" in a and "Проблема не визначена." in b


@pytest.mark.parametrize("a,b,want", [("", "", 1.0), ("a", "", 0.0), ("a b c d", "a c d e", 0.75), ("x", "y", 0.0)])
def test_rouge(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(scoring.rouge_l(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_limiter_does_not_count_rejected_hits():
    assert limiter.decide([0, 0, 1, 1000, 1001], deque(), 1000, 2) == [(True, 0), (True, 0), (False, 1), (True, 0), (True, 0)]


def test_limiter_over_a_table_equals_the_fold(spark):
    rows = [(i, f"k{i % 3}", (i * 137) % 5000) for i in range(300)]
    df = spark.createDataFrame(rows, "n int, key string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = {r["n"]: (r["allowed"], r["retry_after_sec"]) for r in limiter.limit(df, "key", "ts", "n", 700, 4).collect()}
    for k in range(3):
        own = sorted((ms, n) for n, key, ms in rows if key == f"k{k}")
        assert [got[n] for _, n in own] == limiter.decide([ms for ms, _ in own], deque(), 700, 4)


def test_append_new_is_repeatable(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    assert [limiter.append_new(df, path, ["k"]), limiter.append_new(df, path, ["k"])] == [2, 0]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿uid,kind,content\n1,,"a ""q"" \nb"\n2,null,x\n', encoding="utf-8")
    rows = io.read_csv(spark, str(tmp_path / "a.csv")).orderBy("row_id").collect()
    assert [(r["uid"], r["kind"], r["content"]) for r in rows] == [("1", "", 'a "q" \nb'), ("2", "null", "x")]


def test_vectors_are_kept_for_the_same_records_only(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 0.0])], "id string, vector array<double>")
    r = spark.createDataFrame([("a", "k", "x"), ("b", "k", "y")], "uid string, kind string, content string")
    io.save_vectors(v, r, str(tmp_path), "m", "train")
    assert io.load_vectors(spark, r, str(tmp_path), "m", "train").count() == 2
    assert io.load_vectors(spark, r, str(tmp_path), "other", "train") is None and io.load_vectors(spark, r.limit(1), str(tmp_path), "m", "train") is None
    assert io.load_vectors(spark, r, str(tmp_path / "none"), "m", "train") is None


def test_fingerprint_ignores_order(spark):
    import hashlib

    rows = [("b", None, "y"), ("a", "k", "x")]
    df = spark.createDataFrame(rows, "uid string, kind string, content string")
    want = hashlib.sha256(b"a\0k\0x\0b\0None\0y\0").hexdigest()
    assert audit.records_fingerprint(df).first()["fingerprint"] == want


def test_scan_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"uid":"1","receivedDateTime":"","type":"","kind":"","content":"call 067-123-45-67 or write to me@mail.org"}\n\nnot json\n', encoding="utf-8")
    r, = audit.scan_jsonl(spark, str(tmp_path)).collect()
    assert (r["rows"], r["phone_like_rows"], r["email_like_rows"], r["verbatim_source_schema"], r["carries_free_text"]) == (2, 1, 1, True, True)


def test_markdown(spark):
    assert io.markdown_table(["a", "b"], [[1, "x|y"]]) == "| a | b |\n| --- | --- |\n| 1 | x\\|y |"
    df = spark.createDataFrame([("d", "t\n| a | b |\n|---|:-:|\n| 1 | 2 |\n\n| c |\n| 3 |")], "doc string, text string")
    assert sorted((r["table"], r["row"], r["cells"]) for r in audit.markdown_tables(df).collect()) == [(1, 0, ["a", "b"]), (1, 1, ["1", "2"]), (2, 0, ["c"]), (2, 1, ["3"])]


def test_allotment(spark):
    seats = lambda supports, budget, least: {r["kind"]: r["quota"] for r in sample.quotas(spark.createDataFrame(list(supports.items()), "kind string, support long"), budget, least).collect()}
    assert seats({"a": 100, "b": 50, "c": 12}, 60, 12) == {"a": 29, "b": 19, "c": 12}
    assert sum(seats({"a": 1000, "b": 13, "c": 400}, 100, 12).values()) == 100
    assert seats({"a": 40, "b": 40, "c": 40, "d": 0}, 50, 3) == {"a": 17, "b": 17, "c": 16, "d": 0}
    with pytest.raises(Exception, match="no budget of 10"):
        seats({"a": 5}, 10, 1)


def test_kmeans_invariants():
    import numpy as np

    x = np.random.default_rng(0).normal(size=(40, 3))
    labels_, centres = sample.kmeans(x, 5, 1)
    assert len(labels_) == 40 and len(centres) == 5 and (labels_ == sample.kmeans(x, 5, 1)[0]).all()
    assert sorted(sample.kmeans(x, 40, 1)[0]) == list(range(40))


def test_replicate_and_pairs(spark):
    df = spark.createDataFrame([("MT-1",), ("x",)], "uid string")
    got = sorted(r["uid"] for r in augment.replicate(df, F.when(F.col("uid") == "MT-1", 3).otherwise(1)).collect())
    assert got == ["MT-1", "MT-1#1", "MT-1#2", "x"]
    rows = spark.createDataFrame([(i, "s", i % 3) for i in range(30)], "uid long, street string, domain long")
    pairs = augment.pairs_by_key(rows, "street", "uid", "domain", 4).collect()
    assert len(pairs) == 4 and all(p["a_domain"] != p["b_domain"] and p["a_uid"] < p["b_uid"] for p in pairs)
    assert augment.random_pairs(rows, "uid", "domain", 5, rows=10).count() == 5
