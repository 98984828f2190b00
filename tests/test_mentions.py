"""Substring joins against a loop over all pairs; the plan has no nested-loop join."""

import random

import pytest

from grainmill.operators import audit
from grainmill.storage import Workspace


def frames(spark, needles, bodies):
    return spark.createDataFrame([(n,) for n in needles], "needle array<string>"), spark.createDataFrame(list(bodies), "reader string, body string")


def test_equals_all_pairs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc/.é ") for _ in range(rng.randrange(1, 7)))
    needles = [n for n in ([word() for _ in range(rng.randrange(1, 3))] for _ in range(400)) if any(x.strip() for x in n)]
    bodies = [(f"r{i}", " ".join(word() for _ in range(rng.randrange(12)))) for i in range(150)] + [("none", None), ("empty", ""), ("two", "ab"), ("two", "abc c/c")]
    got = {(tuple(r["needle"]), r["reader"]) for r in audit.mentions(*frames(spark, needles, bodies), Workspace(spark, "m")).collect()}
    assert got == {(tuple(n), r) for n in needles for r, b in bodies if b is not None and all(x in b for x in n)}


def test_blank_needles_fail_and_empty_tables_do_not(spark):
    with pytest.raises(Exception, match="not blank"):
        audit.mentions(*frames(spark, [[" "]], [("r", "a b")]), Workspace(spark, "m")).collect()
    assert audit.mentions(*frames(spark, [], [("r", "a")]), Workspace(spark, "m")).collect() == []
    assert audit.mentions(*frames(spark, [["a"], None], []), Workspace(spark, "m")).collect() == []


def test_files_by_tail_or_by_name_and_folder(spark):
    rng = random.Random(2)
    folders, names = [f"set{i}" for i in range(60)] + ["data", "v2"], ["train.jsonl", "test.jsonl", "meta.json"]
    paths = sorted({"/".join(["ml", *[rng.choice(folders) for _ in range(rng.randrange(4))], rng.choice(names)]) for _ in range(2000)}) + ["alone.txt", "data/"]
    readers = [(f"t{i}", " ".join(rng.choice([f"open('{rng.choice(paths)}')", rng.choice(folders), rng.choice(names), "x = 1"]) for _ in range(6))) for i in range(80)]

    def reads(path, body):
        parts = path.split("/")
        if not parts[-1]:
            return False
        above = [d for d in parts[1:-1] if d != "data"]
        return "/".join(parts[-2:]) in body or (parts[-1] in body and any(d in body for d in above))

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = audit.read_by(files, spark.createDataFrame(readers, "reader string, body string"), Workspace(spark, "r"))
    assert {tuple(r) for r in got.collect()} == {(p, r) for p in paths for r, b in readers if reads(p, b)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
