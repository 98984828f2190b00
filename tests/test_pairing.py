"""Pairs among neighbours against a written-out walk, a hot key without a match, and the streams made of them."""

import hashlib
import itertools
import math
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from grainmill.functions import text
from grainmill.operators import pairing
from grainmill.storage import Workspace


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def brute(rows, tests, per_key, least, seed=42):
    """rows: (uid, key, domain, n) -> [(key, a uid, b uid, reason)]."""
    sizes = Counter(r[1] for r in rows)
    size = max(sum(sizes.values()) / pairing.PARTS, least)
    groups = defaultdict(list)
    for r in rows:
        pieces = math.ceil(sizes[r[1]] / size) if sizes[r[1]] > size else 1
        groups[r[1], int(md5(r[0])[:8], 16) % pieces].append(r)
    told = []
    for (key, piece), own in groups.items():
        own.sort(key=lambda r: (md5(seed, r[0]), r[0]))
        nth, seen = {}, Counter()
        for r in own:
            nth[r[0]] = seen[r[2]] = seen[r[2]] + 1
        own.sort(key=lambda r: (nth[r[0]], r[2], md5(seed, r[0])))
        for i in range(0, len(own), 2):
            a, b = own[i], own[i + 1] if i + 1 < len(own) else None
            why = "no_partner" if b is None else "same_domain" if a[2] == b[2] else next((n for n, holds in tests.items() if not holds(a, b)), None)
            told.append([key, piece, a, b, why])
    first = {}
    for t in sorted((t for t in told if t[4] is None), key=lambda t: t[0]):
        two = tuple(sorted((t[2][0], t[3][0])))
        if two in first:
            t[4] = "duplicate_pair"
        first.setdefault(two, t)
    left = Counter()
    for t in sorted((t for t in told if t[4] is None), key=lambda t: (md5(seed, t[2][0], t[3][0]), t[2][0])):
        left[t[0]] += 1
        t[4] = "kept" if left[t[0]] <= per_key else "over_cap"
    return sorted((k, a[0], b and b[0], why) for k, _, a, b, why in told)


@pytest.mark.parametrize("least", [16, 4096])
def test_equals_the_walk(spark, least):
    rng = random.Random(1)
    rows = [(f"u{i}", rng.choice(["hot"] * 6 + [f"k{j}" for j in range(30)]), rng.choice("aaabcd"), rng.randrange(50)) for i in range(1500)]
    df = spark.createDataFrame(rows, "uid string, street string, domain string, n int")
    got = pairing.pairs(df, "street", "uid", "domain", {"far": lambda a, b: F.abs(a["n"] - b["n"]) <= 25}, per_key=2, least=least)
    told = sorted((r["street"], r["a"]["uid"], r["b"] and r["b"]["uid"], r["reason"]) for r in got.collect())
    want = brute(rows, {"far": lambda a, b: abs(a[3] - b[3]) <= 25}, 2, least)
    assert told == want
    assert {w for *_, w in want} == {"no_partner", "same_domain", "far", "over_cap", "kept"}


def test_two_records_of_two_keys_make_one_pair(spark):
    rows = [(u, s, u[0]) for u in ("a1", "b1") for s in ("x", "y")] + [("a2", "z", "a"), (None, "z", "b"), ("c", None, "c")]
    told = pairing.pairs(spark.createDataFrame(rows, "uid string, street string, domain string"), "street", "uid", "domain")
    assert Counter((r["street"], r["reason"]) for r in told.collect()) == {("x", "kept"): 1, ("y", "duplicate_pair"): 1, ("z", "kept"): 1}


def test_a_hot_key_without_a_match_takes_one_pass(spark):
    """100,000 rows of one key, no pair of which holds: as many rows come out as go in by two, and not their square."""
    took = {}
    for n in (25_000, 100_000):
        df = spark.range(n).select(F.col("id").cast("string").alias("uid"), F.lit("s").alias("street"), (F.col("id") % 5).alias("domain"))
        began = time.time()
        told = {r["reason"]: r["n"] for r in pairing.rejects(pairing.pairs(df, "street", "uid", "domain", {"never": lambda a, b: F.lit(False)})).collect()}
        took[n] = time.time() - began
        assert set(told) <= {"never", "same_domain", "no_partner"} and n / 2 <= sum(told.values()) <= n / 2 + 30
        assert told["never"] > 0.45 * n
    assert took[100_000] < 8 * took[25_000] + 5


def test_empty(spark):
    assert pairing.pairs(spark.createDataFrame([], "uid string, street string, domain string"), "street", "uid", "domain").collect() == []


@pytest.fixture(scope="module")
def records(spark):
    things = {
        "Водопостачання": "немає води в усіх квартирах нашого під'їзду з минулого тижня",
        "Дороги": "велика яма на проїжджій частині біля зупинки, псуються автомобілі",
        "Опалення": "холодні батареї у всіх кімнатах, хоча опалювальний сезон почався",
    }
    rng, rows = random.Random(2), []
    for i in range(120):
        kind = rng.choice(list(things))
        street = rng.choice(["Соборна", "Київська", "Садова"])
        rows.append((f"u{i}", kind, f"По вул. {street}, {things[kind]}, звернення {i}. Прошу усунути недолік {i} якнайшвидше."))
    rows += [("x1", "Дороги", rows[0][2]), ("x2", "Опалення", rows[0][2]), ("x3", "Дороги", "коротко"), ("x4", "Дороги", None), ("x5", None, rows[5][2] + " Так.")]
    return spark.createDataFrame(rows, "uid string, kind string, content string")


def test_streams_of_complaints(spark, records):
    mapping = {"Водопостачання": "water", "Дороги": "roads", "Опалення": "heating"}
    frozen = records.where("uid in ('u3', 'u4')").select("content")
    rows = pairing.labelled(records, frozen, Workspace(spark, "pairing"), mapping)
    uids = {r["uid"] for r in rows.select("uid").collect()}
    assert not uids & {"u0", "x1", "x2", "u3", "u4", "x4"} and len(uids) > 100
    told = pairing.same_object(rows, frozen, Workspace(spark, "so"))
    kept = [r for r in told.collect() if r["reason"] == "kept"]
    assert 3 <= len(kept) <= 9 and max(Counter(r["street"] for r in kept).values()) <= 3
    clauses = {r["uid"]: r["clause"] for r in rows.collect()}
    for r in kept:
        a, b = clauses[r["a"]["uid"]], clauses[r["b"]["uid"]]
        assert r["a"]["object"] == r["b"]["object"] == r["street"] and r["a"]["domain"] != r["b"]["domain"]
        assert r["text"] == f"По {r['street']}: {a}, а також {b[0].lower()}{b[1:]}."
    for name, made in (("MT-SYN-SO-", told), ("MT-SYN-CS-", pairing.compact(rows, frozen, Workspace(spark, "cs"), 4)), ("MT-SYN-SS-", pairing.same_street(rows, frozen, Workspace(spark, "ss"), 4))):
        got = pairing.examples(made, name).collect()
        assert got and len({frozenset(r["sources"]) for r in got}) == len(got)
        for r in got:
            assert r["uid"].startswith(name) and len(r["topics"]) == 2 and all(t["issue"].strip() for t in r["topics"])
            assert r["topics"][0]["domain"] != r["topics"][1]["domain"]


def test_frozen_texts_leak(spark):
    rows = spark.createDataFrame([("1", "k", ["s"], "a", "one thing"), ("2", "k", ["s"], "b", "other thing")], "uid string, kind string, streets array<string>, domain string, issue string")
    none = spark.createDataFrame([], "content string")
    text = pairing.compact(rows, none, Workspace(spark, "cs")).first()["text"]
    assert text in ("По s: one thing, а також other thing.", "По s: other thing, а також one thing.")
    told = pairing.compact(rows, spark.createDataFrame([(text.upper() + "  ",)], "content string"), Workspace(spark, "cs")).first()
    assert told["reason"] == "leakage" and told["text"] is None
    assert pairing.compact(rows, none, Workspace(spark, "cs"), longest=10).first()["reason"] == "too_long"


@pytest.mark.parametrize("made", [pairing.compact, pairing.same_street])
def test_texts_are_made_once(spark, made):
    """A text is made once to find pairs and once more at most to fetch those of kept ones; blank ones take no part."""
    calls = spark.sparkContext.accumulator(0)

    def dear(x):
        calls.add(1)
        return x

    n = F.col("id")
    issue = F.udf(dear, "string")(F.when(n % 10 == 0, "").otherwise(F.concat(F.lit("issue "), n.cast("string"))))
    rows = spark.range(600).select(n.cast("string").alias("uid"), F.lit("k").alias("kind"), F.array((n % 5).cast("string")).alias("streets"), (n % 3).alias("domain"), issue.alias("issue"), F.lit("body").alias("body"))
    told = made(rows, spark.createDataFrame([], "content string"), Workspace(spark, "once"), per_key=1).collect()
    assert len(told) == 300 - 30 and sum(r["reason"] == "kept" for r in told) == 5
    assert calls.value <= 2 * 600


def test_blank_runs_are_those_of_the_class(spark):
    own = [("".join(p),) for p in itertools.product("a~!é \n\t\x85　", repeat=4)] + [(None,)]
    df = spark.createDataFrame(own, "x string")
    told = lambda pattern: F.trim(F.regexp_replace(F.coalesce("x", F.lit("")), pattern, " "))
    assert df.where((text.collapse(F.col("x")) != told(text.BLANKS)) | (text.normalize(F.col("x")) != told(text.BLANKS))).count() == 0
