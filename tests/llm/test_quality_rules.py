from collections import Counter

from grainmill.llm import quality_rules
from tests.llm.conftest import MESSY


def base(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def told(df):
    return sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in df.collect()), key=str)


def test_base_equals_brute_force(messy, ws):
    assert told(quality_rules.judge(messy, ws)) == sorted(((i, *base(t)) for i, t, *_ in MESSY), key=str)


def test_base_on_documents(documents, ws):
    got = quality_rules.judge(documents, ws)
    assert told(got) == sorted(((r["doc_id"], *base(r["text"])) for r in documents.collect()), key=str)


def test_repeats_and_lines(frame, ws):
    items = [(1, "a b c a b c d", "en", "s"), (2, "a a a a", "en", "s"), (3, "x\ny\nx\n\n \nx", "en", "s"), (4, "a b c", "en", "s")]
    got = {r["doc_id"]: (r["n_repeat_words"], r["n_dup_lines"]) for r in quality_rules.judge(frame(items), ws).collect()}
    assert got == {1: (6, 0), 2: (4, 0), 3: (0, 2), 4: (0, 0)}


def test_keeps_good_drops_bad(spark, ws):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality_rules.judge(spark.read.parquet(f"{d}/documents.parquet"), ws).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def test_no_python_in_the_plan(documents, ws):
    plan = quality_rules.judge(documents, ws)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(empty, ws):
    assert quality_rules.judge(empty, ws).count() == 0


def test_guards_and_robust_references(frame, ws):
    """Short texts are not judged by their histograms; junk that is a third of a language does not become its reference."""
    import random

    rng = random.Random(2)
    common = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    good = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else "w" + "".join(rng.choice("ijklmnop") for _ in range(6)) for _ in range(n))
    junk = lambda n: " ".join("".join(rng.choice("#$%&*0123456789ABCDEF") for _ in range(5)) for _ in range(n))
    items = [(i, good(200), "en", "s") for i in range(60)] + [(100 + i, junk(200), "en", "s") for i in range(30)] + [(200, junk(49), "en", "s"), (201, junk(55), "en", "s"), (202, "# 1 2 3 4 5 " * 9 + good(55), "en", "s")]
    got = {r["doc_id"]: r for r in quality_rules.judge(frame(items), ws).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[100 + i]["kept"] for i in range(30))
    assert got[200]["base_failed"] and not got[200]["kept"]
    lax = {r["doc_id"]: r for r in quality_rules.judge(frame(items), ws, min_chars=400, min_words=60).collect()}
    assert not got[201]["kept"] and lax[201]["kept"]  # 55 words in 329 code points: judged by characters only from its length on
