"""Cases made of whole conversations, held against a brute-force version."""

import pytest

from grainmill.operators.scoring import DOMAINS
from grainmill.plans import evaluation

LONG = [f"Part {k} of the report names the pipe number {k * 7} in house {k}." for k in range(40)]
TURNS = [
    (1, 0, "user", " ".join(LONG)),
    (1, 1, "assistant", " ".join(LONG[:20] + ["Something else follows here."] + LONG[25:38] + ["We thank you."])),
    (2, 0, "user", "One short sentence. Another one here."),
    (2, 1, "assistant", "One short sentence. A second. And a third. A fourth too."),
    (3, 0, "user", "word " * 900 + "end."),
    (3, 1, "assistant", "other word " * 500 + "end. Last one."),
]


def rouge(a, b):
    a, b = a.split(), b.split()
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
    return 2 * row[-1] / (len(a) + len(b))


def split(text):
    parts = text.replace(". ", ".\n").split("\n")
    return [p for p in parts if p]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("cases"))
    spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def test_whole_texts_are_scored(spark, folder):
    got = {r["id"]: r for r in evaluation.case_scores(spark, folder).collect()}
    assert sorted(got) == [1, 2, 3]
    for i in got:
        (want,), (have,) = [[t.strip() for c, _, role, t in TURNS if c == i and role == k] for k in ("user", "assistant")]
        e, p = split(want), split(have)
        domain = lambda s: DOMAINS[len(s) % len(DOMAINS)]
        de, dp = [set(map(domain, x)) for x in (e, p)]
        r = got[i]
        assert r["text_len"] == len(next(t for c, _, role, t in TURNS if c == i and role == "user"))
        assert (r["expected_topic_count"], r["predicted_topic_count"]) == (len(e), len(p))
        assert r["domain_set_recall"] == pytest.approx(len(de & dp) / len(de)) and r["domain_set_precision"] == pytest.approx(len(de & dp) / len(dp))
        assert r["issue_rouge_l_best"] == pytest.approx(sum(max(rouge(x, y) for y in p) for x in e) / len(e))
        assert r["boilerplate_leak"] == any("thank" in s or "please" in s for s in p)
        assert r["duplicate_domain"] == (len(p) != len(dp))


def test_behaviour_and_structure_see_the_rest(spark, folder):
    told = {r["id"]: r["behaviour"] for r in evaluation.case_behaviour(spark, folder).collect()}
    assert told[2] == "OVER" and told[3] == "OVER" and told[1] != "OVER"
    assert {r["id"]: r["text_len"] for r in evaluation.case_structure(spark, folder).collect()}[1] == len(TURNS[0][3])
