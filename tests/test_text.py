import pytest
from pyspark.sql import functions as F

from grainmill.functions import patterns as p
from grainmill.operators import labels

from grainmill.functions import text as t


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    assert run(spark, t.normalize, [None, "", "  А\xa0Б \x1cв \n", "ПРИВІТ"]) == ["", "", "а б в", "привіт"]


def test_collapse_keeps_case(spark):
    assert run(spark, t.collapse, [None, " Ab \t c "]) == ["", "Ab c"]


def test_tokens(spark):
    assert run(spark, t.tokens, [None, "Привіт, п'ять 5 Café", ""]) == [[], ["привіт", "п'ять", "caf"], []]


@pytest.mark.parametrize(
    "given,want",
    [(None, None), ('a "b" c', "a “b” c"), ('під"їзд', "під’їзд"), ('""', "“”"), ('"a" x "b', "“a” x “b"), ('x"y "z"', "x’y “z”"), ('"', "“"), ("none", "none"), ('1"2 "', "1’2 “")],
)
def test_alternate_quotes(spark, given, want):
    got = run(spark, t.alternate_quotes, [given])[0]
    assert got == want
    if got is not None:
        assert len(got) == len(given) and run(spark, t.alternate_quotes, [got]) == [got]


@pytest.mark.parametrize("given,want", [('a "b" c', "a “b” c"), ('під"їзд "х"', "під’їзд “х”"), ('""', '""'), ('"a" "b', '“a” "b'), (' x ', "x"), ('"a""b"', "“a”“b”"), (None, None), ('"" "a"', '"" “a”')])
def test_pair_quotes(spark, given, want):
    assert run(spark, t.pair_quotes, [given]) == [want]


def test_sentences(spark):
    assert run(spark, t.sentences, ["A b. C!  D? e", "", None, "one"]) == [["A b.", "C!", "D?", "e"], [], [], ["one"]]


def test_repeats_itself(spark):
    gram = "a b c d e f "
    many = " ".join(f"w{i}" for i in range(60))
    assert run(spark, t.repeats_itself, [gram * 4, many, gram * 4 + many, gram * 3 + many, "x " * 60, None]) == [False, False, True, False, True, False]


def test_scores(spark):
    assert run(spark, t.boilerplate_score, ["", "x" * 40, "x" * 80, "x" * 160, "відповідь заявнику " + "x" * 200, None]) == [3.0, 1.5, 0.5, 0.0, 3.0, 3.0]
    assert run(spark, t.topic_score, ["щодо води. щодо тепла, а також доріг", "прошу раз", "прошу; прошу", ""]) == [4, 0, 2, 0]


def test_empty_to_null(spark):
    assert run(spark, t.empty_to_null, [" a ", "  ", None]) == ["a", None, None]


def test_copies(spark):
    df = spark.createDataFrame([("Fix the road!", "please fix  the road now"), ("fix", "fix"), (None, "x")], "a string, t string")
    assert [r[0] for r in df.select(t.contains_copy(F.col("a"), F.col("t"))).collect()] == [True, False, False]


def test_label_patterns_need_a_cyrillic_letter(spark):
    """Labels skip their patterns in texts without one, so none of them may match there."""
    plain = "Please mend the pipe, no. 5. The road is broken!  Call 067 123 45 67 or +380671234567; for the answer. "
    both = spark.createDataFrame([(1, plain), (2, None), (3, "Вода. Прошу прибрати сміття на вул. Шевченка 5.")], "id int, text string")
    c = F.col("text")
    told = [labels.street(c), labels.issue(c), labels.requested_action(c), labels.clean_clause(c), labels.clean_issue(c), labels.action_clause(c), labels.condense(c)]
    got = {r[0]: list(r)[1:] for r in both.select("id", *[x.alias(f"c{i}") for i, x in enumerate(told)]).collect()}
    assert got[1][0] == got[1][2] == got[1][5] == "" and got[2] == [""] * 7
    assert got[1][1] == "Please mend the pipe, no. 5. The road is broken! Call or ; for the answer."
    assert got[3][0].startswith("вул. Шевченка") and got[3][2] and got[3][5].startswith("прибрати")
    for pattern in (p.REQUEST, p.ADMIN_CLAUSE, p.STREET, p.BUILDING, p.BOILERPLATE_ANY, p.DANGLING_IDENTITY, p.ACTION_HEAD, p.CLAUSE_STEMS, p.ANY_ACTION_VERB, p.DANGLING_HEAD):
        assert both.where((F.col("id") == 1) & c.rlike(pattern)).count() == 0
    assert both.where(c.rlike(p.CYRILLIC)).count() == 1
