"""Scoring of structured predictions: similarity of texts and sets, grounding, per-case scores, failure classes.

A topic is a struct of domain, issue, object, requested_action and attributes (a map of strings).
"""

from __future__ import annotations

import difflib
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, MapType, StringType, StructField, StructType

from ..functions.text import RUNS, WS, normalize, plain_words, sentences, strip, word_set

TOPIC = StructType([StructField(c, StringType()) for c in ("domain", "issue", "object", "requested_action")] + [StructField("attributes", MapType(StringType(), StringType()))])
#: The domains a topic may have.
DOMAINS = ("roads", "water", "heating", "housing", "transport", "sanitation", "electricity", "construction", "benefits", "government", "commerce", "payments", "other")


def _words(x: Column) -> Column:
    return F.filter(F.split(F.coalesce(x, F.lit("")), RUNS), lambda w: w != "")


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, by a fold over rows of the table of lengths."""

    def row(last: Column, x: Column) -> Column:
        start = F.array(F.lit(0))
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            start,
            lambda cur, j: F.concat(cur, F.array(F.when(x == F.element_at(b, j), F.element_at(last, j) + 1).otherwise(F.greatest(F.element_at(last, j + 1), F.element_at(cur, -1))))),
        )

    zero = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(F.aggregate(a, zero, row), -1))


def rouge_l(a: Column, b: Column) -> Column:
    """F1 of the longest common subsequence of words: 1 where both are empty, 0 where one is."""

    def of(w: Column) -> Column:
        x, y = w["a"], w["b"]
        n = lcs(x, y)
        total = F.size(x) + F.size(y)
        return F.when(total == 0, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * n / total)

    return F.transform(F.array(F.struct(_words(a).alias("a"), _words(b).alias("b"))), of)[0]


def token_overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct lower-case words that b has; empty texts are 1 together and 0 apart."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    own, other = F.array_distinct(_words(F.lower(x))), F.array_distinct(_words(F.lower(y)))
    return F.when((x == "") | (y == ""), (x == y).cast("double")).otherwise(F.size(F.array_intersect(own, other)) / F.greatest(F.size(own), F.lit(1)))


def set_scores(got: Column, expected: Column) -> Column:
    """Struct of exact, precision and recall of two sets; nothing expected scores 1 for nothing got, else 0."""
    g, e = F.array_distinct(got), F.array_distinct(expected)
    both, n_g, n_e = F.size(F.array_intersect(g, e)), F.size(g), F.size(e)
    none = (n_g == 0).cast("double")
    return F.struct(
        F.when(n_e == 0, none).otherwise(((both == n_g) & (both == n_e)).cast("double")).alias("exact"),
        F.when(n_e == 0, none).when(n_g == 0, 0.0).otherwise(both / n_g).alias("precision"),
        F.when(n_e == 0, none).otherwise(both / n_e).alias("recall"),
    )


def lcs_length(masks: dict[str, int], n: int, words) -> int:
    """The same length for long texts, a bit a word: ``masks`` has the places of each of the ``n`` words of one text."""
    full = (1 << n) - 1
    row = full
    for w in words:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


@lru_cache(1 << 16)
def _likeness(x: str, y: str) -> float:
    """ROUGE-L of two texts; blanks are the same code points as those of ``RUNS``."""
    a, b = x.split(), y.split()
    if a == b:
        return 1.0
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    return 2.0 * lcs_length(masks, len(a), b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def best_rouge(expected: pd.Series, got: pd.Series) -> pd.Series:
    """Mean over the first side's texts of the best ROUGE-L among the second's; texts of any length."""

    def of(want: list, have: list) -> float:
        total = 0.0
        for x in want:
            total += 1.0 if x in have else max(_likeness(x, y) for y in have)
        return total / len(want)

    return pd.Series([of(x.tolist(), y.tolist()) if x is not None and y is not None and len(x) and len(y) else 0.0 for x, y in zip(expected, got)], dtype=float)


def best_issue_rouge(expected: Column, got: Column) -> Column:
    """Mean over the expected topics of the best ROUGE-L that a predicted topic's issue reaches."""
    texts = lambda topics: F.transform(topics, lambda t: F.coalesce(t["issue"], F.lit("")))
    mean = best_rouge(texts(expected), texts(got))
    return F.when(F.size(expected) == 0, (F.size(got) == 0).cast("double")).when(F.size(got) == 0, 0.0).otherwise(mean)


def grounded(source: Column, value: Column, least: float = 0.6, stem: int = 5) -> Column:
    """Whether at least that share of the value's word set is in the source, as is or by a common stem. Blank is."""
    blank = strip(F.coalesce(value, F.lit(""))) == ""

    def of(w: Column) -> Column:
        s, v = w["s"], w["v"]
        has = lambda t: F.array_contains(s, t) | F.exists(s, lambda x: (F.length(x) >= stem) & (F.length(t) >= stem) & (F.left(x, F.lit(stem)) == F.left(t, F.lit(stem))))
        return F.when((F.size(s) == 0) | (F.size(v) == 0), False).otherwise(F.size(F.filter(v, has)) / F.size(v) >= least)

    return blank | F.transform(F.array(F.struct(word_set(source).alias("s"), word_set(value).alias("v"))), of)[0]


def ungrounded_fields(source: Column, topics: Column) -> Column:
    """Paths of the non-empty fields and attributes that the source does not support."""

    def of(t: Column, i: Column) -> Column:
        at = F.concat(F.lit("topic["), i.cast("string"), F.lit("]"))
        bad = lambda v: (F.coalesce(v, F.lit("")) != "") & ~grounded(source, v)
        fields = [F.when(bad(t[k]), F.concat(at, F.lit("." + k))) for k in ("object", "requested_action")]
        attrs = F.transform(F.filter(F.coalesce(F.map_values(t["attributes"]), F.array().cast("array<string>")), bad), lambda v: F.concat(at, F.lit(".attributes:"), F.left(v, F.lit(30))))
        return F.concat(F.array_compact(F.array(*fields)), attrs)

    return F.flatten(F.transform(topics, of))


def hallucinated(target: Column, predicted: Column, source: Column) -> Column:
    """Whether the first prediction fills a field that the target leaves empty, or shares next to no word with the source."""
    blank = lambda x: strip(F.coalesce(x, F.lit(""))) == ""
    invented = F.lit(False)
    for k in ("object", "requested_action"):
        invented = invented | (blank(target[k]) & ~blank(predicted[k]))
    issue, src = F.coalesce(predicted["issue"], F.lit("")), F.coalesce(source, F.lit(""))
    return predicted.isNotNull() & (invented | ((src != "") & (issue != "") & (token_overlap(src, issue) < 0.01)))


def boilerplate_leak(topics: Column, pattern: str) -> Column:
    """Whether a sentence of any issue matches."""
    return F.exists(topics, lambda t: F.exists(sentences(t["issue"]), lambda s: s.rlike(pattern)))


def action_redundant(topics: Column) -> Column:
    """Whether a topic's action is part of its own issue."""
    own = lambda t, k: strip(F.coalesce(t[k], F.lit("")))
    return F.exists(topics, lambda t: (own(t, "requested_action") != "") & F.contains(own(t, "issue"), own(t, "requested_action")))


def whole_sentence(action: Column, text: Column) -> Column:
    """Whether a non-empty action is exactly one of the text's sentences."""
    return (F.coalesce(action, F.lit("")) != "") & F.exists(sentences(text), lambda s: s == action)


def first_domain(topics: Column) -> Column:
    return F.when(F.coalesce(F.size(topics), F.lit(0)) < 1, "NO_TOPIC").otherwise(F.coalesce(F.get(topics, F.lit(0))["domain"], F.lit("")))


def case_columns(leak: str, domains=DOMAINS, likeness: Column | None = None) -> list[Column]:
    """Scores of a case of expected and topics (arrays of topics), text, parsed and schema_ok; ``likeness`` is
    ``best_issue_rouge`` of the two where it is known."""
    got, want = F.transform("topics", lambda t: F.coalesce(t["domain"], F.lit(""))), F.transform("expected", lambda t: F.coalesce(t["domain"], F.lit("")))
    s = set_scores(got, want)
    likeness = best_issue_rouge(F.col("expected"), F.col("topics")) if likeness is None else likeness
    return [
        F.length("text").alias("text_len"),
        F.col("parsed").alias("json_ok"),
        (F.col("parsed") & F.col("schema_ok")).alias("schema_ok"),
        F.size("expected").alias("expected_topic_count"),
        F.size("topics").alias("predicted_topic_count"),
        (F.size("expected") == F.size("topics")).alias("topic_count_ok"),
        s["exact"].alias("domain_set_exact"),
        s["precision"].alias("domain_set_precision"),
        s["recall"].alias("domain_set_recall"),
        likeness.alias("issue_rouge_l_best"),
        boilerplate_leak(F.col("topics"), leak).alias("boilerplate_leak"),
        action_redundant(F.col("topics")).alias("action_redundant"),
        F.exists(got, lambda d: ~d.isin(*domains)).alias("out_of_enum_domain"),
        (F.size(got) != F.size(F.array_distinct(got))).alias("duplicate_domain"),
    ]


def per_case(df: DataFrame, leak: str, domains=DOMAINS) -> DataFrame:
    """Scores of each case. ``df``: id, category, text, expected and topics (arrays of topics), parsed and schema_ok."""
    return df.select("id", "category", *case_columns(leak, domains))


#: Metric of a suite: column of the per-case scores.
SUITE = {
    "schema_validity_rate": "schema_ok",
    "topic_count_accuracy": "topic_count_ok",
    "domain_set_exact": "domain_set_exact",
    "domain_set_precision": "domain_set_precision",
    "domain_set_recall": "domain_set_recall",
    "issue_rouge_l_best": "issue_rouge_l_best",
    "boilerplate_leak_rate": "boilerplate_leak",
    "action_redundancy_rate": "action_redundant",
    "out_of_enum_rate": "out_of_enum_domain",
    "duplicate_domain_rate": "duplicate_domain",
}


def suite_means(scored: DataFrame, *by: str, digits: int = 4) -> DataFrame:
    """n and the mean of every score, over all cases or by groups."""
    means = [F.round(F.avg(F.col(c).cast("double")), digits).alias(m) for m, c in SUITE.items()]
    return scored.groupBy(*by).agg(F.count("*").alias("n"), *means) if by else scored.agg(F.count("*").alias("n"), *means)


#: Failure classes in order; the first that holds names the case.
FAILURES = (
    ("not_json", "NOT json_ok"),
    ("bad_schema", "json_ok AND NOT schema_ok"),
    ("out_of_enum", "out_of_enum_domain"),
    ("duplicate_domain", "duplicate_domain"),
    ("topic_count", "schema_ok AND NOT topic_count_ok"),
    ("domain_missed", "topic_count_ok AND domain_set_exact < 1 AND domain_set_recall < 1"),
    ("domain_invented", "topic_count_ok AND domain_set_exact < 1 AND domain_set_precision < 1"),
    ("boilerplate_leak", "boilerplate_leak"),
    ("action_copy", "action_redundant"),
)


def failure() -> Column:
    out = None
    for name, condition in FAILURES:
        out = F.when(F.expr(condition), name) if out is None else out.when(F.expr(condition), name)
    return out


def taxonomy(scored: DataFrame) -> DataFrame:
    """Counts of failure classes (null: clean), overall and by category in one rollup (null category: overall)."""
    return scored.withColumn("failure", failure()).rollup("category", "failure").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).where("level <> 1 or failure is not null")


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio of two arrays of words; 0 where one is empty."""
    return pd.Series([difflib.SequenceMatcher(None, list(x), list(y)).ratio() if x is not None and y is not None and len(x) and len(y) else 0.0 for x, y in zip(a, b)])


def word_ratio(a: Column, b: Column) -> Column:
    return matching_ratio(plain_words(a), plain_words(b))


def _alike(x: list, y: list, least: float) -> bool:
    """Whether the matching-blocks ratio of two rows of words reaches ``least``. No ratio is above the share of common words,
    so rows with few of them are told without blocks."""
    if not len(x) or not len(y):
        return 0.0 >= least
    left, common = Counter(x), 0
    for w in y:
        if left[w] > 0:
            left[w] -= 1
            common += 1
    return 2.0 * common / (len(x) + len(y)) >= least and difflib.SequenceMatcher(None, x, y).ratio() >= least


def _both_alike(least: float):
    @F.pandas_udf(BooleanType())
    def alike(words: pd.Series, others: pd.Series) -> pd.Series:
        """Whether two of the others' rows of words are like the first side's; null is no."""

        def of(x, ys) -> bool:
            own, n = list(x), 0
            for y in ys:
                n += y is not None and _alike(own, list(y), least)
                if n >= 2:
                    return True
            return False

        return pd.Series([x is not None and ys is not None and of(x, ys) for x, ys in zip(words, others)], dtype=bool)

    return alike


def behaviour(df: DataFrame, least: float = 0.30) -> DataFrame:
    """Adds ``behaviour`` of predictions for cases with two expected topics: JSONFAIL, OVER, SPLIT, MERGE or STOP.

    ``df``: id, expected, topics (null where not parsed). Fewer topics than expected merge where the first issue is
    like both expected ones, else they stop; an empty list stops. Issues are compared only where they decide.
    """
    first = F.get("topics", F.lit(0))["issue"]
    n, m = F.size("topics"), F.size("expected")
    asked = F.col("topics").isNotNull() & (n >= 1) & (n < m)
    wanted = F.when(asked, F.transform("expected", lambda e: plain_words(e["issue"])))
    both = _both_alike(least)(F.when(asked, plain_words(first)), wanted)
    told = F.when(F.col("topics").isNull(), "JSONFAIL").when(n > m, "OVER").when(n == m, "SPLIT").when(both, "MERGE").otherwise("STOP")
    return df.withColumn("behaviour", told)


def covered_domains(expected: Column, got: Column, accepts: Column) -> Column:
    """Struct of uncovered expected names and extra domains. ``accepts``: map of a name to the domains that cover it."""
    ok = lambda e: F.coalesce(accepts[e], F.array(e))
    allowed = F.flatten(F.transform(expected, ok))
    return F.struct(F.filter(expected, lambda e: ~F.arrays_overlap(ok(e), got)).alias("uncovered"), F.sort_array(F.array_except(got, allowed)).alias("extra"))


def scan_sentences(texts: Column, pattern: str) -> Column:
    """Sentences of an array of texts that match."""
    return F.filter(F.flatten(F.transform(texts, sentences)), lambda s: s.rlike(pattern))


def structure(df: DataFrame) -> DataFrame:
    """Structural features of cases with expected topics: objects, domains, actions and length."""
    norm = lambda x: normalize(x)
    a, b = F.get("expected", F.lit(0)), F.get("expected", F.lit(1))
    two = F.size("expected") == 2
    obj = (norm(a["object"]), norm(b["object"]))
    acts = F.size(F.filter("expected", lambda t: strip(F.coalesce(t["requested_action"], F.lit(""))) != ""))
    return df.select(
        "id",
        (two & (obj[0] != "") & (obj[0] == obj[1])).alias("same_object"),
        (two & ((obj[0] == "") | (obj[1] == "") | (obj[0] != obj[1]))).alias("different_object"),
        (two & (norm(a["domain"]) != "") & (norm(a["domain"]) == norm(b["domain"]))).alias("same_domain"),
        (two & (norm(a["domain"]) != norm(b["domain"]))).alias("different_domain"),
        (acts >= 2).alias("multi_action"),
        (acts >= 1).alias("action_present"),
        (F.length("text") < 200).alias("short_text"),
        F.length("text").alias("text_len"),
    )




#: What joins a second problem expressly, any conjunction, and ends of sentences and clauses.
ADDITIVE = r"(?iu)(?:а також|і також|та також|и також|а ще|і ще|та ще)"
COORDINATE = rf"(?iu)(?:^|[{WS},])[іта](?=[{WS},])"
CLAUSE_END = r"[.!?;:\n]+"


def mechanism(df: DataFrame, additive: str = ADDITIVE, coordinate: str = COORDINATE, boundary=("D",), inline=("B", "C")) -> DataFrame:
    """All features of cases (id, category, text, expected): those of ``structure`` and how the two problems are joined, where
    the sentence ends, and how alike the issues are (three digits)."""
    a, b = F.get("expected", F.lit(0))["issue"], F.get("expected", F.lit(1))["issue"]
    parts = F.size(F.filter(F.split("text", CLAUSE_END), lambda s: strip(s) != "")).cast("long")
    like = df.select(F.col("id").alias("__gm_id"), F.round(word_ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), 3).alias("issue_sim"))
    told = df.select(
        F.col("id").alias("__gm_id"), "category", F.col("text").rlike(additive).alias("explicit_additive_marker"), F.col("text").rlike(coordinate).alias("coord_conjunction"), F.col("category").isin(*boundary).alias("boundary_marked"),
        F.col("category").isin(*inline).alias("inline"), parts.alias("sentences"), (parts >= 2).alias("punct_boundary"),
    )
    both = structure(df).join(told, F.col("id") == F.col("__gm_id")).drop("__gm_id").join(like, F.col("id") == F.col("__gm_id")).drop("__gm_id")
    return both.withColumn("second_similar", F.col("issue_sim") >= 0.30).withColumn("issue_sim_ge_60", F.col("issue_sim") >= 0.60)
