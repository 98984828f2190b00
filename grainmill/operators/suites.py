"""Metrics of evaluation suites over generations: one-topic and many-topic suites, smoke checks, faithful aggregates.

A prediction is a row with an id, the source text, the expected topics, the raw generation, and what was read of it:
``parsed`` (it is a JSON object), ``topics`` (empty where there are none) and ``schema_ok``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from . import reconcile, scoring
from .scoring import TOPIC


def typed(topic: Column) -> Column:
    """A topic variant as a struct; what has another type is null."""
    return _whole(F.try_variant_get(topic, "$", TOPIC.simpleString()))


def _whole(t: Column) -> Column:
    """A topic of a typed array: one that is no object has null fields, attributes are never null."""
    return F.struct(*[t[k].alias(k) for k in TOPIC.names[:-1]], F.coalesce(t["attributes"], F.create_map().cast("map<string,string>")).alias("attributes")).cast(TOPIC)


#: The schema of topics whose fields are all strings; names that need quotes and nested attributes are left to the full check.
_PLAIN = r"\AARRAY<OBJECT<attributes: OBJECT<(?:\w+: [A-Z]+(?:, \w+: [A-Z]+)*)?>, domain: STRING, issue: STRING, object: STRING, requested_action: STRING>>\z"


def _fine(topics: Column, raw: Column) -> Column:
    """Whether all topics keep the contract. Types are told from one schema of all topics and presence from the typed fields;
    what these two leave open is checked topic by topic."""
    plain = F.schema_of_variant(raw).rlike(_PLAIN)
    told = lambda t: t["domain"].isNotNull() & t["issue"].isNotNull() & t["object"].isNotNull() & t["requested_action"].isNotNull() & t["attributes"].isNotNull()
    whole = F.forall(topics, lambda t: told(t) & t["domain"].isin(*scoring.DOMAINS) & (strip(t["issue"]) != ""))
    each = F.forall(F.try_variant_get(raw, "$", "array<variant>"), lambda t: F.size(reconcile.topic_errors(t)) == 0)
    return F.coalesce(topics.isNotNull() & (F.coalesce(whole & plain, F.lit(False)) | each), F.lit(False))


#: A generation as models write it: topics of the five fields in order, texts without escapes, no attribute or one. Names
#: occur once, so whatever reads such a text reads the same; a longer text is left to the full reading.
_QUOTED = r'"[^"\\\x00-\x1f]*+"'
_FIELD = lambda name: f'"{name.replace("_", "[_]")}":[ ]?+'
_TOPIC = r"\{" + "".join(f"{_FIELD(k)}{_QUOTED},[ ]?+" for k in TOPIC.names[:-1]) + _FIELD(TOPIC.names[-1]) + rf"\{{(?:{_QUOTED}:[ ]?+{_QUOTED})?+\}}\}}"
_WRITTEN = rf'\A\{{"topics":[ ]?+\[(?:{_TOPIC}(?:,[ ]?+{_TOPIC})*+)?+\]\}}\z'
_LONG = 1_000_000


def read(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds parsed, topics and schema_ok of a generation: from its first opening to its last closing brace.

    A text as models write it (one look tells) is typed at once. Any other is parsed once, and all topics are typed in one
    pass; they are made anew only where one of them is no object or has no attributes. What was parsed is a generated column,
    so that neither a filter nor a further use repeats the parsing and what is below.
    """
    topics = f"array<{TOPIC.simpleString()}>"
    plain = F.coalesce((F.length(raw) <= _LONG) & F.col(raw).rlike(_WRITTEN), F.lit(False))
    own = df.select("*", F.explode_outer(F.array(plain)).alias("__gm_p"))
    own = own.select("*", F.explode_outer(F.array(F.when(~F.col("__gm_p"), reconcile.strict_array(reconcile.braced(F.col(raw)))))).alias("__gm_w"))
    typed_once = F.from_json(raw, f"topics {topics}")["topics"]
    own = own.withColumn("__gm_t", F.when(F.col("__gm_p"), typed_once).otherwise(F.try_variant_get("__gm_w", "$[0].topics", topics)))
    got = F.col("__gm_t")
    ready = F.col("__gm_p") | F.forall(got, lambda t: t["attributes"].isNotNull())
    whole = F.when(got.isNull(), F.array().cast(topics)).when(ready, got).otherwise(F.transform(got, _whole))
    named = F.forall(got, lambda t: t["domain"].isin(*scoring.DOMAINS) & (strip(t["issue"]) != ""))
    # bound, so that the variant of topics is made once
    fine = F.transform(F.array(F.struct(got.alias("t"), F.try_variant_get("__gm_w", "$[0].topics", "variant").alias("raw"))), lambda x: _fine(x["t"], x["raw"]))[0]
    parsed = F.col("__gm_p") | F.try_variant_get("__gm_w", "$[0]", "struct<>").isNotNull()
    return own.withColumns({"parsed": parsed, "topics": whole, "schema_ok": F.when(F.col("__gm_p"), named).otherwise(fine)}).drop("__gm_p", "__gm_w", "__gm_t")


def reference_predictions(cases: DataFrame, expected: str = "expected") -> DataFrame:
    """Cases as their own predictions: the ceiling of the metrics, and their floor where the reference is a weak label."""
    raw = F.to_json(F.struct(F.col(expected).alias("topics")))
    return cases.withColumn("raw", raw).withColumn("parsed", F.lit(True)).withColumn("topics", F.col(expected)).withColumn("schema_ok", F.lit(True))


def targets_of_chats(chats: DataFrame) -> DataFrame:
    """(uid, text, expected) of three-message examples: the user's turn and the topics of the assistant's."""
    turn = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"]
    topics = reconcile.topics_of(turn("assistant"))
    return chats.select("uid", strip(turn("user")).alias("text"), F.transform(topics, typed).alias("expected"))


def _share(flag: Column, digits: int = 4) -> Column:
    return F.round(F.avg(flag.cast("double")), digits)


def one_topic_columns() -> list[Column]:
    """Values of the one-topic suite: the first predicted topic against the first expected one."""
    t, p = F.get("expected", F.lit(0)), F.get("topics", F.lit(0))
    text = lambda x, k: F.coalesce(x[k], F.lit(""))
    obj, got = text(t, "object"), text(p, "object")
    words = lambda x: F.array(F.struct(x.alias("issue")))
    wants, has = text(t, "requested_action") != "", text(p, "requested_action") != ""
    return [
        F.col("parsed").alias("json_parse_rate"),
        F.col("schema_ok").alias("schema_validity_rate"),
        F.coalesce(t["domain"], F.lit("other")).alias("true_domain"),
        scoring.first_domain(F.col("topics")).alias("predicted_domain"),
        (F.coalesce(t["domain"], F.lit("other")) == scoring.first_domain(F.col("topics"))).alias("domain_accuracy"),
        scoring.best_issue_rouge(words(text(t, "issue")), words(text(p, "issue"))).alias("issue_rouge_l"),
        (F.lower(obj) == F.lower(got)).alias("object_exact"),
        scoring.token_overlap(obj, got).alias("object_token_overlap"),
        ((obj != "") != (got != "")).alias("object_mismatch_discriminator"),
        wants.alias("action_presence_target"),
        has.alias("action_presence_pred"),
        (wants == has).alias("action_presence_match"),
        F.coalesce(scoring.hallucinated(t, p, F.col("text")), F.lit(False)).alias("hallucination_rate"),
        (F.size("topics") >= 2).alias("multi_topic_rate"),
    ]


def one_topic_cases(df: DataFrame) -> DataFrame:
    """Per-case values of the one-topic suite."""
    return df.select(*[c for c in df.columns if c in ("arm", "id", "uid")], *one_topic_columns())


MEANS = (
    "json_parse_rate", "schema_validity_rate", "domain_accuracy", "issue_rouge_l", "object_exact", "object_token_overlap", "object_mismatch_discriminator", "action_presence_target",
    "action_presence_pred", "action_presence_match", "hallucination_rate", "multi_topic_rate",
)


def macro_f1(df: DataFrame, true: str, predicted: str, *by: str) -> DataFrame:
    """(by, value): F1 averaged over the classes that are true somewhere. One pass: each row counts for both its classes."""
    sides = F.explode(F.array(F.struct(F.col(true).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    hit = (F.col(true) == F.col(predicted)).cast("int").alias("hit")
    each = df.select(*by, sides.alias("s"), hit).groupBy(*by, "s.c").agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum(F.col("hit") * F.col("s.t")).alias("tp"))
    f1 = 2 * F.col("tp") / (F.col("t") + F.col("p"))
    return each.where("t > 0").groupBy(*by).agg(F.avg(f1).alias("value"))


def one_topic_metrics(df: DataFrame, *by: str, digits: int = 4) -> DataFrame:
    """n and the fourteen metrics of the one-topic suite, over all predictions or by groups."""
    return one_topic_summary(one_topic_cases(df), *by, digits=digits)


def one_topic_summary(cases: DataFrame, *by: str, digits: int = 4, metrics=MEANS) -> DataFrame:
    """n, means of per-case values and the macro F1 of domains, all from one pass: cases are summed by their two classes,
    then by class, where a pair counts for both and its sums for the true one."""
    value = lambda c: F.col(c).cast("double")
    sums = [x for i, c in enumerate(metrics) for x in (F.sum(value(c)).alias(f"s{i}"), F.count(value(c)).alias(f"c{i}"))]
    cells = cases.groupBy(*by, "true_domain", "predicted_domain").agg(F.count("*").alias("n"), *sums)
    none = F.lit(0).cast("long")
    hit = F.when(F.col("true_domain") == F.col("predicted_domain"), F.col("n")).otherwise(none)
    parts = [x for i, _ in enumerate(metrics) for x in (f"s{i}", f"c{i}")]
    own = F.struct(F.col("true_domain").alias("c"), F.col("n").alias("t"), none.alias("p"), hit.alias("tp"), *parts)
    other = F.struct(F.col("predicted_domain").alias("c"), none.alias("t"), F.col("n").alias("p"), none.alias("tp"), *[F.lit(None).cast("double" if x[0] == "s" else "long").alias(x) for x in parts])
    each = cells.select(*by, F.explode(F.array(own, other)).alias("x")).select(*by, "x.*").groupBy(*by, "c").agg(*[F.sum(x).alias(x) for x in ("t", "p", "tp", *parts)])
    f1 = F.avg(F.when(F.col("t") > 0, 2 * F.col("tp") / (F.col("t") + F.col("p"))))
    means = [F.round(F.sum(f"s{i}") / F.nullif(F.sum(f"c{i}"), F.lit(0)), digits).alias(c) for i, c in enumerate(metrics)]
    return each.groupBy(*by).agg(F.coalesce(F.sum("t"), none).alias("n"), *means, F.round(f1, digits).alias("domain_macro_f1"))


def many_topic_columns(likeness: Column | None = None) -> list[Column]:
    """Values of the many-topic suite: counts, sets of domains, and each expected topic's best issue likeness, of which
    ``likeness`` is the mean where it is known."""
    domains = lambda c: F.array_distinct(F.transform(c, lambda t: F.coalesce(t["domain"], F.lit(""))))
    want, got = domains("expected"), domains("topics")
    both = F.size(F.array_intersect(want, got))
    likeness = scoring.best_issue_rouge(F.col("expected"), F.col("topics")) if likeness is None else likeness
    return [
        F.col("parsed"),
        F.col("schema_ok"),
        F.size("expected").alias("target_n"),
        F.size("topics").alias("pred_n"),
        F.sort_array(want).alias("target_domains"),
        F.sort_array(got).alias("pred_domains"),
        (F.sort_array(want) == F.sort_array(got)).alias("domain_set_exact"),
        F.when(F.size(got) > 0, both / F.size(got)).otherwise(0.0).alias("precision"),
        F.when(F.size(want) > 0, both / F.size(want)).otherwise(0.0).alias("recall"),
        F.when(F.size("topics") == 0, 0.0).otherwise(likeness * F.size("expected")).alias("rouge_sum"),
    ]


def many_topic_cases(df: DataFrame) -> DataFrame:
    """Per-case values of the many-topic suite."""
    return df.select(*[c for c in df.columns if c in ("arm", "id", "uid")], *many_topic_columns())


def many_topic_metrics(df: DataFrame, *by: str, digits: int = 4) -> DataFrame:
    """Metrics of the many-topic suite. Exact sets count over all cases, recall over those with two topics or more, and
    the issue likeness over expected topics; without a case of two topics the recall is null."""
    return many_topic_summary(many_topic_cases(df), *by, digits=digits)


def many_topic_summary(cases: DataFrame, *by: str, digits: int = 4) -> DataFrame:
    several = F.col("target_n") >= 2
    return cases.groupBy(*by).agg(
        F.count("*").alias("n"),
        _share(F.col("parsed"), digits).alias("json_parse_rate"),
        _share(F.col("schema_ok"), digits).alias("schema_validity_rate"),
        _share(F.col("target_n") == F.col("pred_n"), digits).alias("topic_count_accuracy"),
        F.round(F.count_if(several & (F.col("pred_n") >= 2)) / F.nullif(F.count_if(several), F.lit(0)), digits).alias("multi_topic_recall"),
        _share(F.col("domain_set_exact"), digits).alias("domain_set_exact"),
        F.round(F.avg("precision"), digits).alias("domain_set_precision"),
        F.round(F.avg("recall"), digits).alias("domain_set_recall"),
        F.round(F.sum("rouge_sum") / F.nullif(F.sum("target_n"), F.lit(0)), digits).alias("issue_rouge_l_best"),
    )


def faithful(cases: DataFrame, recorded: DataFrame, metrics, *by: str, digits: int = 4) -> DataFrame:
    """(by, metric, recorded, recomputed, faithful): whether means over cases reproduce recorded figures as rounded.

    ``recorded``: by, metric, value; a metric that nobody recorded isn't faithful.
    """
    means = F.create_map(*[x for m in metrics for x in (F.lit(m), F.avg(F.col(m).cast("double")))])
    own = cases.groupBy(*by).agg(means.alias("m")).select(*by, F.explode("m").alias("metric", "mean"))
    both = own.join(recorded.withColumnRenamed("value", "recorded"), [*by, "metric"], "left")
    ok = F.coalesce(F.round("mean", digits) == F.col("recorded"), F.lit(False))
    return both.select(*by, "metric", "recorded", F.round("mean", 6).alias("recomputed"), ok.alias("faithful"))


def filled(topics: Column, *names: str) -> Column:
    """Whether a topic has one of these fields non-blank."""
    blank = lambda x: strip(F.coalesce(x, F.lit(""))) == ""
    return F.coalesce(F.exists(topics, lambda t: ~F.forall(F.array(*[t[k] for k in names]), blank)), F.lit(False))


def has_attributes(topics: Column) -> Column:
    return F.coalesce(F.exists(topics, lambda t: F.exists(F.map_values(t["attributes"]), lambda v: strip(F.coalesce(v, F.lit(""))) != "")), F.lit(False))


def field_text(value: Column) -> Column:
    """A field that may be a text or an object of values (a variant): the text, or the values joined by blanks."""
    kind = F.schema_of_variant(value)
    joined = F.array_join(F.transform(F.map_values(value.try_cast("map<string,variant>")), lambda v: F.coalesce(v.try_cast("string"), F.lit(""))), " ")
    return F.when(value.isNull() | (kind == "VOID"), "").when(kind.startswith("OBJECT"), joined).otherwise(F.coalesce(value.try_cast("string"), F.lit("")))


def smoke(cases: DataFrame, results: DataFrame, accepts: Column, key: str = "id") -> DataFrame:
    """Smoke cases with their results and a verdict each: (id, category, predicted, uncovered, extra, fields, attributes,
    passed). ``cases``: id, category, expected_domains; ``results``: id, topics, schema_ok. A case passes when its output is
    valid, every expected domain is covered, nothing else is there and a field is filled."""
    both = cases.join(results, key)
    got = F.array_distinct(F.transform("topics", lambda t: t["domain"]))
    both = both.withColumn("predicted", got).withColumn("__gm_c", scoring.covered_domains(F.col("expected_domains"), F.col("predicted"), accepts))
    fields, attributes = filled(F.col("topics"), "issue", "object", "requested_action"), has_attributes(F.col("topics"))
    ok = F.col("schema_ok") & (F.size("__gm_c.uncovered") == 0) & (F.size("__gm_c.extra") == 0) & fields
    return both.select(key, "category", "predicted", F.col("__gm_c.uncovered").alias("uncovered"), F.col("__gm_c.extra").alias("extra"), fields.alias("fields"), attributes.alias("attributes"), F.size("topics").alias("n_topics"), "schema_ok", ok.alias("passed"))


def smoke_card(verdicts: DataFrame, several: str = "Multi-Topic", *by: str) -> DataFrame:
    """Counts of a smoke suite: cases, valid, covered, with extras, passed, and those of the many-topic category that got
    two topics or more."""
    many = F.col("category") == several
    return verdicts.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if("schema_ok").alias("valid"),
        F.count_if(F.size("uncovered") == 0).alias("covered"),
        F.count_if(F.size("extra") > 0).alias("with_extra"),
        F.count_if("passed").alias("passed"),
        F.count_if(many).alias("several"),
        F.count_if(many & (F.col("n_topics") >= 2)).alias("several_ok"),
    )


def in_all_arms(df: DataFrame, arms: list[str], key: str = "id", arm: str = "arm") -> DataFrame:
    """Keys that every one of the arms has, in one pass."""
    return df.where(F.col(arm).isin(*arms)).groupBy(key).agg(F.countDistinct(arm).alias("__gm_n")).where(F.col("__gm_n") == len(set(arms))).select(key)


def flag(value: Column) -> Column:
    """true, false or null (not recorded) of a variant that should be a boolean; anything else that is there is an error."""
    got = F.try_variant_get(value, "$", "boolean")
    odd = value.isNotNull() & ~F.is_variant_null(value) & (F.schema_of_variant(value) != "BOOLEAN")
    return F.when(odd, F.raise_error(F.concat(F.lit("not a flag: "), value.cast("string"))).cast("boolean")).otherwise(got)
