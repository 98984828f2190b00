"""Requested actions in corpora and predictions: rates, omissions, inventions, copies, and what quotes do to outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences, squash, strip
from . import scoring

#: Markers of an explicit request in a complaint.
REQUEST_MARKERS = r"(?iu)(прошу|просить|проха|вжити заход|вжити заходів|необхідно вжити|організувати|зобов'язати)"


def _text(x: Column) -> Column:
    return strip(F.coalesce(x, F.lit("")))


def acts(topics: Column) -> Column:
    """The topics' actions, stripped, empty ones too."""
    return F.transform(topics, lambda t: _text(t["requested_action"]))


def any_action(topics: Column) -> Column:
    return F.coalesce(F.exists(acts(topics), lambda a: a != ""), F.lit(False))


def rate(df: DataFrame, *by: str, topics: str = "topics", digits: int = 4) -> DataFrame:
    """n, rows with an action and their share; rows without a payload (null topics) don't count, which the counts tell, so
    that topics aren't made once for a filter and once more behind it."""
    there, some = F.col(topics).isNotNull(), any_action(F.col(topics))
    told = df.groupBy(*by).agg(F.count_if(there).alias("n"), F.count_if(some).alias("with_action"), F.round(F.avg(F.when(there, some.cast("int"))), digits).alias("rate"))
    return told.where("n > 0") if by else told


def disagreement(df: DataFrame, *by: str) -> DataFrame:
    """Agreement on whether there is an action, between the first expected and the first predicted topic: counts of
    agreements, of actions omitted and of actions invented."""
    first = lambda c: _text(F.get(c, F.lit(0))["requested_action"]) != ""
    wants, has = first("expected"), first("topics")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(wants == has).alias("agree"), F.count_if(wants & ~has).alias("omitted"), F.count_if(has & ~wants).alias("invented"))


def inventions(df: DataFrame, category: str, *by: str) -> DataFrame:
    """Cases of a category that asks for nothing, how many predictions invent an action, and their ids (a category's cases
    are few)."""
    invented = any_action(F.col("topics"))
    return df.where(F.col("category") == category).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(invented).alias("invented"), F.sort_array(F.collect_list(F.when(invented, F.col("id")))).alias("ids"))


def by_bucket(df: DataFrame, *by: str, bucket: str = "behaviour", digits: int = 4) -> DataFrame:
    """By behaviour: n, the share of predictions with an action, and the mean number of topics' actions, empty ones too."""
    return df.groupBy(*by, bucket).agg(F.count("*").alias("n"), F.round(F.avg(any_action(F.col("topics")).cast("int")), digits).alias("any_action"), F.round(F.avg(F.size(acts(F.col("topics")))), digits).alias("mean_actions"))


def by_regime(df: DataFrame, *by: str, digits: int = 4) -> DataFrame:
    """Action rate by suite, arm and expected number of topics; predictions without topics don't count."""
    own = df.where(F.size("topics") > 0).withColumn("regime", F.size("expected"))
    return own.groupBy(*by, "regime").agg(F.count("*").alias("n"), F.count_if(any_action(F.col("topics"))).alias("nonempty"), F.round(F.avg(any_action(F.col("topics")).cast("int")), digits).alias("rate"))


def label_audit(cases: DataFrame, category: str, markers: str = REQUEST_MARKERS) -> DataFrame:
    """(id, marker, excerpt): cases of a category without requests whose text holds a marker all the same and whose label
    is empty; the excerpt reaches 60 characters back and 120 on."""
    marker = F.regexp_extract("text", markers, 0)
    at = F.regexp_instr("text", F.lit(markers))
    start = F.greatest(at - 60, F.lit(1))
    found = cases.where((F.col("category") == category) & F.col("text").rlike(markers) & ~any_action(F.col("expected")))
    return found.select("id", marker.alias("marker"), F.substring(F.col("text"), start, at + 120 - start).alias("excerpt"))


def copied(topics: Column, text: Column) -> Column:
    """Whether a predicted action, squashed and of eight characters or more, is a part of the source. The source is squashed
    once a row, and only where there is such an action."""
    long = F.filter(F.transform(topics, lambda t: squash(t["requested_action"])), lambda a: F.length(a) >= 8)
    within = lambda w: F.when(F.size(w) > 0, F.transform(F.array(squash(text)), lambda s: F.exists(w, lambda a: F.contains(s, a)))[0])
    return F.coalesce(F.transform(F.array(long), within)[0], F.lit(False))


def copy_rate(df: DataFrame, *by: str, digits: int = 4) -> DataFrame:
    """cases, copies and their share; a prediction without topics is no copy."""
    hit = copied(F.col("topics"), F.col("text"))
    return df.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if(hit).alias("n_copied"), F.round(F.avg(hit.cast("int")), digits).alias("rate"))


def composition(df: DataFrame, *by: str, real: str = "MT-REAL", digits: int = 4) -> DataFrame:
    """Composition of slices (uid, text, topics): examples, topics, many-topic and real rows, actions, and those that are a
    whole sentence of the text."""
    action = lambda t: F.coalesce(t["requested_action"], F.lit(""))
    n, some = F.size("topics"), F.size(F.filter("topics", lambda t: action(t) != ""))
    whole = F.size(F.filter("topics", lambda t: scoring.whole_sentence(action(t), F.col("text"))))
    is_real = F.split("uid", "#")[0].startswith(real)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_examples"),
        F.sum(n).alias("n_topics"),
        F.count_if(n >= 2).alias("n_multi"),
        F.count_if(is_real).alias("n_real"),
        F.round(F.avg(is_real.cast("int")), digits).alias("real_share"),
        F.sum(some).alias("n_action"),
        F.coalesce(F.round(F.sum(some) / F.nullif(F.sum(n), F.lit(0)), digits), F.lit(0.0)).alias("action_share"),
        F.sum(whole).alias("n_whole"),
        F.coalesce(F.round(F.sum(whole) / F.nullif(F.sum(some), F.lit(0)), digits), F.lit(0.0)).alias("whole_share"),
    )


def exposure(df: DataFrame, tokens: Column, stream: str = "stream", digits: int = 4) -> DataFrame:
    """Rows, tokens and their shares by stream; ``tokens``: how many a row's target has."""
    told = df.groupBy(stream).agg(F.count("*").alias("rows"), F.sum(tokens).alias("tokens"))
    total = told.agg(F.sum("rows").alias("all_rows"), F.sum("tokens").alias("all_tokens"))  # one row
    share = lambda a, b: F.coalesce(F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), digits), F.lit(0.0))
    return told.crossJoin(F.broadcast(total)).select(stream, "rows", "tokens", share("rows", "all_rows").alias("row_share"), share("tokens", "all_tokens").alias("token_share"))


def style(df: DataFrame, *by: str, digits: int = 4) -> DataFrame:
    """How references say things: share of topics whose action is a part of the issue, is one of its sentences, and whose
    issue the text holds as it is."""
    each = df.select(*by, "text", F.explode("topics").alias("t")).withColumn("a", _text(F.col("t.requested_action"))).withColumn("i", _text(F.col("t.issue")))
    some = F.col("a") != ""
    ratio = lambda c: F.coalesce(F.round(F.count_if(c) / F.nullif(F.count_if(some), F.lit(0)), digits), F.lit(0.0))
    return each.groupBy(*by).agg(
        F.count("*").alias("n_topics"),
        F.count_if(some).alias("n_action"),
        ratio(some & F.contains(F.col("i"), F.col("a"))).alias("in_issue"),
        ratio(some & F.exists(sentences(F.col("i")), lambda s: strip(s) == F.col("a"))).alias("is_sentence"),
        F.round(F.avg(((F.col("i") != "") & F.contains(F.col("text"), F.col("i"))).cast("int")), digits).alias("verbatim"),
    )


def quote_artefacts(df: DataFrame, text: str, *by: str) -> DataFrame:
    """Examples, those with two adjacent quotation marks, and the marks in all."""
    n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit('""'))
    return df.groupBy(*by).agg(F.count("*").alias("examples"), F.count_if(n > 0).alias("examples_with"), F.sum(n).cast("long").alias("occurrences"))


def artefact_outcomes(affected: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(arm, affected, passed, other, other_passed): how the cases with an artefact fare in each arm, and the others.

    ``affected``: id; ``outcomes``: arm, id, ok.
    """
    hit = affected.select("id").distinct().withColumn("__gm_hit", F.lit(True))
    both = outcomes.join(hit, "id", "left").withColumn("__gm_hit", F.coalesce("__gm_hit", F.lit(False)))
    yes = F.col("__gm_hit")
    return both.groupBy("arm").agg(F.count_if(yes).alias("affected"), F.count_if(yes & F.col("ok")).alias("passed"), F.count_if(~yes).alias("other"), F.count_if(~yes & F.col("ok")).alias("other_passed"))


def residue(df: DataFrame, detectors: dict[str, str], texts: Column, *by: str) -> DataFrame:
    """(by, detector, rows, hits): rows with a sentence of the texts that a detector's pattern matches; one pass."""
    own = df.withColumn("__gm_s", F.flatten(F.transform(texts, sentences)))
    hits = F.array(*[F.struct(F.lit(k).alias("detector"), F.exists("__gm_s", lambda s: s.rlike(v)).alias("hit")) for k, v in detectors.items()])  # noqa: B023
    each = own.select(*by, F.explode(hits).alias("h"))
    return each.groupBy(*by, F.col("h.detector").alias("detector")).agg(F.count("*").alias("rows"), F.count_if("h.hit").alias("hits"))
