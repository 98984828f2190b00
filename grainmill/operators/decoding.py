"""The decoding matrix: generations by model and setting against their cases and a recorded baseline.

``rows``: model, setting, id, raw, raw_chars, strict_ok, behaviour, predicted_topic_count. ``cases``: id,
expected_topic_count, expected_domains. ``baseline``: model, id, json_ok, schema_ok, expected_topic_count,
predicted_topic_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import repeats_itself
from . import scoring, suites

#: The gates' bounds, and the length from which an input is a long one.
SCHEMA_GATE, COUNT_GATE, LONG_INPUT = 1.0, 0.90, 400


def narrowed(rows: DataFrame, leak: str) -> DataFrame:
    """Rows that have their case's expected_topic_count and expected_domains, with what ``measures`` needs of topics: met (the
    expected domains exactly, repeats count; null where none are expected) and leaks. Topics are read from the raw texts
    where rows have none."""
    both = rows if "topics" in rows.columns else suites.read(rows)
    domains = F.array_sort(F.transform("topics", lambda t: F.coalesce(t["domain"], F.lit(""))))
    met = F.when(F.coalesce(F.size("expected_domains"), F.lit(0)) > 0, F.coalesce(domains == F.array_sort("expected_domains"), F.lit(False)))
    return both.withColumn("met", met).withColumn("leaks", scoring.boilerplate_leak(F.col("topics"), leak))


def measures(rows: DataFrame, cases: DataFrame | None, leak: str | None, *by: str, digits: int = 4) -> DataFrame:
    """n, strict rate, schema failures, topic-count accuracy, JSON failures and mean length by groups; with ``leak`` (the
    pattern of boilerplate) also, from the topics (read from the raw texts where rows have none), the share of cases with expected domains whose domains are met
    exactly (repeats count) and the share of leaks. Rows that are their own cases (``cases`` is None) have
    expected_topic_count and, with ``leak``, are ``narrowed``."""
    if cases is None:
        both = rows
    else:
        both = rows.drop("expected_topic_count", "expected_domains").join(cases.select("id", "expected_topic_count", "expected_domains"), "id", "left")
        both = both if leak is None else narrowed(both, leak)
    told = [
        F.count("*").alias("n"),
        F.round(F.avg(F.col("strict_ok").cast("double")), digits).alias("strict_ok"),
        F.count_if(~F.col("strict_ok")).alias("schema_fail"),
        F.round(F.count_if(F.col("predicted_topic_count") == F.col("expected_topic_count")) / F.count("*"), digits).alias("topic_count_ok"),
        F.count_if(F.col("behaviour") == "JSONFAIL").alias("jsonfail"),
        F.round(F.avg(F.coalesce("raw_chars", F.lit(0))), 1).alias("mean_chars"),
    ]
    if leak is not None:
        exact = F.count_if("met") / F.nullif(F.count("met"), F.lit(0))
        told += [F.round(exact, digits).alias("domain_set_exact"), F.round(F.avg(F.col("leaks").cast("double")), digits).alias("boilerplate_rate")]
    return both.groupBy(*by).agg(*told)


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "behaviour").agg(F.count("*").alias("n"))


def baseline_behaviour(baseline: DataFrame, recorded: DataFrame) -> DataFrame:
    """Adds behaviour, strict_ok and whether the behaviour is recorded; where it isn't, it follows from the flags: a JSON
    failure, more topics than expected, as many, or (merged or stopped, which only the text could tell) stopped."""
    told = baseline.join(recorded.select("model", "id", F.col("behaviour").alias("__gm_b")), ["model", "id"], "left")
    got, want = F.coalesce("predicted_topic_count", F.lit(0)), F.coalesce("expected_topic_count", F.lit(0))
    derived = F.when(got > want, "OVER").when(got == want, "SPLIT").otherwise("STOP")
    behaviour = F.when(~F.col("json_ok"), "JSONFAIL").otherwise(F.coalesce("__gm_b", derived))
    ok = F.col("json_ok") & F.col("schema_ok")
    return told.withColumn("recorded", F.col("__gm_b").isNotNull()).withColumn("behaviour", behaviour).withColumn("strict_ok", ok).drop("__gm_b")


def moves(rows: DataFrame, base: DataFrame) -> DataFrame:
    """(model, setting, from, to, n): how cases moved from the baseline's behaviour. ``base``: model, id, behaviour."""
    own = base.select("model", "id", F.col("behaviour").alias("from"))
    return rows.join(own, ["model", "id"]).groupBy("model", "setting", "from", F.col("behaviour").alias("to")).agg(F.count("*").alias("n"))


def grid(rows: DataFrame, cases: DataFrame | None, base: DataFrame, leak: str) -> DataFrame:
    """A row a (model, setting): its measures, the baseline's over the same cases (base_*), and the differences (d_*). Without
    ``cases`` both have their own, as in ``measures``."""
    probe = measures(rows, cases, leak, "model", "setting")
    same = rows.select("model", "setting", "id").distinct().join(base, ["model", "id"]).withColumn("raw_chars", F.lit(0))
    own = measures(same, cases, None, "model", "setting")
    own = own.select("model", "setting", *[F.col(c).alias(f"base_{c}") for c in ("n", "strict_ok", "topic_count_ok", "jsonfail")])
    both = probe.join(own, ["model", "setting"], "left")
    for c in ("strict_ok", "topic_count_ok"):
        both = both.withColumn(f"d_{c}", F.round(F.col(c) - F.col(f"base_{c}"), 4)).withColumn(f"moved_{c}", F.round((F.col(c) - F.col(f"base_{c}")) * F.col("n")).cast("long"))
    return both.withColumn("d_jsonfail", F.col("jsonfail") - F.col("base_jsonfail"))


def best_cells(told: DataFrame) -> DataFrame:
    """Of each model the first setting by name with the highest (strict_ok, topic_count_ok), the gates that it still
    misses, and whether it closes them. ``told``: a grid."""
    order = Window.partitionBy("model").orderBy(F.desc("strict_ok"), F.desc("topic_count_ok"), F.asc_nulls_last("setting"))  # a few cells
    own = told.withColumn("__gm_n", F.row_number().over(order)).where("__gm_n = 1 and model is not null and setting is not null")
    gaps = F.array_compact(F.array(F.when(F.col("strict_ok") < SCHEMA_GATE, "schema"), F.when(F.col("topic_count_ok") < COUNT_GATE, "topic_count")))
    return own.select("model", "setting", "strict_ok", "topic_count_ok", "d_strict_ok", "d_topic_count_ok", gaps.alias("gaps"), (F.size(gaps) == 0).alias("closes"))


def invariance(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, model, settings, failures, always, never): whether a case's JSON failure depends on the setting."""
    fails = F.count_if(F.col("behaviour") == "JSONFAIL")
    told = rows.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id", "model").agg(F.count("*").alias("settings"), fails.alias("failures"))
    return told.withColumn("always", F.col("failures") == F.col("settings")).withColumn("never", F.col("failures") == 0)


def loops(rows: DataFrame, n: int = 6, least: int = 4, tokens: int = 60) -> DataFrame:
    """(model, setting, loops): generations that repeat an n-gram, by cell, zeros included."""
    return rows.groupBy("model", "setting").agg(F.count_if(repeats_itself(F.col("raw"), tokens, n, least)).alias("loops"))


def isolated(cells: DataFrame, knobs: dict[str, tuple[str, str]], value: str = "loops") -> DataFrame:
    """(model, knob, off, on): a value in two settings that differ in one knob only."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("knob"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in knobs.items()]))
    each = cells.select("model", "setting", value, pairs.alias("p")).where("setting in (p.a, p.b)")
    return each.groupBy("model", F.col("p.knob").alias("knob")).agg(F.max(F.when(F.col("setting") == F.col("p.a"), F.col(value))).alias("off"), F.max(F.when(F.col("setting") == F.col("p.b"), F.col(value))).alias("on"))


def short_failures(baseline: DataFrame, long_input: int = LONG_INPUT) -> DataFrame:
    """(id, ordinal) of recorded JSON failures on short inputs, in order. ``baseline``: id, ordinal, json_ok, text_len."""
    return baseline.where(~F.col("json_ok") & (F.coalesce("text_len", F.lit(0)) < long_input)).select("id", "ordinal")


def defects(known: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, place): known failures, then every other case with a generation that isn't strict, in order of appearance.

    ``known``: id, ordinal; ``rows``: id, strict_ok, ordinal. The place orders, it is not dense.
    """
    first = known.groupBy("id").agg(F.min(F.struct(F.lit(0).alias("list"), F.col("ordinal").cast("long").alias("at"))).alias("place"))
    later = rows.where(~F.col("strict_ok")).groupBy("id").agg(F.min(F.struct(F.lit(1).alias("list"), F.col("ordinal").cast("long").alias("at"))).alias("place"))
    return first.unionByName(later).groupBy("id").agg(F.min("place").alias("place"))


def controls(rows: DataFrame, tag: str = "control") -> DataFrame:
    """(id, behaviours, invariant): cases with the tag whose behaviour is one and the same in every cell."""
    own = rows.where(F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), tag))
    return own.groupBy("id").agg(F.sort_array(F.collect_set("behaviour")).alias("behaviours")).withColumn("invariant", F.size("behaviours") == 1)


def with_fallback(df: DataFrame, known: DataFrame, keys: list[str], value: str, otherwise: Column) -> DataFrame:
    """Adds the looked-up value, else the fallback, and which it was (source)."""
    told = df.join(known.select(*keys, F.col(value).alias("__gm_v")), keys, "left")
    return told.withColumn(value, F.coalesce("__gm_v", otherwise)).withColumn("source", F.when(F.col("__gm_v").isNotNull(), "recorded").otherwise("derived")).drop("__gm_v")
