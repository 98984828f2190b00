"""Classification metrics, paired comparisons, cross-tabulations, gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def confusion(df: DataFrame, labels: DataFrame, true: str = "true_kind", pred: str = "predicted_kind") -> DataFrame:
    """Counts of every (true_label, pred_label) of the label map, zeros included; a label outside the map fails the run."""
    counted = df.groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count("*").alias("n"))
    known = [r["kind"] for r in labels.select("kind").collect()]  # a row a label
    for c in ("true_label", "pred_label"):
        counted = counted.withColumn(c, F.when(F.col(c).isin(*known), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast(counted.schema[c].dataType)))
    cells = labels.select(F.col("kind").alias("true_label")).crossJoin(labels.select(F.col("kind").alias("pred_label")))  # labels squared, not rows
    return cells.join(counted, ["true_label", "pred_label"], "left").select("true_label", "pred_label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(cells: DataFrame) -> DataFrame:
    """tp, support, predicted, precision, recall, f1 of each label of a confusion matrix; 0 for empty denominators."""
    rows = cells.groupBy(F.col("true_label").alias("kind")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)).alias("tp"))
    cols = cells.groupBy(F.col("pred_label").alias("kind")).agg(F.sum("n").alias("predicted"))
    both = rows.join(cols, "kind")
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return both.select("kind", "tp", "support", "predicted", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def ranked_classes(cells: DataFrame, digits: int = 4) -> DataFrame:
    """Per class with rounded figures: best f1 first, then support, then kind. Rounded before sorting."""
    told = per_class(cells).select("kind", "tp", "support", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")])
    return told.orderBy(F.col("f1").desc(), F.col("support").desc(), "kind")


def summary(cells: DataFrame, present_only: bool = False) -> DataFrame:
    """accuracy, macro and weighted precision, recall and f1, n. ``present_only``: macro over labels with support."""
    told = per_class(cells)
    counts = F.when(F.col("support") > 0, F.lit(True)) if present_only else F.lit(True)
    macro = lambda c: F.coalesce(F.avg(F.when(counts, F.col(c))), F.lit(0.0))
    n = F.sum("support")
    weighted = lambda c: F.when(n == 0, 0.0).otherwise(F.sum(F.col(c) * F.col("support")) / n)
    return told.agg(
        n.alias("n"),
        F.when(n == 0, 0.0).otherwise(F.sum("tp") / n).alias("accuracy"),
        *[macro(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )


def majority_share(cells: DataFrame) -> DataFrame:
    """The label with most support (the least on ties) and the share of predictions that name it."""
    by = cells.groupBy("true_label").agg(F.sum("n").alias("support"))
    top = by.agg(F.min_by("true_label", F.struct(-F.col("support"), F.col("true_label"))).alias("kind"))
    return cells.crossJoin(F.broadcast(top)).groupBy("kind").agg(_ratio(F.sum(F.when(F.col("pred_label") == F.col("kind"), F.col("n")).otherwise(0)), F.sum("n")).alias("share"))  # top is one row


def confusions(df: DataFrame, most: int = 20, true: str = "true_kind", pred: str = "predicted_kind", ordinal: str = "ordinal") -> DataFrame:
    """The most frequent wrong (true_label, pred_label); ties in the order of first appearance."""
    wrong = df.where(F.col(true) != F.col(pred)).groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label"))
    told = wrong.agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    return told.orderBy(F.col("n").desc(), "first").limit(most)


def top_errors(df: DataFrame, most: int = 20, true: str = "true_kind", pred: str = "predicted_kind", ordinal: str = "ordinal") -> DataFrame:
    """The most confident errors; ties keep input order."""
    return df.where(F.col(true) != F.col(pred)).orderBy(F.col("confidence").desc(), ordinal).limit(most)


def errors_by_label(df: DataFrame, labels: DataFrame, most: int = 5, true: str = "true_kind", pred: str = "predicted_kind", ordinal: str = "ordinal") -> DataFrame:
    """The ``most`` most confident errors of each true label; a label without any has one row of nulls."""
    w = Window.partitionBy(true).orderBy(F.col("confidence").desc(), ordinal)
    wrong = df.where(F.col(true) != F.col(pred)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    own = wrong.select(F.col(true).alias("kind"), "rank", F.col(pred).alias("predicted"), "confidence", F.col(ordinal).alias("ordinal"))
    return labels.select("kind").join(own, "kind", "left")


def duplicate_errors(df: DataFrame, key: Column, true: str = "true_kind", pred: str = "predicted_kind", ordinal: str = "ordinal") -> DataFrame:
    """Texts (by ``key``) that err more than once: rows and the first one's labels."""
    wrong = df.where(F.col(true) != F.col(pred)).groupBy(key.alias("text"))
    told = wrong.agg(F.count("*").alias("n"), F.min_by(true, ordinal).alias("true_label"), F.min_by(pred, ordinal).alias("pred_label"), F.min(ordinal).alias("first"))
    return told.where("n > 1")


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): the element at half the length of a group's sorted values, no mean of two middles. Nulls don't count.

    Equal values are counted first and groups are streamed in order, so none is gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("__gm_c"))
    w = Window.partitionBy(by)
    told = counts.withColumn("__gm_upto", F.sum("__gm_c").over(w.orderBy(value))).join(counts.groupBy(by).agg(F.sum("__gm_c").alias("__gm_n")), by)
    return told.where(F.col("__gm_upto") > F.floor(F.col("__gm_n") / 2)).groupBy(by).agg(F.min(value).alias("median"))


def crosstab(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Counts by (feature, value, label) over many features at once; each row counts once a feature."""
    told = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features]))
    return df.select(F.col(label).alias("label"), told.alias("t")).groupBy("t.feature", "t.value", "label").agg(F.count("*").alias("n"))


def transitions(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Counts of (from, to) for keys in both."""
    both = a.select(key, F.col(value).alias("from")).join(b.select(key, F.col(value).alias("to")), key)
    return both.groupBy("from", "to").agg(F.count("*").alias("n"))


def movement(a: DataFrame, b: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Each key's move from a to b by the rank of its value (best first): improved, regressed or unchanged."""
    rank = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    both = a.select(key, rank[F.col(value)].alias("r0")).join(b.select(key, rank[F.col(value)].alias("r1")), key)
    return both.select(key, F.when(F.col("r1") < F.col("r0"), "improved").when(F.col("r1") > F.col("r0"), "regressed").otherwise("unchanged").alias("movement"))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b); arms that do not cover the same keys fail the run."""
    both = a.select(key, F.col(value).alias("a"), F.lit(1).alias("in_a")).join(b.select(key, F.col(value).alias("b"), F.lit(1).alias("in_b")), key, "full_outer")
    lost = F.coalesce(F.col("in_a"), F.lit(0)) + F.coalesce(F.col("in_b"), F.lit(0)) < 2
    checked = F.when(lost, F.raise_error(F.concat(F.lit("not in both arms: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return both.withColumn("ok", checked.cast("boolean")).where("ok").select(key, "a", "b")


def _binomial_tail(a_only: Column, b_only: Column) -> Column:
    """Two-sided exact p of the smaller count among both. The tail is summed over a sequence of log terms, so its size is the
    number of discordant pairs."""
    m, k = a_only + b_only, F.least(a_only, b_only)
    half = -m * F.log(F.lit(2.0))
    start = F.struct(half.alias("log"), F.exp(half).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((m - i + 1) / i)
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step)["sum"]
    return F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar_by(pairs: DataFrame, *by: str) -> DataFrame:
    """Exact two-sided test on boolean (a, b) in each group: n, a_only, b_only, p. Pairs with a null are left out."""
    told = pairs.where("a is not null and b is not null").groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(~F.col("a") & F.col("b")).alias("b_only"))
    return tail(told)


def tail(counts: DataFrame) -> DataFrame:
    """Adds ``p`` of the exact two-sided test to counts (a_only, b_only)."""
    return counts.withColumn("p", _binomial_tail(F.col("a_only"), F.col("b_only")))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """``mcnemar_by`` of all pairs: one row."""
    return mcnemar_by(pairs)


def bootstrap(pairs: DataFrame, rounds: int = 4_000, seed: int = 0) -> DataFrame:
    """Paired bootstrap of mean(b - a): n, delta, lo, hi, supported (the interval leaves out 0).

    A resample takes each pair a Poisson(1) number of times, so pairs are drawn apart from each other and sums of parts can
    be merged. Pairs of one difference are alike: n of them are taken a Poisson(n) number of times, drawn for all resamples
    at once from the seed and the difference. Each task adds its differences into ``rounds`` sums and hands on these, so
    the work grows with the different differences and the shuffle with the tasks; the draws do not depend on partitions.
    """
    own = pairs.select((F.col("b") - F.col("a")).cast("double").alias("d"))
    told = own.agg(F.count("*").alias("n"), F.avg("d").alias("delta"))
    counts = own.where("d is not null").groupBy((F.col("d") + F.lit(0.0)).alias("d")).agg(F.count("*").alias("n"))

    def drawn(batches):
        import pyarrow as pa

        sums, taken = np.zeros(rounds), np.zeros(rounds, dtype=np.int64)
        for batch in batches:
            for d, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                times = np.random.default_rng([seed, int(np.float64(d).view(np.uint64))]).poisson(n, rounds)
                sums += times * d
                taken += times
        if taken.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds, dtype=np.int32)), pa.array(sums), pa.array(taken)], names=["round", "sum", "taken"])

    each = counts.mapInArrow(drawn, "round int, sum double, taken long").groupBy("round").agg(F.sum("sum").alias("sum"), F.sum("taken").alias("taken"))
    means = each.select(F.round(F.col("sum") / F.greatest("taken", F.lit(1)), 12).alias("mean"))
    band = means.agg(F.sort_array(F.collect_list("mean")).alias("m"))  # a value a round
    lo, hi = F.get("m", F.lit(int(0.025 * rounds))), F.get("m", F.lit(min(rounds - 1, int(0.975 * rounds))))
    return told.crossJoin(band).select("n", "delta", lo.alias("lo"), hi.alias("hi")).withColumn("supported", (F.col("lo") > 0) | (F.col("hi") < 0))  # one row each


def verdict_of_change(delta: Column, higher_is_better: Column, tolerance: Column) -> Column:
    """improved, regressed, unchanged within the tolerance, or unresolved where delta or direction is null."""
    good = F.when(higher_is_better, delta > 0).otherwise(delta < 0)
    return F.when(delta.isNull(), "unresolved").when(F.abs(delta) <= tolerance, "unchanged").when(higher_is_better.isNull(), "unresolved").when(good, "improved").otherwise("regressed")


def gates(observed: DataFrame, rules: DataFrame) -> DataFrame:
    """(arm, gate, observed, blocking, passed) of each arm's metrics by rules (gate, metric, at_least, at_most, blocking,
    null_if_missing). A missing metric fails, or is null where the rule says so."""
    arms = observed.select("arm").distinct()
    told = arms.crossJoin(F.broadcast(rules)).join(observed, ["arm", "metric"], "left")  # rules: a row a gate
    ok = F.coalesce(F.col("value") >= F.col("at_least"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("at_most"), F.lit(True))
    passed = F.when(F.col("value").isNotNull(), ok).when(~F.col("null_if_missing"), False)
    return told.select("arm", "gate", F.col("value").alias("observed"), "blocking", passed.alias("passed"))


def verdicts(gated: DataFrame) -> DataFrame:
    """INCOMPLETE where a blocking gate is null, FAIL where one is false, else PASS."""
    blocking = gated.groupBy("arm").agg(F.count_if(F.col("blocking") & F.col("passed").isNull()).alias("missing"), F.count_if(F.col("blocking") & ~F.col("passed")).alias("failed"))
    return blocking.select("arm", F.when(F.col("missing") > 0, "INCOMPLETE").when(F.col("failed") > 0, "FAIL").otherwise("PASS").alias("verdict"))


def overlapping(df: DataFrame, subsets: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """The same measures over overlapping subsets: (subset, measures...), from one pass."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in subsets.items()]))
    return df.withColumn("subset", F.explode(names)).groupBy("subset").agg(*[m.alias(k) for k, m in measures.items()])


def mean_or(x: Column, default: float) -> Column:
    return F.coalesce(F.avg(x), F.lit(default))
