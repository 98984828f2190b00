"""Curation: noise filters, exact and normalised dedup, support thresholds, chronological splits, leakage, id tables.

Input order is part of the semantics: frames carry an ordinal column, and every ranking ends in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD, normalize

#: The beginning of a referral note, and labels that name no topic (so does a null one; an empty one does).
NOISE = f"^над{WORD}*[\\s]+номер"
BROAD_KINDS = ("Інше", "Інші питання", "null")
DATE = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2})"


def is_noise(text: Column, pattern: str = NOISE) -> Column:
    """Whether the normalised text begins as the pattern says. Empty texts are not noise."""
    return normalize(text).rlike(pattern)


def is_broad(kind: Column, kinds=BROAD_KINDS) -> Column:
    return kind.isNull() | kind.isin(*kinds)


def first_of(df: DataFrame, keys: list, ordinal: str = "row_id") -> DataFrame:
    """The first row of each key by the ordinal, null keys included. Ordinals are unique.

    Keys are hashed (128 bits) and their least ordinals found by partial aggregates, so a key with many rows is nowhere
    gathered; rows are shuffled once, by their ordinals.
    """
    told = F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("="), (F.col(k) if isinstance(k, str) else k).cast("string")), F.lit("null")) for k in keys])
    winners = df.groupBy(F.md5(told).alias("__gm_key")).agg(F.min(ordinal).alias("__gm_first")).select("__gm_first")
    return df.join(winners, F.col(ordinal) == F.col("__gm_first"), "left_semi")


def dedup_pairs(df: DataFrame, text: str = "content", kind: str = "kind", ordinal: str = "row_id") -> DataFrame:
    """The first row of each exact (text, kind)."""
    return first_of(df, [text, kind], ordinal)


def dedup_normalized(df: DataFrame, text: str = "content", ordinal: str = "row_id") -> DataFrame:
    """The first row of each normalised text."""
    return first_of(df, [normalize(F.col(text))], ordinal)


def with_support(df: DataFrame, kind: str = "kind") -> DataFrame:
    """Adds ``support``: the rows of a row's kind. Kinds are counted first, so a hot kind is never gathered."""
    counts = df.groupBy(kind).agg(F.count("*").alias("support")).withColumnRenamed(kind, "__gm_kind")
    return df.join(counts, F.col(kind).eqNullSafe(F.col("__gm_kind"))).drop("__gm_kind")


def min_support(df: DataFrame, least: int = 30, kind: str = "kind") -> DataFrame:
    """Rows of kinds with ``least`` rows or more."""
    return with_support(df, kind).where(F.col("support") >= least).drop("support")


def minute(received: Column) -> Column:
    """A timestamp text to the minute, ``YYYY-MM-DDTHH:MM``, null where it has another form. No calendar check; such
    texts compare as the times they stand for."""
    own = F.trim(received)
    return F.when(own.rlike(DATE), F.substring(own, 1, 16))


def chronological_split(df: DataFrame, validation_from: str, test_from: str, received: str = "received", strict: bool = True) -> DataFrame:
    """Adds ``split``: train before the first bound, test from the second on, validation between; bounds inclusive.

    A text that is not a time fails the run, or has a null split where not ``strict``.
    """
    at = minute(F.col(received))
    split = F.when(at < validation_from, "train").when(at < test_from, "validation").when(at.isNotNull(), "test")
    if strict:
        split = F.coalesce(split, F.raise_error(F.concat(F.lit("not a time: "), F.coalesce(F.col(received), F.lit("null")))))
    return df.withColumn("split", split)


def leakage(df: DataFrame, text: str = "content", split: str = "split") -> DataFrame:
    """Normalised texts in more than one split, the empty one too: text, splits (sorted), rows."""
    told = df.groupBy(normalize(F.col(text)).alias("text")).agg(F.sort_array(F.collect_set(split)).alias("splits"), F.count("*").alias("rows"))
    return told.where(F.size("splits") > 1)


def assert_no_leakage(df: DataFrame, text: str = "content", split: str = "split") -> None:
    found = leakage(df, text, split).limit(5).collect()
    if found:
        raise ValueError(f"texts in several splits, such as {[r['text'][:60] for r in found]}")


def first_split(df: DataFrame, text: str = "content", split: str = "split", ordinal: str = "row_id") -> DataFrame:
    """Each normalised text with the split of its first row."""
    return df.groupBy(normalize(F.col(text)).alias("text")).agg(F.min_by(split, ordinal).alias("split"))


def content_sets(df: DataFrame, text: str = "content", split: str = "split") -> DataFrame:
    """Distinct normalised texts of each split."""
    return df.select(F.col(split).alias("split"), normalize(F.col(text)).alias("text")).distinct()


def held_out(df: DataFrame, splits=("validation", "test"), uid: str = "uid", text: str = "content", ordinal: str = "row_id") -> DataFrame:
    """Rows of the held-out splits, one a normalised text, in order of uid and text."""
    return dedup_normalized(df.where(F.col("split").isin(*splits)), text, ordinal).orderBy(uid, text)


def overlap(df: DataFrame, held: DataFrame, text: str = "content") -> DataFrame:
    """One row: rows, distinct normalised texts, duplicates, and rows whose text is in ``held``, too."""
    own = df.select(normalize(F.col(text)).alias("t"))
    known = held.select(normalize(F.col(text)).alias("t")).distinct().withColumn("hit", F.lit(1))
    counted = own.groupBy("t").agg(F.count("*").alias("n")).join(known, "t", "left")
    rows = F.sum("n")
    return counted.agg(
        F.coalesce(rows, F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_texts"),
        F.coalesce(rows - F.count("*"), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)), F.lit(0)).alias("overlap"),
    )


def label_map(df: DataFrame, kind: str = "kind") -> DataFrame:
    """Distinct kinds in code-point order with dense indexes from 0. One row a kind."""
    return df.select(F.col(kind).alias("kind")).distinct().withColumn("idx", F.row_number().over(Window.orderBy("kind")) - 1)


def to_index(df: DataFrame, labels: DataFrame, kind: str = "kind") -> DataFrame:
    """Adds ``idx`` from a label map; an unknown kind fails the run."""
    known = labels.select(F.col("kind").alias("__gm_kind"), "idx")
    joined = df.join(known, F.col(kind).eqNullSafe(F.col("__gm_kind")), "left").drop("__gm_kind")
    return joined.withColumn("idx", F.coalesce("idx", F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(kind), F.lit("null")))).cast("int")))


def distribution(df: DataFrame, kind: str = "kind") -> DataFrame:
    """Rows per kind, most first, then by kind."""
    return df.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "kind")


def funnel(df: DataFrame, validation_from: str, test_from: str, least: int = 30, noise: str = NOISE, broad=BROAD_KINDS) -> DataFrame:
    """Rows left after each stage of curation: (ordinal, stage, rows). ``df``: row_id, kind, content, received.

    Flags are columns, so one pass over the kept rows counts every stage; the text is hashed once, for dedup.
    """
    flagged = df.select("row_id", "kind", "received", "content", is_noise(F.col("content"), noise).alias("noise"), is_broad(F.col("kind"), broad).alias("broad"))
    left = flagged.where(~F.col("noise") & ~F.col("broad"))
    unique = dedup_pairs(left).select("kind", "received")
    kept = chronological_split(min_support(unique, least), validation_from, test_from)
    whole = flagged.agg(F.count("*").alias("a"), F.count_if(~F.col("noise")).alias("b"), F.count_if(~F.col("noise") & ~F.col("broad")).alias("c"))
    splits = kept.agg(F.count("*").alias("e"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")])
    told = whole.crossJoin(unique.agg(F.count("*").alias("d"))).crossJoin(splits)  # one row each
    stages = [("a", "raw"), ("b", "noise"), ("c", "kinds"), ("d", "dedup"), ("e", "support"), ("train", "train"), ("validation", "validation"), ("test", "test")]
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("stage"), F.col(c).alias("rows")) for i, (c, name) in enumerate(stages)])
    return told.select(F.explode(rows).alias("r")).select("r.*")


def id_table(df: DataFrame, uid: str = "uid", split: str = "split", ordinal: str = "row_id") -> DataFrame:
    """Adds ``id``: ``split:uid``, with ``#n`` (n from 0 in input order) where that is repeated."""
    key = Window.partitionBy(split, uid)
    nth = F.row_number().over(key.orderBy(ordinal)) - 1
    plain = F.concat_ws(":", F.col(split), F.col(uid))
    return df.withColumn("id", F.when(F.count("*").over(key) > 1, F.concat(plain, F.lit("#"), nth.cast("string"))).otherwise(plain))


def batches(df: DataFrame, size: int, ordinal: str = "ordinal") -> DataFrame:
    """Adds ``batch_id`` (batch-001, ..) to rows with a dense ordinal from 0."""
    return df.withColumn("batch_id", F.concat(F.lit("batch-"), F.lpad((F.floor(F.col(ordinal) / size) + 1).cast("string"), 3, "0")))


def holdout(df: DataFrame, fraction: float, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """Adds ``held``: the first ``floor(fraction * rows)`` of each stratum in a seeded hash order.

    Needs each stratum's rows ranked, so use it on strata that fit a task's disk; ranks are by (hash, key).
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    w = Window.partitionBy(stratum)
    return df.withColumn("held", F.row_number().over(w.orderBy(h, key)) <= F.floor(F.count("*").over(w) * fraction))


def strided(df: DataFrame, n: int, stride: int, skip: int = 0, ordinal: str = "ordinal") -> DataFrame:
    """``n`` rows of a small frame with a dense ordinal from 0: the i-th is row (skip + i * stride) modulo its size.

    A stride that wraps repeats rows; ``pick`` is i.
    """
    size = df.count()
    if not size:
        return df.withColumn("pick", F.lit(0)).limit(0)
    picks = df.sparkSession.range(n).select(F.col("id").cast("int").alias("pick"), ((F.lit(skip) + F.col("id") * stride) % size).alias("__gm_at"))
    return picks.join(df, F.col("__gm_at") == F.col(ordinal)).drop("__gm_at")


def capped(df: DataFrame, key: str, most: int, ordinal: str) -> DataFrame:
    """The first ``most`` rows of each key."""
    return df.withColumn("__gm_nth", F.row_number().over(Window.partitionBy(key).orderBy(ordinal))).where(F.col("__gm_nth") <= most).drop("__gm_nth")


#: Ordinals of a part of an unpartitioned order.
CHUNK = 100_000


def run_lengths(df: DataFrame, label: str, ordinal: str, partition: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Runs of equal labels in order: (partition), run, label, length, and the first ordinal.

    Without a partition, the order is cut into parts of ``chunk`` ordinals (numbers, not necessarily dense): each part
    learns the label before it from the parts' last labels, numbers its own runs, and adds those of the parts before.
    """
    if partition:
        w = Window.partitionBy(partition).orderBy(ordinal)
        new = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1))
        first = F.row_number().over(w) == 1
        marked = df.withColumn("run", F.sum(F.when(first, 1).otherwise(new)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(partition, "run", F.col(label).alias("label")).agg(F.count("*").alias("length"), F.min(ordinal).alias("first"))
    rows = df.select(F.col(label).alias("label"), F.col(ordinal).alias("at"), F.floor(F.col(ordinal) / chunk).alias("part"))
    order = Window.orderBy("part")  # a row a part
    ends = rows.groupBy("part").agg(F.max_by("label", "at").alias("last"))
    ends = ends.select("part", F.lag("last").over(order).alias("before"), (F.row_number().over(order) > 1).alias("some"))
    w = Window.partitionBy("part").orderBy("at")
    own = rows.join(ends, "part").withColumn("top", F.row_number().over(w) == 1).withColumn("lag", F.lag("label").over(w))
    previous = F.when(F.col("top"), F.col("before")).otherwise(F.col("lag"))
    own = own.withColumn("new", F.when(F.col("top") & ~F.col("some"), 1).when(~F.col("label").eqNullSafe(previous), 1).otherwise(0))
    ahead = own.groupBy("part").agg(F.sum("new").alias("n")).select("part", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    numbered = own.withColumn("nth", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(ahead, "part")
    return numbered.groupBy((F.col("ahead") + F.col("nth")).alias("run"), "label").agg(F.count("*").alias("length"), F.min("at").alias("first"))


def gaps(df: DataFrame, value: str, first: int, last: int, step: int) -> DataFrame:
    """Members of the arithmetic sequence that the frame lacks."""
    want = df.sparkSession.range(first, last + 1, step).select(F.col("id").alias("missing"))
    return want.join(df.select(F.col(value).cast("long").alias("missing")), "missing", "left_anti")
