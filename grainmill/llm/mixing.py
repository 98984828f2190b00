"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]. Its integral fixes how many words the source owes;
its running integral is the cumulative demand. A source's documents form a stream in a hashed order, read again from
the start when the demand exceeds the source (up to ``max_epochs`` times). The word at offset c of that stream is due
when the cumulative demand reaches c: inverting the demand gives every copy of a document its training position, and
a range sort by position gives the training order.

Nulls, ties, repeats: a null source is a source of its own and comes last; null and empty texts have size 0 and are
never taken; a null doc_id and a null text hash as the empty string; equal rows stay separate rows, one after another in
the stream; an empty table gives an empty result. ``mix`` reads doc_id, source and text only (``apply_mix`` all columns),
so other columns of any name do no harm. Sources are few (a window over one row a source runs in one task).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace, unused
from .text import words

#: (time, multiplier) knots of the weight schedules; tier k of the weights uses the k-th, repeating. Each has mean 1
#: over [0, 1], so the integrated shares are the weights themselves.
SCHEDULES = (((0.0, 1.4), (1.0, 0.6)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Rows of one source that one window partition holds, about; words of one file of a mix, about.
ROWS_PER_BUCKET, WORDS_PER_FILE = 2_000, 4_000_000
#: Equal parts of training time whose words are counted to cut a mix into files.
BINS = 4096


def integral(knots) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def inverse(knots, u: Column) -> Column:
    """The time at which the running integral of the schedule is the share ``u`` of its whole integral.

    Within a linear piece the integral is a quadratic of time; the stable root is taken.
    """
    if any(w < 0 for _, w in knots) or len(knots) < 2:
        raise ValueError("a schedule needs two knots or more and no negative weight")
    total, done, out = integral(knots), 0.0, F.lit(float(knots[-1][0]))
    if total <= 0:
        raise ValueError("a schedule needs a positive integral")
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((done, t0, w0, (w1 - w0) / (t1 - t0)))
        done += (t1 - t0) * (w0 + w1) / 2
    due = u * F.lit(total)
    for at, t0, w0, slope in pieces:  # later pieces override
        left = F.greatest(due - F.lit(at), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * left, F.lit(0.0))) + F.lit(w0)
        t = F.lit(t0) + F.when(root > 0, 2.0 * left / root).otherwise(0.0)
        out = t if at == 0.0 and t0 == knots[0][0] else F.when(due >= F.lit(at), t).otherwise(out)
    return out


@dataclass
class Mix:
    """``sources``: a row each with its target. ``documents``: a row each with what the mix takes of it (``taken``, words)
    and its copies (epoch, take, position; none if nothing is taken)."""

    sources: DataFrame
    documents: DataFrame

    @property
    def curriculum(self) -> DataFrame:
        """Copies of documents in training order, range-sorted by position."""
        order = ["position", "sid", "epoch", "key", "h", "nth"]
        copies = self.documents.select("doc_id", "source", "sid", "size", "key", "h", "nth", F.explode("copies").alias("copy"))
        copies = copies.select("doc_id", "source", "sid", "size", "copy.epoch", "copy.take", "copy.position", "key", "h", "nth")
        return copies.repartitionByRange(*order).sortWithinPartitions(*order)

    @property
    def taken(self) -> DataFrame:
        """Documents in the order of their first copies, those that are not taken last."""
        order = [F.col("position").asc_nulls_last(), F.col("sid"), F.col("key"), F.col("h"), F.col("nth")]
        first = F.get("copies", F.lit(0))["position"]
        rows = self.documents.withColumn("position", F.round(first, 9)).repartitionByRange(*order).sortWithinPartitions(*order)
        return rows.select("doc_id", "size", "source_size", "target", "taken", "position")


def targets(sources: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Adds sid, weight and target: all words shared by weight, no source above ``max_epochs`` times its size.

    Sources in ascending order of cap by weight are full up to some point; beyond it each gets weight times one level,
    which is what handing the excess on by weight until nobody is above its cap ends in. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(int(x)) for x in weights])
    ranked = sources.withColumn("sid", F.row_number().over(order).cast("long")).withColumn("weight", F.get(w, ((F.col("sid") - 1) % len(weights)).cast("int")))
    cap = F.col("source_size") * F.lit(int(max_epochs))
    by_ratio = Window.orderBy(F.col("ratio"), F.col("sid"))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    leveled = (
        ranked.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(Window.partitionBy(F.lit(0))) - before) / after)
    )
    reached = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    share = F.when(reached.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), reached * F.col("weight")))
    return leveled.withColumn("target", share).select("sid", "source", "source_rows", "source_size", "weight", "target")


def mix(documents: DataFrame, ws: Workspace, weights=(5, 2, 1), max_epochs: int = 3, schedules=SCHEDULES, rows_per_bucket: int = ROWS_PER_BUCKET, h: Column | None = None) -> Mix:
    """The mix of ``documents`` (doc_id, source, text): only sizes are shuffled, never texts. ``h`` tells rows apart that
    are equal in these columns.

    A hot source is split into hashed buckets: their totals are summed first, then each bucket adds its own running
    sum, so no task holds a whole source. Equal rows are one row with their number until their copies are told.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    size = F.size(words(F.col("text").cast("string"))).cast("long")
    units = documents.select("doc_id", "source", size.alias("size"), key.alias("key"), (F.lit(0).cast("long") if h is None else h).alias("h"))
    units = ws.table("units", units.groupBy("doc_id", "source", "size", "key", "h").agg(F.count("*").alias("n")))
    per_source = units.groupBy("source").agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("source_size"), F.sum("n").alias("source_rows"))
    sources = ws.table("sources", targets(per_source, weights, max_epochs))

    s = sources.select(F.col("source").alias("source_"), "sid", "source_rows", "source_size", "target")
    buckets = F.ceil(F.col("source_rows") / rows_per_bucket)
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    bucket = F.floor(head * buckets / F.lit(1 << 32)).cast("long")
    placed = units.join(s, F.col("source").eqNullSafe(F.col("source_"))).withColumn("bucket", bucket).withColumn("words", F.col("size") * F.col("n")).drop("source_", "source_rows")
    totals = placed.groupBy("sid", "bucket").agg(F.sum("words").alias("bucket_size"))
    running = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    streamed = placed.join(offsets, ["sid", "bucket"]).withColumn("before", F.col("ahead") + F.coalesce(F.sum("words").over(inner), F.lit(0)))
    # equal rows, by blocks so that no array is long
    block = 1 << 12
    streamed = streamed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))))
    streamed = streamed.withColumn("nth", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + block, F.col("n")) - 1)))
    streamed = streamed.withColumn("before", F.col("before") + F.col("nth") * F.col("size"))

    length = F.floor(F.col("target") + F.lit(1e-9)).cast("long")
    tier = (F.col("sid") - 1) % len(schedules)

    def copy(epoch: int) -> Column:
        at = F.col("before") + F.lit(epoch) * F.col("source_size")
        u = at / F.greatest(length, F.lit(1))
        due = inverse(schedules[-1], u)
        for k, knots in enumerate(schedules[:-1]):
            due = F.when(tier == k, inverse(knots, u)).otherwise(due)
        return F.struct(F.lit(epoch).alias("epoch"), F.greatest(F.least(length - at, F.col("size")), F.lit(0)).cast("long").alias("take"), due.alias("position"))

    copies = F.filter(F.array(*[copy(e) for e in range(int(max_epochs))]), lambda c: c["take"] > 0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["take"])
    told = streamed.withColumn("copies", copies).withColumn("taken", taken)
    told = ws.table("documents", told.select("doc_id", "source", "sid", "size", "source_size", "target", "taken", "copies", "key", "h", "n", "nth"))
    ws.drop("units")
    return Mix(sources, told)


def apply_mix(documents: DataFrame, ws: Workspace, words_per_file: int = WORDS_PER_FILE, **options) -> DataFrame:
    """``documents`` as the mix takes them, in training order: a row per copy, the columns unchanged; a last copy is cut to
    the words still due, and n_chars, where there is such a column, follows it.

    Partitions are ranges of training time, sorted by position, so files that are written of them hold the curriculum in
    the order of their names. Texts are shuffled twice: to their copies by a hash of the row, and to their ranges.
    """
    columns = documents.columns
    h, copy, slot, take, position, size, row, bin_ = unused(columns, "h", "copy", "slot", "take", "position", "size", "row", "bin")
    plain = [f.name for f in documents.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    mixed = mix(documents, ws, h=F.xxhash64(*plain), **options)
    found = mixed.documents.where("taken > 0")
    # parts of training time of about equal numbers of words
    bins = found.select(F.explode("copies").alias("c")).groupBy(F.least(F.floor(F.col("c.position") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.sum("c.take").alias("w"))
    ahead = F.coalesce(F.sum("w").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = ws.table("slots", bins.select(F.col("bin").alias(bin_), F.floor(ahead / words_per_file).cast("int").alias(slot)))  # BINS rows at most
    last, = slots.agg(F.coalesce(F.max(slot), F.lit(0))).first()

    cols = F.struct(F.col("h").alias(h), F.col("size").alias(size), F.col("copies").alias(copy))
    docs = documents.withColumn(h, F.xxhash64(*plain))
    once = found.where("n = 1").select(cols.alias("s")).select("s.*")
    several = ws.table("equal-rows", found.where("n > 1").select(F.col("h").alias(h), F.col("size").alias(size), F.col("copies").alias(copy)))
    known = ws.table("equal-keys", several.select(h).distinct())
    alike = docs.join(known, h, "left_semi").groupBy(h).agg(F.min_by(F.struct(*columns), F.lit(0)).alias(row)).select(h, f"{row}.*")
    both = docs.join(once, h).unionByName(ws.table("equal-texts", alike).join(several, h))
    each = both.withColumn(copy, F.explode(copy)).withColumn(take, F.col(copy)["take"]).withColumn(position, F.col(copy)["position"])
    part = F.least(F.floor(F.col(position) * BINS), F.lit(BINS - 1)).cast("int")
    each = each.join(F.broadcast(slots), part == F.col(bin_))
    partial = F.col(take) < F.col(size)
    cut = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col(take).cast("int")), " ")
    out = each.repartitionById(int(last) + 1, F.col(slot)).sortWithinPartitions(position, h, F.col(copy)["epoch"])
    out = out.withColumn("text", F.when(partial, cut).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(partial, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)


#: The whole report in SQL, with the inverses of the three schedules spelled out.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
src AS (
  SELECT *, [5, 2, 1][1 + (sid - 1) % 3] AS weight FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS sid
    FROM sized GROUP BY source)),
lev AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio FROM src),
lev2 AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM lev),
lam AS (SELECT arg_min(level, sid_order) AS reached FROM (SELECT level, row_number() OVER (ORDER BY ratio, sid) AS sid_order FROM lev2 WHERE level <= ratio)),
tgt AS (
  SELECT source, sid, source_size, CASE WHEN reached IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), reached * weight) END AS target FROM lev2, lam),
str AS (
  SELECT s.doc_id, s.size, t.sid, t.source_size, t.target, CAST(floor(t.target + 1e-9) AS BIGINT) AS length,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
due AS (SELECT *, CAST(before AS DOUBLE) / greatest(length, 1) AS u, least(length - before, size) > 0 AS first FROM str)
SELECT doc_id, size, source_size, target,
       CAST(greatest(least(length - before, size), 0) + greatest(least(length - before - source_size, size), 0)
            + greatest(least(length - before - 2 * source_size, size), 0) AS BIGINT) AS taken,
       CASE WHEN first THEN round(CASE (sid - 1) % 3
         WHEN 0 THEN 2.0::DOUBLE * u / (sqrt(greatest(1.4::DOUBLE * 1.4::DOUBLE + (2.0::DOUBLE * (0.6::DOUBLE - 1.4::DOUBLE)) * u, 0)) + 1.4::DOUBLE)
         WHEN 1 THEN u
         ELSE CASE WHEN u >= 0.375 THEN 0.5::DOUBLE + 2.0::DOUBLE * (u - 0.375::DOUBLE) / (sqrt(1.0::DOUBLE + 2.0::DOUBLE * (u - 0.375::DOUBLE)) + 1.0::DOUBLE)
              ELSE 2.0::DOUBLE * u / (sqrt(0.25::DOUBLE + 2.0::DOUBLE * u) + 0.5::DOUBLE) END END, 9) END AS position
FROM due
"""
