"""Quotas, clustering and selection of records for annotation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quotas(supports: DataFrame, budget: int, least: int, power: float = 0.6) -> DataFrame:
    """(kind, support, quota) from (kind, support): seats that add up to the budget.

    A kind's share of the budget goes by support ** power. It starts with its share rounded down, but ``least`` at least
    and its support at most. What is then above the budget is taken, what is below is given, seat by seat: each seat that
    could go (those beyond ``least``) or come (up to the support) is ranked by how far it lies above the kind's share, and
    the highest go, or the lowest come. On ties the kind that is later in code-point order loses, the earlier one gains.
    A budget that cannot be met fails the run. Kinds are few: windows run over a row a kind and seat in question.
    """
    everything = Window.partitionBy(F.lit(0))
    kinds = supports.where("support > 0").withColumn("place", F.row_number().over(Window.orderBy("kind")))
    weight = F.pow(F.col("support").cast("double"), F.lit(power))
    kinds = kinds.withColumn("share", weight / F.sum(weight).over(everything) * budget)
    kinds = kinds.withColumn("start", F.least(F.col("support"), F.floor(F.greatest(F.lit(float(least)), F.col("share")))).cast("long"))
    kinds = kinds.withColumn("gap", F.lit(budget) - F.sum("start").over(everything))
    going = F.when((F.col("gap") < 0) & (F.col("start") > least), F.sequence(F.lit(least + 1).cast("long"), F.col("start")))
    coming = F.when((F.col("gap") > 0) & (F.col("start") < F.col("support")), F.sequence(F.col("start"), F.least(F.col("support"), F.col("start") + F.col("gap")) - 1))
    seats = kinds.withColumn("seat", F.explode(F.coalesce(going, coming)))
    above = F.when(F.col("gap") < 0, F.col("share") - F.col("seat")).otherwise(F.col("seat") - F.col("share"))  # the first to move is the least
    turn = F.when(F.col("gap") < 0, -F.col("place")).otherwise(F.col("place"))
    moved = seats.withColumn("rank", F.row_number().over(everything.orderBy(above, turn))).where(F.col("rank") <= F.abs("gap"))
    moved = moved.groupBy("kind").agg((F.count("*") * F.signum(F.first("gap"))).cast("long").alias("change"))
    told = kinds.join(moved, "kind", "left").withColumn("quota", F.col("start") + F.coalesce("change", F.lit(0)))
    short = F.sum("quota").over(everything) != budget
    checked = F.when(short, F.raise_error(F.concat(F.lit(f"no budget of {budget} with {least} seats a kind and the support of "), F.sum("support").over(everything).cast("string"))).cast("long")).otherwise(F.col("quota"))
    none = supports.where("support <= 0").select("kind", "support", F.lit(0).cast("long").alias("quota"))
    return told.select("kind", F.col("support").cast("long").alias("support"), checked.alias("quota")).unionByName(none)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n)))[0]


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean vector of each key, by position, so partial sums are what is shuffled."""
    each = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def centroid_distance(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Adds ``distance``: squared, to the centroid of the row's key."""
    c = centroids(df, key, vector).withColumnRenamed(key, "__gm_key")
    return df.join(c, F.col(key).eqNullSafe(F.col("__gm_key"))).withColumn("distance", squared_distance(F.col(vector), F.col("centroid"))).drop("__gm_key", "centroid")


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 50, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of weighted rows. Seeded k-means++ start; ties go to the lowest cluster; an empty cluster keeps its
    centre."""
    rng = np.random.default_rng(seed)
    n = len(x)
    if k > n:
        raise ValueError(f"{k} clusters of {n} rows")
    w = np.ones(n) if weights is None else np.asarray(weights, dtype=float)
    pick = lambda mass: min(int(np.searchsorted(np.cumsum(mass), rng.random() * mass.sum(), side="right")), n - 1)
    chosen = [pick(w)]
    nearest = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        mass = nearest * w
        chosen.append(pick(mass) if mass.sum() > 0 else next(i for i in range(n) if i not in set(chosen)))
        nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centres, labels = x[chosen].astype(float), None
    for _ in range(rounds):
        new = _nearest(x, centres)[0]
        if labels is not None and (new == labels).all():
            break
        labels = new
        for c in range(k):
            if w[labels == c].sum() > 0:
                centres[c] = np.average(x[labels == c], axis=0, weights=w[labels == c])
    return labels, centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the lowest of ties, and the squared distance to it."""
    square = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]
    label = square.argmin(axis=1)
    return label, ((x - centres[label]) ** 2).sum(axis=1)


#: Turns of oversampling, and candidates of a turn for each cluster wanted, about.
TURNS, OVER = 4, 2


def cluster(df: DataFrame, quota: DataFrame, kind: str, key: str, vector: str, seed: int = 0, rounds: int = 50) -> DataFrame:
    """(kind, key, cluster, distance): k-means within each kind with its quota as k, the same way for kinds of any size.

    Seeds are drawn by k-means||: in each of ``TURNS`` turns every row is taken, by a seeded hash of its key, with a chance
    in proportion to its squared distance from what is taken already, ``OVER`` times the quota in all. Candidates weigh as
    many rows as they are nearest to and are clustered into the first centres; then all rows are dealt to the nearest centre
    and centres become the means of their rows, until none moves. What the driver holds and broadcasts are candidates and
    centres, ``TURNS * OVER + 2`` a seat at most, about, whatever the rows. A kind with more seats than rows fails the run.

    ``df`` is read in every round: one that is dear to make should be written before.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    wanted = {r["kind"]: r["quota"] for r in quota.where("quota > 0").collect()}  # a row a kind
    spark, rows = df.sparkSession, df.where(F.col(kind).isin(*wanted)).select(kind, key, F.col(vector).cast("array<double>").alias(vector))
    seats = {r[kind]: (wanted[r[kind]], r["n"]) for r in rows.groupBy(kind).agg(F.count("*").alias("n")).collect()}
    for k, n in seats.values():
        if k > n:
            raise ValueError(f"{k} clusters of {n} rows")
    chance = lambda turn: (F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), key), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    def dealt(centres: dict, schema: str, told):
        """``told(kind, keys, x, labels, distances)`` of each batch and kind, under a schema."""
        sent = spark.sparkContext.broadcast(centres)

        def run(frames):
            for frame in frames:
                for name, part in frame.groupby(kind, sort=False):
                    x = np.stack(part[vector].to_numpy()).astype(float)
                    yield told(name, part[key].to_numpy(), x, *_nearest(x, sent.value[name]))

        return rows.mapInPandas(run, schema)

    spread = lambda centres: dealt(centres, f"{kind} {types[kind]}, {key} {types[key]}, {vector} array<double>, distance double", lambda name, keys, x, _, d: pd.DataFrame({kind: name, key: keys, vector: list(x), "distance": d}))
    # as many rows as seats by the hash alone: the first of them is the first candidate, the others fill up where candidates are few
    least = Window.partitionBy(kind).orderBy(chance(-1), key)
    spare: dict = {}
    most = max((k for k, _ in seats.values()), default=0)
    drawn = rows.select(kind, key).withColumn("__gm_n", F.row_number().over(least)).where(F.col("__gm_n") <= most)  # vectors stay out of the sort
    for r in rows.join(F.broadcast(drawn), [kind, key]).orderBy("__gm_n").collect():
        if len(spare.setdefault(r[kind], [])) < seats[r[kind]][0]:
            spare[r[kind]].append(r[vector])
    found = {name: [own[0]] for name, own in spare.items()}
    arrays = lambda of: {name: np.array(own, dtype=float) for name, own in of.items()}
    for turn in range(TURNS):
        far = spread(arrays(found))
        costs = far.groupBy(kind).agg(F.sum("distance").alias("cost")).collect()  # a row a kind
        share = spark.createDataFrame([(r[kind], OVER * seats[r[kind]][0] / r["cost"]) for r in costs if r["cost"] > 0], f"__gm_k {types[kind]}, share double")
        taken = far.join(F.broadcast(share), F.col(kind).eqNullSafe(F.col("__gm_k"))).where(chance(turn) < F.col("distance") * F.col("share"))
        for r in taken.select(kind, key, vector).orderBy(key).collect():
            found[r[kind]].append(r[vector])
    now = {}
    weighed = dealt(arrays(found), f"{kind} {types[kind]}, at int, n long", lambda name, keys, x, labels, d: pd.DataFrame({kind: name, "at": np.unique(labels), "n": np.unique(labels, return_counts=True)[1]}))
    weights: dict = {name: np.zeros(len(own)) for name, own in found.items()}
    for r in weighed.groupBy(kind, "at").agg(F.sum("n").alias("n")).collect():  # a row a candidate
        weights[r[kind]][r["at"]] = r["n"]
    for name, own in found.items():
        k, w = seats[name][0], weights[name]
        more = spare[name][: max(0, k - len(own))]
        now[name] = kmeans(np.array(own + more, dtype=float), k, seed, weights=np.concatenate([w, np.full(len(more), 1e-9)]))[1]

    def sums(name, keys, x, labels, d):
        own = np.unique(labels)
        return pd.DataFrame({kind: name, "cluster": own, "n": [int((labels == c).sum()) for c in own], "total": [x[labels == c].sum(axis=0).tolist() for c in own]})

    for _ in range(rounds):
        parts = dealt(now, f"{kind} {types[kind]}, cluster int, n long, total array<double>", sums)
        means = parts.select(kind, "cluster", "n", F.posexplode("total").alias("i", "x")).groupBy(kind, "cluster", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
        told = means.groupBy(kind, "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre")).collect()  # the centres
        new = {name: v.copy() for name, v in now.items()}  # an empty cluster keeps its centre
        for r in told:
            new[r[kind]][r["cluster"]] = r["centre"]
        still = all(np.allclose(new[name], now[name], rtol=0, atol=1e-9) for name in now)
        now = new
        if still:
            break
    return dealt(now, f"{kind} {types[kind]}, {key} {types[key]}, cluster int, distance double", lambda name, keys, x, labels, d: pd.DataFrame({kind: name, key: keys, "cluster": labels, "distance": d}))


def _distinct(rows: DataFrame, group: list[str], order: list, most: Column | int) -> DataFrame:
    """Of each group the first ``most`` rows by the order, one a text; ``rank`` from 1. Copies of a text are one row before
    anything is ranked, so a text with many rows takes one place."""
    first = rows.withColumn("__gm_n", F.row_number().over(Window.partitionBy(*group, "text").orderBy(*order))).where("__gm_n = 1").drop("__gm_n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= most)


def select_gold(df: DataFrame, budget: int, kind: str = "kind", key: str = "row_id", text: str = "text", vector: str = "vector", score: Column | None = None, penalty: Column | None = None, least: int = 12, extra: int = 40, share: float = 0.08, seed: int = 0, ws=None) -> DataFrame:
    """(key, kind, method) of exactly ``budget`` records, no normalised text twice.

    In turn: of each cluster (a kind has as many as seats, but for those of its outliers) the row nearest to the centre,
    ties by ``penalty`` (boilerplate) and key, and where its text is claimed already the next one; of each kind, from what
    is left, the furthest rows, ``share`` of its seats but none of its first ``least``; records that look like several
    topics (``score`` of 2 or more), ``extra`` at most; the nearest others.

    Ranking is distributed and by distinct texts. A claim can be passed over at most once a seat, so of each group the
    driver gets at most ``budget`` candidates more than it has places: a bounded number of rows without texts. ``df`` is read
    once: vectors with the hashes of texts are written, and so are clustered records, since both are read many times.
    """
    from ..functions.text import normalize
    from ..storage import Workspace

    ws = ws or Workspace(df.sparkSession, "gold")
    none = F.lit(0.0)
    hashed = [F.md5(normalize(F.col(text))).alias("text"), (none if score is None else score).alias("score"), (none if penalty is None else penalty).alias("penalty")]
    rows = ws.table("rows", df.select(key, F.col(kind).cast("string").alias(kind), vector, *hashed))
    seats = quotas(rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("support")), budget, least)
    room = F.greatest(F.lit(0), F.least(F.floor(F.col("quota") * share), F.col("quota") - least)).cast("int")
    seats = ws.table("seats", seats.withColumn("room", room).withColumn("quota", F.col("quota") - F.col("room")))
    clustered = cluster(rows, seats, kind, key, vector, seed)
    texts = rows.select(key, "text", "score", "penalty")
    told = ws.table("told", clustered.join(texts, key).join(F.broadcast(seats.select(F.col("kind").alias(kind), "room")), kind))
    near = ["distance", "penalty", key]
    centroid = _distinct(told, [kind, "cluster"], near, budget + 1)
    far = _distinct(told, [kind], [F.col("distance").desc(), "penalty", key], F.col("room") + budget)
    several = _distinct(told.where("score >= 2").withColumn("one", F.lit(0)), ["one"], [F.col("score").desc(), *near], extra + budget)
    others = _distinct(told.withColumn("one", F.lit(0)), ["one"], near, 2 * budget)
    cols = ["text", kind, key, "cluster", "room", "rank"]
    taken: set[str] = set()
    out: list[tuple] = []

    def claim(candidates, places: int, method: str) -> None:
        for r in candidates:
            if places <= 0 or len(out) >= budget:
                return
            if r["text"] not in taken:
                taken.add(r["text"])
                out.append((r[key], r[kind], method))
                places -= 1

    def groups(frame: DataFrame, by: list[str]):
        held: dict = {}
        for r in frame.select(*cols).orderBy(*by, "rank").collect():
            held.setdefault(tuple(r[c] for c in by), []).append(r)
        return held.values()

    for own in groups(centroid, [kind, "cluster"]):
        claim(own, 1, "centroid")
    for own in groups(far.where("room > 0"), [kind]):
        claim(own, own[0]["room"], "outlier")
    for own in groups(several, []):
        claim(own, extra, "multi")
    for own in groups(others, []):
        claim(own, budget, "fill")
    if len(out) < budget:
        raise ValueError(f"only {len(out)} different texts for {budget} seats")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ws.drop("rows", "seats", "told")
    return df.sparkSession.createDataFrame(out, f"{key} {kinds[key]}, kind string, method string")


def selection_statistics(records: DataFrame, selected: DataFrame, kinds: list[str], splits: list[str], methods=("centroid", "outlier", "multi", "fill"), kind: str = "kind", split: str = "split", text: str = "text") -> DataFrame:
    """(statistic, value, n): selected and all records by kind, split and method, zeros included, and selected texts that
    repeat another. ``selected``: kind, split, method, text."""
    from ..functions.text import normalize

    spark = records.sparkSession
    names = [("selected by kind", kinds), ("support", kinds), ("selected by split", splits), ("records by split", splits), ("method", list(methods)), ("total", ["selected", "records", "repeated texts"])]
    want = spark.createDataFrame([(s, v) for s, vs in names for v in vs], "statistic string, value string")
    count = lambda df, name, c: df.groupBy(c.cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("statistic"), "value", "n")
    got = count(selected, "selected by kind", F.col(kind)).unionByName(count(records, "support", F.col(kind))).unionByName(count(selected, "selected by split", F.col(split)))
    got = got.unionByName(count(records, "records by split", F.col(split))).unionByName(count(selected, "method", F.col("method")))
    got = got.unionByName(count(selected, "total", F.lit("selected"))).unionByName(count(records, "total", F.lit("records")))
    repeated = selected.agg((F.count("*") - F.countDistinct(normalize(F.col(text)))).alias("n")).select(F.lit("total").alias("statistic"), F.lit("repeated texts").alias("value"), "n")
    return want.join(got.unionByName(repeated), ["statistic", "value"], "left").select("statistic", "value", F.coalesce("n", F.lit(0)).alias("n"))
