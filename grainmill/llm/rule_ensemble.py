"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every text are computed as Spark columns. Shallow trees are boosted on a bounded sample of labelled rows;
every path from a root to a node becomes a conjunctive rule; a logistic regression with an L1 penalty weighs the rules
and drops most; what is left is compiled to one Spark column expression, so scoring is a projection.

The sample: labelled rows whose CRC-32 of doc_id's text leaves a remainder other than 0 modulo 5, thinned by a hash of
doc_id to about ``SAMPLE_ROWS``. Everything else covers all rows. Labels, lang, source and doc_id are never inputs.

Nulls, ties, repeats: a null text counts as the empty one and is scored like it; labels that are null or not 0 or 1 are
left out; a document with several label rows counts once for each; with no training rows every score is 0.5, and with
one class it is that class's smoothed share; a null doc_id is not held out; equal rows give equal rows; an empty table
gives an empty result. Only doc_id and text, and doc_id and quality of the labels, are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace, unused
from .quality_rules import base_stats

#: Labelled rows that are collected for training, about; the bound of the driver's memory.
SAMPLE_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE = 24, 3, 48, 0.3
PENALTY, ROUNDS = 0.001, 400

FEATURES = (
    "log_words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "other_share", "space_share",
    "repeat_share", "dup_line_share", "distinct_share", "long_line", "lone_mark_share", "mark_run_share", "short_share",
)


def statistics(text: Column) -> Column:
    """Struct of the features of a text; all are 0 where it has no words."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    base = base_stats(
        text,
        lambda w: [
            F.size(F.array_distinct(w)).alias("distinct"),
            F.size(F.filter(w, lambda x: F.length(x) <= 3)).alias("short"),
        ],
    )
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)) / chars
    lines = F.size(F.split(text, "\n"))
    return F.transform(
        F.array(base),
        lambda s: F.struct(
            F.log1p(s["n_words"].cast("double")).alias("log_words"),
            (s["word_chars"] / F.greatest(s["n_words"], F.lit(1))).alias("word_length"),
            (s["n_symbols"] / chars).alias("symbol_share"),
            count(r"\p{Lu}").alias("upper_share"),
            count("[0-9]").alias("digit_share"),
            count(r"[.,;:!?]").alias("mark_share"),
            count(r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D.,;:!?]").alias("other_share"),
            (1 - s["word_chars"] / chars).alias("space_share"),
            (s["n_repeat_words"] / F.greatest(s["n_words"], F.lit(1))).alias("repeat_share"),
            (s["n_dup_lines"] / lines).alias("dup_line_share"),
            (s["distinct"] / F.greatest(s["n_words"], F.lit(1))).alias("distinct_share"),
            F.log1p(chars / lines).alias("long_line"),
            count(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D](?![^\x20\x09-\x0D])").alias("lone_mark_share"),
            count(r"[!?.]{2}").alias("mark_run_share"),
            (s["short"] / F.greatest(s["n_words"], F.lit(1))).alias("short_share"),
        ),
    )[0]


Condition = tuple[int, bool, float]  # feature, above, cut: x > cut if above, else x <= cut


@dataclass(frozen=True)
class Ensemble:
    """Rules as sets of conditions with their weights; an intercept; how many rules there were before the lasso."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    tried: int = 0

    def score(self, feature) -> Column:
        """The score as a column; ``feature(name)`` gives a feature's column."""
        total = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            met = F.lit(True)
            for f, above, cut in conditions:
                x = feature(FEATURES[f])
                met = met & ((x > F.lit(float(cut))) if above else (x <= F.lit(float(cut))))
            total = total + F.when(met, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.round(1 / (1 + F.exp(-total)), 9)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for conditions, weight in self.rules:
            z += weight * _met(x, conditions)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _met(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, cut in conditions:
        out &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def _grow(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: float) -> tuple[list[tuple[tuple[Condition, ...], np.ndarray, float]], np.ndarray]:
    """A tree by second-order gain over binned features: its nodes as paths with members and values, its output."""
    nodes, out = [], np.zeros(len(grad))
    stack = [((), np.arange(len(grad)), depth)]
    while stack:
        path, rows, left = stack.pop()
        g, h = grad[rows].sum(), hess[rows].sum()
        value = -g / (h + 1.0)
        if path:
            nodes.append((path, rows, value))
        best = (1e-6, -1, -1)
        if left and len(rows) >= 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gs = np.bincount(bins[rows, f], weights=grad[rows], minlength=len(c) + 1).cumsum()[:-1]
                hs = np.bincount(bins[rows, f], weights=hess[rows], minlength=len(c) + 1).cumsum()[:-1]
                ns = np.bincount(bins[rows, f], minlength=len(c) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] < 0:
            out[rows] = value
            continue
        _, f, k = best
        low = bins[rows, f] <= k
        cut = float(cuts[f][k])
        stack.append(((*path, (f, False, cut)), rows[low], left - 1))
        stack.append(((*path, (f, True, cut)), rows[~low], left - 1))
    return nodes, out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, rounds: int = ROUNDS) -> Ensemble:
    """Trees, their rules, the lasso. Deterministic; rows in any order give the same up to rounding."""
    n = len(y)
    if not n:
        return Ensemble(0.0, ())
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    if n < 20 or y.min() == y.max():
        return Ensemble(start, ())
    cuts = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        cuts.append(q[q < x[:, f].max()])
    bins = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    z, found = np.full(n, start), {}
    least = max(5, n // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        nodes, out = _grow(bins, cuts, p - y, p * (1 - p), depth, least)
        z += RATE * out
        for path, rows, _ in nodes:
            member = np.zeros(n, dtype=bool)
            member[rows] = True
            key = np.packbits(member).tobytes()
            found.setdefault(key, (_tidy(path), member))
    paths, members = [p for p, _ in found.values()], np.column_stack([m for _, m in found.values()]).astype(float)
    mean = members.mean(axis=0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    a = (members - mean) / scale
    step = 4 * n / (np.linalg.norm(a, 2) ** 2 + 1e-9)
    w, v, b, momentum = np.zeros(a.shape[1]), np.zeros(a.shape[1]), start, 1.0
    for _ in range(rounds):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-np.clip(a @ v + b, -30, 30)))
        new = v - step * (a.T @ (p - y)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= float((p - y).mean()) * 4
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, w, momentum = new + (momentum - 1) / nxt * (new - w), new, nxt
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    weights = w[kept] / scale[kept]
    return Ensemble(float(b - (weights * mean[kept]).sum()), tuple((paths[k], float(u)) for k, u in zip(kept, weights)), len(paths))


def _tidy(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One condition a feature and side: the tightest."""
    tight: dict[tuple[int, bool], float] = {}
    for f, above, cut in path:
        old = tight.get((f, above))
        tight[f, above] = cut if old is None else (max if above else min)(old, cut)
    return tuple((f, above, cut) for (f, above), cut in sorted(tight.items()))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def sample(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, quality) of the labelled rows that training may use, thinned by a hash to about ``sample_rows``."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    n, whole = own.count(), 1 << 62
    return own if n <= sample_rows else own.where(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < whole * sample_rows // n)


def train(stats: DataFrame, chosen: DataFrame) -> Ensemble:
    """``stats``: doc_id and the features; ``chosen``: the sample, which is collected with its features."""
    rows = stats.join(chosen, "doc_id").select("quality", *FEATURES).toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)  # the same sums in any order of arrival
    return fit(rows[list(FEATURES)].to_numpy(dtype=float), rows["quality"].to_numpy(dtype=float))


def score(documents: DataFrame, labels: DataFrame, ws: Workspace, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every text. Texts are read once."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), statistics(F.col("text").cast("string")).alias("s"))
    stats = ws.table("statistics", docs.select("doc_id", "s.*"))
    model = train(stats, sample(labels, sample_rows))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, ws: Workspace, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that the classifier accepts, with their columns. Trains on the same sample as ``score``, then reads
    texts once more and scores them in place, so that no text but the sample's is shuffled."""
    chosen = ws.table("sample", sample(labels, sample_rows))
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    stats = ws.table("statistics", own.select("doc_id", statistics(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*"))
    model = train(stats, chosen)
    columns = documents.columns
    s, total = unused(columns, "s", "score")
    scored = documents.withColumn(s, statistics(F.col("text").cast("string"))).withColumn(total, model.score(lambda name: F.col(s)[name]))
    return scored.where(F.col(total) >= THRESHOLD).select(*columns)
