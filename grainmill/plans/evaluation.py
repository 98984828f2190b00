"""Queries of metrics, comparisons, vectors and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import curate, measure, sample, scoring, vectors
from ..storage import Workspace
from .suites import conversation_sql
from .tables import JUDGEMENTS, judgements, norm, table


def _labels(df: DataFrame) -> DataFrame:
    return curate.label_map(df.select(F.col("true_kind").alias("kind")).union(df.select("predicted_kind")))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    j = judgements(spark, d)
    return measure.confusion(j, _labels(j))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return measure.ranked_classes(_cells(spark, d))


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    told = measure.summary(_cells(spark, d))
    return told.select("n", *[F.round(c, 6).alias(c) for c in told.columns if c != "n"])


def majority_share(spark: SparkSession, d: str) -> DataFrame:
    return measure.majority_share(_cells(spark, d)).select("kind", F.round("share", 6).alias("share"))


def top_confusions(spark: SparkSession, d: str) -> DataFrame:
    return measure.confusions(judgements(spark, d), 20)


def confident_errors(spark: SparkSession, d: str) -> DataFrame:
    return measure.top_errors(judgements(spark, d), 20).select("ordinal", "confidence")


def errors_by_label(spark: SparkSession, d: str) -> DataFrame:
    j = judgements(spark, d)
    return measure.errors_by_label(j, _labels(j)).select("kind", F.col("rank").cast("long").alias("rank"), "predicted", "ordinal")


def duplicate_errors(spark: SparkSession, d: str) -> DataFrame:
    return measure.duplicate_errors(judgements(spark, d), F.md5(normalize(F.col("content"))))


def segment_medians(spark: SparkSession, d: str) -> DataFrame:
    return measure.upper_median(table(spark, d, "customer"), "c_mktsegment", "c_acctbal")


def feature_crosstab(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return measure.crosstab(o, ["o_orderstatus", "year"], "o_orderpriority")


def _arms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two arms over the labelled documents: kept by quality, and kept as not toxic."""
    labels = table(spark, d, "labels")
    state = lambda c: F.when(c, "keep").otherwise("drop")
    a = labels.select("doc_id", state(F.col("quality") == 1).alias("state"), (F.col("quality") == 1).alias("ok"))
    return a, labels.select("doc_id", state(F.col("toxic") == 0).alias("state"), (F.col("toxic") == 0).alias("ok"))


def arm_transitions(spark: SparkSession, d: str) -> DataFrame:
    return measure.transitions(*_arms(spark, d), "doc_id", "state")


def arm_movement(spark: SparkSession, d: str) -> DataFrame:
    return measure.movement(*_arms(spark, d), "doc_id", "state", ["keep", "drop"])


def arm_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    a, b = _arms(spark, d)
    return measure.mcnemar(measure.paired(a, b, "doc_id", "ok")).select("n", "a_only", "b_only", F.round("p", 9).alias("p"))


def arm_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    a, b = _arms(spark, d)
    pairs = measure.paired(a, b, "doc_id", "ok").select(F.col("doc_id").alias("id"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    return measure.bootstrap(pairs)


def segment_subsets(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    subsets = {"all": F.lit(True), "returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") >= 40, "open": F.col("l_linestatus") == "O"}
    return measure.overlapping(li, subsets, {"n": F.count("*"), "quantity": F.sum(F.col("l_quantity").cast("long"))})


def _gated(spark: SparkSession, d: str) -> DataFrame:
    """Gates over the kept share and the toxic share of each language; ``length`` is a metric that nobody measured."""
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    told = labels.groupBy(F.col("lang").alias("arm")).agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    observed = told.select("arm", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("metric", "value"))
    rules = spark.createDataFrame(
        [("quality", "quality", 0.8, None, True, False), ("toxic", "toxic", None, 0.125, True, False), ("length", "length", 1.0, None, False, True)],
        "gate string, metric string, at_least double, at_most double, blocking boolean, null_if_missing boolean",
    )
    return measure.gates(observed, rules)


def release_gates(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).withColumn("passed", F.coalesce(F.col("passed").cast("string"), F.lit("missing")))


def release_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return measure.verdicts(_gated(spark, d))


def verdict_of_change(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") - 25).alias("delta"), (F.col("p_partkey") % 2 == 0).alias("higher"))
    told = measure.verdict_of_change(F.when(F.col("delta") % 10 != 0, F.col("delta")), F.when(F.col("p_partkey") % 3 != 0, F.col("higher")), F.lit(3))
    return p.select("p_partkey", told.alias("verdict"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases and predictions made of conversations: the user's turn's sentences as expected topics, the assistant's as
    predicted ones, domains by length."""
    from ..functions.text import sentences

    c = table(spark, d, "conversations")
    names = F.array(*[F.lit(x) for x in scoring.DOMAINS])

    def topics(text) -> F.Column:
        one = lambda s: F.struct(F.get(names, F.length(s) % len(scoring.DOMAINS)).alias("domain"), s.alias("issue"), F.lit("").alias("object"), F.left(s, F.lit(12)).alias("requested_action"), F.create_map().cast("map<string,string>").alias("attributes"))
        return F.transform(sentences(text), one)

    first = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    reply = c.where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("reply"))
    both = first.join(reply, "conv_id")
    return both.select(
        F.col("conv_id").alias("id"), (F.col("conv_id") % 5).alias("category"), "text", topics(F.col("text")).alias("expected"), topics(F.col("reply")).alias("topics"), (F.length("reply") > 0).alias("parsed"), F.lit(True).alias("schema_ok")
    )


def case_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.per_case(_cases(spark, d), "(?i)thank|please")


def case_behaviour(spark: SparkSession, d: str) -> DataFrame:
    return scoring.behaviour(_cases(spark, d)).select("id", "behaviour")


def suite_means(spark: SparkSession, d: str) -> DataFrame:
    return scoring.suite_means(case_scores(spark, d), "category")


def failure_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return scoring.taxonomy(case_scores(spark, d)).select("category", "failure", "n", F.col("level").cast("long").alias("level"))


def case_structure(spark: SparkSession, d: str) -> DataFrame:
    return scoring.structure(_cases(spark, d))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def unit_norms(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return v.select("vec_id", F.round(sample.norm(F.col("vector")), 5).alias("norm"), F.round(sample.norm(sample.unit(F.col("vector"))), 6).alias("unit_norm"))


def centroid_distances(spark: SparkSession, d: str) -> DataFrame:
    return sample.centroid_distance(_vectors(spark, d), "label", "vector").select("vec_id", "label", F.round("distance", 5).alias("distance"))


def label_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).withColumn("kind", F.col("label").cast("string"))
    seats = sample.quotas(v.groupBy("kind").agg(F.count("*").alias("support")), 60, 3)
    return sample.cluster(v, seats, "kind", "vec_id", "vector")


def gold_selection(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    v = _vectors(spark, d).join(docs, F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("row_id"), F.col("label").alias("kind"), "vector", "text")
    return sample.select_gold(v, 60, least=3, ws=Workspace(spark, "gold"))


FOLDS = 5


def embedding_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Held-out predictions of all vectors: each fifth is predicted by a classifier that never saw it, tuned on the next
    fifth over the whole grid and fitted on all four others. A fold's predictions are written, so that its model and plans
    go before the next one."""
    v, ws = _vectors(spark, d), Workspace(spark, "folds")
    fold = F.pmod(F.xxhash64("vec_id"), F.lit(FOLDS))
    out = None
    for k in range(FOLDS):
        rest, held, val = v.where(fold != k), v.where(fold == k), fold == (k + 1) % FOLDS
        c = vectors.VectorClassifier()
        c.tune(rest.where(~val), rest.where(val))
        told = c.fit(rest).predict(held).select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"), "confidence")
        told = ws.table(f"fold-{k}", told)
        out = told if out is None else out.unionByName(told)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        confusion_matrix, class_metrics, metric_summary, majority_share, top_confusions, confident_errors, errors_by_label, duplicate_errors, segment_medians, feature_crosstab, arm_transitions,
        arm_movement, arm_mcnemar, arm_bootstrap, segment_subsets, release_gates, release_verdicts, verdict_of_change, case_scores, case_behaviour, suite_means, failure_taxonomy, case_structure,
        unit_norms, centroid_distances, label_clusters, gold_selection, embedding_classifier,
    )
}

_CELLS = f"""{JUDGEMENTS}, lab AS (SELECT DISTINCT k FROM (SELECT true_kind AS k FROM judgements UNION SELECT predicted_kind FROM judgements)),
  cells AS (SELECT a.k AS true_label, b.k AS pred_label, count(j.ordinal) AS n FROM lab a CROSS JOIN lab b LEFT JOIN judgements j ON j.true_kind = a.k AND j.predicted_kind = b.k GROUP BY 1, 2),
  cls AS (SELECT k AS kind, (SELECT sum(n) FROM cells WHERE true_label = k AND pred_label = k) AS tp, (SELECT sum(n) FROM cells WHERE true_label = k) AS support, (SELECT sum(n) FROM cells WHERE pred_label = k) AS predicted FROM lab),
  pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp::DOUBLE / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS recall FROM cls),
  per AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""
_ARMS = "arms AS (SELECT doc_id, quality = 1 AS a, toxic = 0 AS b FROM labels)"
_GATES = """gates AS (
  SELECT lang AS arm, 'quality' AS gate, avg(quality) AS observed, true AS blocking, avg(quality) >= 0.8 AS passed FROM labels JOIN documents USING (doc_id) GROUP BY lang
  UNION ALL SELECT lang, 'toxic', avg(toxic), true, avg(toxic) <= 0.125 FROM labels JOIN documents USING (doc_id) GROUP BY lang
  UNION ALL SELECT DISTINCT lang, 'length', CAST(NULL AS DOUBLE), false, CAST(NULL AS BOOLEAN) FROM labels JOIN documents USING (doc_id))"""

ORACLE_SQL = {
    **conversation_sql(),
    "confusion_matrix": f"WITH {_CELLS} SELECT true_label, pred_label, n FROM cells",
    "class_metrics": f"WITH {_CELLS} SELECT kind, CAST(tp AS BIGINT) AS tp, CAST(support AS BIGINT) AS support, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM per",
    "metric_summary": f"""WITH {_CELLS} SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
      round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM per""",
    "majority_share": f"""WITH {_CELLS} SELECT kind, round(predicted::DOUBLE / (SELECT sum(n) FROM cells), 6) AS share FROM per ORDER BY support DESC, kind LIMIT 1""",
    "top_confusions": f"""WITH {JUDGEMENTS} SELECT true_kind AS true_label, predicted_kind AS pred_label, count(*) AS n, min(ordinal) AS first FROM judgements WHERE true_kind <> predicted_kind GROUP BY 1, 2
      ORDER BY n DESC, first LIMIT 20""",
    "confident_errors": f"WITH {JUDGEMENTS} SELECT ordinal, confidence FROM judgements WHERE true_kind <> predicted_kind ORDER BY confidence DESC, ordinal LIMIT 20",
    "errors_by_label": f"""WITH {JUDGEMENTS}, lab AS (SELECT DISTINCT k AS kind FROM (SELECT true_kind AS k FROM judgements UNION SELECT predicted_kind FROM judgements)),
      e AS (SELECT true_kind AS kind, row_number() OVER (PARTITION BY true_kind ORDER BY confidence DESC, ordinal) AS rank, predicted_kind AS predicted, ordinal FROM judgements WHERE true_kind <> predicted_kind)
      SELECT lab.kind, e.rank, e.predicted, e.ordinal FROM lab LEFT JOIN (SELECT * FROM e WHERE rank <= 5) e ON lab.kind = e.kind""",
    "duplicate_errors": f"""WITH {JUDGEMENTS} SELECT md5({norm('content')}) AS text, count(*) AS n, arg_min(true_kind, ordinal) AS true_label, arg_min(predicted_kind, ordinal) AS pred_label, min(ordinal) AS first
      FROM judgements WHERE true_kind <> predicted_kind GROUP BY 1 HAVING count(*) > 1""",
    "segment_medians": "SELECT c_mktsegment, list_sort(list(c_acctbal))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median FROM customer GROUP BY c_mktsegment",
    "feature_crosstab": """SELECT 'o_orderstatus' AS feature, o_orderstatus AS value, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 2, 3
      UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), o_orderpriority, count(*) FROM orders GROUP BY 2, 3""",
    "arm_transitions": f"WITH {_ARMS} SELECT CASE WHEN a THEN 'keep' ELSE 'drop' END AS \"from\", CASE WHEN b THEN 'keep' ELSE 'drop' END AS \"to\", count(*) AS n FROM arms GROUP BY 1, 2",
    "arm_mcnemar": f"""WITH {_ARMS}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE a AND NOT b) AS a_only, count(*) FILTER (WHERE b AND NOT a) AS b_only FROM arms)
      SELECT n, a_only, b_only, round(CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(a_only, b_only) + 1),
        lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))))) END, 9) AS p FROM c""",
    "arm_movement": f"WITH {_ARMS} SELECT doc_id, CASE WHEN b AND NOT a THEN 'improved' WHEN a AND NOT b THEN 'regressed' ELSE 'unchanged' END AS movement FROM arms",
    "segment_subsets": """WITH s AS (SELECT unnest(list_filter(['all', CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_quantity >= 40 THEN 'large' END, CASE WHEN l_linestatus = 'O' THEN 'open' END], lambda x: x IS NOT NULL)) AS subset,
      l_quantity FROM lineitem) SELECT subset, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM s GROUP BY subset""",
    "release_gates": f"WITH {_GATES} SELECT arm, gate, observed, blocking, coalesce(CAST(passed AS VARCHAR), 'missing') AS passed FROM gates",
    "release_verdicts": f"""WITH {_GATES} SELECT arm, CASE WHEN count(*) FILTER (WHERE blocking AND passed IS NULL) > 0 THEN 'INCOMPLETE' WHEN count(*) FILTER (WHERE blocking AND NOT passed) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict
      FROM gates GROUP BY arm""",
    "verdict_of_change": """SELECT p_partkey, CASE WHEN (p_size - 25) % 10 = 0 THEN 'unresolved' WHEN abs(p_size - 25) <= 3 THEN 'unchanged' WHEN p_partkey % 3 = 0 THEN 'unresolved'
      WHEN (p_partkey % 2 = 0) = (p_size > 25) THEN 'improved' ELSE 'regressed' END AS verdict FROM part""",
    "unit_norms": """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings""",
    "centroid_distances": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM e GROUP BY label, i)
      SELECT vec_id, label, round(sum((x - c) * (x - c)), 5) AS distance FROM e JOIN c USING (label, i) GROUP BY vec_id, label""",
}
