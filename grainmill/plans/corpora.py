"""Queries of training streams, the evaluation suite's lists, baselines and exposure reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, baseline, builder, streams
from ..storage import Workspace
from .suites import _sql, cases
from .tables import JUDGEMENTS, appeals, judgements, table

#: Sources of the driver's documents as kinds with domains.
MAPPING = {"src0": "roads", "src1": "water", "src2": "heating", "src3": "housing", "src4": "transport", "src5": "sanitation", "src6": "water", "src7": "other"}


def _examples(spark: SparkSession, d: str) -> DataFrame:
    """Cases as examples; issues of topics about roads and water without an object are blank, as if nothing were left."""
    blank = lambda t: t["domain"].isin("roads", "water") & (t["object"] == "")
    topics = F.transform("expected", lambda t: t.withField("issue", F.when(blank(t), "").otherwise(t["issue"])))
    uid = F.concat(F.when(F.col("id") % 9 == 0, "MT-REAL-").otherwise("e-"), F.col("id").cast("string"))
    return cases(spark, d).select("id", uid.alias("uid"), "category", "text", topics.alias("topics"))


def _streams(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = _examples(spark, d)
    return e.where("category < 'H'"), e.where("category between 'H' and 'L'"), e.where("category > 'L'")


def training_corpus(spark: SparkSession, d: str) -> DataFrame:
    return streams.corpus(*_streams(spark, d)).select("stream", "uid")


def dropped_examples(spark: SparkSession, d: str) -> DataFrame:
    single, _, several = _streams(spark, d)
    return streams.dropped(single, several)


def extended_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with a same-object stream of the cases of two topics, by stream."""
    e = _examples(spark, d).where("size(topics) = 2").withColumn("uid", F.concat(F.lit("MT-SYN-SO-"), F.col("id").cast("string")))
    return streams.with_same_object(streams.corpus(*_streams(spark, d)), e).groupBy("stream").agg(F.count("*").alias("rows"), F.countDistinct(F.split("uid", "#")[0]).alias("examples"))


def held_out_examples(spark: SparkSession, d: str) -> DataFrame:
    e = _examples(spark, d).withColumn("synthetic", ~F.col("uid").startswith("MT-REAL"))
    return streams.held_out_examples(e, 0.05).where("held").select("uid", "synthetic")


def kept_provenance(spark: SparkSession, d: str) -> DataFrame:
    rows = streams.corpus(*_streams(spark, d))
    provenance = _examples(spark, d).select("uid", F.lit(1).alias("n_sources"))
    return streams.of_uids(rows, provenance).select("uid")


def _pool(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = appeals(spark, d).withColumn("uid", F.col("row_id").cast("string"))
    return a.where("row_id % 5 <> 0"), a.where("row_id % 5 = 0")


def styled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Examples of two complaints each: (uid, synthetic, held, leaks, n_topics)."""
    records, frozen = _pool(spark, d)
    real = _examples(spark, d).where("uid like 'MT-REAL%' and size(topics) = 2").select("uid", "text", "topics")
    told = streams.multitopic_set(records, frozen, real, {"registry": 40, "joined": 40, "note": 0}, Workspace(spark, "pairs"), MAPPING)
    return told.select("uid", "synthetic", "held", "leaks", F.size("topics").alias("n_topics"))


def relabelled_topics(spark: SparkSession, d: str) -> DataFrame:
    """Relabelled examples, those of several topics each from its own issue: counts by category."""
    e = _examples(spark, d)
    return streams.relabel_counts(streams.relabelled(e, F.size("topics") > 1), "category")


def terse_examples(spark: SparkSession, d: str) -> DataFrame:
    a = appeals(spark, d)
    pool = streams.terse_pool(a, streams.labels.note_kernel(F.col("content")))
    return streams.terse_examples(pool, "row_id", mapping=MAPPING).select("uid", F.length("text").alias("chars"))


def _case_rows(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return c.select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("id"), "category", F.when(F.col("id") % 2 == 0, "real").otherwise("composed").alias("kind"), F.array(F.when(F.col("id") % 3 == 0, "test").otherwise("validation")).alias("splits"), "text",
                    F.col("expected").alias("expected_topics"), "expected_topic_count", F.array_sort(F.array_distinct("expected_domains")).alias("expected_domains"))


def finished_cases(spark: SparkSession, d: str) -> DataFrame:
    return builder.finish(_case_rows(spark, d)).select("id")


def suite_statistics(spark: SparkSession, d: str) -> DataFrame:
    return builder.statistics(builder.distinct_cases(_case_rows(spark, d)))


def tfidf_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of each fourth document's source, of those that the others have, too, from the others'."""
    a = appeals(spark, d).select("row_id", "kind", "content")
    fourth = F.pmod(F.xxhash64("row_id"), F.lit(4)) == 0
    train = a.where(~fourth)
    test = a.where(fourth).join(train.select("kind").distinct(), "kind", "left_semi")
    return baseline.run_tfidf(train, test.select(*a.columns), Workspace(spark, "tfidf"))


def error_report(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the error analysis, with how many rows each part of it has."""
    r = baseline.report(judgements(spark, d))
    told = {k: float(r[k]) for k in ("n_test", "n_errors", "error_rate", "accuracy", "macro_f1", "weighted_f1")}
    told |= {"reproduces_saved": float(r["reproduces_saved"]), "confusions": float(len(r["confusions"])), "surest": float(len(r["surest"])), "cells": float(sum(map(sum, r["matrix"])))}
    return spark.createDataFrame(sorted(told.items()), "metric string, value double")


def baseline_change(spark: SparkSession, d: str) -> DataFrame:
    """Quality as the prediction of toxicity against its opposite: metrics and their change."""
    from ..operators import curate, measure

    j = judgements(spark, d)
    labels = curate.label_map(j.select(F.col("true_kind").alias("kind")).union(j.select("predicted_kind")))
    cells = lambda df: measure.summary(measure.confusion(df, labels))
    other = j.withColumn("predicted_kind", 1 - F.col("predicted_kind"))
    told = baseline.compare(cells(j), cells(other))
    return told.select("metric", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"), F.round("delta", 6).alias("delta"), "improved")


def exposure_totals(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), F.col("n_chars").alias("rows"), "lang", F.col("doc_id") % 10 == 0)
    files = files.toDF("path", "sha256", "bytes", "rows", "class", "alias")
    return audit.exposure(files)


def class_exposure(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), F.col("n_chars").alias("rows"), F.col("lang").alias("class"), F.lit(False).alias("alias"))
    return audit.exposure_by(files, "class")


def read_by(spark: SparkSession, d: str) -> DataFrame:
    """Passages of the benchmark that pages' addresses mention by name: (path, reader)."""
    files = table(spark, d, "nation").select(F.concat(F.lit("data/"), F.lower("n_name"), F.lit("/rows.jsonl")).alias("path"))
    bodies = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("reads "), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lower("c_mktsegment"), F.lit("/rows.jsonl"))).otherwise(F.concat(F.lit("rows.jsonl of nation"), F.col("c_nationkey").cast("string")))).alias("body"))
    nations = table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("n"))
    readers = bodies.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("reader"), F.concat("body", F.lit(" "), "n").alias("body"))
    return audit.read_by(files, readers, Workspace(spark, "readers")).groupBy("path").agg(F.count("*").alias("n"))


def mentioned_terms(spark: SparkSession, d: str) -> DataFrame:
    """Longer words of the benchmark with the number of conversation turns that hold them, inside of other words, too."""
    terms = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\pL{7,})"), F.lit(1))).alias("term"))
    turns = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("reader"), F.col("text").alias("body"))
    found = audit.mentions(terms.select(F.array("term").alias("needle")), turns, Workspace(spark, "terms"))
    return found.groupBy(F.col("needle")[0].alias("term")).agg(F.count("*").alias("n"))


def distribution_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks over paths and documents: (check, ok, found)."""
    paths = table(spark, d, "nation").select(F.concat(F.lit("data/"), "n_name", F.when(F.col("n_nationkey") % 7 == 0, ".bin").otherwise(".md")).alias("path"))
    docs = table(spark, d, "region").select(F.col("r_name").alias("doc"), F.concat(F.lit("Region "), "r_name", F.lit("\nStatus: `ready`")).alias("text"))
    return audit.distribution_checks(paths, docs, [("binaries", r"\.bin$"), ("archives", r"\.zip$")], [("names itself", "AFRICA", "AFRICA"), ("names another", "AFRICA", "ASIA"), ("status", "ASIA", r"Status:\s*`(ready|held)`")], [("no claim", r"(?i)certified")])


def split_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("source").alias("split"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    return audit.split_fingerprints(files)


QUERIES = {
    f.__name__: f
    for f in (
        training_corpus, dropped_examples, extended_corpus, held_out_examples, kept_provenance, styled_pairs, relabelled_topics, terse_examples, finished_cases, suite_statistics,
        tfidf_baseline, error_report, baseline_change, exposure_totals, class_exposure, read_by, mentioned_terms, distribution_checks, split_fingerprints,
    )
}

_EX = f"""WITH {_sql('0')}, ex AS (SELECT id, category, text, CASE WHEN id % 9 = 0 THEN 'MT-REAL-' ELSE 'e-' END || id AS uid, len(exp) AS n, len(list_filter(exp, lambda t: t.d IN ('roads', 'water') AND t.o = '')) AS blank FROM cs),
kp AS (SELECT *, CASE WHEN category < 'H' THEN 'single' WHEN category <= 'L' THEN 'terse' ELSE 'multitopic' END AS stream FROM ex WHERE CASE WHEN category > 'L' THEN blank = 0 ELSE blank < n END),
co AS (SELECT stream, uid, i FROM kp, (SELECT unnest(range(12)) AS i) WHERE i < CASE stream WHEN 'single' THEN 1 WHEN 'terse' THEN 8 ELSE CASE WHEN starts_with(uid, 'MT-REAL') THEN 12 ELSE 3 END END)"""
_FIN = f"""WITH {_sql('0')}, fi AS (SELECT 'c' || lpad(CAST(id AS VARCHAR), 8, '0') AS id, category, CASE WHEN id % 2 = 0 THEN 'real' ELSE 'composed' END AS kind, CASE WHEN id % 3 = 0 THEN 'test' ELSE 'validation' END AS split, text, exp FROM cs
  QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY id) = 1)"""
_CLS = f"""{JUDGEMENTS}, lab AS (SELECT unnest([0, 1]) AS k)"""


def _summary(pred: str, name: str) -> str:
    return f"""{name}c AS (SELECT k, (SELECT count(*) FROM judgements WHERE true_kind = k AND {pred} = k) AS tp, (SELECT count(*) FROM judgements WHERE true_kind = k) AS s, (SELECT count(*) FROM judgements WHERE {pred} = k) AS p FROM lab),
{name}p AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE tp / p::DOUBLE END AS pr, CASE WHEN s = 0 THEN 0 ELSE tp / s::DOUBLE END AS rc FROM {name}c), {name}f AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM {name}p),
{name} AS (SELECT sum(tp) / sum(s)::DOUBLE AS accuracy, avg(pr) AS macro_precision, avg(rc) AS macro_recall, avg(f1) AS macro_f1, sum(pr * s) / sum(s) AS weighted_precision, sum(rc * s) / sum(s) AS weighted_recall, sum(f1 * s) / sum(s) AS weighted_f1 FROM {name}f)"""


ORACLE_SQL = {
    "training_corpus": f"{_EX} SELECT stream, uid || CASE WHEN i = 0 THEN '' ELSE '#' || i END AS uid FROM co",
    "dropped_examples": f"{_EX} SELECT 'single' AS stream, count(*) FILTER (WHERE blank = n) AS dropped FROM ex WHERE category < 'H' UNION ALL SELECT 'multitopic', count(*) FILTER (WHERE blank > 0) FROM ex WHERE category > 'L'",
    "extended_corpus": f"{_EX} SELECT stream, count(*) AS rows, count(DISTINCT uid) AS examples FROM co GROUP BY stream UNION ALL SELECT 'same_object', count(*), count(*) FROM ex WHERE n = 2",
    "held_out_examples": f"""{_EX}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE id % 9 = 0) AS r FROM ex), k AS (SELECT *, greatest(8, CAST(round_even(0.05 * n, 0) AS BIGINT)) AS h, greatest(1, least(r, CAST(round_even(0.05 * r, 0) AS BIGINT))) AS hr FROM c),
      o AS (SELECT uid, id % 9 <> 0 AS synthetic, row_number() OVER (PARTITION BY id % 9 <> 0 ORDER BY md5('42:' || uid), uid) AS nth FROM ex) SELECT uid, synthetic FROM o, k WHERE nth <= CASE WHEN synthetic THEN greatest(0, h - hr) ELSE hr END""",
    "kept_provenance": f"{_EX} SELECT uid FROM kp",
    "finished_cases": f"{_FIN} SELECT id FROM fi",
    "suite_statistics": f"""{_FIN}, l AS (SELECT length(text) AS len, row_number() OVER (ORDER BY length(text)) - 1 AS pos, count(*) OVER () AS m FROM fi)
      SELECT 'cases' AS statistic, 'all' AS value, count(*) AS n FROM fi UNION ALL SELECT 'category', category, count(*) FROM fi GROUP BY category UNION ALL SELECT 'provenance', kind, count(*) FROM fi GROUP BY kind UNION ALL SELECT 'split', split, count(*) FROM fi GROUP BY split
      UNION ALL SELECT 'topics', CAST(len(exp) AS VARCHAR), count(*) FROM fi GROUP BY len(exp) UNION ALL SELECT 'domain', d, count(*) FROM (SELECT unnest(list_distinct(list_transform(exp, lambda t: t.d))) AS d FROM fi) GROUP BY d
      UNION ALL SELECT 'length', w, len FROM (SELECT len, unnest(list_filter([CASE WHEN pos = 0 THEN 'min' WHEN pos = m - 1 THEN 'max' END, CASE WHEN pos = m // 4 THEN 'p25' END, CASE WHEN pos = m * 2 // 4 THEN 'median' END, CASE WHEN pos = m * 3 // 4 THEN 'p75' END], lambda x: x IS NOT NULL)) AS w FROM l)""",
    "error_report": f"""WITH {_CLS}, {_summary('predicted_kind', 'a')}, e AS (SELECT count(*) AS n, count(*) FILTER (WHERE true_kind <> predicted_kind) AS w, count(DISTINCT (true_kind, predicted_kind)) FILTER (WHERE true_kind <> predicted_kind) AS c FROM judgements)
      SELECT 'n_test' AS metric, n::DOUBLE AS value FROM e UNION ALL SELECT 'n_errors', w FROM e UNION ALL SELECT 'error_rate', round(w / n::DOUBLE, 4) FROM e UNION ALL SELECT 'accuracy', round(accuracy, 4) FROM a UNION ALL SELECT 'macro_f1', round(macro_f1, 4) FROM a
      UNION ALL SELECT 'weighted_f1', round(weighted_f1, 4) FROM a UNION ALL SELECT 'reproduces_saved', 1 UNION ALL SELECT 'confusions', c FROM e UNION ALL SELECT 'surest', least(w, 20) FROM e UNION ALL SELECT 'cells', n FROM e""",
    "baseline_change": f"""WITH {_CLS}, {_summary('predicted_kind', 'a')}, {_summary('(1 - predicted_kind)', 'b')},
      u AS (SELECT * FROM (UNPIVOT a ON COLUMNS(*) INTO NAME metric VALUE value)), v AS (SELECT * FROM (UNPIVOT b ON COLUMNS(*) INTO NAME metric VALUE baseline))
      SELECT metric, round(value, 6) AS value, round(baseline, 6) AS baseline, round(value - baseline, 6) AS delta, value > baseline AS improved FROM u JOIN v USING (metric)""",
    "exposure_totals": """WITH f AS (SELECT source || '/' || doc_id AS path, md5(text) AS h, strlen(text) AS b, n_chars AS r, doc_id % 10 = 0 AS alias FROM documents), g AS (SELECT h, arg_min(r, path) AS r, count(*) AS n FROM f WHERE NOT alias GROUP BY h)
      SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM f WHERE NOT alias) AS distinct_files, (SELECT count(*) FROM g) AS distinct_contents, (SELECT CAST(sum(b) AS BIGINT) FROM f) AS bytes, (SELECT CAST(sum(r) AS BIGINT) FROM f) AS rows,
        (SELECT CAST(sum(r) AS BIGINT) FROM g) AS distinct_rows, (SELECT CAST(sum(r) AS BIGINT) FROM f) - (SELECT CAST(sum(r) AS BIGINT) FROM g) AS duplicate_rows, (SELECT count(*) FROM g WHERE n > 1) AS duplicate_groups""",
    "class_exposure": "SELECT lang AS class, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(n_chars) AS BIGINT) AS rows FROM documents GROUP BY lang",
    "read_by": """WITH f AS (SELECT 'data/' || lower(n_name) || '/rows.jsonl' AS path, lower(n_name) AS d FROM nation),
      r AS (SELECT c_custkey, 'reads ' || CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) || '/rows.jsonl' ELSE 'rows.jsonl of nation' || c_nationkey END || ' ' || lower(n_name) AS body FROM customer JOIN nation ON c_nationkey = n_nationkey)
      SELECT path, count(*) AS n FROM f JOIN r ON contains(body, d || '/rows.jsonl') OR (contains(body, 'rows.jsonl') AND contains(body, d)) GROUP BY path""",
    "mentioned_terms": r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\pL{7,}')) AS term FROM benchmark), c AS (SELECT DISTINCT conv_id, turn, text FROM conversations)
      SELECT term, count(DISTINCT (conv_id, turn)) AS n FROM t JOIN c ON contains(text, term) GROUP BY term""",
    "distribution_checks": """SELECT 'binaries' AS "check", count(*) = 0 AS ok, count(*) AS found FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT 'archives', true, 0 UNION ALL SELECT 'names itself', true, 1 UNION ALL SELECT 'names another', false, 0 UNION ALL SELECT 'status', true, 1
      UNION ALL SELECT 'no claim', true, 0""",
    "split_fingerprints": "SELECT split, count(*) AS n, sha256(string_agg(e, '' ORDER BY encode(e))) AS tree_sha256 FROM (SELECT source AS split, CAST(doc_id AS VARCHAR) || ':' || sha256(text) AS e FROM documents) GROUP BY split",
}
