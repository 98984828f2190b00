"""Queries of curation, leakage, labels and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import curate, sample
from .tables import APPEALS, SPLITS, TEST_FROM, VALIDATION_FROM, appeals, norm, ordinal, table

#: For the driver's texts, which hold no Ukrainian: a beginning that many have, and two labels.
NOISE, BROAD = r"^the[\p{L}\p{N}_]*\s", ("src1", "src2")


def _split(spark: SparkSession, d: str) -> DataFrame:
    return curate.chronological_split(appeals(spark, d), VALIDATION_FROM, TEST_FROM)


def corpus_funnel(spark: SparkSession, d: str) -> DataFrame:
    return curate.funnel(appeals(spark, d), VALIDATION_FROM, TEST_FROM, 30, NOISE, BROAD)


def noise_flags(spark: SparkSession, d: str) -> DataFrame:
    return appeals(spark, d).select("row_id", curate.is_noise(F.col("content"), NOISE).alias("noise"), curate.is_broad(F.col("kind"), BROAD).alias("broad"))


def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(t.normalize(F.col("text"))).alias("norm_md5"), F.length(t.normalize(F.col("text"))).cast("long").alias("norm_chars"))


def dedup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return curate.dedup_pairs(appeals(spark, d)).select("row_id", "kind")


def dedup_normalized(spark: SparkSession, d: str) -> DataFrame:
    return curate.dedup_normalized(appeals(spark, d)).select("row_id", "kind")


def min_support(spark: SparkSession, d: str) -> DataFrame:
    return curate.min_support(appeals(spark, d), 50).select("row_id", "kind")


def chronological_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("row_id", "split")


def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    found = curate.leakage(_split(spark, d))
    return found.select(F.md5("text").alias("text_md5"), F.array_join("splits", ",").alias("splits"), F.col("rows").alias("n_rows"))


def first_split(spark: SparkSession, d: str) -> DataFrame:
    return curate.first_split(_split(spark, d)).select(F.md5("text").alias("text_md5"), "split")


def content_sets(spark: SparkSession, d: str) -> DataFrame:
    return curate.content_sets(_split(spark, d)).groupBy("split").agg(F.count("*").alias("n_texts"))


def held_out(spark: SparkSession, d: str) -> DataFrame:
    return curate.held_out(_split(spark, d)).select("row_id", "uid", "split")


def held_out_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = _split(spark, d)
    return curate.overlap(s.where("split = 'train'"), s.where("split <> 'train'"))


def label_map(spark: SparkSession, d: str) -> DataFrame:
    return curate.label_map(appeals(spark, d))


def label_index(spark: SparkSession, d: str) -> DataFrame:
    a = appeals(spark, d)
    return curate.to_index(a, curate.label_map(a)).select("row_id", "idx")


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return curate.distribution(appeals(spark, d))


def split_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).groupBy("split", "kind").agg(F.count("*").alias("n"))


def id_table(spark: SparkSession, d: str) -> DataFrame:
    return curate.id_table(_split(spark, d)).select("row_id", "id")


def annotation_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = ordinal(table(spark, d, "benchmark").select("item_id"), "item_id")
    return curate.batches(rows, 7).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("item_id").alias("first_id"), F.max("item_id").alias("last_id"))


def stratified_holdout(spark: SparkSession, d: str) -> DataFrame:
    return curate.holdout(appeals(spark, d).select("row_id", "kind"), 0.1, "kind", "row_id").select("row_id", "held")


def strided_sample(spark: SparkSession, d: str) -> DataFrame:
    return curate.strided(ordinal(table(spark, d, "customer").select("c_custkey"), "c_custkey"), 40, 37, 3).select("pick", "c_custkey")


def capped_groups(spark: SparkSession, d: str) -> DataFrame:
    return curate.capped(appeals(spark, d).select("row_id", "kind"), "kind", 3, "row_id")


def label_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return curate.run_lengths(e, "event_type", "event_id", "user_id").select("user_id", F.col("run").cast("long").alias("run"), "label", "length", "first")


def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Keys from 0 to the largest that are no order's, where each that ends in 00 of a multiple of four is taken away."""
    keys = table(spark, d, "orders").where("o_orderkey % 400 <> 0").select("o_orderkey")
    last, = keys.agg(F.coalesce(F.max("o_orderkey"), F.lit(-1))).first()
    return curate.gaps(keys, "o_orderkey", 0, last, 1)


def quotas(spark: SparkSession, d: str) -> DataFrame:
    supports = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("support"))
    return sample.quotas(supports, 100, 12)


QUERIES = {
    f.__name__: f
    for f in (
        corpus_funnel, noise_flags, normalized_text, dedup_pairs, dedup_normalized, min_support, chronological_split, split_leakage, first_split, content_sets, held_out, held_out_overlap,
        label_map, label_index, label_distribution, split_distribution, id_table, annotation_batches, stratified_holdout, strided_sample, capped_groups, label_runs, sequence_gaps, quotas,
    )
}

_NOISE = f"regexp_matches({norm('content')}, '^the[\\p{{L}}\\p{{N}}_]*\\s')"
_BROAD = "kind IN ('src1', 'src2')"

ORACLE_SQL = {
    "corpus_funnel": f"""WITH {SPLITS},
      f AS (SELECT *, {_NOISE} AS noise, {_BROAD} AS broad FROM splits),
      u AS (SELECT * FROM f WHERE NOT noise AND NOT broad QUALIFY row_number() OVER (PARTITION BY content, kind ORDER BY row_id) = 1),
      k AS (SELECT * FROM u QUALIFY count(*) OVER (PARTITION BY kind) >= 30)
      SELECT CAST(ordinal AS INTEGER) AS ordinal, stage, CAST(n AS BIGINT) AS rows FROM (
      SELECT 0 AS ordinal, 'raw' AS stage, count(*) AS n FROM f UNION ALL SELECT 1, 'noise', count(*) FROM f WHERE NOT noise
      UNION ALL SELECT 2, 'kinds', count(*) FROM f WHERE NOT noise AND NOT broad UNION ALL SELECT 3, 'dedup', count(*) FROM u
      UNION ALL SELECT 4, 'support', count(*) FROM k UNION ALL SELECT 5, 'train', count(*) FROM k WHERE split = 'train'
      UNION ALL SELECT 6, 'validation', count(*) FROM k WHERE split = 'validation' UNION ALL SELECT 7, 'test', count(*) FROM k WHERE split = 'test')""",
    "noise_flags": f"WITH {APPEALS} SELECT row_id, {_NOISE} AS noise, {_BROAD} AS broad FROM appeals",
    "normalized_text": f"SELECT doc_id, md5({norm('text')}) AS norm_md5, CAST(length({norm('text')}) AS BIGINT) AS norm_chars FROM documents",
    "dedup_pairs": f"WITH {APPEALS} SELECT row_id, kind FROM appeals QUALIFY row_number() OVER (PARTITION BY content, kind ORDER BY row_id) = 1",
    "dedup_normalized": f"WITH {APPEALS} SELECT row_id, kind FROM appeals QUALIFY row_number() OVER (PARTITION BY {norm('content')} ORDER BY row_id) = 1",
    "min_support": f"WITH {APPEALS} SELECT row_id, kind FROM appeals QUALIFY count(*) OVER (PARTITION BY kind) >= 50",
    "chronological_split": f"WITH {SPLITS} SELECT row_id, split FROM splits",
    "split_leakage": f"""WITH {SPLITS} SELECT md5({norm('content')}) AS text_md5, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS n_rows
      FROM splits GROUP BY {norm('content')} HAVING count(DISTINCT split) > 1""",
    "first_split": f"WITH {SPLITS} SELECT md5({norm('content')}) AS text_md5, arg_min(split, row_id) AS split FROM splits GROUP BY {norm('content')}",
    "content_sets": f"WITH {SPLITS} SELECT split, count(DISTINCT {norm('content')}) AS n_texts FROM splits GROUP BY split",
    "held_out": f"WITH {SPLITS} SELECT row_id, uid, split FROM splits WHERE split <> 'train' QUALIFY row_number() OVER (PARTITION BY {norm('content')} ORDER BY row_id) = 1",
    "held_out_overlap": f"""WITH {SPLITS}, tr AS (SELECT {norm('content')} AS t, count(*) AS n FROM splits WHERE split = 'train' GROUP BY 1),
      he AS (SELECT DISTINCT {norm('content')} AS t FROM splits WHERE split <> 'train')
      SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_texts, CAST(sum(n) - count(*) AS BIGINT) AS duplicates,
      CAST(sum(CASE WHEN he.t IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS overlap FROM tr LEFT JOIN he USING (t)""",
    "label_map": f"WITH {APPEALS} SELECT kind, CAST(row_number() OVER (ORDER BY encode(kind)) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT kind FROM appeals)",
    "label_index": f"""WITH {APPEALS}, m AS (SELECT kind, CAST(row_number() OVER (ORDER BY encode(kind)) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT kind FROM appeals))
      SELECT row_id, idx FROM appeals JOIN m USING (kind)""",
    "label_distribution": f"WITH {APPEALS} SELECT kind, count(*) AS n FROM appeals GROUP BY kind",
    "split_distribution": f"WITH {SPLITS} SELECT split, kind, count(*) AS n FROM splits GROUP BY split, kind",
    "id_table": f"""WITH {SPLITS} SELECT row_id, split || ':' || uid || CASE WHEN count(*) OVER (PARTITION BY split, uid) > 1
      THEN '#' || CAST(row_number() OVER (PARTITION BY split, uid ORDER BY row_id) - 1 AS VARCHAR) ELSE '' END AS id FROM splits""",
    "annotation_batches": """SELECT 'batch-' || lpad(CAST(CAST(floor(o / 7) AS INTEGER) + 1 AS VARCHAR), 3, '0') AS batch_id, count(*) AS n, min(item_id) AS first_id, max(item_id) AS last_id
      FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS o FROM benchmark) GROUP BY 1""",
    "stratified_holdout": f"""WITH {APPEALS} SELECT row_id, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id)
      <= floor(count(*) OVER (PARTITION BY kind) * 0.1) AS held FROM appeals""",
    "strided_sample": """WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS o, count(*) OVER () AS n FROM customer)
      SELECT CAST(i AS INTEGER) AS pick, c_custkey FROM range(40) r(i) JOIN c ON c.o = (3 + i * 37) % c.n""",
    "capped_groups": f"WITH {APPEALS} SELECT row_id, kind FROM appeals QUALIFY row_number() OVER (PARTITION BY kind ORDER BY row_id) <= 3",
    "label_runs": """WITH m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m)
      SELECT user_id, run, event_type AS label, count(*) AS length, min(event_id) AS first FROM r GROUP BY user_id, run, event_type""",
    "sequence_gaps": """WITH k AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 400 <> 0)
      SELECT CAST(i AS BIGINT) AS missing FROM (SELECT unnest(range(0, (SELECT max(o_orderkey) + 1 FROM k))) AS i) WHERE i NOT IN (SELECT o_orderkey FROM k)""",
    "quotas": """WITH s AS (SELECT c_mktsegment AS kind, count(*) AS support, row_number() OVER (ORDER BY encode(c_mktsegment)) AS place FROM customer GROUP BY 1),
      h AS (SELECT *, pow(support, 0.6) / sum(pow(support, 0.6)) OVER () * 100 AS share FROM s),
      b AS (SELECT *, least(support, CAST(floor(greatest(12, share)) AS BIGINT)) AS start FROM h), g AS (SELECT *, 100 - CAST(sum(start) OVER () AS BIGINT) AS gap FROM b),
      c AS (SELECT kind, gap, unnest(CASE WHEN gap < 0 THEN range(13, start + 1) WHEN gap > 0 THEN range(start, least(support, start + gap)) ELSE [] END) AS seat, share, place FROM g),
      r AS (SELECT kind, gap, row_number() OVER (ORDER BY CASE WHEN gap < 0 THEN share - seat ELSE seat - share END, CASE WHEN gap < 0 THEN -place ELSE place END) AS nth FROM c),
      m AS (SELECT kind, CAST(count(*) * sign(any_value(gap)) AS BIGINT) AS change FROM r WHERE nth <= abs(gap) GROUP BY kind)
      SELECT g.kind, support, CAST(start + coalesce(change, 0) AS BIGINT) AS quota FROM g LEFT JOIN m USING (kind)""",
}
