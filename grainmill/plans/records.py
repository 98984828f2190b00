"""Queries of reconciliation, validation, augmentation, audits and the rate limiter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, augment, reconcile
from ..streaming import limiter
from .tables import APPEALS, appeals, norm, table


def reconcile_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as expected; supplied: all but some, some changed, some twice, some unknown."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    got = docs.where("id % 50 <> 7").withColumn("text", F.when(F.col("id") % 90 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    got = got.unionByName(docs.where("id % 70 = 5")).unionByName(docs.where("id % 100 = 1").withColumn("id", -F.col("id")))
    return reconcile.reconcile(docs, got)


def manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "documents").where("doc_id % 11 <> 2").select("doc_id", F.md5("text").alias("h"))
    new = table(spark, d, "documents").where("doc_id % 13 <> 5").select("doc_id", F.md5(F.when(F.col("doc_id") % 17 == 1, F.upper("text")).otherwise(F.col("text"))).alias("h"))
    return reconcile.changes(old, new, ["doc_id"], "h")


def failing_sets(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    return reconcile.set_differences(labels.where("quality = 0"), labels.where("toxic = 1"), "doc_id")


def resumed_work(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.resume(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id", "event_type")


def page_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Each page's path with the reason of its longest listed prefix."""
    pages = table(spark, d, "pages").select(F.regexp_replace("url", r"^https?://", "").alias("path")).distinct()
    roots = pages.select(F.split("path", "/")[0].alias("prefix")).distinct().where("length(prefix) % 2 = 0").withColumn("reason", F.concat(F.lit("host "), "prefix"))
    return reconcile.prefix_reason(pages, roots)


def strict_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Parse errors of event properties, as they are and with something behind them."""
    e = table(spark, d, "events").select("event_id", F.concat("props", F.when(F.col("event_id") % 3 == 0, " tail").otherwise("")).alias("raw"))
    return e.select("event_id", reconcile.parse_error(F.col("raw")).alias("error"))


def contract_errors(spark: SparkSession, d: str) -> DataFrame:
    """Violations of topics made of orders: some without an issue, some of an unknown domain, some with a number."""
    o = table(spark, d, "orders")
    topic = F.concat(
        F.lit('{"topics":[{"domain":"'), F.when(F.col("o_orderstatus") == "F", "water").otherwise("nowhere"), F.lit('","issue":"'), F.when(F.col("o_orderkey") % 20 == 0, "").otherwise("leak"),
        F.lit('","object":'), F.when(F.col("o_orderkey") % 30 == 0, "5").otherwise('""'), F.lit(',"requested_action":"","attributes":{}}]}'),
    )
    return reconcile.contract_errors(o.select(F.col("o_orderkey").alias("id"), topic.alias("raw")))


def same_source_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = appeals(spark, d).select("row_id", "kind", F.length("content").alias("chars"), F.pmod(F.floor(F.col("row_id") / 20), F.lit(4)).alias("domain"))
    return augment.pairs_by_key(a, "kind", "row_id", "domain", 3).select("kind", "a_row_id", "b_row_id", F.col("nth").cast("long").alias("nth"))


def single_kind_texts(spark: SparkSession, d: str) -> DataFrame:
    return augment.single_kind(appeals(spark, d)).select("row_id", "kind")


def unseen_texts(spark: SparkSession, d: str) -> DataFrame:
    a = appeals(spark, d)
    return augment.without_texts(a.where("row_id % 2 = 0"), a.where("row_id % 2 = 1")).select("row_id")


def replicated_streams(spark: SparkSession, d: str) -> DataFrame:
    a = appeals(spark, d).select(F.concat("kind", F.lit("-"), F.col("row_id").cast("string")).alias("uid"))
    stream = augment.stream_of(F.col("uid"), (("src10", "ten"), ("src1", "one")))
    return augment.replicate(a.withColumn("stream", stream), F.when(F.col("stream") == "ten", 3).when(F.col("stream") == "one", 2).otherwise(1))


def pair_rejects(spark: SparkSession, d: str) -> DataFrame:
    a = appeals(spark, d)
    return augment.counted_rejects(a, {"long": F.length("content") < 3000, "kind": F.col("kind") != "src3", "short": F.length("content") >= 500})


def limited_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as hits of their users, three a week."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return limiter.limit(e, "user_id", "ts", "event_id", 7 * 86_400_000, 3).select("event_id", "allowed", "retry_after_sec")


def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    told = limiter.counts_by_window(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day")
    return told.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def grid_complete(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", F.lit("x").alias("raw")).distinct()
    return audit.grid_complete(li, ["l_returnflag", "l_linestatus", "l_linenumber"], "raw")


def claim_checks(spark: SparkSession, d: str) -> DataFrame:
    measured = table(spark, d, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    measured = measured.select(F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("metric", "value"))
    claims = spark.createDataFrame([("quality", 0.5), ("toxic", 0.1278), ("length", 1.0)], "metric string, value double")
    return audit.check_claims(claims, measured, ["metric"]).select("metric", "claimed", F.round("measured", 9).alias("measured"), "state")


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), "lang")
    return audit.tree_hash(own, by="lang")


def records_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return audit.records_fingerprint(table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("uid"), F.lit(None).cast("string").alias("kind"), F.col("text").alias("content")))


def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    """Cells of pipe tables: a table of nations a region, between prose and a second table."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.concat(F.lit("| "), "n_name", F.lit(" |"), F.col("n_nationkey").cast("string"), F.lit("|"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda r: r["row"]), "\n")
    text = F.concat(F.lit("# "), F.col("r_name"), F.lit("\n\n| name | key |\n| --- |:-:|\n"), F.col("rows"), F.lit("\n\nand\n| one |\n|---|\n"))
    docs = n.groupBy("r_name").agg(rows.alias("rows")).select(F.col("r_name").alias("doc"), text.alias("text"))
    return audit.markdown_tables(docs).select("doc", F.col("table").cast("long").alias("table"), F.col("row").cast("long").alias("row"), F.array_join("cells", "/").alias("cells"))


QUERIES = {
    f.__name__: f
    for f in (
        markdown_tables, reconcile_documents, manifest_changes, failing_sets, resumed_work, latest_event, page_prefixes, strict_payloads, contract_errors, same_source_pairs, single_kind_texts, unseen_texts,
        replicated_streams, pair_rejects, limited_events, daily_counts, grid_complete, claim_checks, content_hashes, records_fingerprint,
    )
}

ORACLE_SQL = {
    "strict_payloads": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'not strict JSON' ELSE 'missing ''topics'' array' END AS error FROM events",
    "markdown_tables": """WITH n AS (SELECT r_name AS doc, n_name, n_nationkey, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS row FROM nation JOIN region ON n_regionkey = r_regionkey)
      SELECT doc, CAST(1 AS BIGINT) AS "table", CAST(row AS BIGINT) AS row, n_name || '/' || n_nationkey AS cells FROM n
      UNION ALL SELECT DISTINCT doc, 1, 0, 'name/key' FROM n UNION ALL SELECT DISTINCT doc, 2, 0, 'one' FROM n""",
    "limited_events": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
      s AS (SELECT event_id, user_id, ms, k, [ms] AS kept, true AS allowed, 0::BIGINT AS wait FROM e WHERE k = 1
        UNION ALL SELECT e.event_id, e.user_id, e.ms, e.k,
          CASE WHEN len(list_filter(s.kept, lambda x: x > e.ms - 604800000)) >= 3 THEN list_filter(s.kept, lambda x: x > e.ms - 604800000) ELSE list_append(list_filter(s.kept, lambda x: x > e.ms - 604800000), e.ms) END,
          len(list_filter(s.kept, lambda x: x > e.ms - 604800000)) < 3,
          CASE WHEN len(list_filter(s.kept, lambda x: x > e.ms - 604800000)) < 3 THEN 0 ELSE greatest(1, CAST(ceil((list_filter(s.kept, lambda x: x > e.ms - 604800000)[1] + 604800000 - e.ms) / 1000.0) AS BIGINT)) END
        FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
      SELECT event_id, allowed, CAST(wait AS INTEGER) AS retry_after_sec FROM s""",
    "reconcile_documents": """WITH docs AS (SELECT doc_id AS id, text FROM documents),
      got AS (SELECT id, CASE WHEN id % 90 = 3 THEN text || '!' ELSE text END AS text FROM docs WHERE id % 50 <> 7 UNION ALL SELECT id, text FROM docs WHERE id % 70 = 5 UNION ALL SELECT -id, text FROM docs WHERE id % 100 = 1),
      g AS (SELECT id, count(*) AS n FROM got GROUP BY id)
      SELECT 'missing_id' AS category, id, CAST(0 AS BIGINT) AS n FROM docs WHERE id NOT IN (SELECT id FROM g)
      UNION ALL SELECT 'unknown_id', id, n FROM g WHERE id NOT IN (SELECT id FROM docs) UNION ALL SELECT 'duplicate_id', id, n FROM g WHERE n > 1
      UNION ALL SELECT 'changed_text', g.id, any_value(g.n) FROM g JOIN got USING (id) JOIN docs USING (id) WHERE got.text <> docs.text GROUP BY g.id""",
    "manifest_changes": """SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'removed' WHEN o.doc_id IS NULL THEN 'added' WHEN o.text = n.text THEN 'unchanged' ELSE 'changed' END AS state
      FROM (SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 2) o FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 17 = 1 THEN upper(text) ELSE text END AS text FROM documents WHERE doc_id % 13 <> 5) n ON o.doc_id = n.doc_id""",
    "failing_sets": "SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'both' WHEN quality = 0 THEN 'left' ELSE 'right' END AS side FROM labels WHERE quality = 0 OR toxic = 1",
    "resumed_work": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "latest_event": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "page_prefixes": """SELECT path, CASE WHEN length(split_part(path, '/', 1)) % 2 = 0 THEN 'host ' || split_part(path, '/', 1) END AS reason
      FROM (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages)""",
    "contract_errors": """WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders)
      SELECT id, CAST(0 AS INTEGER) AS topic, 'unknown domain' AS error FROM o WHERE s <> 'F' UNION ALL SELECT id, 0, 'blank issue' FROM o WHERE id % 20 = 0
      UNION ALL SELECT id, 0, 'object is not a string' FROM o WHERE id % 30 = 0""",
    "same_source_pairs": f"""WITH {APPEALS}, f AS (SELECT kind, row_id, CAST(floor(row_id / 20) AS BIGINT) % 4 AS dom FROM appeals QUALIFY row_number() OVER (PARTITION BY kind, dom ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) <= 3)
      SELECT a.kind, a.row_id AS a_row_id, b.row_id AS b_row_id, row_number() OVER (PARTITION BY a.kind ORDER BY md5('42:' || CAST(a.row_id AS VARCHAR) || ':' || CAST(b.row_id AS VARCHAR)), a.row_id, b.row_id) AS nth
      FROM f a JOIN f b ON a.kind = b.kind AND a.row_id < b.row_id AND a.dom <> b.dom QUALIFY nth <= 3""",
    "single_kind_texts": f"WITH {APPEALS} SELECT row_id, kind FROM appeals QUALIFY min(kind) OVER (PARTITION BY {norm('content')}) = max(kind) OVER (PARTITION BY {norm('content')})",
    "unseen_texts": f"WITH {APPEALS} SELECT row_id FROM appeals WHERE row_id % 2 = 0 AND {norm('content')} NOT IN (SELECT {norm('content')} FROM appeals WHERE row_id % 2 = 1)",
    "replicated_streams": f"""WITH {APPEALS}, s AS (SELECT kind || '-' || CAST(row_id AS VARCHAR) AS uid FROM appeals),
      t AS (SELECT uid, CASE WHEN starts_with(uid, 'src10') THEN 'ten' WHEN starts_with(uid, 'src1') THEN 'one' ELSE 'single' END AS stream FROM s)
      SELECT CASE WHEN i = 0 THEN uid ELSE uid || '#' || CAST(i AS VARCHAR) END AS uid, stream FROM t JOIN range(3) r(i) ON i < CASE stream WHEN 'ten' THEN 3 WHEN 'one' THEN 2 ELSE 1 END""",
    "pair_rejects": f"""WITH {APPEALS} SELECT CASE WHEN length(content) >= 3000 THEN 'long' WHEN kind = 'src3' THEN 'kind' WHEN length(content) < 500 THEN 'short' ELSE 'kept' END AS reason, count(*) AS n FROM appeals GROUP BY 1""",
    "daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "grid_complete": """WITH g AS (SELECT DISTINCT l_returnflag AS a, l_linestatus AS b, l_linenumber AS c FROM lineitem)
      SELECT count(*) AS rows, count(*) AS cells, CAST(0 AS BIGINT) AS blank, count(DISTINCT a) * count(DISTINCT b) * count(DISTINCT c) - count(*) AS missing, count(DISTINCT a) * count(DISTINCT b) * count(DISTINCT c) = count(*) AS complete FROM g""",
    "claim_checks": """WITH m AS (SELECT 'quality' AS metric, avg(quality) AS v FROM labels UNION ALL SELECT 'toxic', avg(toxic) FROM labels),
      c AS (SELECT * FROM (VALUES ('quality', 0.5::DOUBLE), ('toxic', 0.1278::DOUBLE), ('length', 1.0::DOUBLE)) t(metric, claimed))
      SELECT metric, claimed, round(v, 9) AS measured, CASE WHEN v IS NULL THEN 'unmeasured' WHEN round(claimed, 4) = round(v, 4) THEN 'agrees' ELSE 'differs' END AS state FROM c LEFT JOIN m USING (metric)""",
    "content_hashes": "SELECT lang, sha256(string_agg(e, '' ORDER BY encode(e))) AS tree_sha256 FROM (SELECT lang, CAST(doc_id AS VARCHAR) || ':' || sha256(text) AS e FROM documents) GROUP BY lang",
    "records_fingerprint": "SELECT sha256(string_agg(CAST(item_id AS VARCHAR) || chr(0) || 'None' || chr(0) || text || chr(0), '' ORDER BY encode(CAST(item_id AS VARCHAR)))) AS fingerprint, count(*) AS n FROM benchmark",
}
