"""Queries of pairs that share a street or an object, over the driver's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..operators import pairing
from ..storage import Workspace
from .tables import WS, norm, table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as complaints: the source is the street, the language the object, the text clause and issue, its last line
    the action."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("uid"), F.col("source").alias("kind"), F.col("source").alias("street"), F.col("lang").alias("object"),
        F.pmod(F.floor(F.col("doc_id") / 20), F.lit(4)).cast("long").alias("domain"), collapse(text).alias("issue"), collapse(text).alias("clause"),
        F.element_at(F.split(text, "\n"), -1).alias("action"), F.array(F.concat(F.lit("at "), "source"), F.concat(F.lit("no. "), (F.col("doc_id") % 50).cast("string"))).alias("streets"), text.alias("body"),
    )


def _told(pairs: DataFrame, *more: Column) -> DataFrame:
    return pairs.select("street", *more, F.col("a.uid").alias("a_uid"), F.col("b.uid").alias("b_uid"), "reason", F.md5("text").alias("text_md5"))


def _frozen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("text").alias("content"))


def same_object_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one source and language, with the reason against each that is not kept."""
    return _told(pairing.same_object(_rows(spark, d), _frozen(spark, d), Workspace(spark, "same-object")), F.col("a.object").alias("object"))


def compact_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _told(pairing.compact(_rows(spark, d), _frozen(spark, d), Workspace(spark, "compact"), per_key=3))


def same_street_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _told(pairing.same_street(_rows(spark, d), _frozen(spark, d), Workspace(spark, "same-street"), per_key=2))


def same_object_rejects(spark: SparkSession, d: str) -> DataFrame:
    return pairing.rejects(pairing.same_object(_rows(spark, d), _frozen(spark, d), Workspace(spark, "rejects")))


QUERIES = {f.__name__: f for f in (same_object_pairs, compact_pairs, same_street_pairs, same_object_rejects)}


def _sql(rows: str, within: str, tests: str, per_key: int, text: str) -> str:
    """Tables up to ``told``: street, object, a, b, reason, text."""
    both = f"street, piece{', ' + within if within else ''}"
    size = f"greatest(m / {pairing.PARTS}.0, {float(pairing.LEAST)})"
    two = "least(uid, b.uid), greatest(uid, b.uid)"
    order = "ORDER BY md5('42:' || uid || ':' || b.uid), uid"
    return f"""WITH base AS (SELECT CAST(doc_id AS VARCHAR) AS uid, source, lang AS object, doc_id // 20 % 4 AS domain,
    trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g')) AS issue, string_split(coalesce(text, ''), chr(10))[-1] AS action, coalesce(text, '') AS body, doc_id % 50 AS no FROM documents),
  r AS ({rows}),
  c AS (SELECT street AS k, count(*) AS n FROM r GROUP BY street), z AS (SELECT k, CAST(ceil(n / {size}) AS BIGINT) AS p FROM c, (SELECT sum(n) AS m FROM c) WHERE n > {size}),
  q AS (SELECT r.*, coalesce(('0x' || left(md5(uid), 8))::BIGINT % p, 0) AS piece, md5('42:' || uid) AS o FROM r LEFT JOIN z ON street = k),
  l AS (SELECT *, row_number() OVER (PARTITION BY {both}, domain ORDER BY o, uid) AS nth FROM q),
  w AS (SELECT *, row_number() OVER v AS place, lead(l) OVER v AS b FROM l WINDOW v AS (PARTITION BY {both} ORDER BY nth, domain, o, uid)),
  t0 AS (SELECT *, CASE WHEN b IS NULL THEN 'no_partner' WHEN domain = b.domain THEN 'same_domain' {tests} END AS r0 FROM w WHERE place % 2 = 1),
  t1 AS (SELECT *, CASE WHEN r0 IS NULL AND row_number() OVER (PARTITION BY r0 IS NULL, {two} ORDER BY street) > 1 THEN 'duplicate_pair' ELSE r0 END AS r1 FROM t0),
  t2 AS (SELECT *, CASE WHEN r1 IS NULL AND row_number() OVER (PARTITION BY street, piece, r1 IS NULL {order}) > {per_key} THEN 'over_cap' ELSE r1 END AS r2 FROM t1),
  t3 AS (SELECT *, coalesce(r2, CASE WHEN row_number() OVER (PARTITION BY street, r2 IS NULL {order}) > {per_key} THEN 'over_cap' ELSE 'kept' END) AS r3 FROM t2),
  t4 AS (SELECT *, CASE WHEN r3 = 'kept' THEN {text} END AS made FROM t3), fr AS (SELECT DISTINCT {norm("text")} AS f FROM benchmark),
  told AS (SELECT t4.*, CASE WHEN f IS NOT NULL THEN 'leakage' ELSE r3 END AS reason, CASE WHEN f IS NULL THEN md5(made) END AS text_md5 FROM t4 LEFT JOIN fr ON {norm("made")} = f AND made IS NOT NULL)
"""


_APART = f"""WHEN NOT (length(issue) >= 30 AND length(b.issue) >= 30 AND {norm("issue")} <> {norm("b.issue")}
    AND NOT ({norm("action")} <> '' AND {norm("action")} = {norm("b.action")})) THEN 'not_independent'"""
_EACH = "SELECT *, unnest([{}]) AS street FROM base WHERE issue <> ''".format("'at ' || source, 'no. ' || no")
_SAME = _sql("SELECT *, source AS street FROM base WHERE source IS NOT NULL AND object <> ''", "object", _APART, 3, "'По ' || street || ': ' || issue || ', а також ' || lower(left(b.issue, 1)) || substr(b.issue, 2) || '.'")
_SHORT = "'По ' || street || ': ' || issue || ', а також ' || b.issue || '.'"
_OUT = "SELECT street, {}uid AS a_uid, b.uid AS b_uid, reason, text_md5 FROM told"

ORACLE_SQL = {
    "same_object_pairs": _SAME + _OUT.format("object, "),
    "same_object_rejects": f"{_SAME} SELECT reason, count(*) AS n FROM told GROUP BY reason",
    "compact_pairs": _sql(_EACH, "", f"WHEN length({_SHORT}) > 3000 THEN 'too_long'", 3, _SHORT) + _OUT.format(""),
    "same_street_pairs": _sql(_EACH, "", "", 2, "body || ' а також ' || b.body") + _OUT.format(""),
}
