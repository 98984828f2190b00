"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The bounds of validation and test for the dates of orders.
VALIDATION_FROM, TEST_FROM = "1998-01-01T00:00", "2000-01-01T00:00"


def appeals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, uid, kind, content, received: documents with the date of the order of the same number."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("received"))
    docs = table(spark, sf_dir, "documents")
    return docs.join(orders, F.col("doc_id") == F.col("o_orderkey")).select(
        F.col("doc_id").alias("row_id"), F.pmod(F.col("doc_id"), F.lit(97)).cast("string").alias("uid"), F.coalesce("source", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("content"), "received"
    )


APPEALS = r"""appeals AS (SELECT d.doc_id AS row_id, CAST(d.doc_id % 97 AS VARCHAR) AS uid, coalesce(d.source, '') AS kind,
  coalesce(d.text, '') AS content, strftime(o.o_orderdate, '%Y-%m-%dT%H:%M') AS received
  FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id)"""

SPLIT = f"CASE WHEN received < '{VALIDATION_FROM}' THEN 'train' WHEN received < '{TEST_FROM}' THEN 'validation' ELSE 'test' END"
SPLITS = f"{APPEALS},\nsplits AS (SELECT *, {SPLIT} AS split FROM appeals)"

#: White space for DuckDB's expressions, and the normalised form of a text.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{WS}+', ' ', 'g'))"


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction pairs: toxic as the truth, quality as the prediction, the share of the text's length as confidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    conf = (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("confidence")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("ordinal"), F.col("text").alias("content"), F.col("toxic").alias("true_kind"), F.col("quality").alias("predicted_kind"), conf)


JUDGEMENTS = """judgements AS (SELECT l.doc_id AS ordinal, d.text AS content, l.toxic AS true_kind, l.quality AS predicted_kind,
  l.doc_id * 7919 % 1000 / 1000.0 AS confidence FROM labels l JOIN documents d USING (doc_id))"""


def ordinal(df: DataFrame, key: str) -> DataFrame:
    """A dense ordinal from 0 by a key, for small tables."""
    return df.withColumn("ordinal", F.row_number().over(Window.orderBy(key)) - 1)
