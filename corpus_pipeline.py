"""The corpus pipeline: quality classifier, near-duplicate join, personal data, source mix, packing.

Each stage takes (spark, documents, folder of the tables) and returns a DataFrame that is written and read again as the
next one's documents. All but the last return the columns of documents. A stage works on all that its predecessor kept,
and keeps its contract for nulls, empty texts, repeated rows and extra columns as its operator's module states it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import jaccard_join, mixing, packing, pii, rule_ensemble
from grainmill.storage import Workspace

#: SQL cannot express the trained classifiers, the tokenizer or the exact join here; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return rule_ensemble.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Workspace(spark, "stage-quality"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard similarity the document with the smallest doc_id stays."""
    return jaccard_join.keep_first(docs, Workspace(spark, "stage-duplicates"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind."""
    return pii.redact(docs, Workspace(spark, "stage-pii"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the source mix takes, in training order; a last copy is cut to the words still due."""
    return mixing.apply_mix(docs, Workspace(spark, "stage-mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their ids, numbered as sequences in the training order of the documents, which
    is the order of their files and of the rows in them; their place (slot, at) is told, too."""
    return packing.pack(docs, Workspace(spark, "stage-pack"), with_ids=True, in_order=True)


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("jaccard_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.table(f"{k}-{name}", stage(spark, docs, sf_dir))
    return docs
