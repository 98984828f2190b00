"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import Workspace
from . import fill_middle, fingerprints, jaccard_join, licenses, mixing, packing, pii, quality_rules, rule_ensemble, secrets, substring_dedup, timestamps, token_file


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir), Workspace(spark, "op1")).taken


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir), Workspace(spark, "op2"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    Workspace(spark, "op3")
    return secrets.digest(secrets.find_secrets(_documents(spark, sf_dir)))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), Workspace(spark, "op4"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_documents(spark, sf_dir), Workspace(spark, "op5")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_documents(spark, sf_dir), Workspace(spark, "op6"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), Workspace(spark, "op7"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir), Workspace(spark, "op8"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(_documents(spark, sf_dir), Workspace(spark, "op9"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(_documents(spark, sf_dir), Workspace(spark, "op10"))


def op11_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise(spark.read.parquet(f"{sf_dir}/stamps.parquet"), Workspace(spark, "op11"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.fill_in_middle(_documents(spark, sf_dir), Workspace(spark, "op12")))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    Workspace(spark, "op13")
    return licenses.digest(licenses.find_licenses(_documents(spark, sf_dir)))


_ALL = (
    op1_mixing, op2_quality_rules, op3_secrets, op4_quality_classifier, op5_pii, op6_jaccard_join, op7_packing,
    op8_substring_dedup, op9_fingerprints, op10_token_file, op11_timestamps, op12_fill_middle, op13_licenses,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {
    "op1_mixing": mixing.SQL, "op2_quality_rules": quality_rules.SQL, "op3_secrets": secrets.SQL,
    "op6_jaccard_join": jaccard_join.SQL, "op8_substring_dedup": substring_dedup.SQL,
    "op11_timestamps": timestamps.SQL, "op12_fill_middle": fill_middle.SQL,
}
