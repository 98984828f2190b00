"""Sources and sinks: CSV and JSON lines with an ordinal, validated embedding tables, reports, batches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.audit import records_fingerprint
from ..storage import unused

#: The columns of a raw appeal.
APPEAL_COLUMNS = (
    "uid", "receivedDateTime", "type", "kind", "content", "accrualMethod", "CATUTTC", "addressPostCode", "addressAdminUnitL1", "addressAdminUnitL2", "addressAdminUnitL3",
    "addressAdminUnitL4", "addressPostName", "addressThoroughfare", "addressLocatorDesignator", "addressLocatorBuilding", "status", "organizationName", "organizationId", "result",
)


def strings(columns) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def ordinal(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A growing, not dense, ordinal in the order in which Spark reads the files' parts."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str, columns=None, row_id: str = "row_id") -> DataFrame:
    """All columns as strings, empty cells as the empty string; quoted newlines, doubled quotes and a byte-order mark are
    understood. Files with quoted newlines cannot be split, so give large inputs as many files."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False)
    df = (reader.schema(strings(columns)) if columns else reader).csv(path)
    return ordinal(df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns]), row_id)


def read_jsonl(spark: SparkSession, path: str, schema, on_error: str = "FAILFAST", row_id: str = "row_id") -> DataFrame:
    """JSON lines by a schema; blank lines are skipped. ``on_error``: FAILFAST, or DROPMALFORMED for a tolerant scan."""
    return ordinal(spark.read.schema(schema).option("mode", on_error).json(path), row_id)


def read_splits(spark: SparkSession, folder: str, schema, splits=("train", "validation", "test")) -> DataFrame:
    """The splits' files with a split column and an ordinal within the split."""
    out = None
    for i, s in enumerate(splits):
        one = read_jsonl(spark, f"{folder}/{s}.jsonl", schema, row_id="ordinal").withColumn("split", F.lit(s)).withColumn("split_index", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def read_document(spark: SparkSession, path: str, schema) -> DataFrame:
    """Whole files as one JSON value each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_jsonl(df: DataFrame, path: str, order: list | None = None) -> None:
    """JSON lines in UTF-8. With an order, sorted over all files in the order of their names."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_batches(df: DataFrame, path: str, batch: str = "batch_id") -> DataFrame:
    """A folder a batch, and a manifest (batch, records, ids)."""
    df.write.mode("overwrite").partitionBy(batch).json(path)
    return df.groupBy(batch).agg(F.count("*").alias("records"), F.sort_array(F.collect_list("id")).alias("ids"))


def report_json(row: dict) -> str:
    """A small report with sorted keys, UTF-8 as it is."""
    return json.dumps(row, ensure_ascii=False, indent=2, sort_keys=True)


def markdown_table(header: list[str], rows: list[list]) -> str:
    """A pipe table of small aggregates; bars in cells are escaped."""
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)])


def save_vectors(df: DataFrame, records: DataFrame, path: str, model: str, split: str, vector: str = "vector", key: str = "id") -> dict:
    """Vectors by key as Parquet, with a metadata row: model, split, n, dim and the records' fingerprint.

    Vectors of different sizes fail the run.
    """
    n, lo, hi = df.agg(F.count("*"), F.min(F.size(vector)), F.max(F.size(vector))).first()
    if lo != hi:
        raise ValueError(f"vectors of {lo} to {hi} dimensions")
    df.select(key, F.col(vector).cast("array<float>").alias(vector)).write.mode("overwrite").parquet(f"{path}/{split}/vectors")
    meta = {"model": model, "split": split, "n": n, "dim": hi or 0, "fingerprint": records_fingerprint(records).first()["fingerprint"]}
    df.sparkSession.createDataFrame([meta], "model string, split string, n long, dim int, fingerprint string").write.mode("overwrite").parquet(f"{path}/{split}/meta")
    return meta


def load_vectors(spark: SparkSession, records: DataFrame, path: str, model: str, split: str) -> DataFrame | None:
    """The saved vectors if they are of this model, split and these records; else None, and the caller makes them anew."""
    from pyspark.errors import AnalysisException

    try:
        meta = spark.read.parquet(f"{path}/{split}/meta").first()
        vectors = spark.read.parquet(f"{path}/{split}/vectors")
    except AnalysisException:
        return None
    now = records_fingerprint(records).first()
    same = meta and (meta["model"], meta["split"], meta["n"], meta["fingerprint"]) == (model, split, now["n"], now["fingerprint"])
    return vectors if same and vectors.count() == meta["n"] else None


def cached_vectors(records: DataFrame, path: str, model: str, split: str, factory, batch: int = 32) -> DataFrame:
    """The saved vectors of these records (id, uid, kind, content), else new ones by ``factory``, which are saved first."""
    from ..operators.vectors import embed

    spark = records.sparkSession
    known = load_vectors(spark, records, path, model, split)
    if known is None:
        save_vectors(embed(records, "id", "content", factory, batch), records, path, model, split)
        known = load_vectors(spark, records, path, model, split)
    return known


def join_vectors(records: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Records with their vectors by key; one without the other fails the run."""
    both = records.withColumn("__gm_l", F.lit(1)).join(vectors.withColumn("__gm_r", F.lit(1)), key, "full_outer")
    bad = F.col("__gm_l").isNull() | F.col("__gm_r").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("record or vector missing: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return both.withColumn("__gm_ok", checked.cast("boolean")).where("__gm_ok").drop("__gm_l", "__gm_r", "__gm_ok")


def dense(df: DataFrame, by: str, ws, name: str = "ordinal") -> DataFrame:
    """A dense ordinal from 0 by a column: rows are range-sorted and written to the workspace with their range, ranges are
    counted, and each numbers its rows from what the ranges before it hold."""
    (part,) = unused([*df.columns, name], "part")
    ranged = ws.table(f"dense-{name}", df.repartitionByRange(by).withColumn(part, F.spark_partition_id()))
    ahead = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = ranged.groupBy(part).agg(F.count("*").alias("n")).select(F.col(part).alias("of"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy(part).orderBy(by)) - 1
    told = ranged.withColumn(name, nth).join(starts, F.col(part) == F.col("of"))
    return told.withColumn(name, (F.col("ahead") + F.col(name)).cast("long")).select(*df.columns, name)
