"""Readers and writers of the linkage files: tab-separated text without quoting, Parquet parts, id lists, manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY_SCHEMA = "entity_id string, business_name string, business_address string, country string"


def read_tsv(spark: SparkSession, path: str, schema: str = ENTITY_SCHEMA) -> DataFrame:
    """All columns strings; quotes are text; an empty field is an empty string, not null."""
    return spark.read.schema(schema).options(sep="\t", header=True, quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path).na.fill("")


def read_quoted_tsv(spark: SparkSession, path: str, schema: str = ENTITY_SCHEMA) -> DataFrame:
    """As ``read_tsv``, but a quote opens a quoted field, in which two quotes are one: other rows from the same file."""
    return spark.read.schema(schema).options(sep="\t", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path).na.fill("")


def read_first_rows(spark: SparkSession, path: str, n: int, schema: str = ENTITY_SCHEMA) -> DataFrame:
    """The first ``n`` rows by the first column: files of a folder have no order of their own."""
    rows = read_tsv(spark, path, schema)
    return rows.orderBy(rows.columns[0]).limit(n)


def read_first_column(spark: SparkSession, path: str) -> DataFrame:
    """Distinct values of the first column, without the header and blank lines, whatever stands behind it."""
    rows = spark.read.options(sep="\x01", header=True, quote="", escape="", enforceSchema=True).schema("value string").csv(path)
    return rows.select(F.trim(F.substring_index("value", "\t", 1)).alias("entity_id")).filter("entity_id <> ''").distinct()


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """One row a link, from the comma lists; entities without a match give none."""
    rows = read_tsv(spark, path, "source1_entity_id string, matched_entity_ids string")
    return rows.filter("matched_entity_ids <> ''").select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("cand_id"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("entity_id")).filter("entity_id <> ''").distinct()


def write_parts(df: DataFrame, path: str, by: str = "country", mode: str = "overwrite") -> None:
    """One folder a value; the output committer makes the whole write appear at once or not at all."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """Tab-separated text, one folder a shard."""
    df.write.mode("overwrite").partitionBy(shard).options(sep="\t", header=True, quote="", emptyValue="").csv(path)


def copy_parts(spark: SparkSession, paths: list[str], to: str) -> None:
    """The rows of several Parquet folders in one, with the place in the list as ``shard``."""
    rows = None
    for k, path in enumerate(paths):
        one = spark.read.parquet(path).withColumn("shard", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    rows.write.mode("overwrite").partitionBy("shard").parquet(to)


def write_result(lists: DataFrame, path: str) -> None:
    """Two tab-separated columns with a header, in order, empty lists as empty fields."""
    lists.orderBy(lists.columns[0]).write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="").csv(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(path, wholetext=True).head()
    return json.loads(row["value"]) if row else {}


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares: its checkpoints', else the warehouse that it names; the machine's own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = spark.sparkContext.master.startswith("local")
        if not local and not spark.sparkContext.getConf().contains("spark.sql.warehouse.dir"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{'/tmp' if local else spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{found}/{name}-{uuid.uuid4().hex}"
