"""Tables of a workspace on disk: Parquet by table, JSON for what people read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, root: str, name: str, overwrite: bool = False, partition: str | None = None) -> None:
    """A table of the workspace; an error if it is there and ``overwrite`` isn't set."""
    out = df.write.mode("overwrite" if overwrite else "errorifexists")
    (out.partitionBy(partition) if partition else out).parquet(f"{root.rstrip('/')}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; null fields are left out."""
    df.write.mode("append" if append else "overwrite").json(path)


def manifest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, manifest): a JSON text per document of its stages (rows: key, stage, status, output, warnings)."""
    stages = F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.struct("status", "warnings")))))
    outputs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "output"))))
    good, n = F.count_if(F.col("status") == "done"), F.count(F.lit(1))
    state = F.when(good == n, F.lit("success")).when(good > 0, F.lit("partial_success")).otherwise(F.lit("failed"))
    return df.groupBy(key).agg(F.to_json(F.struct(F.lit("1.0").alias("schema_version"), state.alias("status"), stages.alias("stages"), outputs.alias("outputs"))).alias("manifest"))


def blocks_json(blocks: DataFrame, assets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, json): blocks in order with the asset ids of their references; null fields are left out.

    ``blocks`` has key, block_index, block_type, text, ref; ``assets`` key, ref, asset_id.
    """
    rows = blocks.join(assets, [key, "ref"], "left")
    block = F.struct("block_index", F.col("block_type").alias("type"), "text", "ref", "asset_id")
    return rows.groupBy(key).agg(F.to_json(F.struct(F.lit("blocks_v1").alias("format"), F.array_sort(F.collect_list(block)).alias("blocks"))).alias("json"))
