"""Tables of one input folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the folder ``sf_dir``, a path or URI that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
