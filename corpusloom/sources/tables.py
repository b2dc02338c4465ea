"""Readers of the Parquet tables that the queries run over."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`; filters and column choices reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
