"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark import shipping


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    shipping.ensure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
