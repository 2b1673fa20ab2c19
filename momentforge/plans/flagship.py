"""The flagship query: moment search end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of the ten best videos for the first vector, fused and ranked."""
    return QUERIES["search_moments"](spark, sf_dir)
