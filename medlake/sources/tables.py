"""Readers for the landed parquet tables.

Every reader returns a lazy DataFrame; Catalyst prunes columns and pushes
filters into the parquet scan, so callers should select only what they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Load one landed table (``{sf_dir}/{name}.parquet``)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register every landed table as a temp view under its own name."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
