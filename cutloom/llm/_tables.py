"""Shared-folder tables that cut lineage (from the core), and null-safe reading of named columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.tables import discard_tables, materialize, shared_folder

__all__ = ["discard_tables", "documents", "embeddings", "labels", "materialize", "picked", "shared_folder"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names given: picked(df, id='doc_id') has one column, id. Other columns can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
