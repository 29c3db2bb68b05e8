"""Reading of the Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds that have a table here, and that table.
KIND_TABLES = {
    "product": "products",
    "brand": "brands",
    "category": "categories",
    "feature": "features",
    "ragdocument": "rag_documents",
}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def kind_of(type_name: Column) -> Column:
    """The part of a type name after its last backslash, trimmed and lower-cased."""
    return F.lower(F.trim(F.element_at(F.split(type_name, r"\\"), -1)))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (without: UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def current_rows(df: DataFrame, key: str, version: str, *columns: str) -> DataFrame:
    """One row for each key: that with the greatest version (equal versions are exact copies).

    Null keys are left out. One shuffle on the key with map-side partial aggregation, so a key with
    many versions costs one row for each input partition.
    """
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(F.struct(F.coalesce(F.col(version), F.lit(-(2**31))).alias("__v"), *columns)).alias("__row"))
        .select(key, *[F.col(f"__row.{c}").alias(c) for c in columns])
    )
