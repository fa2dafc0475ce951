"""Manifests stored by fold, with their IDs in buckets (K-01, P-02, P-03, J-01).

A fold is a partition, so asking for one reads its files alone; IDs are in the same buckets in every table
that is stored with as many, so a join by ID moves no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import require_columns


def store(df: DataFrame, name: str, path: str | None = None, buckets: int = 64, key: str = "ID", fold: str | None = "fold") -> DataFrame:
    """K-01: saves a table; without a fold it has buckets alone, as tables have that manifests are joined with. path: where its
    files are, else in the warehouse."""
    require_columns(df, [c for c in (key, fold) if c])
    # rows of a bucket come together first, so that a fold has a file for each bucket and not for each task
    w = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    w = w.partitionBy(fold) if fold else w
    (w.option("path", path) if path else w).saveAsTable(name)
    return df.sparkSession.table(name)


def load(spark: SparkSession, name: str, fold: int | None = None, but: int | None = None) -> DataFrame:
    """P-02, P-03: a stored manifest, one fold of it, or all but one; other folds' files aren't read."""
    x = spark.table(name)
    x = x if fold is None else x.where(F.col("fold") == fold)
    return x if but is None else x.where(F.col("fold") != but)
