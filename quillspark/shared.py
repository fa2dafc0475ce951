"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. In local mode, as in tests, a folder is made where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def spread(df: DataFrame, *by, rows: int | None = None) -> DataFrame:
    """df dealt over as many tasks as exchanges have, and over one for each so many rows if given: a small file that is much
    work is one task or few otherwise. By columns, or else evenly. Spark doesn't join partitions of a given number."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n if rows is None else max(n, -(-df.count() // rows)), *by)


def written(df: DataFrame) -> DataFrame:
    """df as it was computed once: what later jobs read can't differ from it, whatever is planned anew or lost."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
