"""Shared parts: the cluster's shared folder, written tables, Arrow helpers, connected components."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
WRITTEN: list[str] = []  # folders that queries have written


def shared_dir(spark: SparkSession) -> str:
    """A fresh path under spark.checkpoint.dir; in local mode, as in tests, a folder is set where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    WRITTEN.append(f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def release(spark: SparkSession) -> int:
    """Deletes what this driver's queries have written to the shared folder; for when their results are no longer
    needed. Gives the number of folders."""
    n, jvm = len(WRITTEN), spark.sparkContext._jvm
    while WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def table(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes Parquet to the shared folder and reads it again."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df lacks, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_rows(df: DataFrame) -> DataFrame:
    """Arrow batches of bounded rows and bytes, so very long texts don't add up in a worker; the bounds are the
    same for all operators, since Spark reads them when a query runs. Workers on this machine find the package."""
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


def id_and_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id long, body binary): null text becomes empty."""
    return arrow_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")))


def packed(b: bytes) -> bytes:
    """Its size, then the compressed bytes: what goes through an exchange is mostly text."""
    return len(b).to_bytes(8, "little") + pa.Codec("zstd", compression_level=5).compress(b, asbytes=True)


def unpacked(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def planes(a: np.ndarray) -> bytes:
    """The bytes of the numbers by place, all lowest first, so that they compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def unplaned(b: bytes, at: int, n: int, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, n * wide, at).reshape(wide, n).T).view(kind).ravel()


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of n nodes over the edges (i, j)."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        low = np.minimum(new[i], new[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, lab, new.copy())
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (src long, dst long): root is the smallest node reachable.

    Alternates large-star and small-star rounds, each written to the shared folder. Hot nodes are
    handled by partial aggregation and by skew splitting of the plain join."""
    def large(e: DataFrame) -> DataFrame:
        both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        return both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src > dst").distinct()

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("src").agg(F.min("dst").alias("low"))
        return e.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select("src", F.col("low").alias("dst"))).where("src > dst").distinct()

    e = table(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src > dst").distinct())
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        e = table(small(large(e)))
    roots = e.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return roots.unionByName(e.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
