"""Work that can be stopped and taken up again, in batches and as a stream (resume by skipping).

A folder holds waves of finished rows and a ledger. A wave is written whole, under a name of its own; only
then the ledger gets a line with that name. Rows count if their wave is in the ledger, so a wave that was
being written when the run died is never read, and is written anew under another name. What is to be done
next are the rows whose key no counted wave has: an anti-join on the key, before any work is done."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

LINE = "wave string, n long"


class Resumable:
    """Finished rows under a path, each key once. schema is that of the rows, key one of its columns."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType | str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = spark.createDataFrame([], schema).schema

    def exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def waves(self) -> list[str]:
        """The waves that count; there are as many as runs were cut into, not as rows."""
        if not self.exists(f"{self.path}/ledger"):
            return []
        return [r["wave"] for r in self.spark.read.schema(LINE).json(f"{self.path}/ledger").select("wave").distinct().orderBy("wave").collect()]

    def finished(self) -> DataFrame:
        """All rows of the waves that count."""
        waves = self.waves()
        empty = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{w}" for w in waves]) if waves else empty

    def pending(self, todo: DataFrame) -> DataFrame:
        """The rows of todo whose key isn't finished; a null key is a key."""
        done = self.finished().select(F.col(self.key).alias("done_key"))
        return todo.join(done, F.col(self.key).eqNullSafe(F.col("done_key")), "left_anti")

    def put(self, rows: DataFrame, wave: str) -> None:
        """Writes a wave and then its line. A wave of that name that counts already is left alone; one that doesn't, and so was
        not finished, is written over."""
        if wave in self.waves():
            return
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/rows/{wave}")
        n = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{wave}").count()
        self.spark.createDataFrame([(wave, n)], LINE).coalesce(1).write.mode("append").json(f"{self.path}/ledger")

    def run(self, todo: DataFrame, work: Callable[[DataFrame], DataFrame], waves: int = 1, most: int | None = None) -> DataFrame:
        """Does what is pending of todo (keys unique) in so many waves of like size, most of them in this call, and gives all
        finished rows. Waves are dealt by the key's hash, so that each is one narrow filter over what is pending."""
        for k in range(waves if most is None else min(waves, most)):
            own = self.pending(todo).where(F.pmod(F.xxhash64(self.key), F.lit(waves)) == k)
            self.put(work(own), f"run-{uuid.uuid4().hex}")
        return self.finished()

    def follow(self, source: DataFrame, work: Callable[[DataFrame], DataFrame], now: bool = True) -> StreamingQuery:
        """Does the rows of a stream as they come: each key once, whatever files hold it again. A micro-batch is the wave of
        its number, so a batch that is run again after a failure is written once. now: ends once all there is has
        been done."""
        def sink(rows: DataFrame, batch: int) -> None:
            wave = f"batch-{batch:012d}"
            if wave not in self.waves():
                self.put(work(self.pending(rows.dropDuplicates([self.key]))), wave)

        writer = source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{self.path}/progress")
        return (writer.trigger(availableNow=True) if now else writer).start()
