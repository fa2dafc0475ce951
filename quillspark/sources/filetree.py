"""A sink that writes files of given names: one row or several make a file (K-10 to K-14).

Rows are (path, content): consecutive rows of one path in a partition make one file, so whoever gives a file
several rows brings them together and in order. A task writes each file under a folder of its own attempt
and moves it to its place once it is whole: a reader never sees a part of a file, and an attempt that is run
again puts the same bytes at the same place. What lost attempts leave is in one folder, which goes when the
job ends, well or not. Files of finished tasks stay if a job fails, so that it can go on from there."""

from __future__ import annotations

import fnmatch
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .. import ship
from ..shared import spread

ATTEMPTS = "_attempts"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is a local one."""
    return pafs.FileSystem.from_uri(path if ":/" in path else "file://" + os.path.abspath(path))


@dataclass
class Files(WriterCommitMessage):
    n: int


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.job = root, uuid.uuid4().hex
        fs, at = place(root)
        if overwrite and fs.get_file_info(at).type == pafs.FileType.Directory:
            fs.delete_dir_contents(at)

    def write(self, batches):
        fs, root = place(self.root)
        own, made, n = f"{root}/{ATTEMPTS}/{self.job}-{TaskContext.get().taskAttemptId()}", set(), 0
        name = out = None

        def finish():
            out.close()
            target = f"{root}/{name}"
            folder = target.rsplit("/", 1)[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            fs.move(f"{own}/file", target)

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                if path != name:
                    if out is not None:
                        finish()
                    parts = path.split("/")
                    if not path or "" in parts or ".." in parts or "." in parts or parts[0] == ATTEMPTS:
                        raise ValueError(f"not a path within the folder: {path!r}")
                    if not n:
                        fs.create_dir(own, recursive=True)
                    name, out, n = path, fs.open_output_stream(f"{own}/file"), n + 1
                out.write(content.as_buffer())
        if out is not None:
            finish()
        return Files(n)

    def commit(self, messages):
        self.clear()

    def abort(self, messages):
        self.clear()

    def clear(self):
        """This job's attempts go; those of another job that writes to the same folder stay."""
        fs, root = place(self.root)
        selector = pafs.FileSelector(f"{root}/{ATTEMPTS}", allow_not_found=True)
        found = fs.get_file_info(selector)
        for f in found:
            if f.base_name.startswith(self.job):
                fs.delete_dir(f.path)
        if found and not fs.get_file_info(selector):
            fs.delete_dir(f"{root}/{ATTEMPTS}")


class FileTree(DataSource):
    @classmethod
    def name(cls):
        return "filetree"

    def writer(self, schema, overwrite):
        return TreeWriter(self.options["path"], overwrite)


def write_files(df: DataFrame, path: str, together: bool = False, mode: str = "append") -> None:
    """Writes df (path, content binary) under a folder; together: rows of one path are brought together, in the order of a
    column at. Null content writes nothing."""
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(FileTree)
    x = df.where("content is not null")
    x = x.repartition("path").sortWithinPartitions("path", "at") if together else x
    x.select("path", F.col("content").cast("binary").alias("content")).write.format("filetree").mode(mode).save(path)


def names(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path) of the files under a folder, without reading them; none if there is no such folder."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path")


def listed(path: str, glob: str):
    """Paths of a folder's files, and of those in folders named key=value, as Spark lists them: without names that begin with _ or
    a dot. Local folders are gone through entry by entry."""
    if path.startswith("/"):
        with os.scandir(path) as entries:
            yield from under(((e.path, e.name, e.is_dir()) for e in entries), glob)
    else:
        fs, at = place(path)
        yield from under(((f"{path.split('://')[0]}://{f.path}", f.base_name, f.type == pafs.FileType.Directory) for f in fs.get_file_info(pafs.FileSelector(at))), glob)


def under(found, glob: str):
    for p, name, folder in found:
        if folder and "=" in name and name[0] not in "_.":
            yield from listed(p, glob)
        elif not folder and name[0] not in "_." and fnmatch.fnmatchcase(name, glob):
            yield p


def whole_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, value): whole text files of the folders that a path (a pattern of Hadoop's) matches, which aren't descended into.

    The driver knows the folders alone: a task lists each, and the files are dealt out evenly, since Spark's own source makes a
    task of every 32 small files and the driver holds them all. Stores that pyarrow doesn't know are left to that source."""
    ship(spark)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    roots = list(jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm_path) or [])
    folders = [r.getPath().toString() for r in roots]
    folders = [f[5:] if f.startswith("file:/") else f for f in folders]  # local ones are plain paths
    known = bool(roots)
    try:
        if known and not folders[0].startswith("/"):
            place(folders[0])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        known = False
    if not known or any(r.isFile() for r in roots):  # a path that isn't there raises
        return spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(F.col("_metadata.file_name").alias("name"), "value")
    own = spark.createDataFrame([(f,) for f in folders], "path string")

    def names(batches):
        waiting = []
        for b in batches:
            for root in b.column(0).to_pylist():
                for p in listed(root, glob):
                    waiting.append(p)
                    if len(waiting) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(waiting)], ["path"])
                        waiting = []
        yield pa.RecordBatch.from_arrays([pa.array(waiting, pa.string())], ["path"])

    def texts(batches):
        for b in batches:
            name, value, size = [], [], 0
            for p in b.column(0).to_pylist():
                if p.startswith("/"):
                    with open(p, "rb") as f:
                        value.append(f.read())
                else:
                    fs, at = place(p)
                    with fs.open_input_stream(at) as f:
                        value.append(f.read())
                name.append(p.rsplit("/", 1)[-1])
                size += len(value[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(value)], ["name", "value"])
                    name, value, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(value, pa.binary())], ["name", "value"])

    return spread(own.mapInArrow(names, "path string")).mapInArrow(texts, "name string, value binary").withColumn("value", F.col("value").cast("string"))
