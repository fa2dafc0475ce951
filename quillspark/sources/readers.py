"""Sources: manifests, prediction files and decoder outputs as DataFrames (S-01, S-04, S-06 to S-13)."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import ship
from ..functions.text import detokenize, normalize_text, unicode_form
from ..operators.evaluation import require_columns
from ..operators.ranks import fresh, numbered
from ..operators.relations import repeated_ids
from .filetree import whole_texts

#: Fixed value: the fields in which a structured prediction may hold its text, by priority.
TEXT_FIELDS = ("rec_text", "text", "label", "transcription")


def manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S-01, S-04: a CSV with a header; quotes are doubled, fields may hold line breaks, a byte order mark is dropped.
    With a schema, its columns are taken by name from the header; raises where one isn't there, and, when run, on a value
    that isn't of its type. Without one, all are texts."""
    x = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if schema is None:
        return x
    wanted = spark.createDataFrame([], schema).schema
    require_columns(x, wanted.names, path)
    return x.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


def in_order(spark: SparkSession, path: str, schema: str | None = None, place: str = "place") -> DataFrame:
    """O-01, O-02: a CSV that was written in an order, with each row's place in it, from 0: by the number of its
    part file, then by its row there."""
    name = F.col("_metadata.file_name")
    number_of = lambda p: F.coalesce(F.expr(f"try_cast(regexp_extract(_metadata.file_name, '{p}', 1) as bigint)"), F.lit(0))
    x = manifest(spark, path)
    part, piece, file, row = fresh(x, "part_", "piece_", "file_", "row_")
    x = numbered(x.withColumns({part: number_of(r"^part-(\\d+)"), piece: number_of(r"-c(\\d+)"), file: name, row: F.monotonically_increasing_id()}), [part, piece, file, row], place).drop(part, piece, file, row)
    return x if schema is None else x.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema], place)


def parse_spec(spec: str) -> tuple[str, str]:
    """S-08: name and path of name:path; raises where one is empty."""
    name, _, path = spec.partition(":")
    if not name.strip() or not path.strip():
        raise ValueError(f"not name:path: {spec!r}")
    return name.strip(), path.strip()


def predictions(spark: SparkSession, path: str, name: str = "") -> DataFrame:
    """S-06, S-07: (ID, Target[, source]); null texts become empty; raises on repeated IDs."""
    df = require_columns(manifest(spark, path), ["ID", "Target"], path).select("ID", F.coalesce("Target", F.lit("")).alias("Target"))
    if twice := [r["ID"] for r in repeated_ids(df, "ID").orderBy("ID").limit(10).collect()]:
        raise ValueError(f"{path}: repeated IDs {twice}")
    return df.withColumn("source", F.lit(name)) if name else df


def prediction_id(name: Column, prefix: str = "") -> Column:
    """S-11: the stem of a path, without the prefix; only the last suffix goes."""
    name = F.when(F.startswith(name, F.lit(prefix)), F.substring(name, len(prefix) + 1, 1 << 30)).otherwise(name) if prefix else name
    return F.regexp_replace(F.substring_index(F.regexp_replace(name, "/+$", ""), "/", -1), r"(?<=[^.])\.[^.]+$", "")


def decoder_lines(lines: DataFrame, prefix: str = "", detokenized: bool = False) -> DataFrame:
    """S-10: (ID, Target) of the lines (value) of a decoder's output; blank ones and log lines, which begin with [, are left out."""
    line = normalize_text(F.col("value"))
    rest = F.regexp_extract(line, r"^\S+ ?(.*)$", 1)
    return lines.where((line != "") & ~F.startswith(line, F.lit("["))).select(prediction_id(F.regexp_extract(line, r"^(\S+)", 1), prefix).alias("ID"), (normalize_text(rest) if detokenized else detokenize(rest)).alias("Target"))


def decoder_output(spark: SparkSession, path: str, prefix: str = "", detokenized: bool = False) -> DataFrame:
    return decoder_lines(spark.read.text(path), prefix, detokenized)


def transcripts(spark: SparkSession, path: str, form: str = "NFC") -> DataFrame:
    """S-09: one row for each .txt file of a folder: its stem and its normalised text."""
    files = whole_texts(spark, path, "*.txt")
    return files.select(prediction_id(F.col("name")).alias("ID"), unicode_form(normalize_text(F.col("value")), form).alias("Target"))


def payload_text(s: str) -> str:
    """T-23: the text in a plain, JSON or literal payload: of a list or tuple, its first element's; of a mapping, the
    first of its fields, as text whatever it holds. Payloads without one stand for themselves."""
    for parse in (json.loads, ast.literal_eval):
        try:
            value = parse(s)
        except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
            continue
        while isinstance(value, (list, tuple)) and value:
            value = value[0]
        if isinstance(value, str):
            return value
        if isinstance(value, dict) and (field := next((k for k in TEXT_FIELDS if k in value), None)):
            return str(value[field])
    return s


@F.pandas_udf(StringType())
def payload_udf(s: pd.Series) -> pd.Series:
    return s.map(payload_text)


def path_lines(lines: DataFrame) -> DataFrame:
    """S-12: (ID, Target) of lines (value) with a path and a payload, parted by a tab or else by white space.

    Plain payloads stay in the JVM; only those that begin like a structure go to Python."""
    ship(lines.sparkSession)
    v = F.trim("value")
    cut = F.when(F.contains(v, F.lit("\t")), F.regexp_extract(v, r"^([^\t]*)\t", 1)).otherwise(F.regexp_extract(v, r"^(\S+)", 1))
    rest = F.when(F.contains(v, F.lit("\t")), F.regexp_extract(v, r"^[^\t]*\t([\s\S]*)$", 1)).otherwise(F.regexp_extract(v, r"^\S+\s*([\s\S]*)$", 1))
    x = lines.where(v != "").select(prediction_id(cut).alias("ID"), F.trim(rest).alias("rest"))
    return x.select("ID", normalize_text(F.when(F.col("rest").rlike(r"^([A-Za-z]{1,2})?[\[({\"']"), payload_udf("rest")).otherwise(F.col("rest"))).alias("Target"))


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """S-13: (symbol, idx) of lines cut at their last space; blank lines are skipped. Raises, when run, on a line
    without a number and names its own (from 1). Symbol files are small, so each is read whole."""
    whole = spark.read.text(path, wholetext=True)
    x = whole.select(F.posexplode(F.split("value", r"\r?\n", -1)).alias("at", "value")).where(F.trim("value") != "")
    idx = F.regexp_extract("value", r" (\d+)\s*$", 1)
    wrong = F.raise_error(F.concat(F.lit("not a symbol line: "), (F.col("at") + 1).cast("string"), F.lit(": "), "value"))
    return x.select(F.regexp_extract("value", r"^(.*) \d+\s*$", 1).alias("symbol"), F.when(idx == "", wrong).otherwise(idx).cast("int").alias("idx"))
