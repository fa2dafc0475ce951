"""Joins, sets, checks of ids and samples: J-01, J-08, J-09, J-12, U-01 to U-03, W-01, W-05, P-02, O-04, A-13, A-29."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """W-01, W-02: (key, n) of the keys that more than one row has."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def id_difference(a: DataFrame, b: DataFrame, key: str, overlap: bool = False) -> DataFrame:
    """U-01 to U-03: (key, side) of keys in one table alone: missing from b, or extra in it; none where the sets are
    equal. With overlap, the keys of both come too, as shared."""
    x = a.select(key, F.lit(1).alias("m")).unionByName(b.select(key, F.lit(2).alias("m")))
    x = x.groupBy(key).agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    x = x if overlap else x.where("lo = hi")
    return x.select(key, F.when(F.col("lo") < F.col("hi"), "shared").when(F.col("lo") == 1, "missing").otherwise("extra").alias("side"))


def attach(df: DataFrame, meta: DataFrame, key: str, needed: str | None = None) -> DataFrame:
    """J-01, J-04, J-08: a left join that adds the columns df lacks; raises, when run, where needed stays null."""
    new = [c for c in meta.columns if c not in df.columns]
    x = df.join(meta.select(key, *new), key, "left")
    return x.withColumn(needed, F.coalesce(needed, F.raise_error(F.concat(F.lit(f"no {needed} for "), F.col(key).cast("string"))))) if needed else x


def submission(sample: DataFrame, predictions: DataFrame, key: str, text: str, pos: str) -> DataFrame:
    """J-09: sample's keys with their text; of repeated keys the last in pos wins, others are left out,
    null becomes empty; raises, when run, on a key without a row."""
    last = predictions.groupBy(key).agg(F.max_by(F.coalesce(text, F.lit("")), pos).alias("own"))
    return sample.select(key).join(last, key, "left").select(key, F.coalesce("own", F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string")))).alias(text))


def coarsen(df: DataFrame, label: str, least: int, fallback: Column) -> DataFrame:
    """W-05, J-12: a label that fewer than least rows have becomes the fallback. Counts are joined, not windowed, so that a hot label is not one task."""
    n = df.groupBy(F.col(label).alias("counted_label")).agg(F.count("*").alias("label_rows"))
    return df.join(n, F.col(label).eqNullSafe(F.col("counted_label")), "left").drop("counted_label").withColumn(label, F.when(F.col("label_rows") < least, fallback).otherwise(F.col(label))).drop("label_rows")


def split_fold(df: DataFrame, fold: int, column: str = "fold") -> DataFrame:
    """P-02: split is valid in the fold, train elsewhere; raises where one of them has no row."""
    got = {r[0] for r in df.select((F.col(column) == fold).alias("v")).distinct().collect()}
    if not {True, False} <= got:
        raise ValueError(f"fold {fold}: train or valid is empty")
    return df.withColumn("split", F.when(F.col(column) == fold, "valid").otherwise("train"))


def only_fold(df: DataFrame, fold: int | None = None, column: str = "fold") -> DataFrame:
    """P-03: the rows of one fold, or all if none is asked for."""
    return df if fold is None else require_columns(df, [column]).where(F.col(column) == fold)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns {', '.join(missing)}")
    return df


def overfit_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """O-04: n rows by seeded hash, once in each of two folds."""
    own = df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
    return own.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("split", F.when(F.col("fold") == 0, "valid").otherwise("train"))


def source_scores(long: DataFrame, truth: DataFrame) -> DataFrame:
    """A-13, P-05: edits, reference characters and CER of each source, over rows that have a reference."""
    x = long.join(truth.where("reference is not null"), "ID")
    s = x.groupBy("source_idx").agg(F.count("*").alias("n"), F.sum(F.levenshtein("reference", F.coalesce("text", F.lit(""))).cast("long")).alias("char_edits"), F.sum(F.length("reference").cast("long")).alias("ref_chars"))
    return s.withColumn("cer", F.round(F.col("char_edits") / F.col("ref_chars"), 6))


def best_epoch(batches: DataFrame) -> DataFrame:
    """A-29: the first epoch of least mean loss, weighted by batch size. batches: (epoch, loss, n)."""
    e = batches.groupBy("epoch").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
    return e.agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("epoch"), F.round(F.min("loss"), 6).alias("loss"))
