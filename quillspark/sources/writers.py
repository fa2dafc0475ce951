"""Sinks: CSV, JSON and text outputs, written by executors (K-01 to K-14, K-17, T-24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chars, normalize_text, tokenize


def csv(df: DataFrame, path: str, order: list | None = None, rows: int = 1_000_000) -> None:
    """K-01, K-03 to K-08, K-17: with a header and doubled quotes; order is a range sort, so part files follow it.
    White space at a value's ends stays; an empty text is written quoted, yet is read as null. A file has so many rows at
    most, since one task reads all of a file whose values hold line breaks."""
    out = (df.orderBy(*order) if order else df).write.mode("overwrite").option("maxRecordsPerFile", rows)
    out.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def evaluation_bundle(summary: DataFrame, rows: DataFrame, confusions: DataFrame, path: str) -> None:
    """K-02: the summary as JSON with sorted keys, row errors from the worst, confusions from the most frequent."""
    summary.select(*sorted(summary.columns)).write.mode("overwrite").json(f"{path}/summary")
    csv(rows, f"{path}/row_errors", [F.desc("row_cer"), "ID"])
    csv(confusions, f"{path}/confusions", [F.desc("n"), "op", "ref_char", "pred_char"])


def grouped_bundle(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """K-03: row errors with their groups from the worst, and the summary of groups."""
    csv(rows, f"{path}/grouped_row_errors", [F.desc("row_cer"), "ID"])
    csv(summary, f"{path}/grouped_error_summary", ["group_name", "group_value"])


def charset_bundle(frequency: DataFrame, lines: DataFrame, path: str, round_trip: DataFrame | None = None) -> None:
    """K-04: characters from the rarest, lines with rare ones from the most, round trips if there are any."""
    csv(frequency, f"{path}/character_frequency", ["n", "ch"])
    csv(lines, f"{path}/rare_character_lines", [F.desc("rare_char_count"), F.desc("char_len")])
    if round_trip is not None:
        csv(round_trip, f"{path}/tokenizer_roundtrip")


def audit_bundle(table: DataFrame, summary: DataFrame, path: str, order: list) -> None:
    """K-05, K-06: an audit in an order, and its summary as JSON with sorted keys."""
    csv(table, f"{path}/audit", order)
    summary.select(*sorted(summary.columns)).write.mode("overwrite").json(f"{path}/summary")


def jpg(path: Column) -> Column:
    """T-24: the ending jpeg becomes jpg."""
    return F.regexp_replace(path, r"(?i)\.jpeg$", ".jpg")


def shown_path(path: Column, root: str | None = None) -> Column:
    """T-24: the path as it is, or relative to root where it is below it."""
    head = (root or "").rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(head)), F.substring(path, len(head) + 1, 1 << 30)).otherwise(path) if root else path


def export_height(width: Column, height: Column, to: int) -> Column:
    """T-12: the width that an image gets at another height."""
    return F.greatest(F.lit(1), F.rint(width.cast("double") * to / height)).cast("long")


def lines(df: DataFrame, value: Column, path: str) -> None:
    df.select("split", value.alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def metadata(df: DataFrame, path: str, **more) -> None:
    """Rows of each split, and what else is known of a dataset, as JSON."""
    n = df.groupBy().pivot("split", ["train", "valid", "test"]).count().na.fill(0)
    n.select(*[F.col(c).alias(f"n_{c}") for c in n.columns], *[F.lit(v).alias(k) for k, v in sorted(more.items())]).coalesce(1).write.mode("overwrite").json(path)


def paddle_dataset(df: DataFrame, path: str, root: str | None = None) -> None:
    """K-13, K-14: a path, a tab and a normalised text a line, with paths relative to root if given; the characters, one a
    line; metadata."""
    own = df.withColumns({"shown": shown_path(F.col("image_path"), root), "Target": normalize_text(F.col("Target"))})
    lines(own, F.concat_ws("\t", "shown", "Target"), f"{path}/labels")
    char_file(own.where("split <> 'test'"), f"{path}/characters")
    metadata(df, f"{path}/metadata", root=root or "")


def char_file(df: DataFrame, path: str) -> None:
    """K-14: each character of Target but the space, sorted, one a line; an alphabet is small."""
    found = df.select(F.explode(chars(F.coalesce("Target", F.lit("")))).alias("value")).where("value <> ' '").distinct()
    found.orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def fold_tables(df: DataFrame, path: str, form: str = "tokens") -> None:
    """K-11 to K-13: lines of text under split=train|valid|test; form: tokens (id and symbols), text (id and
    text) or tabbed (path, tab, text). df: (ID, Target, split[, image_path])."""
    t = F.coalesce("Target", F.lit(""))
    line = {"tokens": lambda: F.concat_ws(" ", "ID", tokenize(t)), "text": lambda: F.concat_ws(" ", "ID", t), "tabbed": lambda: F.concat_ws("\t", "image_path", t)}[form]()
    df.select("split", line.alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def symbol_file(symbols: DataFrame, path: str) -> None:
    """K-10: a line for each symbol (symbol, idx) in the order of idx; an alphabet is small."""
    symbols.orderBy("idx").coalesce(1).select(F.concat_ws(" ", "symbol", F.col("idx").cast("string")).alias("value")).write.mode("overwrite").text(path)
