"""Vocabularies, geometry, folds, integrity: A-14 to A-18, A-21, A-22, W-02, W-04, T-05, T-06, T-11 to T-14, O-05, D-01."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import ship
from ..functions.text import chars, ctc_collapse, normalize_text, repeats, resized_width, words
from ..shared import spread
from .ranks import median, number, quantiles


def char_frequency(df: DataFrame, text: str, row: str) -> DataFrame:
    """A-14: counts of each character and of the rows that hold it. Texts are dealt by row before they are counted, so that a
    task holds the counts of some 50,000 rows at a time; a row of very many texts is one task, with an alphabet of counts."""
    by_row = spread(df.select(row, text), row, rows=50_000).select(row, F.explode(chars(F.col(text))).alias("ch")).groupBy(row, "ch").agg(F.count("*").alias("n"))
    return by_row.groupBy("ch").agg(F.sum("n").alias("n"), F.count("*").alias("n_rows"))


def named_chars(frequency: DataFrame) -> DataFrame:
    """A-14: adds Unicode names and categories; as many rows as the alphabet has."""
    ship(frequency.sparkSession)

    @F.pandas_udf("struct<unicode_name:string,category:string>")
    def told(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"unicode_name": [unicodedata.name(x, "UNKNOWN") for x in c], "category": [unicodedata.category(x) for x in c]})

    return frequency.withColumn("told", told("ch")).select(*frequency.columns, "told.*")


def alphabet(df: DataFrame, text: str, extra: str = "") -> DataFrame:
    """A-16: (ch, idx) of the distinct characters and the extra ones in their order, from 1. An alphabet is small."""
    found = df.select(F.explode(chars(F.col(text))).alias("ch")).distinct()
    if extra:
        found = found.unionByName(df.sparkSession.createDataFrame([(c,) for c in extra], "ch string")).distinct()
    every = found.agg(F.array_sort(F.collect_set("ch")).alias("a"))
    return every.select(F.posexplode("a").alias("idx", "ch")).select("ch", (F.col("idx") + 1).alias("idx"))


def rare_lines(df: DataFrame, text: str, key: str, most: int = 10, rare: str | None = None) -> DataFrame:
    """A-15: (key, text, rare_chars, rare_char_count, char_len) of the lines that hold a character with most
    occurrences at most (or one of rare): their rare characters sorted, and how many of them there are."""
    norm = df.select(key, normalize_text(F.col(text)).alias("text"))
    if rare is not None:  # given ones may be in every line, so lines are dealt by key as in char_frequency
        norm = spread(norm, key, rows=50_000)
    found = norm.select(key, F.explode(chars(F.col("text"))).alias("ch"))
    if rare is None:  # rare ones are part of an alphabet; only they are counted by line
        wanted = found.groupBy("ch").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("ch")
        found = found.join(F.broadcast(wanted), "ch", "left_semi")
    else:
        found = found.where(F.col("ch").isin(list(rare)))
    found = found.groupBy(key, "ch").agg(F.count("*").alias("n"))
    lines = found.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("ch")), "").alias("rare_chars"), F.sum("n").alias("rare_char_count"))
    return norm.join(lines, key).select(key, "text", "rare_chars", "rare_char_count", F.length("text").cast("long").alias("char_len"))


def round_trip(df: DataFrame, text: str, key: str, letters: str) -> DataFrame:
    """T-06: (key, target, encoded_length, decoded, roundtrip_ok, error): each line encoded and decoded without
    collapsing; a line with unknown characters has them, sorted, as its error and nothing else."""
    known = F.array(*[F.lit(c) for c in letters])
    x = df.select(key, normalize_text(F.col(text)).alias("target")).withColumn("bad", F.array_sort(F.array_except(chars(F.col("target")), known)))
    ids = F.when(F.size("bad") == 0, F.transform(chars(F.col("target")), lambda c: F.array_position(known, c).cast("int"))).otherwise(F.array().cast("array<int>"))
    x = x.withColumn("ids", ids).withColumn("decoded", F.array_join(F.transform("ids", lambda i: F.element_at(known, i)), ""))
    return x.select(key, "target", F.size("ids").alias("encoded_length"), "decoded", ((F.col("decoded") == F.col("target")) & (F.size("bad") == 0)).alias("roundtrip_ok"), F.when(F.size("bad") > 0, F.concat(F.lit("unknown characters: "), F.array_join("bad", " "))).otherwise("").alias("error"))


def ngram_counts(df: DataFrame, text: str, order: int) -> DataFrame:
    """A-17: (context, token, n), with start padding; the end is an empty token."""
    padded = F.concat(F.array_repeat(F.lit("<s>"), order - 1), chars(F.col(text)), F.array(F.lit("</s>")))
    rows = df.select(padded.alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - order + 1), lambda k: F.struct(F.array_join(F.slice("p", k, order - 1), "").alias("context"), F.element_at("p", k + order - 1).alias("token")))).alias("g"))
    return rows.groupBy("g.context", "g.token").agg(F.count("*").alias("n"))


def unclipped_width(w: Column, h: Column, height: int) -> Column:
    return F.greatest(F.lit(1.0), F.rint(w.cast("double") * (F.lit(float(height)) / h.cast("double")))).cast("long")


def ctc_alignment(df: DataFrame, height: int = 96, most: int = 2048, factor: int = 4) -> DataFrame:
    """T-13: time steps that a line image gives against those that its text needs. df: (ID, Target, width, height)."""
    w, h, t = F.col("width"), F.col("height"), normalize_text(F.col("Target"))
    x = df.select("ID", w.alias("original_width"), h.alias("original_height"), resized_width(w.cast("double"), h.cast("double"), height, most).alias("resized_width"), unclipped_width(w, h, height).alias("unclipped_resized_width"), t.alias("text"))
    x = x.withColumns({"was_width_clipped": F.col("resized_width") < F.col("unclipped_resized_width"), "target_length": F.length("text").cast("long"), "adjacent_repeat_count": repeats(F.col("text")).cast("long"), "encoder_time_steps": F.greatest(F.lit(1), F.floor(F.col("resized_width") / factor)).cast("long")})
    x = x.withColumn("required_ctc_steps", F.col("target_length") + F.col("adjacent_repeat_count"))
    return x.withColumns({"ctc_margin": F.col("encoder_time_steps") - F.col("required_ctc_steps"), "is_ctc_length_valid": F.col("encoder_time_steps") >= F.col("required_ctc_steps"), "pixels_per_char": F.col("resized_width") / F.greatest(F.col("target_length"), F.lit(1))})


def ctc_summary(table: DataFrame) -> DataFrame:
    """A-18. Medians are exact, found by passes of their own."""
    margin, pixels = (v[0] for v in quantiles(table, {"ctc_margin": [0.5], "pixels_per_char": [0.5]}).values())
    return table.agg(F.count("*").alias("n"), F.count_if(~F.col("is_ctc_length_valid")).alias("invalid_rows"), F.count_if("was_width_clipped").alias("width_clipped_rows"), F.min("ctc_margin").alias("min_ctc_margin"), number(margin).alias("median_ctc_margin"), F.min("pixels_per_char").alias("min_pixels_per_char"), number(pixels).alias("median_pixels_per_char"))


def target_audit(df: DataFrame, tokens: Column, label: int, generation: int, height: int = 384, canvas: int = 384) -> DataFrame:
    """T-14: token counts against two limits, and whether the line is clipped on a canvas of one size. tokens: the count that a tokenizer gives."""
    w, h = F.col("width"), F.col("height")
    x = df.select("ID", tokens.cast("long").alias("token_count"), normalize_text(F.col("Target")).alias("text"), w.alias("original_width"), h.alias("original_height"), resized_width(w.cast("double"), h.cast("double"), height, canvas).alias("aspect_resized_width"), unclipped_width(w, h, height).alias("unclipped_aspect_resized_width"))
    return x.withColumns({"char_len": F.length("text").cast("long"), "word_len": F.size(words(F.col("text"))).cast("long"), "exceeds_max_label_length": F.col("token_count") > label, "exceeds_max_generation_length": F.col("token_count") > generation, "would_clip_aspect_canvas": F.col("aspect_resized_width") < F.col("unclipped_aspect_resized_width"), "pixels_per_char": F.col("aspect_resized_width") / F.greatest(F.length("text"), F.lit(1))})


def target_summary(table: DataFrame) -> DataFrame:
    """A-19. Quantiles are exact, found by passes of their own."""
    tokens, pixels = (v[0] for v in quantiles(table, {"token_count": [0.95], "pixels_per_char": [0.5]}).values())
    return table.agg(F.count("*").alias("n"), F.max("token_count").alias("max_token_count"), number(tokens).alias("p95_token_count"), F.count_if("exceeds_max_label_length").alias("over_label_rows"), F.count_if("exceeds_max_generation_length").alias("over_generation_rows"), F.count_if("would_clip_aspect_canvas").alias("clipped_rows"), F.min("pixels_per_char").alias("min_pixels_per_char"), number(pixels).alias("median_pixels_per_char"))


def quantile_bins(df: DataFrame, value: str, q: int, prefix: str) -> DataFrame:
    """W-04: by value, right-closed, equal edges merged; null is its own label."""
    edges = [e for e in dict.fromkeys(quantiles(df, {value: [k / q for k in range(q + 1)]})[value]) if e is not None]
    bin_ = F.greatest(F.lit(0), sum((F.when(F.col(value) > e, 1).otherwise(0) for e in edges), F.lit(0)) - 1)
    return df.withColumn(f"{value}_bin", F.when(F.col(value).isNull(), f"{prefix}<NA>").otherwise(F.concat(F.lit(prefix), bin_)))


def duplicate_groups(df: DataFrame, text: str, key: str) -> DataFrame:
    """A-21: groups of rows of equal content."""
    return df.groupBy(F.md5(text).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id")).where("n > 1")


def first_of(rows: DataFrame, by: str, at: str, most: int | None, name: str, value: str) -> DataFrame:
    """(by, name): the values of each group in the order of at, most of them at most. A group is cut in salted slices first, so
    that a hot one is many tasks and never an array of all its rows."""
    if most:
        slices = Window.partitionBy(by, F.pmod(F.xxhash64(at), F.lit(64))).orderBy(at, value)
        rows = rows.withColumn("place_", F.row_number().over(slices)).where(F.col("place_") <= most)
    found = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))))
    values = F.transform(found, lambda r: r["v"])
    return rows.groupBy(F.col(by).alias(f"{name}_of")).agg((F.slice(values, 1, most) if most else values).alias(name))


def duplicate_images(df: DataFrame, by: str, label: str, most: int | None = None) -> DataFrame:
    """A-21: groups of (ID, label, by, file_md5) with one value of by: rows, distinct files and labels, the ids and
    the labels in the order of ids, most of them at most."""
    own = df.where(F.col(by).isNotNull()).select(by, "ID", F.col(label).alias("label_"), "file_md5")
    groups = own.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct("file_md5").alias("unique_files"), F.count_distinct("label_").alias("unique_labels")).where("n > 1")
    several = own.join(groups.select(by), by, "left_semi")
    labels = several.groupBy(by, "label_").agg(F.min("ID").alias("first_id")).where("label_ is not null")
    out = groups
    for part in (first_of(several, by, "ID", most, "ids", "ID"), first_of(labels, by, "first_id", most, "labels", "label_")):
        key, = (c for c in part.columns if c.endswith("_of"))
        out = out.join(part, F.col(by) == F.col(key), "left").drop(key)
    return out.select(by, "n", "unique_files", "unique_labels", "ids", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def duplicate_members(df: DataFrame, key: str) -> DataFrame:
    """W-02: all rows whose key another row has too."""
    many = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("many"))
    return df.join(many, F.col(key).eqNullSafe(F.col("many")), "left_semi")


def robust_z(df: DataFrame, value: str) -> DataFrame:
    """A-22: 0.6745 (x - median) / MAD, zero where MAD is."""
    med = median(df, value)
    mad = median(df.select(F.abs(F.col(value) - number(med)).alias("off")), "off")
    return df.withColumn("z", F.lit(0.0) if not mad else 0.6745 * (F.col(value) - med) / mad)


def greedy_decode(df: DataFrame, logits: str, letters: str, length: str | None = None) -> DataFrame:
    """D-01, T-05: argmax of each of the first length steps (all, if none is given), collapsed, as text; id 0 is
    the blank. Raises, when run, on an id that letters don't have."""
    known = F.array(*[F.lit(c) for c in letters])
    ids = F.transform(F.slice(logits, F.lit(1), F.col(length)) if length else F.col(logits), lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))
    x = df.withColumn("ids", ids)
    letter = lambda i: F.when(i <= len(letters), F.get(known, i - 1)).otherwise(F.raise_error(F.concat(F.lit("no letter has the id "), i.cast("string"))).cast("string"))
    return x.withColumn("text", F.array_join(F.transform(ctc_collapse(F.col("ids")), letter), "")).drop("ids")


def rare_first_sample(df: DataFrame, rare, key: str, n: int, seed: int = 42) -> DataFrame:
    """O-05, O-04: n rows, those that hold a rare character first, then by seeded hash."""
    return df.orderBy(rare.desc(), F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
