"""Data sets in the layouts that two line recognisers train on: images, truth, lists, tables (K-11, K-12).

A manifest is (ID, Target, fold, image_path) with the images' columns (width, height, channels, pixels) as
`images.line_rows` gives them; a test manifest lacks Target and fold. Images are brought to one height by a
cubic filter and written as PNG. Names are split/ID; with fanout, split/folder/ID, so that no folder holds more
than its share. Lists and tables are in the order of ID, one file each, or numbered files of LINES lines."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from ..functions.text import chars, normalize_text, symbol_list, tokenize, unicode_form
from ..operators.images import array, grey, resized
from ..operators.ranks import numbered
from ..operators.relations import repeated_ids, split_fold
from ..shared import spread, written
from .filetree import names, write_files

LINES = 10_000_000


def png(a: np.ndarray) -> bytes:
    """An image [height, width, 1 or 3] as PNG: rows without a filter in one compressed chunk."""
    high, wide, deep = a.shape
    rows = np.zeros((high, 1 + wide * deep), np.uint8)
    rows[:, 1:] = a.reshape(high, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", wide, high, 8, 0 if deep == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def line_png(height: int, mode: str = "L") -> Column:
    """Images of one height as PNG, grey (L) or RGB; raises, when run, on an image without pixels."""
    if height <= 0 or mode not in ("L", "RGB"):
        raise ValueError("height must be positive, mode L or RGB")

    @F.pandas_udf("binary")
    def encoded(pixels: pd.Series, width: pd.Series, high: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for p, w, h, c in zip(pixels, width, high, channels):
            if p is None:
                raise ValueError("an image without pixels")
            a = array(p, w, h, c)
            a = grey(a)[:, :, None] if mode == "L" else np.repeat(a, 3, axis=2) if c == 1 else a
            out.append(png(resized(a, max(1, round(a.shape[1] * height / a.shape[0])), height, "cubic")))
        return pd.Series(out)

    return encoded("pixels", "width", "height", "channels")


def splits(train: DataFrame, test: DataFrame, fold: int) -> DataFrame:
    """All rows with their split: train, val (the fold) and test; raises where train or val is empty or an ID is repeated."""
    own = split_fold(train, fold).withColumn("split", F.when(F.col("split") == "valid", "val").otherwise("train"))
    out = own.unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)
    if twice := repeated_ids(out.select(F.struct("split", "ID").alias("k")), "k").limit(5).collect():
        raise ValueError(f"repeated IDs {[tuple(r['k']) for r in twice]}")
    return out


def stem(fanout: int) -> Column:
    """split/ID, or split/folder/ID with so many folders."""
    folder = F.lpad(F.conv(F.pmod(F.crc32(F.col("ID").cast("string")), F.lit(fanout)).cast("string"), 10, 16), 4, "0") if fanout else None
    return F.concat_ws("/", "split", *([F.lower(folder)] if fanout else []), F.col("ID").cast("string"))


def line_files(rows: DataFrame, tables: dict[str, Column], path: str) -> None:
    """Writes {name}.txt for each table: a line for each row (ID, split, ...) in the order of ID, null lines left out. A name
    may hold {split}."""
    ranked = numbered(rows, ["split", "ID"])
    first = ranked.groupBy("split").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    x = ranked.join(F.broadcast(first), "split").withColumn("at", F.col("pos") - F.col("first"))  # a row for each split
    number = F.when(F.col("n") > LINES, F.concat(F.lit("-"), F.lpad(F.floor(F.col("at") / LINES).cast("string"), 5, "0"))).otherwise("")
    name = lambda n: F.concat(F.replace(F.lit(n), F.lit("{split}"), F.col("split")), number, F.lit(".txt"))
    cells = F.array(*[F.struct(name(n).alias("path"), F.concat(line, F.lit("\n")).alias("content")) for n, line in tables.items()])
    write_files(x.select("at", F.explode(cells).alias("c")).select("at", "c.*"), path, together=True)


def images(rows: DataFrame, path: str, name: Column, height: int, mode: str, force: bool, truth: Column | None = None) -> None:
    """A PNG for each row, and its truth beside it if there is one. Images that exist are left as they are, unless forced."""
    ship(rows.sparkSession)
    for key, most in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", str(4 << 20))):  # images at a time in a worker
        rows.sparkSession.conf.set(f"spark.sql.execution.arrow.{key}", most)
    x = rows.withColumn("name", name)
    if not force:
        known = names(rows.sparkSession, path, "*.png").select(F.substring_index("path", "/", -3).alias("known"))
        x = x.withColumn("tail", F.substring_index(F.concat(F.lit(f"{path.rstrip('/')}/"), "name", F.lit(".png")), "/", -3))
        todo = x.join(known, F.col("tail") == F.col("known"), "left_anti")
    else:
        todo = x
    write_files(todo.select(F.concat("name", F.lit(".png")).alias("path"), line_png(height, mode).alias("content")), path)
    if truth is not None:
        write_files(x.select(F.concat("name", F.lit(".gt.txt")).alias("path"), truth.cast("binary").alias("content")), path)


def described(rows: DataFrame, path: str, **more) -> None:
    """metadata.json, with sorted keys."""
    n = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    text = json.dumps(more | {f"{s}_rows": n.get(s, 0) for s in ("train", "val", "test")}, ensure_ascii=False, indent=2, sort_keys=True)
    one_file(rows, text, "metadata.json", path)


def one_file(rows: DataFrame, text: str, name: str, path: str) -> None:
    write_files(rows.sparkSession.createDataFrame([(name, text.encode())], "path string, content binary"), path)


def kraken_dataset(train: DataFrame, test: DataFrame, path: str, fold: int, height: int = 128, mode: str = "L", form: str = "preserve", force: bool = False, fanout: int = 0) -> None:
    """K-12: {split}/ID.png and ID.gt.txt for train and val, images for test, {split}_files.txt with the images' paths,
    metadata.json. The truth is normalised text in a Unicode form, with a line feed."""
    rows = written(spread(splits(train, test, fold).select("ID", "Target", "split", "width", "height", "channels", "pixels")))
    truth = F.when(F.col("split") != "test", F.concat(unicode_form(normalize_text(F.col("Target")), form), F.lit("\n")))
    images(rows, path, stem(fanout), height, mode, force, truth)
    line_files(rows.select("ID", "split"), {"{split}_files": F.concat(F.lit(f"{path.rstrip('/')}/"), stem(fanout), F.lit(".png"))}, path)
    described(rows, path, fold=fold, image_height=height, image_mode=mode, image_format="png", unicode_normalization=form)


def pylaia_dataset(train: DataFrame, test: DataFrame, path: str, fold: int, height: int = 128, mode: str = "L", force: bool = False, fanout: int = 0) -> None:
    """K-11: images/{split}/ID.png; for each split the table of names with symbols ({split}.txt), with text
    ({split}_text.txt) and of names alone ({split}_ids.txt), where those of test have names alone; syms.txt with the
    symbols of all training texts; metadata.json."""
    rows = written(spread(splits(train, test, fold)).select("ID", "split", normalize_text(F.col("Target")).alias("text"), "width", "height", "channels", "pixels"))
    images(rows, f"{path}/images", stem(fanout), height, mode, force)
    name, labelled = stem(fanout), F.col("split") != "test"
    with_ = lambda c: F.when(labelled, F.concat(name, F.lit(" "), c)).otherwise(name)
    line_files(rows.select("ID", "split", "text"), {"{split}": with_(tokenize(F.col("text"))), "{split}_text": with_(F.col("text")), "{split}_ids": name}, path)
    letters = rows.where(labelled).select(F.explode(chars(F.col("text"))).alias("c")).agg(F.collect_set("c").alias("a"))  # an alphabet is small
    symbols = letters.select(symbol_list(F.col("a")).alias("s")).first()["s"]
    one_file(rows, "".join(f"{s} {k}\n" for k, s in enumerate(symbols)), "syms.txt", path)
    described(rows, path, fold=fold, image_height=height, image_mode=mode, image_format="png", space_token="<space>")
