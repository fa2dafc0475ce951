"""Images of text lines: metadata, hashes, quality, resizing (S-02, S-03, S-05, S-18, S-19, T-20 to T-22, P-13, A-20, W-03, W-09).

Images are columns: the bytes of pixels in rows of width x channels (1: grey, 3: RGB). Geometry, flags and
groups are column functions; what needs pixels is one numpy pass over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..functions.text import normalize_text
from ..sources.readers import prediction_id
from .decoding import encode
from .relations import attach

#: Weights of red, green and blue in 65536ths, by which a grey value is made.
LUMA = (19595, 38470, 7471)
#: Limits of dark, ink at a border, and bright pixels; the border's share of the shorter side.
DARK, INK, BRIGHT, BORDER = 80, 220, 245, 0.05
#: The names of the metrics.
METRICS = ["brightness_mean", "brightness_median", "contrast_std", "p01", "p99", "dynamic_range_1_99", "dark_pixel_ratio", "bright_pixel_ratio", "foreground_ratio", "sharpness_grad_var", "top_foreground_ratio", "bottom_foreground_ratio", "left_foreground_ratio", "right_foreground_ratio"]


def read(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """S-02: (ID, image_path, width, height, aspect_ratio, area, mode, channels, pixels, file_md5, readable) of
    each image file; unreadable ones have no size. Executors decode; files stay apart, however many there are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.md5("content").alias("file_md5"))
    shown = spark.read.format("image").option("pathGlobFilter", glob).load(path).select("image.*").where("width > 0")
    plain = lambda c: F.regexp_replace(c, r"^(\w+):/+", "$1:/")  # noqa: E731  the two readers write file:/ and file:///
    x = files.withColumn("at", plain("path")).join(shown.withColumn("at", plain("origin")).drop("origin"), "at", "left")
    mode = F.when(F.col("nChannels") == 1, "L").when(F.col("nChannels") == 3, "RGB").when(F.col("nChannels") == 4, "RGBA")
    w, h = F.col("width"), F.col("height")
    return x.select(prediction_id(F.col("path")).alias("ID"), F.col("path").alias("image_path"), "width", "height", (w / h).alias("aspect_ratio"), (w * h).cast("long").alias("area"), mode.alias("mode"), F.when(F.col("nChannels") == 1, 1).when(w > 0, 3).alias("channels"), rgb("data", "nChannels").alias("pixels"), "file_md5", (F.coalesce(w, F.lit(0)) > 0).alias("readable"))


def line_rows(manifest: DataFrame, images: DataFrame, letters: str | None = None) -> DataFrame:
    """S-05, S-18, S-19: each row of a manifest (ID[, Target]) with its image's path, size and pixels, and the ids
    of its normalised text if letters are given; raises, when run, where an image is missing or a character unknown."""
    x = attach(manifest, images.select("ID", *[c for c in ("image_path", "width", "height", "channels", "pixels") if c in images.columns]), "ID", "image_path")
    return x.withColumn("target_ids", encode(normalize_text(F.col("Target")), letters)) if letters is not None and "Target" in x.columns else x


def image_path(image_id: Column, folder: str, ending: str = ".jpg") -> Column:
    """S-03."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), image_id.cast("string"), F.lit(ending))


def rgb(data: str, channels: str) -> Column:
    @F.pandas_udf("binary")
    def turned(d: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else bytes(x) if c == 1 else np.frombuffer(x, np.uint8).reshape(-1, int(c))[:, 2::-1].tobytes() for x, c in zip(d, n)])

    return turned(data, channels)


def array(pixels: bytes, width: int, height: int, channels: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(int(height), int(width), int(channels))


def grey(a: np.ndarray) -> np.ndarray:
    if a.shape[2] == 1:
        return a[:, :, 0]
    return ((a.astype(np.int64) @ np.array(LUMA) + (1 << 15)) >> 16).astype(np.uint8)


def cubic(x: np.ndarray) -> np.ndarray:
    """The cubic filter with parameter -1/2: near its centre, and up to two away."""
    a = -0.5
    x = np.abs(x)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0.0))


#: Filters by name: how far they reach, and their weights.
FILTERS = {"triangle": (1.0, lambda x: np.maximum(1 - np.abs(x), 0)), "cubic": (2.0, cubic)}


def spread(old: int, new: int, kind: str = "triangle") -> np.ndarray:
    """Weights [new, old] of a filter that widens when it shrinks, in 2^22ths."""
    support, weigh = FILTERS[kind]
    scale = old / new
    wide = max(scale, 1.0)
    reach = support * wide
    centre = (np.arange(new) + 0.5) * scale
    first = np.maximum((centre - reach + 0.5).astype(int), 0)
    last = np.minimum((centre + reach + 0.5).astype(int), old)
    at = np.arange(old)[None, :]
    w = weigh((at + 0.5 - centre[:, None]) / wide) * ((at >= first[:, None]) & (at < last[:, None]))
    w = w / w.sum(axis=1, keepdims=True) * (1 << 22)
    return np.trunc(w + np.where(w < 0, -0.5, 0.5))


def resized(a: np.ndarray, width: int, height: int, kind: str = "triangle") -> np.ndarray:
    """Bilinear (triangle) or bicubic with antialiasing, in whole numbers: first the width, then the height; an axis that
    keeps its size is left alone."""
    for axis, (old, new) in ((1, (a.shape[1], width)), (0, (a.shape[0], height))):
        if old != new:
            a = np.moveaxis(np.tensordot(spread(old, new, kind), a.astype(np.float64), (1, axis)), 0, axis)
            a = np.clip(np.floor((a + (1 << 21)) / (1 << 22)), 0, 255).astype(np.uint8)
    return a


def average_hash(g: np.ndarray, size: int = 8) -> str:
    """T-20: a bit for each pixel of a small copy that is brighter than its mean."""
    small = resized(g, size, size).astype(np.float32)
    return f"{int(''.join('01'[int(b)] for b in (small > small.mean()).ravel()), 2):0{size * size // 4}x}"


def metrics(g: np.ndarray) -> dict:
    """T-21, for an image of two pixels or more on each side."""
    a = g.astype(np.float64)
    gy, gx = np.gradient(a)
    edge = max(2, int(round(min(a.shape) * BORDER)))
    low, high = np.percentile(a, [1, 99])
    share = lambda x: float(x.mean())
    values = (share(a), float(np.median(a)), float(a.std()), float(low), float(high), float(high - low), share(a < DARK), share(a > BRIGHT), share(a < BRIGHT), float((gx**2 + gy**2).var()), share(a[:edge] < INK), share(a[-edge:] < INK), share(a[:, :edge] < INK), share(a[:, -edge:] < INK))
    return dict(zip(METRICS, values))


def quality(images: DataFrame) -> DataFrame:
    """T-20, T-21: adds ahash, the metrics and error; null where pixels are null or can't be told."""
    ship(images.sparkSession)

    @F.pandas_udf("struct<ahash:string,error:string," + ",".join(f"{m}:double" for m in METRICS) + ">")
    def told(pixels: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.DataFrame:
        out = []
        for p, w, h, c in zip(pixels, width, height, channels):
            try:
                g = grey(array(p, w, h, c)) if p is not None else None
                out.append({"ahash": average_hash(g), **metrics(g)} if g is not None else {"error": "unreadable"})
            except Exception as e:  # noqa: BLE001  a report tells what is wrong with an image
                out.append({"error": repr(e)})
        return pd.DataFrame(out, columns=["ahash", "error", *METRICS]).astype({"ahash": object, "error": object})

    return images.withColumn("told", told("pixels", "width", "height", "channels")).select(*images.columns, "told.*")


def quality_flags(x: DataFrame) -> DataFrame:
    """P-13: seven flags of quality's columns and their number; a null metric raises no flag. The limits are fixed values."""
    flag = {
        "flag_almost_blank": F.expr("readable and contrast_std < 4 and foreground_ratio < 0.01"), "flag_too_dark": F.col("brightness_mean") < 80,
        "flag_too_bright_low_foreground": F.expr("brightness_mean > 245 and foreground_ratio < 0.01"), "flag_low_dynamic_range": F.col("dynamic_range_1_99") < 20, "flag_low_sharpness": F.col("sharpness_grad_var") < 5,
        "flag_top_or_bottom_crop": F.greatest("top_foreground_ratio", "bottom_foreground_ratio") > 0.2, "flag_left_or_right_crop": F.greatest("left_foreground_ratio", "right_foreground_ratio") > 0.2,
    }
    x = x.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flag.items()})
    return x.withColumn("quality_flag_count", sum(F.col(k).cast("int") for k in flag))


def readability(x: DataFrame) -> DataFrame:
    """A-20: rows, existing, readable and bad images of each split."""
    return x.groupBy("split").agg(F.count("ID").alias("n"), F.count_if("exists").alias("n_exists"), F.count_if("readable").alias("n_readable"), F.count_if(~F.col("readable")).alias("bad_images"))


def once(x: DataFrame) -> DataFrame:
    """W-03: one row of each (ID, image_path), the least of those alike."""
    return x.dropDuplicates(["ID", "image_path"])


def scaled(images: DataFrame, height: int, most: int | None = None, cutoff: int | None = None) -> DataFrame:
    """T-22: RGB images of one height, as wide as their shape asks but most at most; cutoff: per cent of the
    darkest and brightest pixels that autocontrast leaves out first."""
    if height <= 0 or (most is not None and most <= 0) or (cutoff is not None and cutoff < 0):
        raise ValueError("height and most must be positive, cutoff not negative")
    def change(a):
        a = contrasted(a, cutoff) if cutoff is not None else a
        wide = max(1, round(a.shape[1] * (height / a.shape[0])))
        return resized(a, min(wide, most) if most else wide, height)

    return mapped(images, change)


def padded(images: DataFrame, width: int, value: int = 255, align: str = "left") -> DataFrame:
    """T-22: images of one width, cropped or padded with value at the side away from align."""
    if width <= 0 or align not in ("left", "center", "right"):
        raise ValueError("width must be positive, align left, center or right")
    share = {"left": 0, "center": 1, "right": 2}[align]

    def change(a):
        own = a.shape[1]
        at = abs(own - width) * share // 2
        if own >= width:
            return a[:, at : at + width]
        out = np.full((a.shape[0], width, 3), value, np.uint8)
        out[:, at : at + own] = a
        return out

    return mapped(images, change)


def contrasted(a: np.ndarray, cutoff: float) -> np.ndarray:
    """Each channel stretched to 0..255 between its darkest and brightest values, after cutoff per cent of the pixels at either end."""
    out = a.copy()
    for c in range(a.shape[2]):
        n = np.bincount(a[:, :, c].ravel(), minlength=256)
        for order in (slice(None), slice(None, None, -1)) if cutoff else ():
            own, cut = n[order], int(n.sum() * cutoff // 100)
            own -= np.minimum(own, np.maximum(cut - (np.cumsum(own) - own), 0))
        on = np.nonzero(n)[0]
        if len(on) and on[-1] > on[0]:
            scale = 255.0 / (on[-1] - on[0])
            table = np.clip(np.trunc(np.arange(256) * scale - on[0] * scale), 0, 255).astype(np.uint8)
            out[:, :, c] = table[a[:, :, c]]
    return out


def mapped(images: DataFrame, change) -> DataFrame:
    """width, height, channels and pixels of each image after change, in RGB; null pixels stay null."""
    ship(images.sparkSession)

    @F.pandas_udf("struct<width:int,height:int,channels:int,pixels:binary>")
    def run(pixels: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.DataFrame:
        out = []
        for p, w, h, c in zip(pixels, width, height, channels):
            a = None if p is None else array(p, w, h, c)
            a = None if a is None else change(np.repeat(a, 3, axis=2) if c == 1 else a)
            out.append((None,) * 4 if a is None else (a.shape[1], a.shape[0], 3, np.ascontiguousarray(a).tobytes()))
        frame = pd.DataFrame(out, columns=["width", "height", "channels", "pixels"])
        return frame.astype({c: "Int32" for c in frame.columns[:3]})

    four = ("width", "height", "channels", "pixels")
    x = images.withColumn("changed", run("pixels", "width", "height", "channels"))
    return x.select(*[F.col(f"changed.{c}").alias(c) if c in four else F.col(c) for c in images.columns])


def batch_width(x: DataFrame, batch: Column, multiple: int = 1) -> DataFrame:
    """W-09: adds batch and padded_width, the widest of a batch rounded up to a multiple."""
    x = x.withColumn("batch", batch)
    wide = x.groupBy("batch").agg((F.ceil(F.max("width") / multiple) * multiple).cast("int").alias("padded_width"))
    return x.join(wide, "batch")
