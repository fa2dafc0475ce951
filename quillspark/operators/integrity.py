"""Integrity of labelled images, and grids of runs: P-10, P-14, J-10, J-13, U-05, D-06, D-10, S-21."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chars
from .audit import robust_z
from .ranks import number, quantiles
from .profile import residuals


def consistency_flags(x: DataFrame) -> DataFrame:
    """P-14: four flags of (ID, width, height, aspect_ratio, char_len) and their number: pixels a character
    and the residual of the length over the shape are outliers, short labels on wide images, long on narrow."""
    x = x.withColumn("pixels_per_char", F.col("width") / F.when(F.col("char_len") != 0, F.col("char_len")))
    x = residuals(x, "char_len", ["width", "height", "aspect_ratio"])
    for c in ("pixels_per_char", "residual"):
        x = robust_z(x, c).withColumnRenamed("z", f"rz_{c}")
    q = quantiles(x, {"char_len": [0.05, 0.95], "width": [0.05, 0.95]})
    (short, long), (narrow, wide) = ([number(v) for v in q[c]] for c in ("char_len", "width"))
    n, w = F.col("char_len"), F.col("width")
    flags = {
        "flag_width_text_mismatch": F.abs("rz_pixels_per_char") > 4, "flag_shape_text_residual": F.abs("rz_residual") > 4,
        "flag_short_label_wide_image": (n <= short) & (w >= wide), "flag_long_label_narrow_image": (n >= long) & (w <= narrow),
    }
    x = x.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    return x.withColumn("consistency_flag_count", sum(F.col(k).cast("int") for k in flags))


def manual_review(rows: DataFrame, /, **tables: DataFrame) -> DataFrame:
    """J-10: rows (ID, ...) with each table's flags and count (name_flag_count), missing ones zero, and their
    total. Whoever wants the worst first sorts by total_flag_count."""
    out = rows
    for df in tables.values():
        out = out.join(df.select("ID", *[c for c in df.columns if c.endswith("flag_count") or c.startswith("flag_")]), "ID", "left")
    counts = [c for c in out.columns if c.endswith("flag_count")]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in counts})
    return out.withColumn("total_flag_count", sum((F.col(c) for c in counts), F.lit(0)))


def holds_any(text: Column, letters: str) -> Column:
    """P-10."""
    return F.arrays_overlap(chars(F.coalesce(text, F.lit(""))), F.array(*[F.lit(c) for c in letters])) if letters else F.lit(False)


def alphabet_union(a: Column, b: Column) -> Column:
    """U-05: sorted characters of either array."""
    return F.array_sort(F.array_union(a, b))


def collisions(alphabet: Column, reserved: list[str]) -> Column:
    """U-05: symbols that an alphabet must not hold, but does."""
    return F.array_sort(F.array_intersect(alphabet, F.array(*[F.lit(x) for x in reserved])))


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """J-13, D-10: every combination of the values, with a run name; as many rows as the lists multiply to."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.crossJoin(spark.createDataFrame([(v,) for v in values], [name]))
    return out.withColumn("run_name", F.concat_ws("_", *[F.concat(F.lit(n), F.col(n).cast("string")) for n in axes]))


def output_steps(width: Column, factor: int = 4) -> Column:
    """D-06: time steps that a network gives for a width."""
    return F.greatest(F.lit(1), F.floor(width / factor)).cast("long")


def resolve_model(name: str, registry: dict[str, str]) -> str:
    """S-21: the address of a model by its short name; a path or address stands for itself."""
    if name in registry:
        return registry[name]
    if "/" in name or "." in name:
        return name
    raise ValueError(f"unknown model {name!r}; known are {', '.join(sorted(registry))}")
