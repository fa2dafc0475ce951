"""Stored manifests, image headers, checked joins."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import ensemble, evaluation, relations
from quillspark.sources import imageheaders, manifests
from quillspark.sources.datasets import png
from test_datasets import picture


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_folds_prune_and_buckets_join(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("ID"), (F.col("id") % 5).cast("int").alias("fold"), F.lit("text").alias("Target"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        manifests.store(rows, "lines", str(tmp_path / "m"), 8)
        manifests.store(rows.select("ID", F.lit("/p").alias("image_path")), "files", str(tmp_path / "f"), 8, fold=None)
        one = manifests.load(spark, "lines", fold=2)
        assert one.count() == 100 and manifests.load(spark, "lines", but=2).count() == 400 and manifests.load(spark, "lines").count() == 500
        joined = relations.attach(one, spark.table("files"), "ID", "image_path")
        assert joined.count() == 100
        text = plan(joined)
        assert "(fold#" in text.split("PartitionFilters")[1][:80] and "Exchange" not in text
        assert len(list((tmp_path / "m" / "fold=2").glob("*.parquet"))) <= 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS lines"), spark.sql("DROP TABLE IF EXISTS files")


def jpeg(wide, high, parts=3, before=b""):
    frame = struct.pack(">BHHB", 8, high, wide, parts) + b"\1\x11\0" * parts
    return b"\xff\xd8" + before + b"\xff\xff\xff\xc2" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xda\0\2" + b"\0" * 1000


def test_headers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    exif = b"\xff\xe1" + struct.pack(">H", 60_002) + b"\xff\xc0" * 30_000  # bytes that look like frames
    files = {"a.png": png(picture(1)), "sub/b.jpg": jpeg(120, 48, 3, exif), "c.jpg": jpeg(7, 9, 1), "cut.jpg": jpeg(7, 9)[:8], "no.png": b"text", "empty.jpg": b"", "zero.jpg": jpeg(0, 5), "skip.txt": b"x"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    grey = png(picture(1)[:, :, :1])
    (tmp_path / "g.png").write_bytes(grey)
    got = {r.ID: r for r in imageheaders.sizes(spark, str(tmp_path), "*.[pj][np]g", files=2).collect()}
    assert {k: (r.width, r.height, r["mode"]) for k, r in got.items() if r.readable} == {"a": (40, 10, "RGB"), "b": (120, 48, "RGB"), "c": (7, 9, "L"), "g": (40, 10, "L")}
    assert {k for k, r in got.items() if not r.readable} == {"cut", "no", "empty", "zero"}
    assert (got["a"].aspect_ratio, got["a"].area, got["g"].bytes) == (4.0, 400, len(grey)) and zlib.crc32(grey)
    (tmp_path / "none").mkdir()
    assert imageheaders.sizes(spark, str(tmp_path / "none")).count() == 0


def test_align_tells_what_is_wrong(spark):
    t = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "ID string, Target string")
    good = sorted(map(tuple, evaluation.align(t("a", "b"), t("b", "a")).collect()))
    assert good == [("a", "ta", "ta"), ("b", "tb", "tb")]
    assert [r.ID for r in evaluation.align(t("a", "b", "c"), t("b"), subset=True).collect()] == ["b"]
    for args, message in (((t("a", "a"), t("a")), "truth: repeated IDs ..a"), ((t("a"), t("a", "a")), "predictions: repeated IDs ..a"), ((t("a"), t("a", "z", "y")), "unknown IDs ..y., .z"), ((t("a", "b"), t("a")), "missing IDs ..b")):
        with pytest.raises(ValueError, match=message):
            evaluation.align(*args)
    with pytest.raises(ValueError, match="unknown"):
        evaluation.align(t("a"), t("z"), subset=True)
    with pytest.raises(ValueError, match="missing columns"):
        evaluation.align(t("a").drop("Target"), t("a"))


def test_sources_agree(spark):
    t = lambda *ids: spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "ID string, pos int")
    ensemble.require_same_ids(t("a", "b"), {"x": t("b", "a"), "y": t("a", "b")})
    ensemble.require_same_ids(t("a"), {})
    with pytest.raises(ValueError, match=r"y: .* missing \['b'\], extra \['c', 'd'\]"):
        ensemble.require_same_ids(t("a", "b"), {"x": t("b", "a"), "y": t("a", "d", "c")})
    ensemble.require_same_order({"x": t("a", None), "y": t("a", None)})
    for other in (t("a", "c"), t("a"), t("a", "b", "c")):
        with pytest.raises(ValueError, match="z: .* order of x's, from place [12] on"):
            ensemble.require_same_order({"x": t("a", "b"), "y": t("a", "b"), "z": other})


def test_sizes_by_tasks(spark, tmp_path):
    """No partition is made by the driver for each so many files, and images go to Python in bounded batches."""
    for k in range(40):
        (tmp_path / f"{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"{k % 3}" / f"{k}.png").write_bytes(png(np.zeros((2, k + 1, 1), np.uint8)))
    x = imageheaders.sizes(spark, str(tmp_path), "*.png", files=3)
    assert x.rdd.getNumPartitions() <= 4
    assert sorted((int(r.ID), r.width, r.height) for r in x.collect()) == [(k, k + 1, 2) for k in range(40)]
