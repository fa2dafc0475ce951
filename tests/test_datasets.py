"""Exports as files: layout, bytes, reruns."""

import json
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import images
from quillspark.sources import datasets, filetree

COLUMNS = "ID string, Target string, fold int, width int, height int, channels int, pixels binary"


def unpng(raw: bytes) -> np.ndarray:
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        assert struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        parts[kind], at = body, at + 12 + size
    wide, high, depth, colour = struct.unpack(">IIBB", parts[b"IHDR"][:10])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(high, -1)
    assert depth == 8 and not rows[:, 0].any()
    return rows[:, 1:].reshape(high, wide, {0: 1, 2: 3}[colour])


def picture(seed, wide=40, high=10):
    return np.random.default_rng(seed).integers(0, 256, (high, wide, 3), dtype=np.uint8)


@pytest.fixture(scope="module")
def manifests(spark):
    row = lambda k, i, t, f: (i, t, f, 40, 10, 3, picture(k).tobytes())
    train = spark.createDataFrame([row(1, "a", "By  this ", 0), row(2, "b", "Act é", 1), row(3, "c", None, 1)], COLUMNS)
    return train, spark.createDataFrame([row(4, "d", None, None)], COLUMNS).drop("Target", "fold")


def files(path: Path) -> dict[str, bytes]:
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*") if p.is_file() and p.suffix != ".crc"}


def test_kraken_layout(manifests, tmp_path):
    datasets.kraken_dataset(*manifests, str(tmp_path), 0, height=16, form="NFC")
    got = files(tmp_path)
    assert set(got) == {"train/b.png", "train/b.gt.txt", "train/c.png", "train/c.gt.txt", "val/a.png", "val/a.gt.txt", "test/d.png", "train_files.txt", "val_files.txt", "test_files.txt", "metadata.json"}
    assert got["train/b.gt.txt"] == "Act é\n".encode() and got["val/a.gt.txt"] == b"By this\n" and got["train/c.gt.txt"] == b"\n"
    assert got["train_files.txt"].decode() == f"{tmp_path}/train/b.png\n{tmp_path}/train/c.png\n" and got["test_files.txt"].decode() == f"{tmp_path}/test/d.png\n"
    about = json.loads(got["metadata.json"])
    assert (about["train_rows"], about["val_rows"], about["test_rows"], about["image_height"]) == (2, 1, 1, 16)
    want = images.resized(images.grey(picture(2))[:, :, None], 64, 16, "cubic")
    assert (unpng(got["train/b.png"]) == want).all() and got["train/b.png"] == datasets.png(want)


def test_pylaia_tables(manifests, tmp_path):
    datasets.pylaia_dataset(*manifests, str(tmp_path), 0, height=16, mode="RGB")
    got = files(tmp_path)
    assert {k for k in got if not k.startswith("images")} == {f"{s}{t}.txt" for s in ("train", "val", "test") for t in ("", "_text", "_ids")} | {"syms.txt", "metadata.json"}
    assert got["train.txt"].decode() == "train/b A c t <space> e ́\ntrain/c \n" and got["val_text.txt"] == b"val/a By this\n"
    assert got["test.txt"] == got["test_text.txt"] == got["test_ids.txt"] == b"test/d\n" and got["train_ids.txt"] == b"train/b\ntrain/c\n"
    syms = got["syms.txt"].decode().splitlines()
    assert syms[0] == "<ctc> 0" and syms[-2:] == [f"<unk> {len(syms) - 2}", f"<space> {len(syms) - 1}"] and len(syms) == 3 + len(set("By thisAct é") - {" "})
    assert unpng(got["images/val/a.png"]).shape == (16, 64, 3)


def test_folders_and_what_exists(manifests, tmp_path, monkeypatch):
    monkeypatch.setattr(datasets, "LINES", 1)
    datasets.kraken_dataset(*manifests, str(tmp_path), 0, height=16, fanout=16)
    got = files(tmp_path)
    images_ = sorted(k for k in got if k.endswith(".png"))
    assert len(images_) == 4 and all(k.count("/") == 2 for k in images_) and {k for k in got if k.startswith("train_files")} == {"train_files-00000.txt", "train_files-00001.txt"}
    (tmp_path / images_[0]).write_bytes(b"own")
    datasets.kraken_dataset(*manifests, str(tmp_path), 0, height=16, fanout=16)
    assert (tmp_path / images_[0]).read_bytes() == b"own" and set(files(tmp_path)) == set(got)
    datasets.kraken_dataset(*manifests, str(tmp_path), 0, height=16, fanout=16, force=True)
    assert files(tmp_path) == got
    with pytest.raises(ValueError, match="empty"):
        datasets.kraken_dataset(*manifests, str(tmp_path / "x"), 7)
    with pytest.raises(ValueError, match="repeated"):
        datasets.splits(manifests[0].union(manifests[0]), manifests[1], 0)


def test_tasks_that_fail(spark, tmp_path):
    """Half of the rows can't be written: files of the others are whole, nothing else is left; a second run completes them."""
    root = tmp_path / "out"
    x = spark.range(40).select(F.concat(F.lit("d/"), "id").alias("path"), F.encode(F.repeat("id", 50), "utf-8").alias("content")).repartition(8)
    torn = x.withColumn("path", F.when(F.col("path") == "d/33", "../33").otherwise(F.col("path")))
    with pytest.raises(Exception, match="not a path"):
        filetree.write_files(torn, str(root))
    want = {f"d/{k}": (str(k) * 50).encode() for k in range(40)}
    assert all(want[k] == v for k, v in files(root).items()) and not (root / "_attempts").exists()
    filetree.write_files(x, str(root))
    assert files(root) == want
    filetree.write_files(x.limit(3), str(root), mode="overwrite")
    assert len(files(root)) == 3


def test_rows_of_one_file(spark, tmp_path):
    x = spark.range(3000).select(F.concat(F.lit("part"), F.col("id") % 7).alias("path"), F.col("id").alias("at"), F.encode(F.concat("id", F.lit("\n")), "utf-8").alias("content")).repartition(5)
    filetree.write_files(x, str(tmp_path / "o"), together=True)
    assert files(tmp_path / "o") == {f"part{k}": "".join(f"{i}\n" for i in range(k, 3000, 7)).encode() for k in range(7)}


def test_cubic_filter():
    """Weights add up to one; an image of one value stays; a ramp stays a ramp away from its ends."""
    for old, new in ((40, 64), (64, 40), (7, 1), (1, 5)):
        assert np.abs(images.spread(old, new, "cubic").sum(axis=1) - (1 << 22)).max() <= old
    assert (images.resized(np.full((9, 30, 1), 77, np.uint8), 50, 4, "cubic") == 77).all()
    ramp = np.tile(np.arange(0, 200, 4, dtype=np.uint8), (3, 1))[:, :, None]
    assert (np.diff(images.resized(ramp, 100, 3, "cubic")[0, 8:-8, 0].astype(int)) == 2).all()
