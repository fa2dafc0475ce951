"""The sizes of images from the first bytes of their files (S-02, S-05), without decoding.

One task goes through the folders and holds few paths at a time; the files are dealt out evenly. A task reads
a PNG's first chunk, or follows a JPEG's segments by their lengths up to the one that tells its frame."""

from __future__ import annotations

import fnmatch
import os
import struct
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..shared import spread
from .filetree import place
from .readers import prediction_id

#: PNG's colour types, JPEG's numbers of components, and its markers of frames.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}


def header(f) -> tuple[int, int, str] | None:
    """(width, height, mode) of an open file, or None if it is neither PNG nor JPEG, or broken before its size."""
    head = f.read(26)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) == 26 and head[12:16] == b"IHDR":
        wide, high, depth, colour = struct.unpack(">IIBB", head[16:26])
        mode = "1" if (depth, colour) == (1, 0) else "I;16" if (depth, colour) == (16, 0) else PNG_MODES.get(colour)
        return (wide, high, mode) if wide and high and mode else None
    if head[:2] != b"\xff\xd8":
        return None
    f.seek(2)
    while True:
        mark = f.read(2)
        while len(mark) == 2 and mark == b"\xff\xff":  # filling
            mark = b"\xff" + f.read(1)
        if len(mark) < 2 or mark[0] != 0xFF:
            return None
        kind = mark[1]
        if kind == 0x01 or 0xD0 <= kind <= 0xD8:  # markers without a length
            continue
        size = f.read(2)
        if len(size) < 2 or kind in (0xD9, 0xDA):
            return None
        size = struct.unpack(">H", size)[0]
        if kind in FRAMES:
            body = f.read(6)
            if len(body) < 6:
                return None
            _, high, wide, parts = struct.unpack(">BHHB", body)
            return (wide, high, JPEG_MODES.get(parts, "RGB")) if wide and high else None
        if size < 2:
            return None
        f.seek(f.tell() + size - 2)


def files_under(fs: pafs.FileSystem, root: str, glob: str):
    """Paths of all files below a folder; local folders are gone through entry by entry."""
    if isinstance(fs, pafs.LocalFileSystem):
        waiting = [root]
        while waiting:
            with os.scandir(waiting.pop()) as found:
                for e in found:
                    if e.is_dir():
                        waiting.append(e.path)
                    elif fnmatch.fnmatch(e.name, glob):
                        yield e.path
    else:
        for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            if f.is_file and fnmatch.fnmatch(f.base_name, glob):
                yield f.path


def sizes(spark: SparkSession, path: str, glob: str = "*.jpg", files: int = 2000) -> DataFrame:
    """S-02, S-05: (ID, image_path, bytes, width, height, aspect_ratio, area, mode, readable) of each image file, with so many
    paths at a time; unreadable ones have no size."""
    ship(spark)

    def names(batches):
        for b in batches:
            if b.num_rows:
                every = files_under(*place(path), glob)
                while some := list(islice(every, files)):
                    yield pa.RecordBatch.from_arrays([pa.array(some)], ["path"])

    def read(batches):
        fs, _ = place(path)
        for b in batches:
            rows = []
            for f in fs.get_file_info(b.column(0).to_pylist()):
                try:
                    with fs.open_input_file(f.path) as opened:
                        got = header(opened)
                except OSError:
                    got = None
                rows.append((f.path, f.size, *(got or (None, None, None))))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["image_path", "bytes", "width", "height", "mode"])

    listed = spark.range(0, 1, 1, 1).mapInArrow(names, "path string")
    x = spread(listed).mapInArrow(read, "image_path string, bytes long, width int, height int, mode string")
    w, h = F.col("width"), F.col("height")
    return x.select(prediction_id(F.col("image_path")).alias("ID"), "image_path", "bytes", "width", "height", (w / h).alias("aspect_ratio"), (w.cast("long") * h).alias("area"), "mode", w.isNotNull().alias("readable"))
