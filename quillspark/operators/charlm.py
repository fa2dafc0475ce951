"""A character n-gram model as sorted arrays that workers map into memory (A-17, S-15, T-15, K-09).

A record is an n-gram's code points, big-endian, so that the order of bytes is that of the n-grams, its count
and its context's total. Spark counts, numbers and writes the records, some millions a file; a model.json
beside them tells the order, the constant and the vocabulary's size and letters. Look-ups are binary
searches for many n-grams at once; nothing but an alphabet is held by the driver."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..functions.text import chars
from ..sources.filetree import place, write_files
from .ranks import numbered

#: Codes of the padding before a text and of its end, beyond all characters.
START, END = 0x110000, 0x110001
RECORDS = 4_000_000


def code(c: Column) -> Column:
    return F.when(c == "<s>", F.lit(START)).when(c == "</s>", F.lit(END)).otherwise(F.ascii(c))


def train(df: DataFrame, text: str, path: str, order: int = 4, k: float = 0.5, extra: str = "") -> None:
    """A-17, K-09: writes the model of a column of texts (null: empty), which are taken as they are. extra: characters that the
    vocabulary has besides those of the texts."""
    if order < 1 or k <= 0:
        raise ValueError("order must be 1 or more, k above 0")
    padded = F.concat(F.array_repeat(F.lit("<s>"), order - 1), chars(F.coalesce(F.col(text), F.lit(""))), F.array(F.lit("</s>")))
    grams = df.select(padded.alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - order + 1), lambda i: F.slice("p", i, order))).alias("g"))
    four = lambda x: F.unhex(F.lpad(F.hex(x.cast("long")), 8, "0"))
    eight = lambda x: F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))
    joined = lambda a: F.unhex(F.array_join(F.transform(a, lambda c: F.lpad(F.hex(code(c).cast("long")), 8, "0")), ""))
    counts = grams.groupBy(joined(F.slice("g", 1, order - 1)).alias("context"), F.element_at("g", order).alias("token")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("context").agg(F.sum("n").alias("total"))
    records = counts.join(totals, "context").select(F.concat("context", four(code(F.col("token")))).alias("key"), "n", "total")
    x = numbered(records, "key")
    write_files(x.select(F.format_string("grams-%06d", F.floor(F.col("pos") / RECORDS)).alias("path"), F.col("pos").alias("at"), F.concat("key", eight(F.col("n")), eight(F.col("total"))).alias("content")), path, together=True, mode="overwrite")
    letters = sorted({r["c"] for r in df.select(F.explode(chars(F.col(text))).alias("c")).distinct().collect()} | set(extra))  # an alphabet
    about = json.dumps({"order": order, "k": k, "letters": "".join(letters)}, ensure_ascii=False)
    write_files(df.sparkSession.createDataFrame([("model.json", about.encode())], "path string, content binary"), path)


class ArrayModel:
    """The model of a folder. It is sent to workers as a path, and opened there."""

    def __init__(self, path: str):
        self.path = path
        fs, at = place(path)
        with fs.open_input_stream(f"{at}/model.json") as f:
            about = json.loads(f.read())
        self.order, self.k, self.letters = about["order"], about["k"], about["letters"]
        self.size = len(self.letters) + 1
        self.known = {*self.letters, "</s>"}
        self.kind = np.dtype([("key", f"S{4 * self.order}"), ("n", ">u8"), ("total", ">u8")])
        names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.startswith("grams-"))
        local = isinstance(fs, pafs.LocalFileSystem)
        self.files = [np.memmap(n, self.kind, "r") if local else np.frombuffer(fs.open_input_file(n).read(), self.kind) for n in names]
        self.first = np.array([f["key"][0] for f in self.files], f"S{4 * self.order}")

    def __reduce__(self):
        return ArrayModel, (self.path,)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each key: the count and total of its record, or of the one that would follow it; and that record's key."""
        n, total, own = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys), keys.dtype)
        file = np.searchsorted(self.first, keys, "right") - 1
        for k in np.unique(file):
            at, grams = np.nonzero(file == k)[0], self.files[max(k, 0)]
            place_ = np.searchsorted(grams["key"], keys[at])
            over = place_ == len(grams)  # the next file's first
            inside = at[~over]
            n[inside], total[inside], own[inside] = (grams[c][place_[~over]] for c in ("n", "total", "key"))
            if over.any() and k + 1 < len(self.files):
                n[at[over]], total[at[over]], own[at[over]] = (self.files[k + 1][c][0] for c in ("n", "total", "key"))
        return n, total, own

    def rows(self, contexts: np.ndarray, tokens: list[str]) -> np.ndarray:
        """T-15: log-probabilities [context, token] after contexts of order - 1 codes each. Contexts never seen, and tokens out of the
        vocabulary, are uniform."""
        if not len(contexts):
            return np.zeros((0, len(tokens)))
        codes = np.array([END if t == "</s>" else START if t == "<s>" else ord(t) for t in tokens], ">u4")
        wide = self.order
        head = np.zeros((len(contexts), wide), ">u4")
        head[:, :-1] = contexts
        total = self.totals(head)
        full = np.repeat(head[:, None, :], len(tokens), axis=1)
        full[:, :, -1] = codes
        flat = self.keys(full.reshape(-1, wide))
        n, _, own = self.find(flat)
        n = np.where(own == flat, n, 0).reshape(len(contexts), len(tokens))
        out = np.log((n + self.k) / (total[:, None] + self.k * self.size))
        out[:, [t not in self.known for t in tokens]] = -math.log(self.size)
        return out

    def totals(self, head: np.ndarray) -> np.ndarray:
        """The counts of contexts, given as n-grams [k, order] whose last code is zero."""
        _, total, own = self.find(self.keys(head))
        met = np.ascontiguousarray(own).view(">u4").reshape(-1, self.order)[:, :-1]
        return np.where((met == head[:, :-1]).all(axis=1), total, 0)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(grams, ">u4").view(f"S{4 * self.order}").ravel()

    def chances(self, grams: np.ndarray) -> np.ndarray:
        """Log-probabilities of whole n-grams [k, order]; equal ones are looked up once."""
        some, back = np.unique(self.keys(grams), return_inverse=True)
        if not len(some):
            return np.zeros(0)
        n, _, own = self.find(some)
        head = some.view(">u4").reshape(-1, self.order).copy()
        last = head[:, -1].copy()
        head[:, -1] = 0
        known = np.isin(last, [END, *map(ord, self.letters)])
        out = np.log((np.where(own == some, n, 0) + self.k) / (self.totals(head) + self.k * self.size))
        return np.where(known, out, -math.log(self.size))[back.ravel()]

    def log_prob(self, prefix: str, token: str) -> float:
        """T-15: log P(token | prefix)."""
        if token not in self.known:
            return -math.log(self.size)
        n = self.order - 1
        own = [START] * max(0, n - len(prefix)) + [ord(c) for c in prefix[max(0, len(prefix) - n) :]] if n else []
        return float(self.rows(np.array([own], ">u4").reshape(1, n), [token])[0, 0])


def load(spark: SparkSession, path: str) -> ArrayModel:
    return ArrayModel(path)


def scores(df: DataFrame, text: str, model: ArrayModel) -> DataFrame:
    """T-15: adds log_prob, that of the text with its end (null: empty), and steps, the n-grams that it is a sum of."""
    ship(df.sparkSession)
    ahead = model.order - 1

    @F.pandas_udf("struct<log_prob:double,steps:long>")
    def told(texts: pd.Series) -> pd.DataFrame:
        codes_ = [np.concatenate([np.full(ahead, START), np.frombuffer(t.encode("utf-32-le"), np.uint32), [END]]).astype(">u4") for t in texts]
        grams = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, model.order) for c in codes_] or [np.zeros((0, model.order), ">u4")])
        steps = np.array([len(c) - ahead for c in codes_])
        out = np.bincount(np.repeat(np.arange(len(steps)), steps), model.chances(grams), minlength=len(steps))
        return pd.DataFrame({"log_prob": out, "steps": steps})

    return df.withColumn("told", told(F.coalesce(F.col(text), F.lit("")))).select(*df.columns, "told.*")
