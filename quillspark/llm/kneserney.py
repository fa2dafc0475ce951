"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Word pairs are counted per task and dealt by the first word and a slice of the second, so that no
frequent word gathers in one task; each bucket's exact pair counts become a sorted hash array in the shared folder. What each
bucket knows of its words (context totals, counts of counts, distinct predecessors) is summed by
word in a second exchange, which writes the sorted arrays of words. Files are replaced whole, so a
task that runs again leaves the same model."""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_bytes, packed, planes, shared_dir, unpacked, unplaned

END, BEGIN = np.uint64(1), np.uint64(2)  # no word's: theirs are 3 at least
MIX = np.uint64(0x9E3779B97F4A7C15)
MUCH = 255  # counts from here on are in arrays of their own


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Words(dict):
    def __missing__(self, w):
        if len(self) > 400_000:
            self.clear()
        h = self[w] = max(3, xxhash.xxh64_intdigest(w))
        return h


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * MIX)) * MIX
    return (x ^ (x >> np.uint64(29))) * MIX ^ (b >> np.uint64(7))


def stream(bodies: list[bytes], known: Words):
    """Hashes of all words with BEGIN before and END after each text, and each text's count of words and END."""
    split = [b.lower().split() for b in bodies]
    sizes = np.array([len(s) + 1 for s in split])
    out = np.empty(int(sizes.sum()) + len(split), np.uint64)
    at = 0
    for s in split:
        out[at] = BEGIN
        out[at + 1 : at + 1 + len(s)] = np.fromiter(map(known.__getitem__, s), np.uint64, len(s))
        at += len(s) + 2
        out[at - 1] = END
    return out, sizes


def summed(key: np.ndarray, *cols: np.ndarray):
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, int)
    return key[first], *[np.add.reduceat(c[order], first) if len(key) else c for c in cols]


def local(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError("the model's folder must be one that executors mount, so that they can map its files")
    return path.removeprefix("file://")


def save(folder: str, name: str, a: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}.npy"  # attempts on several machines may have one pid
    np.save(part, a)
    os.replace(part, f"{folder}/{name}.npy")


def discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the numbers of types with counts 1 to 4."""
    if min(n) <= 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


def place(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a pair: by its first word, and by one of sqrt(buckets) slices of the second, so that a
    bucket holds many pairs of a word (which then travels once) and no frequent word gathers in one."""
    x = (a + (b % np.uint64(math.isqrt(buckets))) * MIX) * MIX
    return ((x ^ (x >> np.uint64(31))) * MIX >> np.uint64(33)) % np.uint64(buckets)


def count(docs: DataFrame, folder: str, buckets: int):
    """Writes the model's arrays; gives its scalars."""
    def pairs(batches):
        known, waiting, size = Words(), [], 0

        def flush():
            x = np.concatenate(waiting)
            a, b = x[:-1], x[1:]
            on = a != END
            a, b = a[on], b[on]
            own = place(a, b, buckets)
            order = np.lexsort((b, a, own))
            a, b, own = a[order], b[order], own[order]
            first = np.nonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (a[1:] != a[:-1])]))[0]
            n = np.diff(np.append(first, len(a))).astype(np.uint64)
            a, b, own = a[first], b[first], own[first]
            cut = np.searchsorted(own, np.arange(buckets + 1, dtype=np.uint64))
            put = [k for k in range(buckets) if cut[k] < cut[k + 1]]
            blobs = []
            for k in put:
                i = slice(cut[k], cut[k + 1])
                begin = np.nonzero(np.concatenate([[True], a[i][1:] != a[i][:-1]]))[0]
                runs = np.diff(np.append(begin, cut[k + 1] - cut[k])).astype(np.uint32)
                blobs.append(packed(np.array([len(begin), len(b[i])], np.int64).tobytes() + a[i][begin].tobytes() + b[i].tobytes() + planes(runs) + planes(n[i])))
            return pa.RecordBatch.from_arrays([pa.array(put, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                x, _ = stream(batch.column(1).slice(k, 100).to_pylist(), known)
                waiting.append(x)
                size += len(x)
                if size > 1_500_000:
                    yield flush()
                    waiting.clear()
                    size = 0
        if size:
            yield flush()

    def dealt(kind, w, cols):
        """Rows (bucket, blob) of words and their numbers, by the word."""
        own = w % np.uint64(buckets)
        order = np.lexsort((w, own))
        w, cols, cut = w[order], [c[order].astype(np.uint64) for c in cols], np.searchsorted(own[order], np.arange(buckets + 1, dtype=np.uint64))
        return [(k, kind.tobytes() + packed(w[i].tobytes() + b"".join(planes(c[i]) for c in cols))) for k in range(buckets) if (i := slice(cut[k], cut[k + 1])).start < i.stop]

    def merge(key, t):
        bucket = key[0].as_py()
        a, b, n = [], [], []
        for blob in map(unpacked, t.column("blob").to_pylist()):
            x, y = np.frombuffer(blob, np.int64, 2).tolist()
            runs = unplaned(blob, 16 + 8 * x + 8 * y, x, np.uint32)
            a.append(np.repeat(np.frombuffer(blob, np.uint64, x, 16), runs)), b.append(np.frombuffer(blob, np.uint64, y, 16 + 8 * x)), n.append(unplaned(blob, 16 + 12 * x + 8 * y, y, np.uint64))
        a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n).astype(np.int64)
        h = pair(a, b)
        order = np.argsort(h)
        h, a, b, n = h[order], a[order], b[order], n[order]
        first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
        h, a, b, n = h[first], a[first], b[first], np.add.reduceat(n, first)
        much = n >= MUCH
        save(folder, f"pair-{bucket}-key", h), save(folder, f"pair-{bucket}-n", np.minimum(n, MUCH).astype(np.uint8))
        save(folder, f"much-{bucket}-key", h[much]), save(folder, f"much-{bucket}-n", n[much])
        kinds = np.array([int((n == k).sum()) for k in (1, 2, 3, 4)], np.int64)
        first, *after = summed(a, n, n == 1, n == 2, n > 2)
        second, *before = summed(b, np.ones(len(n), np.int64), n)
        out = [(-1, kinds.tobytes()), *dealt(np.uint8(0), first, after), *dealt(np.uint8(1), second, before)]
        return pa.table({"bucket": pa.array([k for k, _ in out], pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})

    def words(key, t):
        bucket, blobs = key[0].as_py(), t.column("blob").to_pylist()
        if bucket < 0:
            return pa.table({"kind": ["pairs"], "n": pa.array([np.sum([np.frombuffer(x, np.int64) for x in blobs], axis=0).tolist()], pa.list_(pa.int64()))})
        every, cols = [], [[] for _ in range(6)]
        for x in blobs:
            kind, x = x[0], unpacked(x[1:])
            wide = (4, 2)[kind]
            n = len(x) // (8 + 8 * wide)
            every.append(np.frombuffer(x, np.uint64, n))
            for c, own in enumerate(cols):
                have = c - 4 * kind
                own.append(unplaned(x, (8 + 8 * have) * n, n, np.uint64).astype(np.int64) if 0 <= have < wide else np.zeros(n, np.int64))
        w, *cols = summed(np.concatenate(every), *map(np.concatenate, cols))
        save(folder, f"word-{bucket}-key", w), save(folder, f"word-{bucket}-n", np.stack(cols, axis=1))
        before, n = cols[4], cols[5]
        return pa.table({"kind": ["words"], "n": pa.array([[int(n.sum()), int((n > 0).sum()), int(before.sum()), *(int((before == k).sum()) for k in (1, 2, 3, 4)), int((before > 2).sum())]], pa.list_(pa.int64()))})

    counted = id_and_bytes(docs).mapInArrow(pairs, "bucket int, blob binary")
    partial = counted.groupBy("bucket").applyInArrow(merge, "bucket int, blob binary")
    sums = partial.groupBy("bucket").applyInArrow(words, "kind string, n array<long>").groupBy("kind").agg(F.array(*[F.sum(F.get("n", F.lit(k))) for k in range(8)]).alias("n")).collect()  # two rows
    got = {r["kind"]: r["n"] for r in sums}
    one, two = got.get("words", [0] * 8), got.get("pairs", [0] * 4)[:4]
    return {"N": one[0], "V": one[1], "types": one[2], "kinds": one[3:7], "many": one[7], "d2": discounts(two), "d1": discounts(one[3:7])}


class Model:
    """The mapped arrays of a folder; lookups take sorted distinct hashes."""

    def __init__(self, folder: str, buckets: int, m: dict):
        self.folder, self.buckets, self.m, self.open = folder, buckets, m, {}

    def map(self, name: str):
        if name not in self.open:
            path = f"{self.folder}/{name}.npy"
            self.open[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[name]

    def find(self, kind: str, h: np.ndarray, own: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(h), width), np.int64)
        order = np.argsort(own, kind="stable")
        cut = np.searchsorted(own[order], np.arange(self.buckets + 1, dtype=np.uint64))
        for k in range(self.buckets):
            on = order[cut[k] : cut[k + 1]]
            if len(on) and (keys := self.map(f"{kind}-{k}-key")) is not None and len(keys):
                at = np.minimum(np.searchsorted(keys, h[on]), len(keys) - 1)
                hit = keys[at] == h[on]
                out[on[hit]] = self.map(f"{kind}-{k}-n")[at[hit]].reshape(-1, width)
        return out

    def scores(self, x: np.ndarray):
        """For each token but BEGINs: its count, log10 of the base and of the model."""
        m = self.m
        w, inv = np.unique(x, return_inverse=True)
        info = self.find("word", w, w % np.uint64(self.buckets), 6)
        total, n1, n2, n3, before, n = info.T
        d1, d2 = m["d1"], m["d2"]
        types = max(m["types"], 1)
        rest = (d1[1] * m["kinds"][0] + d1[2] * m["kinds"][1] + d1[3] * m["many"]) / types if m["types"] else 1.0
        low = np.maximum(before - d1[np.minimum(before, 3)], 0) / types + rest / (m["V"] + 1)
        back = np.where(total > 0, (d2[1] * n1 + d2[2] * n2 + d2[3] * n3) / np.maximum(total, 1), 1.0)
        a, b = inv[:-1], inv[1:]
        on = x[1:] != BEGIN
        a, b = a[on], b[on]
        h, where = np.unique(pair(w[a], w[b]), return_inverse=True)
        own = np.empty(len(h), np.uint64)
        own[where] = place(w[a], w[b], self.buckets)
        c = self.find("pair", h, own, 1)[:, 0]
        much = np.nonzero(c == MUCH)[0]
        c[much] = self.find("much", h[much], own[much], 1)[:, 0]
        c = c[where]
        p = np.maximum(c - d2[np.minimum(c, 3)], 0) / np.maximum(total[a], 1) + back[a] * low[b]
        return n[b], np.log10((n[b] + 1) / (m["N"] + m["V"] + 1)), np.log10(p)


def perplexity(docs: DataFrame, training: DataFrame, bucket_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every whole text.

    Null and blank texts are the end token alone; repeated rows are scored and counted each; with
    nothing to learn from, every token has the uniform probability of a vocabulary of one. There is a bucket
    for each bucket_bytes of training text, so that a task's memory doesn't grow with the input."""
    spark = docs.sparkSession
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    folder = local(shared_dir(spark))
    m = count(training, folder, buckets)

    def run(batches):
        known, model = Words(), Model(folder, buckets, m)
        for b in batches:
            rows = []
            for k in range(0, b.num_rows, 200):
                x, sizes = stream(b.column(1).slice(k, 200).to_pylist(), known)
                n, base, score = model.scores(x)
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                rows.append((sizes, np.add.reduceat(n > 0, first, dtype=np.int64), np.add.reduceat(base, first), np.add.reduceat(score, first)))
            size, have, base, score = (np.concatenate(c) for c in zip(*rows)) if rows else [np.zeros(0)] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int64)), pa.array(have.astype(np.int64)), pa.array(np.full(len(size), m["N"], np.int64)), pa.array(base.astype(float)), pa.array(score.astype(float)), pa.array(10.0 ** np.minimum(-score / np.maximum(size, 1), 300))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return id_and_bytes(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_documents(docs: DataFrame) -> DataFrame:
    out = perplexity(docs, docs.where(~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *out.columns[1:])
