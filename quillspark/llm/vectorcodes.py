"""Compression of vectors by product codes: weighted Lloyd over the distinct parts, in whole numbers.

Components become whole numbers and a vector four equal parts. Equal parts of one position are counted first
(with partial sums before the exchange), so the rounds read each distinct part once with its weight. A
round is one narrow pass: tasks find the nearest entries with numpy and give sums and counts of at most 256
entries a position, which Spark adds up; the codebooks, 4 x 256 entries, are all that the driver and the
closures hold. Codes and errors of distinct parts are then joined back to the vectors' parts and added up by
vector. Parts that more than 1 / HOT of the vectors share can be HOT a position at most: only these are
broadcast, all others go through an exchange in which no key holds more than that share. The sums by label
come back in the same way.

Vectors that are null or hold null or non-finite components are dropped. Lengths must agree and divide by
four, and components be below 2^15 in magnitude, so that every sum is exact; else an error is raised. A null
vec_id comes last in the order of the first codebook and stays null; repeated rows each have a row; ties of
vec_id follow the components. An empty table gives no rows. Extra columns are left out."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
HOT = 200  # a part or label counts as hot if more than 1 / HOT of the vectors have it
LIMIT = 1 << 25  # scaled components are below this, so 16 x 2^52 and sums of 2^37 of them fit 64 bits
SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def whole(vectors: DataFrame, vector: str) -> DataFrame:
    """(row, vec_id, label, part0 to part3) of the vectors that stay, written once, so that row is fixed: parts are the
    components' little-endian bytes."""
    v = F.col(vector)
    fine = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    rows = vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.transform(v, lambda x: x.cast("double")).alias("v"))

    def told(batches):
        for batch in batches:
            column = batch.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            if len(sizes) and ((sizes != sizes[0]).any() or sizes[0] % PARTS):
                raise ValueError(f"vectors of lengths {sorted(set(sizes.tolist()))[:5]}: they must agree and divide by {PARTS}")
            x = np.floor(column.flatten().to_numpy() * SCALE)
            if (np.abs(x) >= LIMIT).any():
                raise ValueError(f"components must be below {LIMIT // SCALE} in magnitude")
            wide = int(sizes[0]) // PARTS if len(sizes) else 0
            x = x.astype("<i8").reshape(len(sizes), PARTS, wide)
            parts = [pa.array([r.tobytes() for r in x[:, k]], pa.binary()) for k in range(PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("label"), *parts], ["row", "vec_id", "label", *(f"part{k}" for k in range(PARTS))])

    kind = vectors.select("label").schema[0].dataType.simpleString()
    return table(arrow_rows(rows).mapInArrow(told, f"row long, vec_id long, label {kind}, " + ", ".join(f"part{k} binary" for k in range(PARTS))))


def numbers(parts) -> np.ndarray:
    parts = list(parts)
    return np.frombuffer(b"".join(parts), "<i8").reshape(len(parts), len(parts[0]) // 8 if parts else 0)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of equals, and its squared distance; exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * max(1, x.shape[1]) * most * most < 1 << 53 else np.int64  # float products are exact while sums fit 53 bits
    code = np.empty(len(x), np.int64)
    b = book.astype(kind)
    size = (b * b).sum(axis=1)
    for k in range(0, len(x), 4096):
        code[k : k + 4096] = (size - 2 * (x[k : k + 4096].astype(kind) @ b.T)).argmin(axis=1)
    return code, ((x - book[code]) ** 2).sum(axis=1)


def judge(weighted: DataFrame, books: list[np.ndarray], sums: bool) -> DataFrame:
    """Of distinct parts (pos, part, n): with sums, each task's (pos, code, n, total by component); else (pos, part, n,
    code, error)."""
    def told(batches):
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            pos = batch.column("pos").to_numpy()
            if not len(pos):
                continue
            x, n = numbers(batch.column("part").to_pylist()), batch.column("n").to_numpy()
            code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
            for k in np.unique(pos).tolist():
                at = pos == k
                code[at], error[at] = nearest(x[at], books[k])
                if sums:
                    np.add.at(total[k], code[at], np.column_stack([n[at], x[at] * n[at, None]]))
            if not sums:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int32()), pa.array(error)], [*batch.schema.names, "code", "error"])
        if sums:
            used = [(k, c, t) for k, own in enumerate(total) for c, t in enumerate(own.tolist()) if t[0]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in used], pa.int32()), pa.array([c for _, c, _ in used], pa.int32()), pa.array([t[0] for _, _, t in used], pa.int64()), pa.array([t[1:] for _, _, t in used], pa.list_(pa.int64()))], ["pos", "code", "n", "total"])

    schema = "pos int, code int, n long, total array<long>" if sums else "pos int, part binary, n long, code int, error long"
    return arrow_rows(weighted).mapInArrow(told, schema)


def trained(weighted: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after so many rounds; what comes to the driver is a row for each entry."""
    for _ in range(rounds):
        wide = books[0].shape[1]
        each = judge(weighted, books, True).groupBy("pos", "code").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(wide)])
        books = [b.copy() for b in books]
        for r in each.collect():
            books[r["pos"]][r["code"]] = [r[f"t{i}"] // r["n"] for i in range(wide)]
    return books


def joined(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], least: int) -> DataFrame:
    """left with right's values by keys, of which right has a row each with n, the rows of left that have them. Keys of
    more than least rows are few enough to broadcast; no other is worth more than that in the exchange."""
    match = lambda r: [F.col(f"l.{k}").eqNullSafe(F.col(f"{r}.{k}")) for k in keys]
    x = left.alias("l").join(F.broadcast(right.where(F.col("n") > least)).alias("h"), match("h"), "left")
    x = x.select("l.*", F.col("h.n").isNotNull().alias("hot"), *[F.col(f"h.{v}").alias(v) for v in values])
    rest = x.where("not hot").drop(*values).alias("l").join(right.where(F.col("n") <= least).alias("r"), match("r"))
    return x.where("hot").select(*left.columns, *values).unionByName(rest.select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{v}") for v in values]))


def compress(vectors: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector that stays."""
    rows = whole(vectors, vector)
    names = [f"part{k}" for k in range(PARTS)]
    first = rows.orderBy(F.asc_nulls_last("vec_id"), *names).limit(ENTRIES).collect()  # the codebooks' size
    if not first:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    if len({int(x) for r in rows.agg(*[f(F.octet_length(c)) for c in names for f in (F.min, F.max)]).collect() for x in r}) > 1:
        raise ValueError("vectors of several lengths")
    books = [numbers(r[c] for r in first).copy() for c in names]
    parts = rows.select("row", F.posexplode(F.array(*names)).alias("pos", "part"))
    weighted = table(parts.groupBy("pos", "part").agg(F.count("*").alias("n")))
    books = trained(weighted, books, rounds)
    codes = table(judge(weighted, books, False))
    n = rows.count()
    by_part = joined(parts, codes, ["pos", "part"], ["code", "error"], n // HOT)
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda c: F.lower(F.lpad(F.hex(c["code"]), 2, "0"))), "")
    by_row = by_part.groupBy("row").agg(letters.alias("code"), F.sum("error").alias("error"))
    done = table(rows.select("row", "vec_id", "label").join(by_row, "row").drop("row"))
    labels = table(done.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")))
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    out = joined(done, labels, ["label"], ["label_error"], n // HOT)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
