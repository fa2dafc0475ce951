"""SimHash near-dedup: word-shingle fingerprints, exact tiled comparison.

Fingerprints are 64 bits. Distinct ones are dealt to cells by the population counts of their four
16-bit parts, at most 17**4 of them; two fingerprints within the radius lie in cells whose counts
differ by the radius at most in sum, so all other tile pairs are skipped. Cells are cut into tiles of
bounded size, and each tile pair is compared exactly by exclusive-or and bit counts."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, components, fresh, id_and_bytes, stars, table

TILE = 4096
SPREAD = 64  # tiles of a cell that one task compares with all tiles it meets


def hashes(body: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles; a shorter text is one shingle, a blank one has none."""
    words = body.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)


def majority(got: np.ndarray) -> int:
    """Signed 64-bit value; a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(got), 8192):
        ones += np.unpackbits(got[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(got), bitorder="little").view(np.int64)[0])


def fingerprint(body: bytes, width: int = 3) -> int:
    """Signed 64-bit value; a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    return majority(hashes(body, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per document; null and blank texts get zero."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x, width) for x in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return id_and_bytes(docs).mapInArrow(run, "doc_id long, fp long")


def meeting(left: DataFrame, tiles: DataFrame, cell: list[str]) -> DataFrame:
    """left (tiles with their number in ta) joined with the tiles of the same cell. A cell of many tiles is dealt
    over several keys, with SPREAD tiles of left or so each."""
    # one row for each cell
    salts = F.broadcast(tiles.groupBy(*cell).agg(F.ceil((F.max("t") + 1) / SPREAD).cast("int").alias("salts")))
    a = left.join(salts, cell).withColumn("salt", F.pmod(F.col("ta"), F.col("salts"))).drop("salts")
    b = tiles.join(salts, cell).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return a.join(b, [*cell, "salt"])


def close_pairs(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(src, dst): edges that join all of the distinct values of fp within the radius, as stars per tile pair."""
    part = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)).cast("int")
    cells = fps.select("fp", *[part(k).alias(f"p{k}") for k in range(4)])
    p = [f"p{k}" for k in range(4)]
    # at most 17**4 cells have a count, whatever the input
    sized = cells.join(F.broadcast(cells.groupBy(*p).agg(F.ceil(F.count("*") / TILE).alias("tiles"))), p)
    tiles = table(sized.withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).groupBy(*p, "t").agg(F.collect_list("fp").alias("fps")))
    ahead = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    moves = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)]) for d in ahead])
    left = tiles.withColumn("d", F.explode(moves)).select(*[(F.col(f"p{k}") + F.col(f"d.d{k}")).alias(f"p{k}") for k in range(4)], (F.col("d") == F.struct(*[F.lit(0).alias(f"d{k}") for k in range(4)])).alias("home"), F.col("t").alias("ta"), F.col("fps").alias("a"))
    pairs = meeting(left, tiles.withColumnRenamed("fps", "b"), p).where("not home or ta <= t").select((F.col("home") & (F.col("ta") == F.col("t"))).alias("own"), "a", "b")

    def run(batches):
        for batch in batches:
            own, src, dst = batch.column(0).to_pylist(), [], []
            for k, same in enumerate(own):
                a, b = (np.asarray(batch.column(c)[k].values).view(np.uint64) for c in (1, 2))
                i, j = [], []
                for s in range(0, len(a), 256):
                    x, y = np.nonzero(np.bitwise_count(a[s : s + 256, None] ^ b[None, :]) <= radius)
                    if same:
                        x, y = x[x + s < y], y[x + s < y]
                    i.append(x + s), j.append(y)
                i, j = np.concatenate(i), np.concatenate(j)
                if len(i):
                    both = a if same else np.concatenate([a, b])
                    lab = stars(len(both), i, j if same else j + len(a))
                    on = np.nonzero(lab != np.arange(len(both)))[0]
                    src.append(both[on].view(np.int64)), dst.append(both[lab[on]].view(np.int64))
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    return arrow_rows(pairs).mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links, itself included.

    Null and blank texts have fingerprint zero and are linked like any other; null ids take part but
    are no component's name unless all its ids are null. Repeated rows give a row each."""
    rows = table(fingerprints(docs, width))
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(close_pairs(own, radius))
    classes = own.join(roots, own.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(classes.join(lows, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingles(body: bytes, width: int) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(hashes(body, width))


def sketch(body: bytes, width: int) -> tuple[int, int, int]:
    """(number of distinct shingles, two signed 64-bit halves of their fingerprint)."""
    got = shingles(body, width)
    return len(got), majority(got), majority(mixed(got))


def mixed(x: np.ndarray) -> np.ndarray:
    """Other 64 bits of each hash (the finaliser of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    n = len(np.intersect1d(a, b, assume_unique=True))
    return n / (len(a) + len(b) - n) if len(a) + len(b) else 1.0


def candidates(nodes: DataFrame, least: float, radius: int, both: int, every: bool) -> DataFrame:
    """(src, dst): keys of nodes (key, n, f0, f1, comp) whose halves differ in radius bits at most in the first and
    in both at most in all, and whose counts n allow the similarity. Pairs of one comp are left out; with every all
    the others are told, else stars per tile pair.

    Similar sets have counts within the factor 1 / least, so cells of the count's logarithm to that base
    meet themselves and the next cell alone; that loses no pair."""
    cell = F.when(F.col("n") == 0, -9).otherwise(F.floor(F.log("n") / float(-np.log(least)) + 1e-9)).cast("int")
    cells = nodes.withColumn("cell", cell)
    sized = cells.join(F.broadcast(cells.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("tiles"))), "cell")
    five = ("key", "n", "f0", "f1", "comp")
    tiles = sized.withColumn("t", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")).groupBy("cell", "t").agg(F.collect_list(F.struct(*five)).alias("r"))
    tiles = table(tiles.select("cell", "t", *[F.col(f"r.{c}").alias(c) for c in five]))
    left = tiles.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("d"), F.col("cell").alias("cell_a"), F.col("t").alias("ta"), *[F.col(c).alias(f"{c}_a") for c in five]).withColumn("cell", F.col("cell_a") + F.col("d"))
    pairs = meeting(left, tiles, ["cell"]).where("d = 1 or ta <= t").select((F.expr("d = 0 and ta = t")).alias("own"), *[f"{c}_a" for c in five], *five)

    def run(batches):
        for batch in batches:
            own, src, dst = batch.column(0).to_pylist(), [], []
            for k, same in enumerate(own):
                (ka, na, xa, ya, ca), (kb, nb, xb, yb, cb) = ([np.asarray(batch.column(c)[k].values) for c in range(s, s + 5)] for s in (1, 6))
                i, j = [], []
                for s in range(0, len(ka), 256):
                    x, y = np.nonzero(np.bitwise_count(xa[s : s + 256, None].view(np.uint64) ^ xb[None, :].view(np.uint64)) <= radius)
                    x += s
                    ok = (np.bitwise_count((xa[x] ^ xb[y]).view(np.uint64)) + np.bitwise_count((ya[x] ^ yb[y]).view(np.uint64)) <= both) & (np.minimum(na[x], nb[y]) >= least * np.maximum(na[x], nb[y]) - 1e-9) & (ca[x] != cb[y])
                    if same:
                        ok &= x < y
                    i.append(x[ok]), j.append(y[ok])
                i, j = np.concatenate(i), np.concatenate(j)
                if len(i) and every:
                    src.append(ka[i]), dst.append(kb[j])
                elif len(i):
                    keys = ka if same else np.concatenate([ka, kb])
                    lab = stars(len(keys), i, j if same else j + len(ka))
                    on = np.nonzero(lab != np.arange(len(keys)))[0]
                    src.append(keys[on]), dst.append(keys[lab[on]])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    return arrow_rows(pairs).mapInArrow(run, "src long, dst long")


def confirmed(found: DataFrame, names: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The edges (src, dst) whose texts (digest, body), named by names (key, digest), have a shingle similarity of
    least or more, exactly."""
    edges = table(found.distinct())
    ends = edges.select(F.col("src").alias("key")).unionByName(edges.select(F.col("dst").alias("key"))).distinct()
    own = table(texts.join(names.join(ends, "key", "left_semi"), "digest").select("key", "body"))
    a, b = (own.select(F.col("key").alias(k), F.col("body").alias(v)) for k, v in (("src", "a"), ("dst", "b")))

    def run(batches):
        known: dict = {}
        for batch in batches:
            src, dst = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for pair in zip(src, dst, batch.column(2), batch.column(3)):
                for key, body in zip(pair[:2], pair[2:]):
                    if key not in known:
                        if len(known) > 500:
                            known.clear()
                        known[key] = shingles(body.as_py(), width)
                x, y = (known[k] if k in known else shingles(v.as_py(), width) for k, v in zip(pair[:2], pair[2:]))
                ok.append(alike(x, y) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    return table(arrow_rows(edges.join(a, "src").join(b, "dst").select("src", "dst", "a", "b")).mapInArrow(run, "src long, dst long"))


def similar(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = 22, both: int = 38) -> DataFrame:
    """(doc_id, component_id) by links of texts with a word-shingle Jaccard similarity of least or more.

    Candidates are 128-bit fingerprints of the distinct shingles within both bits, and within radius of the first
    64; at similarity 0.8 about 10 and 20 bits differ. Every link is then checked on the shingles themselves. First
    the stars of each tile pair are checked, then all candidates that these left in different components.
    Null and blank texts are alike; null ids take part but are no component's name."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("body"))

    def run(batches):
        for b in batches:
            got = [sketch(x, width) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([g[k] for g in got], pa.int64()) for k in range(3)]], ["doc_id", "digest", "n", "f0", "f1"])

    rows = table(arrow_rows(keyed).mapInArrow(run, "doc_id long, digest binary, n long, f0 long, f1 long"))
    # equal texts (by SHA-256) are one node, numbered once in the written table
    own = table(rows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("f0").alias("f0"), F.first("f1").alias("f1")).withColumn("key", F.monotonically_increasing_id()))
    names, nodes = own.select("key", "digest"), own.select("key", "n", "f0", "f1")
    texts = keyed.groupBy("digest").agg(F.first("body").alias("body"))
    near = confirmed(candidates(nodes.withColumn("comp", F.col("key")), least, radius, both, False), names, texts, width, least)
    parts = nodes.join(components(near), F.col("key") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "key")).drop("node", "root")
    rest = confirmed(candidates(parts, least, radius, both, True), names, texts, width, least)
    classes = own.select("digest", "low", "key").join(components(near.unionByName(rest)), F.col("key") == F.col("node"), "left").select("digest", "low", F.coalesce("root", "key").alias("root"))
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.select("doc_id", "digest").join(classes.join(lows, "root").select("digest", "component_id"), "digest").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those whose component (see similar) has a smaller doc_id; of rows with that same id, one stays.

    Rows with a null id stay."""
    found = similar(docs).where("component_id < doc_id").select(F.col("doc_id").alias("id"), F.lit(True).alias("gone")).distinct()
    rank, told, gone = (fresh(docs, c) for c in ("rank_in_id", "told_id", "told_gone"))
    named, own = docs.where("doc_id is not null"), F.col("doc_id").cast("long").alias("id")
    again = named.groupBy(own).count().where("count > 1").select("id", F.lit(False).alias("gone"))
    ids = table(found.unionByName(again).groupBy("id").agg(F.max("gone").alias("gone")))
    # both branches read one exchange of the documents
    left = named.join(ids.select(F.col("id").alias(told), F.col("gone").alias(gone)), named.doc_id.cast("long") == F.col(told), "left")
    once, many = left.where(F.col(gone).isNull()).select(*docs.columns), left.where(~F.col(gone)).select(*docs.columns)
    w = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    first = many.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)
    return once.unionByName(first).unionByName(docs.where("doc_id is null"))
