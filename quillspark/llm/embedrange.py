"""Embedding near-dedup by an exact metric range join.

Unit vectors of one label within Euclidean distance r = sqrt(2 - 2 c) have cosine c or more. Pivots
part a label's vectors; a vector is in the cell of its nearest pivot, and is copied to every cell whose
bisecting hyperplane is within r and whose radius plus r reaches it, which the triangle inequality
shows to lose no pair. Cells are cut into tiles of bounded bytes and join independently. A label's
number of cells is the one that promises the least comparing with at most COPIES copies of a vector,
told from sampled vectors; where none does, as with vectors spread evenly in many dimensions, the label
is one cell by the same code.

Within and between tiles, pivots tell pairs apart too. What lies in the span of some pivots, and how long the
rest is, bounds a cosine from above (the triangle inequality for the rests), so pairs whose bound is below the limit
are skipped, and the others are compared in double precision. Tiles move in runs: each task holds RUN tiles
of a cell, and the cell's others pass by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, components, stars, table

TILE_BYTES, PIVOTS, COPIES, PROBES = 2 << 20, 64, 4.0, 4
RUN, SPAN, SLACK, DENSE = 16, 16, 1e-5, 0.1
KEYS = ["label", "size", "cell"]
PIECE = "label string, size int, cell int, ids binary, ns binary, homes binary, vs binary"


def matrix(blob: bytes, size: int, kind) -> np.ndarray:
    """The vectors as doubles; those of very large or small components are scaled, which keeps their cosines."""
    x = np.frombuffer(blob, kind).reshape(-1, size // np.dtype(kind).itemsize).astype(np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)
    return np.where((big > 1e100) | (big < 1e-100), x / big, x)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def distinct(units: np.ndarray) -> np.ndarray:
    """The unit vectors without those parallel to an earlier one, whose cells rounding would part."""
    kept: list = []
    for u in units:
        if all(np.linalg.norm(u - p) > 1e-6 for p in kept):
            kept.append(u)
    return np.array(kept)


def dealt(u: np.ndarray, p: np.ndarray, reach: float, radii=None):
    """(distance to the nearest pivot, its cell, whether each vector goes to each cell)."""
    d = np.maximum(2 - 2 * u @ p.T, 0)
    home = d.argmin(axis=1)
    near = d[np.arange(len(u)), home]
    apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
    to = (d - near[:, None]) / np.maximum(2 * apart[home], 1e-12) <= reach
    if radii is not None:
        to &= np.sqrt(d) <= radii[None, :] + reach
    to[np.arange(len(u)), home] = True
    return np.sqrt(near), home, to


def chosen(heads: list[bytes], size: int, kind, reach: float) -> np.ndarray:
    """The pivots of a label: as many of the tiles' first vectors as compare least, by the other sampled vectors."""
    sample = [unit(matrix(h, size, kind)) for h in heads]
    units, probes = distinct(np.array([s[0] for s in sample])), np.concatenate([s[1:] for s in sample])
    best, least, k = 1, 1.0, 2
    while k <= len(units) and len(probes):
        copies = dealt(probes, units[:k], reach)[2].sum(axis=1).mean()
        if copies <= COPIES and copies * copies / k < least:  # what a cell of n copies / k vectors compares, over k cells
            best, least = k, copies * copies / k
        k *= 2
    return units[:best]


def shadows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For two matrices of unit vectors, rows whose products are no less than the cosines: coordinates in the span of
    at most SPAN pivots (vectors of the first, a quarter of the dimensions at most), and the length of what is left."""
    n = min(SPAN, max(1, a.shape[1] // 4), len(a))
    span = np.linalg.qr(a[np.linspace(0, len(a) - 1, n).astype(int)].T)[0]

    def shadow(x):
        c = x @ span
        return np.column_stack([c, np.sqrt(np.maximum(1 - (c * c).sum(axis=1), 0))]).astype(np.float32)

    return shadow(a), shadow(b)


def hits(a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j) of the rows of a and b with that cosine or more, and how many pairs had to be compared for it. A block
    in which many pairs are left, as among copies, is compared as one product."""
    ua, ub, i, j, compared = unit(a), unit(b), [], [], 0
    sa, sb = shadows(ua, ub)
    la, lb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    for s in range(0, len(a), 256):
        left = sa[s : s + 256] @ sb.T >= cosine - SLACK
        n = int(np.count_nonzero(left))
        if n > DENSE * left.size:
            n = left.size
            x, y = np.nonzero(a[s : s + 256] @ b.T / (la[s : s + 256, None] * lb[None, :]) >= cosine)
        else:
            x, y = np.nonzero(left)
            on = np.einsum("ij,ij->i", a[x + s], b[y]) / (la[x + s] * lb[y]) >= cosine
            x, y = x[on], y[on]
        compared += n
        i.append(x + s), j.append(y)
    return np.concatenate(i), np.concatenate(j), compared


def packed(pieces: DataFrame, room: int) -> DataFrame:
    """Pieces (see PIECE) joined to tiles of about room bytes. The exchange is by ranges, so a hot label has
    many tasks, and a task holds one tile at a time."""
    def run(batches):
        key, parts, held = None, [], 0

        def tile():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, *(b"".join(c) for c in zip(*parts))), (pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 4))], [c.split()[0] for c in PIECE.split(", ")])

        for b in batches:
            for *new, ids, ns, homes, vs in zip(*(c.to_pylist() for c in b.columns[1:])):
                if parts and (new != key or held + len(vs) > room):
                    yield tile()
                    parts, held = [], 0
                key, held = new, held + len(vs)
                parts.append((ids, ns, homes, vs))
        if parts:
            yield tile()

    ranged = pieces.repartitionByRange(*KEYS, "first").sortWithinPartitions(*KEYS, "first").select("first", *[c.split()[0] for c in PIECE.split(", ")])
    return table(arrow_rows(ranged).mapInArrow(run, PIECE).withColumn("t", F.monotonically_increasing_id()))


def link(vectors: DataFrame, cosine: float = 0.98, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id, embedding, label).

    Vectors that are null, empty, zero or hold null or non-finite components, or that have no label,
    link with nothing. Vectors of different lengths are apart. Equal vectors (verified, not hashed) are
    joined once as a class with its count. A null vec_id counts as a link but names no component.
    Nothing is broadcast: at most PIVOTS pivots of a label travel with its tiles."""
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-7

    def blobs(batches):
        for b in batches:
            out = []
            for label, e in zip(b.column(1).to_pylist(), b.column(2)):
                x = None
                if label is not None and e.is_valid and len(e.values) and not e.values.null_count:
                    x = e.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no negative zeros
                    x = x.tobytes() if np.isfinite(x).all() and x.any() else None
                out.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "v"])

    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if kind is np.float32 else "array<double>").alias("embedding"))
    rows = table(arrow_rows(given).mapInArrow(blobs, "vec_id long, label string, v binary"))
    ok = F.col("v").isNotNull()
    classes = table(rows.where(ok).groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))

    def single(batches):
        """Classes as pieces, one for each batch of a label and length."""
        for b in batches:
            where: dict = {}
            for k, (label, v) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                where.setdefault((label, len(v)), []).append(k)
            ids, ns, vs = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_pylist()
            out = [(label, size, 0, ids[on].tobytes(), ns[on].tobytes(), b"\1" * len(on), b"".join(vs[k] for k in on), int(ids[on[0]])) for (label, size), on in where.items()]
            yield pieces_of(out)

    def pieces_of(out):
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 8, kinds)], [*[c.split()[0] for c in PIECE.split(", ")], "first"])

    whole = packed(arrow_rows(classes.select("id", "n", "label", "v")).mapInArrow(single, PIECE + ", first long"), tile_bytes)
    # one sampled tile for each of PIVOTS hashes at most, whatever the label's size
    heads = whole.select("label", "size", F.pmod(F.xxhash64("t"), F.lit(PIVOTS)).alias("h"), "t", F.expr(f"substring(vs, 1, {PROBES} * size)").alias("head")).groupBy("label", "size", "h").agg(F.min_by("head", "t").alias("head"))
    heads = heads.groupBy("label", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "head"))), lambda x: x["head"]).alias("heads"))
    # chosen once for each label, so that all of its tiles have the same pivots
    def choose(batches):
        for b in batches:
            got = [chosen(h, size, kind, reach).astype(np.float64).tobytes() for size, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], ["label", "size", "pivots"])

    pivots = table(arrow_rows(heads).mapInArrow(choose, "label string, size int, pivots binary"))

    def placed(b, r, radii=None):
        p = np.frombuffer(b["pivots"][r].as_py(), np.float64)
        size = b["size"][r].as_py()
        p = p.reshape(-1, size // np.dtype(kind).itemsize)
        return dealt(unit(matrix(b["vs"][r].as_py(), size, kind)), p, reach, radii)

    def reaches(batches):
        for b in batches:
            out = []
            for r in range(b.num_rows):
                far, home, to = placed(b, r)
                most = np.full(to.shape[1], -1.0)
                np.maximum.at(most, home, far)
                out += [(b["label"][r].as_py(), b["size"][r].as_py(), k, float(x)) for k, x in enumerate(most)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.string(), pa.int32(), pa.int32(), pa.float64()))], ["label", "size", "cell", "radius"])

    near = whole.join(pivots, ["label", "size"])
    radii = arrow_rows(near).mapInArrow(reaches, "label string, size int, cell int, radius double").groupBy("label", "size", "cell").agg(F.max("radius").alias("radius"))
    radii = radii.groupBy("label", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "radius"))), lambda x: x["radius"]).alias("radii"))

    def deal(batches):
        for b in batches:
            out = []
            for r in range(b.num_rows):
                label, size = b["label"][r].as_py(), b["size"][r].as_py()
                _, home, to = placed(b, r, np.array(b["radii"][r].as_py()))
                ids, ns, vs = np.frombuffer(b["ids"][r].as_py(), np.int64), np.frombuffer(b["ns"][r].as_py(), np.int64), np.frombuffer(b["vs"][r].as_py(), f"V{size}")
                for c in range(to.shape[1]):
                    on = np.nonzero(to[:, c])[0]
                    if len(on):
                        out.append((label, size, c, ids[on].tobytes(), ns[on].tobytes(), (home[on] == c).astype(np.uint8).tobytes(), vs[on].tobytes(), int(ids[on[0]])))
            yield pieces_of(out)

    tiles = packed(arrow_rows(near.join(radii, ["label", "size"])).mapInArrow(deal, PIECE + ", first long"), tile_bytes)
    # one row for each cell; a task holds the run, and the join streams the others past it
    salts = table(tiles.groupBy(*KEYS).agg(F.ceil(F.count("*") / RUN).cast("int").alias("salts")))
    side = lambda s, salt: tiles.join(salts, KEYS).select(*KEYS, salt.alias("salt"), F.col("t").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "ns", "homes", "vs")])
    runs, others = side("t", F.pmod(F.xxhash64("t"), F.col("salts"))), side("u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    pairs = others.join(runs, [*KEYS, "salt"]).where("t <= u").select("t", "u", "size", *[f"{c}_{s}" for s in "tu" for c in ("ids", "ns", "homes", "vs")])

    def compare(batches):
        """Links between two tiles of a cell that one vector at least is at home in: counts for each at home, and stars."""
        for b in batches:
            src, dst, n = [], [], []
            for r in range(b.num_rows):
                own, size = b["t"][r] == b["u"][r], b["size"][r].as_py()
                (ia, na, ha, va), (ib, nb, hb, vb) = ((np.frombuffer(b[f"ids_{s}"][r].as_py(), np.int64), np.frombuffer(b[f"ns_{s}"][r].as_py(), np.int64), np.frombuffer(b[f"homes_{s}"][r].as_py(), bool), matrix(b[f"vs_{s}"][r].as_py(), size, kind)) for s in "tu")
                i, j, _ = hits(va, vb, cosine)
                on = (ha[i] | hb[j]) & (ia[i] != ib[j])
                i, j = i[on], j[on]
                if not len(i):
                    continue
                both = ia if own else np.concatenate([ia, ib])
                lab = stars(len(both), i, j if own else j + len(ia))
                on = np.nonzero(lab != np.arange(len(both)))[0]
                src.append(both[on]), dst.append(both[lab[on]]), n.append(np.zeros(len(on), np.int64))
                for ids, home, at, far in [(ia, ha, i, nb[j])] + ([] if own else [(ib, hb, j, na[i])]):
                    got = np.bincount(at, far, minlength=len(ids)).astype(np.int64)
                    hit = np.nonzero(home & (got > 0))[0]
                    src.append(ids[hit]), dst.append(ids[hit]), n.append(got[hit])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (src, dst, n)], ["src", "dst", "n"])

    found = table(arrow_rows(pairs).mapInArrow(compare, "src long, dst long, n long"))
    roots = components(found.where("n = 0").select("src", "dst"))
    links = found.where("n > 0").groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("far"))
    known = classes.select("label", "v", "id", "low", "n").join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    lows = known.groupBy("root").agg(F.min("low").alias("component"))
    known = known.join(lows, "root").select("label", "v", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).cast("long").alias("n_links"), "component")
    fine = rows.where(ok).join(known, ["label", "v"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    rest = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fine.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
