"""Suffix-array dedup: bytes covered by a string of 50 that also starts in a document with a smaller id.

Every 50-byte string holds an anchor, the least hash of its 20-byte substrings (all ties count), so
equal strings meet at equal anchors. Anchors seen in two documents are sorted: the suffixes that
begin there and the reversed prefixes that end there, each by a mergesort whose comparisons find the
common extension by binary search on prefix polynomial hashes. Neighbours' common lengths give the
classes of equal strings at every depth, and each string is judged against its class's smallest id.
Equal hashes are verified on the bytes, so a collision can't remove anything."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, packed, planes, unpacked, unplaned

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LAST = (1 << 63) - 1  # stands for a null id: after all others


def powers(n: int, base=BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def sliding(a: np.ndarray, width: int, least) -> np.ndarray:
    """least over each run of width entries."""
    have = 1
    while 2 * have <= width:
        a, have = least(a[:-have], a[have:]), 2 * have
    return least(a[: len(a) - (width - have)], a[width - have :]) if width > have else a


def mixed(g: np.ndarray) -> np.ndarray:
    g = (g ^ (g >> np.uint64(31))) * BASE
    return g ^ (g >> np.uint64(33))


def hashes(text: np.ndarray) -> np.ndarray:
    """The hash of the anchor in each row of bytes around it; equals what anchors gives."""
    p = powers(GRAM)
    g = np.zeros(len(text), np.uint64)
    for k in range(GRAM):
        g += (text[:, REACH + k].astype(np.uint64) + np.uint64(1)) * p[k]
    return mixed(g)


def anchors(buf: np.ndarray, ends: np.ndarray):
    """(position, hash) of the anchors in texts joined one after another; ends: where each text ends."""
    width = REACH + 1
    n = len(buf) - GRAM + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p = powers(len(buf))
    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p, dtype=np.uint64)])
    g = mixed((h[GRAM:] - h[:-GRAM]) * powers(n, INVERSE))
    over = np.zeros(n + GRAM, bool)
    for k in range(1, GRAM):
        at = ends - k
        over[at[(at >= 0) & (at < n)]] = True
    g[over[:n]] = np.iinfo(np.uint64).max
    low = sliding(g, width, np.minimum)
    most = sliding(np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    at = np.nonzero((g == most[:n]) & ~over[:n])[0]
    return at, g[at]


class Suffixes:
    """Strings of bounded length in the rows of a matrix, with prefix hashes for common extensions."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray):
        self.rows, self.sizes = rows, sizes.astype(np.int64)
        p = powers(rows.shape[1])
        self.h = np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * p, axis=1, dtype=np.uint64)], axis=1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix, by binary search, verified on the bytes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.sizes[a], self.sizes[b])
        most = high.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.h[a, mid] == self.h[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return np.minimum(low, most)

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        wrong = (self.rows[a] != self.rows[b]) & (np.arange(self.rows.shape[1]) < n[:, None])
        bad = wrong.any(axis=1)
        return np.where(bad, wrong.argmax(axis=1), n)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        wide = self.rows.shape[1] - 1
        x = np.where(n < self.sizes[a], self.rows[a, np.minimum(n, wide)].astype(np.int64), -1)
        y = np.where(n < self.sizes[b], self.rows[b, np.minimum(n, wide)].astype(np.int64), -1)
        return x < y

    def sort(self, group: np.ndarray) -> np.ndarray:
        """By group, and within each by a bottom-up mergesort; all merges of a level run together, each by
        ranks in the other half. A group that is one run has no more part in it."""
        order = np.argsort(group, kind="stable")
        _, first, many = np.unique(group[order], return_index=True, return_counts=True)
        begin, end = np.repeat(first, many), np.repeat(first + many, many)
        run = 1
        while (pos := np.nonzero(end - begin > run)[0]).size:
            a, e = begin[pos], end[pos]
            block = a + (pos - a) // (2 * run) * (2 * run)
            left = pos - block < run
            mid = np.minimum(block + run, e)
            low = np.where(left, mid, block)
            high = np.where(left, np.minimum(block + 2 * run, e), mid)
            start = low.copy()
            while (on := np.nonzero(low < high)[0]).size:
                m = (low[on] + high[on]) // 2
                mine, other = order[pos[on]], order[m]
                ahead = np.zeros(len(on), bool)
                le = left[on]
                ahead[le] = self.less(other[le], mine[le])
                ahead[~le] = ~self.less(mine[~le], other[~le])
                low[on] = np.where(ahead, m + 1, low[on])
                high[on] = np.where(ahead, high[on], m)
            new = order.copy()
            new[block + (pos - np.where(left, block, mid)) + (low - start)] = order[pos]
            order, run = new, 2 * run
        return order


def judged(low: np.ndarray, group: np.ndarray, back: Suffixes, front: Suffixes) -> np.ndarray:
    """For each class of equal contexts and each o the smallest doc that holds the string starting o bytes
    before its anchor (the greatest number where there is none); low: the class's smallest doc. group: by the
    anchor's hash; equal strings have equal anchors, so only those are sorted together."""
    n = len(low)
    best = np.full((n, REACH + 1), np.iinfo(np.int64).max)
    if not n:
        return best
    ranks = []
    for s in (back, front):
        order = s.sort(group)
        lcp = np.where(group[order[:-1]] == group[order[1:]], s.verified(order[:-1], order[1:]), -1)
        ranks.append((order, lcp))

    def classes(k: int, depth: int) -> np.ndarray:
        order, lcp = ranks[k]
        out = np.empty(n, np.int64)
        out[order] = np.concatenate([[0], np.cumsum(lcp < depth)])
        return out

    for o in range(REACH + 1):
        on = np.nonzero((back.sizes >= o) & (front.sizes >= LENGTH - o))[0]
        if len(on):
            _, inv = np.unique(classes(0, o)[on] * n + classes(1, LENGTH - o)[on], return_inverse=True)
            least = np.full(inv.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, inv, low[on])
            best[on, o] = least[inv]
    return best


def covered(n: int, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for o in range(REACH + 1):
        p = at[(mask >> o) & 1 == 1] - o
        np.add.at(edge, p, 1)
        np.add.at(edge, p + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def split(key: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """The places of each value of key, which is below n."""
    order = np.argsort(key, kind="stable")
    cut = np.searchsorted(key[order], np.arange(n + 1, dtype=key.dtype))
    return [(k, order[cut[k] : cut[k + 1]]) for k in np.nonzero(cut[1:] > cut[:-1])[0].tolist()]


def dedup(docs: DataFrame, bucket_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) for every row.

    Null text is empty; a null id counts as larger than all others; rows with equal ids don't remove
    from each other; texts under 50 bytes stay whole. A document is told by its id and a hash of its
    text. Anchors are dealt by their hash into a bucket for each bucket_bytes of text, so that a task's
    memory doesn't grow with the input, but for an anchor that very many documents share: all its
    contexts meet in one bucket. What a bucket finds is dealt by document into as many parts, so that it
    has a row for each part and not for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    # the mark's last bit tells a null id, so that the exchange of texts has the same columns for both of its uses
    rows = rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.shiftleft(F.xxhash64("body"), 1).bitwiseOR(F.col("doc_id").isNull().cast("long")).alias("mark"), "body")

    size = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    part_of = lambda doc, mark: ((doc.view(np.uint64) * BASE ^ mark.view(np.uint64)) * BASE >> np.uint64(33)) % np.uint64(buckets)

    def find(batches):
        for b in batches:
            bodies = b.column(2).to_pylist()
            name = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            for k in range(0, len(bodies), 100):
                part = bodies[k : k + 100]
                sizes = np.array([len(x) for x in part])
                ends = np.cumsum(sizes)
                at, h = anchors(np.frombuffer(b"".join(part), np.uint8), ends)
                who = np.searchsorted(ends, at, side="right")
                on = sizes[who] >= LENGTH
                at, h, who = at[on], h[on], who[on]
                at = (at - (ends - sizes)[who]).astype(np.uint32)
                put, named, blobs = [], [], []
                for x, i in split((h >> np.uint64(40)) % np.uint64(buckets), buckets):
                    new = np.concatenate([[True], who[i[1:]] != who[i[:-1]]])  # who ascends within a bucket
                    put.append(x), named.append(name[k + who[i[new]]].tobytes())
                    # the bucket tells some upper bits; what 32 others confuse is parted by the bytes later
                    blobs.append(h[i].astype(np.uint32).tobytes() + planes(at[i]) + (np.cumsum(new) - 1).astype(np.uint8).tobytes())
                if put:
                    yield pa.RecordBatch.from_arrays([pa.array(put, pa.int32()), pa.array(named, pa.binary()), pa.array([packed(x) for x in blobs], pa.binary())], ["bucket", "docs", "blob"])

    def by_part(doc, mark, *cols):
        """Rows (part, blob) of what was found, in the order of documents; the numbers in planes, compressed."""
        parts = split(part_of(doc, mark), buckets)
        blobs = []
        for _, i in parts:
            i = i[np.lexsort((cols[0][i], mark[i], doc[i]))]
            blobs.append(packed(planes(doc[i]) + planes(mark[i]) + b"".join(planes(c[i]) for c in cols)))
        return pa.table({"part": pa.array([k for k, _ in parts], pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def joined(kinds, name):
        """Rows (doc, mark, name) from those of by_part."""
        def run(key, t):
            cols: list[list] = [[] for _ in range(2 + len(kinds))]
            for x in map(unpacked, t.column("blob").to_pylist()):
                wide = 16 + sum(np.dtype(k).itemsize for k in kinds)
                n, at = len(x) // wide, 0
                for c, k in zip(cols, (np.int64, np.int64, *kinds)):
                    c.append(unplaned(x, at, n, k))
                    at += n * np.dtype(k).itemsize
            doc, mark, *rest = map(np.concatenate, cols)
            order = np.lexsort((mark, doc))
            doc, mark, rest = doc[order], mark[order], [c[order] for c in rest]
            first = np.nonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]))[0]
            cut = np.append(first, len(doc))
            return pa.table({"doc": doc[first], "mark": mark[first], name: pa.array([b"".join(c[a:b].tobytes() for c in rest) for a, b in zip(cut[:-1], cut[1:])], pa.binary())})

        return run

    def repeated(key, t):
        """The anchors whose hash is in two documents or more, by part."""
        h, at, doc, mark = [], [], [], []
        for d, x in zip(t.column("docs").to_pylist(), map(unpacked, t.column("blob").to_pylist())):
            n = len(x) // 9
            own = np.frombuffer(d, np.int64).reshape(-1, 2)[np.frombuffer(x, np.uint8, n, 8 * n)]
            h.append(np.frombuffer(x, np.uint32, n)), at.append(unplaned(x, 4 * n, n, np.uint32))
            doc.append(own[:, 0]), mark.append(own[:, 1])
        h, at, doc, mark = map(np.concatenate, (h, at, doc, mark))
        order = np.argsort(h)
        h, at, doc, mark = h[order], at[order], doc[order], mark[order]
        first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
        on = np.repeat(np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first), np.diff(np.append(first, len(h))))
        return by_part(doc[on], mark[on], at[on])

    def around(batches):
        """Each repeated anchor with the bytes around it, by bucket."""
        offs = np.arange(-REACH, LENGTH)
        for b in batches:
            docs, marks = (b.column(k).to_numpy() for k in (0, 1))
            bodies, hits = b.column(2).to_pylist(), b.column(3).to_pylist()
            ends = np.cumsum([len(x) for x in bodies])
            begins = ends - [len(x) for x in bodies]
            buf = np.frombuffer(b"".join(bodies), np.uint8)
            who = np.repeat(np.arange(len(hits)), [len(x) // 4 for x in hits])
            at = np.frombuffer(b"".join(hits), np.uint32)
            for k in range(0, len(at), 100_000):  # bounds what very long texts take
                w, a = who[k : k + 100_000], at[k : k + 100_000]
                p = (a + begins[w])[:, None] + offs
                inside = (p >= begins[w][:, None]) & (p < ends[w][:, None])
                text = buf[np.clip(p, 0, len(buf) - 1)] * inside
                bl, fl = (inside[:, c].sum(axis=1, dtype=np.uint8) for c in (slice(REACH), slice(REACH, None)))
                put, blobs = [], []
                for x, i in split((hashes(text) >> np.uint64(40)) % np.uint64(buckets), buckets):
                    put.append(x)
                    blobs.append(packed(planes(docs[w[i]]) + planes(marks[w[i]]) + planes(a[i]) + bl[i].tobytes() + fl[i].tobytes() + text[i].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(put, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def judge(key, t):
        cols: list[list] = [[] for _ in range(6)]
        wide = REACH + LENGTH
        for x in map(unpacked, t.column("blob").to_pylist()):
            n = len(x) // (22 + wide)
            for c, k, a in zip(cols, (np.int64, np.int64, np.uint32, np.uint8, np.uint8), (0, 8 * n, 16 * n, 20 * n, 21 * n)):
                c.append(unplaned(x, a, n, k))
            cols[5].append(np.frombuffer(x, np.uint8, n * wide, 22 * n).reshape(n, wide))
        doc, mark, at, bl, fl, text = map(np.concatenate, cols)
        # anchors with the same bytes around are one class, which goes through the sort once
        whole = np.ascontiguousarray(np.concatenate([text, bl[:, None], fl[:, None]], axis=1)).view(f"V{wide + 2}").ravel()
        _, first, inv = np.unique(whole, return_index=True, return_inverse=True)
        low = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(low, inv, doc)
        _, group = np.unique(hashes(text[first]), return_inverse=True)
        got = judged(low, group, Suffixes(np.ascontiguousarray(text[first, :REACH][:, ::-1]), bl[first]), Suffixes(text[first, REACH:], fl[first]))
        mask = np.zeros(len(doc), np.uint32)
        for o in range(REACH + 1):
            mask |= (got[:, o][inv] < doc).astype(np.uint32) << np.uint32(o)
        on = mask != 0
        return by_part(doc[on], mark[on], at[on], mask[on])

    def finish(batches):
        for b in batches:
            out = []
            for doc, body, spans in zip(*(c.to_pylist() for c in b.columns)):
                kept, gone, runs = body, 0, 0
                if spans:
                    n = len(spans) // 8
                    cov = covered(len(body), np.frombuffer(spans, np.uint32, n).astype(np.int64), np.frombuffer(spans, np.uint32, n, 4 * n).astype(np.int64))
                    gone, runs = int(cov.sum()), int((cov & ~np.concatenate([[False], cov[:-1]])).sum())
                    kept = np.frombuffer(body, np.uint8)[~cov].tobytes()
                out.append((doc, len(body), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = arrow_rows(rows.select("doc", "mark", "body")).mapInArrow(find, "bucket int, docs binary, blob binary")
    hits = found.groupBy("bucket").applyInArrow(repeated, "part int, blob binary").groupBy("part").applyInArrow(joined([np.uint32], "hits"), "doc long, mark long, hits binary")
    dealt = rows.repartition("doc", "mark")  # both joins read this one exchange
    near = dealt.dropDuplicates(["doc", "mark"]).join(hits, ["doc", "mark"]).select("doc", "mark", "body", "hits")
    context = arrow_rows(near).mapInArrow(around, "bucket int, blob binary")
    spans = context.groupBy("bucket").applyInArrow(judge, "part int, blob binary").groupBy("part").applyInArrow(joined([np.uint32, np.uint32], "spans"), "doc long, mark long, spans binary")
    last = dealt.join(spans, ["doc", "mark"], "left").select(F.when(F.col("mark").bitwiseAND(F.lit(1)) == 0, F.col("doc")).alias("doc_id"), "body", "spans")
    return arrow_rows(last).mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
