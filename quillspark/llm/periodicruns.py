"""Periodic runs of words: stretches that repeat a block of words three times or more.

A run of smallest period p is at least L = max(24, 3 p) words long, so of every L - p consecutive places x one
has both x and x + p inside the run: a grid of that step, a harmonic sum over all periods, meets every run.
All (period, grid point) pairs of a batch of documents are tested together: where the two words are equal,
binary search over prefix hashes finds by how much they can be extended to both sides, in one numpy step
for all pairs. Stretches are deduplicated, the smallest period of each stays, and the words themselves are
compared; where a hash has lied, that document's pairs are extended word by word. Pairs are dealt with a
bounded number at a time, so memory follows one document's words, not its pairs.

Rows are judged one by one, without any exchange. Null text has no words; a null doc_id is never rewritten
(see `planted`); repeated rows have the same result; extra columns are left out."""

from __future__ import annotations

import hashlib
import zlib
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
LEAST, TIMES = 24, 3  # words, and periods, that a run has at least
MODULI = (2147483629, 2147483587)  # two primes below 2^31: products fit 64 bits
BASES = (1000003, 998244341)
PAIRS = 1 << 20  # that are tested together


class Prefixes:
    """Polynomial hashes of the stretches of a sequence of small numbers."""

    def __init__(self, ids: np.ndarray):
        self.sums, self.powers = [], []
        for m, base in zip(MODULI, BASES):
            power = np.ones(len(ids) + 1, np.uint64)
            n = 1
            while n < len(power):  # doubling
                some = power[: min(n, len(power) - n)]
                power[n : n + len(some)] = some * np.uint64(pow(base, n, m)) % np.uint64(m)
                n *= 2
            value = (ids.astype(np.uint64) * np.uint64(2654435761) + np.uint64(12345)) % np.uint64(m)
            total = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(value * power[:-1] % np.uint64(m), out=total[1:])  # fewer than 2^33 terms below 2^31
            self.sums.append(total % np.uint64(m))
            self.powers.append(power)

    def equal(self, a: np.ndarray, gap: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a on have the hash of those from a + gap on."""
        out = np.ones(len(a), bool)
        for m, total, power in zip(MODULI, self.sums, self.powers):
            m, b = np.uint64(m), a + gap
            own, other = (total[a + n] + m - total[a]) % m, (total[b + n] + m - total[b]) % m
            out &= own * power[gap] % m == other
        return out

    def extensions(self, x: np.ndarray, p: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
        """By how many words, room at most, the stretches at x and x + p are equal: from there on, or before."""
        low, high = np.zeros(len(x), np.int64), room.copy()
        while (on := low < high).any():
            mid = (low + high + 1) >> 1
            ok = self.equal(x - mid if back else x, p, mid)
            low = np.where(on & ok, mid, low)
            high = np.where(on & ~ok, mid - 1, high)
        return low


def pairs(sizes: np.ndarray, first: np.ndarray):
    """(document, period, grid point) of all documents, PAIRS or one period of one document at a time."""
    doc, low = 0, 1
    most = sizes // TIMES
    periods = lambda d, lo, hi: (np.repeat(d, np.maximum(hi - lo + 1, 0)), np.concatenate([np.arange(a, b + 1) for a, b in zip(lo.tolist(), hi.tolist())] or [np.empty(0, np.int64)]))
    weight = np.where(most > 0, sizes * (1 + np.log(np.maximum(most, 1)) / 2), 0)  # about the pairs of each
    while doc < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(weight[doc:]), PAIRS, "right")))
        if n == 1:
            while low <= most[doc]:
                high, count = low, sizes[doc] // max(LEAST - low, 2 * low) + 1
                while high < most[doc] and count < PAIRS:
                    high += 1
                    count += sizes[doc] // max(LEAST - high, (TIMES - 1) * high) + 1
                yield points(*periods(np.array([doc]), np.array([low]), np.array([high])), sizes, first)
                low = high + 1
            low = 1
        else:
            own = np.arange(doc, min(doc + n, len(sizes)))
            yield points(*periods(own, np.ones(len(own), np.int64), most[own]), sizes, first)
        doc += n


def points(doc: np.ndarray, p: np.ndarray, sizes: np.ndarray, first: np.ndarray):
    """The grid points of each (document, period): places x with x + p in the document."""
    step = np.maximum(LEAST - p, (TIMES - 1) * p)
    n = -(-np.maximum(sizes[doc] - p, 0) // step)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc, p = np.repeat(doc, n), np.repeat(p, n)
    return doc, p, first[doc] + at * np.repeat(step, n)


def distinct(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period, document): of each stretch that with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    keep = np.ones(len(runs), bool)
    keep[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[keep]


def by_words(ids: np.ndarray, x: np.ndarray, p: np.ndarray, low: int, high: int) -> np.ndarray:
    """The stretches of pairs of one document, extended by comparing words."""
    out = []
    for a, q in zip(x.tolist(), p.tolist()):
        same = ids[low : high - q] == ids[low + q : high]
        before, after = np.nonzero(~same[: a - low])[0], np.nonzero(~same[a - low :])[0]
        start = low + (int(before[-1]) + 1 if len(before) else 0)
        end = (a + int(after[0]) if len(after) else high - q) + q
        if end - start >= max(LEAST, TIMES * q):
            out.append((start, end, q))
    return np.array(out, np.int64).reshape(-1, 3)


def find(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All runs of documents whose words stand one after another: rows (start, end, period, document), in order."""
    first = np.cumsum(sizes) - sizes
    hashes, found = None, np.empty((0, 4), np.int64)
    for doc, p, x in pairs(sizes, first):
        same = ids[x] == ids[x + p]
        doc, p, x = doc[same], p[same], x[same]
        if not len(x):
            continue
        hashes = hashes or Prefixes(ids)
        ends = first[doc] + sizes[doc]
        start = x - hashes.extensions(x, p, x - first[doc], True)
        end = x + p + hashes.extensions(x, p, ends - x - p, False)
        long = end - start >= np.maximum(LEAST, TIMES * p)
        found = distinct(np.concatenate([found, np.stack([start, end, p, doc], axis=1)[long]]))
    lied = set()
    for start, end, p, doc in found.tolist():
        if not (ids[start : end - p] == ids[start + p : end]).all() or (start > first[doc] and ids[start - 1] == ids[start - 1 + p]) or (end < first[doc] + sizes[doc] and ids[end] == ids[end - p]):
            lied.add(doc)
    for d in lied:
        own = sizes[d : d + 1], first[d : d + 1]
        exact = [np.empty((0, 4), np.int64)]
        for _, p, x in pairs(*own):
            same = ids[x] == ids[x + p]
            got = by_words(ids, x[same], p[same], int(first[d]), int(first[d] + sizes[d]))
            exact.append(np.column_stack([got, np.full(len(got), d)]))
        found = distinct(np.concatenate([found[found[:, 3] != d], *exact]))
    return found


def planted(words: list, doc_id: int | None) -> list:
    """The contract's rewriting of every tenth document, told by the checksum of its id: from a place on, the words
    repeat a block."""
    if doc_id is None or not words:
        return words
    g, digit = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if digit:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(len(words) - a)]


def better(r: tuple, s: tuple) -> int:
    """Below zero if run r (start, length, period) comes before s: greatest exponent, then smallest start and period."""
    return (s[1] * r[2] - r[1] * s[2]) or (r[0] - s[0]) or (r[2] - s[2])


def judged(docs: list[list]) -> list[tuple]:
    """(runs as (start, length, period), whether each word stays) of each document's words."""
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for words in docs for w in words), np.int64, sum(map(len, docs)))
    sizes = np.array([len(w) for w in docs], np.int64)
    first = np.cumsum(sizes) - sizes
    found = find(ids, sizes)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 1], -1)
    stays = np.cumsum(cover)[:-1] == 0
    order = np.argsort(found[:, 3], kind="stable")
    found, cut = found[order], np.searchsorted(found[order, 3], np.arange(len(docs) + 1))
    out = []
    for k, at in enumerate(first.tolist()):
        runs = [(s - at, e - s, p) for s, e, p, _ in found[cut[k] : cut[k + 1]].tolist()]
        out.append((sorted(runs, key=lambda r: (r[0], r[2])), stays[at : at + sizes[k]]))
    return out


def runs(docs: DataFrame, rewritten: bool = True, words: int = 400_000) -> DataFrame:
    """A row for each document (doc_id, text): its runs in number, the run of greatest exponent (nulls without one), and
    digests of all runs and of the text with every repetition after a run's first period dropped.

    rewritten: the contract's rewriting comes first. words: how many go together, or one document."""
    def told(batches):
        for batch in batches:
            ids, rows, some, size = batch.column("doc_id").to_pylist(), [], [], 0
            for k, text in enumerate(batch.column("body")):
                own = text.as_buffer().to_pybytes().split() if text.is_valid else []
                some.append(planted(own, ids[k]) if rewritten else own)
                size += len(own)
                if size >= words or k == len(ids) - 1:
                    for w, (found, stays) in zip(some, judged(some)):
                        s, n, p = min(found, key=cmp_to_key(better)) if found else (None,) * 3
                        text_ = b" ".join(w if stays.all() else [x for x, stay in zip(w, stays.tolist()) if stay])
                        rows.append((len(found), s, n, p, None if s is None else 1000 * n // p, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(), hashlib.sha256(text_).hexdigest()))
                    some, size = [], 0
            if rows:
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                columns = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    return arrow_rows(x).mapInArrow(told, SCHEMA)
