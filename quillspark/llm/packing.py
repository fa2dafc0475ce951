"""Packing with lexical retrieval: a BM25 inverted index in shards, each of documents that share rare terms.

Token ids are made once. Document frequencies, the number of documents and their mean length are counted
over all of them. Three weighted min-hashes of a document's terms (weights: their inverse document
frequency) name the document's place; documents are dealt by ranges of these places, so those whose
weighted terms overlap most are likely to be in one shard. There a seed document's terms query the index;
the best unused neighbours follow it until the window is full, and the piece that passes the end is cut
there and goes on in the next window. Shards hold about shard_tokens, so memory and work per task don't
grow with the input. What a seed finds is exact within its shard; the README tells the measured recall."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of whole texts. White space separates what is encoded apart, so each chunk between
    ASCII white space is encoded once and kept in a bounded cache."""

    def __init__(self, path: str, most: int = 700_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most, self.known = Tokenizer.from_file(path), most, {}
        normal = json.loads(self.tok.to_str())["normalizer"] or {}
        self.folds = any(n["type"] == "Lowercase" for n in normal.get("normalizers", [normal]) if "type" in n)
        vocab = self.tok.get_vocab()
        self.size = max(vocab.values()) + 1
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # of ids that end a word
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def __call__(self, bodies: list[bytes], end: int) -> list[np.ndarray]:
        # where the tokenizer folds case itself, the cache needs one entry for a word
        split = [b.lower().split() for b in bodies] if self.folds else [b.split() for b in bodies]
        if len(self.known) > self.most:
            self.known.clear()
        self.learn({w for s in split for w in s if w not in self.known})
        get, last = self.known.__getitem__, np.array([end], "<u4").tobytes()
        return [np.frombuffer(b"".join(map(get, s)) + last, "<u4") for s in split]


    def learn(self, new: set[bytes]) -> None:
        """Letters alone are one piece before BPE, and so is closing punctuation: such chunks are encoded
        many at a time and told apart by the ends of words; all others are encoded one by one."""
        letters, tailed, rest = set(), [], []
        for w in new:
            s = w.decode()
            if s.isalpha():
                letters.add(s)
            elif (head := s.rstrip(".,;:!?")).isalpha():
                letters.add(head)
                tailed.append((w, head.encode(), s[len(head) :].encode()))
            else:
                rest.append(w)
        rest += list({t for _, _, t in tailed if t not in self.known})
        letters = sorted(x for x in letters if x.encode() not in self.known)
        parts = [letters[k : k + 512] for k in range(0, len(letters), 512)]
        for part, e in zip(parts, self.tok.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cut = np.nonzero(self.last[ids])[0] + 1
            if len(cut) != len(part):
                rest += [x.encode() for x in part]
                continue
            raw, at = ids.tobytes(), 0
            for x, end in zip(part, (4 * cut).tolist()):
                self.known[x.encode()] = raw[at:end]
                at = end
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            for w, e in zip(part, self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()
        for w, head, tail in tailed:
            self.known[w] = self.known[head] + self.known[tail]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker process's encoder, whose cache outlives its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """The inverse document frequency of each term."""
    return np.log1p((n - df + 0.5) / (df + 0.5))


def bm25(docs: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
    """The inverted index: start of each term, documents, their scores; and each document's distinct terms."""
    length = np.array([len(d) for d in docs], float)
    terms = [np.unique(d, return_counts=True) for d in docs]
    term = np.concatenate([t for t, _ in terms]).astype(np.int64)
    tf = np.concatenate([c for _, c in terms]).astype(float)
    doc = np.repeat(np.arange(len(docs)), [len(t) for t, _ in terms])
    score = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
    order = np.argsort(term, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(term))]), doc[order], score[order], [t for t, _ in terms]


def ranked(index, d: int) -> np.ndarray:
    """The BM25 score of every document of the index for all of d's terms."""
    start, post, score, terms = index
    span = [slice(start[x], start[x + 1]) for x in terms[d]]
    return np.bincount(np.concatenate([post[s] for s in span]), np.concatenate([score[s] for s in span]), minlength=len(terms))


def fill(docs: list[np.ndarray], window: int, idf: np.ndarray, mean: float) -> list[tuple]:
    """(document, start, length, sequence, offset): seeds in the given order; every id in exactly one piece."""
    index = bm25(docs, idf, mean)
    used, at, out, seq, room = np.zeros(len(docs), bool), 0, [], 0, window
    queue: list[int] = []
    while True:
        while queue and used[queue[-1]]:
            queue.pop()
        if not queue:
            while at < len(docs) and used[at]:
                at += 1
            if at == len(docs):
                return out
            rank = ranked(index, at)
            rank[used] = 0
            rank[at] = 0
            near = np.nonzero(rank)[0]
            queue = [*near[np.argsort(-rank[near], kind="stable")][::-1].tolist(), at]
        d = queue.pop()
        used[d] = True
        done = 0
        while done < len(docs[d]):
            n = min(room, len(docs[d]) - done)
            out.append((d, done, n, seq, window - room))
            done, room = done + n, room - n
            if not room:
                seq, room, queue = seq + 1, window, queue if done < len(docs[d]) else []


def encoded(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """(doc_id, ids) of every document, and for each task a row with what it has counted: documents, ids, and
    for each term the documents that hold it."""
    def run(batches):
        enc = encoder(tokenizer)
        kind = np.uint16 if enc.size <= 1 << 16 else np.uint32
        seen, n, total = np.zeros(enc.size, np.int64), 0, 0
        for b in batches:
            for k in range(0, b.num_rows, 100):
                part = b.slice(k, 100)
                ids = enc(part.column(1).to_pylist(), end)
                held = np.zeros((len(ids), enc.size), bool)
                held[np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.concatenate(ids)] = True
                seen += held.sum(axis=0)
                n, total = n + len(ids), total + sum(map(len, ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary()), pa.nulls(len(ids), pa.binary())], ["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.concatenate([[n, total], seen]).tobytes()], pa.binary())], ["doc_id", "ids", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    return table(arrow_rows(rows).mapInArrow(run, "doc_id long, ids binary, counts binary"))


def counted(rows: DataFrame, wide: int = 4096) -> np.ndarray:
    """The sum of the tasks' counts; as long as the vocabulary, however large the input."""
    def cut(batches):
        for b in batches:
            sums = None
            for x in b.column(0).to_pylist():
                v = np.frombuffer(x, np.int64)
                sums = v.copy() if sums is None else sums + v
            if sums is not None:
                parts = [sums[k : k + wide] for k in range(0, len(sums), wide)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "sums"])

    def add(key, t):
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([np.sum([np.frombuffer(x, np.int64) for x in t.column("sums").to_pylist()], axis=0).tobytes()], pa.binary())})

    got = rows.where("counts is not null").select("counts").mapInArrow(cut, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary").orderBy("part").collect()
    return np.concatenate([np.frombuffer(r["sums"], np.int64) for r in got]) if got else np.zeros(3, np.int64)


def races(idf: np.ndarray, seeds: int = 3) -> np.ndarray:
    """For each seed a random time of each term, sooner for greater weights: the first of a document's terms is a
    weighted min-hash. Terms are hashed by a fixed rule, so every task has the same times."""
    x = np.arange(len(idf), dtype=np.uint64) + np.uint64(1)
    out = []
    for k in range(seeds):
        h = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xBF58476D1CE4E5B9 % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(-np.log(((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54) / np.maximum(idf, 1e-9))
    return np.array(out)


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end: int = 2, shard_tokens: int = 2_500_000) -> DataFrame:
    """Pieces (see SCHEMA). Null and empty texts are the end id alone; repeated rows are packed each; null ids
    stay null. Of equal scores the document first in the shard's order wins. Only a shard's last sequence is
    short of its window."""
    rows = encoded(docs, tokenizer, end)
    n, total, *df = counted(rows).tolist()
    idf, mean = weights(np.array(df, float), n), max(total, 1) / max(n, 1)
    kind = np.uint16 if len(df) <= 1 << 16 else np.uint32
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # as long as the vocabulary

    def place(batches):
        times = races(shared.value)
        for b in batches:
            got = [np.frombuffer(x, kind) for x in b.column(1).to_pylist()]
            first = [pa.array([int(x[t[x].argmin()]) for x in got], pa.int32()) for t in times]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *first], ["doc_id", "ids", "s0", "s1", "s2"])

    order = ["s0", "s1", "s2", "doc_id", "ids"]
    placed = arrow_rows(rows.where("ids is not null").select("doc_id", "ids")).mapInArrow(place, "doc_id long, ids binary, s0 int, s1 int, s2 int")
    dealt = placed.repartitionByRange(*order[:4]).sortWithinPartitions(*order).select("doc_id", "ids")

    def run(batches):
        seq, names, held, size = TaskContext.get().partitionId() << 32, [], [], 0

        def shard():
            got = [np.frombuffer(x, kind).astype("<u4") for x in held]
            pieces = fill(got, window, shared.value, mean)
            rows = [(names[d], s, n, zlib.crc32(got[d][s : s + n].tobytes()), len(got[d]), seq + q, o) for d, s, n, q, o in pieces]
            return seq + pieces[-1][3] + 1, pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows)], [c.split()[0] for c in SCHEMA.split(", ")])

        for b in batches:
            for name, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names.append(name), held.append(ids)
                size += len(ids) // np.dtype(kind).itemsize
                if size >= shard_tokens:
                    seq, out = shard()
                    yield out
                    names, held, size = [], [], 0
        if held:
            yield shard()[1]

    return arrow_rows(dealt).mapInArrow(run, SCHEMA)
