"""Token ids as bit-packed files: each id takes the fewest bits that hold the vocabulary's largest one.

A data set is a folder of shards and a manifest. A shard holds the ids of its documents one after another in
blocks of BLOCK ids; 64 ids of w bits are w whole 64-bit words, so a block is packed and unpacked by numpy
in 64 column steps, and any id can be reached by its block's offset. Behind the blocks stand their offsets,
the documents' ids and the places where their tokens begin, and a footer of fixed size. Shards follow each
other in ascending order of doc_id: documents go through one range exchange and are encoded by the tasks
that write the shards, so ids never pass through an exchange, the driver or one task. A task writes a file
under the name of its attempt; the driver's commit names the files of the attempts that count in the
manifest and adds up where each begins (one row a shard), so lost or repeated attempts leave nothing that
a reader would see.

Null text is empty (the end token alone); rows with a null doc_id come first; repeated ids follow each
other in any order. An empty table gives a data set without shards. Extra columns are left out."""

from __future__ import annotations

import json
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import arrow_rows, shared_dir

MAGIC = b"QTB1"
BLOCK = 1 << 16  # ids of a block, a multiple of 64
FOOTER = np.dtype([("index", "<u8"), ("blocks", "<u8"), ("docs", "<u8"), ("ids", "<u8"), ("width", "<u4"), ("magic", "S4")])
#: What Unicode counts as white space, as the tokenizer's pattern does.
WHITE = r"\t-\r \x85\xa0  -     　"


class ByteEncoder:
    """Ids of whole texts by a byte-level BPE, as the tokenizers library gives them.

    Its pattern never joins what stands before a single space or line feed to what follows, so Arrow cuts the
    texts there and tells equal words apart; a word is encoded once, with or without a space before it, and
    its ids are kept in a bounded pool from which numpy gathers the texts' ids. New words are encoded many at
    a time in one string and told apart by the bytes that each id stands for; punctuation that ends a word
    is one piece of its own by the pattern. Texts with other white space, or with an added token's text, are
    encoded whole by the library."""

    def __init__(self, path: str, most: int = 1_000_000, room: int = 1 << 25):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most, self.room = Tokenizer.from_file(path), most, room
        vocab = self.tok.get_vocab()
        self.size = max(vocab.values()) + 1
        self.bytes = np.zeros(self.size, np.int64)
        for token, i in vocab.items():
            self.bytes[i] = len(token)
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = "|".join([f"[{WHITE}]", *added])
        self.clear()

    def clear(self) -> None:
        self.known: tuple[dict, dict] = {}, {}  # numbers of the words with a space before them, and without
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.length, self.words = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def keep(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Puts words into the pool; the number of the first."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while self.words + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length))
        first = self.words
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[first : first + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + len(lengths)] = lengths
        self.used, self.words = self.used + len(ids), first + len(lengths)
        return first

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has."""
        n = self.length[numbers]
        at = np.repeat(self.start[numbers] - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        return self.pool[at], n

    def learn(self, words: list[str], bare: int) -> None:
        known, heads, tails, cut = self.known[bare], [], set(), []
        for w in words:
            head = w.rstrip(".,;:!?")
            if len(head) < len(w) and head.isalpha():
                cut.append((w, head, w[len(head) :]))
                if head not in known:
                    known[head] = -1
                    heads.append(head)
                tails.add(cut[-1][2])
            elif w not in known:
                known[w] = -1
                heads.append(w)
        self.encode(heads, bare)
        if tails := [t for t in tails if t not in self.known[1]]:
            self.encode(tails, 1)
        if cut:
            both = np.array([(known[h], self.known[1][t]) for _, h, t in cut])
            ids, n = self.gather(both.ravel())
            first = self.keep(ids, n.reshape(-1, 2).sum(axis=1))
            known.update((w, first + k) for k, (w, _, _) in enumerate(cut))

    def encode(self, words: list[str], bare: int) -> None:
        known = self.known[bare]
        for k in range(0, len(words), 512):
            part = words[k : k + 512]
            sizes = np.array([len(w.encode()) for w in part])
            gap = 1 if bare else 0  # a line feed between words without a space, which is a piece of its own
            text = "\n".join(part) if bare else " " + " ".join(part)
            last = np.cumsum(sizes + 1) - gap
            ids = self.whole(text)
            ends = np.cumsum(self.bytes[ids])
            at = np.searchsorted(ends, last) + 1
            begin = np.concatenate([[0], at[:-1] + gap])
            if len(ends) and ends[-1] == last[-1] and (ends[at - 1] == last).all() and (not bare or (self.bytes[ids[at[:-1]]] == 1).all()):
                n = at - begin
                inside = np.ones(len(ids), bool)
                if bare:
                    inside[at[:-1]] = False
                first = self.keep(ids[inside], n)
                known.update((w, first + j) for j, w in enumerate(part))
            else:
                for w in part:
                    ids = self.whole(w if bare else " " + w)
                    known[w] = self.keep(ids, np.array([len(ids)]))

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (one more)."""
        if len(self.known[0]) + len(self.known[1]) > self.most or self.used > self.room:
            self.clear()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \0\n "), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        found = split.flatten().dictionary_encode()
        code, distinct = found.indices.to_numpy(), found.dictionary
        odd = pc.or_(pc.equal(distinct, ""), pc.match_substring_regex(distinct, self.odd)).to_numpy(zero_copy_only=False)
        words = distinct.to_pylist()
        feed = words.index("\0\n") if "\0\n" in words else -1
        odd[feed] &= feed < 0
        bare = np.zeros(len(code), bool)
        bare[bounds[:-1]] = True
        bare[1:] |= code[:-1] == feed
        numbers = np.full((2, len(words)), -1, np.int64)
        for b in (0, 1):
            used = np.zeros(len(words), bool)
            used[code[bare == bool(b)]] = True
            used &= ~odd
            if feed >= 0:
                used[feed] = False
            own, known = np.nonzero(used)[0].tolist(), self.known[b]
            if new := [words[k] for k in own if words[k] not in known]:
                self.learn(new, b)
            numbers[b, own] = [known[words[k]] for k in own]
        if feed >= 0:
            if "\n" not in self.known[1]:
                ids = self.whole("\n")
                self.known[1]["\n"] = self.keep(ids, np.array([len(ids)]))
            numbers[:, feed] = self.known[1]["\n"]
        strange = odd[code]
        apart = np.unique(np.searchsorted(bounds, np.nonzero(strange)[0], "right") - 1) if strange.any() else []
        chosen = numbers[bare.astype(np.int8), code]
        ids, n = self.gather(np.where(strange, 0, chosen) if self.words else np.zeros(0, np.int64))
        ends = np.concatenate([[0], np.cumsum(n)]) if self.words else np.zeros(len(code) + 1, np.int64)
        at = ends[bounds]
        if not len(apart):
            return ids, at
        parts = [ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]
        for k in apart:
            parts[k] = self.whole(texts[k].as_py())
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """A worker process's encoder, whose cache outlives its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def width_of(size: int) -> int:
    """The fewest bits that hold every id below size."""
    return max(1, int(size - 1).bit_length())


def pack(ids: np.ndarray, w: int) -> bytes:
    """The ids in w bits each, from the lowest bit up; 64 of them are w words, the last ones are filled up with zeros."""
    groups = -(-len(ids) // 64)
    x = np.zeros((groups * 64,), np.uint64)
    x[: len(ids)] = ids
    x = np.ascontiguousarray(x.reshape(groups, 64).T)
    out = np.zeros((w, groups), "<u8")
    for j in range(64):
        word, shift = divmod(j * w, 64)
        out[word] |= x[j] << np.uint64(shift)
        if shift + w > 64:
            out[word + 1] |= x[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).tobytes()


def unpack(raw: bytes, w: int) -> np.ndarray:
    """The ids of whole groups of 64, as 32-bit numbers."""
    x = np.ascontiguousarray(np.frombuffer(raw, "<u8").reshape(-1, w).T)
    out, mask = np.empty((64, x.shape[1]), np.uint32), np.uint64((1 << w) - 1)
    for j in range(64):
        word, shift = divmod(j * w, 64)
        v = x[word] >> np.uint64(shift)
        if shift + w > 64:
            v |= x[word + 1] << np.uint64(64 - shift)
        out[j] = v & mask
    return np.ascontiguousarray(out.T).ravel()


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


class Shard:
    """Random access to one file."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        end = self.file.size()
        foot = np.frombuffer(self.file.read_at(FOOTER.itemsize, end - FOOTER.itemsize), FOOTER)[0]
        if foot["magic"] != MAGIC:
            raise ValueError(f"{path}: no token file")
        self.index, self.blocks, self.docs, self.ids, self.width = (int(foot[k]) for k in ("index", "blocks", "docs", "ids", "width"))
        self.offsets = self.array("<u8", self.index, self.blocks)

    def array(self, kind: str, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, at), kind)

    def documents(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id, whether it is null, and where each begins (one more), of the documents a to b - 1."""
        ids = self.index + 8 * self.blocks
        nulls = ids + 8 * self.docs
        return self.array("<i8", ids + 8 * a, b - a), self.array("u1", nulls + a, b - a), self.array("<u8", nulls + self.docs + 8 * a, b - a + 1).astype(np.int64)

    def read(self, start: int, n: int) -> np.ndarray:
        """n ids from start on; only the groups that hold them are read."""
        out, done = np.empty(n, np.uint32), 0
        while done < n:
            block, at = divmod(start + done, BLOCK)
            some = min(n - done, BLOCK - at)
            a, b = at // 64, -(-(at + some) // 64)
            got = unpack(self.file.read_at((b - a) * self.width * 8, int(self.offsets[block]) + a * self.width * 8), self.width)
            out[done : done + some] = got[at - 64 * a :][:some]
            done += some
        return out


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    docs: int
    ids: int


class BitWriter(DataSourceArrowWriter):
    """Encodes the documents (doc_id, body) of a partition, which are in order, and writes its shard."""

    def __init__(self, options: dict):
        self.path, self.tokenizer, self.end = options["path"], options["tokenizer"], int(options["end"])

    def write(self, batches):
        encode = encoder(self.tokenizer)
        width = width_of(max(encode.size, self.end + 1))
        fs, root = place(self.path)
        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}.bits"
        docs, nulls, starts, offsets, ids, held, out, at = [], [], [np.zeros(1, np.int64)], [], 0, np.empty(0, np.uint32), None, 0

        def pour(all_: bool) -> None:
            nonlocal held, at
            whole = len(held) if all_ else len(held) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                offsets.append(at)
                at += out.write(pack(held[k : min(k + BLOCK, whole)], width))
            held = held[whole:]

        def take(bodies: list[pa.Array]) -> None:
            nonlocal held, ids
            got, bounds = encode(pa.concat_arrays(bodies))
            held = np.concatenate([held, np.insert(got, bounds[1:], self.end)])
            starts.append(ids + bounds[1:] + np.arange(1, len(bounds)))
            ids = int(starts[-1][-1])
            pour(False)

        waiting, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}")
            column = batch.column("doc_id")
            docs.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            nulls.append(column.is_null().to_numpy(zero_copy_only=False).astype("u1"))
            waiting.append(batch.column("body"))
            size += batch.column("body").nbytes
            if size > 8 << 20:
                take(waiting)
                waiting, size = [], 0
        if waiting:
            take(waiting)
        if out is not None:
            pour(True)
            foot = np.zeros(1, FOOTER)
            foot["index"], foot["blocks"], foot["docs"], foot["ids"], foot["width"], foot["magic"] = at, len(offsets), sum(map(len, docs)), ids, width, MAGIC
            for part in (np.array(offsets, "<u8"), *docs, *nulls, *(x.astype("<u8") for x in starts), foot):
                out.write(part.tobytes())
            out.close()
        return Written(context.partitionId(), name, sum(map(len, docs)), ids)

    def commit(self, messages):
        fs, root = place(self.path)
        fs.create_dir(root, recursive=True)
        shards, start = [], 0
        for m in sorted((m for m in messages if m and m.docs), key=lambda m: m.part):
            shards.append([m.name, m.docs, m.ids, start])
            start += m.ids
        named = {name for name, *_ in shards}
        for f in fs.get_file_info(pafs.FileSelector(root)):  # attempts that don't count
            if f.base_name.endswith(".bits") and f.base_name not in named:
                fs.delete_file(f.path)
        with fs.open_output_stream(f"{root}/manifest.new") as out:
            out.write(json.dumps({"end": self.end, "ids": start, "shards": shards}).encode())
        fs.move(f"{root}/manifest.new", f"{root}/manifest.json")

    def abort(self, messages):
        fs, root = place(self.path)
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            fs.delete_dir_contents(root)


@dataclass
class Documents(InputPartition):
    name: str
    start: int
    low: int
    high: int


class BitReader(DataSourceReader):
    """A partition is a run of documents of one shard; it reads their blocks alone."""

    def __init__(self, options: dict):
        self.path, self.ids, self.split = options["path"], options.get("ids", "false") == "true", int(options.get("split", 4_000_000))

    def partitions(self):
        out = []
        for name, docs, ids, start in manifest(self.path)["shards"]:
            parts = max(1, min(docs, round(ids / self.split)))
            out += [Documents(name, start, docs * k // parts, docs * (k + 1) // parts) for k in range(parts)]
        return out or [Documents("", 0, 0, 0)]

    def read(self, p):
        if p.low == p.high:
            return
        fs, root = place(self.path)
        shard = Shard(fs, f"{root}/{p.name}")
        doc, null, at = shard.documents(p.low, p.high)
        crc, lists, first = np.zeros(len(doc), np.int64), [], 0
        k = 0
        while k < len(doc):
            n = max(1, int(np.searchsorted(at, at[k] + 16 * BLOCK, "right")) - 1 - k)  # whole documents, or one long one
            if n == 1 and not self.ids:
                for a in range(int(at[k]), int(at[k + 1]), 16 * BLOCK):
                    crc[k] = zlib.crc32(shard.read(a, min(16 * BLOCK, int(at[k + 1]) - a)).astype("<u4"), int(crc[k]))
            else:
                x = shard.read(int(at[k]), int(at[k + n] - at[k])).astype("<u4")
                cut = at[k : k + n + 1] - at[k]
                crc[k : k + n] = [zlib.crc32(x[a:b]) for a, b in zip(cut.tolist(), cut.tolist()[1:])]
                lists.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x.view(np.int32)))) if self.ids else None
            k += n
            if k - first >= 10_000 or k == len(doc) or self.ids:
                own = slice(first, k)
                columns = [pa.array(doc[own], pa.int64(), mask=null[own].astype(bool)), pa.array(p.start + at[first:k]), pa.array(np.diff(at[first : k + 1])), pa.array(crc[own])]
                yield pa.RecordBatch.from_arrays(columns + lists, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"][: len(lists)]])
                lists, first = [], k


class TokenBits(DataSource):
    @classmethod
    def name(cls):
        return "tokenbits"

    def schema(self):
        return "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if self.options.get("ids") == "true" else "")

    def writer(self, schema, overwrite):
        return BitWriter(self.options)

    def reader(self, schema):
        return BitReader(self.options)


def manifest(path: str) -> dict:
    fs, root = place(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read_range(path: str, start: int, n: int) -> np.ndarray:
    """n ids from a place in the whole data set on, whatever shards they are in: what a trainer's loader asks for."""
    fs, root = place(path)
    out = []
    for name, _, ids, first in manifest(path)["shards"]:
        a, b = max(start, first), min(start + n, first + ids)
        if a < b:
            out.append(Shard(fs, f"{root}/{name}").read(a - first, b - a))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2, shard_bytes: int = 128 << 20) -> None:
    """Writes the data set of docs (doc_id, text). Shards are as many as shard_bytes of text ask for, and at least
    enough for all cores; ties of doc_id are dealt by their place in the input, so that one id may hold any share."""
    spark = docs.sparkSession
    x = arrow_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("body")))
    spark.dataSource.register(TokenBits)
    size = x.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(1, -(-size // shard_bytes), min(4 * spark.sparkContext.defaultParallelism, -(-size // (4 << 20))))
    x = x.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    x.select("doc_id", "body").write.format("tokenbits").mode("append").option("tokenizer", tokenizer).option("end", end).save(path)


def load(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the files."""
    arrow_rows(spark.range(0))  # workers find the package
    spark.dataSource.register(TokenBits)
    return spark.read.format("tokenbits").option("ids", str(ids).lower()).load(path)


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Writes the data set to the shared folder and reads it back."""
    path = shared_dir(docs.sparkSession)
    write(docs, path, tokenizer, end)
    return load(docs.sparkSession, path)
