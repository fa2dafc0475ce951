"""Language ID by interpolated Kneser-Ney character models, one for each language.

A text's cross-entropy is that of its words, each read with a space before and after it, so that a
word's score is found once per worker and reused. Training takes whole texts of all labelled documents, without the
held-out fold where languages are told for a test. Spark counts their n-grams and makes the models level by level; arrays sorted by hash, in buckets of some
hundred thousand n-grams, are in the shared folder, and workers map them into memory. The driver holds the
languages' names."""

from __future__ import annotations

import io
import uuid
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.ranks import quantiles
from .common import arrow_rows, fresh, shared_dir, table

ORDER, DISCOUNT = 5, 0.75
LETTER = regex.compile(r"\p{L}")
EVIDENCE = 20  # characters that a score is told for
WORDS, CHARS, GRAMS = 150_000, 1 << 26, 500_000  # that a task counts before it gives its n-grams
BUCKET = 1 << 19  # n-grams of a bucket, about


def is_training(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text (null: empty) mod folds is not 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != 0


def key(gram: str) -> int:
    """As Spark's xxhash64."""
    return xxhash.xxh64_intdigest(gram, 42)


def grams(docs: DataFrame, most_words: int = WORDS, most_chars: int = CHARS, most_grams: int = GRAMS) -> DataFrame:
    """(lang, gram, n): counts of all substrings of ' word ' of exactly ORDER characters, shorter at the front, over all texts
    (lang, text); split as texts to be told are."""
    def run(batches):
        seen: dict[str, Counter] = {}
        size = 0

        def out(lang, found):
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])

        def flush():
            for lang, words in seen.items():
                found: dict = {}
                for w, c in words.items():
                    s = f" {w} "
                    for e in range(2, len(s) + 1):
                        g = s[max(0, e - ORDER) : e]
                        found[g] = found.get(g, 0) + c
                    if len(found) > most_grams:
                        yield out(lang, found)
                        found = {}
                yield out(lang, found)
            seen.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(text.lower().split())
                size += len(text)
            if size > most_chars or sum(map(len, seen.values())) > most_words:
                yield from flush()
                size = 0
        yield from flush()

    return arrow_rows(docs.select("lang", "text")).mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Rows:
    """Rows of numbers by string, in the order in which index got the strings."""

    def __init__(self, wide: int):
        self.index, self.room, self.n = {}, np.zeros((1024, wide)), 0

    @property
    def rows(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.room):
            self.room = np.concatenate([self.rows, np.zeros((self.n + 2 * len(rows), self.room.shape[1]))])
        self.room[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


class Memo:
    """What a worker has found with one model: scores of words and of n-grams, forgotten beyond most of either."""

    def __init__(self, langs: int, most: int = 300_000):
        self.most, self.words, self.grams = most, Rows(langs), Rows(langs)

    def limit(self, rows: Rows) -> None:
        if rows.n > self.most:
            rows.__init__(rows.room.shape[1])


_MEMO: dict[str, Memo] = {}


def memo(model: Model) -> Memo:
    """The memo of a worker process, which outlives its tasks; one model's at a time."""
    if model.name not in _MEMO:
        _MEMO.clear()
        _MEMO[model.name] = Memo(len(model.langs))
    return _MEMO[model.name]


class Model:
    """langs; for each bucket of hashes the files keys (sorted hashes of n-grams of any language) and logp, back: float32
    [len(keys), langs], in a folder. It is sent to workers as a path, and its arrays are opened there."""

    def __init__(self, folder: str, langs: list[str], bits: int, floor: float, order: int = ORDER):
        self.folder, self.langs, self.bits, self.floor, self.order = folder, langs, bits, floor, order
        self.name, self.open = uuid.uuid4().hex, {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def array(self, kind: str, bucket: int):
        name = f"{kind}-{bucket}.npy"
        if name not in self.open:
            fs, at = pafs.FileSystem.from_uri(f"{self.folder}/{name}")
            if fs.get_file_info(at).type == pafs.FileType.NotFound:
                self.open[name] = None
            else:
                self.open[name] = np.asarray(np.load(at, mmap_mode="r")) if isinstance(fs, pafs.LocalFileSystem) else np.load(io.BytesIO(fs.open_input_stream(at).read()))
        return self.open[name]

    def find(self, kind: str, grams: list[str]) -> np.ndarray:
        """The grams' rows of logp or back; NaN or 0 where they aren't there."""
        h = np.array([key(g) for g in grams], np.uint64)
        out = np.full((len(h), len(self.langs)), np.nan if kind == "logp" else 0.0)
        own = h >> np.uint64(64 - self.bits)
        order = np.argsort(own, kind="stable")
        cut = np.searchsorted(own[order], np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for b in range(1 << self.bits):
            on = order[cut[b] : cut[b + 1]]
            if len(on) and (keys := self.array("keys", b)) is not None:
                at = np.minimum(np.searchsorted(keys, h[on]), len(keys) - 1)
                hit = keys[at] == h[on]
                out[on[hit]] = self.array(kind, b)[at[hit]]
        return out

    def chars(self, grams: list[str]) -> np.ndarray:
        """log2 probability of each gram's last character after the rest, by language; all back off together."""
        out = np.zeros((len(grams), len(self.langs)))
        rows, wait = np.arange(len(grams)), np.ones(out.shape, bool)
        while len(rows):
            own = self.find("logp", grams)
            now = wait & ~np.isnan(own)
            out[rows] += np.where(now, own, 0.0)
            wait = wait & ~now
            single = np.array([len(g) == 1 for g in grams])
            out[rows] += np.where(wait & single[:, None], self.floor, 0.0)
            left = np.nonzero(wait.any(axis=1) & ~single)[0]
            if not len(left):
                break
            rows, wait, grams = rows[left], wait[left], [grams[x] for x in left]
            out[rows] += np.where(wait, self.find("back", [g[:-1] for g in grams]), 0.0)
            grams = [g[1:] for g in grams]
        return out

    def words(self, words: list[str], memo: Memo) -> np.ndarray:
        """Sums over the characters of each ' word ', by language."""
        memo.limit(memo.grams)
        index, order = memo.grams.index, self.order
        had, grams, begins = len(index), [], []
        for w in words:
            s = f" {w} "
            begins.append(len(grams))
            grams += [index.setdefault(s[:e], len(index)) for e in range(2, min(order, len(s) + 1))]
            grams += [index.setdefault(s[e - order : e], len(index)) for e in range(order, len(s) + 1)]
        memo.grams.add(self.chars(list(islice(index, had, None))))
        return np.add.reduceat(memo.grams.rows[grams], begins, axis=0)


def judge(model: Model):
    """A function of texts: (lang_pred, bits, posterior's denominator less the rejection's part) of each."""
    langs = len(model.langs)

    def run(texts: list):
        kept = memo(model)
        pred, bits, rest = [], [], []
        for k in range(0, len(texts), 500):
            own = [t if t is not None and langs and LETTER.search(t) else None for t in texts[k : k + 500]]
            split = [t.lower().split() if t is not None else [] for t in own]
            kept.limit(kept.words)
            known = kept.words.index
            new = list({w for s in split for w in s if w not in known})
            if new:
                found = model.words(new, kept)
                known.update(zip(new, range(len(known), len(known) + len(new))))
                kept.words.add(found)
            rows = kept.words.rows
            for t, s in zip(own, split):
                if t is None:
                    pred.append("und"), bits.append(None), rest.append(None)
                    continue
                mean = rows[np.fromiter(map(known.__getitem__, s), np.int64, len(s))].sum(axis=0) / (sum(map(len, s)) + len(s))
                best = int(np.argmax(mean))
                pred.append(model.langs[best]), bits.append(float(-mean[best]))
                rest.append(float(np.sum(2.0 ** (EVIDENCE * (mean - mean[best])))))
        return pred, bits, rest

    return run


def labelled(every: bool = False) -> Column:
    """Whether a row may be learned from; every: also one of the held-out fold."""
    own = F.col("lang").isNotNull() & F.col("text").isNotNull()
    return own if every else own & is_training(F.col("doc_id"))


def sample(docs: DataFrame, docs_per_lang: int) -> DataFrame:
    """Labelled training documents, about docs_per_lang of each language at most, chosen by the hash of id; for those
    who ask for it, as identify and keep_known don't. The driver holds a count for each language."""
    own = docs.where(labelled()).select("lang", "text", "doc_id")
    share = {r["lang"]: min(1.0, docs_per_lang / r["count"]) for r in own.groupBy("lang").count().collect()}
    if not share:
        return own
    part = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    return own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20))


def levels(counts: DataFrame) -> dict[int, DataFrame]:
    """(lang, gram, n) for each length: what begins a word keeps its count, others count the distinct characters before."""
    out: dict[int, DataFrame] = {}
    for k in range(ORDER, 0, -1):
        own = counts.where(F.char_length("gram") == k)
        if k < ORDER:
            own = own.unionByName(out[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")))
        out[k] = table(own)
    return out


def train(docs: DataFrame, every: bool = False) -> Model:
    """The model of all labelled documents, with those of the held-out fold if every. An n-gram's context has at most as many rows as the alphabet."""
    folder = shared_dir(docs.sparkSession)
    counts = table(grams(docs.where(labelled(every))))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model(folder, [], 0, 0.0)
    level = levels(counts)
    floor = 1.0 / (level[1].agg(F.count_distinct("gram")).first()[0] + 1)
    made, low = [], None
    for k in range(1, ORDER + 1):
        same = Window.partitionBy("lang", "context")
        x = level[k].withColumn("context", F.substring("gram", 1, k - 1)).withColumn("total", F.sum("n").over(same))
        x = x.withColumn("back", DISCOUNT * F.count("*").over(same) / F.col("total"))
        x = x.join(low, [x["lang"] == low["of"], F.substring("gram", 2, k - 1) == low["rest"]]) if k > 1 else x.withColumn("low", F.lit(floor))
        x = table(x.select("lang", "gram", "context", "back", ((F.col("n") - DISCOUNT) / F.col("total") + F.col("back") * F.col("low")).alias("prob")))
        low = x.select(F.col("lang").alias("of"), F.col("gram").alias("rest"), F.col("prob").alias("low"))
        made.append(x.select("lang", "gram", F.log2("prob").alias("logp"), F.lit(None).cast("double").alias("back")))
        if k > 1:
            made.append(x.select("lang", F.col("context").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log2("back").alias("back")).distinct())
    rows = made[0]
    for x in made[1:]:
        rows = rows.unionByName(x)
    bits = max(4, (sum(x.count() for x in level.values()) // BUCKET).bit_length())
    names = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(langs)), "at int, name string"))
    rows = rows.join(names, F.col("lang") == F.col("name")).select(F.xxhash64("gram").alias("h"), "at", "logp", "back").withColumn("bucket", F.shiftrightunsigned("h", 64 - bits).cast("int"))

    def save(key, t):
        bucket, at = key[0].as_py(), t.column("at").to_numpy()
        keys, row = np.unique(t.column("h").to_numpy().view(np.uint64), return_inverse=True)
        arrays = {"keys": keys, "logp": np.full((len(keys), len(langs)), np.nan, np.float32), "back": np.zeros((len(keys), len(langs)), np.float32)}
        for kind in ("logp", "back"):
            on = t.column(kind).is_valid().to_numpy()
            arrays[kind][row[on], at[on]] = t.column(kind).drop_null().to_numpy()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for kind, a in arrays.items():
            part = f"{root}/.{uuid.uuid4().hex}"  # a task that runs again leaves the same files, whole
            with fs.open_output_stream(part) as f:
                np.save(f, a)
            fs.move(part, f"{root}/{kind}-{bucket}.npy")
        return pa.table({"n": pa.array([len(keys)], pa.int64())})

    arrow_rows(rows).groupBy("bucket").applyInArrow(save, "n long").agg(F.sum("n")).collect()
    return Model(folder, langs, bits, float(np.log2(floor)))


def limit(told: DataFrame, fits: str, bits: str, margin: float) -> float:
    """The bits per character beyond which a text is rejected: margin times the 99.9 % quantile of all rows that fits is true for."""
    tried = quantiles(told.where(F.col(fits)).select(bits), {bits: [0.999]})[bits][0]
    return margin * tried if tried is not None else float("inf")


def identify(docs: DataFrame, margin: float = 1.5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every whole text; und where text is null or has no
    letter, or nothing was learned. Of equally likely languages the first by name is told. The score is that
    language's share at EVIDENCE characters, against the others and against an unknown language whose bits are the limit;
    a text of more bits per character is rejected, and so is one without a letter. Texts are judged once, and what was told is
    written, since the limit rests on all of it."""
    judged = judge(train(docs))

    def run(batches):
        for b in batches:
            pred, bits, rest = judged(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(bits, pa.float64()), pa.array(rest, pa.float64())], ["row", "fits", "lang_pred", "bits", "rest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), labelled().alias("fits"))
    told = table(arrow_rows(rows).mapInArrow(run, "row long, fits boolean, lang_pred string, bits double, rest double"))
    most = limit(told, "fits", "bits", margin)
    score = F.coalesce(1 / (F.col("rest") + F.pow(F.lit(2.0), F.least(EVIDENCE * (F.col("bits") - most), F.lit(900.0)))), F.lit(0.0))
    return told.select(F.col("row").alias("doc_id"), (~is_training(F.col("row"))).alias("held_out"), "lang_pred", score.alias("score"), F.coalesce(F.col("bits") > most, F.lit(True)).alias("rejected"))


def keep_known(docs: DataFrame, margin: float = 1.5, every: bool = False) -> DataFrame:
    """The documents in a learned language, with all their columns, judged where they are and written with their bits, which
    the limit rests on. Rejected are those without a letter and those of more bits than it; all stay if nothing was learned.
    every: models and limit rest on all labelled documents, as where no fold is held out for a test."""
    model = train(docs, every)
    if not model.langs:
        return docs
    judged, at, bits = judge(model), docs.columns.index("text"), fresh(docs, "bits")

    def run(batches):
        for b in batches:
            found = pa.array(judged(b.column(at).to_pylist())[1], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, bits]).filter(found.is_valid())

    told = table(arrow_rows(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(bits, T.DoubleType())])))
    fits = fresh(told, "fits")
    most = limit(told.withColumn(fits, labelled(every)), fits, bits, margin)
    return told.where(F.col(bits) <= most).drop(bits)
