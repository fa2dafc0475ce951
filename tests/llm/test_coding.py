"""Token files, periodic runs and vector codes against plain versions."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import periodicruns, tokenbits, vectorcodes

DOCS = "doc_id long, text string, Doc_source string"


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    return lambda text: tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("width", [1, 7, 15, 16, 17, 31, 32])
def test_packing_bits(width):
    for n in (0, 1, 63, 64, 65, 1000):
        x = np.random.default_rng(n).integers(0, 1 << width, n, dtype=np.uint64)
        raw = tokenbits.pack(x, width)
        assert len(raw) == -(-n // 64) * width * 8 and (tokenbits.unpack(raw, width)[:n] == x).all()
    assert [tokenbits.width_of(n) for n in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_same_ids_as_the_library(vocabulary, library):
    rng = random.Random(1)
    plain = ["a", "b", "cd", " ", " ", "\n", "é", "1", "'s", "!", ".,", "中", "x-y", "\0", "Word", "\U0001f600"]
    odd = [*plain, "\t", "　", "\x1c", "\u0085", "\x0b", "<|endoftext|>"]
    texts = ["".join(rng.choices(rng.choice((plain, odd)), k=rng.randint(0, 30))) for _ in range(4000)] + ["z" * 3000, " " * 50]
    encode = tokenbits.ByteEncoder(vocabulary, most=500)  # forgets again and again
    for k in range(0, len(texts), 300):
        ids, at = encode(pa.array(texts[k : k + 300]))
        for text, a, b in zip(texts[k : k + 300], at, at[1:]):
            assert ids[a:b].tolist() == library(text), repr(text)


def rows_of(spark, path, library, rows, end=2):
    want, at = [], 0
    for doc, text in rows:
        ids = np.array([*library(text or ""), end], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return want, [tuple(r)[:4] for r in tokenbits.load(spark, path).orderBy("start").collect()]


def test_token_files(spark, tmp_path, monkeypatch, vocabulary, library):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(["the", "of", "Zürich", "x1", "\n", "don't"], k=rng.randint(0, 60)))) for k in range(-20, 120)]
    rows += [(500, "long " * 90_000), (501, None), (502, "")]
    shuffled = rng.sample(rows, len(rows))
    docs = spark.createDataFrame([(*r, "s") for r in shuffled], DOCS).repartition(5)
    path = str(tmp_path / "files")
    tokenbits.write(docs, path, vocabulary, shard_bytes=1 << 16)
    want, got = rows_of(spark, path, library, rows)
    assert got == want and len(tokenbits.manifest(path)["shards"]) > 3
    every = np.concatenate([np.array([*library(t or ""), 2]) for _, t in rows])
    for a in (0, 1, 1000, len(every) - 70_000, len(every) - 5):
        for n in (1, 3, 66_000):
            assert (tokenbits.read_range(path, a, n) == every[a : a + n]).all()
    assert [x for r in tokenbits.load(spark, path, ids=True).orderBy("start").collect() for x in r.ids] == every.tolist()
    small = spark.read.format("tokenbits").option("split", "1000").load(path)  # many partitions
    assert sorted(map(tuple, small.collect())) == sorted(want)


def test_token_files_of_odd_tables(spark, tmp_path, vocabulary, library):
    path = str(tmp_path / "none")
    tokenbits.write(spark.createDataFrame([], DOCS), path, vocabulary)
    assert tokenbits.load(spark, path).count() == 0 and tokenbits.read_range(path, 0, 5).size == 0
    path = str(tmp_path / "ties")
    rows = [(None, "null id"), *[(7, "same")] * 50, (9, "last")]
    tokenbits.write(spark.createDataFrame([(*r, "s") for r in rows], DOCS), path, vocabulary)
    want, got = rows_of(spark, path, library, rows)
    assert got == want


def test_lost_attempts_leave_nothing(spark, tmp_path, vocabulary):
    """A task that fails after it has written is run again under another name; the first file goes."""
    path = tmp_path / "retried"
    path.mkdir()
    (path / "shard-000000-99.bits").write_bytes(b"half a file")
    tokenbits.write(spark.createDataFrame([(1, "a b", "s")], DOCS), str(path), vocabulary)
    assert [p.name for p in path.glob("*.bits")] == [tokenbits.manifest(str(path))["shards"][0][0]] and tokenbits.load(spark, str(path)).count() == 1


def plain_runs(words):
    n, out = len(words), {}
    for p in range(1, n // 3 + 1):
        same, i = [words[k] == words[k + p] for k in range(n - p)], 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            if j > i and j - i + p >= max(24, 3 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    runs = sorted((s, e - s, p) for (s, e), p in out.items())
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return runs, [k not in gone for k in range(n)]


def periodic(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        words += [rng.choice("abc") for _ in range(rng.randint(1, 12))] * rng.randint(1, 14) + [rng.choice("abcdef") for _ in range(rng.randint(0, 5))]
    return words


@pytest.mark.parametrize("moduli", [periodicruns.MODULI, (7, 5)])
@pytest.mark.parametrize("pairs", [1 << 20, 50])
def test_runs_brute(monkeypatch, moduli, pairs):
    """Also with hashes that lie most of the time, and with a few pairs at a time."""
    monkeypatch.setattr(periodicruns, "MODULI", moduli), monkeypatch.setattr(periodicruns, "PAIRS", pairs)
    rng = random.Random(5)
    docs = [periodic(rng) for _ in range(200)] + [["a"] * 500, [], ["a"] * 23, ["a"] * 24, list("ab") * 12, list("abcd") * 6]
    for words, (runs, stays) in zip(docs, periodicruns.judged(docs)):
        assert (runs, stays.tolist()) == plain_runs(words)


def test_runs_query(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice(" \n\t").join(periodic(rng) or ["é"] * rng.randint(0, 40)), "s") for k in range(150)] + [(None, "a " * 30, "s"), (-4, None, "s"), (150, "", "s"), (151, "x y " * 20_000, "s"), (3, "w " * 25, "s"), (3, "w " * 25, "s")]
    got = sorted(map(repr, map(tuple, periodicruns.runs(spark.createDataFrame(rows, DOCS), words=300).collect())))
    want = []
    for doc, text, _ in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        runs, stays = plain_runs(words) if len(words) < 5000 else ([(0, len(words), 2)], [k < 2 for k in range(len(words))])
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        kept = hashlib.sha256(b" ".join(w for w, stay in zip(words, stays) if stay)).hexdigest()
        want.append((doc, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], digest, kept))
    assert got == sorted(map(repr, want))
    assert periodicruns.runs(spark.createDataFrame([], DOCS)).count() == 0


def plain_codes(rows):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [np.array(r[1], "<i8").reshape(4, -1)[k].tobytes() for k in range(4)]))
    wide = len(kept[0][1]) // 4
    cut = [[v[k * wide : (k + 1) * wide] for _, v, _ in kept] for k in range(4)]
    books = [own[:256] for own in cut]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(4):
        for k in range(4):
            groups = {}
            for x in cut[k]:
                groups.setdefault(near(x, books[k])[1], []).append(x)
            books[k] = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else e for j, e in enumerate(books[k])]
    last = [[near(x, books[k]) for x in cut[k]] for k in range(4)]
    errors = [sum(last[k][r][0] for k in range(4)) for r in range(len(kept))]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(repr((i, "".join(f"{last[k][r][1]:02x}" for k in range(4)), errors[r], sum(e for e, o in zip(errors, kept) if o[2] == label), digest)) for r, (i, _, label) in enumerate(kept))


@pytest.mark.parametrize("hot", [200, 3])
def test_vector_codes_brute(spark, monkeypatch, hot):
    monkeypatch.setattr(vectorcodes, "HOT", hot)
    rng = np.random.default_rng(2)
    vectors = [rng.normal(0, 0.3, 8).astype(np.float32).tolist() for _ in range(400)]
    for k in range(100, 250):  # one part, and whole vectors, that many share
        vectors[k][:2] = vectors[3][:2]
    vectors[300:330] = [vectors[5]] * 30
    rows = [(k, v, None if k % 3 == 0 else k % 4) for k, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [float("nan")] * 8, 1), (902, [float("inf")] + [0.0] * 7, 1), (903, [None] + [0.0] * 7, 1), (None, vectors[7], 1), (12, vectors[12], 0), (12, vectors[12], 0), (-3, [-0.0005] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("part0", F.lit(1)).withColumn("row_", F.lit("x"))
    got = [tuple(r) for r in vectorcodes.compress(df.repartition(5)).collect()]
    assert sorted(map(repr, got)) == plain_codes(rows)


def test_vector_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert vectorcodes.compress(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    one = vectorcodes.compress(spark.createDataFrame([(1, [0.5] * 4, None)], kind)).first()
    assert (one.code, one.error, one.label_error) == ("00000000", 0, 0)
    assert vectorcodes.compress(spark.createDataFrame([(1, [], 1), (2, [], 1)], kind)).select("code", "label_error").distinct().collect() == [("00000000", 0)]
    for bad in ([(1, [0.5] * 4, 1), (2, [0.5] * 8, 1)], [(1, [0.5] * 5, 1)], [(1, [1e9] * 4, 1)]):
        with pytest.raises(Exception, match="lengths|magnitude"):
            vectorcodes.compress(spark.createDataFrame(bad, kind)).collect()


def test_distances_are_exact():
    rng = np.random.default_rng(1)
    for most in (1000, 1 << 24):
        x, book = (rng.integers(-most, most, (n, 16)) for n in (50, 256))
        book[9] = book[3]
        code, error = vectorcodes.nearest(x, book)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)), k) for k, e in enumerate(book)) for r in x]
        assert [(int(e), int(c)) for c, e in zip(code, error)] == want
