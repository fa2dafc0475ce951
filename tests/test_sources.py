import itertools
import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillspark.operators import decoding, profile, relations
from quillspark.sources import readers, writers


def test_predictions_round_trip(spark, tmp_path):
    rows = [("a", 'one "quoted"'), ("b", "two\nlines"), ("c", None)]
    df = spark.createDataFrame(rows, "ID string, Target string")
    writers.csv(df, str(tmp_path / "p"), ["ID"])
    got = {r.ID: r.Target for r in readers.predictions(spark, str(tmp_path / "p"), "m").collect()}
    assert got == {"a": 'one "quoted"', "b": "two\nlines", "c": ""}
    writers.csv(df.union(df), str(tmp_path / "q"))
    with pytest.raises(ValueError):
        readers.predictions(spark, str(tmp_path / "q"))


def test_parsers(spark, tmp_path):
    lines = [("[log] x",), ("",), ("test/abc B y <space> t h i s",), ("test/abc123",), ("test/d/e.f.jpg a <unk> b",)]
    got = {r.ID: r.Target for r in readers.decoder_lines(spark.createDataFrame(lines, "value string"), "test/").collect()}
    assert got == {"abc": "By this", "abc123": "", "e.f": "ab"}
    lines = [("/tmp/a.jpg\tBy this",), ("/tmp/b.jpg\t[('By this', 0.99)]",), ('/tmp/c.jpg\t{"rec_text": "x", "text": "y"}',), ("/tmp/d.jpg plain text",), ("/tmp/e.jpg\t(broken",)]
    got = {r.ID: r.Target for r in readers.path_lines(spark.createDataFrame(lines, "value string")).collect()}
    assert got == {"a": "By this", "b": "By this", "c": "x", "d": "plain text", "e": "(broken"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "abc.txt").write_text("By  e\u0301\n")
    assert [tuple(r) for r in readers.transcripts(spark, str(tmp_path / "t")).collect()] == [("abc", "By \u00e9")]
    assert readers.parse_spec("m:/x.csv") == ("m", "/x.csv")
    with pytest.raises(ValueError):
        readers.parse_spec(":/x.csv")


def test_symbols_and_folds(spark, tmp_path):
    df = spark.createDataFrame([("<ctc>", 0), ("a", 1), ("<space>", 2)], "symbol string, idx int")
    writers.symbol_file(df, str(tmp_path / "s"))
    assert sorted(map(tuple, readers.symbols(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, df.collect()))
    rows = spark.createDataFrame([("a", "x y", "train"), ("b", None, "test")], "ID string, Target string, split string")
    writers.fold_tables(rows, str(tmp_path / "f"))
    assert {(r.split, r.value) for r in spark.read.text(str(tmp_path / "f")).collect()} == {("train", "a x <space> y"), ("test", "b ")}


def test_evaluation_bundle(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "ID string, row_cer double")
    conf = spark.createDataFrame([("delete", "x", "", 2)], "op string, ref_char string, pred_char string, n long")
    writers.evaluation_bundle(spark.createDataFrame([(1, 2)], "wer int, cer int"), rows, conf, str(tmp_path))
    text = "".join(p.read_text() for p in (tmp_path / "summary").glob("*.json"))
    assert list(json.loads(text)) == ["cer", "wer"]


def test_beam_search_is_exact_when_wide():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(5, 3))
    p = logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)
    want = {}
    for path in itertools.product(range(3), repeat=5):
        text = "".join("AB"[k - 1] for n, k in enumerate(path) if k and (n == 0 or path[n - 1] != k))
        want[text] = np.logaddexp(want.get(text, -np.inf), sum(p[n, k] for n, k in enumerate(path)))
    got = decoding.search(logits, "AB", beam=1000, top=None)
    assert {t: round(a, 9) for t, a, _, _ in got} == {t: round(float(a), 9) for t, a in want.items()}
    assert got[0][0] == max(want, key=want.get)
    with pytest.raises(ValueError):
        decoding.search(logits, "ABC")


def test_model_and_rerank(spark):
    lm = decoding.CharModel({"<s>": {"A": 20}, "A": {"B": 19, "C": 1}, "B": {"</s>": 19}}, 2)
    assert math.isclose(lm.log_prob("", "A"), math.log(20.5 / 22)) and math.isclose(lm.log_prob("A", "?"), -math.log(4))
    flat = np.array([[-5, 5, -5, -5], [5, -5, -5, -5], [-5, -5, 1.0, 1.1], [5, -5, -5, -5]])
    assert decoding.search(flat, "ABC")[0][0] == "AC"
    assert decoding.search(flat, "ABC", lm=lm, lm_weight=2.0)[0][0] == "AB"
    df = spark.createDataFrame([(1, [("a  b", 0.0, 0.0, 1.0), ("ab", 0.0, 0.0, 0.9), ("ac", 0.0, 0.0, 0.9)])], f"id int, candidates {decoding.CANDIDATE}")
    assert [c.text for c in decoding.rerank(df, spaces=0.5).first().candidates] == ["ab", "ac", "a  b"]


def test_nulls(spark):
    df = spark.createDataFrame([(None, None), ("a", "bb!!  "), ("a", "")], "ID string, Target string")
    got = profile.label_flags(profile.label_features(df, "Target")).orderBy("max_run").collect()
    assert len(got) == 3 and [r.max_run for r in got] == [1, 1, 2]
    assert profile.overview(df).where("name = 'ID'").first()["missing"] == 1
    assert relations.repeated_ids(df, "ID").count() == 1
    assert relations.coarsen(df, "ID", 2, F.lit("rare")).where("ID = 'rare'").count() == 1
    with pytest.raises(PySparkException):
        relations.attach(df, df.where("ID = 'x'").withColumn("path", F.lit("p")), "ID", "path").collect()


def test_models_as_files(tmp_path, spark):
    from quillspark.operators import decoding
    from quillspark.sources import models

    models.save_tokenizer(spark, "abc é", f"{tmp_path}/tok")
    assert models.load_tokenizer(spark, f"{tmp_path}/tok") == "abc é"
    with pytest.raises(ValueError):
        models.save_tokenizer(spark, "aa", f"{tmp_path}/bad")
    lm = decoding.CharModel({"a": {"b": 3, "</s>": 1}, "<s>": {"a": 2}}, 2, 0.25)
    models.save_model(spark, lm, f"{tmp_path}/lm")
    got = models.load_model(spark, f"{tmp_path}/lm")
    assert (got.counts, got.order, got.k) == (lm.counts, 2, 0.25) and got.log_prob("a", "b") == lm.log_prob("a", "b")
    conf = models.patched({"Global": {"epochs": 1, "seed": 3}}, Global__epochs=9, Train__batch=4)
    models.save_settings(spark, conf, f"{tmp_path}/conf")
    assert models.load_settings(spark, f"{tmp_path}/conf") == {"Global": {"epochs": 9, "seed": 3}, "Train": {"batch": 4}}


def test_datasets(tmp_path, spark):
    from quillspark.sources import writers

    rows = [("a", " b  c ", "train", "/d/i/a.jpeg"), ("b", "dé", "valid", "/d/i/b.jpg"), ("c", None, "test", "/x/c.jpg")]
    df = spark.createDataFrame(rows, "ID string, Target string, split string, image_path string")
    text = lambda p: sorted(r.value for r in spark.read.text(f"{tmp_path}/{p}").collect())
    writers.paddle_dataset(df, f"{tmp_path}/o", root="/d")
    assert text("o/labels/split=train") == ["i/a.jpeg\tb c"] and text("o/labels/split=test") == ["/x/c.jpg\t"] and text("o/characters") == ["b", "c", "d", "é"]
    assert spark.read.json(f"{tmp_path}/o/metadata").first().n_train == 1


def test_symbol_line_number(spark, tmp_path):
    (tmp_path / "syms").write_text("<ctc> 0\r\n\na 1\n<space> 2\n")
    assert sorted(map(tuple, readers.symbols(spark, str(tmp_path / "syms")).collect())) == [("<ctc>", 0), ("<space>", 2), ("a", 1)]
    (tmp_path / "bad").write_text("<ctc> 0\n\nno number\n")
    with pytest.raises(Exception, match="not a symbol line: 3: no number"):
        readers.symbols(spark, str(tmp_path / "bad")).collect()


def test_transcripts_of_many_folders(spark, tmp_path):
    """What Spark's own source reads, in tasks that don't grow with the number of files."""
    tmp_path = tmp_path / "a %41"
    for k in range(300):
        folder = tmp_path / "t" / (f"f{k % 3}" if k % 10 else "f0/part=1")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{k}.v1.txt").write_bytes(f" A{k}\r\n\té ".encode() if k % 7 else b"")
    for name in ("f0/_x.txt", "f0/.x.txt", "f1/x.csv", "f1/deep/x.txt", "x.txt"):
        (tmp_path / "t" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "t" / name).write_text("no")
    x = readers.transcripts(spark, f"{tmp_path}/t/f*")
    assert x.rdd.getNumPartitions() <= 4
    assert sorted(map(tuple, x.collect())) == sorted((f"{k}.v1", f"A{k} é" if k % 7 else "") for k in range(300))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.transcripts(spark, f"{tmp_path}/none").collect()
