import random
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.operators import decoding, ensemble, evaluation, images
from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    for t in ("part", "customer", "documents", "embeddings", "orders", "lineitem"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duckdb.sql(catalogue.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (x[cols].astype(str).sort_values(cols).values.tolist() for x in (got, want))
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_whole_texts(spark):
    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert any(len(t or "") > 120 for t in texts.values())
    for r in catalogue.QUERIES["t13_ctc_alignment"](spark, SF).collect():
        t = " ".join(texts[r.ID].split())
        needed = len(t) + sum(a == b for a, b in zip(t, t[1:]))
        assert (r.required_ctc_steps, r.ctc_margin, r.is_ctc_length_valid) == (needed, r.encoder_time_steps - needed, r.encoder_time_steps >= needed)
    for r in catalogue.QUERIES["p12_label_flags"](spark, SF).collect():
        t = " ".join(texts[r.ID].split())
        assert r.max_run == max((len(list(g)) for _, g in groupby(t)), default=1)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_edit_script_counts():
    ops = [s[0] for s in evaluation.edit_script("abc", "axcd")]
    assert ops.count("substitute") == 1 and ops.count("insert") == 1 and ops.count("delete") == 0


def plain_script(a, b):
    """Textbook table and backtrace, ties in the order match, substitute, delete, insert."""
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("match" if a[i] == b[j] else "substitute", a[i], b[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append(("delete", a[i], ""))
        else:
            j -= 1
            out.append(("insert", "", b[j]))
    return out[::-1]


def test_edit_kinds_brute(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choices("ab c\u00e9\U0001f600", k=rng.randint(0, 14)))
    rows = [(str(k), text(), text()) for k in range(300)] + [("x", None, "ab"), ("y", "abc", ""), ("z", "", ""), ("w", "a  b", "a b"), ("v", None, None)]
    df = spark.createDataFrame(rows, "ID string, reference string, prediction string")
    norm = {k: [" ".join((t or "").split()) for t in pair] for k, *pair in rows}
    count = lambda s, op: sum(x[0] == op for x in s)
    all_steps = Counter()
    for r in evaluation.row_errors(df).collect():
        a, b = norm[r.ID]
        c, w = plain_script(a, b), plain_script(a.split(), b.split())
        all_steps.update(x for x in c if x[0] != "match")
        assert (r.reference, r.prediction, r.exact_match) == (a, b, a == b)
        assert (r.char_insertions, r.char_deletions, r.char_substitutions) == tuple(count(c, op) for op in ("insert", "delete", "substitute")), (a, b)
        assert (r.word_insertions, r.word_deletions, r.word_substitutions) == tuple(count(w, op) for op in ("insert", "delete", "substitute"))
        assert r.row_cer == (r.char_edits / len(a) if a else float(r.char_edits > 0)) and r.row_wer == (r.word_edits / len(a.split()) if a else float(r.word_edits > 0))
    assert {(r.op, r.ref_char, r.pred_char): r.n for r in evaluation.confusions(df).collect()} == all_steps
    got = {r.ID: r for r in evaluation.edit_counts(df).collect()}
    assert (got["y"].deletions, got["y"].substitutions, got["x"].insertions) == (3, 0, 2)


def test_many_words(spark):
    a, b = [" ".join(f"w{k * s % 3001}" for k in range(3000)) for s in (1, 1)]
    r = evaluation.row_errors(spark.createDataFrame([("a", a, b.replace("w7 ", "x "))], "ID string, reference string, prediction string")).first()
    assert r.word_edits == r.word_substitutions == 1


def test_guards(spark):
    """Both guards must hold, and neither is set unless asked for."""
    rows = [("a", 0, "hello"), *[("a", k, "hellp") for k in (1, 2, 3)], ("b", 0, "x"), *[("b", k, "eighteen characters"[:18]) for k in (1, 2, 3)]]
    df = spark.createDataFrame(rows, "ID string, source_idx int, text string")
    text = lambda **how: {r.ID: r.text for r in ensemble.consensus(df, **how).collect()}
    assert text() == {"a": "hellp", "b": "eighteen characters"[:18]}
    assert text(length_delta=3, outlier_delta=4) == {"a": "hello", "b": "x"}
    assert text(length_delta=3)["a"] == "hellp" and text(outlier_delta=4)["b"] != "x"


def test_same_ids(spark):
    a, b = (spark.createDataFrame([(x, "t", k) for k, x in enumerate(ids)], "ID string, Target string, pos int") for ids in ("abc", "acb"))
    ensemble.require_same_ids(a, {"b": b})
    with pytest.raises(ValueError, match="place 1"):
        ensemble.require_same_order({"a": a, "b": b})
    with pytest.raises(ValueError, match="missing"):
        ensemble.require_same_ids(a, {"b": b.limit(2)})
    assert ensemble.stacked({"a": a, "b": b}).count() == 6


def test_decoder_dispatch(spark):
    df = catalogue.logits(spark, SF).limit(20)
    run = lambda name, **how: {r.vec_id: (r.text, r.candidates) for r in decoding.decode(df, "logits", "ABCDEFG", decoding.DecoderConfig(name, **how), length="steps").collect()}
    greedy, beam = run("greedy"), run("beam", beam=50, top=None, candidates=2)
    assert all(c is None for _, c in greedy.values()) and all(c.split("\t")[0] == t for t, c in beam.values())
    last = run("beam_lm_rerank", beam=50, candidates=3, penalties={"min_chars": 8, "short": 100.0})
    assert all(len(t) == max(len(x.split("\t")[0]) for x in c.split(" ||| ")) for t, c in last.values())
    for bad in ({"decoder": "x"}, {"beam": 0}, {"top": 0}, {"candidates": 0}, {"penalties": {"min_chars": -1}}):
        with pytest.raises(ValueError):
            decoding.DecoderConfig(**bad)


def test_images(tmp_path, spark):
    a = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3) * 14
    assert (images.resized(a, 3, 2) == a).all() and images.resized(a, 6, 4).shape == (4, 6, 3)
    flat = np.full((10, 40, 1), 77, np.uint8)
    assert (images.resized(flat, 7, 3) == 77).all() and images.average_hash(flat[:, :, 0]) == "0" * 16
    assert (images.resized(np.array([[[0], [100]]], np.uint8), 1, 1) == 50).all()
    assert images.contrasted(np.array([[[50], [100], [150]]], np.uint8), 0).ravel().tolist() == [0, 127, 255]
    (tmp_path / "one.ppm").write_bytes(b"no image")
    row = spark.createDataFrame([("i", 40, 10, 1, flat.tobytes()), ("n", None, None, None, None)], "ID string, width int, height int, channels int, pixels binary")
    got = {r.ID: r for r in images.padded(images.scaled(row, 5, most=15), 18, value=9, align="right").collect()}
    assert (got["i"].width, got["i"].height, got["i"].channels, got["n"].pixels) == (18, 5, 3, None)
    assert bytes(got["i"].pixels)[: 18 * 3] == bytes([9] * 9 + [77] * 45)
    assert {r.width for r in images.padded(images.scaled(row.limit(1), 10), 12, align="center").collect()} == {12}
    q = {r.ID: r for r in images.quality_flags(images.quality(row.withColumn("readable", F.col("pixels").isNotNull()))).collect()}
    assert q["i"].flag_too_dark and q["i"].flag_low_dynamic_range and q["n"].error == "unreadable" and q["n"].quality_flag_count == 0
    for how in ({"height": 0}, {"height": 3, "most": 0}, {"height": 3, "cutoff": -1}):
        with pytest.raises(ValueError):
            images.scaled(row, **how)


def test_resized_pixels():
    """Against the filter's definition, pixel by pixel: weights in 2^22ths, the width first, rounding between."""
    def weight(x):
        return max(0.0, 1 - abs(x))

    def line(values, new):
        old, out = len(values), []
        for k in range(new):
            wide = max(1.0, old / new)
            middle = (k + 0.5) * old / new
            own = {i: weight((i + 0.5 - middle) / wide) for i in range(max(0, int(middle - wide + 0.5)), min(old, int(middle + wide + 0.5)))}
            whole = {i: int(w / sum(own.values()) * (1 << 22) + 0.5) for i, w in own.items()}
            out.append(min(255, max(0, (sum(values[i] * w for i, w in whole.items()) + (1 << 21)) >> 22)))
        return out

    rng = np.random.default_rng(9)
    for high, wide, new_high, new_wide in ((8, 8, 4, 4), (5, 9, 7, 3), (3, 4, 8, 16), (30, 50, 8, 8), (1, 1, 2, 2)):
        a = rng.integers(0, 256, (high, wide, 1), dtype=np.uint8)
        rows = [line(r, new_wide) for r in a[:, :, 0].tolist()] if wide != new_wide else a[:, :, 0].tolist()
        want = [list(c) for c in zip(*[line(list(c), new_high) for c in zip(*rows)])] if high != new_high else rows
        assert images.resized(a, new_wide, new_high)[:, :, 0].tolist() == want


def test_hot_group_of_images(spark):
    rows = [(f"k{i:04d}", "h", f"l{i % 90 if i % 7 else i % 3}", f"f{i % 5}") for i in range(900)] + [("z", "x", "l", "f"), ("y1", "y", None, "f"), ("y2", "y", "b", "f"), ("n", None, "l", "f")]
    df = spark.createDataFrame(rows, "ID string, h string, label string, file_md5 string").repartition(7)
    from quillspark.operators import audit

    for most in (None, 20):
        got = {r.h: r for r in audit.duplicate_images(df, "h", "label", most).collect()}
        want = list(dict.fromkeys(r[2] for r in rows[:900]))
        assert set(got) == {"h", "y"} and (got["h"].n, got["h"].unique_files, got["h"].unique_labels) == (900, 5, len(want))
        assert got["h"].ids == [r[0] for r in rows[:900]][:most] and got["h"].labels == want[:most] and got["y"].labels == ["b"]


def test_image_files(tmp_path, spark):
    import struct
    import zlib

    def png(rows):
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        h, w = len(rows), len(rows[0])
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(c for p in r for c in p) for r in rows))) + chunk(b"IEND", b"")

    (tmp_path / "a.png").write_bytes(png([[(255, 0, 0), (0, 255, 0), (0, 0, 255)], [(9, 8, 7), (1, 2, 3), (0, 0, 0)]]))
    (tmp_path / "b.png").write_bytes(b"not an image")
    got = {r.ID: r for r in images.read(spark, str(tmp_path), "*.png").collect()}
    assert (got["a"].width, got["a"].height, got["a"].mode, got["a"].aspect_ratio, got["a"].area) == (3, 2, "RGB", 1.5, 6)
    assert bytes(got["a"].pixels)[:9] == bytes([255, 0, 0, 0, 255, 0, 0, 0, 255]) and not got["b"].readable and got["b"].file_md5


def test_word_distance_random(spark):
    rng = random.Random(1)
    rows = [(str(k), " ".join(rng.choices("abcd", k=rng.randint(0, 8))), " ".join(rng.choices("abcd", k=rng.randint(0, 8)))) for k in range(60)]
    got = evaluation.row_errors(spark.createDataFrame(rows, "ID string, reference string, prediction string")).collect()
    for r in got:
        want = sum(s[0] != "match" for s in evaluation.edit_script(r.reference.split(), r.prediction.split()))
        assert r.word_edits == want


def test_alignment_rejects(spark):
    t = spark.createDataFrame([("a", "x")], "ID string, Target string")
    p = spark.createDataFrame([("b", "x")], "ID string, Target string")
    with pytest.raises(ValueError):
        evaluation.align(t, p)


def test_majority_tie_and_empty(spark):
    rows = [("a", 0, "one"), ("a", 1, "two"), ("b", 0, ""), ("b", 1, "x"), ("c", 0, ""), ("c", 1, None)]
    got = {r.ID: r.text for r in ensemble.majority(spark.createDataFrame(rows, "ID string, source_idx int, text string")).collect()}
    assert got == {"a": "one", "b": "x", "c": ""}
