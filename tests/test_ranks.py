"""Row numbers and quantiles that no task or plan can upset."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import profile, ranks
from quillspark.sources import readers


@pytest.mark.parametrize("advisory", ["64m", "4m"])
def test_numbers_survive_coalescing(spark, advisory):
    """Wide rows: the numbering and the reading of all columns must see the same partitions."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory), spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        x = spark.range(20_000).select(F.col("id"), F.repeat(F.md5(F.col("id").cast("string")), 60).alias("text")).repartition(13)
        got = ranks.numbered(x, "id")
        assert got.count() == 20_000 and got.where("pos <> id").count() == 0
        assert ranks.batches(x, "id", 64).where("batch <> id div 64").count() == 0
        assert [r.id for r in ranks.window_of(x, F.desc("id"), 19_990, 5).orderBy("id").collect()] == [5, 6, 7, 8, 9]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes"), spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_numbers_of_odd_tables(spark):
    assert ranks.numbered(spark.createDataFrame([], "a int"), "a").count() == 0
    x = spark.createDataFrame([(1, 2, 3), (1, 2, 3), (None, 1, 1)], "part int, Row int, pos_ int")
    assert sorted(r.pos for r in ranks.numbered(x, "part").collect()) == [0, 1, 2] and ranks.batches(x, "part", 2).columns == ["part", "Row", "pos_", "batch"]


def test_folds(spark):
    x = spark.createDataFrame([(str(k), "abc"[k % 17 % 3] if k % 5 else None) for k in range(503)], "ID string, label string")
    n = {(r.label, r.fold): r["count"] for r in ranks.stratified_folds(x, "label", "ID", 5).groupBy("label", "fold").count().collect()}
    for label in (None, "a", "b", "c"):
        own = [n[label, f] for f in range(5)]
        assert max(own) - min(own) <= 1
    assert max(sum(n[c, f] for c in (None, "a", "b", "c")) for f in range(5)) == 101


@pytest.mark.parametrize("bound, pivots", [(20_000, 256), (20, 4), (1, 3)])
def test_quantiles_are_exact(spark, monkeypatch, bound, pivots):
    """Also when hardly any value may come to the driver and a round has few pivots; ties, tails and nulls."""
    monkeypatch.setattr(ranks, "BOUND", bound), monkeypatch.setattr(ranks, "PIVOTS", pivots)
    rng = random.Random(2)
    n = 400
    columns = {"a": [rng.gauss(0, 1) for _ in range(n)], "b": [rng.choice([1.0, 1.0, 1.0, 2.0, 7.0]) for _ in range(n)], "c": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(n)], "d": [None if rng.random() < 0.4 else float(rng.randint(0, 9)) for _ in range(n)]}
    shares = [0.0, 0.013, 0.25, 0.5, 0.99, 1.0]
    df = spark.createDataFrame(list(zip(*columns.values())), "a double, b double, c double, d double").repartition(3)
    for c, got in ranks.quantiles(df, {c: shares for c in columns}).items():
        want = np.quantile(np.array([v for v in columns[c] if v is not None]), shares)
        assert np.allclose(got, want, rtol=1e-12, atol=0), c
    none = spark.createDataFrame([(None,)], "a double")
    assert ranks.quantiles(none, {"a": [0.5]}) == {"a": [None]} and ranks.median(none.limit(0), "a") is None


def test_words_and_payloads(spark):
    x = spark.createDataFrame([("Hello, world! hello",), ("(a,b!c) _x- -- été.",), (None,)], "t string")
    assert {r.word: r.n for r in profile.top_words(x, "t", None).collect()} == {"hello": 2, "world": 1, "a,b!c": 1, "_x": 1, "été": 1}
    assert profile.top_words(x, "t", 1).first().word == "hello" and profile.top_targets(x, "t", 1).first().t is None
    f = spark.createDataFrame([("((",), ('""x',), ("aab",), ("",), ("!?",)], "t string")
    got = {r.t: (r.repeated_marks, r.max_run) for r in profile.label_features(f, "t").collect()}
    assert got == {"((": (True, 2), '""x': (True, 2), "aab": (False, 2), "": (False, 1), "!?": (False, 1)}
    assert profile.id_integrity(spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string"), "k").first().asDict() == {"rows": 4, "unique_ids": 3, "duplicate_id_rows": 2, "missing_id_rows": 1, "duplicate_ids": 1}
    for payload, want in {'{"text": 5}': "5", '{"text": null}': "None", "[{'label': 'x'}]": "x", "[]": "[]", "{}": "{}", "5": "5", '"q"': "q", "((1, 2))": "((1, 2))", "[['a'], 'b']": "a", '{"other": 1}': '{"other": 1}'}.items():
        assert readers.payload_text(payload) == want


def test_sizes_must_be_positive(spark):
    from quillspark.functions import text as T

    wide = lambda w, h: spark.range(1).select(T.resized_width(F.lit(w), F.lit(h), 10, None).alias("w")).first().w
    assert wide(40.0, 20.0) == 20
    for w, h in ((0.0, 5.0), (5.0, 0.0), (-1.0, 5.0)):
        with pytest.raises(Exception, match="not an image"):
            wide(w, h)


def test_run_grid(spark):
    from quillspark.operators import integrity

    got = integrity.grid(spark, fold=[0, 1], beam=[5, 10, 20])
    assert got.count() == 6 and {r.run_name for r in got.where("fold = 1").collect()} == {"fold1_beam5", "fold1_beam10", "fold1_beam20"}
