"""Runs that stop half-way and go on."""

import json

import pytest
from pyspark.sql import functions as F
from quillspark.streaming.resume import Resumable

KIND = "ID string, text string"


def upper(x):
    return x.withColumn("text", F.upper("text"))


@pytest.fixture
def todo(spark):
    return spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(60)] + [(None, "null id")], KIND)


def check(spark, rows, todo):
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, upper(todo).collect()))


def test_stopped_and_restarted(spark, tmp_path, todo):
    r = Resumable(spark, str(tmp_path / "o"), "ID", KIND)
    first = r.run(todo, upper, waves=4, most=2)
    n = first.count()
    assert 0 < n < 61 and r.pending(todo).count() == 61 - n
    seen = []
    again = Resumable(spark, str(tmp_path / "o"), "ID", KIND).run(todo, lambda x: seen.append(x.count()) or upper(x), waves=2)
    check(spark, again, todo)
    assert sum(seen) == 61 - n  # nothing is done twice
    assert r.run(todo, upper).count() == 61


def test_work_that_fails(spark, tmp_path, todo):
    r = Resumable(spark, str(tmp_path / "o"), "ID", KIND)
    torn = lambda x: x.withColumn("text", F.when(F.col("ID") == "k7", F.raise_error(F.lit("no k7")).cast("string")).otherwise(F.upper("text")))
    with pytest.raises(Exception, match="no k7"):
        r.run(todo, torn, waves=5)
    before = r.finished().count()
    assert before < 61 and r.finished().where("ID = 'k7'").count() == 0
    check(spark, r.run(todo, upper), todo)


def test_a_wave_that_was_not_finished(spark, tmp_path, todo):
    """Rows without their line in the ledger, as a run leaves them that dies between the two."""
    r = Resumable(spark, str(tmp_path / "o"), "ID", KIND)
    upper(todo.limit(20)).write.parquet(f"{tmp_path}/o/rows/run-lost")
    assert r.finished().count() == 0
    check(spark, r.run(todo, upper, waves=3), todo)
    r.put(upper(todo), r.waves()[0])  # known waves are left alone
    check(spark, r.finished(), todo)


def test_stream_of_files(spark, tmp_path):
    drop, out = tmp_path / "in", tmp_path / "o"
    drop.mkdir()
    r = Resumable(spark, str(out), "ID", KIND)
    put = lambda name, ids: (drop / name).write_text("".join(json.dumps({"ID": i, "text": f"t {i}"}) + "\n" for i in ids))
    stream = lambda: spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(drop))
    put("1", "abc")
    put("2", "cde")
    calls = []

    def flaky(x):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return upper(x)

    with pytest.raises(Exception, match="lost"):
        r.follow(stream(), flaky).awaitTermination()
    assert r.finished().count() == 3
    put("3", "aef")
    r.follow(stream(), flaky).awaitTermination()
    r.follow(stream(), flaky).awaitTermination()
    assert sorted(tuple(x) for x in r.finished().collect()) == [(i, f"T {i.upper()}") for i in "abcdef"]
