"""CSV files: typed columns, values that need quoting, the order of rows."""

import pytest
from pyspark.sql import functions as F

from quillspark.sources import readers, writers

ODD = ["plain", " a ", '"', '""', 'a "b", c', ",", "two\nlines", "win\r\ndows", "\\", '\\"', "\ttab", "é 字", "#x", "'", "NA", "0012"]


def test_values_come_back(spark, tmp_path):
    rows = list(enumerate(ODD))
    writers.csv(spark.createDataFrame(rows + [(98, ""), (99, None)], "ID long, Target string"), str(tmp_path / "m"))
    x = readers.manifest(spark, str(tmp_path / "m"), "ID long, Target string")
    assert x.dtypes == [("ID", "bigint"), ("Target", "string")]
    got = {r.ID: r.Target for r in x.collect()}
    assert {k: got[k] for k, _ in rows} == dict(rows) and got[98] is None and got[99] is None


def test_schema_by_name(spark, tmp_path):
    spark.createDataFrame([("7", "x", "1.5")], "ID string, Target string, width string").write.csv(str(tmp_path / "m"), header=True)
    assert readers.manifest(spark, str(tmp_path / "m"), "width double, ID int").first() == (1.5, 7)
    with pytest.raises(ValueError, match="height"):
        readers.manifest(spark, str(tmp_path / "m"), "ID int, height int")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.manifest(spark, str(tmp_path / "m"), "Target int").collect()


def test_places_follow_parts_and_pieces(spark, tmp_path):
    """Several files a task, many tasks, and names that clash with the reader's own."""
    x = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("part_"), F.lit("a\nb").alias("row_"))
    writers.csv(x, str(tmp_path / "m"), ["k"], rows=37)
    assert len(list((tmp_path / "m").glob("part-*.csv"))) >= 27
    got = readers.in_order(spark, str(tmp_path / "m"), "k long, part_ long, row_ string").collect()
    assert len(got) == 1000 and all(r.k == r.place and r.part_ * 7919 % 1000 == r.k and r.row_ == "a\nb" for r in got)


def test_many_parts_by_number(spark, tmp_path):
    """Part 100000 comes after part 99999, which its name alone doesn't tell."""
    for part in ("part-99999-x-c000", "part-100000-x-c000", "part-100000-x-c001"):
        (tmp_path / f"{part}.csv").write_text(f"name\n{part}\n")
    got = {r.name: r.place for r in readers.in_order(spark, str(tmp_path)).collect()}
    assert got == {"part-99999-x-c000": 0, "part-100000-x-c000": 1, "part-100000-x-c001": 2}


def test_empty_table(spark, tmp_path):
    writers.csv(spark.createDataFrame([], "k long"), str(tmp_path / "m"), ["k"])
    assert readers.in_order(spark, str(tmp_path / "m"), "k long").count() == 0
