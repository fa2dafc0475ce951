"""What a task holds doesn't grow with the table: counts by row are made of rows that were dealt out."""

import re
from collections import Counter

from quillspark.operators import audit, evaluation
from quillspark.plans import stored
from quillspark.sources import writers


def plan(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def at(lines: list[str], pattern: str) -> int:
    return next(k for k, line in enumerate(lines) if re.search(pattern, line))


def test_char_frequency(spark):
    """Repeated rows, nulls, and more rows than one task takes; the exchange is below the counts."""
    rows = [(k // 2, f"a{'b' * (k % 3)}é") for k in range(400)] + [(None, "a𝒜"), (None, "a"), (7, None)]
    d = spark.createDataFrame(rows, "k long, t string")
    n, held = Counter(), {}
    for k, t in rows:
        n.update(t or "")
        for c in t or "":
            held.setdefault(c, set()).add(k)
    x = audit.char_frequency(d, "t", "k")
    assert {r.ch: (r.n, r.n_rows) for r in x.collect()} == {c: (n[c], len(held[c])) for c in n}
    lines = plan(x)
    assert at(lines, r"Aggregate \[k#\d+L?, ch#") < at(lines, "Generate explode") < at(lines, "RepartitionBy")


def test_rare_lines(spark):
    """Only rare characters are counted by line; lines of one key share what they hold."""
    rows = [(k, "ab ab") for k in range(30)] + [(40, "abx"), (40, "yab"), (41, "xzz"), (None, "x")]
    x = audit.rare_lines(spark.createDataFrame(rows, "k long, t string"), "t", "k", most=3)
    assert sorted((r.k, r.text, r.rare_chars, r.rare_char_count) for r in x.collect()) == [(40, "abx", "xy", 2), (40, "yab", "xy", 2), (41, "xzz", "xz", 3)]
    lines = plan(x)
    assert at(lines, r"Aggregate \[k#\d+L?, ch#") < at(lines, "Join LeftSemi")


def test_rare_lines_given(spark):
    """Given characters may be in every line: lines are dealt by key before they are counted. An empty choice finds none."""
    rows = [(k, "ab aab") for k in range(300)] + [(400, "xay"), (400, "ya"), (401, "xz"), (None, "a"), (402, None)]
    d = spark.createDataFrame(rows, "k long, t string")
    x = audit.rare_lines(d, "t", "k", rare="ay")
    want = [(k, "ab aab", "a", 3, 6) for k in range(300)] + [(400, "xay", "ay", 4, 3), (400, "ya", "ay", 4, 2)]
    assert sorted((r.k, r.text, r.rare_chars, r.rare_char_count, r.char_len) for r in x.collect()) == want
    lines = plan(x)
    below = lines[at(lines, r"Aggregate \[k#\d+L?, ch#"):]  # the other side of the join is above
    assert 0 < at(below, "Generate explode") < at(below, "RepartitionBy")
    assert audit.rare_lines(d, "t", "k", rare="").count() == 0


def test_row_errors_dealt_out(spark):
    """One task's pairs are aligned by several."""
    pairs = spark.createDataFrame([(str(k), f"ab{k}", f"ac{k}") for k in range(100)], "ID string, reference string, prediction string").coalesce(1)
    for x in (evaluation.row_errors(pairs), evaluation.confusions(pairs)):
        assert at(plan(x), "ArrowEvalPython") < at(plan(x), "Repartition 4")
    assert [r.char_edits for r in evaluation.row_errors(pairs).collect()] == [1] * 100


def test_edits_once_for_several_files(spark, tmp_path):
    """Row errors that a sort, a summary and groups read are written once, and read from there."""
    part = spark.createDataFrame([(k, f"name {k}", f"TYPE {k % 7}", f"Brand#{k % 5}") for k in range(60)], "p_partkey long, p_name string, p_type string, p_brand string")
    part.write.parquet(str(tmp_path / "part.parquet"))
    seen = []
    bundle, writers.grouped_bundle = writers.grouped_bundle, lambda rows, summary, path: (seen.extend((rows, summary)), bundle(rows, summary, path))
    try:
        assert stored.k03_grouped_files(spark, str(tmp_path)).count() > 0
    finally:
        writers.grouped_bundle = bundle
    assert len(seen) == 2 and not any("ArrowEvalPython" in line for x in seen for line in plan(x))
