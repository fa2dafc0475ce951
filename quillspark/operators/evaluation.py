"""Evaluation: alignment, edit scripts, row errors, corpus rates, grouped slices (J-02 to J-04, J-07, A-01 to A-07, P-03, P-04, P-07 to P-09)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .. import ship
from ..functions.text import digit_ratio, normalize_text, punctuation_ratio, words
from ..shared import spread, written

MATCH, SUBSTITUTE, DELETE, INSERT = range(4)
NAMES = ("match", "substitute", "delete", "insert")
KINDS = [f"{u}_{k}" for u in ("char", "word") for k in ("insertions", "deletions", "substitutions")]
#: Fixed value: the symbols that count as rare.
RARE = "^*#|\\"


def require_columns(df: DataFrame, names: list[str], label: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{label}: missing columns {', '.join(missing)}")
    return df


def align(truth: DataFrame, predictions: DataFrame, subset: bool = False) -> DataFrame:
    """J-02, J-03, P-04: (ID, reference, prediction); raises on repeated, unknown or missing ids; with
    subset only the predicted IDs of truth count. A null ID is an ID.

    Both tables go through one exchange by ID and are written once; what is wrong is counted as they are written, and
    looked up only if there is any."""
    sides = []
    for k, (df, label) in enumerate(((truth, "truth"), (predictions, "predictions"))):
        require_columns(df, ["ID", "Target"], label)
        sides.append(df.select(F.col("ID"), F.lit(k).alias("side"), F.col("Target").cast("string").alias("text")))
    of = lambda k: F.col("side") == k
    both = sides[0].unionByName(sides[1]).groupBy("ID").agg(*[F.count_if(of(k)).alias(f"n{k}") for k in (0, 1)], *[F.first(F.when(of(k), F.col("text")), True).alias(n) for k, n in enumerate(("reference", "prediction"))])
    both = both.where("n1 > 0 or n0 > 1") if subset else both
    wrong = {"truth: repeated": "n0 > 1", "predictions: repeated": "n1 > 1", "unknown": "n0 = 0", "missing": "n1 = 0"}
    seen = Observation()
    out = written(both.observe(seen, *[F.count_if(F.expr(c)).alias(f"w{k}") for k, c in enumerate(wrong.values())]))
    for (what, condition), n in zip(wrong.items(), (seen.get[f"w{k}"] for k in range(len(wrong)))):
        if n:
            raise ValueError(f"{what} IDs {[r['ID'] for r in out.where(condition).orderBy('ID').limit(10).collect()]}")
    return out.select("ID", "reference", "prediction")


def scripts(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = 8_000_000) -> list[list[tuple[int, int, int]]]:
    """A-02: for each pair of code arrays its steps (op, place in the first, place in the second) from the
    end; ties go to match, substitute, delete, insert in that order. Pairs of like lengths go together, so
    that a row of the table is one numpy step for all of them; what they end with alike is a match anyway. A pair
    whose table has more than so many cells is aligned by itself in less memory."""
    out: list = [None] * len(pairs)
    tails = []
    for a, b in pairs:
        n = min(len(a), len(b))
        same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
        tails.append(n if same.all() else int(same.argmin()))
    left = []
    for k, (a, b) in enumerate(pairs):
        n, m = len(a) - tails[k], len(b) - tails[k]
        if (n + 1) * (m + 1) > cells:  # a table of its own would be too large
            own = [(MATCH, len(a) - 1 - s, len(b) - 1 - s) for s in range(tails[k])]
            out[k] = own + long_script(a[:n], b[:m], cells)
        else:
            left.append(k)
    left = sorted(left, key=lambda k: (len(pairs[k][0]) - tails[k], len(pairs[k][1]) - tails[k]))
    while left:
        some, n, m = [], 0, 0
        while left:
            a, b = (len(x) - tails[left[-1]] for x in pairs[left[-1]])
            if some and (len(some) + 1) * (max(n, a) + 1) * (max(m, b) + 1) > cells:
                break
            n, m = max(n, a), max(m, b)
            some.append(left.pop())
        x, y = np.full((len(some), n), -1, np.int64), np.full((len(some), m), -2, np.int64)
        for r, k in enumerate(some):
            a, b = (c[: len(c) - tails[k]] for c in pairs[k])
            x[r, : len(a)], y[r, : len(b)] = a, b
        way = np.empty((len(some), n + 1, m + 1), np.uint8)
        way[:, 0], way[:, :, 0] = INSERT, DELETE
        steps = np.arange(m + 1)
        above = np.broadcast_to(steps, (len(some), m + 1))
        for i in range(1, n + 1):
            differ = x[:, i - 1 : i] != y
            both = above[:, :-1] + differ
            row = np.concatenate([np.full((len(some), 1), i), np.minimum(both, above[:, 1:] + 1)], axis=1)
            row = np.minimum.accumulate(row - steps, axis=1) + steps
            way[:, i, 1:] = np.where(row[:, 1:] == both, differ, np.where(row[:, 1:] == above[:, 1:] + 1, DELETE, INSERT))
            above = row
        for r, k in enumerate(some):
            a, b = pairs[k]
            i, j, t, own = len(a) - tails[k], len(b) - tails[k], tails[k], []
            own += [(MATCH, len(a) - 1 - s, len(b) - 1 - s) for s in range(t)]
            w = way[r]
            while i or j:
                op = int(w[i, j])
                i, j = i - (op != INSERT), j - (op != DELETE)
                own.append((op, i, j))
            out[k] = own
    return out


FAR = np.int32(1 << 30)


def banded(row: np.ndarray, i: int, a: np.ndarray, b: np.ndarray, band: int, ways: np.ndarray | None) -> np.ndarray:
    """The row of the table below row i - 1, of its places j = i - band to i + band; the choices go to ways."""
    j = np.arange(i - band, i + band + 1)
    inside = (j >= 1) & (j <= len(b))
    differ = np.ones(len(j), bool)
    differ[inside] = b[j[inside] - 1] != a[i - 1]
    both = np.where(inside, row + differ, FAR)
    above = np.append(row[1:], FAR) + 1  # of the same j
    out = np.where((j >= 0) & (j <= len(b)), np.minimum(both, above), FAR)
    if i <= band:
        out[band - i] = i  # j = 0
    steps = np.arange(len(j), dtype=np.int32)
    out = np.minimum(np.minimum.accumulate(out - steps) + steps, FAR).astype(np.int32)
    out[j > len(b)] = FAR
    if ways is not None:
        ways[:] = np.where(out == both, differ, np.where(out == above, DELETE, INSERT))
        if i <= band:
            ways[band - i] = DELETE
    return out


def long_script(a: np.ndarray, b: np.ndarray, cells: int) -> list[tuple[int, int, int]]:
    """The steps of one pair from the end, as by the whole table, in memory that grows with the texts and not with
    their product.

    Every best way keeps within as many places of the diagonal as there are edits, so a band doubles until
    the distance is within it. One row of the table in every so many is kept; from the last of them on, the
    choices between two kept rows are made again and followed back."""
    n, m = len(a), len(b)
    band = max(64, abs(n - m))
    while True:
        band = min(band, max(n, m))
        every = max(1, min(int(n**0.5) + 1, cells // (2 * band + 1)))
        j = np.arange(-band, band + 1)
        row = np.where((j >= 0) & (j <= m), j, FAR).astype(np.int32)
        kept = [row]
        for i in range(1, n + 1):
            row = banded(row, i, a, b, band, None)
            if i % every == 0:
                kept.append(row)
        if row[m - n + band] <= band or band >= max(n, m):
            break
        band *= 2
    i, j, out = n, m, []
    for k in range(n // every, -1, -1):
        top = k * every
        if i > top:
            row, ways = kept[k], np.empty((i - top, 2 * band + 1), np.uint8)
            for r in range(top + 1, i + 1):
                row = banded(row, r, a, b, band, ways[r - top - 1])
        while i > top:
            op = int(ways[i - top - 1, j - i + band])
            i, j = i - (op != INSERT), j - (op != DELETE)
            out.append((op, i, j))
        kept.pop() if len(kept) > k else None
    out += [(INSERT, 0, c) for c in range(j - 1, -1, -1)]
    return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def word_codes(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    known: dict = {}
    return tuple(np.array([known.setdefault(w, len(known)) for w in t.split()], np.int64) for t in (a, b))


def edit_script(source, target) -> list[tuple]:
    """A-02: (op, ref, pred) steps of two sequences, from the front."""
    known: dict = {}
    a, b = (np.array([known.setdefault(x, len(known)) for x in s], np.int64) for s in (source, target))
    return [(NAMES[op], source[i] if op != INSERT else "", target[j] if op != DELETE else "") for op, i, j in scripts([(a, b)])[0][::-1]]


@F.pandas_udf(ArrayType(StructType([StructField(c, StringType()) for c in ("op", "ref", "pred")])))
def edits_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """The steps that aren't matches; null texts (equal pairs) have none."""
    on = [(x, y) for x, y in zip(a, b) if x is not None]
    got = iter(scripts([(codes(x), codes(y)) for x, y in on]))
    return pd.Series([None if x is None else [{"op": NAMES[op], "ref": x[i] if op != INSERT else "", "pred": y[j] if op != DELETE else ""} for op, i, j in next(got) if op] for x, y in zip(a, b)])


@F.pandas_udf(StructType([StructField(c, LongType()) for c in KINDS]))
def kinds_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Insertions, deletions and substitutions of characters and of words; zeros for null texts (equal pairs)."""
    out = np.zeros((len(a), 6), np.int64)
    on = [k for k, x in enumerate(a) if x is not None]
    for at, make in ((0, lambda x, y: (codes(x), codes(y))), (3, word_codes)):
        for k, own in zip(on, scripts([make(a[k], b[k]) for k in on])):
            n = np.bincount([op for op, _, _ in own], minlength=4)
            out[k, at : at + 3] = n[INSERT], n[DELETE], n[SUBSTITUTE]
    return pd.DataFrame(out, columns=KINDS)


def prepared(pairs: DataFrame) -> DataFrame:
    """The normalised texts, and the pairs that differ for Python (null where equal, so that those stay in the JVM). Pairs are
    dealt out evenly, since edits are much work for few bytes."""
    ship(pairs.sparkSession)
    p = spread(pairs).select("ID", normalize_text(F.col("reference")).alias("reference"), normalize_text(F.col("prediction")).alias("prediction"))
    return p.withColumns({c[0]: F.when(F.col("reference") != F.col("prediction"), F.col(c)) for c in ("reference", "prediction")})


def rate(edits: Column, units: Column) -> Column:
    return F.when(units > 0, edits / units).otherwise(F.when(edits == 0, 0.0).otherwise(1.0))


def row_errors(pairs: DataFrame) -> DataFrame:
    """A-03, A-04: all 18 columns; texts are normalised and null is empty."""
    p = prepared(pairs).withColumn("k", kinds_udf("r", "p")).drop("r", "p")
    p = p.withColumns({"ref_char_len": F.length("reference").cast("long"), "pred_char_len": F.length("prediction").cast("long"), "ref_word_len": F.size(words(F.col("reference"))).cast("long"), "pred_word_len": F.size(words(F.col("prediction"))).cast("long")})
    own = [F.col(f"k.{c}") for c in KINDS]
    edits = {u: F.col(f"k.{u}_insertions") + F.col(f"k.{u}_deletions") + F.col(f"k.{u}_substitutions") for u in ("char", "word")}
    return p.select("ID", "reference", "prediction", (F.col("reference") == F.col("prediction")).alias("exact_match"), "ref_char_len", "pred_char_len", "ref_word_len", "pred_word_len", edits["char"].alias("char_edits"), *own[:3], rate(edits["char"], F.col("ref_char_len")).alias("row_cer"), edits["word"].alias("word_edits"), *own[3:], rate(edits["word"], F.col("ref_word_len")).alias("row_wer"))


def edit_counts(pairs: DataFrame) -> DataFrame:
    """A-02: insertions, deletions and substitutions of characters by row."""
    return row_errors(pairs).select("ID", *[F.col(f"char_{k}").alias(k) for k in ("insertions", "deletions", "substitutions")])


def confusions(pairs: DataFrame) -> DataFrame:
    """A-06: counts of the steps that aren't matches; (op, ref_char, pred_char) is bounded by the alphabet."""
    s = prepared(pairs).where("r is not null").select(F.explode(edits_udf("r", "p")).alias("s"))
    return s.groupBy(F.col("s.op").alias("op"), F.col("s.ref").alias("ref_char"), F.col("s.pred").alias("pred_char")).agg(F.count("*").alias("n"))


def corpus_summary(rows: DataFrame) -> DataFrame:
    """A-01, A-05: rates over the corpus, means over rows, totals of each kind of edit."""
    totals = [F.sum(c).alias(c) for c in ("char_insertions", "char_deletions", "char_substitutions", "word_insertions", "word_deletions", "word_substitutions")]
    s = rows.agg(F.count("*").alias("row_count"), F.sum(F.col("exact_match").cast("long")).alias("exact_rows"), F.round(F.avg(F.col("exact_match").cast("double")), 6).alias("exact_rate"), F.sum("char_edits").alias("char_edits"), F.sum("ref_char_len").alias("ref_chars"), F.sum("word_edits").alias("word_edits"), F.sum("ref_word_len").alias("ref_words"), *totals, F.round(F.avg("row_cer"), 6).alias("mean_row_cer"), F.round(F.avg("row_wer"), 6).alias("mean_row_wer"))
    cer, wer = rate(F.col("char_edits"), F.col("ref_chars")), rate(F.col("word_edits"), F.col("ref_words"))
    return s.withColumns({"cer": F.round(cer, 6), "wer": F.round(wer, 6), "score": F.round(0.5 * cer + 0.5 * wer, 6)})


def slices(rows: DataFrame, rare: str = RARE) -> DataFrame:
    """P-07 to P-09: the columns by which errors are grouped; aspect_group where rows have an aspect_ratio."""
    n = F.col("ref_char_len")
    symbols = F.array(*[F.lit(c) for c in rare])
    out = rows.withColumns({
        "length_group": F.when(n <= 39, "short").when(n <= 80, "medium").when(n <= 10000, "long").otherwise("nan"),
        "has_rare_symbol": F.arrays_overlap(F.split("reference", ""), symbols) if rare else F.lit(False),
        "punctuation_heavy": punctuation_ratio(F.col("reference")) >= 0.08, "digit_heavy": digit_ratio(F.col("reference")) >= 0.08,
        "prediction_shorter": F.col("pred_char_len") < n, "prediction_longer": F.col("pred_char_len") > n,
    })
    if "aspect_ratio" in rows.columns:
        a = F.col("aspect_ratio")
        out = out.withColumn("aspect_group", F.when((a > -1) & (a <= 12), "low_ar").when((a > 12) & (a <= 22), "mid_ar").when((a > 22) & (a <= 10000), "high_ar").otherwise("nan"))
    return out


GROUPS = ("length_group", "has_rare_symbol", "punctuation_heavy", "digit_heavy", "prediction_shorter", "prediction_longer", "aspect_group")


def grouped(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A-07: one group-by for each key, side by side, by grouping sets; nulls are a group of their own."""
    keys = [k for k in keys or GROUPS if k in rows.columns]
    text = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], "row_cer", "row_wer", F.col("exact_match").cast("double").alias("exact_match"), "char_edits")
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    out = text.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.array(*[F.grouping(k) for k in keys]).alias("g"), F.count("*").alias("n"), mean("row_cer", "mean_row_cer"), mean("row_wer", "mean_row_wer"), mean("exact_match", "exact_match_rate"), mean("char_edits", "mean_char_edits"))
    at = F.array_position("g", 0).cast("int")
    return out.select(F.get(F.array(*[F.lit(k) for k in keys]), at - 1).alias("group_name"), F.get(F.array(*[F.col(k) for k in keys]), at - 1).alias("group_value"), "n", "mean_row_cer", "mean_row_wer", "exact_match_rate", "mean_char_edits")
