"""Profiles of labels and tables: P-11, P-12, T-14, T-19, A-19, A-23 to A-27."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, chars, normalize_text, word_len
from ..shared import written
from .ranks import number, quantiles


#: The Unicode categories.
CATEGORIES = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co Cn".split()
#: What isn't part of a word at its edges.
EDGE = r"[^\p{L}\p{N}_]+"


def label_features(df: DataFrame, text: str) -> DataFrame:
    """P-11: lengths, ratios and oddities of the normalised text. max_run is 1 where no character is repeated, even
    in an empty text; repeated_marks is any character of a category P twice in a row."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    x = df.withColumns({"raw": raw, "norm": normalize_text(raw)})
    n = F.greatest(F.length("norm"), F.lit(1))
    share = lambda p: F.regexp_count("norm", F.lit(p)) / n
    return x.withColumns({
        "char_len": F.length("norm"), "word_len": word_len(F.col("norm")), "edge_space": F.col("raw").rlike(r"(?U)^\s|\s\z"), "repeated_space": F.col("raw").rlike(r"(?U)\s{2,}"), "empty": F.col("norm") == "",
        "digit_ratio": share(r"\p{Nd}"), "alpha_ratio": share(r"\p{L}"), "punct_ratio": share(r"\p{P}"), "control": F.col("norm").rlike(r"\p{C}"), "non_ascii": F.col("norm").rlike(r"[^\x00-\x7F]"),
        "max_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all("norm", F.lit(r"((.)\2+)"), 1), F.length)), F.lit(1)), "repeated_marks": F.col("norm").rlike(r"(\p{P})\1"),
    }).drop("raw", "norm")


def label_flags(features: DataFrame) -> DataFrame:
    """P-12: nine flags of label_features and their number; the length's limits are its 1 % and 99 % quantiles."""
    features = written(features)  # read twice
    low, high = quantiles(features, {"char_len": [0.01, 0.99]})["char_len"]
    flags = {
        "flag_empty": F.col("empty"), "flag_whitespace": F.col("edge_space") | F.col("repeated_space"), "flag_control": F.col("control"), "flag_non_ascii": F.col("non_ascii"), "flag_very_short": F.col("char_len") <= number(low), "flag_very_long": F.col("char_len") >= number(high),
        "flag_low_alpha": F.col("alpha_ratio") < 0.55, "flag_repeated_chars": F.col("max_run") >= 4, "flag_repeated_marks": F.col("repeated_marks"),
    }
    x = features.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    return x.withColumn("n_flags", sum(F.col(c).cast("int") for c in flags))


def token_audit(df: DataFrame, tokens: Column, most: int) -> DataFrame:
    """T-14: token_count, over (more than most) and their excess."""
    return df.withColumn("token_count", tokens.cast("long")).withColumns({"over": F.col("token_count") > most, "excess": F.greatest(F.col("token_count") - most, F.lit(0)).cast("long")})


def token_summary(audit: DataFrame) -> DataFrame:
    """A-19: rows, extremes, median and 95 % quantile (linear) of token_count; rows over the limit."""
    t = F.col("token_count")
    middle, p95 = quantiles(audit, {"token_count": [0.5, 0.95]})["token_count"]
    return audit.agg(F.count("*").alias("n"), F.min(t).alias("least"), number(middle).alias("middle"), number(p95).alias("p95"), F.max(t).alias("most"), F.count_if("over").alias("n_over"))


def residuals(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """A-23: least squares of y on 1 and xs, of least norm where singular; nulls take no part and get null.

    One pass sums products, centred at the means first; the driver solves a system of len(xs) + 1."""
    own = df.dropna(subset=[y, *xs])
    mean = own.agg(*[F.avg(c).alias(c) for c in (y, *xs)]).first()
    if mean[0] is None:
        return df.withColumn("residual", F.lit(None).cast("double"))
    m = {c: F.col(c).cast("double") - mean[c] for c in (y, *xs)}
    sums = own.agg(*[F.sum(m[a] * m[b]) for a in xs for b in xs], *[F.sum(m[a] * m[y]) for a in xs]).first()
    k = len(xs)
    beta = np.linalg.lstsq(np.array(sums[: k * k]).reshape(k, k), np.array(sums[k * k :]), rcond=None)[0]
    return df.withColumn("residual", m[y] - sum((m[c] * float(b) for c, b in zip(xs, beta)), F.lit(0.0)))


def overview(df: DataFrame) -> DataFrame:
    """A-24: (name, kind, missing, missing_pct, distinct) of each column. Values travel as hashes of 128 bits, so that long
    texts aren't group keys."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(t).alias("kind"), F.md5(F.col(c).cast("string")).alias("v")) for c, t in df.dtypes])).alias("c"))
    by_value = cells.groupBy("c.name", "c.kind", "c.v").agg(F.count("*").alias("n"))
    gone = F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0))
    return by_value.groupBy("name", "kind").agg(gone.alias("missing"), (gone / F.sum("n")).alias("missing_pct"), F.count("v").alias("distinct"))


def category_counts(text: Column) -> Column:
    """T-19: a map of the Unicode categories that a text has characters of, and how many."""
    both = [F.struct(F.lit(c).alias("key"), F.regexp_count(text, F.lit(rf"\p{{{c}}}")).alias("value")) for c in CATEGORIES]
    return F.map_from_entries(F.filter(F.array(*both), lambda e: e["value"] > 0))


def describe(df: DataFrame, column: str) -> DataFrame:
    """A-25: count, mean, deviation, extremes and quartiles (linear) of a column."""
    c = F.col(column)
    shares = (0.25, 0.5, 0.75)
    q = quantiles(df, {column: list(shares)})[column]
    return df.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("deviation"), F.min(c).alias("least"), *[number(v).alias(f"p{int(100 * s)}") for s, v in zip(shares, q)], F.max(c).alias("most"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """A-25: (a, b, r) of all pairs of columns, in one pass."""
    cells = [(a, b) for a in columns for b in columns]
    one = df.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(cells)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{k}", 6).alias("r")) for k, (a, b) in enumerate(cells)])).alias("c")).select("c.*")


def tops(found: DataFrame, name: str, n: int | None) -> DataFrame:
    by = found.groupBy(name).agg(F.count("*").alias("n"))
    return by if n is None else by.orderBy(F.desc("n"), name).limit(n)


def top_words(df: DataFrame, text: str, n: int | None) -> DataFrame:
    """A-26: the n most frequent lower-case words (all, if n is None); ties in the words' order. A word is a stretch
    without white space, from its first letter, digit or low line to its last."""
    stretches = df.select(F.explode(F.split(F.lower(F.col(text)), SPACE)).alias("word"))
    return tops(stretches.select(F.regexp_replace("word", f"^{EDGE}|{EDGE}$", "").alias("word")).where("word != ''"), "word", n)


def top_chars(df: DataFrame, text: str, n: int | None) -> DataFrame:
    """A-26: the n most frequent characters, line feeds between texts not counted."""
    return tops(df.select(F.explode(chars(F.col(text))).alias("ch")), "ch", n)


def top_targets(df: DataFrame, text: str, n: int | None) -> DataFrame:
    """A-26: the n most frequent texts as they are, null among them. Groups are told by 128 bits, so that long texts don't
    go through the exchange for each row."""
    by = df.groupBy(F.md5(text).alias("digest")).agg(F.first(text).alias(text), F.count("*").alias("n")).drop("digest")
    return by if n is None else by.orderBy(F.desc("n"), F.asc_nulls_first(text)).limit(n)


def counted(df: DataFrame, column: str) -> DataFrame:
    """(missing, n) of the distinct values of a column; null is a value."""
    return df.groupBy(F.md5(F.col(column).cast("string")).alias("digest")).agg(F.count("*").alias("n")).select(F.col("digest").isNull().alias("missing"), "n")


def label_integrity(df: DataFrame, text: str) -> DataFrame:
    """A-27: rows, missing labels, labels empty once normalised, distinct exact labels, rows of labels that
    another row has too. A missing label is one value of its own."""
    empty = df.agg(F.count_if(normalize_text(F.col(text)) == "").alias("empty_after_normalize"))
    own = counted(df, text).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("missing_labels"), F.count("*").alias("unique_exact_labels"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicated_exact_label_rows"))
    return own.crossJoin(empty)  # one row each


def id_integrity(df: DataFrame, key: str) -> DataFrame:
    """A-27: rows, distinct ids, rows of ids that another row has too, missing ids, and by how many rows exceed ids."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    x = counted(df, key).agg(zero(F.sum("n")).alias("rows"), F.count("*").alias("unique_ids"), zero(F.sum(F.when(F.col("n") > 1, F.col("n")))).alias("duplicate_id_rows"), zero(F.sum(F.when(F.col("missing"), F.col("n")))).alias("missing_id_rows"))
    return x.withColumn("duplicate_ids", F.col("rows") - F.col("unique_ids"))
