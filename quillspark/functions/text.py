"""Text functions: Column in, Column out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that Python's str methods know.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalize_text(c: Column, lower: bool = False, remove_punctuation: bool = False) -> Column:
    """T-01, T-02: collapses white space and strips; null becomes empty."""
    squeeze = lambda x: F.trim(F.regexp_replace(x, SPACE, " "))
    c = squeeze(F.coalesce(c.cast("string"), F.lit("")))
    c = F.lower(c) if lower else c
    return squeeze(F.regexp_replace(c, r"[^A-Za-z0-9\s]", "")) if remove_punctuation else c


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda w: w != "")


def word_len(c: Column) -> Column:
    """P-01."""
    return F.size(words(c))


def tokenize(c: Column) -> Column:
    """T-07: characters joined by a space, the space itself as a symbol."""
    return F.array_join(F.transform(chars(c), lambda x: F.when(x == " ", "<space>").otherwise(x)), " ")


def detokenize(c: Column, keep_unknown: bool = False) -> Column:
    """T-08: the inverse, without unknown symbols unless these are kept."""
    parts = F.filter(F.split(c, " "), lambda x: (x != "") if keep_unknown else (x != "<unk>") & (x != ""))
    return normalize_text(F.array_join(F.transform(parts, lambda x: F.when(x == "<space>", " ").otherwise(x)), ""))


def punctuation_ratio(c: Column) -> Column:
    """T-10."""
    return F.regexp_count(c, F.lit(r"[^\p{L}\p{N}\s]")) / F.greatest(F.length(c), F.lit(1))


def digit_ratio(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{Nd}")) / F.greatest(F.length(c), F.lit(1))


def repeats(c: Column) -> Column:
    """W-07: adjacent equal characters."""
    runs = F.regexp_replace(c, r"(?s)(.)\1+", "$1")
    return F.coalesce(F.length(c) - F.length(runs), F.lit(0))


def resized_width(w: Column, h: Column, height: int, most: int | None) -> Column:
    """T-11; the order of operations is part of the result. Raises, when run, on a size of zero or less."""
    wide = F.greatest(F.lit(1.0), F.rint(w * (F.lit(float(height)) / h)))
    bad = F.raise_error(F.concat(F.lit("not an image's size: "), w.cast("string"), F.lit(" x "), h.cast("string"))).cast("double")
    return F.when((w <= 0) | (h <= 0), bad).otherwise(wide if most is None else F.least(wide, F.lit(float(most)))).cast("long")


def ctc_collapse(ids: Column, blank: int = 0) -> Column:
    """W-08: drops repeats, then blanks."""
    return F.filter(ids, lambda x, i: (x != blank) & ((i == 0) | (x != F.get(ids, i - 1))))


def unicode_form(c: Column, form: str = "NFC") -> Column:
    """T-03: the text in a Unicode form (NFC, NFD, NFKC, NFKD), or as it is (preserve). ASCII texts don't go to Python."""
    if form == "preserve":
        return c

    @F.pandas_udf("string")
    def change(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return F.when(c.rlike(r"[^\x00-\x7F]"), change(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def symbol_list(alphabet: Column, unknown: bool = True) -> Column:
    """T-09: the blank, the sorted characters without the space, the unknown symbol if wanted, the space; raises,
    when run, if the alphabet holds one of these symbols itself."""
    own = ["<ctc>"] + (["<unk>"] if unknown else []) + ["<space>"]
    plain = F.array_sort(F.array_except(alphabet, F.array(F.lit(" "))))
    both = F.array_intersect(alphabet, F.array(*[F.lit(x) for x in own]))
    every = F.concat(F.array(F.lit(own[0])), plain, F.array(*[F.lit(x) for x in own[1:]]))
    return F.when(F.size(both) > 0, F.raise_error(F.concat(F.lit("symbols in the alphabet: "), F.array_join(both, " ")))).otherwise(every)


def text_features(c: Column) -> list[Column]:
    """P-01: char_len of the text as it is, and word_len."""
    return [F.length(c).cast("long").alias("char_len"), word_len(c).cast("long").alias("word_len")]
