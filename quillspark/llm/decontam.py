"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask of span 8 keeps token positions (0, 1, 3, 6, 7) and ignores the others. Every aligned window
of 13 tokens with two substitutions at most holds a position where the mask's five tokens all agree
(checked over all 78 pairs of positions in the tests), so that one mask loses no such overlap.
Items of fewer than 13 tokens are seeded as a whole: with s substitutions allowed, s + 1 masks keep every
(s + 1)-th token each, and s substitutions can't touch them all.
Hits are verified on their diagonal: some window of 13 tokens around the hit must agree in 11."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

MASK, WINDOW, AGREE = (0, 1, 3, 6, 7), 13, 11
SPAN = MASK[-1] + 1


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def allowed(size: int) -> int:
    """Substitutions in a window or in a whole shorter item: two, but five tokens agree at least, or all of fewer."""
    return max(0, min(WINDOW - AGREE, size - 5))


def masks(size: int) -> list[tuple[int, ...]]:
    """The masks of items of size tokens; those of WINDOW or more have the one that is moved along them."""
    return [tuple(range(k, size, allowed(size) + 1)) for k in range(allowed(size) + 1)] if size < WINDOW else [MASK]


def keys(words: Column, sizes: list[int]) -> Column:
    """The places and hashes of the masks for items of these sizes, at each place where they fit."""
    def at(size, k, mask):
        span = SPAN if size >= WINDOW else size
        places = F.transform(F.sequence(F.lit(0), F.size(words) - span), lambda i: F.struct(i.alias("place"), F.xxhash64(F.lit(16 * size + k), *[F.element_at(words, i + (1 + m)) for m in mask]).alias("key")))
        return F.when(F.size(words) >= span, places).otherwise(F.array().cast("array<struct<place int, key bigint>>"))

    return F.concat(*[at(size, k, mask) for size in sizes for k, mask in enumerate(masks(size))])


def agreement(words: Column, item: Column, diagonal: Column) -> Column:
    """The most agreeing tokens in a window of WINDOW (or of the whole item, if shorter) along a diagonal; null if none fits."""
    low = F.greatest(F.lit(0), -diagonal)
    high = F.least(F.size(item), F.size(words) - diagonal)
    size = F.least(F.lit(WINDOW), F.size(item))
    same = F.transform(F.sequence(low, F.greatest(low, high - 1)), lambda k: (F.element_at(item, k + 1) == F.element_at(words, k + diagonal + 1)).cast("int"))
    sums = lambda a: F.array_max(F.transform(F.sequence(F.lit(1), F.size(a) - size + 1), lambda k: F.aggregate(F.slice(a, k, size), F.lit(0), lambda s, x: s + x)))
    return F.when(high - low >= size, sums(same))


def leaks(docs: DataFrame, benchmark: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, n_agree): documents that hold a window of an item, with the most agreeing tokens of 13.

    Items of fewer than 13 tokens are compared over their whole length, with two substitutions at most
    and five agreeing tokens at least; those of up to five tokens must agree in all. Items without a
    token are in no document. Null texts have no tokens; rows with a null id are not told; repeated ids
    are told once. The benchmark is broadcast only if its items have no more than limit tokens, which are
    as many seeds at least as it has; beyond that the joins shuffle."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("item")).where(F.size("item") > 0)
    size = F.least(F.size("item"), F.lit(WINDOW))
    n = items.groupBy(size.alias("size")).agg(F.sum(F.size("item")).alias("n")).collect()  # WINDOW rows at most
    sizes, held = sorted(r["size"] for r in n), F.broadcast if sum(r["n"] for r in n) <= limit else lambda df: df
    if not sizes:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_agree")).where(F.lit(False))
    own = F.array().cast("array<struct<place int, key bigint>>")
    for s in sizes:
        own = F.when(size == s, keys(F.col("item"), [s])).otherwise(own)
    seeds = items.select("item_id", F.explode(own).alias("k")).select("item_id", F.col("k.place").alias("j"), F.col("k.key").alias("key"))
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # tokens are a column of their own: as a nested expression they would be made anew at each position
    at = known.select("doc_id", tokens(F.col("text")).alias("words")).select("doc_id", F.explode(keys(F.col("words"), sizes)).alias("k")).select("doc_id", F.col("k.place").alias("i"), F.col("k.key").alias("key"))
    hits = at.join(held(seeds), "key").groupBy("doc_id", "item_id").agg(F.collect_set(F.col("i") - F.col("j")).alias("diagonals"))
    asked = hits.join(held(items), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonals", "item")).alias("asked"))
    both = known.join(asked, "doc_id").select("doc_id", tokens(F.col("text")).alias("words"), "asked")
    most = lambda h: F.array_max(F.transform(h["diagonals"], lambda d: agreement(F.col("words"), h["item"], d)))
    told = both.select("doc_id", F.explode(F.transform("asked", lambda h: F.struct(h["item_id"].alias("item_id"), most(h).alias("n"), F.least(F.lit(WINDOW), F.size(h["item"])).alias("size")))).alias("h"))
    good = told.where(F.col("h.n") >= F.col("h.size") - F.greatest(F.lit(0), F.least(F.lit(WINDOW - AGREE), F.col("h.size") - 5)))
    return good.groupBy("doc_id", F.col("h.item_id").alias("item_id")).agg(F.max("h.n").cast("long").alias("n_agree"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of any item. Rows of one id are judged together, those with a null
    id each by its own text (all of equal texts alike)."""
    named, unnamed = docs.where("doc_id is not null"), docs.where("doc_id is null")
    found = leaks(named.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("leaking")).distinct()
    left = named.join(found, named.doc_id.cast("long") == found.leaking, "left_anti")
    # texts without an id are few; equal ones get one number, so that no hash stands for a text
    texts = unnamed.where("text is not null").groupBy("text").agg(F.count("*").alias("n")).select("text", F.monotonically_increasing_id().alias("doc_id"))
    texts = table(texts)
    bad = texts.join(leaks(texts, benchmark).select(F.col("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("text").alias("bad_text"))
    return left.unionByName(unnamed.join(bad, unnamed.text == bad.bad_text, "left_anti"))
