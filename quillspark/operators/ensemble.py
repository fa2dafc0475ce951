"""Ensembles over a long table (ID, source_idx, source, text): A-08 to A-12, J-05, J-06, P-06.

A row's candidates are as many as there are sources, so each operator gathers them in one exchange by ID
and decides in array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILLED = r"(?U)[^\s\x1c-\x1f]"


def majority(long: DataFrame) -> DataFrame:
    """A-08: the most frequent non-empty text; ties go to the first source; empty if all are."""
    filled = long.where(F.col("text").rlike(FILLED)).groupBy("ID", "text").agg(F.count("*").alias("votes"), F.min("source_idx").alias("idx"))
    best = filled.groupBy("ID").agg(F.max_by("text", F.struct("votes", -F.col("idx"))).alias("text"), F.max("votes").alias("votes"))
    return long.select("ID").distinct().join(best, "ID", "left").select("ID", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("votes", F.lit(0)).alias("votes"))


def gathered(long: DataFrame) -> DataFrame:
    """(ID, c): each ID's candidates (idx, source, text) in the order of sources; null texts are empty."""
    one = F.struct(F.col("source_idx").alias("idx"), F.col("source"), F.coalesce("text", F.lit("")).alias("text"))
    return long.groupBy("ID").agg(F.array_sort(F.collect_list(one)).alias("c"))


def with_source(long: DataFrame) -> DataFrame:
    return long if "source" in long.columns else long.withColumn("source", F.col("source_idx").cast("string"))


def middle(lengths: Column) -> Column:
    """The median of an array of numbers; null of an empty one."""
    s, n = F.array_sort(lengths), F.size(lengths)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def audited(x: DataFrame, anchor: Column, strategy: Column) -> DataFrame:
    """A-12: the columns of an audit; x: (ID, text, chosen_source, top_text, votes, candidates, median_len)."""
    return x.select("ID", anchor.alias("anchor_text"), "text", "chosen_source", strategy.alias("strategy"), (F.col("text") != anchor).alias("changed"), "top_text", "votes", "candidates", F.length(anchor).cast("long").alias("anchor_len"), F.length("text").cast("long").alias("chosen_len"), "median_len", (F.length("text") - F.length(anchor)).cast("long").alias("len_change"))


def keep_anchor(long: DataFrame) -> DataFrame:
    """A-12: the anchor (source 0) unchanged, with its audit."""
    t = F.coalesce("text", F.lit(""))
    x = with_source(long).where("source_idx = 0")
    return x.select("ID", t.alias("anchor_text"), t.alias("text"), F.col("source").alias("chosen_source"), F.lit("anchor").alias("strategy"), F.lit(False).alias("changed"), F.lit(0).cast("long").alias("votes"), F.lit(0).cast("long").alias("candidates"), F.length(t).cast("long").alias("anchor_len"), F.length(t).cast("long").alias("chosen_len"))


def consensus(long: DataFrame, least: int = 3, length_delta: int | None = None, outlier_delta: int | None = None) -> DataFrame:
    """A-09, A-10, A-12: replaces the anchor by the text that most other sources give (ties: the earliest
    source's), where least of them do and each guard that is set holds: lengths differ by length_delta at
    most, and the anchor's length is outlier_delta or more off the candidates' median. Gives the audit."""
    x = gathered(with_source(long)).select("ID", F.get("c", F.lit(0)).alias("a"), F.filter("c", lambda r: (r["idx"] > 0) & r["text"].rlike(FILLED)).alias("f"))
    same = lambda t: F.filter("f", lambda r: r["text"] == t)
    votes = F.transform(F.array_distinct(F.transform("f", lambda r: r["text"])), lambda t: F.struct(F.size(same(t)).cast("long").alias("votes"), (-F.array_min(F.transform(same(t), lambda r: r["idx"]))).alias("first"), t.alias("text")))
    x = x.select("ID", "f", F.col("a.text").alias("anchor"), F.col("a.source").alias("own"), F.array_max(votes).alias("top"))
    x = x.select("ID", "f", "anchor", "own", F.col("top.text").alias("best"), F.coalesce("top.votes", F.lit(0)).alias("votes"), F.coalesce(middle(F.transform("f", lambda r: F.length(r["text"]))), F.length("anchor").cast("double")).alias("median_len"))
    ok = F.col("best").isNotNull() & (F.col("votes") >= least) & (F.col("best") != F.col("anchor"))
    if length_delta is not None:
        ok &= F.abs(F.length("best") - F.length("anchor")) <= length_delta
    if outlier_delta is not None:
        ok &= F.abs(F.length("anchor") - F.col("median_len")) >= outlier_delta
    x = x.withColumn("ok", F.coalesce(ok, F.lit(False))).select("ID", "anchor", "ok", F.when(F.col("ok"), F.col("best")).otherwise(F.col("anchor")).alias("text"), F.when(F.col("ok"), F.array_join(F.transform(F.filter("f", lambda r: r["text"] == F.col("best")), lambda r: r["source"]), "+")).otherwise(F.col("own")).alias("chosen_source"), F.coalesce("best", F.lit("")).alias("top_text"), "votes", F.size("f").cast("long").alias("candidates"), "median_len")
    return audited(x, F.col("anchor"), F.when(F.col("ok"), "consensus_replace").otherwise("anchor"))


def weighted(long: DataFrame, weights: dict, priority: list | None = None) -> DataFrame:
    """A-11, A-12: the text of the greatest sum of its sources' weights (1 unless given, by source or index);
    ties go to the source first in priority (else to the first source), then to the text seen first; if all
    are empty the anchor stays. Gives the audit; votes is the sum."""
    long = with_source(long)

    def by(own: dict, other: Column) -> Column:
        out = other
        for k, v in own.items():
            out = F.when(F.col("source_idx" if isinstance(k, int) else "source") == k, v).otherwise(out)
        return out

    rank = by({k: i for i, k in enumerate(priority)}, F.lit(len(priority))) if priority else F.col("source_idx")
    one = F.struct(F.col("source_idx").alias("idx"), "source", F.coalesce("text", F.lit("")).alias("text"), by(weights, F.lit(1.0)).cast("double").alias("w"), rank.cast("int").alias("rank"))
    x = long.groupBy("ID").agg(F.array_sort(F.collect_list(one)).alias("c")).withColumn("f", F.filter("c", lambda r: r["text"].rlike(FILLED)))
    same = lambda t: F.filter("f", lambda r: r["text"] == t)
    sums = F.transform(F.array_distinct(F.transform("f", lambda r: r["text"])), lambda t, i: F.struct(F.aggregate(same(t), F.lit(0.0), lambda s, r: s + r["w"]).alias("score"), (-F.array_min(F.transform(same(t), lambda r: r["rank"]))).alias("rank"), (-i).alias("seen"), t.alias("text")))
    x = x.select("ID", "c", "f", F.get("c", F.lit(0)).alias("a"), F.array_max(sums).alias("top"))
    text = F.coalesce("top.text", "a.text")
    x = x.select("ID", F.col("a.text").alias("anchor"), text.alias("text"), F.when(F.col("top").isNull(), F.col("a.source")).otherwise(F.array_join(F.transform(F.filter("f", lambda r: r["text"] == F.col("top.text")), lambda r: r["source"]), "+")).alias("chosen_source"), text.alias("top_text"), F.coalesce("top.score", F.lit(0.0)).alias("votes"), F.size("c").cast("long").alias("candidates"), middle(F.transform("c", lambda r: F.length(r["text"]))).alias("median_len"))
    return audited(x, F.col("anchor"), F.lit("weighted_vote"))


def require_same_ids(anchor: DataFrame, candidates: dict[str, DataFrame]) -> None:
    """J-05: raises with the first missing and extra IDs of a candidate whose IDs aren't the anchor's. All tables go
    through one exchange by ID, in which an ID has a bit for each table; at most 62 candidates."""
    x = anchor.select("ID", F.lit(1).cast("long").alias("bit"))
    for k, df in enumerate(candidates.values(), 1):
        x = x.unionByName(df.select("ID", F.lit(1 << k).cast("long").alias("bit")))
    x = x.groupBy("ID").agg(F.bit_or("bit").alias("bits"))
    has = lambda k: F.col("bits").bitwiseAND(F.lit(1 << k)) != 0
    sides = {"missing": lambda k: has(0) & ~has(k), "extra": lambda k: ~has(0) & has(k)}
    n = x.agg(*[F.count_if(f(k)).alias(f"{side}{k}") for k in range(1, len(candidates) + 1) for side, f in sides.items()]).first() if candidates else None
    for k, name in enumerate(candidates, 1):
        if n[f"missing{k}"] or n[f"extra{k}"]:
            missing, extra = ([r["ID"] for r in x.where(f(k)).orderBy("ID").limit(5).collect()] for f in sides.values())
            raise ValueError(f"{name}: IDs differ from the anchor's; missing {missing}, extra {extra}")


def stacked(sources: dict[str, DataFrame]) -> DataFrame:
    """J-05: (ID, source_idx, source, text) of tables (ID, Target), in the given order; the first is the anchor."""
    parts = [df.select(F.col("ID").cast("string").alias("ID"), F.lit(k).alias("source_idx"), F.lit(name).alias("source"), F.coalesce("Target", F.lit("")).alias("text")) for k, (name, df) in enumerate(sources.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_same_order(sources: dict[str, DataFrame]) -> None:
    """J-06: raises unless all tables (ID, pos) have the same ID at each place; one exchange of each by place."""
    first, *rest = sources
    x = None
    for k, df in enumerate(sources.values()):
        own = df.select("pos", F.lit(k).alias("k"), F.struct("ID").alias("id"))
        x = own if x is None else x.unionByName(own)
    at = lambda k: F.first(F.when(F.col("k") == k, F.col("id")), True)
    x = x.groupBy("pos").agg(*[at(k).alias(f"id{k}") for k in range(len(sources))])
    bad = x.agg(*[F.min(F.when(~F.col("id0").eqNullSafe(F.col(f"id{k}")), F.col("pos"))).alias(f"p{k}") for k in range(1, len(sources))]).first() if rest else ()
    for name, pos in zip(rest, bad):
        if pos is not None:
            raise ValueError(f"{name}: its IDs aren't in the order of {first}'s, from place {pos} on")
