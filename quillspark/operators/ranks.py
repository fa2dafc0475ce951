"""Row numbers and exact quantiles over tables of any size: W-04, W-06, W-10, A-18, A-19, A-22, A-25, O-03."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written

#: Values that one bracket of a rank may hold when they come to the driver.
BOUND = 20_000
#: Pivots of a round; a bracket holds about a 64th of the rows after it.
PIVOTS = 64


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that df lacks, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, order: str | list, pos: str = "pos") -> DataFrame:
    """Adds pos, from 0 in the given order; ties are numbered in any order, but once.

    A range sort is written with each row's partition and its place there, so what is counted is what is read
    again, however Spark joins partitions; the sums before each partition are a window over one row for each
    partition, and the only table that is broadcast."""
    part, row, before = fresh(df, "part", "row", "before")
    order = [order] if isinstance(order, (str, Column)) else list(order)
    x = written(df.orderBy(*order).withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id()}))
    first = x.groupBy(part).agg(F.count("*").alias("n"), F.min(row).alias("low"))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = first.select(part, (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("low")).alias(before))
    return x.join(F.broadcast(shift), part).withColumn(pos, F.col(row) + F.col(before)).drop(part, row, before)


def batches(df: DataFrame, order: str | list, size: int) -> DataFrame:
    """W-10: adds batch, the number of each group of size rows in the given order."""
    pos, = fresh(df, "pos")
    return numbered(df, order, pos).withColumn("batch", F.floor(F.col(pos) / size).cast("long")).drop(pos)


def window_of(df: DataFrame, order: str | list, offset: int = 0, limit: int | None = None) -> DataFrame:
    """S-17, O-03: rows from offset on, limit at most, in the given order. Rows are numbered, so no task holds those
    before the offset."""
    pos, = fresh(df, "pos")
    x = numbered(df, order, pos).where(F.col(pos) >= offset)
    return (x if limit is None else x.where(F.col(pos) < offset + limit)).drop(pos)


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """W-06: round robin within labels in seeded order, each label going on where the last ended, which is the row's number in
    the order of label, hash and key. A null label comes first. The order is by a hash that other engines have too."""
    hashed, pos = fresh(df, "hashed", "pos")
    x = df.withColumn(hashed, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return numbered(x, [label, hashed, key], pos).withColumn("fold", (F.col(pos) % k).cast("int")).drop(hashed, pos)


class Rank:
    """The search for the value of one rank (from 0): its bracket low < value < high, and the rows at or below low."""

    def __init__(self, column: str, at: int):
        self.column, self.at, self.low, self.high, self.below, self.value = column, at, None, None, 0, None

    def inside(self) -> Column:
        v = F.col(self.column)
        on = v.isNotNull()
        on = on & (v > self.low) if self.low is not None else on
        return on & (v < self.high) if self.high is not None else on

    def bracket(self) -> tuple:
        return self.column, self.low, self.high


def step(v: Column, pivots: list[Column], low: int, high: int) -> Column:
    """How many pivots are at or below the value, by nested comparisons that Spark compiles: low to high are left."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(v >= pivots[mid], step(v, pivots, mid + 1, high)).otherwise(step(v, pivots, low, mid))


def select(df: DataFrame, ranks: list[Rank], rows: dict[str, int]) -> None:
    """Finds the values. All ranks go through a pass together; those in one bracket share its pivots.

    A round asks Spark's quantile sketch for pivots within each bracket, and counts exactly what is below and at each; a
    pivot that holds the rank is its value, so that a value of very many rows ends its search."""
    many = {r.bracket(): rows[r.column] for r in ranks}
    while open_ := [r for r in ranks if r.value is None]:
        small = {b: [r for r in open_ if r.bracket() == b] for b in dict.fromkeys(r.bracket() for r in open_) if many[b] <= BOUND}
        if small:
            cells = [F.when(own[0].inside(), F.struct(F.lit(k).alias("k"), F.col(own[0].column).cast("double").alias("v"))) for k, own in enumerate(small.values())]
            found = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.k", "c.v").agg(F.count("*").alias("n")).orderBy("k", "v").collect()
            for k, own in enumerate(small.values()):
                for r in own:
                    seen = r.below
                    for cell in found:
                        if cell["k"] == k:
                            seen += cell["n"]
                            if seen > r.at:
                                r.value = cell["v"]
                                break
            continue
        brackets = list(dict.fromkeys(r.bracket() for r in open_))
        lead = {b: next(r for r in open_ if r.bracket() == b) for b in brackets}
        shares = F.array(*[F.lit((k + 0.5) / PIVOTS) for k in range(PIVOTS)])
        got = df.agg(*[F.percentile_approx(F.when(lead[b].inside(), F.col(b[0])), shares, F.lit(10_000)) for b in brackets]).first()
        pivots = {b: sorted(set(p)) for b, p in zip(brackets, got)}
        cells = []
        for k, b in enumerate(brackets):
            v, p = F.col(b[0]), [F.lit(float(x)) for x in pivots[b]]
            at = step(v, p, 0, len(p))
            cells.append(F.when(lead[b].inside(), F.struct(F.lit(k).alias("k"), at.alias("at"), (F.element_at(F.array(p[0], *p), at + 1) == v).alias("same"))))
        counts = {b: {} for b in brackets}
        for c in df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.k", "c.at", "c.same").agg(F.count("*").alias("n")).collect():  # two rows a pivot
            counts[brackets[c["k"]]][c["at"], c["same"] and c["at"] > 0] = c["n"]
        for b in brackets:
            p = [float(x) for x in pivots[b]]
            if sum(counts[b].values()) != many[b]:
                raise RuntimeError(f"{b[0]}: the table has other rows at each reading")
            for r in [r for r in open_ if r.bracket() == b]:
                seen = r.below
                for k in range(len(p) + 1):  # the rows at pivot k (from 1), then those between it and the next
                    if k and seen + counts[b].get((k, True), 0) > r.at:
                        r.value = p[k - 1]
                        break
                    seen += counts[b].get((k, True), 0) if k else 0
                    between = counts[b].get((k, False), 0)
                    if seen + between > r.at:
                        r.below, r.low, r.high = seen, p[k - 1] if k else r.low, p[k] if k < len(p) else r.high
                        many[r.bracket()] = between
                        break
                    seen += between


def quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of numeric columns, nulls left out: a few passes over df for all columns
    and shares together. No task and no driver holds more than a bounded number of values. A column without values
    has nulls; NaN counts as the greatest value."""
    plain = {c: f"q{k}" for k, c in enumerate(wanted)}
    x = df.select(*[F.col(c).cast("double").alias(n) for c, n in plain.items()])
    rows = dict(zip(plain, x.agg(*[F.count(n) for n in plain.values()]).first()))
    ranks: dict[tuple, Rank] = {}
    for c, shares in wanted.items():
        for q in shares if rows[c] else ():
            place = (rows[c] - 1) * q
            for at in {math.floor(place), math.ceil(place)}:
                ranks.setdefault((c, at), Rank(plain[c], at))
    select(x, list(ranks.values()), {plain[c]: n for c, n in rows.items()})
    out: dict[str, list] = {}
    for c, shares in wanted.items():
        out[c] = []
        for q in shares:
            if not rows[c]:
                out[c].append(None)
                continue
            place = (rows[c] - 1) * q
            low, high = math.floor(place), math.ceil(place)
            a, b = ranks[c, low].value, ranks[c, high].value
            out[c].append(a if a == b or low == high else (high - place) * a + (place - low) * b)
    return out


def median(df: DataFrame, column: str) -> float | None:
    return quantiles(df, {column: [0.5]})[column][0]


def number(value: float | None) -> Column:
    return F.lit(value).cast("double")
