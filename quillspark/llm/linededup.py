"""Line dedup with a log-template tree.

The tree has a fixed depth: a line's token count, then its leading tokens, with variable fields
(tokens that hold digits) generalised. In a leaf, lines join the first template that agrees in
enough positions, and differing positions become wildcards. A template in two documents or more
recurs: its lines go from all documents but the one with the smallest id. Lines of no more words
than the tree's depth are common phrases and headings, and go at a higher count alone.

Lines travel as hashes; the words of a line are fetched once, and only where its leaf is in two
documents. A leaf with many lines is cut into chunks, whose templates are merged by the same rule."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, fresh, table

WILD, SALTS, CHUNK = "<*>", 16, 100_000
DIGIT = re.compile(r"\d")


def masked(line: str) -> list[str]:
    words = line.split()
    return [WILD if DIGIT.search(t) else t for t in words] if DIGIT.search(line) else words


def signed(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def lines(keyed: DataFrame, own: str, mark: str, depth: int) -> DataFrame:
    """(doc, mark, at, size, leaf, line): every line that isn't blank, by its place, token count and hashes."""
    def run(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, m, text in zip(*(c.to_pylist() for c in b.columns)):
                for k, raw in enumerate(text.split("\n")):
                    if w := masked(raw):
                        for col, v in zip(out, (doc, m, k, len(w), signed(f"{len(w)} {' '.join(w[:depth])}"), signed(" ".join(w)))):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["doc", "mark", "at", "size", "leaf", "line"])

    known = keyed.where(F.col(own).isNotNull() & F.col("text").isNotNull()).select(own, mark, "text")
    return arrow_rows(known).mapInArrow(run, "doc long, mark long, at int, size int, leaf long, line long")


def grown(words: list[list[str]], alike: float) -> tuple[list[int], list[list[str]]]:
    """The place of each line's template (lines of one token count, in the given order), and the templates."""
    codes: dict[str, int] = {WILD: 0}
    rows = np.array([[codes.setdefault(t, len(codes)) for t in w] for w in words], np.int32)
    names, known, n, own = list(codes), np.empty_like(rows), 0, []
    for r in rows:
        same = known[:n] == r
        hit = np.nonzero(same.sum(axis=1) >= alike * len(r))[0]
        if len(hit):
            k = int(hit[0])
            known[k][~same[k]] = 0
        else:
            k, n = n, n + 1
            known[k] = r
        own.append(k)
    return own, [[names[c] for c in t] for t in known[:n]]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each key (the first columns), of batches sorted by it."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 5000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def templates(rows: DataFrame, dealt: DataFrame, own: str, mark: str, alike: float) -> DataFrame:
    """(line, template) of the lines whose leaf is in two documents; others can't recur."""
    busy = table(rows.groupBy("leaf").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("leaf", "n"))
    each = rows.join(busy, "leaf").groupBy("leaf", "line").agg(F.min(F.struct("doc", "mark", "at")).alias("one"), F.count("*").alias("times"), F.first("size").alias("size"), F.first("n").alias("n"))
    chunks = F.ceil(F.col("n") * F.col("size") / CHUNK)
    each = each.select("leaf", "line", "one", "times", (chunks > 1).alias("many"), F.pmod(F.xxhash64("line"), chunks).cast("int").alias("chunk"))
    wanted = each.groupBy(F.col("one.doc").alias("doc"), F.col("one.mark").alias("mark")).agg(F.collect_list(F.struct(F.col("one.at").alias("at"), "leaf", "line", "times", "many", "chunk")).alias("wanted"))

    def fetch(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            done = set()
            for doc, m, text, asked in zip(*(b[c].to_pylist() for c in (own, mark, "text", "wanted"))):
                if (doc, m) in done:  # a repeated row
                    continue
                done.add((doc, m))
                raw = text.split("\n")
                for x in asked:
                    for col, v in zip(out, (x["leaf"], x["chunk"], x["many"], x["line"], x["times"], " ".join(masked(raw[x["at"]])))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string()))], ["leaf", "chunk", "many", "line", "times", "words"])

    plain = dealt.select("doc_id", "text", own, mark)
    found = plain.join(wanted, (plain[own] == wanted["doc"]) & (plain[mark] == wanted["mark"])).select("doc_id", own, plain[mark], "text", "wanted")
    words = arrow_rows(found).mapInArrow(fetch, "leaf long, chunk int, many boolean, line long, times long, words string")

    def first(batches):
        """Each line's template in its chunk; its words too where other chunks have templates of the same leaf."""
        def rows():
            for g in groups(batches, 2):
                leaf, many = g[0][0], g[0][2]
                g = list({r[3]: r for r in g}.values()) if len(g) > 1 else g
                place, known = grown([r[4].split(" ") for r in g], alike) if len(g) > 1 else ([0], [g[0][4].split(" ")])
                text = [" ".join(t) for t in known]
                code = [signed(f"{leaf} {t}") for t in text]
                for r, k in zip(g, place):
                    yield r[3], leaf, code[k], text[k] if many else None

        yield from batched(rows(), pa.schema([("line", pa.int64()), ("leaf", pa.int64()), ("template", pa.int64()), ("words", pa.string())]))

    own_chunk = words.repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", F.desc("times"), "words").select("leaf", "chunk", "many", "line", "words")
    one = table(arrow_rows(own_chunk).mapInArrow(first, "line long, leaf long, template long, words string"))

    def merged(batches):
        def rows():
            for g in groups(batches, 1):
                for r, k in zip(g, grown([r[2].split(" ") for r in g], alike)[0]):
                    yield r[1], signed(f"{r[0]} {k}")

        yield from batched(rows(), pa.schema([("template", pa.int64()), ("into", pa.int64())]))

    several = one.where("words is not null").groupBy("leaf", "template").agg(F.first("words").alias("words"))
    into = several.repartition("leaf").sortWithinPartitions("leaf", "words").select("leaf", "template", "words").mapInArrow(merged, "template long, into long")
    return one.join(into, "template", "left").select("line", F.coalesce("into", "template").alias("template"))


def boilerplate(keyed: DataFrame, dealt: DataFrame, own: str, mark: str, min_docs: int = 2, short_docs: int = 8, depth: int = 3, alike: float = 0.75) -> DataFrame:
    """(doc, mark, drop array<int>): places of the lines to drop from each document that has any.

    A template of up to depth words must recur in short_docs documents, a longer one in min_docs."""
    rows = table(lines(keyed, own, mark, depth))
    named = table(templates(rows, dealt, own, mark, alike))
    spread = F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    # a template's documents: its lines' least and greatest ids, and a count where more than two are asked for
    ends = rows.groupBy("line").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.first("size").alias("size"))
    least = F.when(F.col("size") <= depth, short_docs).otherwise(min_docs)
    per_line = named.join(ends, "line").select("line", "template", "lo", "hi", least.alias("least"))
    seen = per_line.groupBy("template").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.first("least").alias("least")).where("first < last or least < 2")
    counted = per_line.where("least > 2").select("line", "template", spread)
    counted = salted.select("doc", "line", "salt").join(counted, ["line", "salt"]).select("template", "doc").distinct().groupBy("template").agg(F.count("*").alias("n"))
    hot = seen.join(counted, "template", "left").where("least <= 2 or n >= least").select("template", "first")
    gone = table(per_line.select("line", "template").join(hot, "template").select("line", "first"))
    hit = salted.join(gone.select("line", "first", spread), ["line", "salt"]).where("doc > first")
    return hit.groupBy("doc", "mark").agg(F.collect_set("at").alias("drop"))


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with text rewritten, plus n_lines and n_dropped (long).

    Null texts stay null; blank lines and the order of lines stay; rows with a null id lose nothing and
    count for no template; rows with equal ids count once. Of equally frequent lines the first in the
    order of their words makes a template. A text that loses all lines becomes empty."""
    own, mark, n, m, gone, parts = (fresh(docs, c) for c in ("own_id", "text_mark", "n_lines", "n_dropped", "drop_places", "line_parts"))
    keyed = docs.withColumns({own: F.col("doc_id").cast("long"), mark: F.xxhash64("text")})
    dealt = keyed.repartition(own, mark)  # one exchange for both uses, where docs has no other columns
    found = boilerplate(keyed, dealt, own, mark, **how).select(F.col("doc").alias("found_doc"), F.col("mark").alias("found_mark"), F.col("drop").alias(gone))
    joined = dealt.join(found, (dealt[own] == found["found_doc"]) & (dealt[mark] == found["found_mark"]), "left")
    # the lines are a column of their own: inside the function they would be made anew for each line
    cut = joined.select(*docs.columns, gone, F.split("text", "\n", -1).alias(parts))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    text = F.when(F.col(gone).isNotNull(), F.array_join(F.transform(kept, lambda k: F.get(F.col(parts), k)), "\n")).otherwise(F.col("text"))
    return cut.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias(n), F.when(F.col(gone).isNotNull(), F.size(gone)).otherwise(0).cast("long").alias(m))
