"""Decoding: prefix beam search, character language model, dispatch, reranking (D-02, D-03, T-04, T-15 to T-18, O-06 to O-08)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from ..functions.text import chars
from .audit import greedy_decode
from .charlm import START

LOW = -1.0e30
CANDIDATE = "array<struct<text string, acoustic double, lm double, score double>>"


class CharModel:
    """Add-k counts: {context: {token: n}} with contexts of order - 1 symbols; unseen ones are uniform."""

    def __init__(self, counts: dict, order: int, k: float = 0.5):
        self.counts, self.order, self.k = counts, order, k
        self.size = max(1, len({t for c in counts.values() for t in c}))
        self.known = {t for c in counts.values() for t in c}

    def log_prob(self, prefix: str, token: str) -> float:
        """T-15."""
        if token not in self.known:
            return -math.log(self.size)
        n = self.order - 1
        context = "<s>" * max(0, n - len(prefix)) + prefix[max(0, len(prefix) - n) :] if n else ""
        own = self.counts.get(context, {})
        return math.log((own.get(token, 0) + self.k) / (sum(own.values()) + self.k * self.size))


def contexts(texts: list[str], order: int) -> np.ndarray:
    """The last order - 1 codes of each text, padded before its start."""
    n = order - 1
    return np.array([[START] * (n - len(t)) + [ord(c) for c in t[max(0, len(t) - n) :]] for t in texts], ">u4").reshape(len(texts), n)


def told_rows(lm, texts: list[str], tokens: list[str]) -> np.ndarray:
    """Log-probabilities [text, token] of what follows each text; equal contexts are looked up once."""
    own, back = np.unique(contexts(texts, lm.order), axis=0, return_inverse=True)
    if hasattr(lm, "rows"):
        return lm.rows(own, tokens)[back.ravel()]
    first = {int(k): i for i, k in reversed(list(enumerate(back.ravel())))}
    return np.array([[lm.log_prob(texts[first[k]], t) for t in tokens] for k in range(len(own))]).reshape(len(own), len(tokens))[back.ravel()]


class Tree:
    """The texts that a row's beams have met, as nodes with their parent and last letter; a text has one node."""

    def __init__(self, letters: str):
        self.letters, self.parent, self.text, self.children = letters, [-1], [""], {}

    def child(self, node: int, k: int) -> int:
        got = self.children.get((node, k))
        if got is None:
            got = self.children[node, k] = len(self.parent)
            self.parent.append(node)
            self.text.append(self.text[node] + self.letters[k - 1])
        return got


def search_many(rows: list[np.ndarray], letters: str, beam: int = 10, top: int | None = 20, lm=None, lm_weight: float = 0.0, length_bonus: float = 0.0) -> list[list[tuple]]:
    """For each row of logits [time, 1 + letters] (column 0 is the blank) its (text, acoustic, lm, score) from the best.

    All rows take a step together: beams are numbers of nodes in arrays [row, beam], and a step weighs all
    continuations at once. What a continuation makes may be another beam's text; their masses meet in
    the place of whichever comes first, so that ties keep the order of the beams."""
    for a in rows:
        if a.ndim != 2 or a.shape[1] != len(letters) + 1:
            raise ValueError(f"logits of shape {a.shape} for {len(letters)} letters and a blank")
    order = sorted(range(len(rows)), key=lambda r: -len(rows[r]))  # rows that end drop off at the end
    lengths = np.array([len(rows[r]) for r in order])
    n, wide = len(rows), min(top or len(letters) + 1, len(letters) + 1)
    trees = [Tree(letters) for _ in rows]
    node, last = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.int64)
    blank, other, told, size = np.zeros((n, 1)), np.full((n, 1), LOW), np.zeros((n, 1)), np.zeros((n, 1), np.int64)
    state = [node, last, blank, other, told, size]
    ended: list = [None] * n
    for t in range(int(lengths.max(initial=0)) + 1):
        on = int((lengths > t).sum())
        for r in range(on, len(state[0])):
            ended[r] = [x[r] for x in state]
        state = [x[:on] for x in state]
        if not on:
            break
        node, last, blank, other, told, size = state
        logits = np.stack([rows[order[r]][t] for r in range(on)]).astype(float)
        logp = logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)
        best = np.argsort(-logp, axis=1, kind="stable")[:, :wide]
        beams = node.shape[1]
        alive = node >= 0
        both = np.logaddexp(blank, other)
        at = np.arange(on)[:, None]
        # slot 0 of a beam is its own text, the others are its continuations in the order of the best letters
        b_mass, o_mass = (np.full((on, beams, 1 + wide), LOW) for _ in range(2))
        lp = logp[at, best]  # [row, letter]
        same = best[:, None, :] == last[:, :, None]
        ok = (best != 0)[:, None, :] & alive[:, :, None]
        b_mass[:, :, 0] = np.where(alive, both + logp[:, :1], LOW)
        o_mass[:, :, 1:] = np.where(ok, np.where(same, blank[:, :, None], both[:, :, None]) + lp[:, None, :], LOW)
        again = (same & ok).any(axis=2)
        o_mass[:, :, 0] = np.where(again, other + np.take_along_axis(logp, last, axis=1), LOW)
        parent = np.array([[trees[r].parent[x] if x >= 0 else -2 for x in own] for r, own in enumerate(node.tolist())])
        target = np.broadcast_to(node[:, :, None], b_mass.shape).copy()
        target[:, :, 1:] = -1  # nodes of continuations are made once chosen
        for r, child, mother in zip(*np.nonzero((parent[:, :, None] == node[:, None, :]) & alive[:, :, None] & alive[:, None, :])):
            found = np.nonzero(best[r] == last[r, child])[0]
            if not len(found) or not last[r, child]:
                continue
            slot = 1 + found[0]
            there, gone = ((mother, slot), (child, 0)) if mother < child else ((child, 0), (mother, slot))
            o_mass[r][there] = np.logaddexp(o_mass[r, mother, slot], o_mass[r, child, 0])
            b_mass[r][there] = b_mass[r, child, 0]
            target[r][there] = node[r, child]
            b_mass[r][gone] = o_mass[r][gone] = LOW
        b_mass[b_mass <= LOW / 2], o_mass[o_mass <= LOW / 2] = LOW, LOW  # no path leads there
        mass = np.logaddexp(b_mass, o_mass)
        next_told = np.repeat(told[:, :, None], 1 + wide, axis=2)
        if lm:
            texts = [trees[r].text[x] for r, own in enumerate(node.tolist()) for x in own if x >= 0]
            follow = np.zeros((on, beams, len(letters) + 1))
            follow[alive] = np.concatenate([np.zeros((len(texts), 1)), told_rows(lm, texts, list(letters))], axis=1)
            next_told[:, :, 1:] += np.take_along_axis(follow, np.broadcast_to(best[:, None, :], (on, beams, wide)), axis=2)
        next_size = np.repeat(size[:, :, None], 1 + wide, axis=2)
        next_size[:, :, 1:] += 1
        score = np.where(mass > LOW / 2, mass + lm_weight * next_told + length_bonus * next_size, -np.inf).reshape(on, -1)
        keep = np.argsort(-score, axis=1, kind="stable")[:, :beam]
        pick = lambda x: np.take_along_axis(x.reshape(on, -1), keep, axis=1)
        good = np.isfinite(pick(score))
        mother, slot = np.divmod(keep, 1 + wide)
        chosen, letter = pick(target), np.where(slot > 0, best[at, np.maximum(slot - 1, 0)], np.take_along_axis(last, mother, axis=1))
        for r, c in zip(*np.nonzero(good & (chosen < 0))):
            chosen[r, c] = trees[r].child(int(node[r, mother[r, c]]), int(letter[r, c]))
        state = [np.where(good, chosen, -1), np.where(good, letter, 0), np.where(good, pick(b_mass), LOW), np.where(good, pick(o_mass), LOW), pick(next_told), pick(next_size)]
    out: list = [None] * n
    for r, (node, _, blank, other, told, size) in enumerate(ended):
        some = node >= 0
        texts, told = [trees[r].text[x] for x in node[some].tolist()], told[some]
        if lm and texts:  # the end of the text counts once the beams are chosen
            told = told + told_rows(lm, texts, ["</s>"])[:, 0]
        mass = np.logaddexp(blank[some], other[some])
        score = mass + lm_weight * told + length_bonus * size[some]
        out[order[r]] = [(texts[k], float(mass[k]), float(told[k]), float(score[k])) for k in np.argsort(-score, kind="stable")]
    return out


def search(logits: np.ndarray, letters: str, **how) -> list[tuple]:
    """(text, acoustic, lm, score) of one row, from the best."""
    return search_many([logits], letters, **how)[0]


def beam_decode(df: DataFrame, logits: str, letters: str, candidates: int = 1, lm=None, **how) -> DataFrame:
    """D-02: adds candidates, from the best; null or empty logits give none. One narrow pass; the rows of an Arrow batch
    take their steps together. lm: an ArrayModel, which workers map into memory, or a small CharModel."""
    ship(df.sparkSession)

    @F.pandas_udf(CANDIDATE)
    def decode(rows: pd.Series) -> pd.Series:
        at = [k for k, r in enumerate(rows) if r is not None and len(r)]
        out = [[] for _ in rows]
        for k in range(0, len(at), 500):
            own = at[k : k + 500]
            for place, got in zip(own, search_many([np.stack([np.asarray(v, float) for v in rows.iloc[i]]) for i in own], letters, lm=lm, **how)):
                out[place] = [dict(zip(("text", "acoustic", "lm", "score"), g)) for g in got[:candidates]]
        return pd.Series(out)

    return df.withColumn("candidates", decode(logits))


def reranked_score(text: Column, score: Column, min_chars: int = 0, short: float = 0.0, spaces: float = 0.0, marks: float = 0.0, edges: float = 0.0) -> Column:
    """T-16: the score less penalties for each missing character, repeated white space, repeated marks, space at an edge."""
    off = lambda hit, by: F.when(hit, F.lit(float(by))).otherwise(0.0)
    return score - F.greatest(min_chars - F.length(text), F.lit(0)) * float(short) - off(text.rlike(r"(?U)\s{2,}"), spaces) - off(text.rlike(r"([.,:;!?\-])\1"), marks) - off(text.rlike(r"(?U)^\s|\s\z"), edges)


def rerank(df: DataFrame, **how) -> DataFrame:
    """O-08: candidates by their adjusted score, ties in the order they had; the scores they carry stay."""
    keyed = F.transform("candidates", lambda c, i: F.struct((-reranked_score(c["text"], c["score"], **how)).alias("key"), i.alias("place"), c.alias("c")))
    return df.withColumn("candidates", F.transform(F.array_sort(keyed), lambda x: x["c"]))


def payload(candidates: Column) -> Column:
    """T-17: text, score, acoustic and language scores of each candidate in one string."""
    return F.array_join(F.transform(candidates, lambda c: F.format_string("%s\t%.6f\t%.6f\t%.6f", c["text"], c["score"], c["acoustic"], c["lm"])), " ||| ")


def unknown(text: Column, letters: str) -> Column:
    """T-04: sorted distinct characters that have no id."""
    return F.array_sort(F.array_except(chars(text), F.array(*[F.lit(c) for c in letters])))


def encode(text: Column, letters: str, strict: bool = True) -> Column:
    """T-04: ids of the characters, from 1 (0 is the blank's). Unknown ones raise, when run, or else are left out."""
    known = F.array(*[F.lit(c) for c in letters])
    ids = F.transform(F.filter(chars(text), lambda c: F.array_contains(known, c)), lambda c: F.array_position(known, c).cast("int"))
    bad = unknown(text, letters)
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("unknown characters: "), F.array_join(bad, " ")))).otherwise(ids) if strict else ids


@dataclass(frozen=True)
class DecoderConfig:
    """D-03: how logits become text."""

    decoder: str = "greedy"
    beam: int = 10
    top: int | None = 20
    lm_weight: float = 0.0
    length_bonus: float = 0.0
    candidates: int = 1
    penalties: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.decoder not in ("greedy", "beam", "beam_lm", "beam_lm_rerank"):
            raise ValueError(f"unknown decoder {self.decoder!r}")
        for name in ("beam", "top", "candidates"):
            if (value := getattr(self, name)) is not None and value <= 0:
                raise ValueError(f"{name} must be positive")
        if self.penalties.get("min_chars", 0) < 0:
            raise ValueError("min_chars must not be negative")


def decode(df: DataFrame, logits: str, letters: str, config: DecoderConfig, lm: CharModel | None = None, length: str | None = None) -> DataFrame:
    """D-03: adds text, and candidates as a payload (null if greedy). Reranking changes the order alone: a
    candidate keeps the scores that it had. Steps beyond length don't count."""
    if config.decoder == "greedy":
        return greedy_decode(df, logits, letters, length).withColumn("candidates", F.lit(None).cast("string"))
    x = df.withColumn("own_logits", F.slice(logits, F.lit(1), F.col(length)) if length else F.col(logits))
    x = beam_decode(x, "own_logits", letters, candidates=config.candidates, lm=lm if config.decoder != "beam" else None, beam=config.beam, top=config.top, lm_weight=config.lm_weight, length_bonus=config.length_bonus).drop("own_logits")
    x = rerank(x, **config.penalties) if config.decoder == "beam_lm_rerank" else x
    return x.withColumns({"text": F.coalesce(F.get("candidates", F.lit(0))["text"], F.lit("")), "candidates": payload(F.col("candidates"))})
