"""Language models rest on all labelled documents outside the held-out fold."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from quillspark.llm import langid


def learned(rows):
    return [(lang, text) for k, text, lang in rows if text is not None and lang is not None and zlib.crc32(str(k).encode()) % 5]


def brute(texts):
    """Interpolated Kneser-Ney by its recursion: a function of (lang, gram) that gives the log2 probability of its last character."""
    full = defaultdict(Counter)
    for lang, text in texts:
        for w in text.lower().split():
            s = f" {w} "
            full[lang].update(s[max(0, e - 5) : e] for e in range(2, len(s) + 1))
    floor = 1 / (len({g[-1] for c in full.values() for g in c}) + 1)
    level = {}
    for lang, c in full.items():
        for k in range(5, 0, -1):
            level[lang, k] = Counter({g: n for g, n in c.items() if len(g) == k})
            for g in level.get((lang, k + 1), ()):
                level[lang, k][g[1:]] += 1
    after = {at: defaultdict(list) for at in level}
    for at, own in level.items():
        for g, n in own.items():
            after[at][g[:-1]].append(n)

    def chance(lang, g):
        if not g:
            return floor
        low, own, met = chance(lang, g[1:]), level[lang, len(g)], after[lang, len(g)].get(g[:-1])
        if not met or len(g) == 1 and g not in own:  # a character that no language has gets the floor whole
            return low
        return max(own.get(g, 0) - 0.75, 0) / sum(met) + 0.75 * len(met) / sum(met) * low

    return lambda lang, g: np.log2(chance(lang, g))


def made(n):
    rng = random.Random(5)
    letters = {"en": "abcdefgh", "de": "cdefghiü", "xx": "ghijk𝒜é"}
    word = lambda c: "".join(rng.choices(letters[c], k=rng.randint(1, 7)))
    return [(k, " ".join(word(c) for _ in range(4)), c) for k, c in enumerate(rng.choices(list(letters), [8, 1, 1], k=n))]


def test_counts_given_in_parts(spark):
    """The bounds of what a task holds don't change the counts."""
    d = spark.createDataFrame(made(50), "doc_id long, text string, lang string")
    want = sorted(langid.grams(d).collect())
    for bounds in ((1, 1 << 26, 500_000), (150_000, 1, 500_000), (150_000, 1 << 26, 1)):
        assert sorted(langid.grams(d, *bounds).collect()) == want


def test_models_of_all_documents(spark):
    """More documents of a language than the 600 that were learned from before."""
    rows = made(1500) + [(2000, None, "en"), (2001, "zzz", None)]
    assert Counter(lang for lang, _ in learned(rows))["en"] > 700
    model, want = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")), brute(learned(rows))
    assert model.langs == ["de", "en", "xx"]
    every = sorted({s[max(0, e - 5) : e] for _, t, _ in rows[:300] for w in t.lower().split() for s in [f" {w} "] for e in range(2, len(s) + 1)}) + ["~", "ab~", "~abcd", " "]
    got = model.chars(every)
    assert np.allclose(got, [[want(lang, g) for lang in model.langs] for g in every], atol=1e-4)


def test_limit_of_all_documents(spark):
    """The 99.9 % quantile is that of all documents learned from, held to numpy's."""
    rows = made(1500)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d)
    bits = langid.judge(model)([t for _, t in learned(rows)])[1]
    most = float(np.quantile(bits, 0.999))
    got = {r.doc_id: r for r in langid.identify(d, margin=1.0).collect()}
    own = dict(zip([k for k, _, _ in rows], langid.judge(model)([t for _, t, _ in rows])[1]))
    assert {k for k in got if got[k].rejected} == {k for k, x in own.items() if x > most + 1e-9}
    assert {r.doc_id for r in langid.keep_known(d, margin=1.0).collect()} == {k for k, r in got.items() if not r.rejected}


def test_pipeline_learns_from_all(spark, monkeypatch):
    """The pipeline's models and limit rest on every labelled document and on no sample: a language that only the
    held-out fold has is known, and the limit is numpy's quantile of all."""
    monkeypatch.delattr(langid, "sample")
    rows = made(1500)
    held = [k for k in range(5000, 5200) if zlib.crc32(str(k).encode()) % 5 == 0]
    rows += [(k, "\u03b1\u03b2\u03b3 \u03b3\u03b1\u03b2\u03b2 \u03b2\u03b1", "el") for k in held] + [(6000, "\u4e2d\u6587\u5b57" * 40, None), (6001, None, "en"), (6002, "12 34", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, d, "").collect()}
    assert kept == {k for k, _, _ in rows} - {6000, 6001, 6002}
    every = [(lang, t) for _, t, lang in rows if lang is not None and t is not None]
    model, want = langid.train(d, every=True), brute(every)
    grams = sorted({s[max(0, e - 5) : e] for _, t in every[::9] for w in t.lower().split() for s in [f" {w} "] for e in range(2, len(s) + 1)})
    assert model.langs == ["de", "el", "en", "xx"] and np.allclose(model.chars(grams), [[want(lang, g) for lang in model.langs] for g in grams], atol=1e-4)
    bits = dict(zip([k for k, _, _ in rows], langid.judge(model)([t for _, t, _ in rows])[1]))
    most = float(np.quantile([bits[k] for k, t, lang in rows if lang is not None and bits[k] is not None], 0.999))
    assert {r.doc_id for r in langid.keep_known(d, margin=1.0, every=True).collect()} == {k for k, x in bits.items() if x is not None and x <= most + 1e-9}
