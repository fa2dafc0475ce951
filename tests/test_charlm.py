"""The language model of sorted arrays, and the beam search on a prefix tree."""

import itertools
import math
import pickle
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.operators import charlm, decoding


def plain(texts, order, k, extra=""):
    counts, letters = defaultdict(Counter), sorted({c for t in texts for c in t} | set(extra))
    for t in texts:
        s = ["<s>"] * (order - 1) + list(t) + ["</s>"]
        for i in range(order - 1, len(s)):
            counts[tuple(s[i - order + 1 : i])][s[i]] += 1
    vocabulary = {*letters, "</s>"}

    def prob(prefix, token):
        if token not in vocabulary:
            return -math.log(len(vocabulary))
        own = counts.get(tuple((["<s>"] * (order - 1) + list(prefix))[len(prefix) :]), {})
        return math.log((own.get(token, 0) + k) / (sum(own.values()) + k * len(vocabulary)))

    return prob


@pytest.mark.parametrize("order, records", [(1, 4_000_000), (2, 7), (4, 50)])
def test_same_probabilities(spark, tmp_path, monkeypatch, order, records):
    """Also over many small files, and with characters beyond the texts'."""
    monkeypatch.setattr(charlm, "RECORDS", records)
    rng = random.Random(order)
    texts = ["".join(rng.choices("ab cé\U0001f600\0", k=rng.randint(0, 12))) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    charlm.train(df, "t", str(tmp_path / "lm"), order, 0.25, extra="xy")
    lm = pickle.loads(pickle.dumps(charlm.load(spark, str(tmp_path / "lm"))))
    prob = plain([*texts, ""], order, 0.25, "xy")
    for prefix in ["", "a", "zz", *texts[:20]]:
        for token in ("a", "é", "\U0001f600", "x", "q", "</s>"):
            assert math.isclose(lm.log_prob(prefix, token), prob(prefix, token), abs_tol=1e-12), (prefix, token)
    for r in charlm.scores(df, "t", lm).collect():
        t = r.t or ""
        assert r.steps == len(t) + 1 and math.isclose(r.log_prob, sum(prob(t[:i], c) for i, c in enumerate([*t, "</s>"])), abs_tol=1e-9)
    assert (len(lm.files) > 1) == (records < 4_000_000)
    with pytest.raises(ValueError):
        charlm.train(df, "t", str(tmp_path / "x"), 0)


def test_search_with_the_model(spark, tmp_path):
    """Every path of a short row is tried: with a wide beam the search is exact, whatever form the model has."""
    texts = ["ABBA", "BAB", "AAB", "B"]
    charlm.train(spark.createDataFrame([(t,) for t in texts], "t string"), "t", str(tmp_path / "lm"), 3)
    lm, prob = charlm.load(spark, str(tmp_path / "lm")), plain(texts, 3, 0.5)
    rng = np.random.default_rng(8)
    rows = [rng.normal(size=(n, 3)) for n in (5, 3, 5, 1)]
    for logits, got in zip(rows, decoding.search_many(rows, "AB", beam=1000, top=None, lm=lm, lm_weight=0.6, length_bonus=0.2)):
        logp = logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)
        mass = {}
        for path in itertools.product(range(3), repeat=len(logits)):
            text = "".join("AB"[k - 1] for k, _ in itertools.groupby(path) if k)
            mass[text] = np.logaddexp(mass.get(text, -np.inf), sum(logp[t, k] for t, k in enumerate(path)))
        want = {t: m + 0.6 * (sum(prob(t[:i], c) for i, c in enumerate(t)) + prob(t, "</s>")) + 0.2 * len(t) for t, m in mass.items()}
        assert {t: round(s, 9) for t, _, _, s in got} == {t: round(float(s), 9) for t, s in want.items()}
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)] + [(9, None), (10, [])], "id int, logits array<array<double>>")
    told = {r.id: [c.text for c in r.candidates] for r in decoding.beam_decode(df, "logits", "AB", candidates=2, lm=lm, lm_weight=0.6).collect()}
    assert told[9] == told[10] == [] and told[0] == [t for t, *_ in decoding.search(rows[0], "AB", lm=lm, lm_weight=0.6)[:2]]


def test_texts_that_come_again():
    """A text that left the beam and comes back is one node: its mass meets that of its continuations."""
    rng = np.random.default_rng(11)
    for _ in range(200):
        logits = np.round(rng.normal(size=(7, 3)) * 2)
        got = decoding.search(logits, "AB", beam=3, top=2)
        assert len({t for t, *_ in got}) == len(got) <= 3
