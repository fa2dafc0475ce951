"""Edit scripts of long texts: the same steps as the whole table's, in bounded memory."""

import random
import tracemalloc

import numpy as np

from quillspark.operators import evaluation
from test_operators import plain_script


def steps(a, b, cells):
    return [(evaluation.NAMES[op], a[i] if op != evaluation.INSERT else "", b[j] if op != evaluation.DELETE else "") for op, i, j in evaluation.scripts([(evaluation.codes(a), evaluation.codes(b))], cells)[0][::-1]]


def test_same_ties_as_the_table():
    rng = random.Random(4)
    for k in range(400):
        letters = rng.choice(["ab", "abcd"])
        a = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        b = "".join(rng.choices(letters, k=rng.randint(0, 40))) if k % 2 else "".join(c for c in a if rng.random() < 0.9) + "a"
        assert steps(a, b, 5) == plain_script(a, b), (a, b)


def test_band_doubles():
    rng = random.Random(5)
    a = "".join(rng.choices("ab", k=300))
    for b in ("".join(rng.choices("cd", k=310)), a[90:] + "xyz", "z" * 150 + a):
        assert steps(a, b, 100) == plain_script(a, b)


def test_fifty_thousand_characters():
    rng = random.Random(6)
    a = "".join(rng.choices("abcdefgh ", k=50_000))
    b = "".join(rng.choice("xyz") if rng.random() < 0.004 else c for c in a[:20_000] + a[20_040:])
    x, y = evaluation.codes(a), evaluation.codes(b)
    tracemalloc.start()
    got = evaluation.scripts([(x, y)])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ops = np.array([op for op, _, _ in got])
    assert most < 200e6 and (ops != evaluation.INSERT).sum() == len(a) and (ops != evaluation.DELETE).sum() == len(b)
    assert 150 < (ops > 0).sum() < 260
    assert all((a[i] == b[j]) == (op == evaluation.MATCH) for op, i, j in got if op in (evaluation.MATCH, evaluation.SUBSTITUTE))
