"""Periodic runs against a plain version."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.helpers import ODD, docs
from weft.llm import queries
from weft.llm.periodic_runs import periodic_runs, runs
from weft.llm.run_queries import planted

SF = "/root/testdata/sf0.001"


def plain_runs(x):
    """Every stretch of every lag, word by word; of equal stretches the smallest period."""
    n, out = len(x), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if x[i] == x[i + q]:
                j = i
                while j + q < n and x[j] == x[j + q]:
                    j += 1
                if j + q - i >= max(24, 3 * q):
                    out.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((a, e - a, q) for (a, e), q in out.items())


def plain_planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def plain_row(doc_id, w):
    found = plain_runs(w)
    dropped = {i for s, k, q in found for i in range(s + q, s + k)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest())


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n = rng.randrange(20, 600)
        x = [rng.randrange(rng.choice([1, 2, 3, 5, 50, 1000])) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            a, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
            for i in range(a, rng.randrange(a, n) + 1):
                x[i] = x[a + (i - a) % p]
        assert runs(np.array(x, np.int32)) == plain_runs(x)


def test_runs_of_fibonacci_and_thue_morse():
    a, b, t = [0], [0, 1], [0, 1]
    while len(b) < 1500:
        a, b, t = b, b + a, t + [1 - v for v in t]
    for x in (b[:1500], t[:1500], [0] * 700, [0, 1] * 300 + [0, 1, 1] * 200):
        assert runs(np.array(x, np.int32)) == plain_runs(x)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_row(i, plain_planted(i, t)) for i, t in rows]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 10


def test_odd_rows(spark):
    long = " ".join(["a b c d e f g h"] * 2000)
    many = [*ODD, (17, "x " * 23), (17, "x " * 24), (None, long), (18, long), (18, long)]
    table = docs(spark, many)
    words = lambda rows: sorted((r[0] or -1, re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows)
    assert words(planted(table).collect()) == words([(i, " ".join(plain_planted(i, t))) for i, t in many])
    got = {(r.doc_id, r.collapsed): (r.n_words, [tuple(x) for x in r.runs]) for r in periodic_runs(table).collect()}
    assert got[17, " ".join(["x"] * 23)] == (23, []) and got[17, "x"] == (24, [(0, 24, 1)])
    assert got[None, "a b c d e f g h"] == got[18, "a b c d e f g h"] == (16000, [(0, 16000, 8)])
    assert got[3, ""] == (0, [])
    assert periodic_runs(table).count() == len(many) and periodic_runs(docs(spark, [])).count() == 0
