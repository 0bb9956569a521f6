"""Removal of repeated windows against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.helpers import ODD, docs
from weft.llm import queries, recompression
from weft.llm.recompression import Symbols, remove_repeated

SF = "/root/testdata/sf0.001"


def plain_removed(texts, window=35):
    """(n_words, kept words) of every text: all windows of all texts in one table."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            count[k] = count.get(k, 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest())
            for r, (n, k) in zip(rows, plain_removed([r.text for r in rows]))]
    got = queries.op11_substring_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[2] for r in want) > 1000


def passages(seed):
    """Texts that share passages of many lengths, periods, runs and near misses."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(rng.choice([3, 60, 5000]))}"
    shared = [[word() for _ in range(rng.choice([34, 35, 36, 50, 120, 400]))] for _ in range(8)]
    shared += [["na"] * 34, ["na"] * 35, ["na"] * 60, ["a", "b"] * 40, ["a", "a", "b"] * 30]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randrange(6)):
            t += [word() for _ in range(rng.randrange(60))]
            p = list(rng.choice(shared))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            if rng.random() < 0.3:
                p = p[rng.randrange(len(p)):]
            t += p
        texts.append(" ".join(t))
    return [*texts, texts[0], texts[1], "", None, " ".join(["na"] * 35)]


@pytest.mark.parametrize("seed,window", [(1, 35), (2, 35), (3, 5), (4, 2), (5, 90)])
def test_shared_passages(spark, seed, window):
    texts = passages(seed)
    rows = [*enumerate(texts), (None, texts[2]), (7, texts[7])]
    got = remove_repeated(docs(spark, rows), window).collect()
    want = plain_removed([t for _, t in rows], window)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(
        ((i, n, n - len(k), " ".join(k)) for (i, _), (n, k) in zip(rows, want)), key=key)


def test_odd_rows(spark):
    long = " ".join(f"u{i}" for i in range(20000))
    rows = [*ODD, (20, long), (21, f"{long} end"), (None, "x " * 80)]
    got = remove_repeated(docs(spark, rows)).collect()
    want = plain_removed([t for _, t in rows])
    assert sorted((r[1], r[2], r[3]) for r in got) == sorted((n, n - len(k), " ".join(k)) for n, k in want)
    assert remove_repeated(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        remove_repeated(docs(spark, []), window=1)


def test_inner_symbols_are_those_of_the_words_alone():
    """A symbol's deciding words alone give the same symbol, whatever stands around them."""
    rng = np.random.default_rng(3)
    names = rng.integers(1, 40, 3000).astype(np.uint64)
    s = Symbols(names.copy(), np.zeros(len(names), int)).rounds(0, recompression.LOW)
    checked = 0
    for name, start, lo, hi in zip(s.names[s.inner], s.start[s.inner], s.lo[s.inner], s.hi[s.inner]):
        around = np.r_[rng.integers(50, 60, 30), names[lo:hi], rng.integers(50, 60, 30)].astype(np.uint64)
        t = Symbols(around, np.zeros(len(around), int)).rounds(0, recompression.LOW)
        at = np.flatnonzero(t.start == start - lo + 30)
        assert len(at) and t.names[at[0]] == name
        checked += 1
    assert checked > 300


def test_texts_are_shuffled_once(spark):
    rows = docs(spark, list(enumerate(passages(1))))
    plan = remove_repeated(rows)._jdf.queryExecution().executedPlan().toString()
    side = [x for x in plan.splitlines() if "text#" in x and "Exchange" in x]
    assert not side and "SelectedBucketsCount" in plan
