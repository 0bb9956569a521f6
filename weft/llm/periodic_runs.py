"""Periodic runs of words: stretches that repeat a word sequence at least three times.

A run is a maximal stretch with smallest period q (words q apart are equal) of at least
``max(LEAST, TIMES * q)`` words.  Texts are independent, so each is searched in one Arrow batch
and nothing is shuffled; work is about n log n for a text of n words.

Periods below ``DIRECT`` are found by comparing the text with itself at each lag.  Longer
periods are found by minimizers at many scales: a scale serves the periods of [A, 1.5 A).
Every position is named by the hash of the C words from it on, C the scale's longest period.
Inside a run of primitive period q <= C these names differ within a period and return q words
later.  Of every window of w positions the smallest name is marked; w is so short that each run
of the scale holds one window and its image a period later, with all words of their names.  So the
marks of a run return at distance q, and neighbouring marks of one name at a distance within
the scale are seeds.  A seed is extended word by word in both directions, which decides exactly.

Names are 64-bit hashes of words: unequal words with equal names could only hide a run (about
pairs / 2^64), never make one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import text_or_empty

LEAST, TIMES = 24, 3
#: Periods below it are compared lag by lag.
DIRECT = 16


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of each pair (a, b), in order."""
    z = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(29))


def _sliding(op, x: np.ndarray, w: int) -> np.ndarray:
    """``op`` (minimum or maximum) over every window of w."""
    have = 1
    while have * 2 <= w:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[:len(x) - (w - have)], x[w - have:]) if have < w else x


def _marks(names: np.ndarray, w: int) -> np.ndarray:
    """Positions whose name is the smallest of some window of w positions."""
    least = _sliding(np.minimum, names, w)
    edge = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_sliding(np.maximum, np.concatenate((edge, least, edge)), w) == names)


def _matching(x: np.ndarray, a: int, q: int) -> tuple[int, int]:
    """The maximal [l, r) around a in which x[i] == x[i + q] (empty if x[a] differs)."""
    n, r, step = len(x) - q, a, 64
    while r < n:
        bad = np.flatnonzero(x[r:min(n, r + step)] != x[r + q:min(n, r + step) + q])
        if len(bad):
            r += int(bad[0])
            break
        r, step = min(n, r + step), step * 2
    l, step = a, 64
    while l > 0:
        lo = max(0, l - step)
        bad = np.flatnonzero(x[lo:l] != x[lo + q:l + q])
        if len(bad):
            l = lo + int(bad[-1]) + 1
            break
        l, step = lo, step * 2
    return l, r


def _short(x: np.ndarray, q: int):
    """Stretches of period q (start, end), by comparison at lag q."""
    need = max(LEAST, TIMES * q) - q
    same = np.flatnonzero(x[:-q] == x[q:])
    if len(same) >= need and (same[need - 1:] - same[:len(same) - need + 1] == need - 1).any():
        cut = np.flatnonzero(np.diff(same) > 1)
        first, last = same[np.r_[0, cut + 1]], same[np.r_[cut, len(same) - 1]] + 1
        for l, r in zip(first.tolist(), last.tolist()):
            if r - l >= need:
                yield l, r + q


def _long(x: np.ndarray):
    """Stretches (start, end, period) of the periods from DIRECT on, by minimizers of each scale."""
    n, lo = len(x), DIRECT
    if n < TIMES * lo:
        return
    power = [mix(x.astype(np.uint64) + np.uint64(1), x.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))]
    while 2 << (len(power) - 1) <= lo:
        half = 1 << (len(power) - 1)
        power.append(mix(power[-1][:-half], power[-1][half:]))
    if len(np.unique(power[-1])) == len(power[-1]):
        return  # no DIRECT words come twice, as they would in any longer run
    while TIMES * lo <= n:
        hi = lo * 3 // 2
        c, w = hi - 1, 2 * lo - hi + 2  # w - 1 + c <= 2 q for every q of the scale
        while 2 << (len(power) - 1) <= c:
            half = 1 << (len(power) - 1)
            power.append(mix(power[-1][:-half], power[-1][half:]))
        whole = 1 << (len(power) - 1)
        names = mix(power[-1][:n - c + 1], power[-1][c - whole:n - whole + 1])
        at = _marks(names, w)
        by = np.argsort(names[at], kind="stable")  # positions of one name stay in order
        at = at[by]
        gap = np.diff(at)
        seed = (np.diff(names[at]) == 0) & (gap >= lo) & (gap < hi)
        at, gap = at[:-1][seed], gap[seed]
        done, period = 0, 0
        for k in np.lexsort((at, gap)).tolist():
            a, q = int(at[k]), int(gap[k])
            if q != period:
                done, period = 0, q
            if a >= done:
                l, r = _matching(x, a, q)
                done = max(r, a + 1)
                if r + q - l >= TIMES * q:
                    yield l, r + q, q
        lo = hi


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of a sequence of word numbers as (start, length, period), by start, then period."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(DIRECT, len(x) // TIMES + 1)):
        for l, e in _short(x, q):
            found.setdefault((l, e), q)  # a multiple of the smallest period has the same stretch
    for l, e, q in _long(x):
        if e - l >= LEAST:
            found[l, e] = min(q, found.get((l, e), q))
    return sorted((l, e - l, q) for (l, e), q in found.items())


def collapse_text(text: bytes) -> tuple[int, list, bytes]:
    """(number of words, runs, text without the words that a run repeats) of one UTF-8 text."""
    words = text.split()  # bytes: at space and \x09-\x0D
    number: dict[bytes, int] = {}
    x = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int32, len(words))
    found = runs(x) if len(words) >= LEAST and len(number) < len(words) else []
    if found:
        stay = np.ones(len(words), bool)
        for start, length, q in found:
            stay[start + q:start + length] = False
        words = [words[i] for i in np.flatnonzero(stay).tolist()]
    return len(x), found, b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, runs`` (array of start, length, period in words,
    by start, then period) and ``collapsed``: the text's words, joined by one space, without those
    that lie in a run after its first period.

    A null text counts as empty: no words, no runs, an empty ``collapsed``.  A null doc_id stays
    null; repeated rows are told alike; other columns are ignored; an empty table gives no rows.
    """
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in batches:
            told = [collapse_text(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t[0] for t in told], pa.int64()),
                 pa.array([[dict(zip(("start", "length", "period"), r)) for r in t[1]] for t in told], pa.list_(item)),
                 pa.array([t[2] for t in told], pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("t")).mapInArrow(
        run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, "
             "runs array<struct<start:long,length:long,period:long>>, collapsed string")
