"""Ranked lexical search against a plain version."""

import math
import random
import re

import pytest

from tests.llm.helpers import ODD, docs
from weft.llm import queries, ranked_search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(rows, items, k=10):
    """Every text scored for every item."""
    found = [(i, terms(t)) for i, t in rows]
    n_all, total = sum(bool(w) for _, w in found), sum(len(w) for _, w in found)
    df = {}
    for _, w in found:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        asked, scored = set(terms(text)), []
        for i, w in found:
            m = 10 + 90 * len(w) * n_all // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1000000000 * w.count(t) // (1000 * w.count(t) + 8 * m))
                        for t in asked & set(w))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op12_ranked_search(spark, SF)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_search(rows, items))


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 7), (3, 50)])
def test_random_texts_in_small_blocks(spark, monkeypatch, seed, block):
    """Common and rare terms, ties, repeated ids and texts; blocks small enough for skipping."""
    rng = random.Random(seed)
    words = [f"t{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30, 200])))) for i in range(400)]
    rows += [rows[3], (None, rows[3][1]), (500, rows[3][1]), (None, rows[3][1]), (501, None), (502, "")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 12])))) for i in range(25)]
    items += [(25, rows[3][1]), (26, None), (27, "nowhere at all"), (28, "t1 t1 T1")]
    monkeypatch.setattr(ranked_search, "BLOCK_ROWS", block)
    query_table = docs(spark, items).withColumnRenamed("doc_id", "item_id").withColumnRenamed("source", "rank")
    got = ranked_search.search(docs(spark, rows).coalesce(2), query_table, k=4)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_search(rows, items, 4), key=key)


def test_pair_bounds_hold_and_skip():
    """Pair bounds are at least the best score and at most the sum of the terms' maxima, and blocks below
    the threshold are skipped."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e"]) for _ in range(rng.choice([1, 2, 6])))) for i in range(300)]
    import pyarrow as pa

    q = ranked_search.QuerySet([(0, b"a b c d"), (1, b"e a")])
    told = type("B", (), {"value": q})
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1].encode() for r in rows])], names=["id", "t"])
    made = list(ranked_search._blocks(told)([batch]))
    df = {}
    for b in made:
        for t, n in zip(b.column("terms")[0].as_py(), b.column("df")[0].as_py()):
            df[t] = df.get(t, 0) + n
    q.weigh(300, sum(len(r[1].split()) for r in rows), df)
    made = [b.select(["ids", "no_id", "sizes", "terms", "df", "texts", "tf"]) for b in made]
    (index,) = list(ranked_search._impacts(told)(made))
    block = ranked_search._Block([c.to_pylist()[0] for c in index.columns])
    for _, pairs, which in q.paired:
        texts, scores = block.best(pairs, which, 1)
        top = int(scores.max())
        singles = sum(int(block.impacts[block.where[t]].max()) for p in pairs for t in p if t in block.where)
        assert top <= int(block.joint[which].sum()) <= singles
        assert block.best(pairs, which, int(block.joint[which].sum()) + 1) is None
        again, _ = block.best(pairs, which, top)
        assert sorted(again.tolist()) == sorted(t for t, s in zip(texts.tolist(), scores.tolist()) if s == top)


def test_odd_and_empty(spark):
    items = docs(spark, [(1, "the QUICK fox"), (1, "the QUICK fox"), (2, "wörter"), (3, None)]).withColumnRenamed("doc_id", "item_id")
    got = ranked_search.search(docs(spark, ODD), items, k=3)
    want = plain_search(ODD, [(1, "the quick fox"), (1, "the quick fox"), (2, "wörter")], 3)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert ranked_search.search(docs(spark, []), items).count() == 0
    assert ranked_search.search(docs(spark, ODD), items.where("item_id > 9")).count() == 0
