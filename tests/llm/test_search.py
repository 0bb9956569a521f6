"""Multi-index hashing: the radius search exactly, recall and scores against brute force."""

import numpy as np
import pytest

from weft.llm import hamming_index, queries


def brute(rows, k=20, every=20):
    """{query: [(vec_id, score)]} by full inner products."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(found, want):
    hits = sum(len({v for v, _ in found.get(q, [])} & {v for v, _ in w}) for q, w in want.items())
    return hits / max(1, sum(map(len, want.values())))


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_and_scores(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want, got = brute(rows), collect(queries.op5_nearest(spark, d))
    assert recall(got, want) >= 0.95
    x = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(s - x[q] @ x[v]) < 1e-12 and v != q for v, s in found)


def test_many_blocks_lengths_and_ties(spark, monkeypatch):
    """Vectors of unequal length, a large group of equal vectors, several blocks of both kinds."""
    monkeypatch.setattr(hamming_index, "BLOCK", 300)
    monkeypatch.setattr(hamming_index, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)) * rng.lognormal(0, 0.4, size=(1500, 1))
    x[100:600] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = hamming_index.clean(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = collect(hamming_index.search(df, df.where("vec_id % 20 = 0")))
    want = brute(rows)
    # equal scores: any of the tied rows would do for recall, but ties must go to the smaller ids
    assert recall(got, want) >= 0.9
    by_norm = [v for v, _ in got[200]]
    assert by_norm == [v for v, _ in want[200]]


def test_radius_search_is_exact():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 16, size=(500, 4)).astype(np.uint16)
    codes[50:90] = codes[50] ^ np.uint16(1)
    block = hamming_index.Block(codes)
    for q in range(0, 500, 25):
        far = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
        apart = [np.bitwise_count(v ^ c) for (v, _, _, _), c in zip(block.lists, codes[q])]
        for radius in (0, 3, 4, 20, 27):
            rows, d = block.within(codes[q], apart, radius)
            assert rows.tolist() == np.flatnonzero(far <= radius).tolist() and d.tolist() == far[rows].tolist()
        edge = np.sort(far)[59]
        assert block.reach(codes[q], 60).tolist() == np.flatnonzero(far <= edge).tolist()
    assert len(block.reach(codes[0], 1000)) == 500


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []),
            (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (40, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, v string, rank int")
    got = collect(hamming_index.search(c := hamming_index.clean(df), c.where("vec_id % 20 = 0")))
    assert got == {0: [(8, 2.0), (8, 2.0), (1, 0.5), (20, 0.0), (20, 0.0)], 20: [(1, 0.5), (0, 0.0), (8, 0.0), (8, 0.0)]}
    none = hamming_index.clean(df.where("vec_id = 2"))
    assert hamming_index.search(none, none).count() == 0
