"""Tiled products against numpy: sparse, batched, transposed, biased, small tiles."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import tensors as TS
from weft.operators import tiles as TL


def long(spark, m, names, rng=None, keep=1.0):
    at = [ix for ix in np.ndindex(m.shape) if rng is None or rng.random() < keep]
    return spark.createDataFrame([(*map(int, ix), float(m[ix])) for ix in at], ", ".join(f"{n} long" for n in names[:-1]) + f", {names[-1]} double"), at


@pytest.mark.parametrize("tile,keep,trans_a,trans_b", [(64, 1.0, False, False), (3, 1.0, True, False), (4, 0.3, False, True), (5, 0.3, True, True)])
def test_product(spark, tile, keep, trans_a, trans_b):
    rng = np.random.default_rng(tile)
    a, b = rng.normal(size=(2, 11, 7)), rng.normal(size=(2, 7, 9))
    rows, at_a = long(spark, a, ("h", "i", "k", "a"), rng, keep)
    cols, at_b = long(spark, b, ("h", "k", "j", "b"), rng, keep)
    bias = spark.createDataFrame([(j, j / 2) for j in range(8)], "j long, bias double")
    za, zb, pa_, pb = np.zeros_like(a), np.zeros_like(b), np.zeros_like(a), np.zeros_like(b)
    for ix in at_a:
        za[ix], pa_[ix] = a[ix], 1
    for ix in at_b:
        zb[ix], pb[ix] = b[ix], 1
    rows = rows.select("h", F.col("k").alias("i"), F.col("i").alias("k"), "a") if trans_a else rows
    cols = cols.select("h", F.col("j").alias("k"), F.col("k").alias("j"), "b") if trans_b else cols
    got = {(r.h, r.i, r.j): r.val for r in TL.matmul(rows, cols, batch=["h"], trans_a=trans_a, trans_b=trans_b, bias=bias, tile=tile).collect()}
    want, there = za @ zb + np.array([*np.arange(8) / 2, 0]), pa_ @ pb
    assert set(got) == {tuple(map(int, ix)) for ix in np.argwhere(there > 0)}
    assert all(abs(got[ix] - want[ix]) < 1e-9 for ix in got)


def test_many_lanes_nulls_repeats_and_empty(spark, monkeypatch):
    monkeypatch.setattr(TL, "LANE_TILES", 1)
    a = spark.createDataFrame([(i, k, float(i + k)) for i in range(-20, 20) for k in range(3)] + [(0, 0, 5.0), (None, 0, 1.0), (0, None, 1.0), (1, 1, None)],
                              "i long, k long, a double")
    b = spark.createDataFrame([(k, 0, 1.0) for k in range(3)] + [(1, 0, 1.0)], "k long, j long, b double")
    got = {r.i: r.val for r in TL.matmul(a, b, tile=2).collect()}
    assert got == {i: 3.0 * i + 3 + (i + 1) + (5 if i == 0 else 0) for i in range(-20, 20)}
    assert TL.matmul(a.where("i > 99"), b).count() == 0
    plan = TL.matmul(a, b, tile=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "_lane" in plan


def test_pairwise_dot(spark):
    rng = np.random.default_rng(1)
    q, k = rng.normal(size=(5, 6)), rng.normal(size=(4, 6))
    rows, _ = long(spark, q, ("i", "d", "q"))
    keys, _ = long(spark, k, ("j", "d", "k"))
    got = {(r.i, r.j): r.score for r in TL.pairwise_dot(rows, keys, 0.5, tile=4).collect()}
    assert len(got) == 20 and all(abs(got[i, j] - 0.5 * q[i] @ k[j]) < 1e-9 for i, j in got)


def test_matrix_report_counts_what_is_not_finite(spark):
    rows = spark.createDataFrame([([1.0, -2.0, None],), ([3.0, 4.0],), (None,), ([],)], "v array<double>")
    r = TS.matrix_report(rows).first()
    assert (r.fro, r.norm_inf, r.norm_ninf, r.norm_1, r.norm_n1, r.mean, r.n_nan, r.n_inf) == (30 ** 0.5, 7.0, 0.0, 6.0, 4.0, 1.5, 0, 0)
    odd = TS.matrix_report(spark.createDataFrame([([float("nan"), float("inf"), float("-inf"), 1.0],)], "v array<double>")).first()
    assert (odd.n_nan, odd.n_inf) == (1, 2)
    none = TS.matrix_report(rows.where("false")).first()
    assert none.fro is None and none.n_nan == none.n_inf == 0


def test_broadcasts_are_measured_in_bytes(spark):
    few = spark.range(3).withColumn("s", F.repeat(F.lit("x"), 1000))
    big = lambda df: spark.range(3).join(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in big(TS.checked_broadcast(few)) and "broadcast" not in big(TS.checked_broadcast(few, max_bytes=1000))


def test_all_close_of_rows_side_by_side(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], [1.0, 2.5]), (2, [3.0], [3.5])], "i long, a array<double>, b array<double>")
    r = TS.all_close(rows, "i", "a", "b", atol=0.1).first()
    assert (r.all_close, r.max_err, r.worst_i, r.worst_j) == (False, 0.5, 1, 1)
    assert TS.all_close(rows, "i", "a", "a").first().all_close is True
    short = spark.createDataFrame([(1, [1.0], [1.0, 2.0])], rows.schema)
    assert TS.all_close(short, "i", "a", "b").first().all_close is False


def test_squeeze_and_slices(spark):
    m = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(4) for j in range(5)], "i long, j long, val double")
    part = TS.slice_ranges(m, {"i": (1, 3), "j": (2, None)})
    assert sorted(map(tuple, part.collect())) == [(i, j, float(10 * (i + 1) + j + 2)) for i in range(2) for j in range(3)]
    assert TS.squeeze(TS.unsqueeze(m, "b"), "b").columns == m.columns
    with pytest.raises(ValueError):
        TS.unsqueeze(m, "j")
    with pytest.raises(Exception, match="larger than one"):
        TS.squeeze(m, "i").collect()
