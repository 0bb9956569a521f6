"""Tensor operators against numpy on small seeded arrays."""
import numpy as np
from pyspark.sql import functions as F

from weft.functions import arrays as A
from weft.functions import elementwise as E
from weft.operators.random import multinomial_rows

X = [0.5, -1.25, 3.0, 3.0, -0.75, 2.0, 0.0, 1.5]


def row(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def arr():
    return F.array(*[F.lit(v) for v in X])


def test_softmax_layer_norm(spark):
    x = np.array(X)
    sm = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    assert np.allclose(row(spark, A.softmax(arr())), sm)
    assert np.allclose(row(spark, A.log_softmax(arr())), np.log(sm))
    ln = (x - x.mean()) / np.sqrt(x.var() + 1e-5)
    assert np.allclose(row(spark, A.layer_norm(arr())), ln)
    assert np.allclose(row(spark, A.rms_norm(arr())), x / np.sqrt((x * x).mean() + 1e-5))
    g = x.reshape(2, 4)
    gn = ((g - g.mean(1, keepdims=True)) / np.sqrt(g.var(1, keepdims=True) + 1e-5)).ravel()
    assert np.allclose(row(spark, A.group_norm(arr(), 2)), gn)


def test_topk_ties_larger_index_first(spark):
    got = row(spark, A.topk(arr(), 3))
    assert [(s["value"], s["index"]) for s in got] == [(3.0, 3), (3.0, 2), (2.0, 5)]
    low = row(spark, A.topk(arr(), 2, largest=False))
    assert [s["index"] for s in low] == [1, 4]


def test_quirks(spark):
    r = spark.range(1).select(E.pow_(F.lit(-2.0), 2.0).alias("p"), E.swiglu(F.lit(1.0)).alias("s"),
                              E.log(F.lit(0.0)).alias("l0"), E.log(F.lit(-1.0)).alias("ln"),
                              E.recip(F.lit(0.0)).alias("r"), E.sqrt(F.lit(-1.0)).alias("q")).first()
    assert r.p == -4.0 and abs(r.s - 1 / (1 + np.exp(-1))) < 1e-12
    assert r.l0 == float("-inf") and np.isnan(r.ln) and r.r == float("inf") and np.isnan(r.q)
    v = [1.0, -2.0, 4.0]
    assert abs(row(spark, A.norm(F.array(*[F.lit(a) for a in v]), -1)) - 3 / (1 + 0.5 + 0.25)) < 1e-12


def test_sinusoidal_and_rope(spark):
    pe = row(spark, A.sinusoidal(F.lit(3), 4))
    f = [1.0, 1 / 100.0]
    assert np.allclose(pe, [np.sin(3 * f[0]), np.sin(3 * f[1]), np.cos(3 * f[0]), np.cos(3 * f[1])])
    y = row(spark, A.rope(F.array(*[F.lit(v) for v in [1.0, 2.0, 3.0, 4.0, 9.0]]), F.lit(1), dim=4))
    a0, a1 = 1.0, 10000 ** (-2 / 4)
    assert np.allclose(y, [1 * np.cos(a0) - 3 * np.sin(a0), 2 * np.cos(a1) - 4 * np.sin(a1),
                           1 * np.sin(a0) + 3 * np.cos(a0), 2 * np.sin(a1) + 4 * np.cos(a1), 9.0])


def test_quantize_roundtrip(spark):
    blocks = row(spark, A.quantize_blocks(arr(), 4, 8))
    back = row(spark, A.dequantize_blocks(A.quantize_blocks(arr(), 4, 8)))
    assert len(blocks) == 2 and np.allclose(back, X, atol=3.0 / 127)
    zero = row(spark, A.quantize_blocks(F.array(*[F.lit(0.0)] * 4), 4, 4))
    assert zero[0]["q"] == [0, 0, 0, 0]


def test_multinomial_single_hot(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0, 1.0, 0.0]), (1, [0.0, 1.0, 0.0])], "id long, w array<double>")
    got = multinomial_rows(df, "w", 3, 11, "id").toPandas()
    assert set(got[got.id == 0]["sample"]) == {2} and set(got[got.id == 1]["sample"]) == {1}
    wo = multinomial_rows(spark.createDataFrame([(0, [1.0, 0.0, 2.0])], "id long, w array<double>"), "w", 2, 3, "id",
                          replacement=False).toPandas()
    assert sorted(wo["sample"]) == [0, 2]
