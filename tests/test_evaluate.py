import numpy as np
from pyspark.sql import functions as F

from weft.operators import evaluate as EV
from weft.operators import optim as OP


def arr(xs, t="int"):
    return F.array(*[F.lit(x) for x in xs]).cast(f"array<{t}>")


def test_token_matches_contract(spark):
    r = spark.range(1).select(
        EV.token_matches(arr([]), arr([1, 2])).alias("empty"),
        EV.token_matches(arr([1]), arr([1, 2])).alias("short"),
        EV.token_matches(arr([1, 3]), arr([1, 2])).alias("equal"),
        EV.must_match(arr([1]), arr([1, 2])).alias("m_short"),
        EV.must_match(arr([]), arr([1, 2])).alias("m_empty"),
        EV.must_match(arr([1, 2, 3]), arr([1, 2])).alias("m_long"),
        EV.must_match(arr([1]), arr([1, 2]), strict=True).alias("m_strict")).first()
    assert r.empty == [] and r.short == [False] and r.equal == [True, False]
    assert (r.m_short, r.m_empty, r.m_long, r.m_strict) == (1, 1, 0, 0)


def test_cross_entropy_ignore_index(spark):
    logits = [[2.0, 0.5, -1.0], [0.1, 0.2, 0.3], [1.0, 1.0, 1.0]]
    df = spark.createDataFrame([(logits[0], 0), (logits[1], -100), (logits[2], 2)], "v array<double>, t int")
    r = EV.cross_entropy(df, "v", "t").first()
    def nll(z, t):
        z = np.array(z)
        return -(z[t] - z.max() - np.log(np.exp(z - z.max()).sum()))
    exp = (nll(logits[0], 0) + nll(logits[2], 2)) / 2
    assert r.n_valid == 2 and abs(r.loss_mean - exp) < 1e-12 and abs(r.perplexity - np.exp(exp)) < 1e-9
    none = EV.cross_entropy(df.filter("t = -100"), "v", "t").first()
    assert none.loss_mean == 0.0


def test_masked_accuracy(spark):
    acc, rowm = EV.masked_accuracy(arr([5, 6, 7]), arr([5, -100, 9]))
    r = spark.range(1).select(acc.alias("a"), rowm.alias("r")).first()
    assert r.a == 0.5 and r.r == [True, False, False]


def test_sgd_first_momentum_step_moves_nothing(spark):
    pg = spark.createDataFrame([("w", 0, 1.0, 0.5)], "name string, idx int, param double, grad double")
    s1 = OP.sgd_step(pg, 0.1, momentum=0.9).first()
    assert s1.param == 1.0 and s1.buf == 0.0
    s1n = OP.sgd_step(pg, 0.1, momentum=0.9, nesterov=True).first()
    assert abs(s1n.param - (1.0 - 0.1 * 0.5)) < 1e-12


def test_adam_one_step_matches_numpy(spark):
    pg = spark.createDataFrame([("w", 0, 1.0, 0.5)], "name string, idx int, param double, grad double")
    r = OP.adam_step(pg, lr=0.1).first()
    m, v = 0.1 * 0.5, 0.001 * 0.25
    exp = 1.0 - (0.1 / 0.1) * m / (np.sqrt(v) / np.sqrt(0.001) + 1e-8)
    assert abs(r.param - exp) < 1e-12 and r.step == 1


def test_cosine_schedule_matches_recurrence(spark):
    base, eta, T = 0.1, 0.01, 10
    lrs = [base]
    for t in range(1, 25):
        last = lrs[-1]
        if t == T:
            lrs.append(eta)
        elif (t - 1 - T) % (2 * T) == 0:
            lrs.append(last + (last - eta) * (1 - np.cos(np.pi / T)) / 2)
        else:
            lrs.append((1 + np.cos(np.pi * t / T)) / (1 + np.cos(np.pi * (t - 1) / T)) * (last - eta) + eta)
    got = spark.range(25).select(OP.lr_cosine(F.col("id"), base, T, eta).alias("lr")).toPandas()["lr"]
    assert np.allclose(got, lrs, atol=1e-12)
