import numpy as np
from pyspark.sql import functions as F

from weft.operators import optim as OP
from weft.streaming.stateful import TailDecoder


def test_fit_linear_matches_numpy(spark):
    X = np.array([[2, 1], [7, 4], [-4, 12], [5, 8]], dtype=float)
    y = X @ np.array([3.0, 1.0]) - 2.0
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(X, y)], "x0 double, x1 double, y double")
    hist = OP.fit_linear(df, ["x0", "x1"], "y", steps=100, lr=0.005)
    w, b = np.zeros(2), 0.0
    for _ in range(100):
        r = X @ w + b - y
        w, b = w - 0.005 * 2 * X.T @ r / 4, b - 0.005 * 2 * r.mean()
    assert np.allclose([hist[-1]["w0"], hist[-1]["w1"], hist[-1]["b"]], [*w, b])
    assert hist[-1]["loss"] < hist[0]["loss"]


def test_lr_sequential(spark):
    lin = (lambda t, s: F.lit(s) * (0.5 + 0.5 * F.least(t, F.lit(4)) / 4.0), lambda t, s: s * (0.5 + 0.5 * min(t, 4) / 4.0))
    exp = (lambda t, s: F.lit(s) * F.pow(F.lit(0.9), t), lambda t, s: s * 0.9 ** t)
    got = spark.range(10).select(OP.lr_sequential(F.col("id"), [lin, exp], [4], 1.0).alias("lr")).toPandas()["lr"]
    want = [0.5 + 0.5 * t / 4 for t in range(4)] + [1.0 * 0.9 ** (t - 4) for t in range(4, 10)]
    assert np.allclose(got, want)


def test_checkpoint_roundtrip(spark, tmp_path):
    st = spark.createDataFrame([(3, "w", [2], [1.0, 2.0]), (3, "old", [1], [0.0])],
                               "step int, name string, shape array<int>, values array<double>")
    OP.write_checkpoint(st, {"step": 3, "params": ["w"]}, str(tmp_path / "ck"))
    t, sk = OP.load_checkpoint(spark, str(tmp_path / "ck"), ["w", "missing"])
    assert [r.name for r in t.collect()] == ["w"] and sk["step"] == 3


def test_param_groups(spark):
    p = spark.createDataFrame([("a", "bias", "parameter", "Linear"), ("a", "weight", "parameter", "Linear"),
                               ("n", "weight", "parameter", "LayerNorm"), ("a", "run_mean", "buffer", "Linear")],
                              "path string, param_name string, kind string, type_name string")
    g = {(r.path, r.param_name): r.group for r in OP.param_groups(p).collect()}
    assert g == {("a", "bias"): "no_decay", ("a", "weight"): "decay", ("n", "weight"): "no_decay"}


def test_tail_decoder():
    """Words come out whole, nothing is lost, the buffers stay short."""
    text = "Hi there, you -- é!\n... end??"
    tail = TailDecoder(lambda ids: "".join(map(chr, ids)))
    out, longest = [], 0
    for ch in text:
        out.append(tail.push(ord(ch)))
        longest = max(longest, len(tail.shown) + len(tail.fresh))
    assert all(p == "" or p[-1].isalnum() for p in out) and "".join(out) == text[:-2] and longest < 12
    assert tail.flush() == "??" and tail.flush() == ""
    # a decoder whose text depends on the token before: spaces between numbers
    tail = TailDecoder(lambda ids: " ".join(map(str, ids)))
    assert "".join(tail.push(i) for i in range(12)) + tail.flush() == " ".join(map(str, range(12)))

