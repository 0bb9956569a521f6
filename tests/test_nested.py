"""Nested collation, nested config diffs and the softmax fit against plain versions."""
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import batching as B
from weft.operators import optim as OP
from weft.operators import runs as RN


def test_nested_rows_collate_to_nested_columns(spark):
    rows = [(0, 1, {"a": 1, "b": {"c": "x", "d": [1.0, 2.0]}}, [(True, [1]), (False, [2])]),
            (0, 0, {"a": None, "b": {"c": "y", "d": [3.0, 4.0]}}, [(None, [3]), (True, [4])]),
            (1, 2, {"a": 5, "b": {"c": None, "d": []}}, [])]
    df = spark.createDataFrame([(b, i, o, x) for b, i, o, x in rows],
                               "batch int, idx int, o struct<a:int,b:struct<c:string,d:array<double>>>, x array<struct<t:boolean,l:array<int>>>")
    got = {r.batch: r.columns.asDict(True) for r in B.collate_nested(df, "batch", "idx", ["o", "x"]).collect()}
    assert got[0] == {"o": {"a": [None, 1], "b": {"c": ["y", "x"], "d": [[3.0, 1.0], [4.0, 2.0]]}},
                      "x": [{"t": [None, True], "l": [[3, 1]]}, {"t": [True, False], "l": [[4, 2]]}]}
    assert got[1] == {"o": {"a": [5], "b": {"c": [None], "d": []}}, "x": []}
    ragged = df.withColumn("x", F.slice("x", 1, F.col("idx")))
    with pytest.raises(Exception, match="of equal size"):
        B.collate_nested(ragged, "batch", "idx", ["x"]).collect()
    assert B.collate_nested(df.where("idx > 9"), "batch", "idx", ["o"]).count() == 0


CASES = [
    ({"a": {"b": 1, "c": True}, "d": "x"}, {"a": {"b": 2, "c": False}, "d": "x"}, "a.b:1→2, -a.c"),
    ({"z": False, "lr": 1e-3}, {"z": True, "lr": 2.5e-4}, "lr:1e-3⥵3e-4, +z"),
    ({"n": 1024}, {"n": 1536}, "n:1e3+(24→536)"),
    ({"n": 250, "m": -500, "k": 99, "j": 100}, {"n": 450, "m": 500, "k": -99, "j": 0}, "j:1e2⥵0, k:99→-99, m:-5e2⥵5e2, etc 1 more"),
    ({"a": {"x": 1}, "l": [1]}, {"a": None, "l": [2], "b": {"c": {"d": {"e": "new"}}}}, "a:undefined→null, a.x:1e0→undefined, b.c.d.e:undefined→new"),
    ({"v": 1, "s": "1"}, {"v": 1.0, "s": 1}, "s:1→1e0"),
    ({"v": 1}, {"v": 1}, None),
    ({}, {"v": 15}, "v:undefined→2e1"),
]


def test_nested_config_diffs(spark):
    prev = RN.nested_leaves(spark.createDataFrame([(i, json.dumps(a)) for i, (a, _, _) in enumerate(CASES)] + [(99, None)], "run_id long, config string"))
    curr = RN.nested_leaves(spark.createDataFrame([(i, json.dumps(b)) for i, (_, b, _) in enumerate(CASES)], "run_id long, config string"))
    got = {r.run_id: r.diff for r in RN.nested_config_diff(curr, prev).collect()}
    assert got == {i: d for i, (_, _, d) in enumerate(CASES) if d}


def test_boosted_and_labelled_leaves_first(spark):
    leaves = lambda c: RN.nested_leaves(spark.createDataFrame([(1, json.dumps(c))], "run_id long, config string"))
    old, new = ({"m": {"w": k, "d": k}, "t": {"x": k}, "q": k, "hidden": k} for k in (1, 2))
    labels = {"m.w": "width", "m.d": ("depth", 5), "t.x": "x", "q": "q"}
    diff = lambda **k: RN.nested_config_diff(leaves(new), leaves(old), **k).first().diff
    assert diff(labels=labels, boosts={"t": 3, "m": 4}) == "depth:1→2, width:1→2, x:1→2, etc 1 more"
    assert diff(labels=labels, top=9) == "depth:1→2, q:1→2, width:1→2, x:1→2"


def test_softmax_fit_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(90, 5)), rng.integers(0, 3, 90)
    lr = lambda t: 0.1 * (1 + math.cos(math.pi * t / 20)) / 2
    rows = [(i, [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, (900, None, 1), (901, [1.0], 1), (902, rows[0][1], 7), (903, rows[0][1], None)], "id long, x array<double>, y int")
    w, losses = OP.fit_softmax(df.repartition(3), "x", "y", 3, 5, 20, lr)
    want, m, v = np.zeros((3, 6)), np.zeros((3, 6)), np.zeros((3, 6))
    xb = np.c_[x, np.ones(90)]
    for t in range(20):
        z = xb @ want.T
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        assert abs(losses[t] + np.log(p[np.arange(90), y]).mean()) < 1e-9
        g = (p - np.eye(3)[y]).T @ xb / 90
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        want = want - lr(t) * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8)
    assert np.allclose(w, want, atol=1e-9) and losses[-1] < losses[0]
    told = OP.predict_softmax(df.where("id < 90"), "x", w).orderBy("id").select("predicted").collect()
    assert [r[0] for r in told] == (xb @ want.T).argmax(1).tolist()
    none, no_loss = OP.fit_softmax(df.where("id > 999"), "x", "y", 3, 5, 2, lr)
    assert not none.any() and no_loss == []
