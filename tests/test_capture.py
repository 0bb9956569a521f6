import pytest
"""Capture queries on a hand-built tree and the op-chain automaton against brute force."""
import itertools

import pandas as pd
from pyspark.sql import functions as F

from weft.operators import capture as CP
from weft.operators.capture import CHILD, DESCENDANT, NEXT, SUBSEQUENT, Step


def tiny_tree(spark):
    rows = [("model", None, "model", "Model", 0, 0), ("model/linear1", "model", "linear1", "Linear", 0, 1),
            ("model/layers", "model", "layers", "ModuleList", 1, 1), ("model/linear2", "model", "linear2", "Linear", 2, 1),
            ("model/layers/0", "model/layers", "0", "Block", 0, 2), ("model/layers/1", "model/layers", "1", "Block", 1, 2),
            ("model/layers/0/attn", "model/layers/0", "attn", "Attention", 0, 3),
            ("model/layers/1/attn", "model/layers/1", "attn", "Attention", 0, 3)]
    m = spark.createDataFrame(rows, "path string, parent_path string, name string, type_name string, child_idx long, depth int")
    nch = m.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("n_children"))
    m = m.join(nch, "path", "left").fillna({"n_children": 0}).withColumn("key", F.lit(None).cast("long"))
    return m, CP.closure(m)


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_selectors(spark):
    m, c = tiny_tree(spark)
    sel = lambda steps, **kw: paths(CP.select_modules(m, c, steps, **kw)[0])
    assert sel([Step(DESCENDANT, "name", "model")]) == ["model"]
    assert sel([Step(DESCENDANT, "name", "attn")]) == ["model/layers/0/attn", "model/layers/1/attn"]
    assert sel([Step(DESCENDANT, "name", "layers", -1)]) == ["model/layers/1"]
    assert sel([Step(DESCENDANT, "name", "model"), Step(CHILD, "name", "layers", 0)]) == ["model/layers/0"]
    assert sel([Step(DESCENDANT, "name", "linear1"), Step(NEXT, "type", "Linear")]) == ["model/linear2"]
    assert sel([Step(DESCENDANT, "name", "linear1"), Step(SUBSEQUENT, "wildcard")]) == ["model/layers", "model/linear2"]
    assert sel([Step(DESCENDANT, "type_regex", "^Lin")]) == ["model/linear1", "model/linear2"]
    assert sel([Step(DESCENDANT, "name", "layers")], include_descendants=True, max_depth=1) == [
        "model/layers", "model/layers/0", "model/layers/1"]
    _, trail = CP.select_modules(m, c, [Step(DESCENDANT, "name", "linear1"), Step(CHILD, "wildcard")])
    d = CP.selector_diagnostics(trail, [Step(DESCENDANT, "name", "linear1"), Step(CHILD, "wildcard")]).toPandas()
    assert d["n_matched"].tolist() == [1, 0] and d["failed_here"].tolist() == [False, True]


#: chain, ops of a module -> places of the ops that complete it, worked out by hand
CHAINS = [
    (["a", "b"], [NEXT], "aabacb", [2]),  # only the b right after an a
    (["a", "b"], [NEXT], "abab", [1, 3]),
    (["a", "b"], [SUBSEQUENT], "aabacb", [2, 5]),  # the a at 3 waits over c; the first two are used up together
    (["a", "b"], [SUBSEQUENT], "abb", [1]),  # the one a is used up
    (["a", "a"], [NEXT], "aaa", [1, 2]),  # overlapping: the second a begins a chain too
    (["a", "c", "b"], [SUBSEQUENT, NEXT], "axcbcb", [3]),  # the c must be right before the b
    (["a", "c", "b"], [SUBSEQUENT, NEXT], "acxcb", []),  # the a was used by the first c, which no b followed
    (["a", "b", "c"], [NEXT, SUBSEQUENT], "abxxcc", [4]),
    (["a", "b", "c"], [NEXT, SUBSEQUENT], "axbc", []),
    (["a", "b", "c"], [NEXT, SUBSEQUENT], "ababc", [4]),
    (["a"], [], "bab", [1]),
]


@pytest.mark.parametrize("chunk", [512, 2])
def test_op_chain_by_hand(spark, monkeypatch, chunk):
    monkeypatch.setattr(CP, "CHUNK_OPS", chunk)
    by_chain = {}
    for items, rels, ops, want in CHAINS:
        by_chain.setdefault((tuple(items), tuple(rels)), {})[ops] = want
    for (items, rels), modules in by_chain.items():
        rows = [(m, i, op) for m in modules for i, op in enumerate(m)] + [(None, i, op) for i, op in enumerate("xx")]
        log = spark.createDataFrame(rows, "module_path string, seq long, op string")
        got = {m: [] for m in modules}
        for r in CP.op_chain(log, items, rels, n=3).collect():
            got[r.module_path].append(r.seq)
        assert {m: sorted(v) for m, v in got.items()} == modules


def test_op_next_and_subsequent(spark):
    log = spark.createDataFrame([("m", i, op) for i, op in enumerate("aabacb")], "module_path string, seq long, op string")
    assert [r.seq for r in CP.op_next(log, "a", "b").collect()] == [2]
    assert sorted(r.seq for r in CP.op_subsequent(log, "a", "b").collect()) == [2, 5]


def test_slice_capture(spark):
    v = F.array(*[F.lit(float(i)) for i in range(12)])
    got = spark.range(1).select(CP.slice_capture(v, [3, 4], [(1, 3), -1]).alias("x")).first().x
    assert got == [7.0, 11.0]
    got2 = spark.range(1).select(CP.slice_capture(v, [3, 4], [Ellipsis, 0]).alias("x")).first().x
    assert got2 == [0.0, 4.0, 8.0]


def test_select_site(spark):
    caps = spark.createDataFrame([("model/a", "input", 1.0), ("model/a", "output", 2.0)], "path string, site string, v double")
    assert [r.v for r in CP.select_site(caps, "output").collect()] == [2.0]


def test_facets_pipe_before_slice_and_gradients(spark):
    df = spark.createDataFrame([("m/a", [1.0, 2.0, 3.0, 4.0], [0.0, -1.0, 5.0, 7.0]), ("m/b", [9.0, 9.0, 9.0, 9.0], None)],
                               "path string, values array<double>, gradients array<double>")

    def last_two(**kw):
        return {r.path: (r.label, r["values"]) for r in CP.capture_values(df, [4], [(2, 4)], **kw).collect()}
    assert last_two() == {"m/a": ("m/a", [3.0, 4.0]), "m/b": ("m/b", [9.0, 9.0])}
    turned = last_two(pipe=F.reverse, scale="200%", label="end")  # the pipe sees the whole tensor
    assert turned["m/a"] == ("end", [4.0, 2.0])
    assert last_two(grad=True) == {"m/a": ("m/a", [5.0, 7.0]), "m/b": ("m/b", None)}
    whole = CP.capture_values(df, [4], grad=True, normalize=True).collect()
    assert abs(sum(whole[0]["values"])) < 1e-9 and whole[1]["values"] is None
