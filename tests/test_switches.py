"""Task switches and vocabularies, batches with failed items, forked seeds, Unicode forms, group checks."""
import unicodedata

import pytest
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import batching as B
from weft.operators import optim as O
from weft.operators import task_tokens as TT


def test_vocabularies(spark):
    assert TT.vocabulary("addition", max_value=10)[:2] + TT.vocabulary("addition", max_value=10)[-3:] == ["00", "01", "10", "+", "="]
    assert TT.vocabulary("parity", colon=False) == ["0", "1", "even", "odd"]
    assert TT.vocabulary("repeat", alphabet=2, commas=True) == ["A", "B", ":", ","]
    assert len(TT.vocabulary("copy_memory", vocab=10)) == 12 and TT.vocabulary("copy_memory", vocab=3, recall=False, commas=True)[-2:] == ["L3", ","]
    assert TT.vocabulary("dyck", order=2) == ["(", ")", "[", "]"] and TT.vocabulary("dyck", order=4)[-2:] == ["(2", ")2"]
    table = TT.vocab_table(spark, "slapjack").orderBy("id").collect()
    assert [r.token for r in table][-5:] == [TT.SLAP, TT.NO_SLAP, "<bos>", "<eos>", "<mask>"] and table[-1].id == len(TT.CARDS) + 5
    for task in ("modular_addition", "marked_addition", "two_sum", "reverse", "sort", "temporal_order", "random", "zeros", "elman"):
        words = TT.vocabulary(task, commas=True)
        assert len(words) == len(set(words))
    with pytest.raises(ValueError):
        TT.vocabulary("chess")


def test_switches_follow_the_rules(spark):
    def rows(task, **kw):
        p, t = TT.TOKEN_TASKS[task](F.col("id"), 5, **kw)
        return [(r.p, r.t) for r in spark.range(120).select(p.alias("p"), t.alias("t")).collect()]
    for p, t in rows("addition"):
        assert p[1::2] == ["+", "="] and int(p[0]) + int(p[2]) == int(t[0])
    assert all(len(p) == 2 and int(p[0]) + int(p[1]) == int(t[0]) for p, t in rows("addition", expression=False))
    for p, t in rows("copy_memory", distractors=2, commas=True):
        assert p[1::2] == [","] * 5 and p[-1] == "?" and p[:5:2] == t
    assert all(p == t and len(p) == 3 for p, t in rows("copy_memory", distractors=0, recall=False))
    for p, t in rows("repeat", commas=True):
        assert p == t + [":"] and t[1::2] == [",", ","]
    for p, t in rows("parity"):
        assert p[-1] == ":" and t == [("even", "odd")[p.count("1") % 2]]
    for doubles in (True, False):
        for sandwiches in (True, False):
            for p, t in rows("slapjack", length=7, doubles=doubles, sandwiches=sandwiches, colon=False):
                want = [c == "J" or doubles and i > 0 and c == p[i - 1] or sandwiches and i > 1 and c == p[i - 2] for i, c in enumerate(p)]
                assert t == [TT.SLAP if w else TT.NO_SLAP for w in want]
    for p, t in rows("two_sum", commas=True):
        assert p[7] == ":" and p[9] == "=" and t[1] == "," and int(t[0]) + int(t[2]) == int(p[8]) and {t[0], t[2]} <= set(p[:7:2])
    ids = spark.range(1).select(TT.token_ids(F.array(F.lit("odd"), F.lit("?")), TT.vocabulary("parity")).alias("i")).first().i
    assert ids == [4, None]


def test_batches_with_failed_items(spark):
    rows = [(i, f"v{i}", {3: "late", 2: "early", 9: "tail"}.get(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "idx long, v string, error string").repartition(3)
    got = {r.batch: r for r in B.batch_results(df, "idx", ["v"], "error", size=4).collect()}
    assert set(got) == {0, 1} and got[0].error == "early" and got[0].columns is None
    assert got[1].columns.v == ["v4", "v5", "v6", "v7"] and got[1].error is None
    kept = {r.batch: r for r in B.batch_results(df, "idx", ["v"], "error", size=4, drop_last=False).collect()}
    assert kept[2].error == "tail" and kept[2].n_rows == 2
    assert B.batch_results(df, "idx", ["v"], "error").count() == 0 == B.batch_results(df.limit(0), "idx", ["v"], "error", drop_last=False).count()


def test_forked_seeds(spark):
    df = spark.range(500).select(B.fork_seed("id").alias("a"), B.fork_seed("id", 1).alias("b"), B.fork_seed(F.lit(None).cast("long")).alias("none"))
    got = df.collect()
    assert len({r.a for r in got} | {r.b for r in got}) > 990 and all(-2 ** 31 <= r.a < 2 ** 31 for r in got)
    assert got == spark.range(500).repartition(7).orderBy("id").select(*[c for c in (
        B.fork_seed("id").alias("a"), B.fork_seed("id", 1).alias("b"), B.fork_seed(F.lit(None).cast("long")).alias("none"))]).collect()


def test_unicode_forms_and_sequences(spark):
    texts = ["e\u0301", "\u00e9", "\ufb01n \u212b", "\u1e9b\u0323", "한글", "", "  \u00a0x ", None, "👩‍👩‍👧"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for form in T.UNICODE_FORMS:
        got = [r.n for r in df.select("id", T.unicode_form("t", form).alias("n")).orderBy("id").collect()]
        assert got == [None if t is None else unicodedata.normalize(form, t) for t in texts]
    steps = ["NFKC", "strip", "lower", ("prepend", "_")]
    got = [r.n for r in df.select("id", T.normalize_sequence("t", steps).alias("n")).orderBy("id").collect()]
    want = [None if t is None else unicodedata.normalize("NFKC", t).strip().lower() for t in texts]
    assert got == [w and "_" + w for w in want]
    turned = df.select(T.normalize_sequence("t", [("prepend", " A"), "strip_left"]).alias("n")).collect()
    assert turned[1].n == "A\u00e9" and turned[5].n == ""
    for wrong in ("NFX", ("append", "x")):
        with pytest.raises(ValueError):
            T.normalize_sequence("t", [wrong])


def test_group_flags_and_check(spark):
    rows = [("a", "weight", "parameter", "Linear"), ("a", "bias", "parameter", "Linear"), ("n", "weight", "parameter", "LayerNorm"),
            ("n", "scale", "parameter", "LayerNorm"), ("e", "weight", "parameter", "Embedding"), ("b", "weight", "buffer", "Linear"), ("x", "weight", None, None)]
    df = spark.createDataFrame(rows, "path string, param_name string, kind string, type_name string")
    plain = {(r.path, r.param_name): r.group for r in O.param_groups(df).collect()}
    assert plain == {("a", "weight"): "decay", ("a", "bias"): "no_decay", ("n", "weight"): "no_decay", ("n", "scale"): "no_decay",
                     ("e", "weight"): "decay", ("x", "weight"): "decay"}
    O.check_param_groups(O.param_groups(df))
    g = O.param_groups(df, decayed=["Linear"], undecayed=["LayerNorm"])
    assert {(r.path, r.param_name) for r in g.where("missing").collect()} == {("e", "weight"), ("x", "weight")} and g.where("overlap").count() == 0
    assert {r.param_name for r in g.where("path = 'n' and group = 'decay'").collect()} == {"scale"}
    with pytest.raises(ValueError, match="2 parameters are in no decay group: e.weight, x.weight"):
        O.check_param_groups(g)
    with pytest.raises(ValueError, match="both decay groups: a.weight"):
        O.check_param_groups(O.param_groups(df.where("path = 'a'"), decayed=["Linear"], undecayed=["Linear"]))
