"""Registered loss / evaluation / optimiser queries (section D, first half).

Logits: ``embeddings.embedding`` (64 classes) with target = ``label``.
Sequences: per order, the quantities of its lines in line-number order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import arrays as A
from weft.operators import evaluate as EV
from weft.operators import optim as OP
from weft.operators.random import argmax_sample
from weft.plans.catalog import REGISTRY, register
from weft.plans.tensor_q import EMB_SQL, LI_SQL, emb, lineitem_scalars
from weft.sources.tables import Tables


def R(c, d=6):
    return F.round(c, d)


def r(x, d=6):
    return f"round({x}, {d})"


def ids_md5(c):
    return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))


CE_SQL = f"""{EMB_SQL},
z AS (SELECT vec_id, label, v, list_max(v) AS m, ln(list_sum(list_transform(v, lambda a: exp(a - list_max(v))))) AS lse FROM e),
l AS (SELECT label, -(v[label + 1] - m - lse) AS nll, -(list_avg(v) - m - lse) AS unif FROM z)"""


@register("d01_cross_entropy", "D-01 D-02 D-03 D-04", sql=f"""WITH {CE_SQL}
SELECT label, {r('SUM(nll)', 4)} AS loss_sum, CAST(COUNT(*) AS BIGINT) AS n_valid, {r('AVG(nll)')} AS loss_mean,
       {r('exp(AVG(nll))')} AS perplexity, {r('AVG(0.9 * nll + 0.1 * unif)')} AS smooth_mean FROM l GROUP BY label""")
def d01_cross_entropy(spark, sf_dir):
    """Plain and label-smoothed (alpha 0.1) cross entropy per label in one scan and one aggregation."""
    e = emb(spark, sf_dir)
    x = e.select("label", EV.nll_row(F.col("v"), "label").alias("nll"),
                 EV.smoothed_row(F.col("v"), "label", 0.1).alias("sm"))
    g = x.groupBy("label").agg(F.sum("nll").alias("loss_sum"), F.count("nll").alias("n_valid"), F.avg("sm").alias("smooth_mean"))
    mean = F.when(F.col("n_valid") > 0, F.col("loss_sum") / F.col("n_valid")).otherwise(0.0)
    return g.select("label", R(F.col("loss_sum"), 4).alias("loss_sum"), "n_valid", R(mean).alias("loss_mean"),
                    R(F.exp(mean)).alias("perplexity"), R(F.col("smooth_mean")).alias("smooth_mean"))


@register("d05_mse_fit", "D-05 D-42", sql=f"""
WITH f AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y, 0.9 * l_quantity + 1.0 AS yh FROM lineitem)
SELECT l_returnflag, {r('SUM((yh - y) * (yh - y))', 4)} AS sse, {r('AVG((yh - y) * (yh - y))')} AS mse,
       {r('SUM((yh - y) * x)', 4)} AS grad_w, {r('SUM(yh - y)', 4)} AS grad_b FROM f GROUP BY l_returnflag""")
def d05_mse_fit(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    f = li.select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"),
                  (F.col("l_quantity") * 0.9 + 1.0).alias("yh"))
    g = OP.mse_gradient(f, "x", "yh", "y", ["l_returnflag"])
    mse = f.groupBy("l_returnflag").agg(F.avg((F.col("yh") - F.col("y")) ** 2).alias("mse"))
    return g.join(mse, "l_returnflag").select("l_returnflag", R(F.col("sse"), 4).alias("sse"), R(F.col("mse")).alias("mse"),
                                              R(F.col("grad_w"), 4).alias("grad_w"), R(F.col("grad_b"), 4).alias("grad_b"))


def order_seqs(spark, sf_dir):
    """Per order: quantities (ints) and a label array (-100 where the line is not returned 'N')."""
    li = Tables(spark, sf_dir).lineitem
    s = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"),
        F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("int")).otherwise(EV.IGNORE_INDEX).alias("lab")))).alias("_l"))
    return s.select("l_orderkey", F.col("_l.q").alias("target"), F.col("_l.lab").alias("labels"))


SEQ_SQL = """s AS (SELECT l_orderkey, list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber, l_partkey, l_suppkey) AS target,
                  list(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS INTEGER) ELSE -100 END ORDER BY l_linenumber, l_partkey, l_suppkey) AS labels
           FROM lineitem GROUP BY l_orderkey)"""


@register("d06_token_matches", "D-06 D-07", sql=f"""WITH {SEQ_SQL},
p AS (SELECT l_orderkey, target, list_sort(target) AS ps, target[1:len(target) - 1] AS pp FROM s)
SELECT l_orderkey, CAST(len(list_filter(list_transform(range(len(ps)), lambda i: ps[i + 1] = target[i + 1]), lambda b: b)) AS INTEGER) AS n_match_sorted,
       CAST(list_bool_and(list_transform(range(len(ps)), lambda i: ps[i + 1] = target[i + 1])) IS NOT FALSE AS INTEGER) AS must_sorted,
       CAST(CASE WHEN len(pp) = len(target) THEN 1 ELSE 0 END AS INTEGER) AS n_match_prefix,
       CAST(list_bool_and(list_transform(range(len(pp)), lambda i: pp[i + 1] = target[i + 1])) IS NOT FALSE AS INTEGER) AS must_prefix,
       CAST(len(pp) AS INTEGER) AS prefix_len
FROM p""")
def d06_token_matches(spark, sf_dir):
    s = order_seqs(spark, sf_dir)
    ps = F.array_sort("target")
    pp = F.slice("target", 1, F.size("target") - 1)
    cnt = lambda m: F.size(F.filter(m, lambda b: b))
    return s.select("l_orderkey", cnt(EV.token_matches(ps, F.col("target"))).alias("n_match_sorted"),
                    EV.must_match(ps, F.col("target")).alias("must_sorted"),
                    cnt(EV.token_matches(pp, F.col("target"))).alias("n_match_prefix"),
                    EV.must_match(pp, F.col("target")).alias("must_prefix"), F.size(pp).alias("prefix_len"))


@register("d09_masked_accuracy", "D-09 D-10 D-16", sql=f"""WITH {SEQ_SQL},
p AS (SELECT l_orderkey, target, labels, list_sort(target) AS pred FROM s),
a AS (SELECT *, len(list_filter(labels, lambda v: v <> -100)) AS n,
             len(list_filter(list_transform(range(len(labels)), lambda i: labels[i + 1] <> -100 AND pred[i + 1] = labels[i + 1]), lambda b: b)) AS hits FROM p)
SELECT l_orderkey, {r('CASE WHEN n > 0 THEN hits / n ELSE 0.0 END')} AS accuracy,
       md5(array_to_string(pred[3:], ',')) AS decoder_slice_md5,
       md5(array_to_string(list_transform(range(len(labels)), lambda i: CASE WHEN labels[i + 1] <> -100 THEN pred[i + 1] ELSE target[i + 1] END), ',')) AS mlm_md5
FROM a""")
def d09_masked_accuracy(spark, sf_dir):
    s = order_seqs(spark, sf_dir).withColumn("pred", F.array_sort("target"))
    acc, _ = EV.masked_accuracy(F.col("pred"), F.col("labels"))
    sl = EV.prediction_slice(F.col("pred"), "decoder", prompt_len=F.lit(2))
    return s.select("l_orderkey", R(acc).alias("accuracy"), ids_md5(sl).alias("decoder_slice_md5"),
                    ids_md5(EV.mlm_fill(F.col("pred"), F.col("labels"), F.col("target"))).alias("mlm_md5"))


@register("d11_aggregate_metrics", "D-11", sql=f"""WITH {SEQ_SQL},
p AS (SELECT l_orderkey, target, labels, list_sort(target) AS pred FROM s),
a AS (SELECT CASE WHEN len(list_filter(labels, lambda v: v <> -100)) > 0 THEN
               len(list_filter(list_transform(range(len(labels)), lambda i: labels[i + 1] <> -100 AND pred[i + 1] = labels[i + 1]), lambda b: b))
               / len(list_filter(labels, lambda v: v <> -100)) ELSE 0.0 END AS accuracy,
             CAST(list_bool_and(list_transform(range(len(pred)), lambda i: pred[i + 1] = target[i + 1])) IS NOT FALSE AS DOUBLE) AS must_match,
             list_avg(list_transform(range(len(pred)), lambda i: CASE WHEN pred[i + 1] = target[i + 1] THEN 1.0 ELSE 0.0 END)) AS matches FROM p)
SELECT 'accuracy' AS metric, {r('AVG(accuracy)')} AS value FROM a
UNION ALL SELECT 'must_match', {r('AVG(must_match)')} FROM a
UNION ALL SELECT 'character_level_accuracy', {r('AVG(matches)')} FROM a""")
def d11_aggregate_metrics(spark, sf_dir):
    s = order_seqs(spark, sf_dir).withColumn("pred", F.array_sort("target"))
    acc, _ = EV.masked_accuracy(F.col("pred"), F.col("labels"))
    per = s.select(acc.alias("accuracy"), EV.must_match(F.col("pred"), F.col("target")).cast("boolean").alias("must_match"),
                   EV.token_matches(F.col("pred"), F.col("target")).alias("matches"))
    return EV.aggregate_metrics(per, ["accuracy", "must_match", "matches"]).select("metric", R(F.col("value")).alias("value"))


@register("d12_unique_completions", "D-12", sql=f"""WITH {SEQ_SQL}
SELECT CAST(COUNT(DISTINCT list_sort(target)) AS BIGINT) AS unique_completions, CAST(COUNT(*) AS BIGINT) AS n_examples FROM s""")
def d12_unique_completions(spark, sf_dir):
    s = order_seqs(spark, sf_dir)
    return s.agg(F.countDistinct(F.array_sort("target")).alias("unique_completions"), F.count("*").alias("n_examples"))


@register("d13_validation_subset", "D-13 B-07", sql=f"""WITH {SEQ_SQL}
SELECT l_orderkey, md5(array_to_string(target, ',')) AS target_md5 FROM s ORDER BY l_orderkey LIMIT 100""")
def d13_validation_subset(spark, sf_dir):
    """The first 100 examples in index order (take_first: the limit is the operator)."""
    from weft.operators.batching import take_first
    s = take_first(order_seqs(spark, sf_dir), ["l_orderkey"], 100)
    return s.select("l_orderkey", ids_md5(F.col("target")).alias("target_md5"))


@register("d14_sample_next", "D-14 C-43", sql=f"""WITH {EMB_SQL}
SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS next_token FROM e""")
def d14_sample_next(spark, sf_dir):
    """Temperature 0: greedy argmax (lowest index on ties)."""
    return emb(spark, sf_dir).select("vec_id", argmax_sample(F.col("v")).alias("next_token"))


@register("d15_append_tokens", "D-15", sql=f"""WITH {SEQ_SQL},
n AS (SELECT l_orderkey, target, list_max(target) AS nxt, len(target) > 0 AND list_contains([50, 49], target[-1]) AS done FROM s),
a AS (SELECT l_orderkey, CASE WHEN done THEN target ELSE list_concat(target, [nxt]) END AS seq FROM n)
SELECT l_orderkey, md5(array_to_string(seq, ',')) AS seq_md5, NOT list_contains([50, 49], seq[-1]) AS running FROM a""")
def d15_append_tokens(spark, sf_dir):
    s = order_seqs(spark, sf_dir)
    new, running = EV.append_tokens(F.col("target"), F.array_max("target"), [50, 49])
    return s.select("l_orderkey", ids_md5(new).alias("seq_md5"), running.alias("running"))


# --- optimiser updates -------------------------------------------------------------

KEYS = ["name", "idx", "part", "supp"]  # (order, line, part, supplier) is the unique line key


def param_grads(spark, sf_dir):
    s = lineitem_scalars(spark, sf_dir)
    return s.select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("idx"), "part", "supp",
                    F.col("p").alias("param"), F.col("x").alias("grad"), (F.col("y") - 0.4).alias("grad2"))


PG_SQL = f"{LI_SQL}, pg AS (SELECT l_orderkey AS name, l_linenumber AS idx, part, supp, p AS param, x AS grad, y - 0.4 AS grad2 FROM li)"


@register("d35_sgd_momentum", "D-35", sql=f"""WITH {PG_SQL}
SELECT name, idx, part, supp, {r('param - 0.1 * (grad2 + 0.01 * param)', 9)} AS param FROM pg""")
def d35_sgd_momentum(spark, sf_dir):
    """Two SGD steps with momentum 0.9 and weight decay 0.01: the first stores a zero buffer
    and moves nothing; the second uses buf = 0.9 * 0 + grad2."""
    pg = param_grads(spark, sf_dir)
    s1 = OP.sgd_step(pg.select(*KEYS, "param", "grad"), 0.1, momentum=0.9, weight_decay=0.01, keys=KEYS)
    pg2 = s1.select(*KEYS, "param").join(pg.select(*KEYS, F.col("grad2").alias("grad")), KEYS)
    s2 = OP.sgd_step(pg2, 0.1, momentum=0.9, weight_decay=0.01, state=s1.select(*KEYS, "buf"), keys=KEYS)
    return s2.select(*KEYS, R(F.col("param"), 9).alias("param"))


def _adam_sql(decoupled: bool, amsgrad: bool) -> str:
    lr, b1, b2, eps, wd = 0.01, 0.9, 0.999, 1e-8, 0.1
    def step(p, g, s, m0, v0, x0):
        pp = f"({p}) * {1 - lr * wd}" if decoupled else p
        gg = g if decoupled else f"({g} + ({p}) * {wd})"
        m = f"({m0} * {b1} + {gg} * {1 - b1})"
        v = f"({v0} * {b2} + {gg} * {gg} * {1 - b2})"
        x = f"greatest({x0}, {v})" if amsgrad else x0
        den = f"(sqrt({x if amsgrad else v}) / sqrt(1 - pow({b2}, {s})) + {eps})"
        return f"{pp} - ({lr} / (1 - pow({b1}, {s}))) * {m} / {den}", m, v, x
    p1, m1, v1, x1 = step("param", "grad", 1, "0.0", "0.0", "0.0")
    p2, _, _, _ = step("p1", "grad2", 2, "m1", "v1", "x1")
    return f"""WITH {PG_SQL},
a1 AS (SELECT name, idx, part, supp, grad2, {p1} AS p1, {m1} AS m1, {v1} AS v1, {x1} AS x1 FROM pg)
SELECT name, idx, part, supp, {r(p2)} AS param FROM a1"""


def _adam_query(spark, sf_dir, decoupled, amsgrad):
    pg = param_grads(spark, sf_dir)
    kw = dict(lr=0.01, betas=(0.9, 0.999), eps=1e-8, weight_decay=0.1, amsgrad=amsgrad, decoupled=decoupled, keys=KEYS)
    s1 = OP.adam_step(pg.select(*KEYS, "param", "grad"), **kw)
    pg2 = s1.select(*KEYS, "param").join(pg.select(*KEYS, F.col("grad2").alias("grad")), KEYS)
    s2 = OP.adam_step(pg2, state=s1.drop("param"), **kw)
    return s2.select(*KEYS, R(F.col("param")).alias("param"))


@register("d36_adam", "D-36", sql=_adam_sql(False, False))
def d36_adam(spark, sf_dir):
    """Two Adam steps (coupled weight decay 0.1)."""
    return _adam_query(spark, sf_dir, False, False)


@register("d37_adamw_amsgrad", "D-37", sql=_adam_sql(True, True))
def d37_adamw_amsgrad(spark, sf_dir):
    """Two AdamW steps (decoupled decay 0.1) with amsgrad."""
    return _adam_query(spark, sf_dir, True, True)


@register("d40_grad_norm_clip", "D-40 D-41", sql=f"""WITH {PG_SQL},
t AS (SELECT name, sqrt(SUM(grad * grad)) AS n FROM pg GROUP BY name),
tot AS (SELECT sqrt(SUM(n * n)) AS total FROM t)
SELECT name, idx, part, supp, {r('grad * least(1.0, 5.0 / (total + 1e-6))')} AS grad, {r('total', 4)} AS total_norm FROM pg, tot""")
def d40_grad_norm_clip(spark, sf_dir):
    pg = param_grads(spark, sf_dir).select(*KEYS, "grad")
    total = OP.total_grad_norm(pg, ["name"]).scalar()
    c = OP.clip_grad_norm(pg, ["name"], 5.0)
    return c.select(*KEYS, R(F.col("grad")).alias("grad"), R(total, 4).alias("total_norm"))


@register("d42_softmax_gradient", "D-42", sql=f"""{"WITH " + EMB_SQL},
z AS (SELECT vec_id, label, v, list_max(v) AS m, list_sum(list_transform(v, lambda a: exp(a - list_max(v)))) AS s FROM e),
g AS (SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS c, unnest(list_transform(range(64), lambda k: exp(v[k + 1] - m) / s - CASE WHEN k = label THEN 1.0 ELSE 0.0 END)) AS d, v FROM z),
x AS (SELECT c, CAST(unnest(range(64)) AS INTEGER) AS j, d * unnest(v) AS gx FROM g)
SELECT c, j, {r('SUM(gx)')} AS grad FROM x GROUP BY c, j""")
def d42_softmax_gradient(spark, sf_dir):
    """Cross-entropy gradient of a linear layer: sum_i (softmax(z_i) - onehot(y_i)) x_i^T,
    a (64 x 64) table."""
    e = emb(spark, sf_dir)
    d = F.zip_with(A.softmax("v"), A.one_hot(F.col("label"), 64), lambda p, o: p - o)
    x = e.select(F.posexplode(d).alias("c", "d"), F.col("v").alias("x"))
    x = x.select("c", "d", F.posexplode("x").alias("j", "xv"))
    return x.groupBy("c", "j").agg(R(F.sum(F.col("d") * F.col("xv"))).alias("grad"))


@register("d44_count_parameters", "D-44", sql=f"""WITH {EMB_SQL}
SELECT CAST(SUM(len(v)) AS BIGINT) AS n_params, {r('SUM(list_sum(v))', 4)} AS param_sum FROM e""")
def d44_count_parameters(spark, sf_dir):
    p = emb(spark, sf_dir).select(F.array(F.size("v").cast("long")).alias("shape"), "v")
    return OP.count_parameters(p, "shape", "v").select("n_params", R(F.col("param_sum"), 4).alias("param_sum"))


@register("d45_checkpoint_resume", "D-45", sql=REGISTRY["d36_adam"].sql)
def d45_checkpoint_resume(spark, sf_dir):
    """Adam step 1, its state written as a checkpoint table (Parquet + JSON skeleton) in the
    checkpoint folder, read back leniently and resumed for step 2: equals two uninterrupted steps."""
    import uuid
    from weft.session import checkpoint_dir
    pg = param_grads(spark, sf_dir)
    kw = dict(lr=0.01, betas=(0.9, 0.999), eps=1e-8, weight_decay=0.1, amsgrad=False, decoupled=False, keys=KEYS)
    s1 = OP.adam_step(pg.select(*KEYS, "param", "grad"), **kw)
    root = f"{checkpoint_dir(spark)}/optim-{uuid.uuid4().hex[:8]}"
    OP.write_checkpoint(s1, {"optimizer": "adam", "step": 1, "keys": KEYS}, root)
    state, skeleton = OP.load_checkpoint(spark, root, pg.select("name"))
    keys = skeleton["keys"]
    pg2 = state.select(*keys, "param").join(pg.select(*keys, F.col("grad2").alias("grad")), keys)
    s2 = OP.adam_step(pg2, state=state.drop("param"), **kw)
    return s2.select(*keys, R(F.col("param")).alias("param"))
