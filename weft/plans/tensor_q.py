"""Registered tensor-operator queries (section C).

Scalars come from ``lineitem`` (x = 10*discount - 0.5 in [-0.5, 0.5], y = 10*tax in
[0, 0.8], q = quantity, p = extendedprice / 1000); matrices from ``embeddings``
(N x 64, row i = vec_id, logits over 64 classes, 10 labels).  Float results are
rounded to 6 decimals in both the query and the oracle; array results are
returned in the long encoding (one row per element).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import arrays as A
from weft.functions import elementwise as E
from weft.functions.hashing import uniform, uniform_sql
from weft.operators import tensors as TS
from weft.operators import tiles as TL
from weft.plans.catalog import register
from weft.sources.tables import Tables

INF = float("inf")


def R(c):
    return F.round(c, 6)


def lineitem_scalars(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
                     (F.col("l_discount") * 10 - 0.5).alias("x"), (F.col("l_tax") * 10).alias("y"),
                     F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("p"))


LI_SQL = """li AS (SELECT l_orderkey, l_linenumber, l_partkey AS part, l_suppkey AS supp, l_discount * 10 - 0.5 AS x, l_tax * 10 AS y,
                   l_quantity AS q, l_extendedprice / 1000 AS p FROM lineitem)"""
EMB_SQL = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def emb(spark, sf_dir):
    return Tables(spark, sf_dir).embeddings.select("vec_id", "label", A.dbl("embedding").alias("v"))


def sig_sql(x):
    return f"(CASE WHEN {x} >= 0 THEN 1.0 / (1.0 + exp(-({x}))) ELSE exp({x}) / (1.0 + exp({x})) END)"


def div_sql(a, b):
    return (f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) WHEN ({a}) > 0 THEN 'inf'::DOUBLE "
            f"WHEN ({a}) < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END)")


def r(x):
    return f"round({x}, 6)"


# --- C1 -------------------------------------------------------------------------

@register("c01_unary", "C-01 C-02 C-03 C-04 C-05 C-06 C-07 C-08 C-09 C-10 C-11 C-12 C-13 C-14 C-15 C-16 C-17 C-18 C-19 C-20 C-21",
          sql=f"""WITH {LI_SQL}
SELECT l_orderkey, l_linenumber, {r('exp(x)')} AS exp_x,
  {r("CASE WHEN y > 0 THEN ln(y) WHEN y = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END")} AS log_y,
  {r('sin(p)')} AS sin_p, {r('cos(p)')} AS cos_p, {r('abs(x)')} AS abs_x, {r('-x')} AS neg_x, {r('x * x')} AS square_x,
  {r("CASE WHEN x >= 0 THEN sqrt(x) ELSE 'nan'::DOUBLE END")} AS sqrt_x, {r(div_sql('1.0', 'x'))} AS recip_x,
  {r('floor(p)')} AS floor_p, {r('ceil(p)')} AS ceil_p, {r('tanh(q - 25)')} AS tanh_q,
  {r(sig_sql('x * 10'))} AS sigmoid_x, {r('greatest(x, 0.0)')} AS relu_x, {r('greatest(x, 0.0) * greatest(x, 0.0)')} AS relu2_x,
  {r('x * ' + sig_sql('x'))} AS silu_x, {r('x * x * ' + sig_sql('x'))} AS swiglu_x,
  {r(f'x * (0.5 + 0.5 * tanh(x * ({E.GELU_A} * x * x + {E.GELU_B})))')} AS gelu_x,
  CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS not_odd,
  CAST(isnan({div_sql('x', 'x')}) AS INTEGER) AS isnan_xx, CAST(abs({div_sql('1.0', 'x')}) = 'inf'::DOUBLE AS INTEGER) AS isinf_rx
FROM li""")
def c01_unary(spark, sf_dir):
    s = lineitem_scalars(spark, sf_dir)
    return s.select(
        "l_orderkey", "l_linenumber", R(E.exp("x")).alias("exp_x"), R(E.log("y")).alias("log_y"),
        R(E.sin("p")).alias("sin_p"), R(E.cos("p")).alias("cos_p"), R(E.abs_("x")).alias("abs_x"),
        R(E.neg("x")).alias("neg_x"), R(E.square("x")).alias("square_x"), R(E.sqrt("x")).alias("sqrt_x"),
        R(E.recip("x")).alias("recip_x"), R(E.floor("p")).alias("floor_p"), R(E.ceil("p")).alias("ceil_p"),
        R(E.tanh(F.col("q") - 25)).alias("tanh_q"), R(E.sigmoid(F.col("x") * 10)).alias("sigmoid_x"),
        R(E.relu("x")).alias("relu_x"), R(E.relu2("x")).alias("relu2_x"), R(E.silu("x")).alias("silu_x"),
        R(E.swiglu("x")).alias("swiglu_x"), R(E.gelu("x")).alias("gelu_x"),
        E.logical_not(F.col("l_linenumber") % 2).alias("not_odd"),
        E.isnan(E.div("x", "x")).alias("isnan_xx"), E.isinf(E.recip("x")).alias("isinf_rx"))


# --- C2 -------------------------------------------------------------------------

@register("c22_binary", "C-22 C-23 C-24 C-25 C-26 C-27 C-28 C-29 C-30 C-31 C-32 C-33 C-34 C-35 C-36 C-37",
          sql=f"""WITH {LI_SQL}
SELECT l_orderkey, l_linenumber, {r('x + y')} AS add_xy, {r('x - y')} AS sub_xy, {r('x * p')} AS mul_xp,
  {r(div_sql('x', 'y'))} AS div_xy, {r('sign(x) * pow(abs(x), 2.0)')} AS pow_x2, {r('sign(x) * pow(abs(x), y)')} AS pow_xy,
  {r('greatest(x, y - 0.4)')} AS max_xy, {r('least(x, y - 0.4)')} AS min_xy,
  {r('p + 0.5 * ' + div_sql('x', 'y'))} AS addcdiv_, {r('p + 0.5 * x * y')} AS addcmul_,
  CAST(x = 0 AS INTEGER) AS eq0, CAST(x <> 0 AS INTEGER) AS ne0, CAST(x < y AS INTEGER) AS lt_xy,
  CAST(x <= y AS INTEGER) AS le_xy, CAST(x > y AS INTEGER) AS gt_xy, CAST(x >= y AS INTEGER) AS ge_xy,
  CAST((x <> 0) AND (y <> 0) AS INTEGER) AS and_xy, CAST((x <> 0) OR (y <> 0) AS INTEGER) AS or_xy,
  CAST((x <> 0) <> (y <> 0) AS INTEGER) AS xor_xy, {r('x + 0.3 * (p - x)')} AS lerp_,
  {r('x * 2.0 + 1.0')} AS affine_, {r('CASE WHEN l_linenumber % 2 <> 0 THEN x ELSE y END')} AS where_,
  {r('least(greatest(x, -0.2), 0.3)')} AS clamp_, CAST(trunc(p * 10) AS INTEGER) AS cast_i32
FROM li""")
def c22_binary(spark, sf_dir):
    s = lineitem_scalars(spark, sf_dir)
    return s.select(
        "l_orderkey", "l_linenumber", R(E.add("x", "y")).alias("add_xy"), R(E.sub("x", "y")).alias("sub_xy"),
        R(E.mul("x", "p")).alias("mul_xp"), R(E.div("x", "y")).alias("div_xy"),
        R(E.pow_("x", 2.0)).alias("pow_x2"), R(E.pow_("x", "y")).alias("pow_xy"),
        R(E.maximum("x", F.col("y") - 0.4)).alias("max_xy"), R(E.minimum("x", F.col("y") - 0.4)).alias("min_xy"),
        R(E.addcdiv("p", "x", "y", 0.5)).alias("addcdiv_"), R(E.addcmul("p", "x", "y", 0.5)).alias("addcmul_"),
        E.cmp("eq", "x", 0).alias("eq0"), E.cmp("ne", "x", 0).alias("ne0"), E.cmp("lt", "x", "y").alias("lt_xy"),
        E.cmp("le", "x", "y").alias("le_xy"), E.cmp("gt", "x", "y").alias("gt_xy"), E.cmp("ge", "x", "y").alias("ge_xy"),
        E.logical("and", "x", "y").alias("and_xy"), E.logical("or", "x", "y").alias("or_xy"),
        E.logical("xor", "x", "y").alias("xor_xy"), R(E.lerp("x", "p", 0.3)).alias("lerp_"),
        R(E.affine("x", 2.0, 1.0)).alias("affine_"),
        R(E.where_cond("x", F.col("l_linenumber") % 2, "y")).alias("where_"),
        R(E.clamp("x", -0.2, 0.3)).alias("clamp_"), E.cast(F.col("p") * 10, "i32").alias("cast_i32"))


# --- C3 reductions --------------------------------------------------------------

@register("c38_reduce_rows", "C-38 C-39 C-40 C-41 C-42 C-43 C-44 C-45", sql=f"""WITH {EMB_SQL}
SELECT vec_id, {r('list_sum(v)')} AS sum_, {r('list_avg(v)')} AS mean_, {r('list_var_samp(v)')} AS var_,
  {r('list_max(v)')} AS max_, {r('list_min(v)')} AS min_,
  CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS argmax_, CAST(list_position(v, list_min(v)) - 1 AS INTEGER) AS argmin_,
  {r('sqrt(list_sum(list_transform(v, lambda a: a * a)))')} AS norm2, {r('list_max(list_transform(v, lambda a: abs(a)))')} AS norm_inf,
  {r('list_min(list_transform(v, lambda a: abs(a)))')} AS norm_ninf, CAST(len(list_filter(v, lambda a: a <> 0)) AS DOUBLE) AS norm0,
  {r('list_sum(list_transform(v, lambda a: abs(a)))')} AS norm1,
  {r('len(v) / list_sum(list_transform(v, lambda a: 1.0 / abs(a)))')} AS norm_n1,
  {r('pow(list_sum(list_transform(v, lambda a: pow(abs(a), 3.0))), 1.0 / 3.0)')} AS norm3
FROM e""")
def c38_reduce_rows(spark, sf_dir):
    e = emb(spark, sf_dir)
    v = F.col("v")
    return e.select("vec_id", R(A.asum(v)).alias("sum_"), R(A.amean(v)).alias("mean_"), R(A.avar(v)).alias("var_"),
                    R(A.amax(v)).alias("max_"), R(A.amin(v)).alias("min_"), A.argmax(v).alias("argmax_"),
                    A.argmin(v).alias("argmin_"), R(A.norm(v, 2)).alias("norm2"), R(A.norm(v, INF)).alias("norm_inf"),
                    R(A.norm(v, -INF)).alias("norm_ninf"), A.norm(v, 0).alias("norm0"), R(A.norm(v, 1)).alias("norm1"),
                    R(A.norm(v, -1)).alias("norm_n1"), R(A.norm(v, 3)).alias("norm3"))


EL_SQL = f"{EMB_SQL}, el AS (SELECT vec_id, label, unnest(v) AS val, CAST(unnest(range(len(v))) AS INTEGER) AS j FROM e)"


@register("c38_reduce_cols", "C-38 C-39 C-40 C-41 C-42 C-43 C-44", sql=f"""WITH {EL_SQL},
a AS (SELECT j, SUM(val) AS s, AVG(val) AS m, VAR_SAMP(val) AS vv, MAX(val) AS mx, MIN(val) AS mn,
      arg_min(vec_id, (-val, vec_id)) AS amx, arg_min(vec_id, (val, vec_id)) AS amn FROM el GROUP BY j)
SELECT j, {r('s')} AS sum, {r('m')} AS mean, {r('vv')} AS var, {r('mx')} AS max, {r('mn')} AS min, amx AS argmax, amn AS argmin FROM a""")
def c38_reduce_cols(spark, sf_dir):
    el = TS.to_long(emb(spark, sf_dir), "vec_id", "v", "j", "val")
    red = TS.reduce_rows(el, ["j"], ops=("sum", "mean", "var", "max", "min"))
    am = TS.arg_reduce(el, ["j"], "vec_id", largest=True).join(TS.arg_reduce(el, ["j"], "vec_id", largest=False), "j")
    return red.join(am, "j").select("j", *[R(F.col(c)).alias(c) for c in ("sum", "mean", "var", "max", "min")],
                                    "argmax", "argmin")


@register("c45_matrix_norms", "C-45 C-46 C-48", sql=f"""WITH {EL_SQL},
rs AS (SELECT vec_id, SUM(abs(val)) AS s FROM el GROUP BY vec_id),
cs AS (SELECT j, SUM(abs(val)) AS s FROM el GROUP BY j)
SELECT {r('(SELECT sqrt(SUM(val * val)) FROM el)')} AS fro, {r('(SELECT MAX(s) FROM rs)')} AS norm_inf,
  {r('(SELECT MIN(s) FROM rs)')} AS norm_ninf, {r('(SELECT MAX(s) FROM cs)')} AS norm_1, {r('(SELECT MIN(s) FROM cs)')} AS norm_n1,
  {r('(SELECT AVG(val) FROM el)')} AS mean, {r('(SELECT greatest(0.0, AVG(val * val) - AVG(val) * AVG(val)) FROM el)')} AS var,
  (SELECT CAST(SUM(CASE WHEN isnan(val) THEN 1 ELSE 0 END) AS BIGINT) FROM el) AS n_nan,
  (SELECT CAST(SUM(CASE WHEN isinf(val) THEN 1 ELSE 0 END) AS BIGINT) FROM el) AS n_inf""")
def c45_matrix_norms(spark, sf_dir):
    m = TS.matrix_report(emb(spark, sf_dir).select("v"))
    return m.select(*[R(F.col(c)).alias(c) for c in ("fro", "norm_inf", "norm_ninf", "norm_1", "norm_n1", "mean", "var")], "n_nan", "n_inf")


@register("c47_zscore", "C-46 C-47", sql=f"""WITH {EL_SQL},
s AS (SELECT label, AVG(val) AS mu, greatest(0.0, AVG(val * val) - AVG(val) * AVG(val)) AS var FROM el GROUP BY label)
SELECT vec_id, j, {r('(val - mu) * (1.0 / sqrt(greatest(0.0, var + 1e-5)))')} AS z FROM el JOIN s USING (label)""")
def c47_zscore(spark, sf_dir):
    el = TS.to_long(emb(spark, sf_dir), "vec_id", "v", "j", "val")
    st = TS.tensor_stats(el, ["label"])
    z = (F.col("val") - F.col("mean")) * (1.0 / F.sqrt(F.greatest(F.lit(0.0), F.col("var") + 1e-5)))
    return el.join(st, "label").select("vec_id", "j", R(z).alias("z"))


@register("c49_all_close", "C-49", sql=f"""WITH {EL_SQL},
b AS (SELECT vec_id, j, round(val, 3) AS val2 FROM el),
d AS (SELECT vec_id, j, abs(val - val2) AS err, abs(val - val2) <= 1e-4 + 1e-3 * abs(val2) AS ok FROM el JOIN b USING (vec_id, j))
SELECT CAST(MIN(CASE WHEN ok THEN 1 ELSE 0 END) AS INTEGER) AS all_close, {r('MAX(err)')} AS max_err, {r('AVG(err)')} AS mean_err,
       arg_max(vec_id, (err, -vec_id, -j)) AS worst_i, arg_max(j, (err, -vec_id, -j)) AS worst_j FROM d""")
def c49_all_close(spark, sf_dir):
    both = emb(spark, sf_dir).select("vec_id", "v", F.transform(A.dbl("v"), lambda x: F.round(x, 3)).alias("w"))
    m = TS.all_close(both, "vec_id", "v", "w", atol=1e-4, rtol=1e-3)
    return m.select(F.col("all_close").cast("int").alias("all_close"), R(F.col("max_err")).alias("max_err"),
                    R(F.col("mean_err")).alias("mean_err"), F.col("worst_i"), F.col("worst_j"))


# --- C4 shape ops -----------------------------------------------------------------

@register("c50_reshape", "C-50", sql=f"""WITH {EL_SQL}
SELECT CAST((vec_id * 64 + j) // 32 AS BIGINT) AS i, CAST((vec_id * 64 + j) % 32 AS BIGINT) AS j, {r('val')} AS val FROM el""")
def c50_reshape(spark, sf_dir):
    el = TS.to_long(emb(spark, sf_dir).drop("label"), "vec_id", "v", "j", "val")
    return TS.reshape(el.withColumnRenamed("vec_id", "i"), 64, 32).select("i", "j", R(F.col("val")).alias("val"))


@register("c52_transpose_flip", "C-52 C-53", sql=f"""WITH {EL_SQL}
SELECT j AS i, CAST((SELECT MAX(vec_id) FROM e) - vec_id AS BIGINT) AS j, {r('val')} AS val FROM el""")
def c52_transpose_flip(spark, sf_dir):
    el = TS.to_long(emb(spark, sf_dir).drop("label"), "vec_id", "v", "j", "val").withColumnRenamed("vec_id", "i")
    n = Tables(spark, sf_dir).embeddings.agg(F.max("vec_id") + 1).scalar()
    t = TS.flip(el, "i", n)
    t = TS.transpose(t, "i", "j")
    return t.select("i", F.col("j").cast("long").alias("j"), R(F.col("val")).alias("val"))


@register("c54_narrow_chunk", "C-54 C-55 C-56 C-57", sql=f"""WITH {EL_SQL}
SELECT vec_id AS i, CAST((j - 8) // 20 AS BIGINT) AS chunk, CAST((j - 8) % 20 AS BIGINT) AS j, {r('val')} AS val
FROM el WHERE j >= 8 AND j < 56""")
def c54_narrow_chunk(spark, sf_dir):
    el = TS.to_long(emb(spark, sf_dir).drop("label"), "vec_id", "v", "j", "val").withColumnRenamed("vec_id", "i")
    n = TS.narrow(el, "j", 8, 48)
    return TS.chunk_ids(n, "j", 20).select("i", "chunk", F.col("j").cast("long").alias("j"), R(F.col("val")).alias("val"))


@register("c51_squeeze_slice", "C-51 C-54", sql=f"""WITH {EL_SQL}
SELECT CAST(0 AS BIGINT) AS b, vec_id - 10 AS i, CAST(j - 8 AS INTEGER) AS j, {r('val')} AS val FROM el WHERE vec_id >= 10 AND j >= 8 AND j < 40""")
def c51_squeeze_slice(spark, sf_dir):
    """Two ranges sliced at once from the matrix of all embeddings, under a leading dimension of size one that is
    put on, taken off and put on again."""
    el = TS.to_long(emb(spark, sf_dir).drop("label"), "vec_id", "v", "j", "val").withColumnRenamed("vec_id", "i")
    part = TS.slice_ranges(el, {"i": (10, None), "j": (8, 40)})
    part = TS.unsqueeze(TS.squeeze(TS.unsqueeze(part, "b"), "b"), "b")
    return part.select("b", "i", F.col("j").cast("int").alias("j"), R(F.col("val")).alias("val"))


@register("c58_cat_stack", "C-58 C-59", sql=f"""WITH {EL_SQL}
SELECT CAST(0 AS BIGINT) AS s, vec_id AS i, j, {r('val')} AS val FROM el WHERE j < 24
UNION ALL SELECT 0, vec_id, j + 24, {r('val * 2')} FROM el WHERE j < 24
UNION ALL SELECT 1, vec_id, j - 16, {r('val')} FROM el WHERE j >= 16""")
def c58_cat_stack(spark, sf_dir):
    el = TS.to_long(emb(spark, sf_dir).drop("label"), "vec_id", "v", "j", "val").withColumnRenamed("vec_id", "i")
    a = TS.narrow(el, "j", 0, 24)
    b = a.withColumn("val", F.col("val") * 2)
    c = TS.cat([a, b], "j", [24, 24])
    d = TS.narrow(el, "j", 16, 48)
    return TS.stack([c, d], "s").select("s", "i", F.col("j").cast("int").alias("j"), R(F.col("val")).alias("val"))


@register("c60_broadcast", "C-60", sql=f"""WITH {EL_SQL},
m AS (SELECT j, AVG(val) AS mu FROM el GROUP BY j)
SELECT vec_id AS i, j, {r('val - mu')} AS centered FROM el JOIN m USING (j)""")
def c60_broadcast(spark, sf_dir):
    """Subtract a (1, 64) row vector from an (N, 64) matrix: equi-join on the shared index."""
    el = TS.to_long(emb(spark, sf_dir).drop("label"), "vec_id", "v", "j", "val").withColumnRenamed("vec_id", "i")
    mu = el.groupBy("j").agg(F.avg("val").alias("mu"))  # 64 rows
    return el.join(F.broadcast(mu), "j").select("i", "j", R(F.col("val") - F.col("mu")).alias("centered"))


@register("c61_triu_tril", "C-61", sql=f"""WITH {EL_SQL}
SELECT vec_id AS i, j, {r('CASE WHEN j - (vec_id % 64) >= 1 THEN val ELSE 0.0 END')} AS triu1,
       {r('CASE WHEN j - (vec_id % 64) <= 0 THEN val ELSE 0.0 END')} AS tril0 FROM el""")
def c61_triu_tril(spark, sf_dir):
    el = TS.to_long(emb(spark, sf_dir).drop("label"), "vec_id", "v", "j", "val").withColumnRenamed("vec_id", "i")
    el = el.withColumn("r", F.col("i") % 64)  # each block of 64 rows is one square matrix
    both = TS.tri(TS.tri(el, 1, True, "r", "j", "val", "triu1"), 0, False, "r", "j", "val", "tril0")
    return both.select("i", "j", R(F.col("triu1")).alias("triu1"), R(F.col("tril0")).alias("tril0"))


@register("c62_index_write", "C-62", sql=f"""WITH {EL_SQL}
SELECT a.vec_id AS i, a.j, {r('COALESCE(b.val, a.val)')} AS val
FROM el a LEFT JOIN (SELECT vec_id + 10 AS vec_id, j + 4 AS j, -val AS val FROM el WHERE vec_id < 5 AND j < 8) b
ON a.vec_id = b.vec_id AND a.j = b.j""")
def c62_index_write(spark, sf_dir):
    el = TS.to_long(emb(spark, sf_dir).drop("label"), "vec_id", "v", "j", "val").withColumnRenamed("vec_id", "i")
    src = el.filter((F.col("i") < 5) & (F.col("j") < 8)).withColumn("val", -F.col("val"))
    w = TS.index_write(el, src, {"i": 10, "j": 4}, ["i", "j"])
    return w.select("i", "j", R(F.col("val")).alias("val"))


# --- C5 index / join-like / sort-like -----------------------------------------------

@register("c63_gather_onehot", "C-63 C-67", sql=f"""WITH {EMB_SQL}
SELECT vec_id, {r('v[label + 1]')} AS gathered, CAST(list_sum(list_transform(range(64), lambda c: CASE WHEN c = label THEN c * 3 + 1 ELSE 0 END)) AS BIGINT) AS onehot_code,
       CAST(list_sum(list_transform(range(10), lambda c: CASE WHEN c = label THEN 1 ELSE 0 END)) AS INTEGER) AS onehot_sum FROM e""")
def c63_gather_onehot(spark, sf_dir):
    e = emb(spark, sf_dir)
    oh = A.one_hot(F.col("label"), 64)
    code = F.aggregate(F.transform(oh, lambda x, c: x * (c * 3 + 1)), F.lit(0).cast("long"), lambda a, t: a + t)
    return e.select("vec_id", R(TS.gather(F.col("v"), F.col("label"))).alias("gathered"), code.alias("onehot_code"),
                    F.aggregate(A.one_hot(F.col("label"), 10), F.lit(0), lambda a, t: a + t).alias("onehot_sum"))


@register("c64_index_select", "C-64", sql="""
SELECT o_orderkey, c_custkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey""")
def c64_index_select(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", "o_custkey")
    c = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return TS.index_select(o, c, "o_custkey", "c_custkey").select("o_orderkey", "c_custkey", "c_nationkey",
                                                                   F.round("c_acctbal", 6).alias("c_acctbal"))


@register("c65_scatter_add", "C-65 C-66", sql="""
WITH u AS (SELECT p_partkey AS idx, p_retailprice AS val FROM part
           UNION ALL SELECT l_partkey, l_quantity FROM lineitem)
SELECT idx, round(SUM(val), 6) AS val FROM u GROUP BY idx""")
def c65_scatter_add(spark, sf_dir):
    t = Tables(spark, sf_dir)
    base = t.part.select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("val"))
    src = t.lineitem.select(F.col("l_partkey").alias("idx"), F.col("l_quantity").alias("val"))
    return TS.scatter_add(base, src, ["idx"]).select("idx", R(F.col("val")).alias("val"))


@register("c66_index_add_rows", "C-66", sql=f"""WITH {EL_SQL}
SELECT CAST(label AS BIGINT) AS label, j, {r('SUM(val)')} AS val FROM el GROUP BY label, j""")
def c66_index_add_rows(spark, sf_dir):
    """Whole 64-wide slices added into the row named by ``label`` (index_add on dim 0)."""
    el = TS.to_long(emb(spark, sf_dir), "vec_id", "v", "j", "val").select(F.col("label").cast("long").alias("label"), "j", "val")
    base = el.select("label", "j", F.lit(0.0).alias("val")).distinct()
    return TS.scatter_add(base, el, ["label", "j"]).select("label", "j", R(F.col("val")).alias("val"))


TOPK = 5


@register("c68_topk", "C-68", sql=f"""WITH {EL_SQL},
k AS (SELECT vec_id, j, val, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY val DESC, j DESC) AS rk FROM el)
SELECT vec_id, CAST(rk - 1 AS INTEGER) AS rank, j AS idx, {r('val')} AS value FROM k WHERE rk <= {TOPK}""")
def c68_topk(spark, sf_dir):
    e = emb(spark, sf_dir)
    t = e.select("vec_id", F.posexplode(A.topk(F.col("v"), TOPK)).alias("rank", "s"))
    return t.select("vec_id", "rank", F.col("s.index").alias("idx"), R(F.col("s.value")).alias("value"))


CENTROIDS_SQL = f"""{EL_SQL},
w AS (SELECT label AS o, j AS k, AVG(val) AS b FROM el GROUP BY label, j)"""


def centroids(spark, sf_dir):
    """Weight table (one row per class): the mean embedding of each label."""
    el = TS.to_long(emb(spark, sf_dir), "vec_id", "v", "j", "val")
    return TS.to_vector(el.groupBy("label", "j").agg(F.avg("val").alias("val")), ["label"], "j", "val", "w") \
        .withColumnRenamed("label", "o")


@register("c69_matmul", "C-69", sql=f"""WITH {CENTROIDS_SQL}
SELECT el.vec_id AS i, w.o AS j, {r('SUM(el.val * w.b)')} AS val FROM el JOIN w ON el.j = w.k GROUP BY el.vec_id, w.o""")
def c69_matmul(spark, sf_dir):
    el = TS.to_long(emb(spark, sf_dir).drop("label"), "vec_id", "v", "k", "a").withColumnRenamed("vec_id", "i")
    w = TS.to_long(centroids(spark, sf_dir), "o", "w", "k", "b").withColumnRenamed("o", "j")
    return TL.matmul(el, w, "i", "k", "j", "a", "b", "val").select("i", F.col("j").cast("int").alias("j"), R(F.col("val")).alias("val"))


HEAD_WIDTH = 16


@register("c70_batched_gemm", "C-69 C-70", sql=f"""WITH {CENTROIDS_SQL}
SELECT CAST(el.j // {HEAD_WIDTH} AS INTEGER) AS head, el.vec_id AS i, CAST(w.o AS INTEGER) AS j, {r('SUM(el.val * w.b) + 0.1 * w.o')} AS val
FROM el JOIN w ON el.j = w.k GROUP BY el.j // {HEAD_WIDTH}, el.vec_id, w.o""")
def c70_batched_gemm(spark, sf_dir):
    """Embeddings as 4 heads of 16 components, each times the transposed class means, plus a bias."""
    def heads(long, row, val):
        return long.select(F.floor(F.col("j") / HEAD_WIDTH).cast("int").alias("head"), row, (F.col("j") % HEAD_WIDTH).alias("k"), F.col(val))

    a = heads(TS.to_long(emb(spark, sf_dir).drop("label"), "vec_id", "v", "j", "a").withColumnRenamed("vec_id", "i"), "i", "a")
    w = heads(TS.to_long(centroids(spark, sf_dir), "o", "w", "j", "b"), "o", "b")
    bias = centroids(spark, sf_dir).select(F.col("o").alias("j"), (F.col("o") * 0.1).alias("bias"))
    # W is stored (o, k): the transposed right factor
    w = w.select("head", F.col("o").alias("k"), F.col("k").alias("j"), "b")
    y = TL.matmul(a, w, "i", "k", "j", "a", "b", "val", batch=["head"], trans_b=True, bias=bias)
    return y.select("head", "i", F.col("j").cast("int").alias("j"), R(F.col("val")).alias("val"))


@register("c73_pairwise_dot", "C-73", sql=f"""WITH {CENTROIDS_SQL}
SELECT el.vec_id AS i, CAST(w.o AS INTEGER) AS j, {r('SUM(el.val * w.b) * 0.125')} AS score FROM el JOIN w ON el.j = w.k GROUP BY el.vec_id, w.o""")
def c73_pairwise_dot(spark, sf_dir):
    """Scaled dot products of every embedding with every class mean."""
    q = TS.to_long(emb(spark, sf_dir).drop("label"), "vec_id", "v", "d", "q").withColumnRenamed("vec_id", "i")
    k = TS.to_long(centroids(spark, sf_dir), "o", "w", "d", "k").withColumnRenamed("o", "j")
    return TL.pairwise_dot(q, k, 0.125).select("i", F.col("j").cast("int").alias("j"), R(F.col("score")).alias("score"))


@register("c72_linear", "C-72", sql=f"""WITH {CENTROIDS_SQL}
SELECT el.vec_id AS i, CAST(w.o AS INTEGER) AS j, {r('SUM(el.val * w.b) + 0.1 * w.o')} AS y FROM el JOIN w ON el.j = w.k GROUP BY el.vec_id, w.o""")
def c72_linear(spark, sf_dir):
    w = centroids(spark, sf_dir).withColumn("b", F.col("o") * 0.1)
    y = TS.linear_rows(emb(spark, sf_dir).drop("label"), w, "v", "o", "w", bias="b", out="y")
    return y.select(F.col("vec_id").alias("i"), F.posexplode("y").alias("j", "y")).select("i", "j", R(F.col("y")).alias("y"))


@register("c71_conv1d", "C-71", sql=f"""WITH {EMB_SQL},
c AS (SELECT vec_id, list_transform(range(64), lambda t: 0.25 * COALESCE(CASE WHEN t - 1 >= 0 THEN v[t] END, 0.0)
        + 0.5 * v[t + 1] + 0.25 * COALESCE(CASE WHEN t + 1 < 64 THEN v[t + 2] END, 0.0)) AS y FROM e)
SELECT vec_id, CAST(unnest(range(len(y))) AS INTEGER) AS t, round(unnest(y), 6) AS y FROM c""")
def c71_conv1d(spark, sf_dir):
    e = emb(spark, sf_dir)
    y = e.select("vec_id", A.conv1d(F.col("v"), [0.25, 0.5, 0.25], stride=1, padding=1).alias("y"))
    return y.select("vec_id", F.posexplode("y").alias("t", "y")).select("vec_id", "t", R(F.col("y")).alias("y"))


# --- C6 normalisation, softmax, positional ------------------------------------------

def _long_out(df, col, name):
    return df.select("vec_id", F.posexplode(col).alias("j", name)).select("vec_id", "j", R(F.col(name)).alias(name))


def _long_sql(expr, name, src="e"):
    return f"SELECT vec_id, CAST(unnest(range(len(l))) AS INTEGER) AS j, round(unnest(l), 6) AS {name} FROM (SELECT vec_id, {expr} AS l FROM {src})"


@register("c74_softmax", "C-74 C-75", sql=f"""WITH {EMB_SQL},
s AS (SELECT vec_id, v, list_max(v) AS m, ln(list_sum(list_transform(v, lambda a: exp(a - list_max(v))))) AS lse FROM e)
SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS j, round(unnest(list_transform(v, lambda a: exp(a - m - lse))), 6) AS p,
       round(unnest(list_transform(v, lambda a: a - m - lse)), 6) AS logp FROM s""")
def c74_softmax(spark, sf_dir):
    e = emb(spark, sf_dir)
    s = e.select("vec_id", F.arrays_zip(A.softmax(F.col("v")).alias("p"), A.log_softmax(F.col("v")).alias("logp")).alias("z"))
    return (s.select("vec_id", F.posexplode("z").alias("j", "z"))
            .select("vec_id", "j", R(F.col("z.p")).alias("p"), R(F.col("z.logp")).alias("logp")))


@register("c76_layer_norm", "C-76", sql=f"""WITH {EMB_SQL} {_long_sql(
    "list_transform(v, lambda a: (a - list_avg(v)) / sqrt(list_avg(list_transform(v, lambda b: b * b)) - list_avg(v) * list_avg(v) + 1e-5))", 'y')}""")
def c76_layer_norm(spark, sf_dir):
    return _long_out(emb(spark, sf_dir), A.layer_norm(F.col("v")), "y")


@register("c77_rms_norm", "C-77", sql=f"""WITH {EMB_SQL} {_long_sql(
    "list_transform(v, lambda a: a / sqrt(list_avg(list_transform(v, lambda b: b * b)) + 1e-5))", 'y')}""")
def c77_rms_norm(spark, sf_dir):
    return _long_out(emb(spark, sf_dir), A.rms_norm(F.col("v")), "y")


@register("c78_group_norm", "C-78", sql=f"""WITH {EL_SQL},
g AS (SELECT vec_id, j // 16 AS g, AVG(val) AS m, AVG(val * val) - AVG(val) * AVG(val) AS var FROM el GROUP BY vec_id, j // 16)
SELECT vec_id, j, {r('(val - m) / sqrt(var + 1e-5)')} AS y FROM el JOIN g ON el.vec_id = g.vec_id AND el.j // 16 = g.g""".replace(
    "SELECT vec_id, j, ", "SELECT el.vec_id AS vec_id, j, "))
def c78_group_norm(spark, sf_dir):
    return _long_out(emb(spark, sf_dir), A.group_norm(F.col("v"), 4), "y")


@register("c79_l2_normalize", "C-79", sql=f"""WITH {EMB_SQL} {_long_sql(
    "list_transform(v, lambda a: a / (sqrt(list_sum(list_transform(v, lambda b: b * b))) + 1e-7))", 'y')}""")
def c79_l2_normalize(spark, sf_dir):
    return _long_out(emb(spark, sf_dir), A.l2_normalize(F.col("v")), "y")


SIN_DIM = 16


@register("c80_sinusoidal", "C-80", sql=f"""WITH {EMB_SQL} {_long_sql(
    f"list_concat(list_transform(range({SIN_DIM // 2}), lambda i: sin(vec_id * (1.0 / pow(10000.0, 2.0 * i / {SIN_DIM})))), "
    f"list_transform(range({SIN_DIM // 2}), lambda i: cos(vec_id * (1.0 / pow(10000.0, 2.0 * i / {SIN_DIM})))))", 'pe')}""")
def c80_sinusoidal(spark, sf_dir):
    e = emb(spark, sf_dir)
    return _long_out(e, A.sinusoidal(F.col("vec_id"), SIN_DIM), "pe")


ROPE_DIM = 32


@register("c81_rope", "C-81", sql=f"""WITH {EMB_SQL} {_long_sql(
    f"list_transform(v, lambda a, i: CASE WHEN i - 1 >= {ROPE_DIM} THEN a "
    f"WHEN i - 1 < {ROPE_DIM // 2} THEN a * cos(vec_id * pow(10000.0, -2.0 * (i - 1) / {ROPE_DIM})) - v[i + {ROPE_DIM // 2}] * sin(vec_id * pow(10000.0, -2.0 * (i - 1) / {ROPE_DIM})) "
    f"ELSE v[i - {ROPE_DIM // 2}] * sin(vec_id * pow(10000.0, -2.0 * (i - 1 - {ROPE_DIM // 2}) / {ROPE_DIM})) + a * cos(vec_id * pow(10000.0, -2.0 * (i - 1 - {ROPE_DIM // 2}) / {ROPE_DIM})) END)",
    'y')}""")
def c81_rope(spark, sf_dir):
    e = emb(spark, sf_dir)
    return _long_out(e, A.rope(F.col("v"), F.col("vec_id"), dim=ROPE_DIM), "y")


HEADS = 8


def _alibi_slopes_sql():
    import math
    n = 2 ** int(math.floor(math.log2(HEADS)))
    m0, m1 = 2.0 ** (-8.0 / n), 2.0 ** (-8.0 / (2 * n))
    return f"CASE WHEN h < {n} THEN pow({m0!r}, h + 1) ELSE pow({m1!r}, 2 * (h - {n}) + 1) END"


@register("c82_alibi", "C-82", sql=f"""WITH {EL_SQL}
SELECT vec_id, j, {r('val + (j % 8) * ' + _alibi_slopes_sql().replace('h', '(j // 8)'))} AS y FROM el""")
def c82_alibi(spark, sf_dir):
    """Each 64-vector read as 8 heads x 8 key columns; bias = column * slope(head)."""
    el = TS.to_long(emb(spark, sf_dir), "vec_id", "v", "j", "val")
    y = F.col("val") + (F.col("j") % 8) * A.alibi_slope(F.floor(F.col("j") / 8), HEADS)
    return el.select("vec_id", "j", R(y).alias("y"))


# --- C7 generators, random, quantise ------------------------------------------------

@register("c84_fill_arange_eye", "C-84 C-85 C-86", sql=f"""WITH {EL_SQL}
SELECT vec_id, j, CASE WHEN j = vec_id % 64 THEN 1.0 ELSE 0.0 END AS eye, CAST(vec_id * 64 + j AS BIGINT) AS arange,
       0.0 AS zeros, 1.0 AS ones, 3.5 AS full FROM el""")
def c84_fill_arange_eye(spark, sf_dir):
    """Tensors shaped like ``embeddings``: zeros/ones/full_like, a row-major arange and
    stacked 64x64 identity blocks (eye)."""
    el = TS.to_long(emb(spark, sf_dir).drop("label"), "vec_id", "v", "j", "val")
    return el.select("vec_id", "j", F.when(F.col("j") == F.col("vec_id") % 64, 1.0).otherwise(0.0).alias("eye"),
                     (F.col("vec_id") * 64 + F.col("j")).cast("long").alias("arange"),
                     F.lit(0.0).alias("zeros"), F.lit(1.0).alias("ones"), F.lit(3.5).alias("full"))


SEED = 1234


@register("c87_random", "C-87 C-88 C-89 C-90 C-83", sql=f"""
WITH u AS (SELECT l_orderkey, l_linenumber, {uniform_sql(SEED, 'l_orderkey', 'l_linenumber', '0')} AS u1,
                  {uniform_sql(SEED, 'l_orderkey', 'l_linenumber', '1')} AS u2, l_quantity FROM lineitem)
SELECT l_orderkey, l_linenumber, round(-1.0 + 3.0 * u1, 6) AS rand_,
       round(0.5 + 2.0 * sqrt(-2.0 * ln(1.0 - u1)) * cos(2.0 * pi() * u2), 6) AS randn_,
       CAST(floor(u2 * 10) AS BIGINT) - 3 AS randint_, CASE WHEN u1 < 0.3 THEN 1 ELSE 0 END AS bernoulli_,
       round(CASE WHEN u2 < 0.2 THEN 0.0 ELSE l_quantity / 0.8 END, 6) AS dropout_
FROM u""")
def c87_random(spark, sf_dir):
    """Seeded, partition-independent draws: uniform, Box-Muller normal, integers, Bernoulli, dropout."""
    from weft.operators.random import bernoulli, dropout, rand_normal, rand_uniform, randint
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    ids = ("l_orderkey", "l_linenumber")
    return li.select("l_orderkey", "l_linenumber", R(rand_uniform(SEED, ids, -1.0, 2.0)).alias("rand_"),
                     R(rand_normal(SEED, ids, 0.5, 2.0)).alias("randn_"), randint(SEED, ids, -3, 7).alias("randint_"),
                     bernoulli(SEED, ids, 0.3).alias("bernoulli_"),
                     R(dropout(F.col("l_quantity"), 0.2, SEED, ids)).alias("dropout_"))


@register("c95_multinomial", "C-95 D-14", sql=f"""WITH {EL_SQL},
p AS (SELECT vec_id, j, exp(val * 20) AS w FROM el),
c AS (SELECT vec_id, j, SUM(w) OVER (PARTITION BY vec_id ORDER BY j) AS cum, SUM(w) OVER (PARTITION BY vec_id) AS tot FROM p),
d AS (SELECT vec_id, draw, {uniform_sql(SEED, 'vec_id', 'draw')} AS u FROM (SELECT DISTINCT vec_id FROM el), range(3) t(draw))
SELECT d.vec_id, CAST(d.draw AS INTEGER) AS draw, CAST(MIN(c.j) AS INTEGER) AS sample
FROM d JOIN c ON c.vec_id = d.vec_id AND c.cum >= d.u * c.tot GROUP BY d.vec_id, d.draw""")
def c95_multinomial(spark, sf_dir):
    """3 draws with replacement per row from unnormalised weights exp(20 * x) (inverse CDF)."""
    from weft.operators.random import multinomial_rows
    e = emb(spark, sf_dir).select("vec_id", F.transform("v", lambda x: F.exp(x * 20)).alias("w"))
    return multinomial_rows(e, "w", 3, SEED, id_col="vec_id")


@register("d14_sample_temperature", "D-14", sql=f"""WITH {EL_SQL},
p AS (SELECT vec_id, j, exp((val - MAX(val) OVER (PARTITION BY vec_id)) / 0.7) AS w FROM el),
c AS (SELECT vec_id, j, SUM(w) OVER (PARTITION BY vec_id ORDER BY j) AS cum, SUM(w) OVER (PARTITION BY vec_id) AS tot FROM p),
d AS (SELECT vec_id, {uniform_sql(SEED, 'vec_id', '0')} AS u FROM (SELECT DISTINCT vec_id FROM el))
SELECT d.vec_id, CAST(MIN(c.j) AS INTEGER) AS next_token FROM d JOIN c ON c.vec_id = d.vec_id AND c.cum >= d.u * c.tot GROUP BY d.vec_id""")
def d14_sample_temperature(spark, sf_dir):
    """The next token of every embedding taken as logits, at temperature 0.7."""
    from weft.operators.random import sample_next
    return sample_next(emb(spark, sf_dir).select("vec_id", "v"), "v", 0.7, SEED, "vec_id").select("vec_id", F.col("next_token").cast("int").alias("next_token"))


@register("c96_quantize", "C-96 C-97 C-98", sql=f"""WITH {EL_SQL},
b AS (SELECT vec_id, j // 32 AS blk, MAX(abs(val)) AS amax FROM el GROUP BY vec_id, j // 32),
q AS (SELECT el.vec_id, el.j, el.val, b.blk, b.amax / 127.0 AS d8, b.amax / 7.0 AS d4 FROM el JOIN b ON el.vec_id = b.vec_id AND el.j // 32 = b.blk),
r AS (SELECT *, CASE WHEN d8 = 0 THEN 0 ELSE CAST(round(val / d8) AS INTEGER) END AS q8,
                CASE WHEN d4 = 0 THEN 0 ELSE CAST(round(val / d4) AS INTEGER) END AS q4 FROM q)
SELECT vec_id, CAST(blk AS INTEGER) AS blk, {r('MAX(d8)')} AS d8, CAST(SUM(q8) AS BIGINT) AS q8_sum, CAST(SUM(q4) AS BIGINT) AS q4_sum,
       {r('sqrt(AVG((val - q8 * d8) * (val - q8 * d8)))')} AS rmse8, {r('sqrt(AVG((val - q4 * d4) * (val - q4 * d4)))')} AS rmse4
FROM r GROUP BY vec_id, blk""")
def c96_quantize(spark, sf_dir):
    e = emb(spark, sf_dir)
    q = e.select("vec_id", "v", A.quantize_blocks(F.col("v"), 32, 8).alias("q8"), A.quantize_blocks(F.col("v"), 32, 4).alias("q4"))
    q = q.withColumn("r8", A.dequantize_blocks(F.col("q8"))).withColumn("r4", A.dequantize_blocks(F.col("q4")))

    def blk_rmse(rec):
        return F.transform(F.sequence(F.lit(0), F.size("q8") - 1), lambda b: F.sqrt(F.aggregate(
            F.zip_with(F.slice("v", b * 32 + 1, 32), F.slice(rec, b * 32 + 1, 32), lambda x, y: (x - y) * (x - y)),
            F.lit(0.0), lambda a, t: a + t) / F.size(F.slice("v", b * 32 + 1, 32))))
    z = q.select("vec_id", F.posexplode(F.arrays_zip(F.col("q8").alias("b8"), F.col("q4").alias("b4"),
                                                    blk_rmse(F.col("r8")).alias("e8"), blk_rmse(F.col("r4")).alias("e4"))).alias("blk", "z"))
    isum = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, t: a + t)
    return z.select("vec_id", "blk", R(F.col("z.b8.d")).alias("d8"), isum(F.col("z.b8.q")).alias("q8_sum"),
                    isum(F.col("z.b4.q")).alias("q4_sum"), R(F.col("z.e8")).alias("rmse8"), R(F.col("z.e4")).alias("rmse4"))


@register("c99_npy_roundtrip", "C-99", sql=f"""WITH {EL_SQL}
SELECT vec_id, j, {r('CAST(CAST(val AS FLOAT) AS DOUBLE)')} AS val FROM el""")
def c99_npy_roundtrip(spark, sf_dir):
    """Embeddings saved as one float32 .npy per block of 100 rows (shape [rows, 64]), read back."""
    import uuid
    from weft.session import checkpoint_dir
    from weft.sources.files import read_npy, write_npy
    e = emb(spark, sf_dir)
    blocks = (e.withColumn("blk", F.floor(F.col("vec_id") / 100)).groupBy("blk")
              .agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("_r")))  # 100 rows per group
    t = blocks.select(F.concat(F.lit("emb_"), F.col("blk").cast("string")).alias("name"),
                      F.array(F.size("_r").cast("long"), F.lit(64).cast("long")).alias("shape"),
                      F.flatten(F.col("_r.v")).alias("values"), F.col("_r.vec_id").alias("ids"))
    root = f"{checkpoint_dir(spark)}/npy-{uuid.uuid4().hex[:8]}"
    write_npy(t, root).write.format("noop").mode("overwrite").save()
    back = read_npy(spark, root).join(t.select("name", "ids"), "name")
    x = back.select(F.posexplode("values").alias("k", "val"), "ids")
    return x.select(F.element_at("ids", (F.floor(F.col("k") / 64) + 1).cast("int")).alias("vec_id"),
                    (F.col("k") % 64).cast("int").alias("j"), R(F.col("val")).alias("val"))
