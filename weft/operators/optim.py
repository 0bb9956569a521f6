"""Learning-rate schedules, optimiser updates and gradient statistics (D-28 .. D-44).

Schedules are closed forms over a ``step`` column, so a schedule table of any
length is one projection.  Optimiser steps are joins of the parameter, gradient
and state tables on ``(name, idx)`` followed by element-wise expressions; the
state comes back as a table to be joined into the next step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import stage_table


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- schedules (multiplier of the base lr at step t) --------------------------------

def lr_constant(t, base: float, factor: float = 1 / 3, total: int = 5) -> Column:
    """D-28: base * factor for t < total, base afterwards."""
    return F.when(_c(t) < total, F.lit(base * factor)).otherwise(F.lit(base))


def lr_linear(t, base: float, start: float = 1 / 3, end: float = 1.0, total: int = 5) -> Column:
    """D-29: base * (start + (end - start) * min(t, total) / total)."""
    if not (0 < start <= 1) or not (0 <= end <= 1):
        raise ValueError("factors out of range")
    return F.lit(base) * (F.lit(start) + F.lit(end - start) * F.least(_c(t), F.lit(total)) / F.lit(float(total)))


def lr_step(t, base: float, size: int, gamma: float = 0.1) -> Column:
    """D-30: base * gamma^floor(t / size)."""
    return F.lit(base) * F.pow(F.lit(gamma), F.floor(_c(t) / size))


def lr_multistep(t, base: float, milestones: Sequence[int], gamma: float = 0.1) -> Column:
    """D-31: base * gamma^(number of distinct milestones <= t)."""
    ms = sorted(set(int(m) for m in milestones))
    passed = sum((F.when(_c(t) >= m, 1).otherwise(0) for m in ms), F.lit(0))
    return F.lit(base) * F.pow(F.lit(gamma), passed)


def lr_exponential(t, base: float, gamma: float) -> Column:
    """D-32: base * gamma^t."""
    return F.lit(base) * F.pow(F.lit(gamma), _c(t))


def lr_cosine(t, base: float, t_max: int, eta_min: float = 0.0) -> Column:
    """D-33: eta + (base - eta)(1 + cos(pi t / T)) / 2 for t <= T.

    The recurrent form reaches exactly eta_min at T and its restart branch
    multiplies (lr - eta_min), which is then 0: the rate stays at eta_min for
    every t > T (it does not climb back like the textbook curve)."""
    x = F.lit(eta_min) + F.lit(base - eta_min) * (1 + F.cos(F.lit(math.pi) * _c(t) / F.lit(float(t_max)))) / 2
    return F.when(_c(t) < t_max, x).otherwise(F.lit(eta_min))


# --- optimiser steps ------------------------------------------------------------------

def sgd_step(pg: DataFrame, lr: float, momentum: float = 0.0, dampening: float = 0.0, weight_decay: float = 0.0,
             nesterov: bool = False, state: DataFrame | None = None, keys: Sequence[str] = ("name", "idx")
             ) -> DataFrame:
    """D-35: ``pg`` has (keys, param, grad); rows without grad are left unchanged.

    The first momentum step stores a zero buffer and — without Nesterov — moves
    nothing.  Returns (keys, param, buf)."""
    if nesterov and (momentum <= 0 or dampening != 0):
        raise ValueError("nesterov needs a momentum above 0 and no dampening")
    keys = list(keys)
    x = pg if state is None else pg.join(state.select(*keys, F.col("buf").alias("_buf0")), keys, "left")
    if state is None:
        x = x.withColumn("_buf0", F.lit(None).cast("double"))
    has = F.col("grad").isNotNull()
    g = F.col("grad") + F.col("param") * weight_decay if weight_decay else F.col("grad")
    if momentum:
        buf = F.when(F.col("_buf0").isNull(), F.lit(0.0)).otherwise(F.col("_buf0") * momentum + g * (1 - dampening))
        upd = (g + buf * momentum) if nesterov else buf
    else:
        buf = F.lit(None).cast("double")
        upd = g
    return x.select(*keys, F.when(has, F.col("param") - F.lit(lr) * upd).otherwise(F.col("param")).alias("param"),
                    F.when(has, buf).otherwise(F.col("_buf0")).alias("buf"))


def adam_step(pg: DataFrame, lr: float = 1e-3, betas=(0.9, 0.999), eps: float = 1e-8, weight_decay: float = 0.0,
              amsgrad: bool = False, decoupled: bool = False, state: DataFrame | None = None,
              keys: Sequence[str] = ("name", "idx")) -> DataFrame:
    """D-36 (coupled decay: grad += wd * param) and D-37 AdamW (decoupled: param *= 1 - lr * wd).

    Bias corrections use the per-parameter step count; eps is added after
    sqrt(v) / sqrt(bc2).  Returns (keys, param, step, m, v, vmax)."""
    b1, b2 = betas
    if not (0 <= b1 < 1 and 0 <= b2 < 1):
        raise ValueError("betas must be in [0, 1)")
    keys = list(keys)
    if state is None:
        x = pg.withColumns({"_s0": F.lit(0).cast("long"), "_m0": F.lit(0.0), "_v0": F.lit(0.0), "_x0": F.lit(0.0)})
    else:
        st = state.select(*keys, F.col("step").alias("_s0"), F.col("m").alias("_m0"), F.col("v").alias("_v0"),
                          F.col("vmax").alias("_x0"))
        x = pg.join(st, keys, "left").fillna({"_s0": 0, "_m0": 0.0, "_v0": 0.0, "_x0": 0.0})
    has = F.col("grad").isNotNull()
    p = F.col("param")
    if weight_decay and decoupled:
        p = p * (1 - lr * weight_decay)
    g = F.col("grad") + F.col("param") * weight_decay if (weight_decay and not decoupled) else F.col("grad")
    step = F.col("_s0") + 1
    m = F.col("_m0") * b1 + g * (1 - b1)
    v = F.col("_v0") * b2 + g * g * (1 - b2)
    vmax = F.greatest(F.col("_x0"), v) if amsgrad else F.col("_x0")
    bc1 = 1 - F.pow(F.lit(b1), step)
    bc2 = 1 - F.pow(F.lit(b2), step)
    denom = F.sqrt(vmax if amsgrad else v) / F.sqrt(bc2) + eps
    new_p = p - (F.lit(lr) / bc1) * m / denom
    return x.select(*keys,
                    F.when(has, new_p).otherwise(F.col("param")).alias("param"),
                    F.when(has, step).otherwise(F.col("_s0")).alias("step"),
                    F.when(has, m).otherwise(F.col("_m0")).alias("m"),
                    F.when(has, v).otherwise(F.col("_v0")).alias("v"),
                    F.when(has, vmax).otherwise(F.col("_x0")).alias("vmax"))


# --- gradient statistics ----------------------------------------------------------------

def tensor_norms(grads: DataFrame, by: Sequence[str], val: str = "grad", ord=2) -> DataFrame:
    """Per-tensor norms (partial aggregation per tensor)."""
    x = F.abs(F.col(val))
    if ord == float("inf"):
        return grads.groupBy(*by).agg(F.max(x).alias("norm"))
    return grads.groupBy(*by).agg(F.pow(F.sum(F.pow(x, F.lit(float(ord)))), F.lit(1.0 / ord)).alias("norm"))


def total_grad_norm(grads: DataFrame, by: Sequence[str], val: str = "grad", ord=2) -> DataFrame:
    """D-40: the norm of the per-tensor norms (one row)."""
    t = tensor_norms(grads, by, val, ord)
    if ord == float("inf"):
        return t.agg(F.max("norm").alias("total_norm"))
    return t.agg(F.pow(F.sum(F.pow(F.col("norm"), F.lit(float(ord)))), F.lit(1.0 / ord)).alias("total_norm"))


def clip_grad_norm(grads: DataFrame, by: Sequence[str], max_norm: float, val: str = "grad", ord=2) -> DataFrame:
    """D-41: scale every gradient by min(1, max_norm / (total_norm + 1e-6)).

    The total norm is a scalar subquery (computed once, inlined as a value)."""
    total = total_grad_norm(grads, by, val, ord).scalar()
    coef = F.least(F.lit(1.0), F.lit(max_norm) / (total + F.lit(1e-6)))
    return grads.withColumn("clip_coef", coef).withColumn(val, F.col(val) * F.col("clip_coef"))


def mse_gradient(rows: DataFrame, x: str, y_hat: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """D-42 (MSE, linear model): dL/dw = sum (y_hat - y) x, dL/db = sum (y_hat - y)."""
    r = F.col(y_hat) - F.col(y)
    return rows.groupBy(*by).agg(F.sum(r * F.col(x)).alias("grad_w"), F.sum(r).alias("grad_b"),
                                 F.sum(r * r).alias("sse"))


def count_parameters(params: DataFrame, shape: str = "shape", values: str | None = None) -> DataFrame:
    """D-44: total element count (sum of shape products) and, given values, their sum."""
    n = F.aggregate(F.col(shape), F.lit(1).cast("long"), lambda a, d: a * d)
    aggs = [F.sum(n).alias("n_params")]
    if values:
        aggs.append(F.sum(F.aggregate(F.col(values).cast("array<double>"), F.lit(0.0), lambda a, v: a + v)).alias("param_sum"))
    return params.agg(*aggs)


def param_groups(params: DataFrame, name: str = "param_name", kind: str = "kind", module_type: str = "type_name",
                 decayed: Sequence[str] | None = None, undecayed: Sequence[str] | None = None) -> DataFrame:
    """D-39: decay / no_decay membership; buffers are not optimised.

    No decay: biases, and weights of modules of the types ``undecayed``.  Decay: weights of the
    types ``decayed``, and what is neither weight nor bias.  Without type lists a module whose
    type contains ``Norm`` is undecayed with all its parameters and every other one decayed.
    Adds ``group`` (null if neither rule holds) and the flags ``overlap`` (both rules hold;
    decay counts then) and ``missing`` (neither): :func:`check_param_groups` refuses both."""
    n, t = F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(module_type), F.lit(""))
    bias, weight, norm = n.endswith("bias"), n.endswith("weight"), t.contains("Norm")
    of = lambda types: t.isin(list(types)) if types else F.lit(False)
    no_decay = bias | (norm if undecayed is None else weight & of(undecayed))
    decay = ~bias & (~norm if decayed is None else ~weight | of(decayed))
    return params.filter(~F.col(kind).eqNullSafe(F.lit("buffer"))).withColumn("overlap", no_decay & decay).withColumn("missing", ~no_decay & ~decay).withColumn(
        "group", F.when(decay, "decay").when(no_decay, "no_decay"))


def check_param_groups(groups: DataFrame, path: str = "path", name: str = "param_name", shown: int = 5) -> None:
    """D-39: raises if a parameter is in both groups or in none; one aggregate tells their numbers and the first few names."""
    full = F.concat_ws(".", path, name)
    bad = groups.filter("overlap OR missing").groupBy("overlap").agg(F.count("*").alias("n"))
    for r in bad.orderBy("overlap").collect():  # two rows at most
        some = [x[0] for x in groups.filter("overlap" if r.overlap else "missing").select(full).orderBy(full).limit(shown).collect()]
        raise ValueError(f"{r.n} parameters are in {'both decay groups' if r.overlap else 'no decay group'}: {', '.join(some)}")


def lr_sequential(t, schedules: Sequence, milestones: Sequence[int], base: float) -> Column:
    """D-34: schedule k runs from milestone k-1 (its own step 0 there) and starts from the rate
    the previous schedule reached; each schedule is ``fn(step, start_lr) -> Column`` and
    ``start_fn(step, start_lr) -> float`` gives its value at a step (evaluated on the driver for
    the few milestones).  Milestones must increase and number len(schedules) - 1."""
    if len(milestones) != len(schedules) - 1 or any(b <= a for a, b in zip(milestones, milestones[1:])):
        raise ValueError("milestones must be strictly increasing, one fewer than schedules")
    starts = [base]
    for k, m in enumerate(milestones):
        prev_start = milestones[k - 1] if k > 0 else 0
        starts.append(schedules[k][1](m - prev_start, starts[-1]))
    tc = _c(t)
    expr = None
    bounds = [0, *milestones]
    for k in range(len(schedules) - 1, -1, -1):
        e = schedules[k][0](tc - bounds[k], starts[k])
        expr = e if expr is None else F.when(tc < milestones[k], e).otherwise(expr)
    return expr


def fit_linear(rows: DataFrame, features: Sequence[str], target: str, steps: int, lr: float,
               momentum: float = 0.0, max_grad_norm: float | None = None) -> list[dict]:
    """D-43: full-batch gradient descent of y = w.x + b under MSE.  Each step is one aggregate
    over the (cached) rows with the current weights inlined as literals (D-42), optional
    gradient clipping (D-41) and an SGD update (D-35) on the driver — the weights are a few
    numbers.  Returns the per-step history."""
    data = rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y")).cache()
    w, b = [0.0] * len(features), 0.0
    buf = None
    hist = []
    n = data.count()
    for step in range(steps):
        yh = sum((F.lit(wi) * F.col(f) for wi, f in zip(w, features)), F.lit(b))
        r = yh - F.col("_y")
        g = data.agg(*[F.sum(r * F.col(f)).alias(f"g{i}") for i, f in enumerate(features)], F.sum(r).alias("gb"),
                     F.sum(r * r).alias("sse")).first()
        grad = [2.0 * g[f"g{i}"] / n for i in range(len(features))] + [2.0 * g["gb"] / n]
        if max_grad_norm is not None:
            tot = sum(x * x for x in grad) ** 0.5
            grad = [x * min(1.0, max_grad_norm / (tot + 1e-6)) for x in grad]
        if momentum:
            buf = [0.0] * len(grad) if buf is None else [momentum * bi + gi for bi, gi in zip(buf, grad)]
            upd = buf
        else:
            upd = grad
        params = [*w, b]
        params = [p - lr * u for p, u in zip(params, upd)]
        w, b = params[:-1], params[-1]
        hist.append({"step": step, "loss": g["sse"] / n, **{f"w{i}": v for i, v in enumerate(w)}, "b": b})
    data.unpersist()
    return hist


def softmax_gradient_parts(rows: DataFrame, features: str, target: str, weights: np.ndarray) -> DataFrame:
    """One row an Arrow batch: its summed gradient of the cross entropy by (class, feature and bias),
    flat, followed by its summed loss and number of rows.  ``weights``: classes x (features + 1)."""
    classes, width = weights.shape
    model = rows.sparkSession.sparkContext.broadcast(weights)  # classes x features

    def run(batches):
        w = model.value
        for b in batches:
            if b.num_rows:
                x = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width - 1), np.ones((b.num_rows, 1))], axis=1)
                y = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                z = x @ w.T
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                loss = -np.log(p[np.arange(len(y)), y]).sum()
                p[np.arange(len(y)), y] -= 1
                yield pa.RecordBatch.from_arrays([pa.array([np.r_[(p.T @ x).ravel(), loss, len(y)]], pa.list_(pa.float64()))], names=["part"])

    clean = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("long").alias("y"))
    clean = clean.where((F.size("x") == width - 1) & F.col("y").between(0, classes - 1) & ~F.exists("x", lambda e: e.isNull()))
    return clean.mapInArrow(run, "part array<double>")


def fit_softmax(rows: DataFrame, features: str, target: str, classes: int, width: int, steps: int, lr,
                betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> tuple[np.ndarray, list[float]]:
    """D-43: softmax regression by full-batch Adam (D-36) with the learning rate ``lr(step)`` of a schedule (D-28 ...).

    Each step is one pass over the (staged) rows: every batch sums its gradient in place, the sums are
    added position by position with partial aggregation, and what comes to the driver is one number for each
    weight, whatever the number of rows.  Rows with a null, a feature array of another width or
    a class outside 0 .. ``classes`` - 1 teach nothing; no rows leave the weights at 0.
    Returns (weights: classes x (width + 1), the bias last; mean loss before each step)."""
    data = stage_table(rows.select(features, target), "fit")
    w = np.zeros((classes, width + 1))
    m, v, losses = np.zeros_like(w), np.zeros_like(w), []
    for step in range(steps):
        parts = softmax_gradient_parts(data, features, target, w).select(F.posexplode("part").alias("at", "g"))
        total = {r["at"]: r["g"] for r in parts.groupBy("at").agg(F.sum("g").alias("g")).collect()}
        if not total:
            break
        flat = np.array([total[i] for i in range(w.size + 2)])
        grad = flat[:w.size].reshape(w.shape) / flat[-1]
        losses.append(float(flat[-2] / flat[-1]))
        m, v = betas[0] * m + (1 - betas[0]) * grad, betas[1] * v + (1 - betas[1]) * grad * grad
        up, down = m / (1 - betas[0] ** (step + 1)), np.sqrt(v / (1 - betas[1] ** (step + 1))) + eps
        w = w - lr(step) * up / down
    return w, losses


def predict_softmax(rows: DataFrame, features: str, weights: np.ndarray) -> DataFrame:
    """``rows`` with ``predicted``, the class of the largest logit (the smallest of equals)."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weights])
    x = F.col(features).cast("array<double>")
    logit = lambda w: F.aggregate(F.zip_with(F.concat(x, F.array(F.lit(1.0))), w, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    z = F.transform(table, logit)
    return rows.withColumn("_z", z).withColumn("predicted", (F.array_position("_z", F.array_max("_z")) - 1).cast("int")).drop("_z")


def write_checkpoint(state: DataFrame, skeleton: dict, root: str) -> None:
    """D-45: tensors as Parquet rows (step, name, shape, values) and the nested structure as JSON."""
    import json
    state.write.mode("overwrite").parquet(f"{root}/tensors")
    spark = state.sparkSession
    spark.createDataFrame([(json.dumps(skeleton),)], "skeleton string").coalesce(1).write.mode("overwrite").text(f"{root}/skeleton")


def load_checkpoint(spark, root: str, expected) -> tuple[DataFrame, dict]:
    """D-45 lenient load: tensors whose name is not expected (a list, or a DataFrame with a
    ``name`` column) are skipped with a semi join."""
    import json
    tensors = spark.read.parquet(f"{root}/tensors")
    keep = expected.select("name").distinct() if isinstance(expected, DataFrame) else \
        spark.createDataFrame([(e,) for e in expected], "name string")
    sk = json.loads(spark.read.text(f"{root}/skeleton").first()[0])
    return tensors.join(keep, "name", "left_semi"), sk
