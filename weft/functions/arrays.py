"""Row-wise tensor math on the ``vector`` encoding (one ARRAY<DOUBLE> per row).

All functions are higher-order array expressions (``transform``,
``aggregate``, ``zip_with``), evaluated inside the task that holds the row:
no shuffle, no Python.  Reductions over the *other* axis (across rows) live
in ``weft.operators.tensors`` and use groupBy with partial aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.elementwise import INF, NAN


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dbl(x) -> Column:
    return _c(x).cast("array<double>")


def let(x, fn) -> Column:
    """Evaluate ``x`` once and bind it for ``fn``.

    Higher-order functions are interpreted per element; an invariant such as
    the row maximum inside a ``transform`` lambda would otherwise be
    recomputed for every element (quadratic work)."""
    return F.element_at(F.transform(F.array(_c(x)), fn), 1)


def asum(x) -> Column:
    return F.aggregate(dbl(x), F.lit(0.0), lambda a, v: a + v)


def amean(x) -> Column:
    return asum(x) / F.size(_c(x))


def asumsq(x) -> Column:
    return F.aggregate(dbl(x), F.lit(0.0), lambda a, v: a + v * v)


def avar(x, unbiased: bool = True) -> Column:
    """Two-pass variance; unbiased divides by n-1 (n = 1 gives NaN like 0/0)."""
    def body(xv):
        n = F.size(xv)
        d = (n - 1) if unbiased else n
        return let(amean(xv), lambda m: F.when(
            d > 0, F.aggregate(xv, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / d).otherwise(F.lit(NAN)))
    return let(dbl(x), body)


def amax(x) -> Column:
    return F.array_max(dbl(x))


def amin(x) -> Column:
    return F.array_min(dbl(x))


def argmax(x) -> Column:
    """0-based index of the largest value (lowest index on ties)."""
    return (F.array_position(dbl(x), amax(x)) - 1).cast("int")


def argmin(x) -> Column:
    return (F.array_position(dbl(x), amin(x)) - 1).cast("int")


def norm(x, ord=2) -> Column:
    """Vector norms: 2 (Frobenius), inf, -inf, 0 (count of non-zeros), 1, -1 (n / sum(1/|x|)), p."""
    x = dbl(x)
    ab = F.transform(x, lambda v: F.abs(v))
    if ord in (2, "fro"):
        return F.sqrt(asumsq(x))
    if ord == INF:
        return F.array_max(ab)
    if ord == -INF:
        return F.array_min(ab)
    if ord == 0:
        return F.size(F.filter(x, lambda v: v != 0)).cast("double")
    if ord == 1:
        return asum(ab)
    if ord == -1:
        inv = F.aggregate(ab, F.lit(0.0), lambda a, v: a + F.when(v == 0, F.lit(INF)).otherwise(1.0 / v))
        return F.size(x) / inv
    p = float(ord)
    return F.pow(F.aggregate(ab, F.lit(0.0), lambda a, v: a + F.pow(v, F.lit(p))), F.lit(1.0 / p))


def softmax(x) -> Column:
    """exp(x - max) / sum(exp(x - max))."""
    def body(xv):
        e = let(F.array_max(xv), lambda m: F.transform(xv, lambda v: F.exp(v - m)))
        return let(e, lambda ev: let(asum(ev), lambda s: F.transform(ev, lambda v: v / s)))
    return let(dbl(x), body)


def logsumexp(x) -> Column:
    return let(dbl(x), lambda xv: let(F.array_max(xv), lambda m: m + F.log(
        F.aggregate(xv, F.lit(0.0), lambda a, v: a + F.exp(v - m)))))


def log_softmax(x) -> Column:
    return let(dbl(x), lambda xv: let(logsumexp(xv), lambda lse: F.transform(xv, lambda v: v - lse)))


def layer_norm(x, weight=None, bias=None, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(E[x^2] - mean^2 + eps) * w + b (biased variance)."""
    def body(xv):
        def with_mean(m):
            r = 1.0 / F.sqrt(asumsq(xv) / F.size(xv) - m * m + F.lit(eps))
            return let(r, lambda rv: F.transform(xv, lambda v: (v - m) * rv))
        return let(amean(xv), with_mean)
    return _affine(let(dbl(x), body), weight, bias)


def rms_norm(x, weight=None, eps: float = 1e-5) -> Column:
    def body(xv):
        return let(1.0 / F.sqrt(asumsq(xv) / F.size(xv) + F.lit(eps)), lambda r: F.transform(xv, lambda v: v * r))
    return _affine(let(dbl(x), body), weight, None)


def _affine(y, weight, bias):
    if weight is not None:
        y = F.zip_with(y, dbl(weight), lambda a, w: a * w)
    if bias is not None:
        y = F.zip_with(y, dbl(bias), lambda a, b: a + b)
    return y


def group_norm(x, groups: int, eps: float = 1e-5) -> Column:
    """Normalise each of ``groups`` equal, contiguous channel groups (biased variance)."""
    def body(xv):
        gs = (F.size(xv) / groups).cast("int")

        def stats(g):
            return let(F.slice(xv, g * gs + 1, gs), lambda part: let(amean(part), lambda m: F.struct(
                m.alias("m"), (1.0 / F.sqrt(asumsq(part) / F.size(part) - m * m + F.lit(eps))).alias("r"))))
        st = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), stats)
        return let(st, lambda sv: F.transform(xv, lambda v, i: let(
            F.element_at(sv, (F.floor(i / gs) + 1).cast("int")), lambda g: (v - g["m"]) * g["r"])))
    return let(dbl(x), body)


def l2_normalize(x, eps: float = 1e-7) -> Column:
    return let(dbl(x), lambda xv: let(F.sqrt(asumsq(xv)) + F.lit(eps), lambda n: F.transform(xv, lambda v: v / n)))


def sinusoidal(pos, dim: int, offset: int = 0) -> Column:
    """[sin(p*f_0..f_{d/2-1}) | cos(p*f_0..)] with f_i = 1/10000^(2i/d); ``dim`` even."""
    if dim % 2:
        raise ValueError("sinusoidal encoding needs an even dim")
    p = _c(pos).cast("double") + F.lit(float(offset))
    half = dim // 2
    idx = F.sequence(F.lit(0), F.lit(half - 1))
    f = F.transform(idx, lambda i: F.lit(1.0) / F.pow(F.lit(10000.0), F.lit(2.0) * i / F.lit(float(dim))))
    return F.concat(F.transform(f, lambda w: F.sin(p * w)), F.transform(f, lambda w: F.cos(p * w)))


def rope(x, pos, dim: int | None = None, base: float = 10000.0, offset: int = 0) -> Column:
    """Rotate halves of the first ``dim`` features: (x1, x2) -> (x1 c - x2 s, x1 s + x2 c),
    angle = p * base^(-2i/dim); features past ``dim`` unchanged."""
    x = dbl(x)
    d = F.size(x) if dim is None else F.lit(dim)
    h = (d / 2).cast("int")
    p = _c(pos).cast("double") + F.lit(float(offset))

    def ang(i):
        return p * F.pow(F.lit(base), -2.0 * i.cast("double") / d.cast("double"))

    def one(v, i):
        j = F.when(i < h, i).otherwise(i - h)
        a = ang(j)
        partner_lo = F.element_at(x, (i + h + 1).cast("int"))
        partner_hi = F.element_at(x, (i - h + 1).cast("int"))
        return (F.when(i >= 2 * h, v)
                .when(i < h, v * F.cos(a) - partner_lo * F.sin(a))
                .otherwise(partner_hi * F.sin(a) + v * F.cos(a)))
    return F.transform(x, one)


def alibi_slope(head, n_heads: int, max_bias: float = 8.0) -> Column:
    """Slope per head: n = 2^floor(log2 h); head < n: (2^(-max_bias/n))^(head+1),
    else (2^(-max_bias/2n))^(2(head-n)+1)."""
    n = 2 ** int(math.floor(math.log2(n_heads)))
    m0 = 2.0 ** (-max_bias / n)
    m1 = 2.0 ** (-max_bias / (2 * n))
    h = _c(head).cast("double")
    return F.when(h < n, F.pow(F.lit(m0), h + 1)).otherwise(F.pow(F.lit(m1), 2 * (h - n) + 1))


def one_hot(idx, num_classes: int) -> Column:
    i = _c(idx)
    return F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)), lambda j: (j == i).cast("int"))


def topk(x, k: int, largest: bool = True, ties_larger_index_first: bool = True) -> Column:  # noqa: D417
    """ARRAY<STRUCT<value, index>> of the k best entries (values ordered best first).

    Ties are ordered larger index first (``ties_larger_index_first``) like the
    GPU kernel, else lowest index first."""
    x = dbl(x)
    sgn = -1.0 if largest else 1.0
    isgn = -1 if ties_larger_index_first else 1
    keyed = F.transform(x, lambda v, i: F.struct((v * F.lit(sgn)).alias("k"), (i * F.lit(isgn)).alias("t"),
                                                 v.alias("value"), i.alias("index")))
    best = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(best, lambda s: F.struct(s["value"].alias("value"), s["index"].alias("index")))


def conv1d(x, kernel: list[float], stride: int = 1, padding: int = 0) -> Column:
    """1-D cross-correlation of a row with a fixed kernel, zero padding."""
    x = dbl(x)
    K = len(kernel)
    n = F.size(x) + 2 * padding
    n_out = F.floor((n - K) / stride) + 1
    ks = F.array(*[F.lit(float(w)) for w in kernel])

    def at(t):
        return F.aggregate(F.sequence(F.lit(0), F.lit(K - 1)), F.lit(0.0),
                           lambda a, o: a + F.element_at(ks, o + 1) * F.coalesce(
                               F.when((t * stride + o - padding >= 0) & (t * stride + o - padding < F.size(x)),
                                      F.element_at(x, (t * stride + o - padding + 1).cast("int"))), F.lit(0.0)))
    return F.when(n_out > 0, F.transform(F.sequence(F.lit(0), (n_out - 1).cast("int")), at)).otherwise(
        F.array().cast("array<double>"))


def quantize_blocks(x, block: int = 32, bits: int = 8) -> Column:
    """Q8_0 (qmax 127) / Q4 (qmax 7): per block of ``block`` values d = max|x| / qmax,
    q = round(x / d) (0 when d = 0).  Returns ARRAY<STRUCT<d, q ARRAY<INT>>>."""
    qmax = {8: 127.0, 4: 7.0}[bits]
    x = dbl(x)
    nb = F.ceil(F.size(x) / F.lit(block)).cast("int")

    def blk(b):
        part = F.slice(x, b * block + 1, block)
        d = F.array_max(F.transform(part, lambda v: F.abs(v))) / F.lit(qmax)
        q = F.transform(part, lambda v: F.when(d == 0, F.lit(0)).otherwise(F.round(v / d)).cast("int"))
        return F.struct(d.alias("d"), q.alias("q"))
    return F.transform(F.sequence(F.lit(0), nb - 1), blk)


def dequantize_blocks(blocks) -> Column:
    return F.flatten(F.transform(_c(blocks), lambda s: F.transform(s["q"], lambda q: q * s["d"])))


def is_finite(v) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(~F.isnan(v) & (F.abs(v) != F.lit(INF)), F.lit(False))


def masked_mean(x) -> Column:
    """Mean of the finite entries (NaN when none)."""
    f = F.filter(dbl(x), lambda v: ~F.isnan(v) & (F.abs(v) != F.lit(INF)))
    return F.when(F.size(f) > 0, asum(f) / F.size(f)).otherwise(F.lit(NAN))
