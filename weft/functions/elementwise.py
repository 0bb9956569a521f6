"""Element-wise tensor operators (C1, C2) as Column expressions.

Tensor semantics differ from SQL in a few places that matter: x/0 is ±inf
(ANSI Spark raises), ln(0) is -inf and ln(x<0) NaN (Spark returns NULL),
booleans are 0/1 integers, ``pow`` keeps the sign of the base.  Each function
guards those cases with ``when`` so nothing raises and the value matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")
# fixed values: the tanh-approximation constants of gelu
GELU_A = 0.035677407
GELU_B = 0.7978846


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def _d(x) -> Column:
    return _c(x).cast("double")


# --- C1 unary ------------------------------------------------------------------

def exp(x):
    return F.exp(_d(x))


def log(x):
    x = _d(x)
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).when(x.isNotNull(), F.lit(NAN))


def sin(x):
    return F.sin(_d(x))


def cos(x):
    return F.cos(_d(x))


def abs_(x):
    return F.abs(_d(x))


def neg(x):
    return -_d(x)


def square(x):
    x = _d(x)
    return x * x


def sqrt(x):
    x = _d(x)
    return F.when(x >= 0, F.sqrt(x)).when(x.isNotNull(), F.lit(NAN))


def div(a, b):
    """a / b with IEEE results for b = 0: ±inf, NaN for 0/0."""
    a, b = _d(a), _d(b)
    return (F.when(b != 0, a / b).when(b.isNull(), b)
            .when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(a.isNotNull(), F.lit(NAN)))


def recip(x):
    return div(F.lit(1.0), x)


def floor(x):
    return F.floor(_d(x)).cast("double")


def ceil(x):
    return F.ceil(_d(x)).cast("double")


def tanh(x):
    return F.tanh(_d(x))


def sigmoid(x):
    """Two-branch stable logistic."""
    x = _d(x)
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def relu(x):
    return maximum(x, F.lit(0.0))


def relu2(x):
    r = relu(x)
    return r * r


def silu(x):
    x = _d(x)
    return x * sigmoid(x)


def swiglu(x):
    """x^2 * sigmoid(x) (the single-input form)."""
    x = _d(x)
    return x * x * sigmoid(x)


def gelu(x):
    x = _d(x)
    return x * (0.5 + 0.5 * F.tanh(x * (F.lit(GELU_A) * x * x + F.lit(GELU_B))))


def logical_not(x):
    return F.when(_c(x) == 0, 1).otherwise(0)


def isnan(x):
    return F.isnan(_d(x)).cast("int")


def isinf(x):
    return (F.abs(_d(x)) == F.lit(INF)).cast("int")


UNARY = {
    "exp": exp, "log": log, "sin": sin, "cos": cos, "abs": abs_, "neg": neg, "square": square,
    "sqrt": sqrt, "recip": recip, "floor": floor, "ceil": ceil, "tanh": tanh, "sigmoid": sigmoid,
    "relu": relu, "relu2": relu2, "silu": silu, "swiglu": swiglu, "gelu": gelu,
}


# --- C2 binary / ternary / compare -----------------------------------------------

def add(a, b):
    return _d(a) + _d(b)


def sub(a, b):
    return _d(a) - _d(b)


def mul(a, b):
    return _d(a) * _d(b)


def pow_(a, b):
    """Sign-preserving power: sign(a) * |a|^b."""
    a, b = _d(a), _d(b)
    return F.signum(a) * F.pow(F.abs(a), b)


def maximum(a, b):
    """The larger one; null if either is (``greatest`` would skip it)."""
    a, b = _d(a), _d(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def minimum(a, b):
    """The smaller one; null if either is."""
    a, b = _d(a), _d(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def addcdiv(x, a, b, value=1.0):
    return _d(x) + F.lit(value) * div(a, b)


def addcmul(x, a, b, value=1.0):
    return _d(x) + F.lit(value) * _d(a) * _d(b)


def cmp(op: str, a, b):
    a, b = _c(a), _c(b)
    r = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]
    return r.cast("int")


def logical(op: str, a, b):
    a, b = _c(a) != 0, _c(b) != 0
    r = {"and": a & b, "or": a | b, "xor": a != b}[op]
    return r.cast("int")


def lerp(a, b, w):
    a = _d(a)
    return a + _d(w) * (_d(b) - a)


def affine(x, mul_, add_):
    return _d(x) * F.lit(mul_) + F.lit(add_)


def where_cond(x, cond, on_false):
    """(input, condition, on_false): input where condition != 0 else on_false."""
    return F.when(_c(cond) != 0, _d(x)).otherwise(_d(on_false))


def clamp(x, lo=None, hi=None):
    x = _d(x)
    if lo is not None:
        x = maximum(x, lo)
    if hi is not None:
        x = minimum(x, hi)
    return x


def cast(x, dtype: str):
    """dtype in f32/f16/bf16 (float), i32 (int), u32 (long, negative -> NULL)."""
    spark_t = {"f32": "float", "f16": "float", "bf16": "float", "i32": "int", "u32": "long", "f64": "double"}[dtype]
    y = _c(x).try_cast(spark_t)
    return F.when(y >= 0, y) if dtype == "u32" else y


def sinusoid_freq(i: int, dim: int) -> float:
    return 1.0 / math.pow(10000.0, 2.0 * i / dim)
