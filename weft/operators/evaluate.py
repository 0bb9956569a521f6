"""Losses and evaluation metrics (D-01 .. D-16).

Logits live in the vector encoding (one ARRAY<DOUBLE> per example), so every
per-example quantity is a row-local expression; batch reductions are plain
aggregates (partial + final), never a collect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import arrays as A
from weft.functions.elementwise import NAN

IGNORE_INDEX = -100


def nll_row(logits, target) -> Column:
    """-log_softmax(logits)[target] for one example (null when target is ignored)."""
    t = F.col(target) if isinstance(target, str) else target
    lsm = A.log_softmax(logits)
    return F.when(t == IGNORE_INDEX, F.lit(None).cast("double")).otherwise(-F.try_element_at(lsm, (t + 1).cast("int")))


def smoothed_row(logits, target, alpha: float) -> Column:
    """D-03: (1 - alpha) * nll + alpha * (-mean_j log p_j)."""
    t = F.col(target) if isinstance(target, str) else target
    return A.let(A.log_softmax(logits), lambda lsm: F.when(t == IGNORE_INDEX, F.lit(None).cast("double")).otherwise(
        F.lit(1.0 - alpha) * -F.try_element_at(lsm, (t + 1).cast("int")) + F.lit(alpha) * -A.amean(lsm)))


def cross_entropy(df: DataFrame, logits: str, target: str, by: Sequence[str] = (), alpha: float = 0.0) -> DataFrame:
    """D-01/D-02/D-03/D-04: per group — loss sum, mean over non-ignored rows (0 when none),
    count of valid rows and perplexity exp(mean)."""
    per = smoothed_row(F.col(logits), target, alpha) if alpha else nll_row(F.col(logits), target)
    x = df.withColumn("_l", per)
    return (x.groupBy(*by).agg(F.sum("_l").alias("loss_sum"), F.count("_l").alias("n_valid"))
            .withColumn("loss_sum", F.coalesce("loss_sum", F.lit(0.0)))
            .withColumn("loss_mean", F.when(F.col("n_valid") > 0, F.col("loss_sum") / F.col("n_valid")).otherwise(0.0))
            .withColumn("perplexity", F.exp("loss_mean")))


def token_matches(pred, target) -> Column:
    """D-06: per-position equality; unequal lengths give all false of the prediction's length."""
    p, t = _c(pred), _c(target)
    return F.when(F.size(p) == F.size(t), F.zip_with(p, t, lambda a, b: a == b)).otherwise(
        F.transform(p, lambda a: F.lit(False)))


def must_match(pred, target, strict: bool = False) -> Column:
    """D-07: 1 when every *predicted* token equals the target at that place (an empty or
    shorter correct prefix scores 1); ``strict`` also requires equal length."""
    p, t = _c(pred), _c(target)
    ok = F.forall(F.transform(p, lambda a, i: (i < F.size(t)) & (a == F.try_element_at(t, i + 1))), lambda b: b)
    if strict:
        ok = ok & (F.size(p) == F.size(t))
    return ok.cast("int")


def masked_accuracy(pred, labels) -> tuple[Column, Column]:
    """D-09: accuracy over positions with label != -100 (0 when none) and the per-position match row."""
    p, lab = _c(pred), _c(labels)
    row = F.transform(lab, lambda v, i: (v != IGNORE_INDEX) & (F.try_element_at(p, i + 1) == v))
    n = F.size(F.filter(lab, lambda v: v != IGNORE_INDEX))
    hits = F.size(F.filter(row, lambda b: b))
    return F.when(n > 0, hits / n).otherwise(F.lit(0.0)), row


def prediction_slice(pred, topology: str, prompt_len=None, mask=None) -> Column:
    """D-10: decoder -> after the prompt; encoder-decoder -> after position 1;
    encoder -> the masked positions."""
    p = _c(pred)
    if topology == "decoder":
        k = _c(prompt_len)
        return F.slice(p, k + 1, F.greatest(F.size(p) - k, F.lit(0)))
    if topology == "encoder-decoder":
        return F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
    return F.filter(p, lambda v, i: F.try_element_at(_c(mask), i + 1))


def aggregate_metrics(per_example: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """D-11: numbers averaged over finite values, booleans as 0/1, arrays averaged per example
    first; ``matches`` is reported as ``character_level_accuracy``; each metric divided by its
    own count.  Returns (by..., metric, value)."""
    cols = []
    for m in metrics:
        dt = per_example.schema[m].dataType.simpleString()
        c = F.col(m)
        if dt.startswith("array"):
            # entries that are not finite count as 0 over the full length
            whole = F.transform(c, lambda v: F.when(A.is_finite(v.cast("double")), v.cast("double")).otherwise(F.lit(0.0)))
            c = F.when(F.size(whole) > 0, A.asum(whole) / F.size(whole)).otherwise(F.lit(A.NAN))
        else:
            c = c.cast("double")
        name = "character_level_accuracy" if m == "matches" else m
        cols.append(F.struct(F.lit(name).alias("metric"), c.alias("v")))
    long = per_example.select(*by, F.explode(F.array(*cols)).alias("_m"))
    finite = ~F.isnan(F.col("_m.v")) & (F.abs(F.col("_m.v")) != F.lit(float("inf")))
    return (long.filter(finite).groupBy(*by, F.col("_m.metric").alias("metric"))
            .agg(F.avg("_m.v").alias("value")))


def append_tokens(seqs: Column, nxt: Column, stop_ids: Sequence[int]) -> tuple[Column, Column]:
    """D-15: append the next token unless the sequence already ended with a stop token
    (the stop token itself is appended).  Returns (new sequence, still_running)."""
    s = _c(seqs)
    stops = F.array(*[F.lit(x) for x in stop_ids])
    done = (F.size(s) > 0) & F.array_contains(stops, F.try_element_at(s, F.lit(-1)))
    new = F.when(done, s).otherwise(F.concat(s, F.array(_c(nxt))))
    running = ~F.array_contains(stops, F.try_element_at(new, F.lit(-1)))
    return new, running


def mlm_fill(pred, labels, inp) -> Column:
    """D-16: prediction where the label is not ignored, else the input token."""
    return F.zip_with(F.zip_with(_c(pred), _c(labels), lambda p, lab: F.struct(p.alias("p"), lab.alias("l"))),
                      _c(inp), lambda s, x: F.when(s["l"] != IGNORE_INDEX, s["p"]).otherwise(x))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


__all__ = ["cross_entropy", "nll_row", "smoothed_row", "token_matches", "must_match", "masked_accuracy",
           "prediction_slice", "aggregate_metrics", "append_tokens", "mlm_fill", "NAN"]
