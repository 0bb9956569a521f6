"""Experiment-log analytics (D-17 .. D-27).

The metric log is a table ``(run_id, metric, step, y, logged_at)``.  From the
``events`` table: run = user_id, metric = event_type, y = value, logged_at = ts,
and the implicit step = position of the log call inside its run in
(ts, event_id) order.  Per-run sequences use the skew-safe ordering helpers:
one run may hold a large share of the log.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.ordering import lag_value, prefix_agg, prefix_sum, row_index


def metric_log(events: DataFrame) -> DataFrame:
    """D-19: implicit steps — each log call of a run advances the run's step by one."""
    e = events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric"),
                      F.col("value").alias("y"), F.col("ts").alias("logged_at"), "event_id")
    return row_index(e, ["run_id"], ["logged_at", "event_id"], "step")


def logged_steps(calls: DataFrame, keys: Sequence[str], order: Sequence[str], at_step: str, start: DataFrame | None = None) -> DataFrame:
    """D-19 with explicit steps: adds ``step`` and ``_next``, the run's step after the call.

    A call without ``at_step`` is logged at the run's step, which then grows by one; a call with one is logged
    there, and the run's step becomes it if that is larger.  ``start``: ``(keys..., next)``, steps of runs that
    have begun.  With i implicit calls before a call, the run's step is i plus the largest of
    its start and of (at_step - implicit calls before it) over the explicit calls before: a running sum
    and a running maximum, so a long run is spread over blocks."""
    keys, order = list(keys), list(order)
    x = prefix_sum(calls, keys, order, F.when(F.col(at_step).isNull(), 1).otherwise(0).cast("long"), "_i", exclusive=True)
    x = prefix_agg(x, keys, order, F.col(at_step) - F.col("_i"), "_m", fn="max", exclusive=True)
    if start is None:
        x = x.withColumn("_s", F.lit(0).cast("long"))
    else:
        known = start.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("next").alias("_s"))
        on = F.lit(True)
        for n, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{n}"))
        x = x.join(known, on, "left").drop(*[f"_k{n}" for n in range(len(keys))])
    now = F.col("_i") + F.greatest(F.coalesce("_s", F.lit(0)), F.coalesce("_m", F.lit(0)))
    step = F.coalesce(F.col(at_step), now).cast("long")
    after = F.when(F.col(at_step).isNull(), now + 1).otherwise(F.greatest(now, F.col(at_step))).cast("long")
    return x.withColumns({"step": step, "_next": after}).drop("_i", "_m", "_s")


def known_runs(calls: DataFrame, runs: DataFrame, run_id: str = "run_id") -> DataFrame:
    """D-19: the calls themselves; one for a run that ``runs`` doesn't have is an error when it is evaluated."""
    known = runs.select(F.col(run_id).alias("_known")).distinct()
    bad = F.raise_error(F.concat(F.lit("no such run: "), F.coalesce(F.col(run_id).cast("string"), F.lit("null"))))
    return calls.join(known, F.col(run_id) == F.col("_known"), "left").withColumn(
        run_id, F.when(F.col("_known").isNotNull(), F.col(run_id)).otherwise(bad)).drop("_known")


def throughput(log: DataFrame, tokens_per_step: int) -> DataFrame:
    """D-17: steps/s and tokens/s between consecutive log points of a run (0 without a time delta)."""
    x = log.withColumn("_t", F.unix_micros(F.col("logged_at").cast("timestamp")))
    x = lag_value(x, ["run_id"], ["logged_at", "event_id"], {"_t": "_t_prev", "step": "_s_prev"})
    dt = (F.col("_t") - F.col("_t_prev")) / 1e6
    sps = F.when(F.col("_t_prev").isNotNull() & (dt > 0), (F.col("step") - F.col("_s_prev")) / dt).otherwise(F.lit(0.0))
    return x.withColumn("steps_per_sec", sps).withColumn("tokens_per_sec", sps * tokens_per_step).drop("_t", "_t_prev", "_s_prev")


def running_rate(log: DataFrame, tokens_per_step: int) -> DataFrame:
    """D-18: total tokens so far / elapsed seconds since the run's first log (elapsed >= 1 ms)."""
    x = log.withColumn("_t", F.unix_micros(F.col("logged_at").cast("timestamp")))
    x = prefix_agg(x, ["run_id"], ["logged_at", "event_id"], "_t", "_t0", fn="min")
    x = prefix_sum(x, ["run_id"], ["logged_at", "event_id"], F.lit(tokens_per_step).cast("long"), "total_tokens")
    elapsed = F.greatest((F.col("_t") - F.col("_t0")) / 1e6, F.lit(0.001))
    return x.withColumn("tokens_per_sec", F.col("total_tokens") / elapsed).drop("_t", "_t0")


def run_summary(log: DataFrame) -> DataFrame:
    """One row per run: created_at (first log), last_updated (last log), current step."""
    return log.groupBy("run_id").agg(F.min("logged_at").alias("created_at"), F.max("logged_at").alias("last_updated"),
                                     F.max("step").alias("step"))


def last_n_runs(log: DataFrame, n: int) -> DataFrame:
    """D-20: the n most recently updated runs (a top-k report: the limit is the feature)."""
    return run_summary(log).orderBy(F.col("last_updated").desc(), F.col("run_id")).limit(n)


def metric_names(log: DataFrame, n: int) -> DataFrame:
    """D-21: distinct metric names of the last n runs (semi join), sorted."""
    runs = last_n_runs(log, n).select("run_id")
    return log.join(runs, "run_id", "left_semi").select("metric").distinct().orderBy("metric")


def metric_groups(names: DataFrame) -> DataFrame:
    """D-22: group = text before the first '/', else 'default'; 'visualization/matches' is skipped."""
    g = F.when(F.instr("metric", "/") > 0, F.substring_index("metric", "/", 1)).otherwise(F.lit("default"))
    return (names.filter(F.col("metric") != "visualization/matches").withColumn("group", g)
            .groupBy("group").agg(F.sort_array(F.collect_set("metric")).alias("metrics")))


def minmax_downsample(log: DataFrame, bucket_steps: int) -> DataFrame:
    """D-23: per (run, metric, bucket of steps) keep the min and the max point."""
    b = F.floor(F.col("step") / bucket_steps).cast("long")
    return (log.withColumn("bucket", b).groupBy("run_id", "metric", "bucket")
            .agg(F.min_by("step", F.struct("y", "step")).alias("min_step"), F.min("y").alias("min_y"),
                 F.max_by("step", F.struct("y", F.col("step") * -1)).alias("max_step"), F.max("y").alias("max_y")))


def nearest_step(targets: DataFrame, series: DataFrame, keys: Sequence[str], target: str = "target_step",
                 step: str = "step") -> DataFrame:
    """D-24: for every target, the nearest logged step of the series (ties to the earlier
    step; targets outside the series' range get none).

    An as-of join without a per-key window: targets and series are unioned, the
    backward neighbour is a running max and the forward neighbour a running min
    in reverse order (both skew-safe two-level scans)."""
    keys = list(keys)
    t = targets.select(*keys, F.col(target).cast("long").alias("_pos"), F.lit(1).alias("_is_t"),
                       F.lit(None).cast("long").alias("_s"))
    s = series.select(*keys, F.col(step).cast("long").alias("_pos"), F.lit(0).alias("_is_t"),
                      F.col(step).cast("long").alias("_s")).distinct()
    u = t.unionByName(s)
    u = prefix_agg(u, keys, [F.col("_pos"), F.col("_is_t")], "_s", "_back", fn="max")
    u = prefix_agg(u, keys, [-F.col("_pos"), -F.col("_is_t")], "_s", "_fwd", fn="min")
    lo, hi = F.col("_back"), F.col("_fwd")
    inside = lo.isNotNull() & hi.isNotNull()
    pick = F.when(~inside, F.lit(None).cast("long")).when(F.col("_pos") - lo <= hi - F.col("_pos"), lo).otherwise(hi)
    return u.filter(F.col("_is_t") == 1).select(*keys, F.col("_pos").alias(target), pick.alias("nearest_step"))


def prev_run(summary: DataFrame) -> DataFrame:
    """D-27: the run created just before each run (global order, skew-safe lag)."""
    return lag_value(summary, [], ["created_at", "run_id"], "run_id", "prev_run_id")


def config_leaves(configs: DataFrame, key: str = "run_id", config: str = "config") -> DataFrame:
    """Flatten a JSON object column to (key, path, value) leaves (one nesting level per call)."""
    m = F.from_json(F.col(config), "map<string,string>")
    return configs.select(key, F.explode(m).alias("path", "value"))


def config_diff(curr: DataFrame, prev: DataFrame, key: str = "run_id", top: int = 3) -> DataFrame:
    """D-25: full outer comparison of leaf paths; changed paths rendered ``path:old→new``
    ordered by path, the first ``top`` kept and ``etc k more`` appended; ``no changes``
    when equal, ``initial experiment`` when there is no previous config (prev null)."""
    j = curr.alias("c").join(prev.alias("p"), [key, "path"], "full_outer")
    old = F.coalesce(F.col("p.value"), F.lit("∅"))
    new = F.coalesce(F.col("c.value"), F.lit("∅"))
    ch = j.filter(~F.col("c.value").eqNullSafe(F.col("p.value"))).select(
        key, "path", F.concat(F.col("path"), F.lit(":"), old, F.lit("→"), new).alias("change"))
    w = Window.partitionBy(key).orderBy("path")  # per-run groups: a run's config is a handful of leaves
    ranked = ch.withColumn("_r", F.row_number().over(w))
    agg = ranked.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", "change")))),
                                 lambda s: s["change"]), ", ").alias("_shown"),
        F.count("*").alias("_n"))
    text = F.when(F.col("_n") > top, F.concat(F.col("_shown"), F.lit(", etc "), (F.col("_n") - top).cast("string"),
                                              F.lit(" more"))).otherwise(F.col("_shown"))
    return agg.select(key, text.alias("diff"))


# --- D-25 on nested configs -----------------------------------------------------------------

LEAVES = "array<struct<path:string,kind:string,value:string>>"


def _leaves_of(config: str | None) -> list[dict]:
    """Paths (joined by a dot), kinds and JSON texts of all values that are neither object nor list."""
    out, todo = [], [("", json.loads(config) if config else None)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in value.items() if not isinstance(v, list)]
        elif path:
            kind = "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if value is not None else "null"
            out.append({"path": path, "kind": kind, "value": value if kind == "string" else json.dumps(value)})
    return out


def nested_leaves(configs: DataFrame, key: str = "run_id", config: str = "config") -> DataFrame:
    """``(key, path, kind, value)``: the leaves of a JSON config of any depth; lists are left out, a null
    config has none."""
    read = F.pandas_udf(lambda texts: texts.map(lambda t: _leaves_of(t if isinstance(t, str) else None)), LEAVES)
    return configs.select(key, F.explode(read(F.col(config).cast("string"))).alias("leaf")).select(key, "leaf.*")


def one_digit(n: float) -> str:
    """A number rounded to one significant digit, halves away from zero, as ``2e3``."""
    if n == 0:
        return "0"
    with localcontext(prec=1, rounding=ROUND_HALF_UP):
        d = +Decimal(n)
    return f"{'-' if d < 0 else ''}{d.as_tuple().digits[0]}e{d.adjusted()}"


def number_change(a: float, b: float) -> str:
    """How a changed number is shown: small integers in full; integers of one magnitude that share their
    leading digit by what follows it; all others to one digit."""
    whole = float(a).is_integer() and float(b).is_integer()
    if whole and max(abs(a), abs(b)) < 100:
        return f"{int(a)}→{int(b)}"
    if whole and min(a, b) >= 0 and a and b:
        size = math.floor(math.log10(a))
        unit = 10 ** size
        if math.floor(math.log10(b)) == size and abs(b - a) < unit:
            lead = int(a) // unit
            return f"{lead}e{size}+({int(a) - lead * unit}→{int(b) - lead * unit})"
    return f"{one_digit(a)}⥵{one_digit(b)}"


def _change(label: str, was: str | None, old: str | None, now: str | None, new: str | None) -> str:
    if was == now == "bool":
        return ("+" if new == "true" else "-") + label
    if was == now == "number":
        return f"{label}:{number_change(json.loads(old), json.loads(new))}"
    show = lambda kind, v: "undefined" if kind is None else one_digit(json.loads(v)) if kind == "number" else v
    return f"{label}:{show(was, old)}→{show(now, new)}"


def nested_config_diff(curr: DataFrame, prev: DataFrame, key: str = "run_id", top: int = 3, labels: dict | None = None,
                       boosts: dict | None = None) -> DataFrame:
    """D-25: ``(key, diff)`` for every key with a changed leaf, from the leaves (:func:`nested_leaves`) of two configs.

    Booleans show as ``+label`` / ``-label``, numbers by :func:`number_change`, all else as old→new, a missing
    leaf as ``undefined``; numbers are equal by value.  ``labels``: path -> label or (label, boost); a leaf without
    one is skipped (without ``labels`` the path is the label).  Order: highest boost first (its own or that of
    any path prefix in ``boosts``, 0 otherwise), then label by code point; the first ``top`` are shown
    and the others counted."""
    paths = {p: (x, 0.0) if isinstance(x, str) else (x[0], float(x[1])) for p, x in (labels or {}).items()}
    prefixes = dict(boosts or {})

    def rank(path: str) -> float:
        parts = path.split(".")
        return max([0.0, paths.get(path, ("", 0.0))[1], *(float(prefixes.get(".".join(parts[:i]), 0)) for i in range(1, len(parts) + 1))])

    def shown(pdf):
        told = [(_change(paths.get(p, (p,))[0], *c), rank(p), paths.get(p, (p,))[0]) for p, *c in pdf.itertuples(index=False)]
        return pd.DataFrame(told, columns=["text", "boost", "label"])

    show = F.pandas_udf(lambda p, a, b, c, d: shown(pd.DataFrame({"p": p, "a": a, "b": b, "c": c, "d": d}).astype(object).where(
        lambda x: x.notna(), None)), "text string, boost double, label string")
    c, p = curr.alias("c"), prev.alias("p")
    both = c.join(p, (F.col(f"c.{key}") == F.col(f"p.{key}")) & (F.col("c.path") == F.col("p.path")), "full_outer")
    number = (F.col("c.kind") == "number") & (F.col("p.kind") == "number")
    same = F.when(number, F.col("c.value").cast("double") == F.col("p.value").cast("double")).otherwise(
        F.col("c.kind").eqNullSafe(F.col("p.kind")) & F.col("c.value").eqNullSafe(F.col("p.value")))
    path = F.coalesce("c.path", "p.path")
    changed = both.where(~F.coalesce(same, F.lit(False)))
    if labels is not None:
        changed = changed.where(path.isin(list(paths)))
    lines = changed.select(F.coalesce(f"c.{key}", f"p.{key}").alias(key), show(path, F.col("p.kind"), F.col("p.value"), F.col("c.kind"), F.col("c.value")).alias("s"))
    # a key's changes are at most the leaves of its two configs
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("s.boost"), "s.label"))
    first = F.array_sort(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", "s.text"))))
    agg = lines.withColumn("_r", nth).groupBy(key).agg(first.alias("_f"), F.count("*").alias("_n"))
    rest = F.when(F.col("_n") > top, F.concat(F.lit(", etc "), (F.col("_n") - top).cast("string"), F.lit(" more"))).otherwise("")
    return agg.select(key, F.concat(F.array_join("_f.text", ", "), rest).alias("diff"))
