"""Registered experiment-log queries (section D, second half) over ``events``.

run = user_id, metric = event_type, y = value, logged_at = ts; the implicit step
is the position of the log call inside its run in (ts, event_id) order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import optim as OP
from weft.operators import runs as RN
from weft.plans.catalog import register
from weft.session import checkpoint_dir
from weft.sources.tables import Tables

TOKENS_PER_STEP = 32 * 128  # batch x sequence length


def R(c, d=6):
    return F.round(c, d)


def log(spark, sf_dir):
    """The metric log table (implicit steps assigned once, then read by every report)."""
    checkpoint_dir(spark)
    return RN.metric_log(Tables(spark, sf_dir).events).checkpoint(eager=True)


LOG_SQL = """lg AS (SELECT user_id AS run_id, event_type AS metric, value AS y, ts AS logged_at, event_id,
            CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step FROM events)"""


@register("d19_log_metrics", "D-19", sql=f"WITH {LOG_SQL} SELECT run_id, metric, step, round(y, 6) AS y FROM lg")
def d19_log_metrics(spark, sf_dir):
    return log(spark, sf_dir).select("run_id", "metric", "step", R(F.col("y")).alias("y"))


@register("d17_throughput", "D-17", sql=f"""WITH {LOG_SQL},
l AS (SELECT *, epoch_us(logged_at) AS t, LAG(epoch_us(logged_at)) OVER (PARTITION BY run_id ORDER BY logged_at, event_id) AS tp,
             LAG(step) OVER (PARTITION BY run_id ORDER BY logged_at, event_id) AS sp FROM lg)
SELECT run_id, step, round(CASE WHEN tp IS NOT NULL AND t > tp THEN (step - sp) / ((t - tp) / 1e6) ELSE 0.0 END, 6) AS steps_per_sec,
       round(CASE WHEN tp IS NOT NULL AND t > tp THEN (step - sp) / ((t - tp) / 1e6) ELSE 0.0 END * {TOKENS_PER_STEP}, 4) AS tokens_per_sec
FROM l""")
def d17_throughput(spark, sf_dir):
    t = RN.throughput(log(spark, sf_dir), TOKENS_PER_STEP)
    return t.select("run_id", "step", R(F.col("steps_per_sec")).alias("steps_per_sec"), R(F.col("tokens_per_sec"), 4).alias("tokens_per_sec"))


@register("d18_running_rate", "D-18", sql=f"""WITH {LOG_SQL},
l AS (SELECT *, epoch_us(logged_at) AS t, MIN(epoch_us(logged_at)) OVER (PARTITION BY run_id) AS t0 FROM lg)
SELECT run_id, step, CAST((step + 1) * {TOKENS_PER_STEP} AS BIGINT) AS total_tokens,
       round((step + 1) * {TOKENS_PER_STEP} / greatest((t - t0) / 1e6, 0.001), 4) AS tokens_per_sec FROM l""")
def d18_running_rate(spark, sf_dir):
    r = RN.running_rate(log(spark, sf_dir), TOKENS_PER_STEP)
    return r.select("run_id", "step", "total_tokens", R(F.col("tokens_per_sec"), 4).alias("tokens_per_sec"))


@register("d20_last_n_runs", "D-20", sql=f"""WITH {LOG_SQL}
SELECT run_id, MIN(logged_at) AS created_at, MAX(logged_at) AS last_updated, MAX(step) AS step
FROM lg GROUP BY run_id ORDER BY last_updated DESC, run_id LIMIT 5""")
def d20_last_n_runs(spark, sf_dir):
    return RN.last_n_runs(log(spark, sf_dir), 5)


@register("d21_metric_names", "D-21 D-22", sql=f"""WITH {LOG_SQL},
r AS (SELECT run_id FROM lg GROUP BY run_id ORDER BY MAX(logged_at) DESC, run_id LIMIT 5),
m AS (SELECT DISTINCT metric FROM lg WHERE run_id IN (SELECT run_id FROM r))
SELECT CASE WHEN strpos(metric, '/') > 0 THEN split_part(metric, '/', 1) ELSE 'default' END AS "group",
       array_to_string(list_sort(list(metric)), ',') AS metrics FROM m WHERE metric <> 'visualization/matches' GROUP BY 1""")
def d21_metric_names(spark, sf_dir):
    g = RN.metric_groups(RN.metric_names(log(spark, sf_dir), 5))
    return g.select("group", F.array_join("metrics", ",").alias("metrics"))


@register("d23_minmax_downsample", "D-23", sql=f"""WITH {LOG_SQL},
r AS (SELECT run_id FROM lg GROUP BY run_id ORDER BY MAX(logged_at) DESC, run_id LIMIT 5)
SELECT run_id, metric, CAST(step // 10 AS BIGINT) AS bucket, arg_min(step, (y, step)) AS min_step, round(MIN(y), 6) AS min_y,
       arg_max(step, (y, -step)) AS max_step, round(MAX(y), 6) AS max_y
FROM lg WHERE run_id IN (SELECT run_id FROM r) GROUP BY run_id, metric, step // 10""")
def d23_minmax_downsample(spark, sf_dir):
    lg = log(spark, sf_dir)
    runs = RN.last_n_runs(lg, 5).select("run_id")
    d = RN.minmax_downsample(lg.join(runs, "run_id", "left_semi"), 10)
    return d.select("run_id", "metric", "bucket", "min_step", R(F.col("min_y")).alias("min_y"), "max_step",
                    R(F.col("max_y")).alias("max_y"))


@register("d24_nearest_step", "D-24", sql=f"""WITH {LOG_SQL},
t AS (SELECT run_id, step AS target_step FROM lg WHERE metric = 'click'),
s AS (SELECT DISTINCT run_id, step FROM lg WHERE metric = 'view'),
b AS (SELECT t.run_id, t.target_step, MAX(s.step) AS lo FROM t LEFT JOIN s ON s.run_id = t.run_id AND s.step <= t.target_step GROUP BY 1, 2),
f AS (SELECT t.run_id, t.target_step, MIN(s.step) AS hi FROM t LEFT JOIN s ON s.run_id = t.run_id AND s.step >= t.target_step GROUP BY 1, 2)
SELECT b.run_id, b.target_step, CASE WHEN lo IS NULL OR hi IS NULL THEN NULL WHEN b.target_step - lo <= hi - b.target_step THEN lo ELSE hi END AS nearest_step
FROM b JOIN f USING (run_id, target_step)""")
def d24_nearest_step(spark, sf_dir):
    lg = log(spark, sf_dir)
    t = lg.filter(F.col("metric") == "click").select("run_id", F.col("step").alias("target_step"))
    s = lg.filter(F.col("metric") == "view").select("run_id", "step")
    return RN.nearest_step(t, s, ["run_id"])


RUNS_SQL = f"""{LOG_SQL},
rs AS (SELECT run_id, MIN(logged_at) AS created_at, arg_min(props, (logged_at, lg.event_id)) AS config FROM lg JOIN events ON events.event_id = lg.event_id GROUP BY run_id),
pr AS (SELECT run_id, created_at, config, LAG(run_id) OVER (ORDER BY created_at, run_id) AS prev_run_id FROM rs)"""


@register("d27_prev_run", "D-27", sql=f"WITH {RUNS_SQL} SELECT run_id, prev_run_id FROM pr")
def d27_prev_run(spark, sf_dir):
    s = RN.run_summary(log(spark, sf_dir))
    return RN.prev_run(s).select("run_id", "prev_run_id")


@register("d25_config_diff", "D-25", sql=f"""WITH {RUNS_SQL},
cur AS (SELECT run_id, prev_run_id, json_extract_string(config, '$.k') AS k FROM pr),
old AS (SELECT c.run_id, c.prev_run_id, c.k AS new_k, p.k AS old_k FROM cur c LEFT JOIN cur p ON p.run_id = c.prev_run_id)
SELECT run_id, CASE WHEN prev_run_id IS NULL THEN 'initial experiment'
                    WHEN new_k IS NOT DISTINCT FROM old_k THEN 'no changes'
                    ELSE 'k:' || COALESCE(old_k, '∅') || '→' || COALESCE(new_k, '∅') END AS diff FROM old""")
def d25_config_diff(spark, sf_dir):
    """A run's config = the JSON props of its first log event; compared with the previous run's."""
    ev = Tables(spark, sf_dir).events
    lg = log(spark, sf_dir)
    cfg = (lg.join(ev.select("event_id", "props"), "event_id")
           .groupBy("run_id").agg(F.min("logged_at").alias("created_at"),
                                  F.min_by("props", F.struct("logged_at", "event_id")).alias("config")))
    pr = RN.prev_run(cfg.select("run_id", "created_at", "config"))
    cur = RN.config_leaves(pr, "run_id", "config")
    prev = (RN.config_leaves(cfg.select(F.col("run_id").alias("src"), "config"), "src", "config")
            .join(pr.select("run_id", F.col("prev_run_id").alias("src")), "src").drop("src"))
    d = RN.config_diff(cur, prev, "run_id")
    return (pr.select("run_id", "prev_run_id").join(d, "run_id", "left")
            .select("run_id", F.when(F.col("prev_run_id").isNull(), F.lit("initial experiment"))
                    .otherwise(F.coalesce(F.col("diff"), F.lit("no changes"))).alias("diff")))


@register("d28_lr_schedules", "D-28 D-29 D-30 D-31 D-32 D-33", sql=f"""WITH {LOG_SQL}
SELECT run_id, step, round(CASE WHEN step < 5 THEN 0.1 / 3 ELSE 0.1 END, 8) AS lr_constant,
  round(0.1 * (1.0 / 3 + (1.0 - 1.0 / 3) * least(step, 50) / 50.0), 8) AS lr_linear,
  round(0.1 * pow(0.5, floor(step / 10)), 8) AS lr_step,
  round(0.1 * pow(0.1, (CASE WHEN step >= 5 THEN 1 ELSE 0 END) + (CASE WHEN step >= 20 THEN 1 ELSE 0 END)), 8) AS lr_multistep,
  round(0.1 * pow(0.97, step), 8) AS lr_exponential,
  round(CASE WHEN step < 60 THEN 0.001 + (0.1 - 0.001) * (1 + cos(pi() * step / 60.0)) / 2 ELSE 0.001 END, 8) AS lr_cosine
FROM lg""")
def d28_lr_schedules(spark, sf_dir):
    lg = log(spark, sf_dir)
    t = F.col("step")
    return lg.select("run_id", "step",
                     F.round(OP.lr_constant(t, 0.1, 1 / 3, 5), 8).alias("lr_constant"),
                     F.round(OP.lr_linear(t, 0.1, 1 / 3, 1.0, 50), 8).alias("lr_linear"),
                     F.round(OP.lr_step(t, 0.1, 10, 0.5), 8).alias("lr_step"),
                     F.round(OP.lr_multistep(t, 0.1, [5, 20, 20], 0.1), 8).alias("lr_multistep"),
                     F.round(OP.lr_exponential(t, 0.1, 0.97), 8).alias("lr_exponential"),
                     F.round(OP.lr_cosine(t, 0.1, 60, 0.001), 8).alias("lr_cosine"))


@register("d34_lr_sequential", "D-34", sql=f"""WITH {LOG_SQL}
SELECT run_id, step, round(CASE WHEN step < 10 THEN 0.1 * (0.1 + 0.9 * least(step, 8) / 8.0)
                                ELSE 0.1 * pow(0.95, step - 10) END, 8) AS lr FROM lg""")
def d34_lr_sequential(spark, sf_dir):
    """Warm-up (linear 0.1 -> 1 of base over 8 steps) then, from milestone 10, exponential decay
    starting from the rate the warm-up reached, over every logged step."""
    warm = (lambda t, s: F.lit(s) * (0.1 + 0.9 * F.least(t, F.lit(8)) / 8.0), lambda t, s: s * (0.1 + 0.9 * min(t, 8) / 8.0))
    expo = (lambda t, s: F.lit(s) * F.pow(F.lit(0.95), t), lambda t, s: s * 0.95 ** t)
    lg = log(spark, sf_dir)
    return lg.select("run_id", "step", F.round(OP.lr_sequential(F.col("step"), [warm, expo], [10], 0.1), 8).alias("lr"))


_NESTED_SQL = """'{"train":{"steps":' || (event_id % 7) || ',"amp":' || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END
  || ',"sched":{"name":"' || event_type || '"}},"seed":' || (event_id % 50) || '}'"""


@register("d25_nested_config_diff", "D-25", sql=f"""WITH {RUNS_SQL},
f AS (SELECT lg.run_id, MIN(lg.logged_at) AS created_at, arg_min(lg.event_id, (lg.logged_at, lg.event_id)) AS event_id FROM lg GROUP BY lg.run_id),
c AS (SELECT f.run_id, f.created_at, f.event_id, event_type AS name FROM f JOIN events USING (event_id)),
p AS (SELECT *, LAG(event_id) OVER (ORDER BY created_at, run_id) AS before, LAG(name) OVER (ORDER BY created_at, run_id) AS old FROM c),
d AS (SELECT run_id, before, list_filter([
    CASE WHEN name <> old THEN 'sched:' || old || '→' || name END,
    CASE WHEN (event_id % 3 = 0) <> (before % 3 = 0) THEN CASE WHEN event_id % 3 = 0 THEN '+amp' ELSE '-amp' END END,
    CASE WHEN event_id % 7 <> before % 7 THEN 'steps:' || (before % 7) || '→' || (event_id % 7) END,
    CASE WHEN event_id % 50 <> before % 50 THEN 'seed:' || (before % 50) || '→' || (event_id % 50) END], lambda x: x IS NOT NULL) AS l FROM p)
SELECT run_id, CASE WHEN before IS NULL THEN 'initial experiment' WHEN len(l) = 0 THEN 'no changes'
  ELSE array_to_string(l[1:3], ', ') || CASE WHEN len(l) > 3 THEN ', etc ' || (len(l) - 3) || ' more' ELSE '' END END AS diff FROM d""")
def d25_nested_config_diff(spark, sf_dir):
    """Nested configs made of each run's first log event, compared with the previous run's; the scheduler
    comes first, then the other training values, then the rest."""
    ev = Tables(spark, sf_dir).events
    config = F.to_json(F.struct(
        F.struct((F.col("event_id") % 7).alias("steps"), (F.col("event_id") % 3 == 0).alias("amp"),
                 F.struct(F.col("event_type").alias("name")).alias("sched")).alias("train"), (F.col("event_id") % 50).alias("seed")))
    first = log(spark, sf_dir).groupBy("run_id").agg(F.min("logged_at").alias("created_at"), F.min_by("event_id", F.struct("logged_at", "event_id")).alias("event_id"))
    cfg = first.join(ev.select("event_id", config.alias("config")), "event_id")
    pr = RN.prev_run(cfg.select("run_id", "created_at", "config"))
    old = RN.nested_leaves(cfg.select(F.col("run_id").alias("src"), "config"), "src").join(
        pr.select("run_id", F.col("prev_run_id").alias("src")), "src").drop("src")
    labels = {"train.steps": "steps", "train.amp": "amp", "train.sched.name": ("sched", 3), "seed": "seed"}
    d = RN.nested_config_diff(RN.nested_leaves(pr.where("prev_run_id IS NOT NULL")), old, labels=labels, boosts={"train": 2})
    return (pr.select("run_id", "prev_run_id").join(d, "run_id", "left")
            .select("run_id", F.when(F.col("prev_run_id").isNull(), F.lit("initial experiment"))
                    .otherwise(F.coalesce(F.col("diff"), F.lit("no changes"))).alias("diff")))
