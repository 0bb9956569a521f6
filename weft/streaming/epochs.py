"""Streams whose micro-batches are batch jobs with state in tables (S-01 .. S-05).

A micro-batch ("epoch") is worked on by the batch operators, so a corpus or run that holds a third of all
rows is spread over blocks as in a batch job and no key's rows meet in one task.  What an epoch hands on
(offsets, open shards and batches, buffered rows) is a table of that epoch below the query's folder:
epoch n reads the tables of epoch n - 1 and writes outputs and state of its own, overwriting what a failed
attempt left.  Spark commits the epoch after that; an epoch repeated after a failure gets the
same rows and the same state, so its outcome is the same, and readers see committed epochs only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators import corpus as C
from weft.operators.ordering import prefix_sum, row_index
from weft.operators.runs import logged_steps
from weft.session import stage_table, staged_until


class EpochQuery:
    """A resumable streaming query in the folder ``base`` (shared by driver and executors).

    ``step(query, batch, epoch)`` works on one micro-batch with :meth:`before` and :meth:`put`.  ``run``
    takes in what the source has now; a new object on the same folder goes on where the last one stopped."""

    def __init__(self, spark: SparkSession, base: str, step: Callable[[EpochQuery, DataFrame, int], None]):
        self.spark, self.base, self.step = spark, base.rstrip("/"), step

    def _path(self, name: str, epoch) -> str:
        return f"{self.base}/{name}/epoch={epoch}"

    def _epochs(self, path: str, pattern: str) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        names = (s.getPath() for s in found)
        return sorted(int((p if p.getName() != "_SUCCESS" else p.getParent()).getName().rpartition("=")[2]) for p in names)

    def committed(self) -> int:
        """Epochs that are done."""
        done = self._epochs(f"{self.base}/checkpoint/commits", "[0-9]*")
        return done[-1] + 1 if done else 0

    def put(self, name: str, df: DataFrame, epoch: int, **options) -> DataFrame:
        """``df`` as the epoch's table ``name``; returns the written rows.  ``options`` are the writer's."""
        df.write.mode("overwrite").options(**options).parquet(self._path(name, epoch))
        return self.spark.read.schema(df.schema).parquet(self._path(name, epoch))

    def before(self, name: str, epoch: int, schema: str) -> DataFrame:
        """The table ``name`` of the epoch before; empty for the first."""
        if epoch == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name, epoch - 1))

    def rows(self, name: str, schema: str) -> DataFrame:
        """All committed rows of the output ``name``."""
        n = self.committed()
        paths = [self._path(name, e) for e in self._epochs(f"{self.base}/{name}", "epoch=*") if e < n]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def left(self, name: str, schema: str) -> DataFrame:
        """The state ``name`` after the last committed epoch."""
        return self.before(name, self.committed(), schema)

    def run(self, source: DataFrame) -> EpochQuery:
        q = (source.writeStream.foreachBatch(lambda batch, epoch: self.step(self, batch, epoch))
             .option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception():
            raise q.exception()
        return self


def _types(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _with_state(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the state of their key, which has one row a key; null keys match each other."""
    there = state.withColumnsRenamed({k: f"_s_{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_s_{i}"))
    return rows.join(there, on, "left").drop(*[f"_s_{i}" for i in range(len(keys))])


def _next(rows: DataFrame, state: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    """``(keys..., next)``: the state's counter plus the amounts of the rows."""
    new = rows.groupBy(*keys).agg(F.sum(amount).cast("long").alias("next"))
    return new.unionByName(state.select(*keys, "next")).groupBy(*keys).agg(F.sum("next").alias("next"))


# --- S-01 shards ---------------------------------------------------------------------------

#: Ids in a file of shards at most.
IDS_PER_FILE = 4_000_000


def shard_query(spark: SparkSession, base: str, pieces: Callable[[DataFrame], DataFrame], keys: Sequence[str], order: Sequence[str],
                per_shard: int, key_types: str, eos: int | None = None, ids_type: str = "array<int>") -> EpochQuery:
    """S-01: documents arriving in order become token shards of ``per_shard`` tokens for each corpus.

    ``pieces`` makes ``(keys..., order..., ids)`` of a micro-batch, ids being arrays or (``ids_type`` string) text; within a micro-batch ``order`` decides,
    and later micro-batches follow earlier ones.  State: the next offset of each corpus and the
    pieces of its open shard (fewer than ``per_shard`` tokens).  Outputs: :func:`shards`, kept in the form of the ids.

    A shard is one long value, and a reader holds a file's rows by the batch: so a file has at most
    ``IDS_PER_FILE`` ids (or one shard) and a page one shard, whatever a task got.  What an epoch stages is gone at its end."""
    keys = list(keys)
    wide = {"maxRecordsPerFile": max(1, IDS_PER_FILE // per_shard), "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}

    def step(query: EpochQuery, batch: DataFrame, epoch: int) -> None:
        with staged_until(spark):
            before = query.before("offsets", epoch, f"{key_types}, next long")
            start = C.flatten_tokens(pieces(batch), keys, list(order), eos=eos)
            begun = _with_state(start.select(*keys, "start", "ids", "n_tokens"), before, keys).select(
                *keys, (F.col("start") + F.coalesce("next", F.lit(0))).cast("long").alias("start"), F.col("ids").cast(ids_type).alias("ids"),
                F.col("n_tokens").cast("long").alias("n_tokens"))
            held = query.before("open", epoch, f"{key_types}, start long, ids {ids_type}, n_tokens long")
            cut = stage_table(C.shard_pieces(begun.unionByName(held), per_shard), "cut")
            # a corpus goes on where its last slice ends
            ends = cut.select(*keys, (F.col("shard") * per_shard + F.col("offset") + F.col("n_tokens")).cast("long").alias("next"))
            now = query.put("offsets", ends.unionByName(before.select(*keys, "next")).groupBy(*keys).agg(F.max("next").alias("next")), epoch)
            cut = _with_state(cut, now, keys).withColumn("full", F.col("shard") < F.floor(F.col("next") / per_shard))
            query.put("shards", C.joined_shards(cut.where("full").drop("full", "next"), keys).select(*keys, "shard", "tokens"), epoch, **wide)
            query.put("open", cut.where("not full").select(
                *keys, (F.col("shard") * per_shard + F.col("offset")).cast("long").alias("start"), "ids", "n_tokens"), epoch)

    query = EpochQuery(spark, base, step)
    query.keys, query.key_types, query.per_shard, query.ids_type = keys, key_types, per_shard, ids_type
    return query


def shards(query: EpochQuery, closed: bool = False) -> DataFrame:
    """``(keys..., shard, tokens)``: the full shards so far; with ``closed`` also each corpus's last, open one."""
    full = C.id_arrays(query.rows("shards", f"{query.key_types}, shard long, tokens {query.ids_type}"), "tokens")
    if not closed:
        return full
    held = query.left("open", f"{query.key_types}, start long, ids {query.ids_type}, n_tokens long")
    last = C.assemble_shards(C.shard_pieces(held, query.per_shard), query.keys)
    return full.unionByName(last.select(*query.keys, F.col("shard").cast("long").alias("shard"), "tokens"))


# --- S-02 windows from a committed cursor -----------------------------------------------------


class WindowReader:
    """S-02: the windows of a table, a number at a time, from a cursor that survives restarts.

    The windows ``(keys..., shard, win, ...)`` are numbered once for each corpus and staged: each within its shard,
    which is bounded, where the windows lie, and a small table has the windows before each shard.  Every
    :meth:`take` hands out the next ``n`` windows of each corpus: it writes them, then the new cursor (corpus,
    next window).  A take that failed before its cursor was written is simply made again."""

    def __init__(self, windows: DataFrame, keys: Sequence[str], base: str):
        self.keys, self.base, self.spark = list(keys), base.rstrip("/"), windows.sparkSession
        self.tables = EpochQuery(self.spark, self.base, None)
        self.types = _types(windows, self.keys)
        if not self.tables._epochs(f"{self.base}/before", "epoch=*/_SUCCESS"):
            in_shard = F.row_number().over(Window.partitionBy(*self.keys, "shard").orderBy("win"))
            rows = self.tables.put("numbered", windows.withColumn("_nth", in_shard), 0)
            sizes = rows.groupBy(*self.keys, "shard").agg(F.count("*").alias("_n"))
            self.tables.put("before", prefix_sum(sizes, self.keys, ["shard"], "_n", "_before", exclusive=True).select(*self.keys, "shard", "_before"), 0)
        numbered, before = (self.spark.read.parquet(f"{self.base}/{name}/epoch=0") for name in ("numbered", "before"))
        self.windows = _with_state(numbered, before, [*self.keys, "shard"]).select(
            *windows.columns, (F.col("_before") + F.col("_nth") - 1).alias("nth"))

    def taken(self) -> int:
        """Takes whose cursor is written as a whole."""
        done = self.tables._epochs(f"{self.base}/cursor", "epoch=*/_SUCCESS")
        return done[-1] + 1 if done else 0

    def take(self, n: int) -> DataFrame:
        step = self.taken()
        cursor = self.tables.before("cursor", step, f"{self.types}, next long")
        at = F.coalesce("next", F.lit(0))
        got = _with_state(self.windows, cursor, self.keys).where((F.col("nth") >= at) & (F.col("nth") < at + n)).drop("next")
        got = self.tables.put("out", got, step)
        self.tables.put("cursor", _next(got, cursor, self.keys, F.lit(1)), step)
        return got


# --- S-03 batches ---------------------------------------------------------------------------------


def batch_query(spark: SparkSession, base: str, keys: Sequence[str], order: Sequence[str], item: str, size: int, types: str) -> EpochQuery:
    """S-03: batches of ``size`` items for each key as rows arrive; ``types`` are those of keys, order and item.

    State: each key's number of items and its open batch (fewer than ``size`` items).  The tail rule
    is applied by :func:`batches`, when the stream is over."""
    keys, cols = list(keys), [c.split(" ")[0].strip("`") for c in types.split(", ")]

    def step(query: EpochQuery, batch: DataFrame, epoch: int) -> None:
        before = query.before("counts", epoch, f"{query.key_types}, next long")
        numbered = _with_state(row_index(batch.select(*cols), keys, list(order), "nth"), before, keys)
        arrived = stage_table(numbered.select(*cols, (F.col("nth") + F.coalesce("next", F.lit(0))).alias("nth")), "arrived")
        now = query.put("counts", _next(arrived, before, keys, F.lit(1)), epoch)
        every = arrived.unionByName(query.before("open", epoch, f"{types}, nth long"))
        every = stage_table(_with_state(every, now, keys).withColumn("full", F.floor(F.col("nth") / size) < F.floor(F.col("next") / size)), "dealt")
        query.put("batches", _collected(every.where("full"), keys, item, size), epoch)
        query.put("open", every.where("not full").select(*cols, "nth"), epoch)

    query = EpochQuery(spark, base, step)
    kinds = dict(zip(cols, types.split(", ")))
    query.keys, query.item, query.size, query.types = keys, item, size, types
    query.key_types, query.item_type = ", ".join(kinds[k] for k in keys), kinds[item].split(" ", 1)[1]
    return query


def _collected(rows: DataFrame, keys: Sequence[str], item: str, size: int) -> DataFrame:
    return (rows.groupBy(*keys, F.floor(F.col("nth") / size).cast("long").alias("batch"))
            .agg(F.array_sort(F.collect_list(F.struct("nth", F.col(item).alias("_item")))).alias("_b"))
            .select(*keys, "batch", F.col("_b._item").alias("items")))


def batches(query: EpochQuery, drop_last: bool) -> DataFrame:
    """``(keys..., batch, items)``: all full batches and, unless ``drop_last``, each key's last, shorter one."""
    full = query.rows("batches", f"{query.key_types}, batch long, items array<{query.item_type}>")
    if drop_last:
        return full
    held = query.left("open", f"{query.types}, nth long")
    return full.unionByName(_collected(held, query.keys, query.item, query.size))


# --- S-05 metric log ----------------------------------------------------------------------------------

CALLS = "run_id long, metric string, y double, logged_at timestamp_ntz, event_id long, at_step long"
LOG = "run_id long, metric string, step long, y double, logged_at timestamp_ntz, event_id long"


def log_query(spark: SparkSession, base: str, delay: str, runs: DataFrame | None = None) -> EpochQuery:
    """S-05: log calls (``CALLS``; ``at_step`` null: implicit step) arriving out of order get their steps in the order
    of (logged_at, event_id), as :func:`weft.operators.runs.logged_steps` gives them.

    A call waits until the newest time seen is ``delay`` (an interval, as ``10 minutes``) past its own; then
    no earlier one is expected and it is logged.  One that comes later than that is not lost: it stands in the
    output ``late`` and takes no step.  State: the waiting calls, the newest time and each run's next step.
    ``runs``: known run ids; a call of any other run is an error."""
    def step(query: EpochQuery, batch: DataFrame, epoch: int) -> None:
        if runs is not None:
            known = runs.select(F.col("run_id").alias("_known")).distinct()
            odd = batch.join(known, F.col("run_id") == F.col("_known"), "left_anti").first()
            if odd is not None:
                raise ValueError(f"log call for run {odd['run_id']}, which does not exist")
        was = query.before("newest", epoch, "past timestamp_ntz, newest timestamp_ntz").first()  # one row, or none at first
        fresh = stage_table(batch.select(*[c.split(" ")[0] for c in CALLS.split(", ")]), "calls")
        late = F.coalesce(F.col("logged_at") < F.lit(was["past"] if was else None).cast("timestamp_ntz"), F.lit(False))
        query.put("late", fresh.where(late), epoch)
        newest = F.greatest(F.max("logged_at"), F.lit(was["newest"] if was else None).cast("timestamp_ntz"))
        now = query.put("newest", fresh.agg(newest.alias("newest")).select(
            (F.col("newest") - F.expr(f"INTERVAL {delay}")).alias("past"), "newest"), epoch).first()
        every = stage_table(fresh.where(~late).unionByName(query.before("waiting", epoch, CALLS)), "waiting")
        ready = F.coalesce(F.col("logged_at") < F.lit(now["past"]).cast("timestamp_ntz"), F.lit(False))
        query.put("waiting", every.where(~ready), epoch)
        _log(query, every.where(ready), epoch)

    return EpochQuery(spark, base, step)


def _log(query: EpochQuery, calls: DataFrame, epoch: int) -> None:
    before = query.before("steps", epoch, "run_id long, next long")
    done = logged_steps(calls, ["run_id"], ["logged_at", "event_id"], "at_step", before)
    done = query.put("log", done.select(*[c.split(" ")[0] for c in LOG.split(", ")], "_next"), epoch)
    now = done.groupBy("run_id").agg(F.max("_next").alias("next")).unionByName(before).groupBy("run_id").agg(F.max("next").alias("next"))
    query.put("steps", now, epoch)


def metric_log(query: EpochQuery, closed: bool = False) -> DataFrame:
    """The log so far; with ``closed`` (the stream is over) also the calls that still wait, in order."""
    done = query.rows("log", LOG)
    if not closed:
        return done
    waiting = query.left("waiting", CALLS)
    rest = logged_steps(waiting, ["run_id"], ["logged_at", "event_id"], "at_step", query.left("steps", "run_id long, next long"))
    return done.unionByName(rest.select(*[c.split(" ")[0] for c in LOG.split(", ")]))


# --- S-04 hold-out with a guard -------------------------------------------------------------------------


def heldout_query(spark: SparkSession, base: str, heldout: DataFrame, key: str, groups: Sequence[str], order: Sequence[str], types: str,
                  max_skips: int = 10) -> EpochQuery:
    """S-04: arriving rows without those whose ``key`` is held out; a run of ``max_skips`` held-out rows of one
    group, also across micro-batches, is an error.  ``types``: columns kept, groups and order among them.

    State: each group's number of held-out rows since its last kept row.  Output: ``kept``."""
    groups, cols = list(groups), [c.split(" ")[0].strip("`") for c in types.split(", ")]

    def step(query: EpochQuery, batch: DataFrame, epoch: int) -> None:
        held = heldout.select(F.col(key).alias("_held")).distinct()
        flags = batch.join(held, F.col(key) == F.col("_held"), "left").withColumn("out", F.col("_held").isNotNull())
        nth = stage_table(row_index(flags.select(*cols, "out"), groups, list(order), "nth"), "numbered")
        before = query.before("skips", epoch, f"{query.group_types}, next long")
        # rows before, at and after the kept ones: runs of held-out rows are gaps between kept positions
        kept = row_index(nth.where("not out").select(*groups, F.col("nth").alias("at")), groups, ["at"], "k")
        ends = nth.groupBy(*groups).agg(F.count("*").alias("n"))
        marks = kept.select(*groups, "k", "at")
        prev = kept.select(*groups, (F.col("k") + 1).alias("k"), F.col("at").alias("prev"))
        gaps = marks.join(prev, [*groups, "k"], "left").select(*groups, (F.col("at") - F.coalesce("prev", F.lit(-1)) - 1).alias("run"), (F.col("k") == 0).alias("first"))
        last = kept.groupBy(*groups).agg(F.max("at").alias("last"))
        tail = ends.join(last, groups, "left").select(*groups, (F.col("n") - 1 - F.coalesce("last", F.lit(-1))).alias("run"), F.col("last").isNull().alias("first"))
        runs = stage_table(_with_state(gaps.withColumn("open", F.lit(False)).unionByName(tail.withColumn("open", F.lit(True))), before, groups)
                           .withColumn("run", F.col("run") + F.when(F.col("first"), F.coalesce("next", F.lit(0))).otherwise(0)), "runs")
        bad = runs.where(F.col("run") >= max_skips).first()
        if bad is not None:
            raise ValueError(f"{bad['run']} rows in a row are held out ({', '.join(str(bad[g]) for g in groups)}): the task has too few different rows")
        query.put("kept", nth.where("not out").select(*cols), epoch)
        now = runs.where("open").select(*groups, F.col("run").cast("long").alias("next"))
        idle = before.join(now.select(*groups), groups, "left_anti")
        query.put("skips", now.unionByName(idle), epoch)

    query = EpochQuery(spark, base, step)
    kinds = dict(zip(cols, types.split(", ")))
    query.types, query.group_types = types, ", ".join(kinds[g] for g in groups)
    return query


def kept(query: EpochQuery) -> DataFrame:
    return query.rows("kept", query.types)
