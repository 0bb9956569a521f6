"""Streams over several micro-batches, with stops, restarts and failed epochs, against the batch operators."""
import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from weft.operators import corpus as C
from weft.operators.runs import known_runs, logged_steps
from weft.streaming import epochs as EP

PIECES = "corpus string, doc_id long, ids array<int>"


class Feed:
    """A folder to which parts arrive, and its stream."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.schema, self.path = spark, schema, f"{tmp_path}/in-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).repartition(2).write.mode("append").parquet(self.path)
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def failing(query, at):
    """The step of epoch ``at`` fails once after it has written everything."""
    step, failed = query.step, []

    def once(q, batch, epoch):
        step(q, batch, epoch)
        if epoch == at and not failed:
            failed.append(epoch)
            raise RuntimeError("lost")

    query.step = once
    return query


def rows_of(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def test_shards_over_five_parts_with_a_failure_and_restarts(spark, tmp_path):
    rng = random.Random(1)
    parts, n = [], 0
    for _ in range(5):
        part = []
        for _ in range(rng.randrange(1, 9)):
            part.append((rng.choice(["a", "a", "b", None]), n, [rng.randrange(250) for _ in range(rng.choice([0, 1, 7, 55]))]))
            n += 1
        parts.append(part)
    feed, base = Feed(spark, tmp_path, PIECES), f"{tmp_path}/q"
    make = lambda: EP.shard_query(spark, base, lambda b: b, ["corpus"], ["doc_id"], 20, "corpus string", eos=256)
    for i, part in enumerate(parts):
        stream = feed.add(part)
        if i == 2:
            with pytest.raises(Exception, match="lost"):
                failing(make(), i).run(stream)
        query = make().run(stream)  # a new object each time: a restart
        assert query.committed() == i + 1
    whole = C.flatten_tokens(spark.createDataFrame([r for p in parts for r in p], PIECES), ["corpus"], ["doc_id"], eos=256)
    want = C.assemble_shards(C.shard_pieces(whole.withColumn("n_tokens", F.col("n_tokens").cast("long")), 20), ["corpus"]).select("corpus", "shard", "tokens")
    assert rows_of(EP.shards(query, closed=True)) == rows_of(want)
    assert rows_of(EP.shards(query)) == rows_of(want.where(F.size("tokens") == 20))
    assert rows_of(EP.shards(make(), closed=True)) == rows_of(want)


def test_batches_keep_or_drop_the_tail(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, i * 10) for i in range(90)]
    feed, base = Feed(spark, tmp_path, "k long, at long, v long"), f"{tmp_path}/q"
    make = lambda: EP.batch_query(spark, base, ["k"], ["at"], "v", 4, "k long, at long, v long")
    with pytest.raises(Exception, match="lost"):
        failing(make(), 0).run(feed.add(rows[:25]))
    make().run(feed.add(rows[25:27]))
    query = make().run(feed.add(rows[27:]))
    want = {}
    for k, _, v in rows:
        want.setdefault(k, []).append(v)
    every = sorted(((k, i // 4, tuple(v[i:i + 4])) for k, v in want.items() for i in range(0, len(v), 4)), key=lambda r: (r[0] is None, r))
    assert rows_of(EP.batches(query, drop_last=False)) == every
    assert rows_of(EP.batches(query, drop_last=True)) == [r for r in every if len(r[2]) == 4]


def plain_log(calls, start=0):
    """The counter rule, call by call."""
    now, out = {}, []
    for run, metric, y, at, event, step in sorted(calls, key=lambda c: (c[3], c[4])):
        c = now.get(run, start)
        out.append((run, event, c if step is None else step))
        now[run] = c + 1 if step is None else max(c, step)
    return sorted(out)


def calls_of(n, seed, explicit):
    rng, day = random.Random(seed), dt.datetime(2024, 1, 1)
    return [(rng.choice([1, 1, 2]), "loss", 0.5, day + dt.timedelta(minutes=rng.randrange(n)), i,
             rng.randrange(40) if rng.random() < explicit else None) for i in range(n)]


def test_explicit_and_implicit_steps(spark):
    for explicit in (0, 0.3, 1):
        calls = calls_of(120, 5, explicit)
        got = logged_steps(spark.createDataFrame(calls, EP.CALLS), ["run_id"], ["logged_at", "event_id"], "at_step")
        assert sorted(map(tuple, got.select("run_id", "event_id", "step").collect())) == plain_log(calls)
    begun = spark.createDataFrame([(1, 7), (2, 7)], "run_id long, next long")
    got = logged_steps(spark.createDataFrame(calls, EP.CALLS), ["run_id"], ["logged_at", "event_id"], "at_step", begun)
    assert sorted(map(tuple, got.select("run_id", "event_id", "step").collect())) == plain_log(calls, 7)


def test_log_of_calls_out_of_order(spark, tmp_path):
    calls = calls_of(150, 3, 0.2)
    rng = random.Random(8)
    dealt = [[] for _ in range(5)]
    for c in calls:  # a call comes with its part or with the next one
        part = (c[3] - dt.datetime(2024, 1, 1)).seconds // 60 // 30
        dealt[min(4, part + rng.randrange(2))].append(c)
    feed, base = Feed(spark, tmp_path, EP.CALLS), f"{tmp_path}/q"
    for i, part in enumerate(dealt):
        stream = feed.add(part)
        if i == 3:
            with pytest.raises(Exception, match="lost"):
                failing(EP.log_query(spark, base, "70 minutes"), i).run(stream)
        query = EP.log_query(spark, base, "70 minutes").run(stream)
    got = EP.metric_log(query, closed=True).select("run_id", "event_id", "step")
    assert sorted(map(tuple, got.collect())) == plain_log(calls)
    early = EP.metric_log(query).count()
    assert 0 < early < 150 and query.rows("late", EP.CALLS).count() == 0
    # a call from long ago is kept aside and changes no step
    query = EP.log_query(spark, base, "70 minutes").run(feed.add([(1, "loss", 0.1, dt.datetime(2023, 1, 1), 999, None)]))
    assert [r.event_id for r in query.rows("late", EP.CALLS).collect()] == [999]
    assert sorted(map(tuple, EP.metric_log(query, closed=True).select("run_id", "event_id", "step").collect())) == plain_log(calls)


def test_calls_of_unknown_runs_are_errors(spark, tmp_path):
    calls, runs = calls_of(9, 1, 0), spark.createDataFrame([(1,)], "run_id long")
    table = spark.createDataFrame(calls, EP.CALLS)
    assert known_runs(table.where("run_id = 1"), runs).count() == sum(c[0] == 1 for c in calls)
    with pytest.raises(Exception, match="no such run: 2"):
        known_runs(table, runs).collect()
    with pytest.raises(Exception, match="run 2, which does not exist"):
        EP.log_query(spark, f"{tmp_path}/q", "1 hour", runs).run(Feed(spark, tmp_path, EP.CALLS).add(calls))


def test_windows_from_a_cursor(spark, tmp_path):
    windows = spark.createDataFrame([(c, s, w, [s, w]) for c, n in (("a", 5), ("b", 2), (None, 1)) for s in range(n) for w in range(3)],
                                    "corpus string, shard long, win long, tokens array<int>")
    base, got, takes = f"{tmp_path}/w", [], 0
    while True:
        reader = EP.WindowReader(windows, ["corpus"], base)  # restarted before every take
        assert reader.taken() == takes
        if takes == 1:  # written, but the cursor was not
            reader.tables.put("out", windows.limit(0).withColumn("nth", F.lit(0).cast("long")), 1)
        rows = [(r.corpus, r.shard, r.win) for r in reader.take(4).collect()]
        takes += 1
        if not rows:
            break
        got.append(rows)
    assert sorted(got[0], key=str) == sorted([("a", s, w) for s, w in ((0, 0), (0, 1), (0, 2), (1, 0))] + [("b", s, w) for s, w in ((0, 0), (0, 1), (0, 2), (1, 0))]
                                             + [(None, 0, w) for w in range(3)], key=str)
    assert sorted(sum(got, []), key=str) == sorted(((r.corpus, r.shard, r.win) for r in windows.collect()), key=str)


def test_heldout_guard_counts_across_micro_batches(spark, tmp_path):
    types = "g string, at long, key string"
    held = spark.createDataFrame([("x",), ("y",)], "key string")
    rows = lambda g, start, keys: [(g, start + i, k) for i, k in enumerate(keys)]
    feed, base = Feed(spark, tmp_path, types), f"{tmp_path}/q"
    make = lambda: EP.heldout_query(spark, base, held, "key", ["g"], ["at"], types, max_skips=5)
    make().run(feed.add(rows("a", 0, "nxxnxy") + rows("b", 0, "xxx") + rows("c", 0, "n")))
    query = make().run(feed.add(rows("a", 10, "xynx") + rows("c", 10, "xxxx")))
    assert rows_of(EP.kept(query)) == sorted([("a", 0, "n"), ("a", 3, "n"), ("a", 12, "n"), ("c", 0, "n")])
    assert rows_of(query.left("skips", "g string, next long")) == [("a", 1), ("b", 3), ("c", 4)]
    with pytest.raises(Exception, match="5 rows in a row"):
        make().run(feed.add(rows("b", 20, "yxn")))
    with pytest.raises(Exception, match="6 rows in a row"):
        EP.heldout_query(spark, f"{tmp_path}/other", held, "key", ["g"], ["at"], types, max_skips=6).run(
            Feed(spark, tmp_path, types).add(rows("d", 0, "nxxyyxxn")))


def test_shard_files_are_small_and_epochs_leave_no_staged_tables(spark, tmp_path, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    from weft.session import checkpoint_dir
    monkeypatch.setattr(EP, "IDS_PER_FILE", 60, raising=False)
    staged = lambda: set(glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/stage/*"))
    were, base = staged(), f"{tmp_path}/q"
    feed = Feed(spark, tmp_path, "corpus string, doc_id long, ids string")
    for k in range(2):
        query = EP.shard_query(spark, base, lambda b: b, ["corpus"], ["doc_id"], 20, "corpus string", eos=256, ids_type="string").run(
            feed.add([("a" if i % 3 else None, 100 * k + i, "é" * (i % 50)) for i in range(100)]))
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{base}/shards/*/*.parquet")]
    assert sum(f.num_rows for f in files) == EP.shards(query).count() > 100
    assert max(f.num_rows for f in files) <= 3  # a reader's batch holds the long values of a file
    assert query.spark.read.parquet(f"{base}/shards").schema["tokens"].dataType.simpleString() == "string"
    assert staged() == were
    lengths = [len(r["tokens"]) for r in EP.shards(query, closed=True).collect()]
    assert sum(lengths) == 2 * sum(i % 50 + 1 for i in range(100)) and sorted(lengths)[2:] == [20] * (len(lengths) - 2)


def test_parts_arrive_once_and_whole(spark, tmp_path):
    from weft.plans import stream_q
    df = spark.createDataFrame([(i if i else None, f"t{i}") for i in range(40)], "n long, t string")
    part = F.when(F.col("n") < 20, 0).when(F.col("n") < 30, 2).otherwise(4)  # parts 1 and 3 have no row
    seen, sizes = [], []
    for k, stream in enumerate(stream_q._arrivals(df, part, f"{tmp_path}/q")):
        q = (stream.writeStream.foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect())))
             .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
        q.awaitTermination()
        assert q.exception() is None
        sizes.append(len(seen))
    assert sizes == [19, 19, 29, 29, 40]
    assert sorted(seen, key=str) == sorted(map(tuple, df.collect()), key=str)
    none = df.limit(0)
    assert all(s.schema == df.schema for s in stream_q._arrivals(none, part, f"{tmp_path}/none"))
