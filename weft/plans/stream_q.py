"""Registered streaming queries (section F): each runs a Structured Streaming query over the
table folder with ``availableNow`` and returns the table it wrote.  Their batch
answers are the oracles (the same SQL as the batch operators)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import batching as B
from weft.operators import capture as CP
from weft.operators import corpus as C
from weft.plans import batching_q as BQ
from weft.plans import capture_q as CQ
from weft.plans import corpus_q as CORPUS
from weft.plans import runs_q as RQ
from weft.plans.catalog import REGISTRY, register
from weft.sources.tables import Tables
from weft.streaming import epochs as EP
from weft.streaming import stateful as ST


@register("s05_stream_log_metrics", "S-05", sql=REGISTRY["d19_log_metrics"].sql)
def s05_stream_log_metrics(spark, sf_dir):
    log = ST.run_to_table(ST.stream_log_metrics(ST.table_stream(spark, sf_dir, "events")), "log")
    return log.select("run_id", "metric", "step", F.round("y", 6).alias("y"))


@register("s06_stream_throughput", "S-06", sql=REGISTRY["d17_throughput"].sql)
def s06_stream_throughput(spark, sf_dir):
    t = ST.run_to_table(ST.stream_throughput(ST.table_stream(spark, sf_dir, "events"), RQ.TOKENS_PER_STEP), "tput")
    return t.select("run_id", "step", F.round("steps_per_sec", 6).alias("steps_per_sec"),
                    F.round("tokens_per_sec", 4).alias("tokens_per_sec"))


@register("s03_stream_batches", "S-03", sql=f"""WITH {RQ.LOG_SQL},
b AS (SELECT run_id, step // 16 AS batch, step, event_id, COUNT(*) OVER (PARTITION BY run_id, step // 16) AS n FROM lg)
SELECT run_id, CAST(batch AS BIGINT) AS batch, md5(array_to_string(list(event_id ORDER BY step), ',')) AS items_md5
FROM b WHERE n = 16 GROUP BY run_id, batch""")
def s03_stream_batches(spark, sf_dir):
    """Batches of 16 log events per run; a run's unfinished tail waits in state."""
    ev = ST.table_stream(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id")
    b = ST.run_to_table(ST.stream_batches(ev, "run_id", ["ts", "event_id"], "event_id", 16), "batches")
    return b.select("run_id", "batch", BQ.ids_md5(F.col("items")).alias("items_md5"))


@register("s04_stream_exclude_heldout", "S-04", sql=REGISTRY["b19_exclude_heldout"].sql)
def s04_stream_exclude_heldout(spark, sf_dir):
    """Stream-static anti join of arriving paragraphs against the held-out keys."""
    docs = ST.table_stream(spark, sf_dir, "documents").select("doc_id", "text")
    held = BQ._para_keys(Tables(spark, sf_dir).benchmark.select("item_id", "text"), "item_id", "chars")
    kept = B.exclude_heldout(BQ._para_keys(docs, "doc_id", "chars"), held).select("doc_id", "para_idx")
    return ST.run_to_table(kept, "heldout")


@register("s08_stream_op_chain", "S-08", sql=CQ.CHAIN_SQL)
def s08_stream_op_chain(spark, sf_dir):
    """``@view + @click ~ @purchase`` as ops arrive (equals e18_op_chain on the same log)."""
    m, _ = CQ.tree(spark, sf_dir, with_closure=False)
    paths = m.filter(F.col("key").isNotNull()).select(F.col("path").alias("module_path"), F.col("key").alias("user_id"))
    ev = ST.table_stream(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("op"))
    ops = ev.join(F.broadcast(paths), "user_id")  # stream-static join; the tree is one row per customer
    return ST.run_to_table(ST.stream_op_chain(ops, ["view", "click", "purchase"], [CP.NEXT, CP.SUBSEQUENT]), "chain")


@register("s01_stream_token_offsets", "S-01 S-02", sql=f"""WITH {__import__('weft.plans.sqlfrag', fromlist=['x']).pieces_cte()},
{__import__('weft.plans.sqlfrag', fromlist=['x']).stream_cte()}
SELECT source, CAST(COUNT(*) AS BIGINT) AS n_pieces, CAST(SUM(n_tokens) AS BIGINT) AS n_tokens, CAST(SUM(start) AS BIGINT) AS start_sum
FROM stream GROUP BY source""")
def s01_stream_token_offsets(spark, sf_dir):
    """Documents arrive as a stream; paragraphs and chunks are char-encoded (+eos) and every piece
    gets its corpus offset from per-corpus state.  Run twice on one checkpoint: the second run
    finds no new input, so the table has neither gaps nor duplicates (S-02)."""
    import os
    import uuid
    from weft.functions import text as T
    from weft.operators import corpus as C
    from weft.session import checkpoint_dir

    def build():
        d = C.drop_blank(ST.table_stream(spark, sf_dir, "documents").select("doc_id", "source", "text"))
        p = C.paragraph_pieces(d).withColumn("ids", F.concat(T.char_ids(F.col("piece")), F.array(F.lit(T.CHAR_EOS))))
        return ST.stream_token_offsets(p.drop("piece"), "source", ["doc_id", "para_idx", "chunk_idx"])
    base = os.path.join(checkpoint_dir(spark), f"stream-offsets-{uuid.uuid4().hex[:8]}")
    ST.run_to_table(build(), "offsets", checkpoint=base)
    out = ST.run_to_table(build(), "offsets", checkpoint=base)  # restart: resumes, adds nothing
    return out.groupBy("source").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"),
                                     F.sum("start").alias("start_sum"))


@register("s07_incremental_decode", "S-07", sql="""
WITH t AS (SELECT conv_id, regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') AS x FROM conversations),
p AS (SELECT conv_id, length(x) AS n, length(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')) AS words,
             CASE WHEN regexp_matches(x, '[^\\p{L}\\p{N}]$') THEN 1 ELSE 0 END AS tail FROM t)
SELECT conv_id, CAST(SUM(n) AS BIGINT) AS n_emitted, CAST(SUM(words + tail) AS BIGINT) AS n_pieces FROM p GROUP BY conv_id HAVING SUM(n) > 0""")
def s07_incremental_decode(spark, sf_dir):
    """Conversation text arrives as a stream of char tokens in order of (turn, offset), every turn closed
    by an end token; text is given out whenever it ends with a letter or digit, the rest at the end."""
    from weft.functions import text as T
    conv = ST.table_stream(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    ids = F.concat(T.char_ids(F.col("text")), F.array(F.lit(T.CHAR_EOS)))
    toks = conv.select("conv_id", "turn", F.posexplode(ids).alias("k", "tok"))
    out = ST.run_to_table(ST.stream_incremental_decode(toks, "conv_id", ["turn", "k"], "tok",
                                                       lambda ids: "".join(map(chr, ids)), T.CHAR_EOS), "decode")
    return out.groupBy("conv_id").agg(F.sum(F.length("text")).cast("long").alias("n_emitted"), F.count("*").alias("n_pieces"))


# --- the same over parts that arrive one after another; every part is taken in by a restarted query ---

PARTS = 5


def _base(spark, name):
    import uuid
    from weft.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/epochs-{name}-{uuid.uuid4().hex[:8]}"


def _arrivals(df, part, base):
    """The table's rows in ``PARTS`` parts (column expression 0..PARTS-1): yields the stream of the parts so far after each has arrived.

    The rows are written once, each part to a folder of its own."""
    spark, path = df.sparkSession, f"{base}/in"
    df.withColumn("_part", part).write.partitionBy("_part").parquet(path)
    for k in range(PARTS):
        yield spark.readStream.schema(df.schema).parquet(f"{path}/_part={{{','.join(map(str, range(k + 1)))}}}")


def _ranges(df, col):
    """Part of a numeric column expression: by its approximate quantiles."""
    cuts = df.select(col.cast("double").alias("x")).approxQuantile("x", [k / PARTS for k in range(1, PARTS)], 0.01)
    return sum((F.when(col.cast("double") > c, 1).otherwise(0) for c in cuts), F.lit(0))


@register("s01_stream_shards", "S-01", sql=CORPUS.WIN_SQL + """
SELECT source, CAST(shard AS BIGINT) AS shard, CAST(COUNT(*) AS BIGINT) AS n_tokens, md5(array_to_string(list(tok ORDER BY off), ',')) AS tokens_md5
FROM sh GROUP BY source, shard""")
def s01_stream_shards(spark, sf_dir):
    """Documents arrive in five parts; every part adds to the token shards of its corpora, and the
    query is restarted between parts.  The open shards are closed at the end."""
    base, d = _base(spark, "shards"), CORPUS.docs(spark, sf_dir)

    def pieces(batch):
        p = C.paragraph_pieces(C.drop_blank(batch))
        return p.withColumn("ids", T.char_text(F.col("piece"))).drop("piece")

    for stream in _arrivals(d, _ranges(d, F.col("doc_id")), base):
        query = EP.shard_query(spark, base, pieces, CORPUS.KEYS, CORPUS.ORDER, CORPUS.SHARD, "source string", eos=T.CHAR_EOS,
                               ids_type="string").run(stream)
    sh = EP.shards(query, closed=True)
    return sh.select("source", "shard", F.size("tokens").cast("long").alias("n_tokens"), BQ.ids_md5(F.col("tokens")).alias("tokens_md5"))


@register("s02_resumable_windows", "S-02", sql=REGISTRY["a36_context_windows"].sql)
def s02_resumable_windows(spark, sf_dir):
    """Context windows handed out a third of the longest corpus at a time, each time by a new reader that goes on
    from the committed cursor."""
    w = C.context_windows(C.shard_pieces(CORPUS.char_stream(spark, sf_dir), CORPUS.SHARD), CORPUS.KEYS, CORPUS.CONTEXT, arrays=False)
    base = _base(spark, "windows")
    reader = EP.WindowReader(w.select("source", "shard", "win", "tokens"), CORPUS.KEYS, base)
    n = reader.windows.agg(F.max("nth")).first()[0]
    out = []
    while n is not None:
        got = EP.WindowReader(w.select("source", "shard", "win", "tokens"), CORPUS.KEYS, base).take(n // 3 + 1)
        if got.isEmpty():
            break
        out.append(got)
    got = C.id_arrays(reduce(lambda a, b: a.unionByName(b), out or [reader.windows]), "tokens")
    return got.select("source", "shard", "win", BQ.ids_md5(F.col("tokens")).alias("tokens_md5"))


@register("s03_stream_batches_with_tail", "S-03", sql=f"""WITH {RQ.LOG_SQL}
SELECT run_id, CAST(step // 16 AS BIGINT) AS batch, CAST(COUNT(*) AS INTEGER) AS n_items, md5(array_to_string(list(event_id ORDER BY step), ',')) AS items_md5
FROM lg GROUP BY run_id, step // 16""")
def s03_stream_batches_with_tail(spark, sf_dir):
    """Batches of 16 log events of each run, which arrive in five parts in order of time; the tails are kept."""
    base = _base(spark, "batches")
    ev = Tables(spark, sf_dir).events.select(F.col("user_id").alias("run_id"), "ts", "event_id")
    types = f"run_id long, ts {ev.schema['ts'].dataType.simpleString()}, event_id long"
    for stream in _arrivals(ev, _ranges(ev, F.unix_micros(F.col("ts").cast("timestamp"))), base):
        query = EP.batch_query(spark, base, ["run_id"], ["ts", "event_id"], "event_id", 16, types).run(stream)
    b = EP.batches(query, drop_last=False)
    return b.select("run_id", "batch", F.size("items").alias("n_items"), BQ.ids_md5(F.col("items")).alias("items_md5"))


#: Held-out paragraphs in a row that are an error in the query below.
MAX_SKIPS = 1000


@register("s04_stream_heldout_guard", "S-04", sql=f"""WITH {BQ.HELDOUT_SQL}
SELECT source, doc_id, CAST(para_idx AS INTEGER) AS para_idx FROM fl WHERE NOT excluded""")
def s04_stream_heldout_guard(spark, sf_dir):
    """Paragraphs that arrive in five parts, without those held out, under a guard that counts each source's
    held-out paragraphs in a row across parts."""
    base, t = _base(spark, "guard"), Tables(spark, sf_dir)
    held = BQ._para_keys(t.benchmark.select("item_id", "text"), "item_id", "chars")
    paras = BQ._para_keys(t.documents.select("doc_id", "source", "text"), "doc_id", "chars").select("source", "doc_id", "para_idx", "key")
    for stream in _arrivals(paras, _ranges(t.documents, F.col("doc_id")), base):
        query = EP.heldout_query(spark, base, held, "key", ["source"], ["doc_id", "para_idx"], "source string, doc_id long, para_idx int, key binary",
                                 MAX_SKIPS).run(stream)
    return EP.kept(query).select("source", "doc_id", "para_idx")


@register("s05_stream_log_out_of_order", "S-05", sql=REGISTRY["d19_log_metrics"].sql)
def s05_stream_log_out_of_order(spark, sf_dir):
    """Log calls in five parts by time, of which a part's calls may come with the next one; they get the steps of
    their order in time."""
    base, ev = _base(spark, "log"), Tables(spark, sf_dir).events
    calls = ev.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric"), F.col("value").alias("y"),
                      F.col("ts").cast("timestamp_ntz").alias("logged_at"), "event_id", F.lit(None).cast("long").alias("at_step"))
    at = F.unix_micros(F.col("logged_at").cast("timestamp"))
    first, last = calls.agg(F.min(at), F.max(at)).first()
    span = max(1, (last or 0) - (first or 0))
    part = F.least(F.lit(PARTS - 1), F.floor((at - F.lit(first)) * PARTS / F.lit(span + 1)) + F.pmod(F.xxhash64("event_id"), F.lit(2)))
    for stream in _arrivals(calls, part, base):
        query = EP.log_query(spark, base, f"{2 * span // PARTS + 1_000_000} microseconds").run(stream)
    return EP.metric_log(query, closed=True).select("run_id", "metric", "step", F.round("y", 6).alias("y"))


@register("d19_explicit_steps", "D-19", sql="""
WITH c AS (SELECT user_id AS run_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN event_id % 300 END AS at_step FROM events),
i AS (SELECT *, SUM(CASE WHEN at_step IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             - CASE WHEN at_step IS NULL THEN 1 ELSE 0 END AS n FROM c),
m AS (SELECT *, MAX(at_step - n) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM i)
SELECT run_id, event_id, CAST(COALESCE(at_step, n + greatest(0, COALESCE(top, 0))) AS BIGINT) AS step FROM m""")
def d19_explicit_steps(spark, sf_dir):
    """Log calls of which the purchases name their step: the run's own step follows, and every run is a known one."""
    from weft.operators.runs import known_runs, logged_steps
    t = Tables(spark, sf_dir)
    calls = t.events.select(F.col("user_id").alias("run_id"), "event_id", "ts",
                            F.when(F.col("event_type") == "purchase", F.col("event_id") % 300).alias("at_step"))
    calls = known_runs(calls, t.events.select(F.col("user_id").alias("run_id")).distinct())
    return logged_steps(calls, ["run_id"], ["ts", "event_id"], "at_step").select("run_id", "event_id", "step")
