"""Registered sampler / batching / collation / hold-out queries (section B).

Items: ``orders`` (ordered by o_orderdate, o_orderkey).  Sequences: per order,
prompt = first two line quantities, target = the rest, mask = line not
returned ('R'); vocabulary 1..50 with bos 51, eos 52, mask 53.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions.hashing import hash32_sql, uniform_sql
from weft.operators import batching as B
from weft.operators import corpus as C
from weft.plans import sqlfrag as Q
from weft.plans.catalog import register
from weft.sources.tables import Tables

BOS, EOS, MASK = 51, 52, 53
SEED = 99


def ids_md5(c):
    return F.md5(F.array_join(c.cast("array<string>"), ","))


def md5_sql(x):
    return f"md5(array_to_string({x}, ','))"


def indexed_orders(spark, sf_dir):
    """Orders with their position in (o_orderdate, o_orderkey) order, staged once in the
    checkpoint folder: samplers and batchers read the index several times."""
    from weft.session import checkpoint_dir
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    checkpoint_dir(spark)
    return B.sequential_index(o, ["o_orderdate", "o_orderkey"], "idx").checkpoint(eager=True)


IDX_SQL = """io AS (SELECT o_orderkey, o_totalprice, o_orderstatus,
                   CAST(ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS idx FROM orders)"""


@register("b01_sequential_index", "B-01", sql=f"WITH {IDX_SQL} SELECT o_orderkey, idx FROM io")
def b01_sequential_index(spark, sf_dir):
    return indexed_orders(spark, sf_dir).select("o_orderkey", "idx")


@register("b02_random_sample", "B-02", sql=f"""WITH {IDX_SQL},
n AS (SELECT COUNT(*) AS n FROM io),
x AS (SELECT o_orderkey, idx, epoch, {uniform_sql(SEED, 'epoch', 'idx')} AS h FROM io, (SELECT unnest(range(2)) AS epoch) t),
p AS (SELECT o_orderkey, CAST(ROW_NUMBER() OVER (ORDER BY epoch, h, idx) - 1 AS BIGINT) AS pos FROM x)
SELECT pos, o_orderkey FROM p WHERE pos < (SELECT n * 3 // 2 FROM n)""")
def b02_random_sample(spark, sf_dir):
    """1.5 epochs without replacement: one full permutation, then half of a second one."""
    io = indexed_orders(spark, sf_dir)
    n = io.count() * 3 // 2
    return B.random_sample(io, n, SEED, "idx").select("pos", "o_orderkey")


@register("b03_sample_replacement", "B-03", sql=f"""WITH {IDX_SQL},
n AS (SELECT COUNT(*) AS n FROM io),
d AS (SELECT pos, CAST(floor({uniform_sql(SEED, 'pos')} * (SELECT n FROM n)) AS BIGINT) AS idx FROM (SELECT unnest(range((SELECT n FROM n))) AS pos))
SELECT CAST(pos AS BIGINT) AS pos, o_orderkey FROM d JOIN io USING (idx)""")
def b03_sample_replacement(spark, sf_dir):
    io = indexed_orders(spark, sf_dir)
    return B.random_sample(io, io.count(), SEED, "idx", replacement=True).select("pos", "o_orderkey")


@register("b04_batches", "B-04 B-05 B-06 B-08", sql=f"""WITH {IDX_SQL},
b AS (SELECT idx // 32 AS batch, idx, o_orderkey, o_totalprice, o_orderstatus FROM io),
n AS (SELECT COUNT(*) AS n FROM io)
SELECT CAST(batch AS BIGINT) AS batch, CAST(COUNT(*) AS BIGINT) AS n_rows, md5(array_to_string(list(o_orderkey ORDER BY idx), ',')) AS keys_md5,
       array_to_string(list(o_orderstatus ORDER BY idx), '') AS statuses,
       batch < (SELECT n // 32 FROM n) AS kept_if_drop_last,
       (SELECT CAST(n // 32 AS BIGINT) FROM n) AS len_drop_last, (SELECT CAST((n + 31) // 32 AS BIGINT) FROM n) AS len_keep_last
FROM b GROUP BY batch""")
def b04_batches(spark, sf_dir):
    io = indexed_orders(spark, sf_dir)
    b = B.batch_ids(io, "idx", 32)
    kept = B.batch_ids(io, "idx", 32, drop_last=True).select("batch").distinct().withColumn("kept_if_drop_last", F.lit(True))
    cols = B.collate_columns(b, "batch", "idx", ["o_orderkey", "o_orderstatus"])
    sizes = b.groupBy("batch").agg(F.count("*").alias("n_rows"))
    return (cols.join(sizes, "batch").join(kept, "batch", "left")
            .select("batch", "n_rows", ids_md5(F.col("columns.o_orderkey")).alias("keys_md5"),
                    F.array_join("columns.o_orderstatus", "").alias("statuses"),
                    F.coalesce("kept_if_drop_last", F.lit(False)).alias("kept_if_drop_last"),
                    B.loader_length(io, 32, True).alias("len_drop_last"), B.loader_length(io, 32, False).alias("len_keep_last")))


def sequences(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    s = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), (F.col("l_returnflag") != "R").alias("m")))).alias("_l"))
    rest = F.greatest(F.size("_l") - 2, F.lit(0))
    return s.select("l_orderkey", F.slice("_l.q", 1, 2).alias("prompt"),
                    F.slice("_l.q", 3, rest).alias("target"), F.slice("_l.m", 3, rest).alias("mask"))


SEQ_SQL = """s AS (SELECT l_orderkey, list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber, l_partkey, l_suppkey) AS q,
                  list(l_returnflag <> 'R' ORDER BY l_linenumber, l_partkey, l_suppkey) AS m FROM lineitem GROUP BY l_orderkey),
sq AS (SELECT l_orderkey, q[1:2] AS prompt, q[3:] AS target, m[3:] AS mask FROM s)"""


@register("b09_collate_stack", "B-09 B-10", sql=f"""WITH {SEQ_SQL}, {IDX_SQL},
b AS (SELECT io.idx // 8 AS batch, io.idx, len(sq.target) AS n FROM io JOIN sq ON io.o_orderkey = sq.l_orderkey)
SELECT CAST(batch AS BIGINT) AS batch, CASE WHEN MIN(n) = MAX(n) THEN 'ok' ELSE 'ragged' END AS status,
       CAST(SUM(n) AS BIGINT) AS n_tokens FROM b GROUP BY batch""")
def b09_collate_stack(spark, sf_dir):
    io = B.batch_ids(indexed_orders(spark, sf_dir), "idx", 8)
    x = io.join(sequences(spark, sf_dir), io.o_orderkey == F.col("l_orderkey"))
    st = B.collate_stack(x, "batch", "idx", "target")
    tot = B.collate_custom(x.select("batch", F.size("target").cast("long").alias("n_tokens")), "batch",
                           {"bigint": F.sum})
    return st.join(tot, "batch").select("batch", "status", "n_tokens")


@register("b12_mask_tokens", "B-12", sql=f"""WITH {SEQ_SQL}
SELECT l_orderkey,
  {md5_sql(f"list_transform(target, lambda v, i: CASE WHEN {uniform_sql(SEED, 'l_orderkey', 'i - 1')} < 0.3 THEN {MASK} ELSE v END)")} AS input_md5,
  {md5_sql(f"list_transform(target, lambda v, i: CASE WHEN {uniform_sql(SEED, 'l_orderkey', 'i - 1')} < 0.3 THEN v ELSE -100 END)")} AS labels_md5
FROM sq""")
def b12_mask_tokens(spark, sf_dir):
    s = sequences(spark, sf_dir)
    inp, lab, _ = B.mask_tokens(F.col("target"), 0.3, MASK, SEED, F.col("l_orderkey"))
    return s.select("l_orderkey", ids_md5(inp).alias("input_md5"), ids_md5(lab).alias("labels_md5"))


@register("b13_collate_autoregressive", "B-13 B-16", sql=f"""WITH {SEQ_SQL},
f AS (SELECT l_orderkey, prompt, target, mask, list_concat([{BOS}], prompt, target, [{EOS}]) AS fs FROM sq),
a AS (SELECT l_orderkey, prompt, target, mask, fs[1:len(fs) - 1] AS inp,
        list_transform(fs[2:], lambda v, i: CASE WHEN i - 1 < len(prompt) THEN -100
             WHEN i - 1 - len(prompt) < len(mask) AND NOT mask[i - len(prompt)] THEN -100 ELSE v END) AS lab FROM f)
SELECT l_orderkey, {md5_sql('inp')} AS input_md5, {md5_sql('lab')} AS labels_md5,
  {md5_sql(f"list_concat(list_transform(target, lambda v, i: CASE WHEN NOT mask[i] THEN {MASK} ELSE v END), [{EOS}])")} AS visible_md5
FROM a""")
def b13_collate_autoregressive(spark, sf_dir):
    s = sequences(spark, sf_dir)
    inp, lab, _ = B.collate_autoregressive("prompt", "target", "mask", bos=BOS, eos=EOS, ignore_prompt=True)
    vis = B.visible_target("target", "mask", MASK, eos=EOS)
    return s.select("l_orderkey", ids_md5(inp).alias("input_md5"), ids_md5(lab).alias("labels_md5"), ids_md5(vis).alias("visible_md5"))


@register("b14_collate_bidirectional", "B-14", sql=f"""WITH {SEQ_SQL},
f AS (SELECT l_orderkey, list_concat(prompt, target) AS fs, len(prompt) AS pl, mask FROM sq),
k AS (SELECT l_orderkey, fs, list_transform(fs, lambda v, i: {{'u': {uniform_sql(SEED, 'l_orderkey', 'i - 1')}, 'i': i - 1,
        'e': i - 1 >= pl AND COALESCE(mask[i - pl], true)}}) AS keyed FROM f),
g AS (SELECT *, list_min(list_transform(list_filter(keyed, lambda s: s.e), lambda s: {{'u': s.u, 'i': s.i}})) AS forced FROM k),
p AS (SELECT l_orderkey, fs, forced, list_transform(keyed, lambda s: s.e AND (s.u < 0.15 OR s.i = forced.i)) AS picked FROM g)
SELECT l_orderkey, CASE WHEN forced IS NULL THEN NULL ELSE {md5_sql(f"list_transform(fs, lambda v, i: CASE WHEN picked[i] THEN {MASK} ELSE v END)")} END AS input_md5,
       CASE WHEN forced IS NULL THEN NULL ELSE {md5_sql("list_transform(fs, lambda v, i: CASE WHEN picked[i] THEN v ELSE -100 END)")} END AS labels_md5
FROM p""")
def b14_collate_bidirectional(spark, sf_dir):
    s = sequences(spark, sf_dir)
    inp, lab = B.collate_bidirectional("prompt", "target", "mask", MASK, SEED, F.col("l_orderkey"), ratio=0.15)
    return s.select("l_orderkey", F.when(inp.isNotNull(), ids_md5(inp)).alias("input_md5"),
                    F.when(lab.isNotNull(), ids_md5(lab)).alias("labels_md5"))


@register("b15_collate_encoder_decoder", "B-15", sql=f"""WITH {SEQ_SQL}
SELECT l_orderkey, {md5_sql('prompt')} AS encoder_md5, {md5_sql(f'list_concat([{BOS}], target)')} AS decoder_input_md5,
       {md5_sql(f"list_concat(list_transform(target, lambda v, i: CASE WHEN NOT mask[i] THEN -100 ELSE v END), [{EOS}])")} AS decoder_labels_md5
FROM sq""")
def b15_collate_encoder_decoder(spark, sf_dir):
    s = sequences(spark, sf_dir)
    enc, dec_in, dec_lab = B.collate_encoder_decoder("prompt", "target", "mask", bos=BOS, eos=EOS)
    return s.select("l_orderkey", ids_md5(enc).alias("encoder_md5"), ids_md5(dec_in).alias("decoder_input_md5"),
                    ids_md5(dec_lab).alias("decoder_labels_md5"))


@register("b17_right_pad", "B-17", sql=f"""WITH {SEQ_SQL}, {IDX_SQL},
b AS (SELECT io.idx // 16 AS batch, sq.l_orderkey, sq.target FROM io JOIN sq ON io.o_orderkey = sq.l_orderkey),
m AS (SELECT *, MAX(len(target)) OVER (PARTITION BY batch) AS mx FROM b)
SELECT l_orderkey, {md5_sql("list_concat(target, list_transform(range(mx - len(target)), lambda k: COALESCE(target[-1], 0)))")} AS padded_md5,
       CAST(len(target) AS INTEGER) AS n_attended FROM m""")
def b17_right_pad(spark, sf_dir):
    io = B.batch_ids(indexed_orders(spark, sf_dir), "idx", 16)
    x = io.join(sequences(spark, sf_dir), io.o_orderkey == F.col("l_orderkey")).select("batch", "l_orderkey", "target")
    p = B.right_pad(x, "batch", "target")
    return p.select("l_orderkey", ids_md5(F.col("padded")).alias("padded_md5"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v).alias("n_attended"))


# --- hold-out exclusion over documents / benchmark ------------------------------------

def _para_keys(df, id_col, name):
    keep = [c for c in df.columns if c != "text"]
    p = df.select(*keep, F.posexplode(T.split_paragraphs(F.col("text"))).alias("para_idx", "para"))
    return p.withColumn("key", B.char_sequence_key(F.lit(name), "para")).drop("para")


HELDOUT_SQL = f"""tr AS (SELECT doc_id, source, unnest(l) AS para, unnest(range(len(l))) AS para_idx
        FROM (SELECT doc_id, source, {Q.split_paragraphs('text')} AS l FROM documents)),
ho AS (SELECT unnest({Q.split_paragraphs('text')}) AS para FROM benchmark),
trk AS (SELECT doc_id, source, para_idx, 'chars|0|' || length(para) || '||' || array_to_string({Q.char_ids('para')}, ',') AS key FROM tr),
hok AS (SELECT DISTINCT 'chars|0|' || length(para) || '||' || array_to_string({Q.char_ids('para')}, ',') AS key FROM ho),
fl AS (SELECT trk.*, key IN (SELECT key FROM hok) AS excluded FROM trk)"""


@register("b19_exclude_heldout", "B-18 B-19", sql=f"""WITH {HELDOUT_SQL}
SELECT doc_id, CAST(para_idx AS INTEGER) AS para_idx FROM fl WHERE NOT excluded""")
def b19_exclude_heldout(spark, sf_dir):
    t = Tables(spark, sf_dir)
    train = _para_keys(t.documents.select("doc_id", "text"), "doc_id", "chars")
    held = _para_keys(t.benchmark.select("item_id", "text"), "item_id", "chars")
    return B.exclude_heldout(train, held).select("doc_id", "para_idx")


@register("b20_low_diversity_guard", "B-20", sql=f"""WITH {HELDOUT_SQL},
i AS (SELECT *, SUM(CASE WHEN excluded THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY doc_id, para_idx) AS island FROM fl),
r AS (SELECT source, island, COUNT(*) AS run FROM i WHERE excluded GROUP BY source, island),
s AS (SELECT DISTINCT source FROM fl)
SELECT s.source, CAST(COALESCE(MAX(run), 0) AS BIGINT) AS max_consecutive_excluded, COALESCE(MAX(run), 0) >= 10 AS too_many_skips
FROM s LEFT JOIN r USING (source) GROUP BY s.source""")
def b20_low_diversity_guard(spark, sf_dir):
    t = Tables(spark, sf_dir)
    train = _para_keys(t.documents.select("doc_id", "source", "text"), "doc_id", "chars")
    held = _para_keys(t.benchmark.select("item_id", "text"), "item_id", "chars").select("key").distinct()
    flags = train.join(held.withColumn("excluded", F.lit(True)), "key", "left").fillna({"excluded": False})
    return B.low_diversity_guard(flags, ["source"], ["doc_id", "para_idx"])


def _seed_mix_sql(x: str) -> str:
    from weft.functions.hashing import _let_sql, _xs_sql, imul32_sql
    x = _let_sql(x, lambda v: imul32_sql(_xs_sql(v, 16), B.SEED_MIX_C1))
    x = _let_sql(x, lambda v: imul32_sql(_xs_sql(v, 15), B.SEED_MIX_C2))
    return _let_sql(x, lambda v: _xs_sql(v, 16))


def _sample_seed_sql(base: int, dataset: str, idx: str, scope: str = "sample") -> str:
    const = (base & 0xFFFFFFFF) ^ B._seed_mix_int(B.fnv1a32(dataset)) ^ B._seed_mix_int(B.fnv1a32(scope))
    m = _seed_mix_sql(f"xor(CAST({const} AS BIGINT), {_seed_mix_sql(f'(CAST({idx} AS BIGINT) & 4294967295)')})")
    return f"(CASE WHEN {m} = 0 THEN 1 ELSE {m} END)"


def _parse_seed_sql(x: str) -> str:
    h = (f"list_reduce(list_transform(string_split({x}, ''), lambda c: CAST(unicode(c) AS BIGINT)), "
         f"lambda a, c: (a * 31 + c) & 4294967295, CAST(0 AS BIGINT))")
    lead = f"regexp_extract({x}, '^\\s*([+-]?\\d+)', 1)"
    return (f"CASE WHEN length({lead}) > 0 THEN CAST({lead} AS BIGINT) "
            f"ELSE abs(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END) END")


@register("b21_sample_seeds", "B-21 B-22", sql=f"""
SELECT doc_id, CAST({_sample_seed_sql(42, 'documents', 'doc_id')} AS BIGINT) AS sample_seed,
       CAST({_parse_seed_sql('source')} AS BIGINT) AS source_seed, CAST({_parse_seed_sql('CAST(n_chars AS VARCHAR)')} AS BIGINT) AS nchars_seed
FROM documents""")
def b21_sample_seeds(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", B.sample_seed(42, "documents", F.col("doc_id")).alias("sample_seed"),
                    B.parse_seed(F.col("source")).alias("source_seed"),
                    B.parse_seed(F.col("n_chars").cast("string")).alias("nchars_seed"))


@register("b08_collate_nested", "B-08", sql="""
WITH l AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders),
b AS (SELECT idx // 32 AS batch, list(o_orderkey ORDER BY idx) AS k, list(o_orderstatus ORDER BY idx) AS s,
             list(round(o_totalprice, 2) ORDER BY idx) AS p, list(o_custkey ORDER BY idx) AS c FROM l GROUP BY idx // 32)
SELECT CAST(batch AS BIGINT) AS batch, md5(array_to_string(k, ',')) AS keys_md5, md5(array_to_string(s, ',')) AS status_md5,
       CAST(len(p) AS INTEGER) AS n, round(list_sum(p), 2) AS price_sum, md5(array_to_string(c, ',') || '|' || array_to_string(k, ',')) AS pair_md5 FROM b""")
def b08_collate_nested(spark, sf_dir):
    """Orders as nested objects with a pair (customer, order), collated 32 at a time."""
    o = Tables(spark, sf_dir).orders
    rows = o.select("o_orderkey", F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 2).alias("price"))
                                           .alias("state")).alias("obj"), F.array("o_custkey", "o_orderkey").alias("pair"))
    b = B.row_index(rows, [], ["o_orderkey"], "idx").withColumn("batch", F.floor(F.col("idx") / 32).cast("long"))
    c = B.collate_nested(b, "batch", "idx", ["obj", "pair"])
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    pair = F.col("columns.pair")
    return c.select("batch", ids_md5(F.col("columns.obj.id")).alias("keys_md5"), F.md5(text(F.col("columns.obj.state.status"))).alias("status_md5"),
                    F.size("columns.obj.state.price").alias("n"),
                    F.round(F.aggregate("columns.obj.state.price", F.lit(0.0), lambda a, x: a + x), 2).alias("price_sum"),
                    F.md5(F.concat(text(F.get(pair, F.lit(0))), F.lit("|"), text(F.get(pair, F.lit(1))))).alias("pair_md5"))


def _fork_sql(parent, nth):
    return f"(CAST(floor({uniform_sql(B.FORK, parent, nth)} * 4294967296.0) AS BIGINT) - 2147483648)"


@register("b22_fork_seeds", "B-22", sql=f"""
WITH s AS (SELECT doc_id, CAST({_parse_seed_sql('source')} AS BIGINT) AS p FROM documents),
c AS (SELECT *, {_fork_sql('p', '0')} AS c0, {_fork_sql('p', '1')} AS c1, {_fork_sql('p', 'doc_id')} AS own FROM s)
SELECT doc_id, c0 AS child_0, c1 AS child_1, own AS child_of_doc, {_fork_sql('own', '0')} AS grandchild FROM c""")
def b22_fork_seeds(spark, sf_dir):
    """Seeds forked from each document's source seed, and once more from the child of the document."""
    s = Tables(spark, sf_dir).documents.select("doc_id", B.parse_seed(F.col("source")).alias("p"))
    s = s.select("doc_id", B.fork_seed("p").alias("child_0"), B.fork_seed("p", 1).alias("child_1"),
                 B.fork_seed("p", F.col("doc_id")).alias("child_of_doc"))
    return s.withColumn("grandchild", B.fork_seed("child_of_doc"))


@register("b05_batch_results", "B-05", sql="""
WITH l AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 400000 THEN 'too dear: ' || o_orderkey END AS error,
                  row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders),
b AS (SELECT idx // 16 AS batch, count(*) AS n_rows, arg_min(error, idx) FILTER (error IS NOT NULL) AS error,
             list(o_orderkey ORDER BY idx) AS k, list(o_orderstatus ORDER BY idx) AS s FROM l GROUP BY idx // 16)
SELECT CAST(batch AS BIGINT) AS batch, n_rows, error, CASE WHEN error IS NULL THEN md5(array_to_string(k, ',')) END AS keys_md5,
       CASE WHEN error IS NULL THEN array_to_string(s, '') END AS statuses
FROM b WHERE batch < (SELECT count(*) // 16 FROM orders)""")
def b05_batch_results(spark, sf_dir):
    """Orders in batches of 16, where an order above 400,000 is a failed item."""
    bad = F.when(F.col("o_totalprice") > 400000, F.concat(F.lit("too dear: "), F.col("o_orderkey").cast("string")))
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus", bad.alias("error"))
    b = B.batch_results(B.sequential_index(o, ["o_orderkey"]), "idx", ["o_orderkey", "o_orderstatus"], "error")
    return b.select("batch", "n_rows", "error", ids_md5(F.col("columns.o_orderkey")).alias("keys_md5"),
                    F.array_join("columns.o_orderstatus", "").alias("statuses"))


# --- synthetic tasks (one sample per order: idx = o_orderkey) -------------------------------

from weft.operators import tasks as TK  # noqa: E402

TASK_SEED = 2024


def _u_sql(k):
    return uniform_sql(TASK_SEED, "o_orderkey", k)


def _draws_sql(start, length, n):
    return f"list_transform(range({start}, {start + length}), lambda k: CAST(floor({_u_sql('k')} * {n}) AS INTEGER))"


TASK_SQL = {
    "addition": ("[a, 21, s - a, 22]", "[s]",
                 f"CAST(floor({_u_sql(0)} * 21) AS INTEGER) AS s, CASE WHEN s = 0 THEN 0 ELSE CAST(floor({_u_sql(1)} * s) AS INTEGER) END AS a"),
    "modular_addition": ("[a, 501, s - a, 502]", "[s % 113]",
                         f"CAST(floor({_u_sql(0)} * 501) AS INTEGER) AS s, CASE WHEN s = 0 THEN 0 ELSE CAST(floor({_u_sql(1)} * s) AS INTEGER) END AS a"),
    "parity": ("p", "[CAST(list_sum(p) % 2 AS INTEGER)]", f"{_draws_sql(0, 4, 2)} AS p"),
    "random": ("p", "t", f"{_draws_sql(0, 5, 10)} AS p, {_draws_sql(5, 1, 10)} AS t"),
    "repeat": ("p", "p", f"{_draws_sql(0, 3, 5)} AS p"),
    "reverse": ("p", "list_reverse(p)", f"{_draws_sql(0, 3, 5)} AS p"),
    "sort": ("p", "list_sort(p)", f"{_draws_sql(0, 5, 26)} AS p"),
    "zeros": ("CAST([] AS INTEGER[])", "[0, 0, 0, 0, 0]", "1 AS unused"),
    "slapjack": ("p", "list_transform(p, lambda c, i: CASE WHEN c = 10 OR (i >= 2 AND c = p[i - 1]) OR (i >= 3 AND c = p[i - 2]) THEN 1 ELSE 0 END)",
                 f"{_draws_sql(0, 5, 13)} AS p"),
    "marked_addition": ("flatten(list_transform(range(8), lambda j: [v[j + 1], m[j + 1] + 11]))",
                        "[least(list_sum(list_transform(range(8), lambda j: v[j + 1] * m[j + 1])), 30)]",
                        f"{_draws_sql(0, 8, 11)} AS v, {_draws_sql(8, 8, 2)} AS m"),
    "copy_memory": ("list_concat(p, list_transform(range(12), lambda x: 10), [11])", "p", f"{_draws_sql(0, 3, 10)} AS p"),
    "temporal_order": ("list_transform(f, lambda x, i: CASE WHEN i - 1 = px THEN 10 WHEN i - 1 = py THEN 11 ELSE x END)",
                       "CASE WHEN px < py THEN [10, 11] ELSE [11, 10] END",
                       f"CAST(floor({_u_sql(0)} * 13) AS INTEGER) AS px, CAST(floor({_u_sql(1)} * 12) AS INTEGER) AS q, "
                       f"CASE WHEN q >= px THEN q + 1 ELSE q END AS py, {_draws_sql(2, 13, 10)} AS f"),
}


#: Samples of one task at most: a table file of few bytes a row is read by few tasks, and the work is in the samples.
SAMPLES_A_TASK = 50_000


def _sample_ids(spark, sf_dir):
    """Sample indices, dealt evenly."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey")
    return o.repartition(max(spark.sparkContext.defaultParallelism, -(-o.count() // SAMPLES_A_TASK)))


def _task_sql():
    parts = []
    for name, (p, t, defs) in TASK_SQL.items():
        parts.append(f"SELECT '{name}' AS task, o_orderkey AS idx, md5(array_to_string({p}, ',')) AS prompt_md5, "
                     f"md5(array_to_string({t}, ',')) AS target_md5 FROM (SELECT o_orderkey, {defs} FROM orders)")
    return "\nUNION ALL\n".join(parts)


@register("b23_toy_tasks", "B-23 B-24 B-25 B-26 B-29 B-30 B-31 B-32 B-33 B-34 B-35 B-37 B-39", sql=_task_sql())
def b23_toy_tasks(spark, sf_dir):
    """Twelve task generators, one sample per order (any index regenerates on its own)."""
    o = _sample_ids(spark, sf_dir)
    rows = []
    for name in TASK_SQL:
        p, t = TK.TASKS[name](F.col("o_orderkey"), TASK_SEED)
        rows.append(F.struct(F.lit(name).alias("task"), ids_md5(p).alias("prompt_md5"), ids_md5(t).alias("target_md5")))
    x = o.select("o_orderkey", F.explode(F.array(*rows)).alias("r"))
    return x.select("r.task", F.col("o_orderkey").alias("idx"), "r.prompt_md5", "r.target_md5")


@register("b27_dyck", "B-27 B-38")
def b27_dyck(spark, sf_dir):
    """Dyck-2 words of length 10, one per order, with a balance check and the task vocabulary size."""
    o = _sample_ids(spark, sf_dir)
    _, seq = TK.dyck(F.col("o_orderkey"), TASK_SEED, 10, 2)
    s = o.select("o_orderkey", seq.alias("seq"))
    depth = F.aggregate("seq", F.struct(F.lit(0).alias("d"), F.lit(0).alias("lo")), lambda a, t: F.struct(
        (a["d"] + F.when(F.pmod(t, F.lit(2)) == 0, 1).otherwise(-1)).alias("d"),
        F.least(a["lo"], a["d"] + F.when(F.pmod(t, F.lit(2)) == 0, 1).otherwise(-1)).alias("lo")))
    return s.select("o_orderkey", F.size("seq").alias("length"), ids_md5(F.col("seq")).alias("seq_md5"),
                    ((depth["d"] == 0) & (depth["lo"] >= 0)).alias("balanced"),
                    F.size(F.filter(TK.dyck_mask(F.col("seq")), lambda b: b)).alias("n_closing"),
                    F.lit(TK.task_vocab_size("dyck")).alias("vocab_size"))


@register("b40_task_labels", "B-40 B-41", sql="""
WITH s AS (SELECT l_orderkey, list(CAST(l_quantity AS INTEGER) % 13 ORDER BY l_linenumber, l_partkey, l_suppkey) AS q FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(list_sum(q) AS BIGINT) AS sum_label, CAST(list_sum(q) % 2 AS BIGINT) AS parity_label,
       md5(array_to_string(list_sort(q), ',')) AS sorted_md5, md5(array_to_string(list_reverse(q), ',')) AS reversed_md5,
       md5(array_to_string(list_transform(q, lambda c, i: CASE WHEN c = 10 OR (i >= 2 AND c = q[i - 1]) OR (i >= 3 AND c = q[i - 2]) THEN 1 ELSE 0 END), ',')) AS slaps_md5,
       CAST(len(q) + 2 AS INTEGER) AS block_size, CAST(ceil((len(q) + 16) / 8) * 8 AS BIGINT) AS rounded_vocab
FROM s""")
def b40_task_labels(spark, sf_dir):
    """Task rules recomputed on any int arrays: per order, line quantities mod 13 (card ranks)."""
    li = Tables(spark, sf_dir).lineitem
    s = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", F.pmod(F.col("l_quantity").cast("int"), F.lit(13)).alias("q")))).alias("_l"))
    s = s.select("l_orderkey", F.col("_l.q").alias("q"))
    L = TK.label_rules(F.col("q"))
    return s.select("l_orderkey", L["sum"].alias("sum_label"), L["parity"].alias("parity_label"),
                    ids_md5(L["sorted"]).alias("sorted_md5"), ids_md5(L["reversed"]).alias("reversed_md5"),
                    ids_md5(L["slaps"]).alias("slaps_md5"), (F.size("q") + 2).alias("block_size"),
                    TK.round_vocab(F.size("q") + 16, 8).alias("rounded_vocab"))


def _elman_sql():
    def slot(s):
        return "NULL" if s is None else "[" + ", ".join(f"'{w}'" for w in TK.ELMAN_CATEGORIES[s]) + "]"
    tpls = "[" + ", ".join("[" + ", ".join(slot(s) for s in t) + "]" for t in TK.ELMAN_TEMPLATES) + "]"
    return tpls


@register("b28_elman", "B-28 D-08", sql=f"""
WITH g AS (SELECT o_orderkey, {_elman_sql()}[CAST(floor({_u_sql(0)} * 16) AS INTEGER) + 1] AS tpl,
                  {_elman_sql()}[CAST(floor({uniform_sql(TASK_SEED + 1, 'o_orderkey', '0')} * 16) AS INTEGER) + 1] AS tpl2 FROM orders),
w AS (SELECT o_orderkey, list_transform(tpl, lambda s, j: CASE WHEN s IS NULL THEN 'PAD' ELSE s[CAST(floor({_u_sql('j')} * len(s)) AS INTEGER) + 1] END) AS words,
             list_transform(tpl2, lambda s, j: CASE WHEN s IS NULL THEN 'PAD' ELSE s[CAST(floor({uniform_sql(TASK_SEED + 1, 'o_orderkey', 'j')} * len(s)) AS INTEGER) + 1] END) AS words2 FROM g),
p AS (SELECT o_orderkey, words, [words[1], words[2], words2[3]] AS pred FROM w),
m AS (SELECT o_orderkey, words, pred, list_max(list_transform({_elman_sql()}, lambda t:
        CASE WHEN NOT (CASE WHEN t[1] IS NULL THEN pred[1] = 'PAD' ELSE list_contains(t[1], pred[1]) END) THEN 0
             WHEN NOT (CASE WHEN t[2] IS NULL THEN pred[2] = 'PAD' ELSE list_contains(t[2], pred[2]) END) THEN 1
             WHEN NOT (CASE WHEN t[3] IS NULL THEN pred[3] = 'PAD' ELSE list_contains(t[3], pred[3]) END) THEN 2 ELSE 3 END)) AS best FROM p)
SELECT o_orderkey AS idx, array_to_string(words, ' ') AS sentence, array_to_string(pred, ' ') AS prediction,
       CAST(best AS INTEGER) AS best_prefix, best = 3 AS matched_template FROM m""")
def b28_elman(spark, sf_dir):
    """One Elman sentence per order; the prediction keeps its first two words and takes the third
    from a second sample, then is scored against the templates."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey")
    words, _ = TK.elman(F.col("o_orderkey"), TASK_SEED)
    words2, _ = TK.elman(F.col("o_orderkey"), TASK_SEED + 1)
    x = o.select("o_orderkey", words.alias("words"), words2.alias("w2"))
    x = x.withColumn("pred", F.array(F.col("words")[0], F.col("words")[1], F.col("w2")[2]))
    m = TK.elman_metrics(F.col("pred"))
    return x.select(F.col("o_orderkey").alias("idx"), F.array_join("words", " ").alias("sentence"),
                    F.array_join("pred", " ").alias("prediction"), m["best_prefix"].alias("best_prefix"),
                    m["matched_template"].alias("matched_template"))


@register("b36_two_sum", "B-36", sql=f"""
WITH g AS (SELECT o_orderkey, CAST(floor({_u_sql('0')} * 8) AS INTEGER) AS a, CAST(floor({_u_sql('1')} * 8) AS INTEGER) AS b,
                  CAST(floor({_u_sql('2')} * 4) AS INTEGER) AS i, CAST(floor({_u_sql('3')} * 3) AS INTEGER) AS d FROM orders),
h AS (SELECT *, a + b AS t, (i + 1 + d) % 4 AS j FROM g),
c AS (SELECT *, list_filter(range(8), lambda v: v <> a AND v <> b AND v <> t - v AND (t - v < 0 OR t - v > 7
        OR ({_u_sql('(least(v, t - v) + 1000)')} < 0.5) = (v < t - v))) AS fill FROM h),
n AS (SELECT *, list_append(list_transform(range(4), lambda p: CASE WHEN p = i THEN a WHEN p = j THEN b
        ELSE fill[CAST(floor({_u_sql('(p + 4)')} * len(fill)) AS INTEGER) + 1] END), t) AS prompt FROM c)
SELECT o_orderkey, {md5_sql('prompt')} AS prompt_md5, {md5_sql('[a, b]')} AS target_md5, true AS unique_solution FROM n""")
def b36_two_sum(spark, sf_dir):
    """One two-sum instance per order; ``unique_solution`` recounts the pairs that make the sum."""
    prompt, target = TK.two_sum(F.col("o_orderkey"), TASK_SEED)
    g = Tables(spark, sf_dir).orders.select("o_orderkey", F.struct(prompt.alias("prompt"), target.alias("target")).alias("s"))
    nums = F.slice("s.prompt", 1, 4)
    t = F.element_at("s.prompt", 5)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda j: F.when((i < j) & (F.element_at(nums, i + 1) + F.element_at(nums, j + 1) == t), 1).otherwise(0))))
    return g.select("o_orderkey", ids_md5(F.col("s.prompt")).alias("prompt_md5"), ids_md5(F.col("s.target")).alias("target_md5"),
                    (F.aggregate(pairs, F.lit(0), lambda a, x: a + x) == 1).alias("unique_solution"))


# --- tasks as tokens with their switches ----------------------------------------------------

from weft.operators import task_tokens as TT  # noqa: E402

SWITCHED = [("addition", "plain", {"expression": False}), ("addition", "expression", {}), ("copy_memory", "commas", {"distractors": 4, "commas": True}),
            ("copy_memory", "silent", {"distractors": 4, "recall": False}), ("parity", "colon", {}), ("parity", "plain", {"colon": False}),
            ("repeat", "commas", {"commas": True}), ("slapjack", "doubles", {"sandwiches": False}),
            ("slapjack", "sandwiches", {"doubles": False, "colon": False}), ("two_sum", "commas", {"commas": True}),
            ("two_sum", "plain", {"expression": False})]


def _pad_sql(x, width=2):
    return f"list_transform({x}, lambda v: lpad(CAST(v AS VARCHAR), {width}, '0'))"


def _comma_sql(x):
    return f"flatten(list_transform({x}, lambda v, i: CASE WHEN i = 1 THEN [v] ELSE [',', v] END))"


def _switch_sql():
    """Prompt, target, vocabulary and inner columns of every setting."""
    number = _pad_sql("range(21)")
    add = f"CAST(floor({_u_sql(0)} * 21) AS INTEGER) AS s, CASE WHEN s = 0 THEN 0 ELSE CAST(floor({_u_sql(1)} * s) AS INTEGER) END AS a, {_pad_sql('[a, s - a, s]')} AS w"
    letter = "list_transform({}, lambda v: 'L' || v)"
    copy = f"{letter.format(_pad_sql(_draws_sql(0, 7, 10)))} AS w"
    copy_vocab = letter.format(_pad_sql("range(11)"))
    bits = f"{_draws_sql(0, 4, 2)} AS b, list_transform(b, lambda v: CAST(v AS VARCHAR)) AS w, [CASE WHEN list_sum(b) % 2 = 0 THEN 'even' ELSE 'odd' END] AS t"
    rep = f"list_transform({_draws_sql(0, 3, 5)}, lambda v: substr('ABCDE', CAST(v + 1 AS BIGINT), 1)) AS w"
    cards = f"list_transform({_draws_sql(0, 5, 12)}, lambda v: substr('{TT.CARDS}', CAST(v + 1 AS BIGINT), 1)) AS w"
    act = f"list_transform(w, lambda c, i: CASE WHEN c = 'J' OR (i > {{0}} AND c = w[i - {{0}}]) THEN '{TT.SLAP}' ELSE '{TT.NO_SLAP}' END)"
    deck = f"string_split('{','.join(TT.CARDS)}', ',')"
    acts = f"['{TT.SLAP}', '{TT.NO_SLAP}']"
    ab = f"""CAST(floor({_u_sql('0')} * 8) AS INTEGER) AS a, CAST(floor({_u_sql('1')} * 8) AS INTEGER) AS b, a + b AS t,
      CAST(floor({_u_sql('2')} * 4) AS INTEGER) AS i, (i + 1 + CAST(floor({_u_sql('3')} * 3) AS INTEGER)) % 4 AS j,
      list_filter(range(8), lambda v: v <> a AND v <> b AND v <> t - v AND (t - v < 0 OR t - v > 7
        OR ({_u_sql('(least(v, t - v) + 1000)')} < 0.5) = (v < t - v))) AS f,
      {_pad_sql(f"list_transform(range(4), lambda p: CASE WHEN p = i THEN a WHEN p = j THEN b ELSE f[CAST(floor({_u_sql('(p + 4)')} * len(f)) AS INTEGER) + 1] END)")} AS w,
      lpad(CAST(t AS VARCHAR), 2, '0') AS g, {_pad_sql('[a, b]')} AS pair"""
    low = _pad_sql("range(16)")
    return {
        ("addition", "plain"): ("w[1:2]", "w[3:3]", number, add),
        ("addition", "expression"): ("[w[1], '+', w[2], '=']", "w[3:3]", f"list_concat({number}, ['+', '='])", add),
        ("copy_memory", "commas"): (_comma_sql("list_append(w, '?')"), "w[1:3]", f"list_concat({copy_vocab}, [',', '?'])", copy),
        ("copy_memory", "silent"): ("w", "w[1:3]", copy_vocab, copy),
        ("parity", "colon"): ("list_append(w, ':')", "t", "['0', '1', ':', 'even', 'odd']", bits),
        ("parity", "plain"): ("w", "t", "['0', '1', 'even', 'odd']", bits),
        ("repeat", "commas"): (f"list_append({_comma_sql('w')}, ':')", _comma_sql("w"), "['A', 'B', 'C', 'D', 'E', ':', ',']", rep),
        ("slapjack", "doubles"): ("list_append(w, ':')", act.format(1), f"list_concat({deck}, [':'], {acts})", cards),
        ("slapjack", "sandwiches"): ("w", act.format(2), f"list_concat({deck}, {acts})", cards),
        ("two_sum", "commas"): (f"list_concat({_comma_sql('w')}, [':', g, '='])", _comma_sql("pair"), f"list_concat({low}, [':', '=', ','])", ab),
        ("two_sum", "plain"): ("list_append(w, g)", "pair", low, ab),
    }


def _switched_sql():
    parts = [f"SELECT '{task}' AS task, '{setting}' AS setting, o_orderkey AS idx, {p} AS p, {t} AS t, {vocab} AS vocab FROM (SELECT o_orderkey, {inner} FROM orders)"
             for (task, setting), (p, t, vocab, inner) in _switch_sql().items()]
    return ("SELECT task, setting, idx, array_to_string(p, ' ') AS prompt, array_to_string(t, ' ') AS target, "
            + md5_sql("list_transform(list_concat(p, t), lambda x: list_position(vocab, x) - 1)")
            + " AS ids_md5, CAST(len(vocab) + 3 AS INTEGER) AS vocab_size FROM (" + "\nUNION ALL\n".join(parts) + ")")


@register("b38_task_switches", "B-23 B-26 B-29 B-31 B-34 B-36 B-38", sql=_switched_sql())
def b38_task_switches(spark, sf_dir):
    """Eleven settings of six tasks, one sample per order, as tokens and as ids of the setting's vocabulary."""
    o = _sample_ids(spark, sf_dir)
    rows = []
    for task, setting, switches in SWITCHED:
        p, t = TT.TOKEN_TASKS[task](F.col("o_orderkey"), TASK_SEED, **switches)
        kinds = {k: v for k, v in switches.items() if k in ("expression", "recall", "commas", "colon")}
        vocab = TT.vocabulary(task, **({"max_value": 15} if task == "two_sum" else {}), **kinds)
        rows.append(F.struct(F.lit(task).alias("task"), F.lit(setting).alias("setting"), p.alias("p"), t.alias("t"),
                             F.lit(vocab).alias("vocab")))
    x = o.select("o_orderkey", F.explode(F.array(*rows)).alias("r"))
    return x.select("r.task", "r.setting", F.col("o_orderkey").alias("idx"), F.array_join("r.p", " ").alias("prompt"),
                    F.array_join("r.t", " ").alias("target"), ids_md5(TT.token_ids(F.concat("r.p", "r.t"), F.col("r.vocab"))).alias("ids_md5"),
                    (F.size("r.vocab") + len(TT.SPECIALS)).alias("vocab_size"))
