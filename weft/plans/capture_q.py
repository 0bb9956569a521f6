"""Registered capture queries (section E) over the region -> nation -> customer module tree
and an op log built from ``events`` (module = the customer whose key is the event's user_id,
op = event_type, seq = position in (ts, event_id) order)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import capture as CP
from weft.operators.capture import CHILD, DESCENDANT, NEXT, SUBSEQUENT, Step
from weft.operators.ordering import row_index
from weft.plans.catalog import register
from weft.session import checkpoint_dir
from weft.sources.tables import Tables


def tree(spark, sf_dir, with_closure: bool = True):
    """Module tree and closure, each written once to the checkpoint folder: every
    selector step joins them again, so their lineage is cut instead of re-planned.
    Op-log queries only need the tree (``with_closure=False``)."""
    t = Tables(spark, sf_dir)
    checkpoint_dir(spark)
    m = CP.module_tree(t.region, t.nation, t.customer).checkpoint(eager=True)
    return m, (CP.closure(m).checkpoint(eager=True) if with_closure else None)


def oplog(spark, sf_dir, modules):
    ev = Tables(spark, sf_dir).events.select("event_id", "ts", "user_id", F.col("event_type").alias("op"), "value")
    m = modules.filter(F.col("key").isNotNull()).select(F.col("path").alias("module_path"), F.col("key").alias("user_id"))
    o = ev.join(m, "user_id")
    return row_index(o, ["module_path"], ["ts", "event_id"], "seq").checkpoint(eager=True)


def run(spark, sf_dir, steps, **kw):
    m, c = tree(spark, sf_dir)
    return CP.select_modules(m, c, steps, **kw)


TREE_SQL = """r AS (SELECT r_regionkey, regexp_replace(lower(trim(r_name)), ' ', '_', 'g') AS name,
                  ROW_NUMBER() OVER (ORDER BY r_regionkey) - 1 AS child_idx FROM region),
n AS (SELECT n_nationkey, n_regionkey, regexp_replace(lower(trim(n_name)), ' ', '_', 'g') AS name,
             ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS child_idx FROM nation),
c AS (SELECT c_custkey, c_nationkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS seg,
             ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS child_idx FROM customer),
nodes0 AS (
  SELECT 'model' AS path, CAST(NULL AS VARCHAR) AS parent_path, 'model' AS name, 'Model' AS type_name, CAST(0 AS BIGINT) AS child_idx, 0 AS depth, CAST(NULL AS BIGINT) AS key
  UNION ALL SELECT 'model/' || r.name, 'model', r.name, 'Region', r.child_idx, 1, NULL FROM r
  UNION ALL SELECT 'model/' || r.name || '/' || n.name, 'model/' || r.name, n.name, 'Nation', n.child_idx, 2, NULL FROM n JOIN r ON n.n_regionkey = r.r_regionkey
  UNION ALL SELECT 'model/' || r.name || '/' || n.name || '/' || c.child_idx, 'model/' || r.name || '/' || n.name, CAST(c.child_idx AS VARCHAR), c.seg, c.child_idx, 3, c.c_custkey
  FROM c JOIN n ON c.c_nationkey = n.n_nationkey JOIN r ON n.n_regionkey = r.r_regionkey),
nodes AS (SELECT n0.*, COALESCE(k.nc, 0) AS n_children FROM nodes0 n0 LEFT JOIN (SELECT parent_path AS p, COUNT(*) AS nc FROM nodes0 GROUP BY 1) k ON k.p = n0.path)"""

OPLOG_SQL = """ops AS (SELECT nodes.path AS module_path, e.event_type AS op, e.event_id,
          CAST(ROW_NUMBER() OVER (PARTITION BY nodes.path ORDER BY e.ts, e.event_id) - 1 AS BIGINT) AS seq
        FROM events e JOIN nodes ON nodes.key = e.user_id)"""


def paths_sql(body: str) -> str:
    return f"WITH {TREE_SQL} SELECT DISTINCT path FROM ({body})"


@register("e01_select_by_name", "E-01 E-10", sql=paths_sql(
    "SELECT path FROM nodes WHERE name = '7' AND path LIKE 'model/asia/%'"))
def e01_select_by_name(spark, sf_dir):
    """``asia 7``: customers named 7 anywhere below asia."""
    out, _ = run(spark, sf_dir, [Step(DESCENDANT, "name", "asia"), Step(DESCENDANT, "name", "7")])
    return out.select("path")


@register("e02_select_child", "E-02 E-07", sql=paths_sql(
    "SELECT path FROM nodes WHERE parent_path = 'model/europe'"))
def e02_select_child(spark, sf_dir):
    """``model > europe > *``: the first token matches the root itself."""
    out, _ = run(spark, sf_dir, [Step(DESCENDANT, "name", "model"), Step(CHILD, "name", "europe"), Step(CHILD, "wildcard")])
    return out.select("path")


@register("e03_select_by_index", "E-03 E-23", sql=f"""WITH {TREE_SQL},
q0 AS (SELECT k.path FROM nodes p JOIN nodes k ON k.parent_path = p.path AND k.child_idx = p.n_children - 1
       WHERE p.path = 'model/america/nation_1'),
q1 AS (SELECT k.path FROM nodes p JOIN nodes k ON k.parent_path = p.path AND k.child_idx = 2
       WHERE p.path LIKE 'model/africa/%')
SELECT path, 0 AS query_idx FROM q0 UNION ALL SELECT path, 1 FROM q1""")
def e03_select_by_index(spark, sf_dir):
    """Two selectors at once: ``america > nation_1[-1]`` and ``africa [2]``."""
    a, _ = run(spark, sf_dir, [Step(DESCENDANT, "name", "america"), Step(CHILD, "name", "nation_1", -1)])
    b, _ = run(spark, sf_dir, [Step(DESCENDANT, "name", "africa"), Step(DESCENDANT, "name", "", 2)])
    return CP.multi_query([a.select("path"), b.select("path")])


@register("e04_next_sibling", "E-04 E-06", sql=paths_sql("""
SELECT s.path FROM nodes b JOIN nodes s ON s.parent_path = b.parent_path AND s.child_idx = (
  SELECT MIN(x.child_idx) FROM nodes x WHERE x.parent_path = b.parent_path AND x.child_idx > b.child_idx AND x.type_name = 'Machinery')
WHERE b.type_name = 'Building'"""))
def e04_next_sibling(spark, sf_dir):
    """``Building + Machinery``: for each Building node the first later Machinery sibling."""
    out, _ = run(spark, sf_dir, [Step(DESCENDANT, "type", "Building"), Step(NEXT, "type", "Machinery")])
    return out.select("path")


@register("e05_subsequent_siblings", "E-05", sql=paths_sql("""
SELECT s.path FROM nodes s JOIN (SELECT parent_path, MIN(child_idx) AS m FROM nodes WHERE type_name = 'Household' GROUP BY 1) h
  ON s.parent_path = h.parent_path WHERE s.child_idx > h.m AND s.type_name = 'Furniture'"""))
def e05_subsequent_siblings(spark, sf_dir):
    """``Household ~ Furniture``: every Furniture sibling after some Household node."""
    out, _ = run(spark, sf_dir, [Step(DESCENDANT, "type", "Household"), Step(SUBSEQUENT, "type", "Furniture")])
    return out.select("path")


@register("e06_type_wildcard", "E-06 E-07", sql=f"""WITH {TREE_SQL}
SELECT depth, CAST(COUNT(*) AS BIGINT) AS n FROM nodes WHERE depth = 0 OR type_name = 'Automobile' OR depth IN (1, 2) GROUP BY depth""")
def e06_type_wildcard(spark, sf_dir):
    """``*`` as first token (root + everything), unioned with ``Region > * > Automobile``."""
    a, _ = run(spark, sf_dir, [Step(DESCENDANT, "wildcard")])
    b, _ = run(spark, sf_dir, [Step(DESCENDANT, "type", "Region"), Step(CHILD, "wildcard"), Step(CHILD, "type", "Automobile")])
    allx = a.filter(F.col("depth") < 3).unionByName(b).dropDuplicates(["path"])
    return allx.groupBy("depth").agg(F.count("*").alias("n"))


@register("e08_regex", "E-08 E-09", sql=paths_sql("""
SELECT path FROM nodes WHERE depth = 3 AND regexp_matches(parent_path, '/nation_1[0-9]$')
  AND regexp_matches(type_name, '^(Building|Furniture)$')"""))
def e08_regex(spark, sf_dir):
    """``/^nation_1[0-9]$/ > :/^(Building|Furniture)$/``."""
    out, _ = run(spark, sf_dir, [Step(DESCENDANT, "name_regex", "^nation_1[0-9]$"),
                                 Step(CHILD, "type_regex", "^(Building|Furniture)$")])
    return out.select("path")


@register("e11_include_descendants", "E-11", sql=paths_sql(
    "SELECT path FROM nodes WHERE path = 'model/africa' OR parent_path = 'model/africa'"))
def e11_include_descendants(spark, sf_dir):
    out, _ = run(spark, sf_dir, [Step(DESCENDANT, "name", "africa")], include_descendants=True, max_depth=1)
    return out.select("path")


@register("e12_selector_diagnostics", "E-12", sql=f"""WITH {TREE_SQL}
SELECT * FROM (VALUES (0, 'descendant:name:europe', CAST(1 AS BIGINT), false), (1, 'child:name:nation_0', CAST(0 AS BIGINT), true),
                      (2, 'child:wildcard:', CAST(0 AS BIGINT), false)) t(token_idx, token, n_matched, failed_here)
WHERE (SELECT COUNT(*) FROM nodes) > 0""")
def e12_selector_diagnostics(spark, sf_dir):
    """``europe > nation_0 > *`` fails at token 1 (nation_0 is in africa)."""
    steps = [Step(DESCENDANT, "name", "europe"), Step(CHILD, "name", "nation_0"), Step(CHILD, "wildcard")]
    _, trail = run(spark, sf_dir, steps)
    return CP.selector_diagnostics(trail, steps)


def params(spark, sf_dir, modules):
    cu = Tables(spark, sf_dir).customer.select("c_custkey", "c_acctbal", "c_nationkey")
    m = modules.filter(F.col("key").isNotNull()).select("path", F.col("key").alias("c_custkey"))
    x = cu.join(m, "c_custkey")
    return (x.select("path", F.lit("acctbal").alias("param_name"), F.lit("parameter").alias("kind"),
                     F.array(F.col("c_acctbal")).alias("values"))
            .unionByName(x.select("path", F.lit("nation_id").alias("param_name"), F.lit("buffer").alias("kind"),
                                  F.array(F.col("c_nationkey").cast("double")).alias("values"))))


@register("e13_select_params", "E-13 E-22", sql=f"""WITH {TREE_SQL},
p AS (SELECT nodes.path, c_acctbal AS val FROM nodes JOIN customer ON nodes.key = customer.c_custkey WHERE nodes.type_name = 'Machinery')
SELECT path, 'acctbal' AS param_name, CAST(0 AS INTEGER) AS elem_idx, round(val, 6) AS val, path || ':0:0' AS match_id, 0 AS query_idx FROM p""")
def e13_select_params(spark, sf_dir):
    """``Machinery #/^acct/``: parameters of matched modules, flattened to one row per element."""
    m, c = tree(spark, sf_dir)
    out, _ = CP.select_modules(m, c, [Step(DESCENDANT, "type", "Machinery")])
    p = CP.select_params(out, params(spark, sf_dir, m), regex="^acct").withColumn("query_idx", F.lit(0))
    f = CP.flatten_matches(p.select("path", "param_name", "values", "query_idx"))
    return f.select("path", "param_name", "elem_idx", F.round("val", 6).alias("val"), "match_id", "query_idx")


@register("e15_op_simple", "E-15", sql=f"""WITH {TREE_SQL}, {OPLOG_SQL}
SELECT module_path, seq, op FROM ops WHERE module_path LIKE 'model/europe/%' AND op = 'purchase'
  AND module_path IN (SELECT path FROM nodes WHERE type_name = 'Building')""")
def e15_op_simple(spark, sf_dir):
    """``europe Building @purchase``."""
    m, c = tree(spark, sf_dir)
    out, _ = CP.select_modules(m, c, [Step(DESCENDANT, "name", "europe"), Step(DESCENDANT, "type", "Building")])
    return CP.op_simple(oplog(spark, sf_dir, m), out, op="purchase").select("module_path", "seq", "op")


@register("e16_op_next", "E-16", sql=f"""WITH {TREE_SQL}, {OPLOG_SQL},
l AS (SELECT *, LAG(op) OVER (PARTITION BY module_path ORDER BY seq) AS prev FROM ops)
SELECT module_path, seq FROM l WHERE op = 'click' AND prev = 'view'""")
def e16_op_next(spark, sf_dir):
    """``@view + @click`` over every module."""
    m, _ = tree(spark, sf_dir, with_closure=False)
    return CP.op_next(oplog(spark, sf_dir, m), "view", "click").select("module_path", "seq")


@register("e17_op_subsequent", "E-17", sql=f"""WITH {TREE_SQL}, {OPLOG_SQL},
l AS (SELECT *, MAX(CASE WHEN op = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY module_path ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ops)
SELECT module_path, seq FROM l WHERE op = 'purchase' AND seen = 1""")
def e17_op_subsequent(spark, sf_dir):
    """``@signup ~ @purchase``."""
    m, _ = tree(spark, sf_dir, with_closure=False)
    return CP.op_subsequent(oplog(spark, sf_dir, m), "signup", "purchase").select("module_path", "seq")


#: ``view + click ~ purchase`` step by step: a view counts for the next op only, a view with its click
#: waits for a purchase, which uses it up.
CHAIN_SQL = f"""WITH RECURSIVE {TREE_SQL}, {OPLOG_SQL},
st AS (SELECT module_path, seq, op, 0 AS had_view, 0 AS waiting, false AS done FROM (SELECT DISTINCT module_path, CAST(-1 AS BIGINT) AS seq, '' AS op FROM ops)
  UNION ALL
  SELECT o.module_path, o.seq, o.op, CASE WHEN o.op = 'view' THEN 1 ELSE 0 END,
         CASE WHEN s.had_view = 1 AND o.op = 'click' THEN 1 WHEN s.waiting = 1 AND o.op <> 'purchase' THEN 1 ELSE 0 END,
         s.waiting = 1 AND o.op = 'purchase'
  FROM st s JOIN ops o ON o.module_path = s.module_path AND o.seq = s.seq + 1)
SELECT module_path, seq FROM st WHERE done"""


@register("e18_op_chain", "E-18", sql=CHAIN_SQL)
def e18_op_chain(spark, sf_dir):
    """``@view + @click ~ @purchase`` with overlapping progress."""
    m, _ = tree(spark, sf_dir, with_closure=False)
    return CP.op_chain(oplog(spark, sf_dir, m), ["view", "click", "purchase"], [NEXT, SUBSEQUENT]).select("module_path", "seq")


SLICE_SPEC = [(2, 5), Ellipsis, -1]
SLICE_IDX = [r * 8 + 7 for r in range(2, 5)]  # rows 2..4 of the 8x8 view, last column


@register("e19_slice_capture", "E-19 E-20 E-21", sql=f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT vec_id, list_transform({[i + 1 for i in SLICE_IDX]}, lambda p: v[p] * 0.5) AS y FROM e)
SELECT vec_id, CAST(unnest(range(len(y))) AS INTEGER) AS k, round(unnest(y), 6) AS val FROM s""")
def e19_slice_capture(spark, sf_dir):
    """Captured 64-vectors viewed as 8x8: ``[2:5, ..., -1]`` with scale 50% (facet applied after slicing)."""
    e = Tables(spark, sf_dir).embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    y = CP.capture_facets(CP.slice_capture(F.col("v"), [8, 8], SLICE_SPEC), scale="50%")
    return e.select("vec_id", F.posexplode(y).alias("k", "val")).select("vec_id", "k", F.round("val", 6).alias("val"))


@register("e20_facets", "E-20 E-21", sql=f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT vec_id, list_transform({[i + 1 for i in SLICE_IDX]}, lambda p: greatest(2 * v[p], 0) * 0.5) AS y FROM e)
SELECT vec_id, 'half the rising slope' AS label, CAST(unnest(range(len(y))) AS INTEGER) AS k, round(unnest(y), 6) AS val FROM s""")
def e20_facets(spark, sf_dir):
    """Gradients of each vector's squared length, piped through relu, sliced as 8x8, scaled and labelled."""
    v = F.col("embedding").cast("array<double>")
    m = Tables(spark, sf_dir).embeddings.select("vec_id", F.col("vec_id").cast("string").alias("path"), v.alias("values"),
                                                F.transform(v, lambda x: x * 2).alias("gradients"))
    relu = lambda a: F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))
    c = CP.capture_values(m, [8, 8], SLICE_SPEC, pipe=relu, scale="50%", grad=True, label="half the rising slope")
    return c.select("vec_id", "label", F.posexplode("values").alias("k", "val")).select("vec_id", "label", "k", F.round("val", 6).alias("val"))


@register("e24_module_index", "E-24", sql=f"""WITH {TREE_SQL}, {OPLOG_SQL}
SELECT module_path, CAST(COUNT(*) AS BIGINT) AS n_ops, array_to_string(list_sort(list(DISTINCT op)), ',') AS ops,
       MIN(seq) AS first_seq, MAX(seq) AS last_seq FROM ops GROUP BY module_path""")
def e24_module_index(spark, sf_dir):
    m, _ = tree(spark, sf_dir, with_closure=False)
    i = CP.module_index(oplog(spark, sf_dir, m))
    return i.select("module_path", "n_ops", F.array_join("ops", ",").alias("ops"), "first_seq", "last_seq")


@register("d39_param_groups", "D-39", sql=f"""WITH {TREE_SQL},
p AS (SELECT nodes.path, 'acctbal' AS param_name, nodes.type_name FROM nodes JOIN customer ON nodes.key = customer.c_custkey
      UNION ALL SELECT path, 'norm.bias', type_name FROM nodes WHERE depth = 2)
SELECT path, param_name, CASE WHEN ends_with(param_name, 'bias') OR contains(type_name, 'Norm') THEN 'no_decay' ELSE 'decay' END AS "group"
FROM p""")
def d39_param_groups(spark, sf_dir):
    """Decay groups of the module parameters (customers: weight-like balances; nations: a bias;
    buffers are left out)."""
    from weft.operators.optim import param_groups
    m, _ = tree(spark, sf_dir)
    p = params(spark, sf_dir, m).join(m.select("path", "type_name"), "path")
    nb = m.filter(F.col("depth") == 2).select("path", F.lit("norm.bias").alias("param_name"), F.lit("parameter").alias("kind"),
                                              F.array(F.lit(0.0)).alias("values"), "type_name")
    g = param_groups(p.unionByName(nb))
    return g.select("path", "param_name", "group")


DECAYED, UNDECAYED = ("Building", "Machinery", "Automobile"), ("Automobile", "Household")


@register("d39_group_flags", "D-39", sql=f"""WITH {TREE_SQL},
p AS (SELECT nodes.path, n.name AS param_name, nodes.type_name FROM nodes JOIN customer ON nodes.key = customer.c_custkey,
      (SELECT unnest(['weight', 'bias', 'scale']) AS name) n),
f AS (SELECT *, ends_with(param_name, 'bias') OR (param_name = 'weight' AND type_name IN {UNDECAYED}) AS no_decay,
      param_name = 'scale' OR (param_name = 'weight' AND type_name IN {DECAYED}) AS decay FROM p)
SELECT path, param_name, CASE WHEN decay THEN 'decay' WHEN no_decay THEN 'no_decay' END AS "group",
       decay AND no_decay AS overlap, NOT decay AND NOT no_decay AS missing FROM f""")
def d39_group_flags(spark, sf_dir):
    """Three parameters of every customer module under type lists that overlap in one type and miss another."""
    from weft.operators.optim import param_groups
    m, _ = tree(spark, sf_dir, with_closure=False)
    cu = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("key"))
    p = m.filter(F.col("key").isNotNull()).join(cu, "key").select(
        "path", "type_name", F.explode(F.array(F.lit("weight"), F.lit("bias"), F.lit("scale"))).alias("param_name"), F.lit("parameter").alias("kind"))
    return param_groups(p, decayed=DECAYED, undecayed=UNDECAYED).select("path", "param_name", "group", "overlap", "missing")


@register("d43_fit_linear", "D-43 D-41 D-42 D-35")
def d43_fit_linear(spark, sf_dir):
    """20 full-batch steps fitting extendedprice/1e5 ~ w * quantity/50 + b over every line item."""
    from weft.operators.optim import fit_linear
    li = Tables(spark, sf_dir).lineitem.select((F.col("l_quantity") / 50).alias("x"),
                                               (F.col("l_extendedprice") / 1e5).alias("y"))
    hist = fit_linear(li, ["x"], "y", steps=20, lr=0.5, momentum=0.9, max_grad_norm=5.0)
    return spark.createDataFrame([(h["step"], h["loss"], h["w0"], h["b"]) for h in hist], "step int, loss double, w double, b double")


@register("d43_fit_softmax", "D-43 D-33 D-36")
def d43_fit_softmax(spark, sf_dir):
    """20 Adam steps under a cosine schedule fit the embeddings' labels; every row's prediction."""
    import math
    from weft.operators.optim import fit_softmax, predict_softmax
    e = Tables(spark, sf_dir).embeddings.select("vec_id", "embedding", "label")
    w, _ = fit_softmax(e, "embedding", "label", 10, 64, 20, lambda t: 0.05 * (1 + math.cos(math.pi * t / 20)) / 2)
    return predict_softmax(e, "embedding", w).select("vec_id", "label", "predicted")
