"""Capture queries over a module tree and an op log (section E).

Tables
------
``modules(path, parent_path, name, type_name, child_idx, n_children, depth)``
``closure(anc, path, dist)`` — every (ancestor, descendant) pair; its size is
nodes x depth, so descendant search is an equi-join on ``anc`` instead of a
prefix (non-equi) join.
``oplog(module_path, seq, op, value)`` — ops in execution order per module.

Selectors are plain Python tokens — ``Step(combinator, kind, value, index)`` —
no grammar is parsed.  Every step is a join/filter; sibling steps use the
skew-safe ordered scans of ``ordering`` rather than pairing siblings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.ordering import BLK, _join_offsets, blocked, lag_value, prefix_agg, row_index
from weft.session import stage_table

DESCENDANT, CHILD, NEXT, SUBSEQUENT = "descendant", "child", "next", "subsequent"


@dataclass(frozen=True)
class Step:
    combinator: str = DESCENDANT          # how this token relates to the previous context
    kind: str = "name"                    # name | type | wildcard | name_regex | type_regex
    value: str = ""
    index: int | None = None              # name[i] / [i]


# --- tree tables ------------------------------------------------------------------

def module_tree(region: DataFrame, nation: DataFrame, customer: DataFrame, root: str = "model") -> DataFrame:
    """Three-level tree: model / region / nation / customer.

    Region and nation nodes are named after them (lower case, '_' for spaces);
    customers are list items named by their position ('0', '1', ...) with their
    market segment as type.  Positions come from the skew-safe ``row_index``."""
    def nm(c):
        return F.regexp_replace(F.lower(F.trim(c)), " ", "_")
    r = row_index(region.select("r_regionkey", nm(F.col("r_name")).alias("name")), [], ["r_regionkey"], "child_idx")
    r = r.select(F.concat(F.lit(root + "/"), "name").alias("path"), F.lit(root).alias("parent_path"), "name",
                 F.lit("Region").alias("type_name"), "child_idx", F.lit(1).alias("depth"), "r_regionkey")
    n = nation.select("n_nationkey", "n_regionkey", nm(F.col("n_name")).alias("name"))
    n = row_index(n, ["n_regionkey"], ["n_nationkey"], "child_idx")
    n = n.join(r.select(F.col("r_regionkey").alias("n_regionkey"), F.col("path").alias("parent_path")), "n_regionkey")
    n = n.select(F.concat(F.col("parent_path"), F.lit("/"), "name").alias("path"), "parent_path", "name",
                 F.lit("Nation").alias("type_name"), "child_idx", F.lit(2).alias("depth"), "n_nationkey")
    c = row_index(customer.select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey"], ["c_custkey"], "child_idx")
    c = c.join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("path").alias("parent_path")), "c_nationkey")
    c = c.select(F.concat(F.col("parent_path"), F.lit("/"), F.col("child_idx").cast("string")).alias("path"), "parent_path",
                 F.col("child_idx").cast("string").alias("name"), F.initcap("c_mktsegment").alias("type_name"),
                 "child_idx", F.lit(3).alias("depth"), F.col("c_custkey").alias("key"))
    rootdf = region.sparkSession.range(1).select(
        F.lit(root).alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit(root).alias("name"),
        F.lit("Model").alias("type_name"), F.lit(0).cast("long").alias("child_idx"), F.lit(0).alias("depth"))
    cols = ["path", "parent_path", "name", "type_name", "child_idx", "depth", "key"]
    nokey = F.lit(None).cast("long").alias("key")
    nodes = (rootdf.select("*", nokey).unionByName(r.select(*cols[:-1], nokey)).unionByName(n.select(*cols[:-1], nokey))
             .unionByName(c.select(*cols)))
    nch = nodes.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("n_children"))
    return nodes.join(nch, "path", "left").fillna({"n_children": 0})


def closure(modules: DataFrame) -> DataFrame:
    """(anc, path, dist >= 1) for every proper ancestor of every node."""
    parts = F.split("path", "/")
    k = F.sequence(F.lit(1), F.size(parts) - 1)
    x = modules.select("path", F.size(parts).alias("_n"), F.explode(F.when(F.size(parts) > 1, k)).alias("_k"))
    return x.select(F.array_join(F.slice(F.split("path", "/"), 1, F.col("_k")), "/").alias("anc"), "path",
                    (F.col("_n") - F.col("_k")).alias("dist"))


# --- one selector step ---------------------------------------------------------------

def _pred(kind: str, value: str) -> Column:
    if kind == "name":
        return F.col("name") == value
    if kind == "type":
        return F.col("type_name") == value
    if kind == "wildcard":
        return F.lit(True)
    if kind == "name_regex":
        return F.col("name").rlike(value)
    if kind == "type_regex":
        return F.col("type_name").rlike(value)
    raise ValueError(kind)


def _indexed_child(parents: DataFrame, modules: DataFrame, index: int) -> DataFrame:
    """i-th child of each parent (Python-style negative index); none when out of range."""
    p = parents.select(F.col("path").alias("_pp"), "n_children")
    idx = F.when(F.lit(index) < 0, F.col("n_children") + index).otherwise(F.lit(index))
    p = p.withColumn("_ci", idx).filter((F.col("_ci") >= 0) & (F.col("_ci") < F.col("n_children"))).drop("n_children")
    return modules.join(p, (modules.parent_path == p._pp) & (modules.child_idx == p._ci), "inner").select(modules.columns)


def _descendants(ctx: DataFrame, modules: DataFrame, clos: DataFrame, max_depth: int | None = None) -> DataFrame:
    c = clos if max_depth is None else clos.filter(F.col("dist") <= max_depth)
    d = ctx.select(F.col("path").alias("anc")).join(c, "anc").select("path").distinct()
    return modules.join(d, "path", "left_semi")


def _next_matching(modules: DataFrame, pred: Column) -> DataFrame:
    """For every node: child_idx of the first *later* sibling satisfying ``pred`` (or null)."""
    m = modules.withColumn("_hit", F.when(pred, F.col("child_idx")))
    m = m.filter(F.col("parent_path").isNotNull())
    return prefix_agg(m, ["parent_path"], [-F.col("child_idx")], "_hit", "_next", fn="min", exclusive=True)


def apply_step(ctx: DataFrame, step: Step, modules: DataFrame, clos: DataFrame, first: bool) -> DataFrame:
    """Nodes reached from the context by one selector token (deduplicated by path)."""
    comb, kind, value, index = step.combinator, step.kind, step.value, step.index
    cols = modules.columns
    ctxn = modules.join(ctx.select("path").distinct(), "path", "left_semi")
    if index is not None and kind == "name":
        literal = f"{value}[{index}]"
        if comb == CHILD:
            kids = modules.join(ctx.select(F.col("path").alias("parent_path")).distinct(), "parent_path", "left_semi")
            if value == "":
                out = _indexed_child(ctxn, modules, index)
            else:
                lit_hit = kids.filter(F.col("name") == literal)
                via = _indexed_child(kids.filter(F.col("name") == value), modules, index)
                # the literal child wins; otherwise the indexed child of the named child
                have_lit = lit_hit.select("parent_path").distinct()
                out = lit_hit.unionByName(via.join(
                    modules.select(F.col("path").alias("_p"), F.col("parent_path").alias("_gp")), F.col("parent_path") == F.col("_p"))
                    .join(have_lit.withColumnRenamed("parent_path", "_gp"), "_gp", "left_anti").select(cols))
        elif comb in (NEXT, SUBSEQUENT):
            has_idx = F.when(F.lit(index) < 0, F.col("n_children") + index).otherwise(F.lit(index))
            has = (has_idx >= 0) & (has_idx < F.col("n_children"))
            p = has if value == "" else ((F.col("name") == literal) | ((F.col("name") == value) & has))
            out = _sibling(ctxn, modules, p, comb)
        else:
            if first and value != "":
                root_hit = ctxn.filter(F.col("name") == value)
                rest = ctxn.join(root_hit.select("path"), "path", "left_anti")
            else:
                root_hit, rest = ctxn.limit(0), ctxn
            found = _descendants(rest, modules, clos)
            if value == "":
                out = _indexed_child(found, modules, index)
            else:
                out = found.filter(F.col("name") == literal).unionByName(
                    _indexed_child(found.filter(F.col("name") == value), modules, index))
            out = out.unionByName(_indexed_child(root_hit, modules, index))
        return out.select(cols).dropDuplicates(["path"])
    pred = _pred(kind, value)
    if comb == CHILD:
        out = modules.join(ctx.select(F.col("path").alias("parent_path")).distinct(), "parent_path", "left_semi").filter(pred)
    elif comb in (NEXT, SUBSEQUENT):
        out = _sibling(ctxn, modules, pred, comb)
    else:
        if first and kind in ("name", "wildcard"):
            root_hit = ctxn.filter(pred)
            if kind == "name":
                # a start node that matches the first name token is the match; no descent below it
                rest = ctxn.join(root_hit.select("path"), "path", "left_anti")
                out = root_hit.unionByName(_descendants(rest, modules, clos).filter(pred))
            else:
                out = ctxn.unionByName(_descendants(ctxn, modules, clos))
        else:
            out = _descendants(ctxn, modules, clos).filter(pred)
    return out.select(cols).dropDuplicates(["path"])


def _sibling(ctxn: DataFrame, modules: DataFrame, pred: Column, comb: str) -> DataFrame:
    if comb == NEXT:
        nxt = _next_matching(modules, pred).select("path", "parent_path", "_next")
        hits = nxt.join(ctxn.select("path"), "path", "left_semi").filter(F.col("_next").isNotNull())
        hits = hits.select(F.col("parent_path").alias("_pp"), F.col("_next").alias("_ci")).distinct()
        return modules.join(hits, (modules.parent_path == hits._pp) & (modules.child_idx == hits._ci)).select(modules.columns)
    first_ctx = ctxn.filter(F.col("parent_path").isNotNull()).groupBy("parent_path").agg(F.min("child_idx").alias("_m"))
    return (modules.join(first_ctx, "parent_path").filter((F.col("child_idx") > F.col("_m")) & pred)
            .select(modules.columns))


def select_modules(modules: DataFrame, clos: DataFrame, steps: Sequence[Step], start: DataFrame | None = None,
                   include_descendants: bool = False, max_depth: int | None = None) -> tuple[DataFrame, list]:
    """E-01..E-11: run the steps from the root (or ``start``); returns the matched
    nodes and the list of per-step frames (for E-12 diagnostics)."""
    ctx = start if start is not None else modules.filter(F.col("depth") == 0)
    trail = []
    for i, st in enumerate(steps):
        first = i == 0
        ctx = apply_step(ctx, st, modules, clos, first)
        trail.append(ctx)
    if include_descendants:
        ctx = ctx.unionByName(_descendants(ctx, modules, clos, max_depth)).dropDuplicates(["path"])
    return ctx, trail


def selector_diagnostics(trail: Sequence[DataFrame], steps: Sequence[Step]) -> DataFrame:
    """E-12: matches after each token and the first token at which the selection became empty."""
    counts = None
    for i, (df, st) in enumerate(zip(trail, steps)):
        c = df.agg(F.count("*").alias("n_matched")).select(
            F.lit(i).alias("token_idx"), F.lit(f"{st.combinator}:{st.kind}:{st.value}" + ("" if st.index is None else f"[{st.index}]")).alias("token"),
            "n_matched")
        counts = c if counts is None else counts.unionByName(c)
    first_empty = counts.filter(F.col("n_matched") == 0).agg(F.min("token_idx")).scalar()
    return counts.withColumn("failed_here", F.coalesce(F.col("token_idx") == first_empty, F.lit(False)))


# --- parameters and ops -----------------------------------------------------------------

def select_params(matched: DataFrame, params: DataFrame, name: str | None = None, regex: str | None = None) -> DataFrame:
    """E-13: parameters / buffers of matched modules: ``#name``, ``*`` (None), or a regex."""
    p = params.join(matched.select("path"), "path", "left_semi")
    if name is not None:
        p = p.filter(F.col("param_name") == name)
    if regex is not None:
        p = p.filter(F.col("param_name").rlike(regex))
    return p


def select_site(captures: DataFrame, site: str) -> DataFrame:
    """E-14: captures taken at module entry ('input') or exit ('output')."""
    return captures.filter(F.col("site") == site)


def op_simple(oplog: DataFrame, matched: DataFrame, op: str | None = None, regex: str | None = None) -> DataFrame:
    """E-15: ops executed inside matched modules (semi join), by name, ``*`` or regex."""
    o = oplog.join(matched.select(F.col("path").alias("module_path")), "module_path", "left_semi")
    if op is not None:
        o = o.filter(F.col("op") == op)
    if regex is not None:
        o = o.filter(F.col("op").rlike(regex))
    return o


def op_next(oplog: DataFrame, a: str, b: str) -> DataFrame:
    """E-16 ``a + b``: b immediately after a in its module's execution order."""
    x = lag_value(oplog, ["module_path"], ["seq"], "op", "_prev")
    return x.filter((F.col("op") == b) & (F.col("_prev") == a)).drop("_prev")


def op_subsequent(oplog: DataFrame, a: str, b: str) -> DataFrame:
    """E-17 ``a ~ b``: b after some earlier a of the same module (never consumed)."""
    x = oplog.withColumn("_isa", F.when(F.col("op") == a, 1).otherwise(0))
    x = prefix_agg(x, ["module_path"], ["seq"], "_isa", "_seen_a", fn="max", exclusive=True)
    return x.filter((F.col("op") == b) & (F.col("_seen_a") == 1)).drop("_isa", "_seen_a")


# --- E-18 chains: a bit automaton, folded in chunks -----------------------------------

#: Ops folded in one list.
CHUNK_OPS = 512


def chain_table(items: Sequence[str], relations: Sequence[str]) -> tuple[dict, list[int], list[bool]]:
    """The chain as a table: symbols of ops, next states and completions.

    A state is a set of progresses as bits: bit j says that items 0..j have been met.  An op
    with bit j set in ``met`` is item j.  It moves a progress j - 1 up to j, starts progress 0,
    and a progress that waits for a later op (SUBSEQUENT) stays where the op is not its next
    item; one that needs the very next op is dropped.  Reaching the last item completes the
    chain and uses that progress up.  Ops that are no item share one symbol.  Row ``symbol *
    states + state`` of the two lists tells the next state and whether the op completes."""
    k, states = len(items), 1 << (len(items) - 1)
    waits = sum(1 << j for j, r in enumerate(relations) if r != NEXT)
    symbols = {op: n for n, op in enumerate(dict.fromkeys(items))}
    met = [sum(1 << j for j, x in enumerate(items) if x == op) for op in symbols] + [0]
    after, done = [], []
    for m in met:
        for state in range(states):
            moved = (state << 1 | 1) & m | state & waits & ~(m >> 1)
            after.append(moved & (states - 1))
            done.append(bool(moved >> (k - 1) & 1))
    return symbols, after, done


def op_chain(oplog: DataFrame, items: Sequence[str], relations: Sequence[str], n: int | None = None) -> DataFrame:
    """E-18: ops that complete a chain of ``+`` (NEXT) / ``~`` (SUBSEQUENT) relations, with
    overlapping progresses (see :func:`chain_table`).

    A module's ordered ops lie in range blocks, and a block in chunks of ``CHUNK_OPS``.  Each
    chunk is folded to the table of where every state leads; tables are composed over the
    chunks of a block and then over a module's blocks, which gives every chunk its entry
    state, from which it is run once more to find the completions.  All in array functions; no
    list is longer than a chunk, or a block's chunks, or a module's blocks."""
    if len(relations) != len(items) - 1:
        raise ValueError("need one relation between consecutive items")
    symbols, after, done = chain_table(items, relations)
    states = 1 << (len(items) - 1)
    after, done = F.array(*map(F.lit, after)), F.array(*map(F.lit, done))
    symbol = F.coalesce(*[F.when(F.col("op") == op, F.lit(i)) for op, i in symbols.items()], F.lit(len(symbols)))

    def cell(table, state, sym):
        return F.element_at(table, sym * states + state + 1)

    def composed(tables):  # where each state leads through a list of tables
        return F.aggregate(tables, F.sequence(F.lit(0), F.lit(states - 1)),
                           lambda acc, x: F.transform(acc, lambda s: F.element_at(x["table"], s + 1)))

    def entries(tables, first):  # the state before each table of a list
        start = F.struct(first.alias("s"), F.array().cast("array<struct<at:bigint,entry:int>>").alias("out"))
        return F.aggregate(tables, start, lambda acc, x: F.struct(
            F.element_at(x["table"], acc["s"] + 1).alias("s"),
            F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), acc["s"].alias("entry")))).alias("out")))["out"]

    b = blocked(oplog.select("module_path", "seq", "op", symbol.alias("sym")), ["module_path"], ["seq"], n)
    nth = F.row_number().over(Window.partitionBy(BLK, "module_path").orderBy("seq")) - 1
    chunks = (b.withColumn("chunk", F.floor(nth / CHUNK_OPS)).groupBy("module_path", BLK, "chunk")
              .agg(F.array_sort(F.collect_list(F.struct("seq", "op", "sym"))).alias("ops")))
    chunks = stage_table(chunks.withColumn("table", F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s0: F.aggregate(
        "ops", s0, lambda s, x: cell(after, s, x["sym"])))), "chain-chunks")
    blocks = chunks.groupBy("module_path", BLK).agg(F.array_sort(F.collect_list(F.struct(F.col("chunk").alias("at"), "table"))).alias("tables"))
    modules = blocks.groupBy("module_path").agg(F.array_sort(F.collect_list(F.struct(
        F.col(BLK).cast("long").alias("at"), composed("tables").alias("table")))).alias("tables"))
    of_block = modules.select("module_path", F.explode(entries(F.col("tables"), F.lit(0))).alias("e")) \
        .select("module_path", F.col("e.at").cast("int").alias(BLK), "e.entry")
    of_chunk = _join_offsets(blocks, of_block, ["module_path"]).select(
        "module_path", BLK, F.explode(entries(F.col("tables"), F.col("entry"))).alias("e")) \
        .select("module_path", BLK, F.col("e.at").alias("chunk"), "e.entry")
    run = F.aggregate("ops", F.struct(F.col("entry").alias("s"), F.array().cast("array<struct<seq:bigint,op:string>>").alias("hits")),
                      lambda acc, x: F.struct(cell(after, acc["s"], x["sym"]).alias("s"), F.when(
                          cell(done, acc["s"], x["sym"]), F.concat(acc["hits"], F.array(F.struct(x["seq"].alias("seq"), x["op"].alias("op")))))
                          .otherwise(acc["hits"]).alias("hits")))["hits"]
    return _join_offsets(chunks, of_chunk, ["module_path", "chunk"]).select("module_path", F.explode(run).alias("h")) \
        .select("module_path", "h.seq", "h.op")


def module_index(oplog: DataFrame) -> DataFrame:
    """E-24: per module — op count, distinct ops, first and last position in execution order."""
    return oplog.groupBy("module_path").agg(F.count("*").alias("n_ops"), F.sort_array(F.collect_set("op")).alias("ops"),
                                            F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


# --- capture post-processing ---------------------------------------------------------------

def slice_capture(values: Column, shape: Sequence[int], spec: Sequence) -> Column:
    """E-19 on a row-major captured tensor stored as an array with a known ``shape``.

    ``spec`` items: ``(a, b)`` half-open range (None = open end), an int index
    (dimension dropped), or ``...`` (Ellipsis) filling the missing dims; dims not
    given are taken whole; too many dims raise; steps are not supported."""
    spec = list(spec)
    if spec.count(Ellipsis) > 1:
        raise ValueError("only one ellipsis allowed")
    if Ellipsis in spec:
        k = spec.index(Ellipsis)
        spec = spec[:k] + [(None, None)] * (len(shape) - len(spec) + 1) + spec[k + 1:]
    if len(spec) > len(shape):
        raise ValueError("too many indices for the captured tensor")
    spec = spec + [(None, None)] * (len(shape) - len(spec))
    ranges = []
    for s, n in zip(spec, shape):
        if isinstance(s, int):
            i = s + n if s < 0 else s
            ranges.append((i, i + 1))
        else:
            a, b = s
            a = 0 if a is None else (a + n if a < 0 else a)
            b = n if b is None else (b + n if b < 0 else b)
            ranges.append((max(0, a), min(n, b)))
    # flat indices of the kept elements, in row-major order (a literal array: shape is small metadata)
    import itertools
    strides = [1] * len(shape)
    for d in range(len(shape) - 2, -1, -1):
        strides[d] = strides[d + 1] * shape[d + 1]
    flat = [sum(i * s for i, s in zip(idx, strides)) for idx in itertools.product(*[range(a, b) for a, b in ranges])]
    return F.transform(F.array(*[F.lit(f + 1) for f in flat]), lambda p: F.element_at(values, p)) if flat else \
        F.array().cast("array<double>")


def capture_facets(values: Column, scale: float | str | None = None, normalize: bool = False) -> Column:
    """E-20: scale factor (``"50%"`` -> 0.5, default 1) and the z-score ``norm`` flag."""
    from weft.functions import arrays as A
    f = 1.0
    if isinstance(scale, str) and scale.endswith("%"):
        f = float(scale[:-1]) / 100.0
    elif scale is not None:
        f = float(scale)
    v = F.transform(A.dbl(values), lambda x: x * f)
    if normalize:
        v = A.let(v, lambda xv: A.let(A.amean(xv), lambda m: A.let(
            F.greatest(F.lit(0.0), A.asumsq(xv) / F.size(xv) - m * m), lambda var: F.transform(
                xv, lambda x: (x - m) * (1.0 / F.sqrt(var + F.lit(1e-5)))))))
    return v


def capture_values(matches: DataFrame, shape: Sequence[int], spec: Sequence = (), pipe=None, scale: float | str | None = None,
                   normalize: bool = False, grad: bool = False, label: str | None = None, values: str = "values",
                   gradients: str = "gradients") -> DataFrame:
    """E-20 / E-21: matches with what a selector's facets make of their captured tensors, in ``values``.

    ``grad`` takes the gradient instead of the value (null where none was kept); ``pipe``, a
    function of the whole array column, comes before the slice ``spec``; then scale and norm.
    ``label`` is a column of its own, by default the match's path."""
    captured = v = F.col(gradients if grad else values)
    if pipe is not None:
        v = pipe(v)
    if spec:
        v = slice_capture(v, shape, spec)
    rest = [c for c in matches.columns if c not in (values, gradients, "label")]
    return matches.select(*rest, (F.col("path") if label is None else F.lit(label)).alias("label"),
                          F.when(captured.isNotNull(), capture_facets(v, scale, normalize)).alias(values))


def flatten_matches(matches: DataFrame, values: str = "values", query_idx: str = "query_idx") -> DataFrame:
    """E-22: one row per captured element with id ``path:index:query`` (array-of-array matches skipped)."""
    m = matches.filter(~F.col(values).isNull())
    x = m.select("*", F.posexplode(values).alias("elem_idx", "val"))
    return x.withColumn("match_id", F.concat_ws(":", F.col("path"), F.col("elem_idx").cast("string"),
                                                F.col(query_idx).cast("string"))).drop(values)


def multi_query(results: Sequence[DataFrame]) -> DataFrame:
    """E-23: several selector results at once, tagged with their query index."""
    out = None
    for i, r in enumerate(results):
        q = r.withColumn("query_idx", F.lit(i))
        out = q if out is None else out.unionByName(q)
    return out
