"""Chat formatting by schema fingerprints, with DataFrame operations only.

Layouts: those of a record's nested field paths (``messages[].role``, ``instruction`` ...) that
any mapping knows are hashed to a fingerprint, and a declarative mapping that says where turns
come from is looked up by it.  Tables have one fingerprint, taken from their schema.  Columns
of JSON records have one a row, taken from the parsed value, so mixed layouts are told apart
row by row.  Either way the result is canonical turns ``(conv_id, turn, role, text)``.

Template: ``<turn:ROLE>TEXT</turn>`` and a line feed, one rendered row a turn, so a
conversation of any length is never one row here.  In roles and texts a backslash becomes
``\\\\s``, ``<`` becomes ``\\\\l`` and ``>`` becomes ``\\\\g``: no control string is left in them and the
change is reversible.  The loss mask is the span of the escaped assistant text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mappings: field paths of the layout -> how its turns are read.  ``rows``: each row is a turn;
#: ``list``: a list of turns with role and text names; ``fields``: turns from single fields.
MAPPINGS = [
    {"paths": ("conv_id", "turn", "role", "text"), "rows": ("conv_id", "turn", "role", "text")},
    {"paths": ("conv_id", "turn", "role", "content"), "rows": ("conv_id", "turn", "role", "content")},
    {"paths": ("messages[].role", "messages[].content"), "list": ("messages", "role", "content")},
    {"paths": ("conversations[].from", "conversations[].value"), "list": ("conversations", "from", "value")},
    {"paths": ("turns[].role", "turns[].text"), "list": ("turns", "role", "text")},
    {"paths": ("prompt", "completion"), "fields": (("user", ("prompt",)), ("assistant", ("completion",)))},
    {"paths": ("prompt", "response"), "fields": (("user", ("prompt",)), ("assistant", ("response",)))},
    {"paths": ("question", "answer"), "fields": (("user", ("question",)), ("assistant", ("answer",)))},
    {"paths": ("system", "prompt", "completion"),
     "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))},
    {"paths": ("instruction", "output"), "fields": (("user", ("instruction",)), ("assistant", ("output",)))},
    {"paths": ("instruction", "input", "output"), "fields": (("user", ("instruction", "input")), ("assistant", ("output",)))},
]
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}

ASSISTANT = "assistant"


def field_paths(schema: T.StructType) -> list[str]:
    """Nested field paths of a schema: ``a``, ``a.b``, ``a[].b``."""
    def walk(kind, path):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(kind, T.ArrayType):
            yield from walk(kind.elementType, f"{path}[]")
        else:
            yield path
    return list(walk(schema, ""))


def fingerprint_of(paths) -> str:
    """Fingerprint of a set of field paths: SHA-256 of the sorted paths, one a line."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: Fingerprint -> mapping: of tables of turns and of records.
TABLES = {fingerprint_of(m["paths"]): m for m in MAPPINGS if "rows" in m}
RECORDS = {fingerprint_of(m["paths"]): m for m in MAPPINGS if "rows" not in m}


def _known(mappings) -> list[str]:
    return sorted({p for m in mappings.values() for p in m["paths"]})


def _has(record, path: str):
    """Whether a variant column has a field path; an empty list has every path below it."""
    if "[]." not in path:
        return F.try_variant_get(record, f"$.{path}", "variant").isNotNull()
    at, field = path.split("[].")
    items = F.try_variant_get(record, f"$.{at}", "array<variant>")
    return F.coalesce((F.size(items) == 0) | F.exists(items, lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull()), F.lit(False))


def fingerprint(record):
    """Fingerprint of a variant column: of those field paths that any mapping of records knows."""
    paths = F.array_compact(F.array(*[F.when(_has(record, p), F.lit(p)) for p in _known(RECORDS)]))
    return F.sha2(F.array_join(paths, "\n"), 256)


def _role(col):
    pairs = [F.lit(x) for kv in ROLES.items() for x in kv]
    low = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    return F.coalesce(F.element_at(F.create_map(*pairs), low), low)


def _listed(at: str, role: str, text: str):
    """Turns of a list of objects in the variant ``v``."""
    return F.transform(F.try_variant_get("v", f"$.{at}", "array<variant>"), lambda x: F.struct(
        F.try_variant_get(x, f"$.{role}", "string").alias("role"), F.try_variant_get(x, f"$.{text}", "string").alias("text")))


def turns_of_records(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Mixed JSON records, one conversation a row -> ``(conv_id, turn, role, text, layout)``.

    ``layout`` is the fingerprint; further keys do not matter.  Records of no known layout, nulls and malformed JSON give one
    turn with null role and text, so that nothing is lost unseen; empty lists give no turn.
    """
    v = df.select(F.col(id_col).cast("long").alias("conv_id"), F.try_parse_json(json_col).alias("v")) \
        .withColumn("layout", fingerprint("v"))
    empty = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))
    pick = F.when(F.lit(False), empty)
    for layout, m in RECORDS.items():
        if "list" in m:
            turns = _listed(*m["list"])
        else:
            turns = F.array(*[F.struct(F.lit(r).alias("role"), F.concat_ws("\n\n", *[
                F.nullif(F.try_variant_get("v", f"$.{f}", "string"), F.lit("")) for f in fields]).alias("text"))
                for r, fields in m["fields"]])
        pick = pick.when(F.col("layout") == layout, turns)
    return v.select("conv_id", "layout", F.posexplode(F.coalesce(pick.otherwise(empty), empty)).alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("t.role").isNotNull(), _role(F.col("t.role"))).alias("role"),
        "t.text", "layout")


def turns_of_table(df: DataFrame) -> DataFrame:
    """A table of turns -> ``(conv_id, turn, role, text)``: the mapping is selected by the fingerprint
    of the schema's known paths, so further columns don't matter.  Raises for other layouts."""
    have = set(field_paths(df.schema)) & set(_known(TABLES))
    if "text" in have:  # both names of the text: the plain one counts
        have.discard("content")
    layout = TABLES.get(fingerprint_of(have))
    if layout is None:
        raise ValueError(f"no mapping for the layout {sorted(have)}")
    conv, turn, role, text = layout["rows"]
    return df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                     F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def escape(col):
    for raw, code in (("\\", "\\s"), ("<", "\\l"), (">", "\\g")):
        col = F.replace(col, F.lit(raw), F.lit(code))
    return col


def unescape(col):
    for raw, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\s")):
        col = F.replace(col, F.lit(code), F.lit(raw))
    return col


def format_turns(turns: DataFrame) -> DataFrame:
    """Canonical turns -> ``(conv_id, turn, piece, loss_start, loss_end)``: the rendered turn and, in
    code points within it, the span that counts in the loss (empty but for the assistant).

    Joined in order of turn (ties: by piece) the pieces are the formatted conversation.  Null roles
    and texts count as empty; a null conv_id is a conversation of its own.
    """
    head = F.concat(F.lit("<turn:"), escape(F.coalesce("role", F.lit(""))), F.lit(">"))
    body = escape(F.coalesce("text", F.lit("")))
    start = F.when(F.col("role") == ASSISTANT, F.length(head)).otherwise(0)
    return turns.select("conv_id", "turn", F.concat(head, body, F.lit("</turn>\n")).alias("piece"), start.alias("loss_start"),
                        F.when(F.col("role") == ASSISTANT, start + F.length(body)).otherwise(0).alias("loss_end"))


def parse_turns(pieces: DataFrame) -> DataFrame:
    """What :func:`format_turns` wrote, read back: ``conv_id, turn, piece, role, text, loss`` (the
    unescaped text under the mask, null where there is none)."""
    head_end = F.instr("piece", ">")
    end = F.length("piece") - F.lit(len("</turn>\n"))
    return pieces.select(
        "conv_id", "turn", "piece",
        unescape(F.substring("piece", F.lit(len("<turn:") + 1), head_end - F.lit(len("<turn:") + 1))).alias("role"),
        unescape(F.substring("piece", head_end + 1, end - head_end)).alias("text"),
        F.when(F.col("loss_end") > 0, unescape(F.substring("piece", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))).alias("loss"))


def conversation_digests(parsed: DataFrame) -> DataFrame:
    """Per conversation: ``n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    A digest of a conversation is sequential over it, so here (and only here) its turns are
    brought together, ordered by turn and then by piece.
    """
    of = parsed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "piece", "role", "text", "loss"))).alias("t"))
    turns = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("t", lambda x: F.coalesce(x["loss"], F.lit(""))), "")
    return of.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                     F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                     F.length(F.array_join(F.transform("t", lambda x: x["piece"]), "")).cast("long").alias("formatted_chars"))
