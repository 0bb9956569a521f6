"""Deterministic synthetic sequence tasks (B-23 .. B-41).

Each generator is a pure function of (seed, sample index): draw k of sample i is
``uniform(seed, i, k)``, so any index regenerates its sample on its own (B-39),
whatever the partitioning, and generation is a narrow projection over an index
column (one sample per input row).  The draws of a sample are one array, made in Arrow
batches (``hashing.draws``); the task rules are column expressions over it.  The reference's Mersenne-Twister streams are
not reproduced; the task rules are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.arrays import let
from weft.functions.hashing import draws


def _draws(seed, idx, start: int, length: int, n: int) -> Column:
    """Integers in [0, n) from the draws start, start + 1, .."""
    return draws(seed, idx, range(start, start + length), n)


def _below(u: Column, n) -> Column:
    """Integer in [0, n) from a uniform draw."""
    return F.floor(u * n).cast("int")


def addition(idx: Column, seed: int, max_value: int = 20) -> tuple[Column, Column]:
    """B-23: sum in [0, max], a in [0, sum-1] (0 when sum = 0), b = sum - a; prompt ``a + b =``
    (ids: numbers 0..max, '+' = max+1, '=' = max+2); target [sum]."""
    u = draws(seed, idx, range(2))
    s = _below(u[0], max_value + 1)
    a = F.when(s == 0, F.lit(0)).otherwise(_below(u[1], s))
    return F.array(a, F.lit(max_value + 1), s - a, F.lit(max_value + 2)), F.array(s)


def modular_addition(idx: Column, seed: int, max_value: int = 500, mod: int = 113) -> tuple[Column, Column]:
    """B-24: the same pair draw, target = sum mod m."""
    p, t = addition(idx, seed, max_value)
    return p, F.array(F.pmod(t[0], F.lit(mod)))


def parity(idx: Column, seed: int, length: int = 4) -> tuple[Column, Column]:
    """B-29: random bits; target 0 (even) / 1 (odd) number of ones."""
    bits = _draws(seed, idx, 0, length, 2)
    return bits, F.array(F.pmod(F.aggregate(bits, F.lit(0), lambda a, b: a + b), F.lit(2)))


def random_task(idx: Column, seed: int, length: int = 5, response: int = 1, vocab: int = 10) -> tuple[Column, Column]:
    """B-30: independent prompt and target tokens."""
    return _draws(seed, idx, 0, length, vocab), _draws(seed, idx, length, response, vocab)


def repeat(idx: Column, seed: int, length: int = 3, alphabet: int = 5) -> tuple[Column, Column]:
    """B-31: target = the prompt items."""
    p = _draws(seed, idx, 0, length, alphabet)
    return p, p


def reverse(idx: Column, seed: int, length: int = 3, alphabet: int = 5) -> tuple[Column, Column]:
    """B-32: target = reversed prompt."""
    p = _draws(seed, idx, 0, length, alphabet)
    return p, F.reverse(p)


def sort_task(idx: Column, seed: int, length: int = 5, alphabet: int = 26) -> tuple[Column, Column]:
    """B-33: target = prompt sorted ascending."""
    p = _draws(seed, idx, 0, length, alphabet)
    return p, F.array_sort(p)


def zeros(idx: Column, seed: int, length: int = 5) -> tuple[Column, Column]:
    """B-37: no prompt, all-zero target."""
    return F.array().cast("array<int>"), F.array_repeat(F.lit(0), length)


JACK = 10  # card 'J' among 13 card ranks 0..12


def slap_rule(cards: Column) -> Column:
    """B-34 / B-40: slap (1) at a position whose card is J, equals the previous card, or the one two back."""
    return let(cards, lambda all_: F.transform(all_, lambda c, i: F.when(
        (c == JACK) | ((i >= 1) & (c == F.try_element_at(all_, i))) | ((i >= 2) & (c == F.try_element_at(all_, i - 1))),
        F.lit(1)).otherwise(F.lit(0))))


def slapjack(idx: Column, seed: int, length: int = 5) -> tuple[Column, Column]:
    cards = _draws(seed, idx, 0, length, 13)
    return cards, slap_rule(cards)


def marked_addition(idx: Column, seed: int, length: int = 8, max_input: int = 10, max_sum: int = 30) -> tuple[Column, Column]:
    """B-25: (value, mark) pairs, marks M0 = max_input+1, M1 = max_input+2; target = sum of the
    values marked M1, clamped to max_sum."""
    vals = _draws(seed, idx, 0, length, max_input + 1)
    marks = _draws(seed, idx, length, length, 2)
    prompt = F.flatten(F.zip_with(vals, marks, lambda v, m: F.array(v, m + max_input + 1)))
    s = F.aggregate(F.zip_with(vals, marks, lambda v, m: v * m), F.lit(0), lambda a, b: a + b)
    return prompt, F.array(F.least(s, F.lit(max_sum)))


def copy_memory(idx: Column, seed: int, prefix: int = 3, distractors: int = 12, vocab: int = 10) -> tuple[Column, Column]:
    """B-26: prefix tokens, then distractors (blank id = vocab) and a '?' (vocab + 1); target = prefix."""
    p = _draws(seed, idx, 0, prefix, vocab)
    return F.concat(p, F.array_repeat(F.lit(vocab), distractors), F.array(F.lit(vocab + 1))), p


def temporal_order(idx: Column, seed: int, length: int = 13, vocab: int = 10) -> tuple[Column, Column]:
    """B-35: one X (id vocab) and one Y (id vocab+1) at distinct positions among fillers;
    target [X, Y] or [Y, X] by order of appearance.  Needs length >= 2."""
    if length < 2:
        raise ValueError("temporal order needs length >= 2")
    u, fill = draws(seed, idx, range(2)), _draws(seed, idx, 2, length, vocab)
    px = _below(u[0], length)
    q = _below(u[1], length - 1)
    py = F.when(q >= px, q + 1).otherwise(q)
    prompt = let(F.struct(fill.alias("fill"), px.alias("px"), py.alias("py")), lambda c: F.transform(
        c["fill"], lambda f, i: F.when(i == c["px"], F.lit(vocab)).when(i == c["py"], F.lit(vocab + 1)).otherwise(f)))
    tgt = F.when(px < py, F.array(F.lit(vocab), F.lit(vocab + 1))).otherwise(F.array(F.lit(vocab + 1), F.lit(vocab)))
    return prompt, tgt


def dyck(idx: Column, seed: int, length: int = 10, order: int = 2) -> tuple[Column, Column]:
    """B-27: balanced brackets of exactly ``length`` (odd rounded down) by a stack walk:
    open when the stack is empty, close when the rest must close, else close with p = 0.5.
    Open bracket of type t = 2t, its close = 2t + 1.  Target = the sequence; the mask
    (``dyck_mask``) marks closing positions."""
    n = length - (length % 2)

    def step(acc, k, u):
        stack, out = acc["stack"], acc["out"]
        depth = F.size(stack)
        remaining = F.lit(n) - k
        must_close = depth >= remaining
        close = (depth > 0) & (must_close | (u[k * 2] < 0.5))
        t = F.floor(u[k * 2 + 1] * order).cast("int")
        top = F.try_element_at(stack, F.lit(-1))
        new_stack = F.when(close, F.slice(stack, 1, depth - 1)).otherwise(F.concat(stack, F.array(t)))
        tok = F.when(close, top * 2 + 1).otherwise(t * 2)
        return F.struct(new_stack.alias("stack"), F.concat(out, F.array(tok)).alias("out"))
    init = F.struct(F.array().cast("array<int>").alias("stack"), F.array().cast("array<int>").alias("out"))
    seq = let(draws(seed, idx, range(2 * n)), lambda u: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), init, lambda acc, k: step(acc, k, u))[
        "out"]) if n > 0 else F.array().cast("array<int>")
    return F.array().cast("array<int>"), seq


def dyck_mask(seq: Column) -> Column:
    return F.transform(seq, lambda t: F.pmod(t, F.lit(2)) == 1)


TASKS = {
    "addition": addition, "modular_addition": modular_addition, "parity": parity, "random": random_task,
    "repeat": repeat, "reverse": reverse, "sort": sort_task, "zeros": zeros, "slapjack": slapjack,
    "marked_addition": marked_addition, "copy_memory": copy_memory, "temporal_order": temporal_order, "dyck": dyck,
}


def task_vocab_size(task: str, **kw) -> int:
    """B-38 (sizes): task tokens + bos, eos, mask appended after them."""
    base = {"addition": kw.get("max_value", 20) + 3, "modular_addition": kw.get("max_value", 500) + 3,
            "parity": 2, "random": kw.get("vocab", 10), "repeat": kw.get("alphabet", 5),
            "reverse": kw.get("alphabet", 5), "sort": kw.get("alphabet", 26), "zeros": 1, "slapjack": 13,
            "marked_addition": kw.get("max_input", 10) + 3, "copy_memory": kw.get("vocab", 10) + 2,
            "temporal_order": kw.get("vocab", 10) + 2, "dyck": 2 * kw.get("order", 2)}[task]
    return base + 3


def round_vocab(n: int | Column, multiple: int = 8) -> Column:
    """B-41: vocabulary size rounded up to a multiple."""
    c = n if isinstance(n, Column) else F.lit(n)
    return (F.ceil(c / multiple) * multiple).cast("long")


def label_rules(seq: Column) -> dict[str, Column]:
    """B-40: the task rules applied to any int array (sum, parity, sort, reverse, slap, repeat)."""
    s = F.aggregate(seq, F.lit(0).cast("long"), lambda a, x: a + x)
    return {"sum": s, "parity": F.pmod(s, F.lit(2)), "sorted": F.array_sort(seq), "reversed": F.reverse(seq),
            "slaps": slap_rule(seq), "repeat": seq}


# --- Elman grammar (B-28) and its template metrics (D-08) --------------------------------

# fixed values: word categories and the 16 three-slot sentence templates (None = PAD)
ELMAN_CATEGORIES = {
    "NOUN_HUM": ["man", "woman", "boy", "girl"],
    "NOUN_ANIM": ["cat", "mouse", "dog"],
    "NOUN_INANIM": ["book", "rock", "pencil"],
    "NOUN_AGRESS": ["dragon", "monster"],
    "NOUN_FRAG": ["glass", "plate"],
    "NOUN_FOOD": ["apple", "banana", "orange", "pie", "pizza", "sandwich"],
    "VERB_INTRAN": ["think", "sleep"],
    "VERB_TRAN": ["see", "chase"],
    "VERB_AGPAT": ["move", "break"],
    "VERB_PERCEPT": ["smell", "see"],
    "VERB_DESTROY": ["break", "smash"],
    "VERB_EAT": ["eat", "consume"],
}
ELMAN_TEMPLATES = [
    ["NOUN_HUM", "VERB_EAT", "NOUN_FOOD"],
    ["NOUN_HUM", "VERB_PERCEPT", "NOUN_INANIM"],
    ["NOUN_HUM", "VERB_DESTROY", "NOUN_FRAG"],
    ["NOUN_HUM", "VERB_INTRAN", None],
    ["NOUN_HUM", "VERB_TRAN", "NOUN_HUM"],
    ["NOUN_HUM", "VERB_AGPAT", "NOUN_INANIM"],
    ["NOUN_HUM", "VERB_AGPAT", None],
    ["NOUN_ANIM", "VERB_EAT", "NOUN_FOOD"],
    ["NOUN_ANIM", "VERB_TRAN", "NOUN_ANIM"],
    ["NOUN_ANIM", "VERB_AGPAT", "NOUN_INANIM"],
    ["NOUN_ANIM", "VERB_AGPAT", None],
    ["NOUN_INANIM", "VERB_AGPAT", None],
    ["NOUN_AGRESS", "VERB_DESTROY", "NOUN_FRAG"],
    ["NOUN_AGRESS", "VERB_EAT", "NOUN_HUM"],
    ["NOUN_AGRESS", "VERB_EAT", "NOUN_ANIM"],
    ["NOUN_AGRESS", "VERB_EAT", "NOUN_FOOD"],
]


def elman_vocab() -> list[str]:
    """Words in first-seen order over the categories, then PAD (bos/eos/mask follow)."""
    seen = []
    for words in ELMAN_CATEGORIES.values():
        for w in words:
            if w not in seen:
                seen.append(w)
    return seen + ["PAD"]


def _elman_templates_literal() -> Column:
    def slot(s):
        return F.lit(None).cast("array<string>") if s is None else F.array(*[F.lit(w) for w in ELMAN_CATEGORIES[s]])
    return F.array(*[F.array(*[slot(s) for s in t]) for t in ELMAN_TEMPLATES])


def elman(idx: Column, seed: int) -> tuple[Column, Column]:
    """B-28: a template (draw 0), then one word per slot (draw 1 + slot); PAD for empty slots.
    Returns (words, ids) with ids = positions in ``elman_vocab()``."""
    words = let(draws(seed, idx, range(1 + len(ELMAN_TEMPLATES[0]))), lambda u: F.transform(
        F.element_at(_elman_templates_literal(), _below(u[0], len(ELMAN_TEMPLATES)) + 1),
        lambda s, j: F.when(s.isNull(), F.lit("PAD")).otherwise(F.element_at(s, _below(u[j + 1], F.size(s)) + 1))))
    vocab = elman_vocab()
    m = F.create_map(*[x for i, w in enumerate(vocab) for x in (F.lit(w), F.lit(i))])
    return words, F.transform(words, lambda w: m[w])


def elman_metrics(words: Column) -> Column:
    """D-08: best in-order prefix match of the first (up to) three words against every
    template; per-token matches; length_correct (3 words), matched_template / valid_statement."""
    n = F.least(F.size(words), F.lit(3))

    def prefix(tpl):
        def step(acc, i):
            s = F.element_at(tpl, i + 1)
            w = F.element_at(words, i + 1)
            ok = F.when(s.isNull(), w == "PAD").otherwise(F.array_contains(s, w))
            go = acc["go"] & (i < n) & ok
            return F.struct(go.alias("go"), (acc["k"] + F.when(go, 1).otherwise(0)).alias("k"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(2)), F.struct(F.lit(True).alias("go"), F.lit(0).alias("k")), step)["k"]
    best = F.array_max(F.transform(_elman_templates_literal(), prefix))
    matches = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(-1))), lambda i: i < best)
    return F.struct(best.alias("best_prefix"), (F.size(words) == 3).alias("length_correct"),
                    (best == 3).alias("matched_template"), (best == 3).alias("valid_statement"),
                    F.when(n > 0, matches).otherwise(F.array().cast("array<boolean>")).alias("matches"))


def two_sum(idx: Column, seed: int, length: int = 4, max_number: int = 15) -> tuple[Column, Column]:
    """B-36: ``length`` numbers and a sum t that exactly one pair of places makes; the answer is the pair.

    Built without trial: a and b (draws 0, 1) stand at two different places (draws 2, 3).  Of
    the other values one member of every couple {v, t - v} is struck out by a coin, and so are
    a, b and t / 2; whatever fills the free places, no other pair makes t.  Raises if nothing
    is left to fill with (very small ``max_number``)."""
    top = max_number // 2
    u, coins = draws(seed, idx, range(4 + length)), draws(seed, idx, range(1000, 1001 + top))
    given = F.struct(u.alias("u"), coins.alias("coins"), _below(u[0], top + 1).alias("a"), _below(u[1], top + 1).alias("b"),
                     _below(u[2], length).alias("i"), _below(u[3], length - 1).alias("step"))

    def may_fill(v, c):
        other = c["a"] + c["b"] - v
        heads = F.get(c["coins"], F.least(v, other)) < 0.5
        return (v != c["a"]) & (v != c["b"]) & (v != other) & ((other < 0) | (other > top) | (heads == (v < other)))

    def numbers(c):
        fill = F.filter(F.sequence(F.lit(0), F.lit(top)), lambda v: may_fill(v, c))
        fill = let(fill, lambda f: F.when(F.size(f) > 0, f).otherwise(
            F.raise_error(F.lit("two_sum: max_number leaves no filler")).cast("array<int>")))
        j = (c["i"] + 1 + c["step"]) % length
        return let(F.struct(fill.alias("fill"), j.alias("j")), lambda d: F.transform(
            F.sequence(F.lit(0), F.lit(length - 1)), lambda p: F.when(p == c["i"], c["a"]).when(p == d["j"], c["b"]).otherwise(
                F.element_at(d["fill"], _below(c["u"][p + 4], F.size(d["fill"])) + 1))))
    a, b = _below(u[0], top + 1), _below(u[1], top + 1)
    return F.concat(let(given, numbers), F.array(a + b)), F.array(a, b)
