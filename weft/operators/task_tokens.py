"""Synthetic tasks as tokens, with their switches and vocabularies (B-23 .. B-38).

A task here yields two arrays of token strings, prompt and target, from the draws of
:mod:`weft.operators.tasks`; the switches add or leave out markers and separators.  Ids are
places in the task's vocabulary (``vocabulary`` with the same switches), so one rule serves
every setting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.arrays import let
from weft.operators import tasks as TK

# fixed values: card ranks, the two actions of slapjack, and the special tokens in their order
CARDS = "A23456789JQK"
SLAP, NO_SLAP = "🖐️", "❌"
SPECIALS = ("<bos>", "<eos>", "<mask>")


def _padded(n: int) -> list[str]:
    """0 .. n with leading zeros."""
    return [str(i).zfill(len(str(n))) for i in range(n + 1)]


def _letters(n: int) -> list[str]:
    return [chr(ord("A") + i) for i in range(n)]


def vocabulary(task: str, *, max_value: int = 20, alphabet: int = 5, vocab: int = 10, order: int = 2, expression: bool = True,
               recall: bool = True, commas: bool = False, colon: bool = True) -> list[str]:
    """B-38: the tokens of a task in the order of their ids, without the special ones.

    ``expression``: ``+ =`` of sums, ``: =`` of two-sum, ``=`` of marked sums; ``recall``: ``?``;
    ``commas`` and ``colon``: the separators and the marker before the answer."""
    comma, mark = [","] * commas, [":"] * colon
    numbers = _padded(max_value)
    if task in ("addition", "modular_addition"):
        return numbers + ["+", "="] * expression
    if task == "marked_addition":
        return numbers + ["M0", "M1"] + ["="] * expression
    if task == "two_sum":
        return numbers + [":", "="] * expression + comma
    if task in ("repeat", "reverse", "sort"):
        return _letters(alphabet) + mark + comma
    if task == "parity":
        return ["0", "1"] + mark + ["even", "odd"]
    if task == "slapjack":
        return list(CARDS) + mark + [SLAP, NO_SLAP]
    if task == "copy_memory":
        return [f"L{n}" for n in _padded(vocab)] + comma + ["?"] * recall
    if task == "temporal_order":
        return [f"D{n}" for n in _padded(vocab)] + ["X", "Y", "XY", "YX"] + comma
    if task == "random":
        return [f"V{i}" for i in range(vocab)]
    if task == "zeros":
        return ["0", "1"]
    if task == "elman":
        return TK.elman_vocab()
    if task == "dyck":
        level = lambda i: str(i // 3 + 1) if order > 3 else ""
        return [b + level(i) for i in range(order) for b in ("()", "[]", "{}")[i % 3]]
    raise ValueError(f"unknown task {task!r}")


def vocab_table(spark: SparkSession, task: str, specials: Sequence[str] = SPECIALS, **switches) -> DataFrame:
    """B-38: ``(token, id)``: the task's tokens, then the special ones."""
    tokens = vocabulary(task, **switches) + list(specials)
    return spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id int")


def token_ids(tokens: Column, vocab: Sequence[str] | Column) -> Column:
    """Places of the tokens in a vocabulary (null for one that is not in it)."""
    v = vocab if isinstance(vocab, Column) else F.lit(list(vocab))
    return F.transform(tokens, lambda t: F.nullif(F.array_position(v, t), F.lit(0)).cast("int") - 1)


def _named(ids: Column, names: Sequence[str]) -> Column:
    return F.transform(ids, lambda i: F.element_at(F.lit(list(names)), i + 1))


def _with_commas(tokens: Column, commas: bool) -> Column:
    """A comma before every token but the first."""
    if not commas:
        return tokens
    return F.flatten(F.transform(tokens, lambda t, i: F.when(i == 0, F.array(t)).otherwise(F.array(F.lit(","), t))))


def _ended(tokens: Column, mark: str, on: bool) -> Column:
    return F.concat(tokens, F.array(F.lit(mark))) if on else tokens


def addition(idx: Column, seed: int, max_value: int = 20, expression: bool = True) -> tuple[Column, Column]:
    """B-23: ``a + b =`` or only ``a b``; the answer is the sum."""
    p, t = TK.addition(idx, seed, max_value)
    words = let(p, lambda q: _named(F.array(q[0], q[2]), _padded(max_value)))
    if expression:
        words = let(words, lambda w: F.array(w[0], F.lit("+"), w[1], F.lit("=")))
    return words, _named(t, _padded(max_value))


def copy_memory(idx: Column, seed: int, prefix: int = 3, distractors: int = 12, vocab: int = 10, recall: bool = True,
                commas: bool = False) -> tuple[Column, Column]:
    """B-26: prefix, drawn distractors and the recall mark, separated or not; the answer is the prefix."""
    names = [f"L{n}" for n in _padded(vocab)]
    items = _named(TK._draws(seed, idx, 0, prefix + distractors, vocab), names)
    return _with_commas(_ended(items, "?", recall), commas), F.slice(items, 1, prefix)


def parity(idx: Column, seed: int, length: int = 4, colon: bool = True) -> tuple[Column, Column]:
    """B-29: bits and the colon; the answer is ``even`` or ``odd``."""
    bits, odd = TK.parity(idx, seed, length)
    return _ended(_named(bits, ["0", "1"]), ":", colon), _named(odd, ["even", "odd"])


def repeat(idx: Column, seed: int, length: int = 3, alphabet: int = 5, commas: bool = False, colon: bool = True) -> tuple[Column, Column]:
    """B-31: letters, then the colon; the answer repeats them, with commas if the prompt has them."""
    items = _with_commas(_named(TK.repeat(idx, seed, length, alphabet)[0], _letters(alphabet)), commas)
    return _ended(items, ":", colon), items


def slapjack(idx: Column, seed: int, length: int = 5, doubles: bool = True, sandwiches: bool = True, colon: bool = True) -> tuple[Column, Column]:
    """B-34: cards; each place is a slap for a jack, with ``doubles`` for the card before again, with
    ``sandwiches`` for the card two before again."""
    cards = _named(TK._draws(seed, idx, 0, length, len(CARDS)), CARDS)

    def slaps(all_):
        def act(c, i):
            hit = c == "J"
            if doubles:
                hit = hit | F.coalesce(c == F.get(all_, i - 1), F.lit(False))
            if sandwiches:
                hit = hit | F.coalesce(c == F.get(all_, i - 2), F.lit(False))
            return F.when(hit, F.lit(SLAP)).otherwise(F.lit(NO_SLAP))
        return F.transform(all_, act)
    return _ended(cards, ":", colon), let(cards, slaps)


def two_sum(idx: Column, seed: int, length: int = 4, max_number: int = 15, commas: bool = False, expression: bool = True) -> tuple[Column, Column]:
    """B-36: numbers, the colon, their target sum, the equals sign; the answer is the pair."""
    prompt, pair = TK.two_sum(idx, seed, length, max_number)
    names = _padded(max_number)
    words = let(_named(prompt, names), lambda w: F.concat(
        _with_commas(F.slice(w, 1, length), commas), *([F.array(F.lit(":"))] if expression else []), F.slice(w, length + 1, 1)))
    return _ended(words, "=", expression), _with_commas(_named(pair, names), commas)


TOKEN_TASKS = {"addition": addition, "copy_memory": copy_memory, "parity": parity, "repeat": repeat, "slapjack": slapjack, "two_sum": two_sum}
