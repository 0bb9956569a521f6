"""Text Column expressions for corpus preparation (section A).

Everything here is a native Catalyst expression (string functions, regexes
and higher-order array functions), so it stays in the JVM and is evaluated
per row without Python.  Characters are Unicode code points (Python/Spark
semantics); the browser code slices UTF-16 code units, which only differs
for characters outside the BMP.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.arrays import let

# fixed values: char vocabulary of the character-level path
CHAR_EOS = 256          # end-of-sequence id (bos = eos = 256)
CHAR_MASK = 257         # <mask>, making the vocabulary 258 with mask
CHAR_UNKNOWN = 63       # '?' for code points >= 256
CHAR_SPACE_GLYPH = "␣"  # shown for id 32 when decoding for display
# whitespace class of JavaScript's \s (Java needs the Unicode flag for it)
JS_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# the same class as a character set for btrim (native, no regex)
JS_SPACE_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + \
    "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(x) -> Column:
    """String.prototype.trim: strip JS whitespace (incl. NBSP, BOM) at both ends."""
    return F.btrim(_c(x), F.lit(JS_SPACE_CHARS))


def is_blank(x) -> Column:
    """Null, or nothing but whitespace."""
    c = _c(x)
    return c.isNull() | (F.length(js_trim(c)) == 0)


def split_paragraphs(x) -> Column:
    """A-05: CRLF -> LF, split on 2+ newlines, trim each, drop empties -> ARRAY<STRING>."""
    parts = F.split(F.regexp_replace(_c(x), "\r\n", "\n"), "\n{2,}")
    return F.filter(F.transform(parts, js_trim), lambda p: F.length(p) > 0)


def chunk_text(x, max_chars: int = 4000) -> Column:
    """A-06: fixed slices of ``max_chars`` code points; a text that fits (even '') is itself."""
    c = _c(x)
    n = F.length(c)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(max_chars))
    sliced = F.transform(starts, lambda s: F.substring(c, s + 1, max_chars))
    return F.when(n <= max_chars, F.array(c)).otherwise(sliced)


def split_lines(x) -> Column:
    """A-07: the non-blank lines of a text (\\n, \\r\\n, \\r); the whole text if there are none."""
    c = _c(x)
    lines = F.filter(F.split(c, "\r\n|\n|\r"), lambda ln: F.length(js_trim(ln)) > 0)
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(c))


def chars(x) -> Column:
    """ARRAY<STRING> of code points (none of the empty text)."""
    return F.array_remove(F.split(_c(x), ""), "")


def latin(x) -> Column:
    """The text with every code point from 256 on as '?' (``CHAR_UNKNOWN``)."""
    return F.regexp_replace(_c(x), r"[^\x00-\xff]", chr(CHAR_UNKNOWN))


def code_points(x) -> Column:
    """ARRAY<INT> of code points."""
    return F.transform(chars(x), lambda ch: F.ascii(ch))


def encode_char(x, eos: int = CHAR_EOS, trailing_eos: bool = True) -> Column:
    """A-08: code point < 256 -> itself else 63; eos after every '\\n' that is followed by '\\n';
    a trailing eos unless the sequence already ends with one.

    The rules are applied to the text, where U+0100 stands for eos; every character is looked at once."""
    mark = chr(256)
    t = F.regexp_replace(latin(x), "\n(?=\n)", f"\n{mark}")
    if trailing_eos:
        t = F.concat(t, F.lit(mark)) if eos > 255 else let(t, lambda c: F.when(
            c.endswith(chr(eos)), c).otherwise(F.concat(c, F.lit(mark))))
    if eos == 256:
        return code_points(t)
    return F.transform(chars(t), lambda ch: F.when(ch == mark, F.lit(eos)).otherwise(F.ascii(ch)))


def char_ids(x) -> Column:
    """Plain char-level ids (code point < 256 else 63), no eos rules."""
    return code_points(latin(x))


def char_text(x, eos: int | None = None) -> Column:
    """``char_ids`` (and ``eos``) as text of one code point an id; ``code_points`` gives the ids."""
    return latin(x) if eos is None else F.concat(latin(x), F.lit(chr(eos)))


def decode_char(ids, show_space: bool = True) -> Column:
    """A-26: ids -> display string; 256 = <eos>, 257 = <mask>, 32 shown as '␣', others <unk>."""
    def one(i):
        return (F.when(i == CHAR_EOS, F.lit("<eos>"))
                .when(i == CHAR_MASK, F.lit("<mask>"))
                .when((i == 32) & F.lit(show_space), F.lit(CHAR_SPACE_GLYPH))
                .when((i >= 0) & (i < 256), F.chr(i))
                .otherwise(F.lit("<unk>")))
    return F.array_join(F.transform(_c(ids), one), "")


# --- pre-tokenisers (A-11 .. A-14) -------------------------------------------

WHITESPACE_PATTERN = r"\w+|[^\w\s]+"
WHITESPACE_SPLIT_PATTERN = r"[^\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
METASPACE = "▁"


def pretokenize_whitespace(x) -> Column:
    """A-11: runs of word characters, or runs of other non-space characters."""
    return F.regexp_extract_all(_c(x), F.lit(WHITESPACE_PATTERN), 0)


def pretokenize_whitespace_split(x) -> Column:
    """A-12: runs of non-space (JavaScript whitespace class)."""
    return F.regexp_extract_all(_c(x), F.lit(WHITESPACE_SPLIT_PATTERN), 0)


def pretokenize_metaspace(x, prepend_scheme: str = "always", add_prefix_space: bool = True,
                          section_index=0) -> Column:
    """A-13: spaces -> '▁'; a leading '▁' is added when missing and the scheme is
    'always', or 'first' on section 0.  Returns the one resulting piece."""
    c = F.regexp_replace(_c(x), " ", METASPACE)
    add = F.lit(add_prefix_space) & (
        F.lit(prepend_scheme == "always") | (F.lit(prepend_scheme == "first") & (F.lit(section_index) == 0)))
    return F.array(F.when(add & ~c.startswith(METASPACE), F.concat(F.lit(METASPACE), c)).otherwise(c))


def pretokenize_sequence(x, *steps) -> Column:
    """A-14: feed the pieces of one pre-tokeniser into the next and flatten."""
    pieces = F.array(_c(x))
    for step in steps:
        pieces = F.flatten(F.transform(pieces, step))
    return pieces


def normalize_text(x, lowercase: bool = False, strip_left: bool = False, strip_right: bool = False,
                   prepend: str | None = None) -> Column:
    """A-09 (non-Unicode-form steps): lowercase, strip, prepend, in that order."""
    c = _c(x)
    if lowercase:
        c = F.lower(c)
    if strip_left:
        c = F.regexp_replace(c, f"^{JS_SPACE}+", "")
    if strip_right:
        c = F.regexp_replace(c, f"{JS_SPACE}+$", "")
    if prepend:
        c = F.concat(F.lit(prepend), c)
    return c


#: Texts of an Arrow batch that are Python strings at the same time.
TEXTS_AT_ONCE = 64
UNICODE_FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def unicode_form(x, form: str) -> Column:
    """A-09: a Unicode normal form; null stays null.  Spark has none of its own, so texts go through
    Arrow batches, of which ``TEXTS_AT_ONCE`` texts at a time are Python strings."""
    if form not in UNICODE_FORMS:
        raise ValueError(f"unknown Unicode form {form!r}")

    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        parts = [pa.array([None if t is None else unicodedata.normalize(form, t) for t in texts.slice(k, TEXTS_AT_ONCE).to_pylist()], texts.type)
                 for k in range(0, len(texts), TEXTS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else texts
    return normal(_c(x))


def _prepended(text: str):
    return lambda t: F.when(F.length(t) > 0, F.concat(F.lit(text), t)).otherwise(t)


def normalize_sequence(x, steps: Sequence[str | tuple[str, str]]) -> Column:
    """A-09: normaliser steps one after the other, in the order given.

    A step is a Unicode form, ``"lower"``, ``"strip_left"``, ``"strip_right"``, ``"strip"`` or the
    pair ``("prepend", text)``, which leaves an empty text alone."""
    c = _c(x)
    for step in steps:
        if step in UNICODE_FORMS:
            c = unicode_form(c, step)
        elif step == "lower":
            c = F.lower(c)
        elif step in ("strip_left", "strip_right", "strip"):
            c = normalize_text(c, strip_left=step != "strip_right", strip_right=step != "strip_left")
        elif isinstance(step, tuple) and len(step) == 2 and step[0] == "prepend":
            c = let(c, _prepended(step[1]))
        else:
            raise ValueError(f"unknown normaliser step {step!r}")
    return c


def split_added_tokens(x, tokens: list[str]) -> Column:
    """A-15: split a text into sections around added (special) tokens, longest match first;
    special tokens become their own sections and empty sections are dropped."""
    import re as _re
    alt = "|".join(_re.escape(t) for t in sorted(tokens, key=len, reverse=True))
    marked = F.regexp_replace(_c(x), f"({alt})", "\u0000$1\u0000")
    return F.filter(F.split(marked, "\u0000"), lambda s: F.length(s) > 0)
