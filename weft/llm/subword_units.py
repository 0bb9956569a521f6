"""Encoding by units: texts are cut where no token can cross, and units repeat.

A library encodes each distinct unit once and the ids of a text are joined from its units,
which is several times faster than encoding whole texts and gives the same ids.  Within a
slice of rows Arrow finds the distinct words; over slices, units are remembered in bounded
memory, long ones not at all.
"""

from __future__ import annotations

import contextlib
import gc
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose words are told apart at once.
SLICE_BYTES = 10 << 20
#: Units of each of two generations, and the longest unit that is kept.
MOST_UNITS, LONGEST = 400_000, 48

#: Unicode's White_Space, which the byte-level pre-tokenizer's \s means.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and digits, and the signs before which a token that ends with one of them ends (an
#: apostrophe may belong to the token).
_ALNUM, _SIGNS = "0-9A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:-@\\[-^`{-~"


def le_bytes(ids: list) -> bytes:
    """Ids as little-endian uint32."""
    return struct.pack(f"<{len(ids)}I", *ids)


class UnitCache:
    """unit -> what ``encode`` (of a list of units) makes of it.

    When full, the units become the older generation, from which those that are met again
    come back; the older generation before is forgotten."""

    def __init__(self, encode, most: int = 0):
        self.encode, self.most, self.young, self.older = encode, most or MOST_UNITS, {}, {}

    def values(self, units: list) -> list:
        found = list(map(self.young.get, units))
        if None in found:
            missing = [i for i, v in enumerate(found) if v is None]
            new = dict.fromkeys([units[i] for i in missing])
            unknown = []
            for u in new:
                new[u] = self.older.get(u)
                if new[u] is None:
                    unknown.append(u)
            new.update(zip(unknown, self.encode(unknown)))
            for i in missing:
                found[i] = new[units[i]]
            self.keep(new)
        return found

    def keep(self, new: dict) -> None:
        for u, v in new.items():
            if len(u) <= LONGEST:
                if len(self.young) >= self.most:
                    self.older, self.young = self.young, {}
                self.young[u] = v

    def by_text(self, units: list) -> list:
        """Values of lists of units, one list a text."""
        found, out, at = self.values([u for x in units for u in x]), [], 0
        for x in units:
            out.append(found[at:at + len(x)])
            at += len(x)
        return out


@contextlib.contextmanager
def without_gc():
    """No cycle search while very many small lists and strings, none in a cycle, come and go."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def slices(batch: pa.RecordBatch, column: int, size: int = 0):
    """Runs of a batch's rows with about ``size`` bytes of text each (``SLICE_BYTES`` by default), one
    row at least."""
    part = (np.asarray(pc.binary_length(batch.column(column))).astype(np.int64).cumsum() - 1) // (size or SLICE_BYTES)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(i, j - i) for i, j in zip(cuts[:-1], cuts[1:]) if j > i)


def words(texts: pa.Array, odd: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Words of the texts without a match of the pattern ``odd`` (in which every space ends a word):
    which texts those are, the words' codes, where each text's codes begin (and the end), and
    the distinct words that the codes mean."""
    plain = pc.invert(pc.match_substring_regex(texts, odd))
    lists = pc.split_pattern(texts.filter(plain), " ")
    found = lists.flatten().dictionary_encode()
    ends = np.asarray(lists.value_lengths()).astype(np.int64).cumsum()
    return (np.flatnonzero(plain.to_numpy(zero_copy_only=False)), np.array(found.indices, np.int64), np.append(0, ends).astype(np.int64),
            found.dictionary.to_pylist())


def spell(codes: np.ndarray, values: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids that the codes mean, one after the other, and where each code's begin (and the end)."""
    size = np.array([len(v) // 4 for v in values], np.int32)
    ids, start = np.frombuffer(b"".join(values), "<u4"), np.cumsum(size, dtype=np.int32) - size
    n = size[codes]
    ends = np.append(0, np.cumsum(n, dtype=np.int64))
    at = np.repeat(start[codes] - ends[:-1].astype(np.int32), n)  # a slice of text has far fewer than 2**31 ids
    at += np.arange(len(at), dtype=np.int32)
    return ids[at], ends


class ByteBpe:
    """A byte-level BPE of the tokenizers library.

    ``specials``: special tokens are recognised inside texts, as the library does by default;
    else their strings are text like any other.  A text with the content of an added token that
    is recognised goes to the library whole.

    The pre-tokenizer ends a token before a space that follows a visible character, between a
    letter or digit and a sign, and splits white space from what follows it; so a word with
    the space before it, or else a run of visible characters, is encoded alone.
    """

    LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
    #: Texts with white space beside a space, or a space at an end, are not cut at every space.
    ODD = f"[{_WS}] | [{_WS}]|^ | $"

    UNITS = re.compile(f" ?[{_ALNUM}]++(?![^{_WS}{_SIGNS}])| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")

    def __init__(self, path: str, specials: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if specials or not t.special]
        self.added = "|".join(map(re.escape, added))
        self.cache = UnitCache(self._encode)
        # a unit of letters is one pre-token: its bytes, as the vocabulary spells them, go to the model alone
        letters = [chr(c) for c in range(32, 256) if c == 32 or self.LETTERS.fullmatch(chr(c))]
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {ord(c): spelled.pre_tokenize_str(c)[0][0] for c in letters}
        self.model = Tokenizer(self.tokenizer.model)

    def _encode(self, units: list) -> list:
        alone = [self.LETTERS.fullmatch(u) is not None for u in units]
        words = iter(self.model.encode_batch_fast([u.translate(self.spelling) for u, a in zip(units, alone) if a], add_special_tokens=False))
        rest = iter(self.tokenizer.encode_batch_fast([u for u, a in zip(units, alone) if not a], add_special_tokens=False))
        return [le_bytes(next(words if a else rest).ids) for a in alone]

    def ids(self, texts: pa.Array) -> list:
        """Ids of each text, as uint32 arrays."""
        with without_gc():
            added = np.flatnonzero(pc.match_substring_regex(texts, self.added)) if self.added else ()
            if not len(added):
                return self._ids(texts)
            out = [None] * len(texts)
            for i in added.tolist():  # one at a time: such texts are few and may be long
                out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
            rest = iter(self._ids(texts.filter(pa.array([x is None for x in out]))))
            return [next(rest) if x is None else x for x in out]

    def _ids(self, texts: pa.Array) -> list:
        plain, codes, begin, found = words(texts, self.ODD)
        first = codes[begin[:-1]]
        codes[begin[:-1]] = len(found) + np.arange(len(first))  # a text's first word has no space before it
        units = [*(" " + w for w in found), *(found[c] for c in first)]
        rest = texts.filter(pa.array(np.isin(np.arange(len(texts)), plain, invert=True))).to_pylist()
        values = [b"".join(x) for x in self.cache.by_text([self.UNITS.findall(u) for u in units + rest])]
        flat, ends = spell(codes, values[:len(units)])
        out, ends = [None] * len(texts), ends[begin].tolist()
        for i, at, to in zip(plain.tolist(), ends[:-1], ends[1:]):
            out[i] = flat[at:to]
        rest = iter(values[len(units):])
        return [np.frombuffer(next(rest), "<u4") if x is None else x for x in out]


_LOADED: dict = {}


def byte_bpe(path: str, specials: bool = False) -> ByteBpe:
    """One tokenizer of each kind for each Python worker."""
    if (path, specials) not in _LOADED:
        _LOADED[path, specials] = ByteBpe(path, specials)
    return _LOADED[path, specials]
