"""Offset-preserving SentencePiece encoding and decoding.

Normalisation walks a text by the longest prefix that the model's compiled character map
(a double-array trie followed by its replacements) knows, else by one character, and
records for every byte of the normalised text the byte of the original that it came from.
The pieces of an encoding cover the normalised bytes in order, so a running sum of piece
lengths gives their normalised spans and the record projects these to original spans.
A model with an empty map has its normalisation computed for all bytes at once.

The ids are the library's own.  Where a model's pieces cannot cross a word start (checked
on its vocabulary), distinct words are encoded once (see ``subword_units``).
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import text_or_empty
from weft.llm.subword_units import UnitCache, le_bytes, slices, spell, without_gc, words

MARK = "▁"
#: Units of a generation and bytes of a slice: workers outlive the job, so they keep little.
UNITS, SLICE = 100_000, 4 << 20


class CharMap:
    """The compiled character map: ``[trie bytes: uint32][trie units: uint32...][replacements,
    each ended by a zero byte]``; a trie value is a place among the replacements."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + n], "<u4").tolist()
        self.text = blob[4 + n:]

    def longest(self, b: bytes, at: int) -> tuple[int, bytes]:
        """Bytes of the longest known prefix at ``at`` (0: none) and its replacement."""
        units, found, value = self.units, 0, 0
        if not units:
            return 0, b""
        node = _offset(units[0])
        for i in range(at, len(b)):
            node ^= b[i]
            unit = units[node]
            if unit & 0x800000FF != b[i]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found, value = i + 1 - at, units[node] & 0x7FFFFFFF
        return found, self.text[value:self.text.index(b"\0", value)] if found else b""


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 0x200) >> 6)


class PieceCodec:
    """One model: ``normalize``, ``encode``, ``spans``, ``decode``."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.spec = spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        # normalised bytes that a piece covers
        self.width = np.array([0 if sp.is_control(i) else 1 if sp.is_byte(i) else len(p.encode())
                               for i, p in enumerate(names)], np.int64)
        self.eos = sp.eos_id()
        self.plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        by_word = (self.plain and spec.add_dummy_prefix and spec.escape_whitespaces
                   and not proto.trainer_spec.treat_whitespace_as_suffix and proto.trainer_spec.byte_fallback
                   and proto.trainer_spec.model_type == proto.trainer_spec.BPE
                   and not any(re.search(f"[^{MARK}]{MARK}", p) for p in names)
                   and sp.piece_to_id(MARK) != sp.unk_id()
                   and not any(p.type == p.USER_DEFINED for p in proto.pieces))
        self.units = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+") if by_word else None
        # the model itself puts a space before a text, but not before an empty one
        mark = [sp.piece_to_id(MARK)]
        self.cache = UnitCache(lambda units: [
            (le_bytes(ids), " ".join(map(str, ids)))
            for ids in (i if len(u) > 1 else mark for u, i in zip(units, sp.encode([u[1:] for u in units], num_threads=1)))],
            most=UNITS)

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised UTF-8 and, for each of its bytes and its end, the original byte offset."""
        raw = text.encode()
        if not raw:
            return b"", np.zeros(1, np.int64)
        mark = MARK.encode() if self.spec.escape_whitespaces else b" "
        if self.plain:
            b = np.frombuffer(raw, np.uint8)
            wide = np.where(b == 32, len(mark), 1)
            align = np.repeat(np.arange(len(b)), wide)
            if self.spec.add_dummy_prefix:
                align = np.concatenate((np.zeros(len(mark), np.int64), align))
            out = raw.replace(b" ", mark)
            return (mark if self.spec.add_dummy_prefix else b"") + out, np.append(align, len(b))
        parts: list[tuple[bytes, int]] = []
        at = 0
        while at < len(raw):
            n, to = self.map.longest(raw, at)
            if not n:
                n = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                to = raw[at:at + n]
            parts.append((to, at))
            at += n
        out, align = bytearray(), []
        squeeze = self.spec.remove_extra_whitespaces
        if squeeze:
            while parts and not parts[0][0].strip(b" "):
                parts.pop(0)
            while parts and not parts[-1][0].strip(b" "):
                at = parts.pop()[1]
        if not parts:
            return b"", np.full(1, at)
        if self.spec.add_dummy_prefix:
            out += mark
            align += [parts[0][1]] * len(mark)
        space = squeeze
        for to, start in parts:
            for c in to:
                if c == 32:
                    if space and squeeze:
                        continue
                    out += mark
                    align += [start] * len(mark)
                else:
                    out.append(c)
                    align.append(start)
                space = c == 32
        while squeeze and out.endswith(mark):
            del out[-len(mark):]
            at = align[-len(mark)]
            del align[-len(mark):]
        return bytes(out), np.array([*align, at], np.int64)

    def encode(self, texts: pa.Array) -> list:
        """For each text its ids with the end id, and the ids in decimal, joined by one space."""
        with without_gc():
            return self._encode(texts)

    def _encode(self, texts: pa.Array) -> list:
        if self.units is None:
            ids = [[*i, self.eos] for i in self.sp.encode(texts.to_pylist(), num_threads=1)]
            return [(np.array(i, "<u4"), " ".join(map(str, i))) for i in ids]
        end, out = (le_bytes([self.eos]), str(self.eos)), [None] * len(texts)
        # texts in which each space begins a word of its own (and so has one mark)
        plain, codes, begin, found = words(texts, f"  |^ | $|{MARK}|^$")
        codes = np.insert(codes, begin[1:], len(found))
        begin += np.arange(len(begin))
        values = [*self.cache.values([" " + w for w in found]), end]
        flat, ends = spell(codes, [v[0] for v in values])
        decimal, codes, ends = [v[1] for v in values], codes.tolist(), ends[begin].tolist()
        for i, at, to, c, d in zip(plain.tolist(), ends[:-1], ends[1:], begin[:-1].tolist(), begin[1:].tolist()):
            out[i] = flat[at:to], " ".join([decimal[k] for k in codes[c:d]])
        odd = [i for i, x in enumerate(out) if x is None]
        texts = [texts[i].as_py() for i in odd]
        for i, x in zip(odd, self.cache.by_text([self.units.findall(" " + t) if t else [] for t in texts])):
            x.append(end)
            out[i] = np.frombuffer(b"".join([f[0] for f in x]), "<u4"), " ".join([f[1] for f in x])
        return out

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte spans ``[start, end)`` of the pieces; a byte piece has its byte's place, the
        end id an empty span at the end.  Raises if the pieces don't cover the normalised text."""
        norm, align = self.normalize(text)
        unknown = ids == self.sp.unk_id()
        if unknown.any():
            raise ValueError("an unknown piece has no own length; spans need byte fallback")
        ends = np.cumsum(self.width[ids])
        if int(ends[-1]) != len(norm):
            raise ValueError("pieces do not cover the normalised text")
        starts = ends - self.width[ids]
        return align[starts], align[ends]

    def decode(self, ids) -> str:
        return self.sp.decode([int(i) for i in ids])


_LOADED: dict = {}


def codec(path: str) -> PieceCodec:
    """One codec for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceCodec(path)
    return _LOADED[path]


#: Columns that ``encode`` can make, with their types.
OUTPUTS = {
    "ids": "array<int>", "starts": "array<long>", "ends": "array<long>", "n_tokens": "long", "ids_sha256": "string",
    "decoded": "string", "decoded_sha256": "string", "spans_crc32": "long",
}
ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _row(c: PieceCodec, text: str, ids: np.ndarray, decimal: str, want: set) -> dict:
    out = {"n_tokens": len(ids)}
    if want & {"starts", "ends", "spans_crc32"}:
        starts, ends = c.spans(text, ids)
        out |= {"starts": starts, "ends": ends}
        if "spans_crc32" in want:
            out["spans_crc32"] = zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(starts.astype("<i8").tobytes()))
    if "ids" in want:
        out["ids"] = ids.astype(np.int32)
    if "ids_sha256" in want:
        out["ids_sha256"] = hashlib.sha256(decimal.encode()).hexdigest()
    if want & {"decoded", "decoded_sha256"}:
        out["decoded"] = back = c.sp.decode(ids.tolist())
        out["decoded_sha256"] = hashlib.sha256(back.encode()).hexdigest()
    return {k: v for k, v in out.items() if k in want}


def encode(docs: DataFrame, model_path: str, outputs=("ids", "starts", "ends"), keep=("doc_id",),
           text_col: str = "text") -> DataFrame:
    """Encode every whole text, row by row, and decode the ids again: the ``keep`` columns and
    ``outputs`` (see OUTPUTS).

    Null and empty texts give the end id alone with an empty span; repeated rows give equal
    rows; an empty table gives no rows; a clash of kept and made names is an error.
    """
    clash = set(keep) & set(outputs)
    if clash:
        raise ValueError(f"columns named twice: {sorted(clash)}")
    want, names = set(outputs), list(outputs)
    kept, width = [F.col(f"`{k}`") for k in keep], len(keep)

    def run(batches):
        c = codec(model_path)
        types = {k: ARROW[OUTPUTS[k]] for k in names}
        for b in batches:
            for part in slices(b, width, SLICE):
                texts = part.column(width)
                rows = [_row(c, t, *e, want) for t, e in zip(texts.to_pylist(), c.encode(texts))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array([r[k] for r in rows], types[k]) for k in names)],
                    names=[*part.schema.names[:-1], *names])

    src = docs.select(*kept, text_or_empty(text_col).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]),
                        *(f"`{k}` {OUTPUTS[k]}" for k in names)])
    return src.mapInArrow(run, schema)


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``tokens`` plus ``decoded``: the text of its ids (null ids: empty)."""
    at = tokens.columns.index(ids_col)

    def run(batches):
        c = codec(model_path)
        for b in batches:
            text = ["" if i is None else c.decode(i) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields), "decoded string"])
    return tokens.mapInArrow(run, schema)
