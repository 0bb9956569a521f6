"""Small tables for the operators' tests."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # extra columns whose names the operators use themselves
                     *(T.StructField(c, T.StringType()) for c in ("row", "h", "size", "fp", "score", "digest", "keep_id", "ids"))])


def docs(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) as documents with clashing extra columns."""
    full = [(*r, *([None] * (4 - len(r))), None if r[1] is None else len(r[1]), *"abcdefgh") for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [
    (1, "The quick brown fox"), (2, "the  quick\tbrown\nfox"), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "Zwei Wörter"),
    (8, "The quick brown fox"), (8, "The quick brown fox"), (9, "ẞ É ß é 　  x \x1c y"), (10, "a" * 5000 + " " + "b c " * 4000),
    (None, "no id"), (None, None), (11, "emoji 👩‍👩‍👧 ▁▁ mark ▁ x▁ y   z  "), (12, "<|endoftext|> </s> <unk> <0x41>"), (13, "  lead"),
    (14, "nul \x00 byte"), (15, "line\r\n\r\n  two\n\n\n three   \n"), (16, "1234 don't we'll I'M"),
]


def plain_components(fps, most):
    """fp -> smallest fp reachable by steps of at most ``most`` bits."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def plain_fingerprint(text, k=3):
    import re

    import xxhash
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_near(rows):
    """(doc_id, text) rows -> list of (doc_id, fingerprint hex, component_id)."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(fps, 2)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return [(i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps)]
