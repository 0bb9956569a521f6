"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte n-grams (2 to 4 bytes of the lower-cased
text, letters only, words bounded by a space), hashed to buckets.  Embeddings and the
softmax are trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows; the sample is the only thing that reaches the driver.  Afterwards embeddings times
weights fold into one table of a few numbers a bucket, so a text's logits are a mean of
table rows.  A temperature fitted on rows kept back calibrates the scores.

Rejection has two thresholds, each of which correctly told rows kept back pass but for a
stated share: on the calibrated score, and on how well the text's n-grams fit any learned
language (their mean log probability there against the language's usual one, in units of
one over the root of how many different n-grams carry the text).  The softmax alone cannot
tell languages that were not learned, or gibberish, since it only compares the learned ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import text_or_empty

BUCKETS, DIM, GRAMS = 1 << 13, 16, (2, 3, 4)
#: Labelled rows a language that training may see (their counts by bucket go to the driver).
PER_LANGUAGE = 500
#: Languages at most that a model tells apart, those with the most rows.
MOST_LANGUAGES = 1000
#: Share of correctly told rows kept back that either rejection threshold may lose, and the rows
#: that it takes to set one.
LOSE, FEWEST = 0.001, 8
#: Weight of the uniform distribution in a language's n-gram distribution, in n-grams.
SMOOTH = 200
UNKNOWN = "und"
#: Bytes worked on at once.
WINDOW = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _buckets(b: np.ndarray):
    """Bucket of each n-gram that starts at each byte, and whether it counts, for each length.

    ``b``: bytes with every run of non-letters already one zero byte.  An n-gram may begin
    and end with the zero, but has none inside."""
    code = b.astype(np.uint32)
    for n in range(2, max(GRAMS) + 1):
        if len(b) < n:
            return
        code = (code[:-1] << np.uint32(8)) | b[n - 1:]
        good = np.ones(len(code), bool) if n == 2 else good[:-1] & (b[n - 2:n - 2 + len(code)] != 0)
        if n in GRAMS:
            mixed = (code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            yield (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - 13), good


def letters(text: str) -> np.ndarray:
    """Lower-cased UTF-8 with every run of other bytes as one zero, and zeros at both ends."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    b = np.where(_LETTER[raw], raw, 0).astype(np.uint8)
    return b[(b != 0) | np.append(True, b[:-1] != 0)]


def bucket_counts(text: str) -> np.ndarray:
    """Counts of a whole text's n-grams by bucket."""
    b, out = letters(text), np.zeros(BUCKETS, np.int64)
    lap = max(GRAMS) - 1
    for at in range(0, len(b), WINDOW):
        part = b[at:at + WINDOW + lap]
        for bucket, good in _buckets(part):
            k = min(WINDOW, len(bucket))
            out += np.bincount(bucket[:k][good[:k]], minlength=BUCKETS)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list
    table: np.ndarray  # BUCKETS x languages: embedding times weight
    bias: np.ndarray
    temperature: float
    least: float  # scores below it are rejected
    grams: np.ndarray | None = None  # BUCKETS x languages: log probability of an n-gram
    usual: np.ndarray | None = None  # its mean in a usual text of the language
    floor: float = -np.inf  # texts that fit no language as well are rejected

    def logits(self, text: str) -> np.ndarray:
        return self._logits(bucket_counts(text))

    def _logits(self, c: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(c)
        return c[at] @ self.table[at] / max(c.sum(), 1) + self.bias

    def fits(self, c: np.ndarray) -> float:
        """How well a text's n-grams fit the language that they fit best; 0 is usual, less is worse."""
        at = np.flatnonzero(c)
        return float(((c[at] @ self.grams[at] / max(c.sum(), 1) - self.usual) * _carriers(c)).max())

    def predict(self, text: str):
        """Language, calibrated score, rejected.  A text without letters: ``und``, 0, rejected."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        c = bucket_counts(text)
        p = _softmax(self._logits(c)[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.least or self.grams is not None and self.fits(c) < self.floor)


def _softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _carriers(c):
    """Root of the number of equally frequent n-grams that would vary as those counted (last axis)."""
    c = np.asarray(c, np.float64)
    return c.sum(axis=-1) / np.sqrt(np.maximum((c * c).sum(axis=-1), 1))


def _grams(sums: np.ndarray) -> np.ndarray:
    """Counts of n-grams (languages x BUCKETS) -> smoothed log probabilities (BUCKETS x languages)."""
    return np.log((sums + SMOOTH / BUCKETS) / (sums.sum(axis=1, keepdims=True) + SMOOTH)).T


def _low(values: np.ndarray) -> float:
    """Value below which a share ``LOSE`` lies.  Fewer values than show it: their lowest, carried on as
    in an exponential tail below the median; under ``FEWEST``: none."""
    n = len(values)
    if n < FEWEST:
        return -np.inf
    if n * LOSE >= 1:
        return float(np.quantile(values, LOSE, method="lower"))
    mid = np.median(values)
    return float(mid - (mid - values.min()) * np.log(0.5 / LOSE) / np.log(0.5 * n))


def _typical(counts: np.ndarray, y: np.ndarray, n: int, rng) -> tuple:
    """``grams``, ``usual`` and ``floor`` of a model of ``n`` languages; each fifth of the rows is judged by the others."""
    part = rng.permutation(len(y)) % 5
    sums = np.zeros((5, n, BUCKETS))
    for i, k in set(zip(part.tolist(), y.tolist())):
        sums[i, k] = counts[(part == i) & (y == k)].sum(axis=0, dtype=np.float64)
    whole, own, right = sums.sum(axis=0), np.zeros(len(y)), np.zeros(len(y), bool)
    for i in range(5):
        rows = np.flatnonzero(part == i)
        v = counts[rows] @ _grams(whole - sums[i]).astype(np.float32) / np.maximum(counts[rows].sum(axis=1, keepdims=True), 1)
        own[rows], right[rows] = v[np.arange(len(rows)), y[rows]], v.argmax(axis=1) == y[rows]
    usual = np.array([np.median(own[y == k]) for k in range(n)])
    return _grams(whole).astype(np.float32), usual, _low(((own - usual[y]) * _carriers(counts))[right]) - 1e-3


def fit(counts: np.ndarray, lang: list, epochs: int = 30, rate: float = 0.5, seed: int = 7) -> Model:
    """Train on the bucket counts (rows x BUCKETS) and languages of the sample; every fifth row is
    kept back for the temperature and the score's threshold."""
    names = sorted(set(lang))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    y = np.array([names.index(v) for v in lang])
    x = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, use = order[::5], (np.delete(order, np.s_[::5]) if len(y) > 1 else order)
    e = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, c = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    # rows are short vectors (many n-grams, each a small share), so embeddings take larger steps
    gain = np.float32(64)
    steps, done = epochs * max(1, len(use) // 32), 0
    for _ in range(epochs):
        rng.shuffle(use)
        for i in range(0, len(use), 32):
            k = use[i:i + 32]
            h = x[k] @ e * gain
            p = _softmax(h @ w + c)
            p[np.arange(len(k)), y[k]] -= 1
            p = (p / len(k)).astype(np.float32)
            lr = np.float32(rate * max(0.05, 1 - done / steps))
            back_h = p @ w.T
            w -= lr * (h.T @ p)
            c -= lr * p.sum(axis=0)
            e -= lr * gain * (x[k].T @ back_h)
            done += 1
    z = (x[back] @ e * gain) @ w + c
    best = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(back)), y[back]] + 1e-12).mean())
    best = max(float(best), 0.25)  # few rows kept back cannot show more certainty than this
    p = _softmax(z / best)
    right = p.max(axis=1)[p.argmax(axis=1) == y[back]].astype(np.float64)
    odds = _low(np.log(right / np.maximum(1 - right, 1e-9)))  # a score's tail is even on this scale
    least = float(1 / (1 + np.exp(-odds))) if len(names) > 1 else 0.0
    return Model(names, (e @ w * gain).astype(np.float32), c.astype(np.float64), best, least, *_typical(counts, y, len(names), rng))


def fold(id_col="doc_id"):
    """crc32 of the id as text, modulo 5; 0 is the held-out fold.  A null id is in none (-1)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(-1))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Model:
    """Fit on at most ``per_language`` rows of each language outside the held-out fold, chosen by a
    hash of their id and text and used as whole texts (of ``MOST_LANGUAGES`` at most).  Rows that
    agree in language, id and text count once; rows without language or letters teach nothing."""
    lang = F.col(lang_col).cast("string")
    # a null id is like any other: the text tells the rows apart
    rows = docs.where(lang.isNotNull() & (fold(id_col) != 0)).select(
        F.xxhash64(id_col, F.xxhash64(text_col)).alias("pick"), lang.alias("lang"), text_or_empty(text_col).alias("t"))
    slim = rows.select("pick", "lang")
    # a threshold on the hash leaves a few more than wanted of each language, however many there are
    share = (per_language + 4 * per_language ** 0.5) / F.col("n")
    sizes = slim.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("rows"), F.approx_count_distinct("pick", 0.02).alias("n")) \
        .orderBy(F.desc("rows"), "of").limit(MOST_LANGUAGES)
    few = slim.join(F.broadcast(sizes), slim.lang == sizes.of).where(F.pmod("pick", F.lit(1 << 30)) < share * (1 << 30)) \
        .select("lang", "pick").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("pick", F.lit(1 << 30)), "pick"))
    chosen = few.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "pick")
    # at most per_language rows a language
    rows = rows.join(F.broadcast(chosen), ["lang", "pick"]).dropDuplicates(["lang", "pick"]).select("lang", "t")

    def count(batches):
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                c = bucket_counts(t)
                at = np.flatnonzero(c)
                out.append((at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.binary()),
                                              pa.array([o[1] for o in out], pa.binary())], names=["lang", "at", "n"])

    got = sorted((r["lang"], bytes(r["at"]), bytes(r["n"])) for r in
                 rows.mapInArrow(count, "lang string, at binary, n binary").where("length(at) > 0").collect())
    counts = np.zeros((len(got), BUCKETS), np.float32)
    for row, (_, at, n) in zip(counts, got):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
    return fit(counts, [g[0] for g in got])


def identify(docs: DataFrame, model: Model, keep=("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns plus ``lang_pred, score, rejected`` of every whole text.

    A null text or one without letters: ``und``, score 0, rejected.  A text of no learned language
    keeps the likest one's name and is rejected.  Ties go to the language that
    sorts first; repeated rows are told alike; an empty table gives no rows.
    """
    kept, at = [F.col(f"`{k}`") for k in keep], list(keep).index(text_col) if text_col in keep else len(keep)
    src = docs.select(*kept, *([] if text_col in keep else [F.col(text_col).alias("__text")]))
    n = len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches):
        m = shared.value
        for b in batches:
            told = [m.predict(t.as_py() or "") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n], pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64()),
                 pa.array([t[2] for t in told], pa.bool_())],
                names=[*b.schema.names[:n], "lang_pred", "score", "rejected"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:n]),
                        "lang_pred string, score double, rejected boolean"])
    return src.mapInArrow(run, schema)
