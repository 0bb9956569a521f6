"""Mixing and the whole pipeline against plain versions."""

import hashlib
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.helpers import ODD, docs, plain_near
from weft.llm import langid, mixing, queries

SF = "/root/testdata/sf0.001"


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain_targets(sizes, share=1.5, most=2.0):
    """Deal, stop at the caps, deal the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in open_)
        deal = {s: left * weight[s] / total for s in open_} if open_ else {}
        over = [s for s in open_ if deal[s] > most * sizes[s]]
        if not over:
            return target | deal
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)


def plain_mix(rows):
    """[(doc_id, text, source)] -> [(doc_id, size, source_size, target, taken)] by sorting hashes."""
    h = lambda i, t: int(hashlib.md5(f"{'' if i is None else i} {t or ''}".encode()).hexdigest()[:15], 16)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + words(t)
    target, below, passes = plain_targets(size), {}, {}
    for s in size:
        passes[s] = int(target[s] // size[s]) if size[s] else 0
        need, groups = target[s] - passes[s] * size[s], {}
        for i, t, x in rows:
            if x == s and words(t):
                groups[h(i, t)] = groups.get(h(i, t), 0) + words(t)
        done, below[s] = 0, 0
        for k in sorted(groups):
            if done + groups[k] > need:
                below[s] = k + 1 if done + groups[k] - need < need - done else k
                break
            done += groups[k]
    copies = [passes[s] + (h(i, t) < below[s]) for i, t, s in rows]
    return [(i, words(t), size[s], target[s], c * words(t)) for (i, t, s), c in zip(rows, copies)], copies


def near_equal(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want]
    assert all(g[3] == pytest.approx(w[3], rel=1e-9) for g, w in zip(got, want))


def test_mix_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = [tuple(r) for r in queries.op10_mixing(spark, SF).collect()]
    near_equal(got, plain_mix(rows)[0])
    assert sorted(got) == sorted(map(tuple, queries.op10_mixing(spark, SF).collect()))  # reruns agree


def mixed(spark, rows):
    return [tuple(r) for r in mixing.mix(docs(spark, [(i, t, None, s) for i, t, s in rows])).select(
        "row.doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken").collect()]


def test_mix_odd_rows(spark):
    sources = [None, "b", "a", "Z", "é"]
    rows = [(i, t, sources[n % 5]) for n, (i, t) in enumerate(ODD)]
    near_equal(mixed(spark, rows), plain_mix(rows)[0])
    near_equal(mixed(spark, [(1, "", "a"), (2, None, "a")]), [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])
    near_equal(mixed(spark, [(1, "one two", "a")]), plain_mix([(1, "one two", "a")])[0])
    assert mixed(spark, []) == []


def test_mix_comes_near_and_stays_below_twice(spark):
    rows = [(i, "w " * (1 + i * 7919 % 40), f"s{0 if i % 3 else i % 11}") for i in range(1500)]
    got = mixed(spark, rows)
    near_equal(got, plain_mix(rows)[0])
    taken, target = {}, {}
    for (i, _, s), r in zip(sorted(rows), sorted(got)):
        taken[s], target[s] = taken.get(s, 0) + r[4], r[3]
        assert r[4] <= 2 * r[1]
    assert all(abs(taken[s] - target[s]) <= 20 for s in taken)


def test_mix_comes_near_where_ids_are_missing_or_repeated(spark):
    rows = [(None if i % 3 == 0 else i % 7 if i % 3 == 1 else i, f"t{i} " * (1 + i * 7919 % 40), f"s{i % 2}") for i in range(1200)]
    got = mixed(spark, rows)
    near_equal(got, plain_mix(rows)[0])
    by_source = {(r[2], r[3]) for r in got}
    assert len(by_source) == 2
    for size, target in by_source:
        assert abs(sum(r[4] for r in got if (r[2], r[3]) == (size, target)) - target) <= 20


def plain_pipeline(spark, rows, model):
    """rows (doc_id, text, lang, source) -> rows of run()."""
    rows = [r for r in rows if not model.predict(r[1] or "")[2]]
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    rows = list(first.values())
    rows = [r for r, (i, _, c) in zip(rows, plain_near([r[:2] for r in rows])) if i == c]
    copies = plain_mix([(r[0], r[1], r[3]) for r in rows])[1]
    rows = [r for r, c in zip(rows, copies) for _ in range(c)]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))
    out = []
    for r in rows:
        ids = sp.encode(r[1] or "") + [sp.eos_id()]
        out.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return out


def test_pipeline_whole_table(spark):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs_.select("doc_id", "text", "lang", "source").collect()]
    want = plain_pipeline(spark, rows, langid.train(docs_))
    got = [tuple(r)[:4] for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100


def test_near_keeps_one_row_of_each_group(spark):
    """Also where all ids of a group are null, or near texts share the smallest id."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    near = lambda t: t.upper()  # noqa: E731  the same fingerprint, another text
    rows = [(None, a), (None, near(a)), (None, a.title()), (5, b), (5, near(b)), (9, b.title()), (None, c), (7, near(c))]
    got = corpus_pipeline.near(spark, docs(spark, rows), SF).collect()
    assert sorted((r.text.lower(), r.doc_id) for r in got) == [(a, None), (b, 5), (c, 7)]


def test_stages_on_odd_rows(spark):
    """Every stage takes odd rows and an empty table, and keeps the columns."""
    labelled = [(100 + i, "the and of to in is that " * 5, "en", "s") for i in range(20)]
    odd, none = docs(spark, [*ODD, *labelled]), docs(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and 0 < out.count() <= 2 * odd.count()
        assert stage(spark, none, SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, SF).count() == odd.count() and last(spark, none, SF).count() == 0
