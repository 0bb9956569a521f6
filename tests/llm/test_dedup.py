"""SimHash near-dedup and exact dedup against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, docs, plain_components, plain_near
from weft.llm import digest_index, queries, simhash
from weft.llm.common import rows_that_stay, shared_path
from weft.llm.components import components

SF = "/root/testdata/sf0.001"


def key(r):
    return tuple((x is None, x) for x in r)


def test_near_duplicates_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r)[:3] for r in queries.op1_simhash(spark, SF).collect()]
    assert sorted(got) == sorted(plain_near(rows))


def test_near_duplicates_odd_rows(spark):
    found = simhash.near_duplicates(docs(spark, ODD))
    got = [tuple(r) for r in found.select("doc_id", simhash.fingerprint_hex(), "component_id").collect()]
    assert sorted(got, key=key) == sorted(plain_near(ODD), key=key)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    stay = rows_that_stay(docs(spark, ODD), found, "doc_id <=> component_id")
    ids = [r.doc_id for r in stay.collect()]
    assert ids.count(8) == 0 and ids.count(1) == 1 and 3 in ids and 4 not in ids and len(stay.columns) == 13


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(3000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == whole


def chains(seed, n=400):
    """Random fingerprints with clusters, chains of 1- and 2-bit steps and near misses."""
    rng, out = random.Random(seed), []
    for _ in range(n // 40):
        f = rng.getrandbits(64)
        for _ in range(40):
            out.append(f)
            f = f ^ (1 << rng.randrange(64))
            if rng.random() < 0.6:
                f = f ^ (1 << rng.randrange(64))
            if rng.random() < 0.15:
                f = f ^ (7 << rng.randrange(61))
    base = rng.getrandbits(64)
    return list({*out, *(base ^ (1 << i) for i in range(64)), 0, 2 ** 64 - 1})


@pytest.mark.parametrize("seed", [1, 2])
def test_links_keep_every_component(spark, seed):
    fps = chains(seed)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.links(df)
    got = {r.node % 2 ** 64: r.root % 2 ** 64 for r in components(links).collect()}
    want = plain_components(fps, 2)
    # roots are the smallest by signed order: compare the partitions
    def classes(of):
        out = {}
        for f, r in of.items():
            out.setdefault(r, set()).add(f)
        return {frozenset(c) for c in out.values() if len(c) > 1}
    assert classes(got) == classes(want)
    assert all((r.a ^ r.b).bit_count() <= 2 or ((r.a ^ r.b) % 2 ** 64).bit_count() <= 2 for r in links.collect())


def test_links_rows_stay_linear(spark):
    """A ball of near copies: links grow with the fingerprints, not with their pairs."""
    base = 0x0123456789ABCDEF
    ball = [base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    df = spark.createDataFrame([(f,) for f in np.array(ball, np.uint64).view(np.int64).tolist()], "fp long")
    n = simhash.links(df).count()
    assert len(ball) / 2 < n <= 65 * len(ball)
    assert components(simhash.links(df)).select("root").distinct().count() == 1


def test_components_long_chain_and_hub(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 500)] + [(5000, 5000), (7, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(500)}
    assert components(df.where("a < 0")).count() == 0


def plain_exact(rows):
    groups = {}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (i, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    keep = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return [(i, keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm)]


def test_exact_odd_rows(spark):
    df = digest_index.exact_duplicates(docs(spark, ODD))
    got = df.select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest"))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_exact(ODD), key=key)
    kept = [r.doc_id for r in df.where("kept").collect()]
    texts = {r[3] for r in plain_exact(ODD)}
    assert len(kept) == len(texts) and kept.count(8) == 0 and 1 in kept
    stay = rows_that_stay(docs(spark, ODD), df, "kept")
    assert stay.count() == len(texts) and stay.columns == docs(spark, ODD).columns
    assert digest_index.exact_duplicates(docs(spark, [])).count() == 0


def test_repeated_rows_leave_one(spark):
    rows = docs(spark, [(1, "x y"), (1, "x y"), (1, "x  y"), (2, "z")])
    df = digest_index.exact_duplicates(rows)
    assert df.where("kept").count() == 2
    assert sorted(r.doc_id for r in rows_that_stay(rows, df, "kept").collect()) == [1, 2]


def test_index_persists_over_batches(spark):
    spark.sql("DROP TABLE IF EXISTS seen_texts_test")
    index = digest_index.DigestIndex(spark, "seen_texts_test", buckets=4)
    first = {r.doc_id: tuple(r)[1:4] for r in index.add(docs(spark, [(5, "a b"), (6, "a  b"), (7, "c")])).collect()}
    assert first == {5: (5, 2, True), 6: (5, 2, False), 7: (7, 1, True)}
    again = digest_index.DigestIndex(spark, "seen_texts_test", buckets=4)
    second = {r.doc_id: tuple(r)[1:4] for r in again.add(docs(spark, [(1, "a b"), (2, "d"), (3, "d")])).collect()}
    assert second == {1: (5, 1, False), 2: (2, 2, True), 3: (2, 2, False)}
    assert {r.keep_id for r in again.rows().collect()} == {5, 7, 2}
    again.add(docs(spark, []))
    plan = again.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the buckets are the partitioning
    spark.sql("DROP TABLE seen_texts_test")


def test_index_outlives_a_session_and_repeats_a_batch(spark):
    path = shared_path(spark, "index-test")
    rows = docs(spark, [(5, "a b"), (6, "a  b"), (7, "c")])
    told = lambda df: {r.doc_id: tuple(r)[1:4] for r in df.collect()}
    index = digest_index.DigestIndex(spark, "seen_path_one", buckets=3, path=path)
    first = told(index.add(rows, batch_id="monday"))
    assert told(index.add(rows, batch_id="monday")) == first == {5: (5, 2, True), 6: (5, 2, False), 7: (7, 1, True)}
    later = spark.newSession()
    later.sql("DROP TABLE seen_path_one")  # a catalogue that knows nothing of the index
    again = digest_index.DigestIndex(later, "seen_path_two", buckets=8, path=path)
    assert again.buckets == 3 and sorted(r.keep_id for r in again.rows().collect()) == [5, 7]
    new = docs(later, [(1, "c"), (2, "d")])
    want = {1: (7, 1, False), 2: (2, 1, True)}
    assert told(again.add(new, batch_id="tuesday")) == want == told(again.add(new, batch_id="tuesday"))
    # an attempt that left part of its batch in the index
    part = digest_index.digests(docs(later, [(8, "e")])).select("digest", F.col("doc_id").alias("keep_id"), F.lit("wednesday").alias("batch"))
    again._write(part)
    assert told(again.add(docs(later, [(8, "e"), (9, "f"), (10, "a b")]), batch_id="wednesday")) == \
        {8: (8, 1, True), 9: (9, 1, True), 10: (5, 1, False)}
    assert again.rows().count() == again.rows().select("digest").distinct().count() == 5
    later.sql("DROP TABLE seen_path_two")


def test_exact_one_id_and_no_ids(spark):
    for i in (None, 3):
        df = digest_index.exact_duplicates(docs(spark, [(i, t) for t in ("a", "a", "b", None, "")]))
        got = sorted((r.group_size, r.kept, r.keep_id) for r in df.collect())
        assert got == [(1, True, i), (2, False, i), (2, False, i), (2, True, i), (2, True, i)]


def test_rows_that_stay_with_columns_without_order(spark):
    rows = docs(spark, [(1, "x"), (1, "x"), (2, "y")]).withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id"))) \
        .withColumn("extra", F.parse_json(F.lit('{"a":1}')))
    stay = rows_that_stay(rows, digest_index.exact_duplicates(rows), "kept")
    assert stay.columns == rows.columns and sorted((r.doc_id, r.tags["k"]) for r in stay.collect()) == [(1, 1), (2, 2)]
