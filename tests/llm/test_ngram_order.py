"""The order of n-grams, the blocks of the second round, and that frequent n-grams make no candidates."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.llm import ngram


@given(st.lists(st.integers(0, 2**42 - 1), max_size=50))
def test_packed_numbers_come_back(values):
    assert ngram.unpacked(ngram.packed(np.array(values, np.uint64))).tolist() == values


def shared_docs(spark, n=400):
    """Documents of one common passage each, among words of their own; two pairs of near copies."""
    rng = random.Random(2)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(n):
        own = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        rows.append((i, " ".join(own[:40] + common + own[40:])))
    rows += [(n, rows[3][1] + " end"), (n + 1, rows[5][1] + " end")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6), " ".join(common)


def test_counts_are_the_numbers_of_documents(spark, odd_docs):
    for docs in (odd_docs, shared_docs(spark)[0]):
        texts = pa.array([r.text for r in docs.select("text").collect()], pa.string())
        x, n = ngram.shingle_sets(texts, 3)
        want = Counter((x >> np.uint64(24)).tolist())
        grams, counts = ngram.frequent(docs, 3)
        assert dict(zip(grams.tolist(), counts.tolist())) == {g: c for g, c in want.items() if c > 1}
        top, most = ngram.frequent(docs, 3, 40)
        assert len(top) <= 40 and all(want[g] == c for g, c in zip(top.tolist(), most.tolist()))
        assert not len(top) or min(most) > max((c for g, c in want.items() if g not in set(top.tolist())), default=0)


def test_buckets_do_not_change_counts(spark, odd_docs, monkeypatch):
    whole = ngram.frequent(odd_docs, 5)
    monkeypatch.setattr(ngram, "BUCKET", 500)
    split = ngram.frequent(odd_docs, 5)
    assert all((a == b).all() for a, b in zip(whole, split))


def test_a_passage_of_all_documents_makes_no_candidates(spark):
    docs, common = shared_docs(spark)
    for k, percent in ((3, 90), (5, 80)):
        passage = set(ngram.shingle_sets(pa.array([common]), k)[0].view(np.int64).tolist())
        prefix = {g for r in ngram.sets_of(docs, k, percent).select("prefix").collect() for g in r.prefix}
        assert prefix and not prefix & passage
        got = {r.doc_id: r.component_id for r in ngram.similar(docs, k, percent).collect()}
        assert {i: c for i, c in got.items() if i != c} == {400: 3, 401: 5}


def test_blocks_meet_each_pair_once(spark):
    own = spark.range(300).select(F.lit(1).cast("long").alias("gram"), F.col("id").alias("d"), F.lit(50).alias("n"), F.lit(0).alias("pos"), (F.col("id") % 7).alias("component"), *[F.lit(0).cast("long").alias(f"s{i}") for i in range(4)])
    tried = spark.createDataFrame([(0, 1), (2, 5)], "a long, b long")
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if a % 7 != b % 7} - {(0, 1), (2, 5)}
    for block in (7, 100, 1000):
        got = ngram._second_round(own, tried, 90, block).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
