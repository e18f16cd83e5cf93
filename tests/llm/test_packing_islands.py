"""Islands of the packing algorithm: apart at first, with elites that migrate; keys that tell equal texts apart."""

import numpy as np
from pyspark.sql import functions as F

from blockloom.llm import packing


def test_islands_receive_what_others_made(spark):
    rng = np.random.default_rng(9)
    lengths = rng.integers(200, 480, 60).tolist()  # best fit alone does not reach the least number
    shape = "shard long, island int, lengths array<int>, elites array<binary>"
    apart = spark.createDataFrame([(0, i, lengths, None) for i in range(3)], shape)
    state = apart.mapInArrow(packing._round(0, 1000), packing._STATE)
    first = {r.island: bytes(r.elite) for r in state.collect()}
    assert len(set(first.values())) == 3  # three islands, three genomes
    moved = packing.migrated(spark.createDataFrame(state.collect(), packing._STATE)).collect()
    for r in moved:
        own, other = map(bytes, r.elites)
        assert own == first[r.island] and other == first[(r.island - 1) % 3] != own


def test_rounds_do_not_lose_shards(spark):
    rng = np.random.default_rng(2)
    for rounds in (0, 1, 3):
        items = spark.createDataFrame([(s, [(int(x),) for x in sorted(rng.integers(200, 480, 40))[::-1]]) for s in range(5)], "shard long, list array<struct<length:int>>")
        got = packing._evolved(items, 5, 1000, 3, rounds).collect()
        assert sorted(r.shard for r in got) == list(range(5))
        for r in got:
            bins = np.frombuffer(r.elite, np.int32)
            assert len(bins) == 40 and np.bincount(bins, weights=[x.length for x in r.list]).max() <= 1000


def test_equal_texts_under_one_id_have_keys_of_their_own(spark):
    import public_tokenizers

    docs = spark.range(0, 800, 1, 8).select(F.lit(7).cast("long").alias("doc_id"), F.lit("").alias("text"))
    keys = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")).select("shard_key").collect()
    assert len({r.shard_key for r in keys}) == 800
