"""Brute-force versions and edge cases of the operators on texts."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.llm import lines, mixing, ngram, packing, quality, rules, stats, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def brute_ngrams(docs, k, percent):
    """doc_id -> (set size, component) for documents with an id."""
    sets = {}
    for i, text, _ in docs:
        if i is None:
            continue
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a]:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= percent * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_ngram_join_is_exact(odd_docs, k, percent):
    want = brute_ngrams(rows_of(odd_docs), k, percent)
    got = ngram.similar(odd_docs, k, percent).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_ngram_join_of_nothing(no_docs):
    assert ngram.similar(no_docs).collect() == []


def brute_repeats(docs, window):
    """Rows in order with the words left; a window is gone if the same words start earlier in another place."""
    order = sorted({(i is None, i or 0, zlib.crc32((t or "").encode()), t or "") for i, t, _ in docs})
    seen, out = set(), {}
    for null, i, _, t in order:
        w = WORD.findall(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if key in seen:
                gone[j : j + window] = [True] * window
            seen.add(key)
        out[(None if null else i, t)] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("window, anchor, portion, large", [(20, 8, 2_000_000, 2048), (20, 8, 500, 3), (6, 3, 300, 1), (6, 3, 300, 5)])
def test_repeats_are_exact(odd_docs, window, anchor, portion, large):
    docs = rows_of(odd_docs)
    want = Counter((i, *brute_repeats(docs, window)[(i, t or "")]) for i, t, _ in docs)
    got = substrings.remove_repeats(odd_docs.repartition(5), window, anchor, portion, large).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == want


def test_repeats_of_nothing(no_docs):
    assert substrings.remove_repeats(no_docs).collect() == []


def test_suffix_trees():
    rng = np.random.default_rng(4)
    for trial in range(30):
        codes = rng.integers(0, 3, 80).astype(np.int32)
        cuts = np.sort(rng.integers(0, 80, 4))
        ends = np.repeat([*cuts, 80], np.diff([0, *cuts, 80]))
        for least in (1, 2, 3, 5, 20):
            order, common = substrings.suffix_order(codes, ends, least)
            suffix = [tuple(codes[i : ends[i]]) for i in range(80)]
            size = 1 << (least - 1).bit_length()
            assert [suffix[i][:size] for i in order] == sorted(x[:size] for x in suffix)
            for (i, j), c in zip(zip(order, order[1:]), common[1:]):
                same = next((k for k, (x, y) in enumerate(zip(suffix[i], suffix[j])) if x != y), min(len(suffix[i]), len(suffix[j])))
                assert c == same if same < size else c >= size
            node = substrings.deep_nodes(common, least)
            whole = [(n, suffix[i][:least]) for n, i in zip(node, order) if len(suffix[i]) >= least]
            assert len(set(whole)) == len({n for n, _ in whole}) == len({x for _, x in whole})


def test_maximal_repeats():
    text = "the cat sat on the mat and the cat sat on a hat".split()
    names = {w: i for i, w in enumerate(dict.fromkeys(text))}
    codes = np.array([names[w] for w in text], np.int32)
    found = substrings.maximal_repeats(codes, np.full(len(codes), len(codes)), 3)
    assert sorted(found) == [(3, 2, 1), (4, 2, 0)]
    # Two texts: a run that goes over the end of one is no repeat.
    ends = np.array([7] * 7 + [13] * 6)
    assert substrings.maximal_repeats(codes, ends, 4) == [(4, 2, 0)] and substrings.maximal_repeats(codes, ends - (ends == 13) * 3, 4) == []
    assert substrings.maximal_repeats(codes[:0], ends[:0], 3) == []


def test_large_groups_are_split(spark):
    """One common n-gram in every document, in other words each time: a single anchor's group, without a repeat."""
    import time

    from pyspark.sql import functions as F

    def took(n):
        word = lambda k: F.concat(F.lit(f"w{k}x"), F.col("id"))
        docs = spark.range(0, n, 1, 8).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[word(k) for k in range(4)], F.lit("the one and only common eight words here"), *[word(k) for k in range(4, 22)]).alias("text"))
        began = time.perf_counter()
        got = substrings.remove_repeats(docs, large=100).agg(F.sum("n_removed"), F.count(F.lit(1))).first()
        assert tuple(got) == (0, n)
        return time.perf_counter() - began

    took(1000)
    small, large = took(4000), took(16_000)
    assert large < 4 * small + 5


def test_repeated_rows_of_large_groups(spark):
    words = " ".join(f"a{i}" for i in range(60))
    rows = [(7, words)] * 300 + [(8, words + " end"), (3, "x " + words), (None, words)]
    for large in (1, 2048):
        got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), large=large).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed) for r in got) == Counter({(7, 60, 60): 300, (8, 61, 60): 1, (3, 61, 0): 1, (None, 60, 60): 1})


def test_statistics_against_plain_python(odd_docs):
    texts = [t for _, t, _ in rows_of(odd_docs)] + ["a# b|c\na# b|c\n\n \n", "x y z x y z x y z x y z x y z"]
    found, _, _ = stats.statistics(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        real = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        want = (len(w), sum(map(len, w)), sum(c in stats.SYMBOLS for c in t), len(real) - len(set(real)), len(cover), len(set(w)))
        assert tuple(int(found[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words")) == want


def test_rules_learn_thresholds_in_order():
    rng = np.random.default_rng(0)
    x = rng.random((900, 2))
    bad = (x[:, 0] > 0.8) | (x[:, 1] < 0.1)
    found = rules.learn(x, bad, ["a", "b"])
    hit = np.zeros(len(x), bool)
    for rule in found:
        hit |= rules._match(rule, x, ["a", "b"])
    assert (hit == bad).mean() > 0.97 and len(found) >= 2
    assert rules.learn(x, np.zeros(900), ["a", "b"]) == [] and rules.learn(x[:0], bad[:0], ["a", "b"]) == []


def test_rules_on_odd_documents(odd_docs, no_docs):
    made = [[rules.Condition("words", True, 1000.0)], [rules.Condition("symbols_per_word", True, 0.5), rules.Condition("words", False, 40.0)]]
    got = rules.apply_rules(odd_docs, made)
    assert got.count() == odd_docs.count()
    by_id = {r.doc_id: r for r in got.collect() if r.doc_id}
    assert by_id[403].rule == 1 and not by_id[403].kept and by_id[400].base_failed and by_id[404].base_failed
    assert rules.apply_rules(no_docs, []).collect() == []


def test_rules_tell_good_from_bad(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learned = rules.train(docs, labels.filter(~quality.held_out(labels.doc_id)))
    both = rules.apply_rules(docs, learned).join(labels, "doc_id").filter(quality.held_out(labels.doc_id)).filter("not base_failed").collect()
    assert sum((r.quality == 1) == r.kept for r in both) >= 0.95 * len(both)


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = quality.Machine(rng.normal(size=quality.DENSE), np.ones(quality.DENSE), 0.3, rng.normal(size=quality.DENSE + quality.BUCKETS), rng.normal(size=(quality.DENSE + quality.BUCKETS, 3)))
    dense, codes = rng.normal(size=(1, quality.DENSE)), np.array([3, 7, 11], np.int32)
    x = np.concatenate([m.inputs(dense)[0], np.full(3, 1 / np.sqrt(3))])
    w = np.concatenate([m.w[: quality.DENSE], m.w[codes + quality.DENSE]])
    v = np.concatenate([m.v[: quality.DENSE], m.v[codes + quality.DENSE]])
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert np.isclose(m.raw(dense, codes, np.array([3]))[0][0], 0.3 + w @ x + pairs)


def test_classifier_on_the_held_out_fifth(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in quality.op7_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert held and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_classifier_on_odd_documents(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    blank = quality.train(odd_docs, none)
    got = quality.score(odd_docs, blank)
    assert got.count() == odd_docs.count() and got.columns.count("score") == 1
    assert {r.score for r in got.collect()} == {0.5}
    assert quality.score(no_docs, blank).collect() == []
    some = spark.createDataFrame([(300, 1), (404, 0), (1, None), (300, 1)], "doc_id long, quality int")
    assert quality.score(odd_docs, quality.train(odd_docs, some)).count() == odd_docs.count()


def test_boilerplate_lines(odd_docs, no_docs):
    docs = rows_of(odd_docs)
    blank = " \t\n\x0b\x0c\r"
    places, sites = {}, {}
    for i, t, s in docs:
        for pos, part in enumerate((t or "").split("\n")):
            if part.strip(blank):
                sites.setdefault(part.strip(blank), set()).add(s or "")
                places.setdefault(part.strip(blank), []).append((i is None, i or 0, pos))
    first = {k: min(v) for k, v in places.items() if len(sites[k]) >= 10}
    assert first
    for r in lines.remove_boilerplate(odd_docs).collect():
        text = next(t for i, t, _ in docs if i == r.doc_id and (i is not None or (t is None) == (r.text is None)))
        if text is None:
            assert r.text is None and (r.n_lines, r.n_removed) == (0, 0)
            continue
        parts = text.split("\n")
        gone = {p for p, part in enumerate(parts) if part.strip(blank) in first and first[part.strip(blank)] != (r.doc_id is None, r.doc_id or 0, p)}
        assert r.n_removed == len(gone) and r.text == "\n".join(x for p, x in enumerate(parts) if p not in gone)
    assert lines.remove_boilerplate(no_docs).collect() == []


def test_mix_comes_near_its_targets(odd_docs, no_docs):
    mixed = mixing.mix_sources(odd_docs).collect()
    assert len(mixed) == odd_docs.count()
    taken, longest = Counter(), Counter()
    for r in mixed:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        longest[r.source] = max(longest[r.source], r.size)
    for r in mixed:
        assert abs(taken[r.source] - r.target) <= longest[r.source] and r.target <= 2 * r.source_size
    whole = sum({r.source: r.source_size for r in mixed}.values())
    assert abs(sum({r.source: r.target for r in mixed}.values()) - 1.5 * whole) < 1e-6
    again = mixing.mix_sources(odd_docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.copies) for r in again) == Counter((r.doc_id, r.copies) for r in mixed)
    assert mixing.mix_sources(no_docs).collect() == []


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_words_give_the_tokenizers_ids():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    own, real = packing.WordIds(vocabulary()), Tokenizer.from_file(vocabulary())

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(max_size=40), st.text(alphabet="aAbéßÄñ' .,<|>#'sdlltm\n\t\xa01½Σ", max_size=60)))
    def same(text):
        assert np.frombuffer(own.of(text), "<u4").tolist() == real.encode(text, add_special_tokens=False).ids

    same()
    for text in ("<|endoftext|>x", "don't I'LL we're", "a\x1cb", "e\u0301 É", "x\u2028y", "ÀÉÎ x²³"):
        assert np.frombuffer(own.of(text), "<u4").tolist() == real.encode(text, add_special_tokens=False).ids


def test_packing_places_every_piece_once(odd_docs, no_docs):
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(vocabulary())
    size = 256
    got = packing.pack(odd_docs, vocabulary(), size, shard=16).collect()
    ids = {i: np.array([*real.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, _ in rows_of(odd_docs) if i is not None}
    want = Counter()
    for i, _, _ in rows_of(odd_docs):
        if i is not None:
            want.update((i, n, s, min(size, len(ids[i]) - s), zlib.crc32(ids[i][s : s + size].tobytes())) for n, s in enumerate(range(0, len(ids[i]), size)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id is not None) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    least = sum(r.length for r in got) / size
    assert len(by) <= least * 1.05 + 2
    assert packing.pack(no_docs, vocabulary(), size).collect() == []


def test_texts_that_share_an_id_link_each_on_its_own(spark):
    import corpus_pipeline

    one, two, alone = (" ".join(f"{c}{i}" for i in range(100)) for c in "abc")
    rows = [(5, one), (5, two), (6, one + " end"), (7, two + " end"), (8, one + " end"), (3, two + " more"), (3, alone), (9, None), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in ngram.similar(docs).collect())
    assert got == Counter({(5, 5): 1, (6, 5): 1, (8, 5): 1, (5, 3): 1, (7, 3): 1, (3, 3): 2, (9, 9): 1, (None, None): 1})
    whole = docs.selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, whole, "").collect()}
    assert kept == {(5, one), (3, two + " more"), (3, alone), (9, None), (None, one)}


def test_packing_of_very_short_texts_ends(spark):
    for text, n, size, shard in ((None, 5000, packing.SEQUENCE, packing.SHARD), ("x", 4000, 64, 8)):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(text).cast("string").alias("text"))
        got = packing.pack(docs, vocabulary(), size, shard=shard).collect()
        assert sorted(r.doc_id for r in got) == list(range(n))
        loads = Counter()
        for r in got:
            loads[r.sequence_id] += r.length
        tokens = sum(loads.values())
        assert tokens == n * (2 if text else 1) and max(loads.values()) <= size and len(loads) <= -(-tokens // size) + 1


def test_genetic_steps_keep_every_piece():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 100, 300).tolist()
    one, two = packing.start_genomes(lengths, 100, 2, rng)[0], [[i] for i in range(300)]
    for child in (packing.crossover(one, two, lengths, 100, rng), packing.mutate(one, lengths, 100, rng), packing.evolve(lengths, [two], 100, 1)):
        assert sorted(i for b in child for i in b) == list(range(300))
        assert all(sum(lengths[i] for i in b) <= 100 for b in child)
    assert len(packing.evolve(lengths, [two], 100, 1)) <= packing.least_bins(lengths, 100) * 1.03 + 1


def test_removed_words_have_the_digest(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_repeats(docs, 20)
    got = {r.doc_id: r for r in substrings.op8_substrings(spark, sf).collect()}
    for i, t, _ in docs:
        n, removed, left = want[(i, t)]
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, removed, hashlib.sha256(left.encode()).hexdigest())
