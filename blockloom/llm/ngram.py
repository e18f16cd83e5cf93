"""Near-duplicate documents by an exact Jaccard join on word n-grams.

All n-grams are put in one order, rare ones first; two sets of a wanted similarity then share an n-gram among
the first few of each (prefix filter). Candidates come from prefix n-grams that several documents share and
must pass the length filter (sizes near enough), the positional filter (what can still match before and after
the shared n-gram) and the suffix filter (a lower bound on the sets' difference, from parities of hashed
elements). Each pair that is left is verified once, by the whole texts.

The order needs counts only to be good, not to be right. Documents are counted for every n-gram, exactly: tasks
send sorted lists of hashes, packed by their differences, to as many buckets as the input asks for, and each
bucket gives its most frequent n-grams back. The HEAVY most frequent of all come last, by their counts; the
others, each rarer than all of these, come first in the order of their hashes.

Documents with equal sets are one class and are compared once. To keep large groups of copies from becoming all
their pairs, the join has two rounds: each document is first compared with the least of the documents that it
shares a prefix n-gram with; after the links so found are joined to components, documents of one group are
compared with each other where their components differ, in blocks of a bounded size. No link between components
is lost: a pair inside one component cannot change any component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, mix, release, small_batches, split_words, table, window_hashes, window_starts, word_hashes
from .components import components

#: Words of an n-gram and least similarity in percent, unless a caller says otherwise.
WORDS, PERCENT = 5, 80
#: Frequent n-grams that are told apart by their counts, bits of a set's parity signature.
HEAVY, SIGNATURE = 1 << 20, 256
#: n-grams that a task sends at once, and that a bucket of the count gets, about; bits of the hashes that are counted.
SENT, BUCKET, COUNTED_BITS = 1_500_000, 1_000_000, 40
#: Documents of one n-gram's group that are compared with as many others in one place.
BLOCK = 1024


def _all_shingles(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram hashes of all texts, repeats included, in order of the texts, and their numbers."""
    flat, counts = split_words(pc.ascii_lower(pc.fill_null(text, "")))
    h = word_hashes(flat)
    starts = window_starts(counts, k)
    number = np.maximum(counts - k + 1, np.minimum(counts, 1))
    out = np.empty(int(number.sum()), np.uint64)
    long = np.repeat(counts >= k, number)
    out[long] = window_hashes(h, k)[starts] if len(starts) else 0
    first, at = np.cumsum(counts) - counts, np.cumsum(number) - number
    for n in range(1, k):
        own = np.flatnonzero(counts == n)
        x = np.full(len(own), n, np.uint64)
        for i in range(n):
            x = mix(x * np.uint64(31) + h[first[own] + i])
        out[at[own]] = x
    return out, number


def shingle_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts in a row, each text's ascending, and their numbers.

    A-Z are lower-cased. A text of fewer than k words, but one at least, has its whole sequence as one n-gram.
    """
    x, number = _all_shingles(text, k)
    sets = [np.unique(part) for part in np.split(x, np.cumsum(number)[:-1])] if len(number) else []
    return np.concatenate(sets) if sets else x, np.array([len(s) for s in sets], np.int64)


def least_overlap(n, m, percent: int):
    """Common n-grams that sets of n and m elements need for the similarity."""
    return -(-(percent * (n + m)) // (100 + percent))


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers below 2^42 in seven bits a byte, lowest first; the top bit says that more follow."""
    v = values.astype(np.uint64)
    width = 1 + sum((v >> np.uint64(7 * i) > 0).astype(np.int64) for i in range(1, 6))
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.empty(int(at[-1]), np.uint8)
    for i in range(6):
        own = width > i
        part = (v[own] >> np.uint64(7 * i)).astype(np.uint8) & np.uint8(127)
        out[at[:-1][own] + i] = part | ((width[own] > i + 1).astype(np.uint8) << np.uint8(7))
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.empty(0, np.uint64)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & np.uint8(127)).astype(np.uint64) << (7 * shift).astype(np.uint64), first)


def _counted(x: np.ndarray) -> np.ndarray:
    return x >> np.uint64(64 - COUNTED_BITS)


def _count(k: int, bits: int):
    """Of all documents of a task: n-grams and the documents that hold them, by bucket (the hash's first bits)."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        bucket = (values >> np.uint64(COUNTED_BITS - bits)).astype(np.int64)
        heads = np.flatnonzero(np.diff(bucket, prepend=-1))
        cuts = [*zip(heads.tolist(), [*heads[1:].tolist(), len(values)], strict=True)]
        lists = [packed(np.diff(values[a:b], prepend=np.uint64(0))) for a, b in cuts]
        return pa.RecordBatch.from_arrays([pa.array(bucket[heads]), pa.array(lists, pa.binary()), pa.array([packed(counts[a:b]) for a, b in cuts], pa.binary())], ["bucket", "grams", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches, "text"):
            got = _counted(shingle_sets(batch.column("text"), k)[0])
            for at in range(0, len(got), SENT):
                held.append(got[at : at + SENT])
                size += len(held[-1])
                if size >= SENT:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    return run


def _most(quota: int):
    """The most frequent n-grams of one bucket, of those that several documents hold."""

    def run(keys, rows):
        values = [np.cumsum(unpacked(g)) for g in rows.column("grams").to_pylist()]
        counts = [unpacked(c) for c in rows.column("counts").to_pylist()]
        values, where = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
        top = np.argsort(-total, kind="stable")[:quota]
        top = top[total[top] > 1]
        return pa.table({"gram": pa.array(values[top].astype(np.int64)), "n": pa.array(total[top])})

    return run


def frequent(docs: DataFrame, k: int, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` n-grams at most that the most documents hold: their hashes' first bits, ascending, and those numbers of documents.

    Counts are over all documents. Of n-grams with the least number that would be listed, none is if not all fit.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(size / 6 / BUCKET)).bit_length()
    sent = docs.select("text").mapInArrow(_count(k, bits), "bucket long, grams binary, counts binary")
    # Hashes spread over the buckets evenly, so twice a bucket's share of the list is enough for its part of it.
    found = cut(sent.groupBy("bucket").applyInArrow(_most(max(1, 2 * most >> bits)), "gram long, n long"))
    numbers = sorted(((r["n"], r["count"]) for r in found.groupBy("n").count().collect()), reverse=True)
    least, room = 2, most
    for n, count in numbers:
        if count > room:
            least = n + 1
            break
        room -= count
    rows = found.filter(F.col("n") >= least).toArrow()  # a list of bounded length
    order = np.argsort(rows["gram"].to_numpy())
    table_ = rows["gram"].to_numpy()[order].astype(np.uint64), rows["n"].to_numpy()[order]
    del sent, found, rows
    release(docs.sparkSession)
    return table_


def number_of(x: np.ndarray, table_: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Documents that hold each n-gram, 0 for those that are not on the list of frequent ones."""
    grams, n = table_
    if not len(grams):
        return np.zeros(len(x), np.int64)
    own = _counted(x)
    at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
    return np.where(grams[at] == own, n[at], 0)


def _describe(k: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            x, n = shingle_sets(batch.column("text"), k)
            owner = np.repeat(np.arange(len(n)), n)
            ends = np.cumsum(n)
            # Two independent sums identify a set.
            f = [np.concatenate([[np.uint64(0)], np.cumsum(mix(x + np.uint64(c)), dtype=np.uint64)]) for c in (1, 0x1F0A2B)]
            f1, f2 = (np.diff(s[np.concatenate([[0], ends])]).view(np.int64) for s in f)
            parity = np.bincount(owner * SIGNATURE + (x >> np.uint64(56)).astype(np.int64), minlength=len(n) * SIGNATURE) & 1
            bits = np.packbits(parity.astype(np.uint8)).view(np.int64).reshape(len(n), SIGNATURE // 64)
            want = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
            count = number_of(x, shared.value)
            first = [part[np.argsort(c, kind="stable")[:w]] for part, c, w in zip(np.split(x, ends[:-1]), np.split(count, ends[:-1]), want.tolist(), strict=True)]
            first = np.concatenate(first) if first else x
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(want)]).astype(np.int32)), pa.array(first.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(v) for v in (n, f1, f2)], *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(bits.shape[1])], prefix],
                ["doc_id", "n", "f1", "f2", "s0", "s1", "s2", "s3", "prefix"],
            )

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "z"])


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sides = []
                for z in ("za", "zb"):
                    coded = batch.column(z).dictionary_encode()
                    x, n = shingle_sets(pa.array([unpack(t).decode() for t in coded.dictionary.to_pylist()], pa.string()), k)
                    sides.append((np.split(x, np.cumsum(n)[:-1]), coded.indices.to_pylist()))
                (xa, ia), (xb, ib) = sides
                hit = []
                for i, (p, q) in enumerate(zip(ia, ib, strict=True)):
                    one, two = xa[p], xb[q]
                    at_two = np.searchsorted(two, one)
                    common = int((two[np.minimum(at_two, len(two) - 1)] == one).sum()) if len(two) and len(one) else 0
                    if common and 100 * common >= percent * (len(one) + len(two) - common):
                        hit.append(i)
                kept = batch.take(pa.array(hit, pa.int32()))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return run


def _small_difference(x: str, y: str, percent: int) -> Column:
    """Length filter, and suffix filter: the sets differ in as many elements as their parities do, at least."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    differ = sum((F.bit_count(F.col(f"{x}s{i}").bitwiseXOR(F.col(f"{y}s{i}"))) for i in range(4)), F.lit(0))
    need = F.ceil((n + m) * percent / F.lit(100 + percent))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ <= n + m - 2 * need)


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that are similar enough, as a checkpointed frame."""
    side = ["n", "s0", "s1", "s2", "s3"]
    for name in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(name), *[F.col(c).alias(name + c) for c in side]), name)
    pairs = cut(pairs.filter(_small_difference("a", "b", percent)).select("a", "b"))
    release(docs.sparkSession)
    wanted = cut(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", "text").mapInArrow(_compressed, f"doc_id {kind}, z binary")
    texts = cut(texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("z").alias("zb")), "b")
    return cut(both.select("a", "b", "za", "zb").mapInArrow(_verify(k, percent), f"a {kind}, b {kind}"))


def node_of(docs: DataFrame) -> Column:
    """What tells texts of ``docs`` apart: doc_id, or where rows repeat one with other texts, doc_id and the text's hash."""
    t = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    if texts.filter("lo <> hi").isEmpty():
        return F.col("doc_id")
    return F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", t.alias("t")))


def similar(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when 100 * common n-grams >= percent * all n-grams of both; component_id is the smallest
    doc_id that links reach, itself included. Null and blank texts have no n-grams and link with nothing. Rows
    that repeat a doc_id and its text are one node, those with other texts are nodes of their own. A null doc_id
    links with nothing and keeps a null component. Further columns are dropped; an empty table gives an empty one.
    """
    found = linked(docs.select(node_of(docs).alias("doc_id"), "text"), k, percent)
    if not dict(found.dtypes)["doc_id"].startswith("struct"):
        return found
    return found.select("doc_id.doc_id", "n_shingles", F.col("component_id.doc_id").alias("component_id"))


def sets_of(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of each document: size, fingerprints and parities of its set, and its prefix, rare n-grams first."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, k))  # a list of bounded length
    shape = f"doc_id {kind}, n long, f1 long, f2 long, s0 long, s1 long, s2 long, s3 long, prefix array<long>"
    return cut(docs.select("doc_id", "text").mapInArrow(_describe(k, percent, shared), shape))


def _fits(x: str, y: str, percent: int) -> Column:
    """Length and positional filter for sides with n and pos."""
    n, m, p, q = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}pos"), F.col(f"{y}pos")
    most = F.least(p, q) + F.least(n - p, m - q)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (most * (100 + percent) >= percent * (n + m))


def _second_round(own: DataFrame, tried: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of one n-gram's group whose components differ, of those that pass all filters and were not ``tried``.

    own: gram, d, n, pos, component and parities, a row for each document of a group. A group is dealt to blocks
    of about ``block`` documents, and each two blocks meet under a key of their own.
    """
    side = ["s0", "s1", "s2", "s3"]
    split = own.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"))
    split = cut(split.filter("lo <> hi").select("gram", F.ceil(F.col("m") / block).cast("int").alias("p")))
    own = cut(own.join(split, "gram").withColumn("block", F.pmod(F.xxhash64("d"), F.col("p")).cast("int")))
    own = own.select("gram", "d", "n", "pos", "component", "p", "block", *side)
    x, y = (own.select("gram", "p", "block", *[F.col(c).alias(s + c) for c in ("d", "n", "pos", "component", *side)]) for s in ("x", "y"))
    x = x.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence(F.col("block"), F.col("p") - 1))).drop("p", "block")
    y = y.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block")))).drop("p", "block")
    fit = ((F.col("i") < F.col("j")) | (F.col("xd") < F.col("yd"))) & (F.col("xcomponent") != F.col("ycomponent")) & _fits("x", "y", percent) & _small_difference("x", "y", percent)
    rest = x.join(y, ["gram", "i", "j"]).filter(fit).select(F.least("xd", "yd").alias("a"), F.greatest("xd", "yd").alias("b")).distinct()
    return rest.join(tried, ["a", "b"], "left_anti")


def linked(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """As similar(), of documents whose doc_id is a node by node_of(): equal ones have equal texts."""
    with small_batches(docs.sparkSession):
        return _linked(docs, k, percent)


def _linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    sets = sets_of(docs, k, percent)
    # Documents with equal sets are a class; the least id stands for it.
    real = sets.filter("n > 0 and doc_id is not null")
    side = ["s0", "s1", "s2", "s3"]
    classes = cut(real.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("other")))
    # Copies of a node go first and by the join's keys, so prefixes are shuffled once.
    whole = ["doc_id", "n", "f1", "f2"]
    heads = real.dropDuplicates(whole).join(classes.select("n", "f1", "f2", F.col("lead").alias("doc_id")), whole, "left_semi")
    heads = cut(heads.select("doc_id", "n", *side, "prefix"))
    # From here on, only the classes' heads need their prefixes; the table with all of them can go.
    sets = cut(sets.select(*whole))
    real = sets.filter("n > 0 and doc_id is not null")
    release(docs.sparkSession)
    inside = real.join(classes.filter("lead <> other").select("n", "f1", "f2", "lead"), ["n", "f1", "f2"]).filter("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))

    held = heads.select(F.col("doc_id").alias("d"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "gram"))
    several = held.groupBy("gram").agg(F.min(F.struct("d", "n", "pos")).alias("x"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    several = cut(several.select("gram", F.col("x.d").alias("lead"), F.col("x.n").alias("ln"), F.col("x.pos").alias("lpos")))
    release(docs.sparkSession)
    # First round: each document with the least of all that it shares an n-gram with.
    held = cut(held.join(several, "gram").select("gram", "d", "n", "pos", "lead", _fits("", "l", percent).alias("near")))
    near = held.filter("near and d <> lead").groupBy("d").agg(F.min("lead").alias("lead"))
    tried = cut(near.select(F.col("lead").alias("a"), F.col("d").alias("b")))
    release(docs.sparkSession)
    links = _verified(tried, heads, docs, k, percent)
    found = cut(components(links))
    release(docs.sparkSession)

    own = heads.select(F.col("doc_id").alias("d"), *side).join(found.select(F.col("node").alias("d"), "component"), "d", "left")
    own = held.select("gram", "d", "n", "pos").join(own, "d").withColumn("component", F.coalesce("component", "d"))
    more = _verified(_second_round(own, tried, percent), heads, docs, k, percent)

    ends = components(links.unionByName(more).unionByName(inside))
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(ends, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op10_ngram(spark, sf_dir: str) -> DataFrame:
    """Word triples at 90 percent."""
    return similar(table(spark, sf_dir, "documents"), 3, 90)


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g AS x JOIN g AS y USING (gram) WHERE x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(node, reached) AS (
  SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.reached FROM r JOIN e ON e.a = r.node
), k AS (
  SELECT node, min(reached) AS component FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.component, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.node = d.doc_id
"""
