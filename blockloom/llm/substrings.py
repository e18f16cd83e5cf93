"""Removal of repeated passages by partitioned suffix trees.

A window is a suffix of a document cut to WINDOW words. Suffixes are split into groups by the content of their
beginning: the n-gram with the least hash among the window's words, its anchor. Equal windows have equal
anchors, so all occurrences of a passage meet in one group; neighbouring suffixes mostly share an anchor and
travel as one row with one stretch of words. Anchors with a single row cannot hold a repeat and are dropped
before any words are sent. Groups of up to LARGE rows, about a portion, are dealt by anchor, and each task works through whole
groups in portions of a bounded number of words: ranks of prefixes of 1, 2, 4, 8, .. words give the order of the
portion's suffixes and the length that neighbours have in common, which is its suffix tree. An internal node of
WINDOW words' depth or more is a repeat, maximal to the right at its depth; of the suffixes below, all but the
first in the corpus are marked.

A group of more rows is split by a longer prefix, the whole window: its subtrees are single leaves' nodes then,
named by two hashes of the window, and the first occurrence in each is a minimum, taken in part before the
shuffle. So no group, however large, meets in one task. Before any of this, repeats within one batch of
documents are found by hashes of whole windows, checked by their words, so a passage that a third of all
documents share comes from each batch once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, mix, release, split_words, stored, table, window_hashes, window_starts, word_hashes

#: Words of a window, of an anchor; text bytes of a batch; words of a portion; rows of an anchor from which on its group is split.
WINDOW, ANCHOR, BATCH_BYTES, PORTION, LARGE = 20, 8, 10 << 20, 500_000, 16_384
#: Anchors whose groups are split, at most; where more are larger than LARGE rows, that is doubled.
MOST_LARGE = 1_000_000


def _runs(starts: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the stretches in which starts rise by one and all of ``same`` stay equal."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.concatenate([[True], np.diff(starts) != 1])
    for s in same:
        new[1:] |= s[1:] != s[:-1]
    heads = np.flatnonzero(new)
    return heads, np.diff(np.concatenate([heads, [len(starts)]]))


def _equal_to_first(order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows in ``order`` by key, those whose key is that of the one before, and the first with that key."""
    k = key[order]
    head = np.concatenate([[True], k[1:] != k[:-1]])
    first = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    return order[~head], first[~head]


def _found(window: int, anchor: int, large=None):
    """Of each document: stretches of windows that repeat earlier ones of the batch (found), and the others by anchor.

    at: a stretch's first window (upper 32 bits), its windows (the next 31) and whether it is found (the last).

    With ``large``, a broadcast array of anchors in order: only the others of these anchors, each window a row with
    two hashes of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", BATCH_BYTES):
            batch = batch.sort_by([("doc_id", "ascending"), ("t", "ascending")])  # null last
            flat, counts = split_words(batch.column("text"))
            starts = window_starts(counts, window)
            if not len(starts):
                continue
            h = word_hashes(flat)
            owner = np.repeat(np.arange(len(counts)), counts)[starts]
            inside = starts - (np.cumsum(counts) - counts)[owner]
            ids, t = batch.column("doc_id"), batch.column("t").to_numpy()
            # Rows that agree in id and text are one document.
            codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            document = np.cumsum(np.concatenate([[0], (codes[1:] != codes[:-1]) | (t[1:] != t[:-1])]))[owner]
            key = window_hashes(h, window)[starts]
            later, first = _equal_to_first(np.argsort(key, kind="stable"), key)
            same = (document[later] != document[first]) | (inside[later] != inside[first])
            for i in range(window):  # equal hashes are checked by the words
                same &= h[starts[later] + i] == h[starts[first] + i]
            gone = np.zeros(len(starts), bool)
            gone[later[same]] = True
            kept = np.flatnonzero(~gone)
            grams = window_hashes(h, anchor)
            best, at = grams[starts[kept]], starts[kept].copy()
            for i in range(1, window - anchor + 1):
                x = grams[starts[kept] + i]
                less = x < best
                best[less] = x[less]
                at[less] = (starts[kept] + i)[less]
            if large is not None:
                anchors, best = large.value, best.view(np.int64)
                own = kept[anchors[np.minimum(np.searchsorted(anchors, best), len(anchors) - 1)] == best]
                other = window_hashes(mix(h ^ np.uint64(0x5851F42D4C957F2D)), window)[starts[own]]
                named = [ids.take(pa.array(owner[own])), pa.array(t[owner[own]], pa.int64()), pa.array(inside[own].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*named, pa.array(key[own].view(np.int64)), pa.array(other.view(np.int64))], ["doc_id", "t", "start", "h1", "h2"])
                continue
            heads, lengths = _runs(starts[kept], at, owner[kept])
            lost = np.flatnonzero(gone)
            marked, marks = _runs(starts[lost], owner[lost])
            place = np.concatenate([kept[heads], lost[marked]])
            # Marks go along under random anchors.
            value = np.concatenate([best[heads], mix(starts[lost[marked]].astype(np.uint64) + key[lost[marked]])])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(owner[place])), pa.array(t[owner[place]], pa.int64()), pa.array(value.view(np.int64)),
                    pa.array((inside[place].astype(np.int64) << 32) | (np.concatenate([lengths, marks]) << 1) | (np.arange(len(place)) >= len(heads))),
                ],
                ["doc_id", "t", "anchor", "at"],
            )

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=9).compress
    for batch in batches:
        z = [pack((x or "").encode()) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(z, pa.binary())], ["doc_id", "t", "z"])


def _words_of(z: bytes) -> list[bytes]:
    """bytes.split() splits at the six ASCII white-space characters."""
    return zstandard.ZstdDecompressor().decompress(z).split()


def _stretches(window: int):
    """Rows of a document and its list of stretches, as a row for each stretch with its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                row, anchor, start, count, text = [], [], [], [], []
                for i, (z, list_) in enumerate(zip(batch.column("z").to_pylist(), batch.column("list").to_pylist(), strict=True)):
                    words = _words_of(z)
                    for x in list_:
                        row.append(i)
                        anchor.append(x["anchor"])
                        start.append(s := x["at"] >> 32)
                        count.append(n := (x["at"] & 0xFFFFFFFF) >> 1)
                        text.append(None if x["at"] & 1 else b" ".join(words[s : s + n + window - 1]))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(pa.array(row, pa.int32())) for c in ("doc_id", "t")], pa.array(anchor, pa.int64()), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(text, pa.binary())],
                    ["doc_id", "t", "anchor", "start", "count", "words"],
                )

    return run


def _ranked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs, in the order of the pairs: the nodes one level down."""
    pairs = x.astype(np.int64) * (int(y.max()) + 1 if len(y) else 1) + y
    return np.unique(pairs, return_inverse=True)[1].astype(np.int32)


def suffix_order(codes: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in order, and how many codes each has in common with the one before it (0 for the first).

    ends: for each place the end of its text, which no suffix goes beyond. Lengths in common are exact up to
    twice the least power of two that reaches ``least``, and at least that where they say so.
    """
    n = len(codes)
    place = np.arange(n)
    # Codes from 1 on; what is beyond a text's end is 0, and so less than any code.
    levels, size = [codes.astype(np.int32) + 1], 1
    while size < least:
        before = np.append(levels[-1], np.int32(0))
        after = np.where(place + size < ends, place + size, n)
        levels.append(_ranked(before[:-1], before[after]) + 1)
        size *= 2
    order = np.argsort(levels[-1], kind="stable")
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for level in range(len(levels) - 1, -1, -1):
        ranks, step = np.append(levels[level], np.int32(0)), 1 << level
        x, y = a + common[1:], b + common[1:]
        # Equal ranks of prefixes that lie within their texts are equal prefixes.
        inside = (x + step <= ends[a]) & (y + step <= ends[b])
        same = inside & (ranks[np.minimum(x, n)] == ranks[np.minimum(y, n)])
        common[1:] += np.where(same, step, 0)
    return order, common


def deep_nodes(common: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order, the number of the subtree at ``depth`` that it is in: neighbours with that much in common."""
    return np.cumsum(common < depth)


def maximal_repeats(codes: np.ndarray, ends: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Deepest internal nodes of the tree, of depth ``least`` or more: their depth, suffixes, and the first place.

    A node's depth is what all its suffixes have in common, so no longer run of codes occurs at all of them.
    """
    if not len(codes):
        return []
    order, common = suffix_order(codes, ends, max(least, int((ends - np.arange(len(codes))).max())))
    group = deep_nodes(common, least)
    heads = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    sizes = np.diff(np.append(heads, len(order)))
    depth = np.where(np.append(True, group[1:] != group[:-1]), np.iinfo(np.int64).max, common)
    return [(int(depth[h : h + n].min()), int(n), int(order[h : h + n].min())) for h, n in zip(heads.tolist(), sizes.tolist(), strict=True) if n > 1]


def _tree(rows: pa.Table, window: int) -> np.ndarray:
    """Rows are sorted by anchor, document, start. Rows, starts and lengths of marked stretches."""
    flat, counts = split_words(rows.column("words").combine_chunks().cast(pa.string()))
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ends = np.repeat(np.cumsum(counts), counts)
    order, common = suffix_order(codes, ends, window)
    whole = order + window <= ends[order]
    node = np.empty(len(codes), np.int64)
    node[order] = deep_nodes(common, window)
    starts = np.sort(order[whole])
    owner = np.repeat(np.arange(len(counts)), counts)[starts]
    inside = rows.column("start").to_numpy()[owner] + starts - (np.cumsum(counts) - counts)[owner]
    document = _documents(rows)[owner]
    # Rows are in order, so the first leaf of a node is its first occurrence within the group; equal windows share their anchor.
    later, first = _equal_to_first(np.argsort(node[starts], kind="stable"), node[starts])
    gone = np.zeros(len(starts), bool)
    gone[later[(document[later] != document[first]) | (inside[later] != inside[first])]] = True
    lost = np.flatnonzero(gone)
    heads, lengths = _runs(starts[lost], owner[lost])
    return np.stack([owner[lost[heads]], inside[lost[heads]], lengths])


def _documents(rows: pa.Table) -> np.ndarray:
    ids = rows.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    t = rows.column("t").to_numpy()
    return np.unique(np.stack([ids, t]), axis=1, return_inverse=True)[1].reshape(-1)


def _trees(window: int, portion: int):
    """Marked stretches of all groups; rows come sorted by anchor, document and start, and none has null words."""

    def marks(rows: pa.Table) -> pa.Table:
        owner, start, count = _tree(rows, window)
        own = pa.array(owner)
        return pa.table({"doc_id": rows.column("doc_id").take(own), "t": rows.column("t").take(own), "start": pa.array(start.astype(np.int32)), "count": pa.array(count.astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                held.append(batch)
                words += int(np.asarray(batch.column("count")).sum()) + (window - 1) * batch.num_rows
                if words < portion:
                    continue
                rows = pa.Table.from_batches(held)
                anchors = rows.column("anchor").to_numpy()
                cut = int(np.argmax(anchors == anchors[-1]))
                if not cut:
                    continue  # a group has a bounded number of rows, so its end is near
                yield from marks(rows.slice(0, cut)).to_batches()
                rows = rows.slice(cut)
                held, words = rows.to_batches(), int(np.asarray(rows.column("count").combine_chunks()).sum()) + (window - 1) * rows.num_rows
        if held:
            yield from marks(pa.Table.from_batches(held)).to_batches()

    return run


def _finished(window: int):
    """Counts and digest of each document from its words and the stretches of marked windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest = [], [], []
            for z, gone in zip(batch.column("z").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                words = _words_of(z)
                n = len(words)
                if gone:
                    edge = np.zeros(n + 1, np.int64)
                    for x in gone:
                        edge[x["start"]] += 1
                        edge[x["start"] + x["count"] + window - 1] -= 1
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                n_words.append(n)
                n_removed.append(n - len(words))
                digest.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, portion: int = PORTION, large: int = LARGE) -> DataFrame:
    """doc_id, n_words, n_removed and text (the words left, joined by one space) of every row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` words over it also starts earlier: in a document with a smaller doc_id
    (null is greatest), or earlier in its own. Windows are those of the input. A null text has no words. Rows
    with the same doc_id and text are one document, which both give; with the same doc_id but other texts they
    are documents in the order of their checksums. Other columns are dropped.
    """
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.crc32(text.cast("binary")).alias("t"), text.alias("text"))
    # Written once: the anchors are counted, in parts before the shuffle, before their rows are dealt.
    found = stored(keyed.mapInArrow(_found(window, anchor), f"doc_id {kind}, t long, anchor long, at long"))
    several = cut(found.filter("at & 1 = 0").groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    while several.filter(F.col("rows") > large).count() > MOST_LARGE:
        large *= 2
    release(docs.sparkSession)
    several = several.select("anchor", (F.col("rows") > large).alias("large"))
    found = found.join(several, "anchor", "left").filter("at & 1 = 1 or not large")
    texts = keyed.mapInArrow(_compressed, f"doc_id {kind}, t long, z binary")

    def listed(rows: DataFrame) -> DataFrame:
        """Stretches by document; rows that repeat a document give each of them once."""
        return rows.groupBy("doc_id", "t").agg(F.collect_set(F.struct("anchor", "at")).alias("list"))

    # Null-safe on both keys: so no filter is put before one of the two joins, and both read one exchange of the texts.
    def with_texts(side: DataFrame, column: str, how: str) -> DataFrame:
        own = side.select(F.col("doc_id").alias("d"), F.col("t").alias("u"), column)
        return texts.join(own, texts["doc_id"].eqNullSafe(F.col("d")) & texts["t"].eqNullSafe(F.col("u")), how).select("doc_id", "t", "z", column)

    # Rows that repeat a document send its stretches again, which changes nothing: a place is never earlier than itself.
    rows = with_texts(listed(found), "list", "inner").mapInArrow(_stretches(window), f"doc_id {kind}, t long, anchor long, start int, count int, words binary")
    ordered = rows.repartition("anchor").sortWithinPartitions("anchor", F.col("doc_id").asc_nulls_last(), "t", "start")
    shape = f"doc_id {kind}, t long, start int, count int"
    gone = ordered.mapInArrow(_marks_and(_trees(window, portion)), shape)
    split = several.filter("large").select("anchor").toArrow()["anchor"].to_numpy()  # MOST_LARGE at most
    if len(split):
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(split))
        gone = gone.unionByName(_later(stored(keyed.mapInArrow(_found(window, anchor, shared), f"doc_id {kind}, t long, start int, h1 long, h2 long"))))
    marked = gone.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "count")).alias("gone"))
    return with_texts(marked, "gone", "left").mapInArrow(_finished(window), f"doc_id {kind}, n_words long, n_removed long, text string")


def _later(windows: DataFrame) -> DataFrame:
    """Windows (doc_id, t, start, h1, h2) that are not the first of their words, as stretches of one window."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "start")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last")))
    later = windows.join(first.select("h1", "h2", "first"), ["h1", "h2"]).filter(~F.col("first").eqNullSafe(place))
    return later.select("doc_id", "t", "start", F.lit(1).alias("count")).distinct()


def _marks_and(trees):
    """Rows without words are marks already and pass; the others go to the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def real() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                none = batch.column("words").is_null()
                passed.append(batch.filter(none).select(["doc_id", "t", "start", "count"]))
                yield batch.filter(batch.column("words").is_valid())

        for got in trees(real()):
            yield from passed
            passed.clear()
            yield got
        yield from passed

    return run


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS t FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 19, 0))) AS i FROM d)
), f AS (
  SELECT t, min(struct_pack(doc_id, i)) AS first FROM s GROUP BY t
), c AS (
  SELECT DISTINCT doc_id, i + k AS j FROM (SELECT s.doc_id, s.i, unnest(range(20)) AS k FROM s JOIN f USING (t) WHERE struct_pack(s.doc_id, s.i) <> f.first)
), x AS (
  SELECT doc_id, unnest(range(len(w))) AS j, unnest(w) AS word FROM d
), y AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM x ANTI JOIN c USING (doc_id, j) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(y.n, 0))::BIGINT AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id)
"""
