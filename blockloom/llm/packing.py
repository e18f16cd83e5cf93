"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A document's tokens and the closing id are cut only where they exceed a sequence. Pieces are dealt by hash to
shards of a bounded number of pieces. A shard's genome is a list of bins (groups); crossover injects whole
well-filled bins of one parent into the other, drops the other's bins that hold any of the same pieces, and
puts the pieces thereby displaced back by best fit. A shard whose pieces best fit puts into the least possible
number of bins is done at once. The others evolve as several islands, each begun from genomes and with random
numbers of its own; between rounds each island's elite migrates to the next island of the ring, and a shard
stops when one of its islands reaches the least number of bins. The least-filled bins of all shards are then dissolved and packed
again with those of other shards, level by level, until one shard is left. Shards are dealt so that they hold
several times the bins that may stay open, however short the pieces are, so each level has far fewer shards.

Genomes, not documents, travel between rounds: an island is one row with its lengths and its elite.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import chunks, cut, table

#: Tokens of a sequence, id that ends each document.
SEQUENCE, END = 4096, 1
#: Pieces of a shard, islands of a shard, rounds between which elites migrate.
SHARD, ISLANDS, ROUNDS = 1024, 3, 3
#: Genomes of an island, generations of a round, generations without progress that end it.
POPULATION, GENERATIONS, PATIENCE = 6, 12, 5
#: Shards that one task evolves.
SHARDS_OF_A_TASK = 16
#: Bins of a shard that are open to packing with those of other shards: the least filled, at most so many.
OPEN_BINS = 4
#: Bins that a shard's tokens fill at least, on average, where there are several shards.
LEAST_BINS = 4 * OPEN_BINS
#: Words that a worker remembers the ids of.
MEMORY = 1_500_000


# ---- tokens


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds(dict):
    """Ids of a word as little-endian uint32 bytes, found when first asked for.

    The vocabulary's rules (canonical composition, lower case, splits into letters, digits and other signs) never
    look across white space, so a text's ids are those of its words in order. Words in common Latin letters
    go straight to the merge rules; all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.plain = re.compile(r"[!-~\xa1-ž]+\Z").match
        self.ascii = re.compile(r"[!-~]+\Z").match
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
            self.known.clear()
        if self.plain(word) and "<|" not in word:
            lower = unicodedata.normalize("NFC", word).lower()
            found = b"".join([self.known.get(p) or self._part(p) for p in self.parts(lower)])
        else:
            found = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = found
        return found

    def _part(self, part: str) -> bytes:
        written = part if self.ascii(part) else "".join(map(self.letters.__getitem__, part.encode()))
        found = self.known[part] = np.array([t.id for t in self.merge(written)], "<u4").tobytes()
        return found

    def of(self, text: str) -> bytes:
        # str.split() also splits at these four, which the vocabulary does not.
        if _SEPARATORS.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


_SEPARATORS = re.compile("[\x1c-\x1f]")
_WORDS: dict[str, WordIds] = {}

PIECE = "doc_id {}, piece int, start long, length long, ids_crc32 long, shard_key long"


def pieces(docs: DataFrame, vocabulary: str, size: int = SEQUENCE) -> DataFrame:
    """Token pieces of each document: doc_id, piece, start, length, ids_crc32 and a key to deal them by."""
    ending = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORDS.get(vocabulary) or _WORDS.setdefault(vocabulary, WordIds(vocabulary))
        row, part_of = 0, TaskContext.get().partitionId()
        for batch in chunks(batches, "text"):
            at, number, start, length, crc, key = [], [], [], [], [], []
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                row += 1
                ids = words.of(text or "") + ending
                for n, a in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[a : a + 4 * size]
                    at.append(i)
                    number.append(n)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    # Equal texts, even under one id, are told apart by where they were read.
                    key.append(xxh3_64_intdigest(f"{doc},{part_of},{row},{n}") >> 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int32())), pa.array(number, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc, key)]],
                ["doc_id", "piece", "start", "length", "ids_crc32", "shard_key"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, PIECE.format(kind))


# ---- the genetic algorithm


class Rooms:
    """Open bins by the room left in them, for best fit."""

    def __init__(self, loads: dict[int, int], size: int):
        self.size = size
        self.by_room: dict[int, list[int]] = {}
        self.rooms: list[int] = []
        for b, load in loads.items():
            self.put(b, size - load)

    def put(self, b: int, room: int) -> None:
        if room in self.by_room:
            self.by_room[room].append(b)
        elif room > 0:
            self.by_room[room] = [b]
            insort(self.rooms, room)

    def best(self, length: int) -> tuple[int, int] | None:
        """Takes out the fullest bin with room for ``length``; its number and the room left then."""
        at = bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        own = self.by_room[room]
        b = own.pop()
        if not own:
            del self.by_room[room]
            self.rooms.pop(at)
        return b, room - length


def best_fit(lengths: list[int], order, bins: dict[int, list[int]], loads: dict[int, int], size: int) -> None:
    """Puts the pieces in ``order`` into the bins, each into the fullest that holds it, else into a new one."""
    rooms, new = Rooms(loads, size), max(bins, default=-1) + 1
    for i in order:
        got = rooms.best(lengths[i])
        if got is None:
            got = new, size - lengths[i]
            bins[new], loads[new] = [], 0
            new += 1
        b, room = got
        bins[b].append(i)
        loads[b] += lengths[i]
        rooms.put(b, room)


Genome = list[list[int]]


def fitness(genome: Genome, lengths: list[int], size: int) -> float:
    """Fewer bins first, then bins as unequally filled as may be."""
    return -len(genome) + sum((sum(lengths[i] for i in b) / size) ** 2 for b in genome) / (len(genome) + 1)


def crossover(one: Genome, two: Genome, lengths: list[int], size: int, rng: np.random.Generator) -> Genome:
    """The bins of ``two``, with well-filled bins of ``one`` injected whole and what they displace put back by best fit."""
    fill = np.array([sum(lengths[i] for i in b) for b in one]) / size
    want = max(1, int(len(one) * rng.uniform(0.2, 0.6)))
    inject = [one[k] for k in np.argsort(-(fill + rng.uniform(0, 0.1, len(one))))[:want]]
    taken = {i for b in inject for i in b}
    stay = [b for b in two if taken.isdisjoint(b)]
    displaced = [i for b in two if not taken.isdisjoint(b) for i in b if i not in taken]
    return _completed([list(b) for b in inject + stay], displaced, lengths, size)


def mutate(genome: Genome, lengths: list[int], size: int, rng: np.random.Generator) -> Genome:
    """Dissolves the least-filled bin and a few others, and packs their pieces anew."""
    loads = [sum(lengths[i] for i in b) for b in genome]
    gone = {int(np.argmin(loads)), *rng.integers(0, len(genome), max(1, len(genome) // 20)).tolist()}
    return _completed([list(b) for k, b in enumerate(genome) if k not in gone], [i for k in gone for i in genome[k]], lengths, size)


def _completed(bins: Genome, loose: list[int], lengths: list[int], size: int) -> Genome:
    named = dict(enumerate(bins))
    loads = {k: sum(lengths[i] for i in b) for k, b in named.items()}
    best_fit(lengths, sorted(loose, key=lambda i: -lengths[i]), named, loads, size)
    return list(named.values())


def start_genomes(lengths: list[int], size: int, count: int, rng: np.random.Generator, plain: bool = True) -> list[Genome]:
    """Best fit in falling order of length (unless not ``plain``), then in that order ever more disturbed."""
    whole = np.array(lengths)
    out = []
    for k in range(0 if plain else 1, count if plain else count + 1):
        noise = rng.uniform(1 - 0.1 * k, 1 + 0.1 * k, len(whole)) if k else 1
        bins: dict[int, list[int]] = {}
        best_fit(lengths, np.argsort(-whole * noise, kind="stable").tolist(), bins, {}, size)
        out.append(list(bins.values()))
        if len(out[0]) <= least_bins(lengths, size):
            break
    return out


def least_bins(lengths: list[int], size: int) -> int:
    """No packing has fewer bins: pieces of over half a bin need one each, and all need their sum."""
    return max(-(-sum(lengths) // size), sum(2 * x > size for x in lengths))


def evolve(lengths: list[int], elites: list[Genome], size: int, seed: int, generations: int = GENERATIONS, plain: bool = True) -> Genome:
    """One round of one island: its elite after some generations, begun from the given elites and start genomes."""
    rng = np.random.default_rng(seed)
    least = least_bins(lengths, size)
    pool = [*elites, *start_genomes(lengths, size, 2 if elites else POPULATION, rng, plain and not elites)]
    scored = sorted(((fitness(g, lengths, size), k, g) for k, g in enumerate(pool)), reverse=True)
    count, idle = len(pool), 0
    for _ in range(generations):
        if len(scored[0][2]) <= least or idle >= PATIENCE:
            break
        before = scored[0][0]
        for _ in range(2):
            a, b = rng.integers(0, len(scored), 2)
            child = crossover(scored[min(a, b)][2], scored[max(a, b)][2], lengths, size, rng) if a != b else mutate(scored[a][2], lengths, size, rng)
            if rng.random() < 0.3:
                child = mutate(child, lengths, size, rng)
            scored.append((fitness(child, lengths, size), count, child))
            count += 1
        scored = sorted(scored, reverse=True)[:POPULATION]
        idle = 0 if scored[0][0] > before else idle + 1
    return scored[0][2]


def _bins_of(genome: Genome, n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, b in enumerate(genome):
        out[b] = k
    return out


def _genome_of(bins: np.ndarray) -> Genome:
    order = np.argsort(bins, kind="stable")
    return [x.tolist() for x in np.split(order, np.cumsum(np.bincount(bins))[:-1])] if len(bins) else []


def _first_fit(size: int):
    """Each shard by best fit in falling order alone, which most shards need no more than."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [start_genomes(x, size, 1, np.random.default_rng(0))[0] for x in batch.column("lengths").to_pylist()]
            yield _state(batch, each, size)

    return run


def _round(number: int, size: int):
    """One round of every island in the rows: shard, island, lengths, elites (its own and its neighbour's; none at first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for shard, island, lengths, elites in zip(*[batch.column(c).to_pylist() for c in ("shard", "island", "lengths", "elites")], strict=True):
                start = [_genome_of(np.frombuffer(e, np.int32)) for e in elites or []]
                best.append(evolve(lengths, start, size, zlib.crc32(b"%d,%d,%d" % (shard, island, number)), plain=not island))
            yield _state(batch, best, size)

    return run


def _state(batch: pa.RecordBatch, best: list[Genome], size: int) -> pa.RecordBatch:
    lengths = batch.column("lengths").to_pylist()
    elite = [_bins_of(g, len(x)).tobytes() for g, x in zip(best, lengths, strict=True)]
    counts = [pa.array([len(g) for g in best], pa.int32()), pa.array([least_bins(x, size) for x in lengths], pa.int32())]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("shard", "island", "lengths")], pa.array(elite, pa.binary()), *counts], ["shard", "island", "lengths", "elite", "bins", "least"])


_STATE = "shard long, island int, lengths array<int>, elite binary, bins int, least int"


def migrated(state: DataFrame) -> DataFrame:
    """Islands with the elites they go on from: their own and that of the island before them in the ring."""
    ring = W.partitionBy("shard").orderBy("island")
    before = F.coalesce(F.lag("elite").over(ring), F.last("elite").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return state.select("shard", "island", "lengths", F.array("elite", before).alias("elites"))


def _evolved(items: DataFrame, shards: int, size: int, islands: int, rounds: int) -> DataFrame:
    """items: shard, list (sorted structs with length). Adds elite, the best genome of all islands and rounds."""
    lengths = items.select("shard", F.lit(0).alias("island"), F.transform("list", lambda x: x["length"].cast("int")).alias("lengths"))
    # Rows are small and slow: tasks are counted by shards, not by bytes.
    tasks = -(-shards // SHARDS_OF_A_TASK)
    state = cut(lengths.repartition(tasks, "shard").mapInArrow(_first_fit(size), _STATE))
    if rounds < 1:
        return items.join(state.select("shard", "elite"), "shard")
    done = [state.filter("bins <= least").select("shard", "elite")]
    open_ = state.filter("bins > least")
    apart = open_.select("shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "lengths", F.lit(None).cast("array<binary>").alias("elites"))
    for number in range(rounds):
        if open_.isEmpty():
            break
        moved = apart if not number else migrated(open_)
        state = cut(moved.repartition(islands * tasks, "shard", "island").mapInArrow(_round(number, size), _STATE))
        best = state.groupBy("shard").agg(F.min_by(F.struct("elite", "bins", "least"), F.struct("bins", "island")).alias("x")).select("shard", "x.*")
        over = best if number == rounds - 1 else best.filter("bins <= least")
        done.append(over.select("shard", "elite"))
        open_ = state.join(best.filter("bins > least").select("shard"), "shard", "left_semi")
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return items.join(whole, "shard")


def _placed(kind: str, size: int):
    """Rows of shard, list and elite as pieces with their bin, its load, and the piece's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = pa.RecordBatch.from_struct_array(batch.column("list").slice(i, 1).flatten())
                bins = np.frombuffer(batch.column("elite")[i].as_py(), np.int32)
                lengths = own.column("length").to_numpy()
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                heads = np.concatenate([[0], np.flatnonzero(np.diff(bins[order])) + 1])
                place = np.empty(len(bins), np.int64)
                place[order] = before - np.repeat(before[heads], np.diff(np.concatenate([heads, [len(bins)]])))
                load = np.bincount(bins, weights=lengths).astype(np.int64)
                # The least-filled bins, by rank; full ones are never open.
                rank = np.empty(len(load), np.int64)
                rank[np.argsort(load, kind="stable")] = np.arange(len(load))
                open_ = (rank < OPEN_BINS) & (load < size)
                shard = np.full(len(bins), batch.column("shard")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(shard), pa.array(bins.astype(np.int64)), pa.array(place), pa.array(open_[bins])],
                    [*own.schema.names, "shard", "bin", "offset", "open"],
                )

    return run


def pack(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, shard: int = SHARD, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """Pieces of all documents with the sequence each is in and its place there.

    docs: doc_id, text (null: empty); other columns are dropped. Returns doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Every document has at least one piece, as the closing id is part of it. Rows that
    repeat a doc_id are packed as documents of their own. An empty table gives an empty one.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, shard_key long, shard long, bin long, offset long, open boolean"
    level, rest = 0, cut(pieces(docs, vocabulary, size))
    packed = []
    # Full pieces are sequences of their own.
    full = rest.filter(F.col("length") == size).select("*", F.xxhash64("ids_crc32", "shard_key").alias("shard"), F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset"))
    packed.append(full.select("*", F.lit(-1).alias("level")))
    rest = rest.filter(F.col("length") < size)
    while True:
        # The rest of n shards is less than n * OPEN_BINS sequences, so the next level has at most a quarter of them.
        left = rest.agg(F.count(F.lit(1)).alias("pieces"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        n = max(1, min(-(-left["pieces"] // shard), left["tokens"] // (LEAST_BINS * size)))
        item = F.struct("doc_id", "piece", "start", "length", "ids_crc32", "shard_key")
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("shard_key", "ids_crc32", F.lit(level)), F.lit(n)))
        items = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("a"), item.alias("x")))).alias("list"))
        items = cut(items.select("shard", F.transform("list", lambda p: p["x"]).alias("list")))
        placed = cut(_evolved(items, n, size, islands, rounds).mapInArrow(_placed(kind, size), shape))
        if n == 1:
            packed.append(placed.drop("open").withColumn("level", F.lit(level)))
            break
        packed.append(placed.filter("not open").drop("open").withColumn("level", F.lit(level)))
        rest = placed.filter("open").select("doc_id", "piece", "start", "length", "ids_crc32", "shard_key")
        level += 1
    out = packed[0]
    for p in packed[1:]:
        out = out.unionByName(p)
    # A sequence's number: level, shard and bin; of full pieces, which are alone, any number of its own.
    named = F.when(F.col("level") < 0, -1 - F.col("bin")).otherwise(F.shiftleft(F.col("level").cast("long"), 56) + F.shiftleft("shard", 16) + F.col("bin"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", named.alias("sequence_id"), "offset")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
