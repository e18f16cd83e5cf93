"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its hashed words (each distinct word once, scaled to unit length together) and dense
statistics of its structure and size. Every feature i has a weight w_i and a short vector v_i; the score is
the logistic of

    b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],

which holds all pairwise products <v_i, v_j> x_i x_j at a cost linear in the number of features. The model is
fitted by mini-batch Adam on the driver, on a bounded sample of labelled texts; their features, not the texts,
are gathered there. Scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, first_of, labelled, table, word_hashes
from .stats import statistics

#: Labelled texts that a fit reads at most; those with the smallest id hashes are taken.
MAX_LABELLED = 6_000
#: Buckets of the hashed words, length of the vectors, passes over the sample.
BUCKETS, RANK, EPOCHS = 1 << 15, 6, 8
#: Scores from this on count as good.
THRESHOLD = 0.3
DENSE = 15


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense statistics (n x DENSE), then the distinct word buckets of all texts in a row and their numbers."""
    s, flat, counts = statistics(text)
    f = {k: v.astype(np.float64) for k, v in s.items()}
    words, size, lines = np.maximum(f["n_words"], 1), np.maximum(f["n_bytes"], 1), np.maximum(f["n_lines"], 1)
    letters = np.maximum(f["n_upper"] + f["n_lower"], 1)
    dense = np.stack(
        [
            np.log1p(f["n_words"]), np.log1p(f["n_bytes"]), np.log1p(f["n_lines"]),
            f["word_chars"] / words, f["n_symbols"] / words, np.sqrt(f["n_symbols"] / size), f["n_dup_lines"] / lines, f["n_repeat_words"] / words,
            f["n_upper"] / letters, f["n_digits"] / size, f["n_marks"] / words, f["n_distinct_words"] / words, np.log1p(f["longest_word"]),
            np.log1p(words / lines), (f["n_words"] == 0).astype(np.float64),
        ],
        axis=1,
    )
    owner = np.repeat(np.arange(len(counts)), counts)
    pairs = np.unique(owner * BUCKETS + (word_hashes(flat) % np.uint64(BUCKETS)).astype(np.int64))
    return dense, (pairs % BUCKETS).astype(np.int32), np.bincount(pairs // BUCKETS, minlength=len(counts))


@dataclass
class Machine:
    """Parameters: dense features first, then the buckets."""

    mean: np.ndarray
    scale: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def inputs(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -4, 4)

    def raw(self, dense: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic, with the inputs, the words' value and the factor sums."""
        x = self.inputs(dense)
        value = 1 / np.sqrt(np.maximum(counts, 1))
        at = codes.astype(np.int64) + DENSE
        owner = np.repeat(np.arange(len(counts)), counts)
        n = len(counts)
        linear = x @ self.w[:DENSE] + value * np.bincount(owner, weights=self.w[at], minlength=n)
        sums = x @ self.v[:DENSE]
        squares = (x * x) @ (self.v[:DENSE] ** 2)
        for f in range(self.v.shape[1]):
            own = self.v[at, f]
            sums[:, f] += value * np.bincount(owner, weights=own, minlength=n)
            squares[:, f] += value**2 * np.bincount(owner, weights=own * own, minlength=n)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1), x, value, sums

    def score(self, dense: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(dense, codes, counts)[0], -30, 30)))


def fit(dense: np.ndarray, codes: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rank: int = RANK, rate: float = 0.02, decay: float = 2e-3, seed: int = 5) -> Machine:
    """Fits the machine to 0/1 labels; codes are as shut() gives them. Without labels it knows nothing and scores 1/2."""
    rng = np.random.default_rng(seed)
    if not len(labels):
        return Machine(np.zeros(DENSE), np.ones(DENSE), 0.0, np.zeros(DENSE + BUCKETS), np.zeros((DENSE + BUCKETS, rank)))
    m = Machine(dense.mean(0), dense.std(0) + 1e-6, 0.0, np.zeros(DENSE + BUCKETS), rng.normal(0, 0.02, (DENSE + BUCKETS, rank)))
    p = (labels.sum() + 1) / (len(labels) + 2)
    m.bias = float(np.log(p / (1 - p)))
    state = {k: (np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))) for k in ("w", "v")}
    step, b0, b1 = 0, 0.0, 0.0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 128)):
            step += 1
            own_codes = [opened(codes[i]) for i in rows]
            counts = np.array([len(c) for c in own_codes])
            flat = np.concatenate(own_codes)
            raw, x, value, sums = m.raw(dense[rows], flat, counts)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) / len(rows)
            at, owner = flat.astype(np.int64) + DENSE, np.repeat(np.arange(len(rows)), counts)
            hit, where = np.unique(at, return_inverse=True)
            ev = err * value
            own = np.bincount(where, weights=ev[owner], minlength=len(hit))
            own2 = np.bincount(where, weights=(ev * value)[owner], minlength=len(hit))
            at_all = np.concatenate([np.arange(DENSE), hit])
            gw = np.concatenate([x.T @ err, own])
            gv = np.empty((len(at_all), rank))
            gv[:DENSE] = x.T @ (err[:, None] * sums) - ((x * x).T @ err)[:, None] * m.v[:DENSE]
            for f in range(rank):
                gv[DENSE:, f] = np.bincount(where, weights=(ev * sums[:, f])[owner], minlength=len(hit)) - own2 * m.v[hit, f]
            for name, g in (("w", gw), ("v", gv)):
                par, (a, b) = getattr(m, name), state[name]
                g = g + decay / 10 * par[at_all]
                a[at_all] = 0.9 * a[at_all] + 0.1 * g
                b[at_all] = 0.999 * b[at_all] + 0.001 * g * g
                par[at_all] -= rate * (a[at_all] / (1 - 0.9**step)) / (np.sqrt(b[at_all] / (1 - 0.999**step)) + 1e-8)
            b0, b1 = 0.9 * b0 + 0.1 * err.sum(), 0.999 * b1 + 0.001 * err.sum() ** 2
            m.bias -= rate * (b0 / (1 - 0.9**step)) / (np.sqrt(b1 / (1 - 0.999**step)) + 1e-8)
    return m


def shut(codes: np.ndarray) -> bytes:
    """A text's distinct buckets as two bytes each, or as a bit for every bucket where that is shorter."""
    if 16 * len(codes) < BUCKETS:
        return codes.astype("<u2").tobytes()
    bits = np.zeros(BUCKETS, bool)
    bits[codes] = True
    return np.packbits(bits).tobytes()


def opened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2") if 8 * len(data) < BUCKETS else np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        dense, codes, counts = features(batch.column("text"))
        own = [shut(c) for c in np.split(codes, np.cumsum(counts)[:-1])] if len(counts) else []
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, dense.size + 1, DENSE, dtype=np.int32)), pa.array(dense.ravel()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "t", "quality")], lists, pa.array(own, pa.binary())], ["doc_id", "t", "quality", "dense", "codes"])


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Machine:
    """Fits on at most ``limit`` of the labelled texts; a null label counts as none, of several the least.

    The driver gets ``limit`` rows at most, of 4 KB and a few numbers each, however long or often repeated the
    texts are. Rows that repeat an id with other texts count each; an empty table gives a machine that knows nothing.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = labelled(docs, labels, limit).mapInArrow(_gather, f"doc_id {kind}, t long, quality int, dense array<double>, codes binary")
    rows = first_of(rows, limit).toArrow().combine_chunks()
    rows = rows.sort_by([("doc_id", "ascending"), ("t", "ascending")])
    if not rows.num_rows:
        return fit(np.empty((0, DENSE)), [], np.empty(0))
    dense = rows["dense"].combine_chunks().flatten().to_numpy().reshape(-1, DENSE)
    return fit(dense, rows["codes"].to_pylist(), rows["quality"].to_numpy().astype(np.float64))


def score(docs: DataFrame, machine: Machine, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a column score, 0 to 1, of the whole text.

    Null and empty texts are scored as empty ones; a column named score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed number of parameters
    names = [c for c in (docs.columns if keep is None else keep) if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            got = shared.value.score(*features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(got)], [*names, "score"])

    shape = T.StructType([docs.schema[c] for c in names] + [T.StructField("score", T.DoubleType())])
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, shape)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no fit may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Score and prediction for every document; the fit never sees labels of the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels", False)
    machine = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = score(docs, machine, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
