"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Equal vectors are one class, compared once. Cell centres, in number a share of the square root of the classes,
are fitted on a sample of at most SAMPLE vectors, or PER_CENTRE for each centre where that is more; every vector
is indexed in its nearest cell and looks for partners there and in the cells nearest to it besides. A cell is
not looked into if no vector in it can be near enough: the plane between two centres is then too far away.
Within a cell, vectors are dealt to blocks of bounded size, and each task multiplies two blocks in double
precision; vectors travel in the precision they have. Tasks return, per vector, the number of its links and
the least vector that links within the blocks reach: pairs are never written out, so a cell of near copies
costs products but no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

#: Links join vectors of at least this cosine.
COSINE = 0.9
#: Vectors that centres are fitted on at most, and of each centre if that is more; steps of the fit; vectors' square roots for a centre.
SAMPLE, PER_CENTRE, STEPS, ROOTS = 20_000, 8, 12, 4
#: Cells besides its own that a vector looks into at most, and vectors of a block.
PROBES, BLOCK = 3, 4096


def unit_rows(vectors) -> np.ndarray:
    """Vectors of one length in double precision, scaled to unit length."""
    x = np.array(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length, as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def spherical_kmeans(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """k unit centres of unit vectors; a cell that loses its vectors starts anew from the worst-placed ones."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        near = x @ centres.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        length = np.sqrt((sums * sums).sum(axis=1))
        empty = length < 1e-9
        if empty.any():
            worst = np.argsort(near.max(axis=1))[: int(empty.sum())]
            sums[empty], length[empty] = x[worst], 1.0
        centres = sums / length[:, None]
    return centres


def cells_of(x: np.ndarray, centres: np.ndarray, probes: int, least: float) -> np.ndarray:
    """For each unit vector its nearest cell, then those of the next nearest that can hold a vector of cosine ``least`` to it; -1 for none."""
    near = x @ centres.T
    some = min(probes + 1, near.shape[1])
    part = np.argpartition(-near, some - 1, axis=1)[:, :some]
    order = np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1)
    own = np.take_along_axis(near, order, 1)
    # A vector of another cell lies beyond the plane between the two centres: at an angle whose sine is this, at least.
    apart = np.sqrt(np.maximum(((centres[order[:, :1]] - centres[order]) ** 2).sum(axis=2), 1e-30))
    far = (own[:, :1] - own) / apart > np.sqrt(max(0.0, 1 - least * least)) + 1e-9
    far[:, 0] = False
    return np.where(far, -1, order)


def _assign(centres: dict[int, np.ndarray], probes: int, least: float):
    """Gives every vector the cells it looks into, its own first; cells of all lengths of vectors are numbered apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                column = batch.column("embedding")
                size = np.asarray(column.value_lengths())
                cells = np.full((batch.num_rows, probes + 1), -1, np.int32)
                offset = 0
                for length in sorted(centres):
                    rows = np.flatnonzero(size == length)
                    if len(rows):
                        got = cells_of(unit_rows(_matrix(column.take(pa.array(rows)))), centres[length], probes, least)
                        cells[rows, : got.shape[1]] = np.where(got < 0, -1, got + offset)
                    offset += len(centres[length])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, probes + 1, dtype=np.int32)), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "cells"])

    return run


def joined(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``labels`` (of places, each a place of its group) after the links of places (left, right) have joined groups: the least place of each."""
    while True:
        a, b = labels[left], labels[right]
        differ = a != b
        if not differ.any():
            return labels
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        labels = parent[labels]


def _products(least: float):
    """One pair of blocks of one cell: rows that seek look for partners among the rows that live there."""

    def run(keys, rows):
        vec, copies = (rows.column(c).to_numpy() for c in ("vec_id", "copies"))
        seek, held = (np.flatnonzero(rows.column(c).to_numpy()) for c in ("seeks", "lives"))
        links, group = np.zeros(len(rows)), np.arange(len(rows))
        if len(seek) and len(held):
            x, cells, cell = unit_rows(_matrix(rows.column("embedding"))), _matrix(rows.column("cells")), keys[0].as_py()
            home = cells[:, 0]
            for at in range(0, len(seek), 512):
                some = seek[at : at + 512]
                i, j = np.nonzero(x[some] @ x[held].T >= least)
                i, j = some[i], held[j]
                differ = vec[i] != vec[j]
                i, j = i[differ], j[differ]
                links += np.bincount(i, weights=copies[j], minlength=len(rows))
                # A pair whose cells differ may be found in the cells of both; if this is the only one, both sides count it here.
                far = home[i] != cell
                once = far & ~(cells[j] == home[i][:, None]).any(axis=1)
                links += np.bincount(j[once], weights=copies[i[once]], minlength=len(rows))
                group = joined(group, i, j)
        # A row for each vector with links: how many, and a vector that they reach.
        hit = np.flatnonzero((links > 0) | (group != np.arange(len(rows))))
        return pa.table({"vec_id": pa.array(vec[hit]), "links": pa.array(links[hit].astype(np.int64)), "to": pa.array(vec[group[hit]])})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, probes: int = PROBES, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding).

    Vectors link when their cosine in double precision is at least ``cosine``; vectors of different lengths never
    do. Null and zero vectors and those with null or non-finite components link with nothing. Of a component the
    smallest vec_id is kept. Equal vectors are linked with each other and share all other links. A null vec_id
    is not part of any component; rows that repeat a vec_id are linked as copies if their vectors are equal.
    Links of vectors that are in no common cell are missed; recall is measured in the tests.
    """
    v = F.col("embedding")
    good = v.isNotNull() & F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    every = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    valid = good & F.col("vec_id").isNotNull()
    # A class is named by two hashes of its vector, so a vector that many rows hold is no large key.
    name = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2")]
    classes = every.filter(valid).groupBy(*name).agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    heads = cut(classes)

    lengths = {r["size"]: r["n"] for r in heads.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    centres = {}
    for size, n in sorted(lengths.items()):
        k = max(1, round(n**0.5 / ROOTS))
        most = max(sample // len(lengths) + 1, PER_CENTRE * k)
        chosen = heads.filter(F.size("embedding") == size).orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(n, most)).select("embedding").toArrow()
        centres[size] = spherical_kmeans(unit_rows(_matrix(chosen["embedding"])), k)
    rows = heads.select("vec_id", "embedding", "copies").mapInArrow(_assign(centres, probes, cosine), f"vec_id long, embedding {kind}, copies long, cells array<int>")

    # Of each cell: how many vectors live there and how many look into it give the numbers of its blocks.
    looks = rows.select(F.explode(F.filter("cells", lambda c: c >= 0)).alias("cell"), F.element_at("cells", 1).alias("home"))
    sizes = looks.groupBy("cell").agg(F.count(F.lit(1)).alias("seekers"), F.count_if(F.col("cell") == F.col("home")).alias("living"))
    # One row for each cell, of which there are as many as centres.
    sizes = F.broadcast(cut(sizes.select("cell", F.ceil(F.col("seekers") / block).cast("int").alias("p"), F.ceil(F.col("living") / block).cast("int").alias("q")).filter("q > 0")))
    spread = F.xxhash64("vec_id", F.lit(3))
    sent = rows.withColumn("cell", F.explode(F.filter("cells", lambda c: c >= 0))).join(sizes, "cell")
    sent = sent.withColumns({"home": F.col("cell") == F.element_at("cells", 1), "oi": F.pmod(spread, F.col("p")).cast("int"), "oj": F.pmod(spread, F.col("q")).cast("int")})
    # A vector goes once to each pair of blocks in which it seeks, lives, or does both.
    seeks = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: F.struct(F.col("oi").alias("i"), j.alias("j")))
    lives = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.struct(i.alias("i"), F.col("oj").alias("j")))
    sent = sent.withColumn("at", F.explode(F.when(F.col("home"), F.array_union(seeks, lives)).otherwise(seeks)))
    i, j = F.col("at.i"), F.col("at.j")
    sent = sent.select("cell", i.alias("i"), j.alias("j"), "vec_id", "embedding", "copies", "cells", (i == F.col("oi")).alias("seeks"), (F.col("home") & (j == F.col("oj"))).alias("lives"))
    found = cut(sent.groupBy("cell", "i", "j").applyInArrow(_products(cosine), "vec_id long, links long, to long"))

    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    ends = components(found.filter("vec_id <> to").select(F.col("vec_id").alias("a"), F.col("to").alias("b")))
    leads = heads.select("h1", "h2", "vec_id", "copies")
    heads_out = cut(leads.join(counts, "vec_id", "left").join(ends.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component")))
    keyed = every.select("vec_id", F.when(valid, name[0]).alias("h1"), F.when(valid, name[1]).alias("h2"))
    out = keyed.join(heads_out, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op2_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", False).select("vec_id", "embedding"))
