"""Encoding, access and re-encoding of blocks, and sweeps over configurations.

Blocks travel to codecs as rows (block_id, n, data array<int>); one Arrow pass per stage does all byte work of
a row, in memory bounded by an Arrow batch. Times are columns of their own, so results can leave them out.
"""

from __future__ import annotations

import resource
import time
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import position, reorder
from ..functions.params import Access, Ordering, Pattern, Transform
from ..operators import access as access_ops
from ..operators.codecs import registry
from ..operators.tiling import blocks, least, sample, sampled, shift_nonnegative
from ..operators.transform import CLASSES, SHIFT, array_transform, bound, transform
from ..sources.raster import Raster


def as_arrays(cells: DataFrame, keys: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """Long form to rows of keys, n and data (in order of the places)."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return cells.groupBy(*keys).agg(listed.alias("data")).select(*keys, F.size("data").alias("n"), F.transform("data", lambda x: x["v"].cast("int")).alias("data"))


def as_cells(rows: DataFrame) -> DataFrame:
    return rows.select("block_id", F.posexplode("data").alias("pos", "v"))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column as numpy arrays, without copying them one value at a time."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
    lengths = np.asarray(column.value_lengths().fill_null(0))
    return np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32), pa.int32()))


ENCODED = "block_id long, codec string, n int, payload binary, encoded_bytes long, sum32 int, encode_ns long"


def encode(rows: DataFrame, codec: str) -> DataFrame:
    """Rows of block_id, n and data as encoded blocks; the sum of a block's values stays beside its payload."""
    registry.by_name(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = registry.by_name(codec)
        for batch in batches:
            out, took, sums = [], [], []
            arrays = _arrays(batch.column("data"))
            for a in arrays:
                began = time.perf_counter_ns()
                out.append(own.encode(a))
                took.append(time.perf_counter_ns() - began)
                sums.append(int(a.sum(dtype=np.int32)))
            n = pa.array([len(a) for a in arrays], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("block_id"), pa.array([codec] * len(arrays), pa.string()), n, pa.array(out, pa.binary()), pa.array([len(x) for x in out], pa.int64()), pa.array(sums, pa.int32()), pa.array(took, pa.int64())],
                ["block_id", "codec", "n", "payload", "encoded_bytes", "sum32", "encode_ns"],
            )

    return rows.select("block_id", "n", "data").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame) -> DataFrame:
    """block_id, n, data and decode_ns of encoded blocks, each by the codec that its row names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, registry.Codec] = {}
        for batch in batches:
            out, took = [], []
            for name, n, payload in zip(*[batch.column(c).to_pylist() for c in ("codec", "n", "payload")], strict=True):
                own = known.get(name) or known.setdefault(name, registry.by_name(name))
                began = time.perf_counter_ns()
                out.append(own.decode(payload, n))
                took.append(time.perf_counter_ns() - began)
            yield pa.RecordBatch.from_arrays([batch.column("block_id"), batch.column("n"), _lists(out), pa.array(took, pa.int64())], ["block_id", "n", "data", "decode_ns"])

    return encoded.select("block_id", "codec", "n", "payload").mapInArrow(run, "block_id long, n int, data array<int>, decode_ns long")


def peak_mb() -> float:
    """The most memory that this process has held so far."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def bench(rows: DataFrame, codecs: list[str]) -> DataFrame:
    """Each block by each codec: status (ok, mismatch or the error), total (sum of the decoded values), cf (encoded over raw bytes), bpi (bytes per value), times, and the worker's peak memory.

    A codec that fails on a block says so in its row and is left out of means, rather than counting as zero.
    """
    for name in codecs:
        registry.by_name(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [registry.by_name(c) for c in codecs]
        for batch in batches:
            found: dict[str, list] = {k: [] for k in ("row", "codec", "n", "status", "total", "encoded_bytes", "encode_ns", "decode_ns", "peak_mb")}
            for i, a in enumerate(_arrays(batch.column("data"))):
                for codec in known:
                    size, total, t0, t1, t2 = None, None, 0, 0, 0
                    try:
                        t0 = time.perf_counter_ns()
                        data = codec.encode(a)
                        t1 = time.perf_counter_ns()
                        back = codec.decode(data, len(a))
                        t2 = time.perf_counter_ns()
                        size, total, status = len(data), int(back.sum(dtype=np.int64)), "ok" if np.array_equal(back, a) else "mismatch"
                    except Exception as e:  # the row tells
                        status = f"{type(e).__name__}: {e}"
                    for k, v in (("row", i), ("codec", codec.name), ("n", len(a)), ("status", status), ("total", total), ("encoded_bytes", size), ("encode_ns", t1 - t0), ("decode_ns", t2 - t1), ("peak_mb", peak_mb())):
                        found[k].append(v)
            kinds = {"codec": pa.string(), "n": pa.int32(), "status": pa.string(), "total": pa.int64(), "encoded_bytes": pa.int64(), "encode_ns": pa.int64(), "decode_ns": pa.int64(), "peak_mb": pa.float64()}
            keys = [batch.column(c).take(pa.array(found["row"], pa.int32())) for c in names]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(found[k], t) for k, t in kinds.items()]], [*names, *kinds])

    names = [c for c in rows.columns if c not in ("n", "data")]
    keys = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in names)
    out = rows.mapInArrow(run, f"{keys}, codec string, n int, status string, total long, encoded_bytes long, encode_ns long, decode_ns long, peak_mb double")
    size = F.col("encoded_bytes").cast("double")
    return out.withColumn("cf", size / (4 * F.col("n"))).withColumn("bpi", size / F.col("n"))


def codec_means(found: DataFrame, keys: tuple[str, ...] = ("codec",)) -> DataFrame:
    """Means and population variances of cf and bpi over the blocks that a codec got through, and how many failed."""
    ok = F.col("status") == "ok"
    each = [f(F.when(ok, F.col(c))).alias(f"{c}_{n}") for c in ("cf", "bpi") for n, f in (("mean", F.avg), ("var", F.var_pop))]
    return found.groupBy(*keys).agg(F.count_if(ok).alias("blocks"), F.count_if(~ok).alias("failed"), *each, F.avg(F.when(ok, F.col("encode_ns"))).alias("encode_ns"), F.avg(F.when(ok, F.col("decode_ns"))).alias("decode_ns"), F.max("peak_mb").alias("peak_mb"))


def prepared(raster: Raster, size: int, chosen: DataFrame | None, ordering: Ordering, kind: Transform, minimum: str = "full") -> DataFrame:
    """Cells of the chosen blocks (None: all), shifted, reordered, transformed: block_id, pos, v.

    minimum: whose least value shifts them, that of all full blocks ("full") or of the chosen ones ("sampled").
    A block chosen twice is one block here.
    """
    if minimum not in ("full", "sampled"):
        raise ValueError(f"minimum is full or sampled, not {minimum!r}")
    every = blocks(raster, size)
    own = every if chosen is None else every.join(chosen.select("block_id").distinct(), "block_id", "left_semi")
    shifted = shift_nonnegative(own, least(every if minimum == "full" else own))
    return transform(reorder(shifted, size, ordering), kind)


def versions(rows: DataFrame, size: int, orderings: list[Ordering], kinds: list[Transform]) -> DataFrame:
    """Rows (block_id, n, data in row-major order) in every ordering and transform: block_id, ordering, transform, n, data."""

    def ordered(o: Ordering) -> Column:
        return F.transform(F.array_sort(F.transform("data", lambda v, i: F.struct(position(i % size, F.floor(i / size).cast("int"), size, o).alias("p"), v.alias("v")))), lambda s: s["v"])

    def version(o: Ordering, t: Transform) -> Column:
        return F.struct(F.lit(str(o)).alias("ordering"), F.lit(str(t)).alias("transform"), bound(ordered(o), lambda d: array_transform(d, t)).alias("data"))

    each = [version(o, t) for o, t in product(orderings, kinds)]
    return rows.select("block_id", "n", F.explode(F.array(*each)).alias("x")).select("block_id", "x.ordering", "x.transform", "n", "x.data")


def compression_sweep(spark: SparkSession, raster: Raster, size: int, n: int | None, orderings: list[str], transforms: list[str], composites: list[str], names: list[str]) -> DataFrame:
    """Means by ordering, transform, composite and codec, over ``n`` sampled blocks (None: all full ones).

    Unknown names of any of them are errors before anything runs. Blocks are read, shifted and shuffled once; their
    versions are made from arrays, as rows, and each goes through all codecs of a composite in one pass.
    """
    parsed, kinds = [Ordering.parse(x) for x in orderings], [Transform.parse(x) for x in transforms]
    pools = [(kind, [c.name for c in registry.select(registry.pool(kind), names)]) for kind in composites]
    chosen = None if n is None else sample(spark, raster, size, n)
    rows = versions(as_arrays(prepared(raster, size, chosen, Ordering.ROW_MAJOR, Transform.NONE)), size, parsed, kinds)
    out = None
    for kind, codecs in pools:
        found = codec_means(bench(rows, codecs), ("ordering", "transform", "codec")).withColumn("composite", F.lit(kind))
        out = found if out is None else out.unionByName(found)
    return out


def _changed(kind: Access, v: np.ndarray) -> np.ndarray | int:
    """A block after an operation that changes it, else the operation's result; as the expressions give them."""
    v = v.astype(np.int64)
    whole = lambda a, b: np.trunc(a / b).astype(np.int64)
    if kind is Access.SUM or kind is Access.SUM_SIMD or kind is Access.SUM_FUSED:
        return int(v.sum()) if kind is Access.SUM else int(v.sum().astype(np.int32))
    if kind is Access.XOR:
        return int(np.bitwise_xor.reduce(v)) if len(v) else 0
    if not kind.mutates:
        raise ValueError(f"{kind} draws at random; use access()")
    if kind.transform is Transform.THRESHOLD:
        return (v >= whole(v.sum(), max(len(v), 1))).astype(np.int32)
    if kind.transform is Transform.SMOOTH_AND_SHIFT and len(v) > 1:
        wide = np.pad(v, 1)
        near = whole(wide[:-2] + wide[1:-1] + wide[2:], 3)
        near[0], near[-1] = whole(v[0] + v[1], 2), whole(v[-2] + v[-1], 2)
        return (near - min(int(near.min()), 0)).astype(np.int32)
    if kind.transform is Transform.INDEX_CLASSES:
        return np.minimum(np.arange(len(v)) // max(len(v) // CLASSES, 1), CLASSES - 1).astype(np.int32)
    if kind.transform is Transform.VALUE_CLASSES and len(v):
        step = int(v.max() - v.min()) // (CLASSES - 1)
        return (np.minimum((v - v.min()) // max(step, 1), CLASSES - 1) if step else np.zeros(len(v))).astype(np.int32)
    return (v + SHIFT if kind.transform is Transform.VALUE_SHIFT else v).astype(np.int32)


def repetitions(rows: DataFrame, first: str, kind: Access, second: str, reps: int) -> DataFrame:
    """One access ``reps`` times to every block, each time encoded anew by ``first``: one row.

    blocks, reps, checksum (results, or sums of changed blocks, of all repetitions); of each of the streams
    decode, transform and encode the number of observations, total, mean and population variance in nanoseconds,
    pooled over blocks and repetitions; and the workers' peak memory. Only changed blocks are encoded again.
    """
    for name in (first, second):
        registry.by_name(name)
    streams = ("decode", "transform", "encode")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, later = registry.by_name(first), registry.by_name(second)
        for batch in batches:
            out = []
            for a in _arrays(batch.column("data")):
                seen, check = np.zeros((3, 3)), 0
                for _ in range(reps):
                    data = base.encode(a)
                    t = [time.perf_counter_ns()]
                    back = base.decode(data, len(a))
                    t.append(time.perf_counter_ns())
                    got = _changed(kind, back)
                    t.append(time.perf_counter_ns())
                    if kind.mutates:
                        later.encode(got)
                        t.append(time.perf_counter_ns())
                    for k, ns in enumerate(np.diff(t).tolist()):
                        seen[k] += (1, ns, float(ns) ** 2)
                    check += int(got.sum(dtype=np.int64)) if kind.mutates else got
                out.append([check, *seen.ravel().tolist(), peak_mb()])
            names = ["checksum", *[f"{s}_{x}" for s in streams for x in ("n", "ns", "ns2")], "peak_mb"]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=pa.schema([("checksum", pa.int64()), *[(c, pa.float64()) for c in names[1:]]]))

    shape = "checksum long, " + ", ".join(f"{s}_{x} double" for s in streams for x in ("n", "ns", "ns2")) + ", peak_mb double"
    found = rows.select("data").mapInArrow(run, shape)
    pooled = []
    for s in streams:
        n, ns, ns2 = (F.sum(f"{s}_{x}") for x in ("n", "ns", "ns2"))
        mean = ns / F.nullif(n, F.lit(0.0))
        pooled += [n.cast("long").alias(f"{s}_n"), ns.alias(f"{s}_total"), mean.alias(f"{s}_mean"), F.greatest(ns2 / F.nullif(n, F.lit(0.0)) - mean * mean, F.lit(0.0)).alias(f"{s}_variance")]
    return found.agg(F.count(F.lit(1)).alias("blocks"), F.lit(reps).alias("reps"), F.sum("checksum").alias("checksum"), *pooled, F.max("peak_mb").alias("peak_mb"))


def run_access(spark: SparkSession, encoded: DataFrame, kind: Access, codec: str, pattern: Pattern = Pattern.LINEAR, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One access to every block of an encoded grid: (results, the grid after it).

    Operations that change blocks give them newly encoded by ``codec``; the others leave the grid as it was, and
    the fused sum reads no payload at all. The pattern is kept as each block's key in the visit.
    """
    visit = access_ops.visit_order(encoded.select("block_id"), pattern)
    if kind is Access.SUM_FUSED:
        return encoded.select("block_id", F.col("sum32").alias("result")).join(visit, "block_id"), encoded
    rows = decode(encoded)
    if kind.mutates:
        changed = rows.select("block_id", "n", array_transform(F.col("data"), kind.transform).alias("data"))
        again = encode(changed, codec)
        return again.select("block_id", F.col("sum32").alias("result")).join(visit, "block_id"), again
    if size is None and kind in (Access.RANDOM_XOR, Access.RANDOM_SUM):
        raise ValueError("random draws need the number of a block's cells")
    return access_ops.access(spark, as_cells(rows), kind, size or 0).join(visit, "block_id"), encoded


def pipeline_sweep(spark: SparkSession, raster: Raster, size: int, n: int, combos: list[tuple[str, str, str]], base: list[str], later: list[str], patterns: list[str]) -> DataFrame:
    """Every (ordering, initial transform, access) with every base codec, access codec and pattern.

    One row per configuration: blocks, total bytes before and after, and a checksum of the results. Names are
    checked before anything runs.
    """
    parsed = [(Ordering.parse(o), Transform.parse(t), Access.parse(a)) for o, t, a in combos]
    for name in [*base, *later]:
        registry.by_name(name)
    out = None
    for (o, t, a), first, second, pattern in product(parsed, base, later, [Pattern.parse(p) for p in patterns]):
        cells = prepared(raster, size, sample(spark, raster, size, n), o, t, "sampled")
        grid = encode(as_arrays(cells), first)
        results, after = run_access(spark, grid, a, second, pattern, size * size)
        one = results.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("result").cast("long")).alias("checksum"))
        sizes = grid.agg(F.sum("encoded_bytes").alias("bytes_before")).join(after.agg(F.sum("encoded_bytes").alias("bytes_after")))
        row = one.join(sizes).select(*[F.lit(str(v)).alias(k) for k, v in (("ordering", o), ("transform", t), ("access", a), ("base", first), ("later", second), ("pattern", pattern))], "*")
        out = row if out is None else out.unionByName(row)
    return out
