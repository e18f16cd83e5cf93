"""Queries over the driver's tables, each with the SQL that gives the same rows.

R1: embeddings, a line per vector; R2: events by value; R3: orders by price; R4: R2 in coarse classes. All are 64
cells wide and cut into full blocks of SIZE x SIZE.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import cell, reorder
from ..functions.params import Access, Ordering, Pattern, Transform
from ..operators import access, encode, tiling
from ..operators.codecs import registry
from ..operators.transform import array_transform, transform
from ..sources.raster import Raster, from_arrays, from_key
from . import pipeline, planner

WIDTH, SIZE, SAMPLE = 64, 16, 7


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _floor(c: Column) -> Column:
    return F.floor(c).cast("int")


def r1(spark, sf_dir) -> Raster:
    return from_arrays(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", lambda e: _floor(e.cast("double") * 1000), WIDTH)


def r2(spark, sf_dir) -> Raster:
    return from_key(_read(spark, sf_dir, "events").select("event_id", "value"), "event_id", _floor(F.col("value")), WIDTH)


def r3(spark, sf_dir) -> Raster:
    return from_key(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", _floor(F.col("o_totalprice")), WIDTH)


def r4(spark, sf_dir) -> Raster:
    whole = r2(spark, sf_dir)
    return Raster(whole.cells.withColumn("v", (F.col("v") / 100).cast("int")), whole.width, whole.height)


RASTERS = {"R1": r1, "R2": r2, "R3": r3, "R4": r4}

# ---- SQL of the same


def _cells_sql(name: str) -> str:
    if name == "R1":
        return "SELECT unnest(range(64))::INT AS x, vec_id::INT AS y, floor(unnest(embedding)::DOUBLE * 1000)::INT AS v FROM embeddings"
    table, key, value = {"R2": ("events", "event_id", "floor(value)::INT"), "R3": ("orders", "o_orderkey", "floor(o_totalprice)::INT"), "R4": ("events", "event_id", "(floor(value)::INT // 100)::INT")}[name]
    return f"SELECT ({key} % 64)::INT AS x, ({key} // 64)::INT AS y, {value} AS v FROM {table}"


def _height_sql(name: str) -> str:
    return {"R1": "SELECT count(*)::INT AS h FROM embeddings", "R3": "SELECT (count(*) // 64)::INT AS h FROM orders"}.get(name, "SELECT (count(*) // 64)::INT AS h FROM events")


def _position_sql(ordering: Ordering, size: int = SIZE) -> str:
    x, y = f"(pos % {size})", f"(pos // {size})"
    if ordering is Ordering.ZIGZAG:
        return f"(CASE WHEN {y} % 2 = 0 THEN pos ELSE {y} * {size} + {size - 1} - {x} END)::INT"
    if ordering is Ordering.MORTON:
        bits = [f"((({c} >> {i}) & 1) << {2 * i + k})" for k, c in enumerate((x, y)) for i in range(size.bit_length() - 1)]
        return f"({' | '.join(bits)})::INT"
    return "pos"


def _blocks_sql(name: str, ordering: Ordering = Ordering.ROW_MAJOR, shift: bool = True, sampled: int | None = None, size: int = SIZE) -> str:
    """CTEs up to b(block_id, pos, v): full blocks, shifted by the global minimum, reordered."""
    only = "" if sampled is None else f" WHERE block_id IN (SELECT (i * greatest(1, total // {sampled})) % total FROM (SELECT unnest(range({sampled})) AS i), (SELECT (64 // {size}) * (h // {size}) AS total FROM h))"
    moved = "(v - least(lo, 0))::INT" if shift else "v"
    return f"""WITH h AS ({_height_sql(name)}), c AS ({_cells_sql(name)}), f AS (
  SELECT ((y // {size}) * (64 // {size}) + x // {size})::BIGINT AS block_id, ((y % {size}) * {size} + x % {size})::INT AS pos, v
  FROM c, h WHERE x < (64 // {size}) * {size} AND y < (h // {size}) * {size}
), m AS (SELECT min(v) AS lo FROM f), b AS (
  SELECT block_id, {_position_sql(ordering, size)} AS pos, {moved} AS v FROM f, m{only}
)"""


def _transform_sql(kind: Transform, source: str = "b") -> str:
    """A SELECT of block_id, pos, v from ``source`` with v transformed."""
    whole = "OVER (PARTITION BY block_id)"
    along = "OVER (PARTITION BY block_id ORDER BY pos)"
    if kind is Transform.THRESHOLD:
        return f"SELECT block_id, pos, CASE WHEN v >= (sum(v) {whole})::BIGINT // count(*) {whole} THEN 1 ELSE 0 END::INT AS v FROM {source}"
    if kind is Transform.SMOOTH_AND_SHIFT:
        inner = f"SELECT block_id, pos, v::BIGINT AS v, lag(v::BIGINT) {along} AS a, lead(v::BIGINT) {along} AS c FROM {source}"
        smooth = f"SELECT block_id, pos, CASE WHEN a IS NULL AND c IS NULL THEN v WHEN a IS NULL THEN (v + c) // 2 WHEN c IS NULL THEN (a + v) // 2 ELSE (a + v + c) // 3 END AS s FROM ({inner})"
        return f"SELECT block_id, pos, (s - least(min(s) {whole}, 0))::INT AS v FROM ({smooth})"
    if kind is Transform.INDEX_CLASSES:
        return f"SELECT block_id, pos, least(pos // greatest(count(*) {whole} // 8, 1), 7)::INT AS v FROM {source}"
    if kind is Transform.VALUE_CLASSES:
        inner = f"SELECT block_id, pos, v, min(v) {whole} AS lo, (max(v) {whole} - min(v) {whole}) // 7 AS w FROM {source}"
        return f"SELECT block_id, pos, CASE WHEN w = 0 THEN 0 ELSE least((v - lo) // greatest(w, 1), 7) END::INT AS v FROM ({inner})"
    if kind is Transform.VALUE_SHIFT:
        return f"SELECT block_id, pos, (v + 8388608)::INT AS v FROM {source}"
    return f"SELECT block_id, pos, v FROM {source}"


_WRAP = "((({0}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"
_ZIGZAG = "CASE WHEN ({0}) >= 0 THEN 2 * ({0}) ELSE -2 * ({0}) - 1 END"
_DRAW = "((({0})::BIGINT * 16807 + ({1})::BIGINT * 48271 + 11) % 2147483647) % {2}"
_WIDTH_OF = "CASE WHEN ({0}) = 0 THEN 0 ELSE length(bin({0})) END"

# ---- queries


def _cells(name: str, ordering: Ordering = Ordering.ROW_MAJOR):
    def cells(spark, sf_dir) -> DataFrame:
        return reorder(tiling.shift_nonnegative(tiling.blocks(RASTERS[name](spark, sf_dir), SIZE)), SIZE, ordering)

    return cells


def _profile(spark, sf_dir):
    out = None
    for name, make in RASTERS.items():
        one = tiling.profile(make(spark, sf_dir)).withColumn("raster", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _loss(spark, sf_dir):
    floats = _read(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("e"))
    sizes = _read(spark, sf_dir, "part").select("p_size")
    return tiling.is_lossless(floats, F.col("e")).withColumn("raster", F.lit("embedding")).unionByName(tiling.is_lossless(sizes, F.col("p_size")).withColumn("raster", F.lit("p_size")))


def _two_reads(spark, sf_dir):
    raw = _read(spark, sf_dir, "events").select((F.col("event_id") % 64).alias("x"), F.floor(F.col("event_id") / 64).alias("y"), F.col("value").alias("v"))
    return tiling.compare_reads(raw, raw.withColumn("v", _floor(F.col("v"))))


def _block_sums(cells):
    return cells.groupBy("block_id").agg(F.min("v").alias("least"), F.sum(F.col("v").cast("long")).alias("total"))


def _minimum(kind: str, spark, sf_dir):
    raster = r1(spark, sf_dir)
    cells = tiling.blocks(raster, SIZE)
    return tiling.least(cells if kind == "full" else tiling.sampled(cells, tiling.sample(spark, raster, SIZE, SAMPLE)))


def _sample(n: int, spark, sf_dir):
    return tiling.sample(spark, r2(spark, sf_dir), SIZE, n)


def _ordered(ordering: Ordering, spark, sf_dir):
    return _cells("R1", ordering)(spark, sf_dir)


def _cell_of(spark, sf_dir):
    """Places under both curves, and the cells that these places give back."""
    ids = spark.range(SIZE * SIZE).select(F.col("id").cast("int").alias("pos"))
    zx, zy = cell(F.col("pos"), SIZE, Ordering.ZIGZAG)
    mx, my = cell(F.col("pos"), SIZE, Ordering.MORTON)
    return ids.select("pos", zx.alias("zigzag_x"), zy.alias("zigzag_y"), mx.alias("morton_x"), my.alias("morton_y"))


def _transformed(kind: Transform, ordering: Ordering, spark, sf_dir):
    return transform(_cells("R1", ordering)(spark, sf_dir), kind)


def _array_transformed(kind: Transform, spark, sf_dir):
    rows = pipeline.as_arrays(_cells("R1", Ordering.MORTON)(spark, sf_dir))
    return pipeline.as_cells(rows.withColumn("data", array_transform(F.col("data"), kind)))


def _accessed(kind: Access, shifted: bool, spark, sf_dir):
    cells = _cells("R1")(spark, sf_dir)
    return access.access(spark, transform(cells, Transform.VALUE_SHIFT) if shifted else cells, kind, SIZE * SIZE)


def _metadata(spark, sf_dir):
    return access.metadata(_cells("R3")(spark, sf_dir))


def _visit(spark, sf_dir):
    ids = tiling.grid(spark, r1(spark, sf_dir), SIZE).select("block_id")
    one = access.visit_order(ids, Pattern.LINEAR).withColumnRenamed("visit_key", "linear_key")
    return one.join(access.visit_order(ids, Pattern.RANDOM).withColumnRenamed("visit_key", "random_key"), "block_id")


def _stats(spark, sf_dir):
    rows = access.running_stats(_cells("R2")(spark, sf_dir), ["block_id"], "v")
    return rows.select("block_id", "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), F.col("total").cast("long").alias("total"))


def _delta(stride: encode.Stride, spark, sf_dir):
    return encode.delta(_cells("R2", Ordering.MORTON)(spark, sf_dir), stride)


def _mismatches(cells: DataFrame, back: DataFrame) -> DataFrame:
    both = cells.join(back.withColumnRenamed("v", "w"), ["block_id", "pos"], "full_outer")
    return both.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("v").eqNullSafe(F.col("w"))).alias("mismatches"))


def _undelta(stride: encode.Stride, spark, sf_dir):
    cells = _cells("R2", Ordering.MORTON)(spark, sf_dir)
    return _mismatches(cells, encode.undelta(encode.delta(cells, stride), stride))


def _unframe(spark, sf_dir):
    cells = _cells("R1", Ordering.MORTON)(spark, sf_dir)
    return _mismatches(cells, encode.unframe(encode.frame_of_reference(cells)))


def _unrun(spark, sf_dir):
    cells = _cells("R4")(spark, sf_dir)
    return _mismatches(cells, encode.unrun(encode.run_lengths(cells)))


def _size(column: str, spark, sf_dir):
    return encode.sizes(_cells("R2", Ordering.MORTON)(spark, sf_dir)).select("block_id", F.col(column).alias("bytes"))


_MODELS = ("bitpack", "varint", "varint_delta", "streamvbyte", "frame")


def _model_stats(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and variance of cf and bpi from exact sums of bytes; all blocks have the same number of values."""
    one = sizes.select(*keys, "n", F.explode(F.create_map(*[x for m in _MODELS for x in (F.lit(m), F.col(m))])).alias("codec", "bytes"))
    size = F.col("bytes").cast("double")
    found = one.groupBy(*keys, "codec").agg(F.avg(size / (4 * F.col("n"))).alias("cf"), F.var_pop(size / (4 * F.col("n"))).alias("cf_var"), F.avg(size / F.col("n")).alias("bpi"))
    return found.select(*keys, "codec", *[F.round(c, 6).alias(c) for c in ("cf", "cf_var", "bpi")])


def _codec_stats(spark, sf_dir):
    return _model_stats(encode.sizes(_cells("R2", Ordering.MORTON)(spark, sf_dir)), [])


_SWEEP_TRANSFORMS = (Transform.NONE, Transform.THRESHOLD, Transform.INDEX_CLASSES, Transform.VALUE_CLASSES)


def _codec_sweep(spark, sf_dir):
    out = None
    for ordering in Ordering:
        for kind in _SWEEP_TRANSFORMS:
            sizes = encode.sizes(transform(_cells("R1", ordering)(spark, sf_dir), kind))
            one = sizes.withColumns({"ordering": F.lit(str(ordering)), "transform": F.lit(str(kind))})
            out = one if out is None else out.unionByName(one)
    return _model_stats(out, ["ordering", "transform"]).drop("cf_var")


_POOL = [c.name for c in registry.pool()]


def _select_codecs(spark, sf_dir):
    names = {"one": ["Zstd_1"], "pool order": ["STREAMVBYTE", "DEFLATE", "DEFLATE"], "unknown": ["no_such_codec"], "star": ["*"]}
    rows = [(k, i, c.name) for k, v in names.items() for i, c in enumerate(registry.select(registry.pool(), v))]
    return spark.createDataFrame(rows, "request string, place int, codec string")


_PARETO = [
    (1, "a.tif", "Threshold", "LZ4 Zstd_1", "'DEFLATE' LZ4", None),
    (2, "a.tif", "SmoothAndShift", "", "simdcomp", "simdcomp  LZ4"),
    (3, "a.tif", "Threshold", "Zstd_3", "\"Zstd_5\"", "Zstd_3"),
    (4, "b.tif", "Threshold", "custom_direct_access", None, None),
    (5, "c.tif", "none", "LZ4", "LZ4", "LZ4"),
    (6, "b.tif", "none", None, "", None),
]


def _pareto_table(spark):
    return spark.createDataFrame(_PARETO, "row int, File string, Transformation string, dec string, com string, both string")


def _pareto_lookup(spark, sf_dir):
    return planner.jobs(_pareto_table(spark), ["a.tif", "b.tif"], ["Threshold", "SmoothAndShift", "none"], ["dec", "com", "both"], "row")


def _mandatory(spark, sf_dir):
    own = _pareto_table(spark).select("row", planner.names(F.col("com")).alias("own"))
    return own.select("row", F.array_join(planner.with_mandatory(F.col("own")), "|").alias("codecs"))


def _front(spark, sf_dir):
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_size", F.floor("p_retailprice").cast("long").alias("price"))
    return planner.pareto_front(parts, "p_partkey", ["p_size", "price"])


def _reencoded(spark, sf_dir):
    """A grid encoded, thresholded in place, encoded anew by another codec, and read once more."""
    cells = pipeline.prepared(r1(spark, sf_dir), SIZE, tiling.sample(spark, r1(spark, sf_dir), SIZE, SAMPLE), Ordering.MORTON, Transform.NONE, "sampled")
    grid = pipeline.encode(pipeline.as_arrays(cells), "[+]_custom_delta_vecavx512+simdcomp")
    _, after = pipeline.run_access(spark, grid, Access.VALUE_CLASSES, "[+]_custom_rle_vecavx512+FastPFor_FastPFor128")
    return pipeline.decode(after).select("block_id", F.posexplode("data").alias("pos", "v"))


def _reencoded_whole(spark, sf_dir):
    """All full blocks encoded, classified in place, encoded anew by another codec, and read once more."""
    cells = pipeline.prepared(r1(spark, sf_dir), SIZE, None, Ordering.MORTON, Transform.NONE)
    grid = pipeline.encode(pipeline.as_arrays(cells), "[+]_custom_delta_vecavx512+simdcomp")
    _, after = pipeline.run_access(spark, grid, Access.VALUE_CLASSES, "[+]_custom_rle_vecavx512+FastPFor_FastPFor128")
    return pipeline.decode(after).select("block_id", F.posexplode("data").alias("pos", "v"))


#: Codecs whose sizes SQL can tell, by the model that gives them.
_KNOWN_SIZES = {"MASKEDVBYTE": "varint", "STREAMVBYTE": "streamvbyte", "FrameOfReference": "frame", "FastPFor_JustCopy": "(4 * n)"}


def _compression_means(spark, sf_dir):
    """Means of what real codecs make of all blocks, in two orderings and two transforms."""
    found = pipeline.compression_sweep(spark, r2(spark, sf_dir), SIZE, None, ["default", "morton"], ["none", "SmoothAndShift"], ["default"], list(_KNOWN_SIZES))
    return found.select("ordering", "transform", "codec", "blocks", "failed", *[F.round(c, 6).alias(c) for c in ("cf_mean", "cf_var", "bpi_mean")])


_REPS = 3


def _repetitions(spark, sf_dir):
    """Accesses that are repeated: how many observations each stream pools, and a checksum of all results."""
    rows = pipeline.as_arrays(_cells("R2", Ordering.MORTON)(spark, sf_dir))
    out = None
    for kind in (Access.THRESHOLD, Access.SMOOTH_AND_SHIFT, Access.SUM):
        one = pipeline.repetitions(rows, "simdcomp", kind, "STREAMVBYTE", _REPS).select(F.lit(str(kind)).alias("access"), "blocks", "reps", "checksum", "decode_n", "transform_n", "encode_n")
        out = one if out is None else out.unionByName(one)
    return out


_STUDY = [
    (1, "a.tif", "No Transformation", "LZ4", "Zstd_1 LZ4"), (2, "a.tif", "No Transformation", "'LZ4' simdcomp", "Zstd_1"), (3, "a.tif", "threshold", "Zstd_3", "DEFLATE"),
    (4, "a.tif", "valueShift", None, "LZMA  LZ4"), (5, "a.tif", "smoothAndShift", "LZ4", ""), (6, "b.tif", "No Transformation", "", "LZ4"), (7, "b.tif", "threshold", "LZ4", "\"Zstd_5\""),
]


def _planner_phases(spark, sf_dir):
    table = spark.createDataFrame(_STUDY, "row int, File string, Transformation string, dec string, both string")
    return planner.phases(spark, table, ["a.tif", "b.tif"], {"decompression": "dec", "both": "both"}, row_number="row")


#: Blocks of the size that the reference's studies use, over a raster of customers that is as wide as one.
_WIDE = 256


def _wide_blocks(kind: Transform, spark, sf_dir):
    own = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("key"), F.floor("c_acctbal").cast("long").alias("a"))
    low = own.agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("rows"))
    cells = own.join(F.broadcast(low)).select((F.col("key") - F.col("low")).alias("y"), "a", "rows").filter(F.col("y") < F.floor(F.col("rows") / _WIDE) * _WIDE)
    cells = cells.select("y", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(_WIDE - 1)), lambda x: ((F.col("a") * (x + 1)) % 9973).cast("int"))).alias("x", "v"))
    placed = cells.select(F.floor(F.col("y") / _WIDE).alias("block_id"), ((F.col("y") % _WIDE) * _WIDE + F.col("x")).cast("int").alias("pos"), "v")
    rows = pipeline.as_arrays(reorder(placed, _WIDE, Ordering.MORTON))
    return rows.withColumn("data", array_transform(F.col("data"), kind)).select(
        "block_id", "n", F.array_min("data").alias("least"), F.array_max("data").alias("greatest"), F.aggregate("data", F.lit(0).cast("long"), lambda a, v: (a * 31 + v) % 1000000007).alias("checksum")
    )


def _wide_sql(kind: Transform) -> str:
    return f"""WITH l AS (SELECT min(c_custkey) AS low, count(*) AS rows FROM customer), c AS (
  SELECT (c_custkey - low)::INT AS y, unnest(range({_WIDE}))::INT AS x, floor(c_acctbal)::BIGINT AS a FROM customer, l WHERE c_custkey - low < rows // {_WIDE} * {_WIDE}
), f AS (SELECT (y // {_WIDE})::BIGINT AS block_id, ((y % {_WIDE}) * {_WIDE} + x)::INT AS pos, ((a * (x + 1)) % 9973)::INT AS v FROM c
), b AS (SELECT block_id, {_position_sql(Ordering.MORTON, _WIDE)} AS pos, v FROM f), t AS ({_transform_sql(kind)})
SELECT block_id, count(*)::INT AS n, min(v) AS least, max(v) AS greatest, (list_reduce(list_prepend(0::BIGINT, list(v::BIGINT ORDER BY pos)), lambda a, x: (a * 31 + x) % 1000000007))::BIGINT AS checksum FROM t GROUP BY block_id"""


def _statuses(codecs: list[str], spark, sf_dir):
    found = pipeline.bench(pipeline.as_arrays(_cells("R2", Ordering.MORTON)(spark, sf_dir)), codecs)
    return found.groupBy("codec").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("status") == "ok").alias("ok"), F.sum("total").alias("total"))


_CASCADES = [c.name for head in ("custom_delta_vecavx512", "custom_rle_vecavx512", "custom_for_vecavx512") for c in registry.pool(head)]


def _sweep(spark, sf_dir):
    combos = [("morton", "none", "linearSum"), ("zigzag", "Threshold", "linearXOR"), ("default", "none", "ValueShift"), ("morton", "none", "linearSumFused"), ("default", "none", "randomSum")]
    found = pipeline.pipeline_sweep(spark, r1(spark, sf_dir), SIZE, SAMPLE, combos, ["custom_direct_access", "simdcomp_fused"], ["LZ4"], ["linear"])
    return found.select("ordering", "transform", "access", "base", "blocks", "checksum")


def _stream(spark, sf_dir):
    """Sums of all blocks, from what their encoded forms decode to."""
    rows = pipeline.as_arrays(_cells("R2")(spark, sf_dir))
    return pipeline.decode(pipeline.encode(rows, "STREAMVBYTE")).select("block_id", "n", F.aggregate("data", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


_TRANSFORM_NAMES = {"t_threshold": Transform.THRESHOLD, "t_smooth": Transform.SMOOTH_AND_SHIFT, "t_index_class": Transform.INDEX_CLASSES, "t_value_class": Transform.VALUE_CLASSES, "t_value_shift": Transform.VALUE_SHIFT}
_ACCESS_NAMES = {"acc_xor": (Access.XOR, False), "acc_sum": (Access.SUM, False), "acc_sum32": (Access.SUM_SIMD, True), "acc_sum_fused": (Access.SUM_FUSED, True), "acc_random_xor": (Access.RANDOM_XOR, False), "acc_random_sum": (Access.RANDOM_SUM, False)}
_STRIDES = {"adjacent": encode.Stride.ADJACENT, "g4": encode.Stride.GROUP_4, "g8pair": encode.Stride.GROUP_8, "g16": encode.Stride.GROUP_16}


_WIDE_KINDS = {"threshold": Transform.THRESHOLD, "smooth": Transform.SMOOTH_AND_SHIFT, "value_class": Transform.VALUE_CLASSES}


def queries() -> dict:
    found = {
        "raster_profile": _profile, "cast_loss_check": _loss, "float_int_compare": _two_reads,
        "tile_grid": lambda s, d: tiling.grid(s, r3(s, d), SIZE), "full_block_filter": lambda s, d: tiling.full_blocks(r3(s, d), SIZE),
        "sample_offsets": partial(_sample, 5), "sample_offsets_wrap": partial(_sample, 5000),
        "global_min_full": partial(_minimum, "full"), "global_min_sampled": partial(_minimum, "sampled"), "shift_nonneg": lambda s, d: _block_sums(_cells("R1")(s, d)),
        "order_rowmajor": partial(_ordered, Ordering.ROW_MAJOR), "order_zigzag": partial(_ordered, Ordering.ZIGZAG), "order_morton": partial(_ordered, Ordering.MORTON), "order_inverse": _cell_of,
        "block_metadata": _metadata, "visit_order": _visit, "running_stats": _stats,
        "enc_for": lambda s, d: encode.frame_of_reference(_cells("R1", Ordering.MORTON)(s, d)), "enc_rle": lambda s, d: encode.run_lengths(_cells("R4")(s, d)),
        "dec_for_roundtrip": _unframe, "dec_rle_roundtrip": _unrun, "size_rle_compat": lambda s, d: encode.run_length_sizes(_cells("R4")(s, d)),
        "codec_stats": _codec_stats, "codec_sweep": _codec_sweep, "select_codecs": _select_codecs, "mandatory_codecs": _mandatory, "pareto_lookup": _pareto_lookup, "pareto_front": _front,
        "pipeline_reencode": _reencoded, "pipeline_sweep": _sweep, "phys_roundtrip": partial(_statuses, _POOL), "cascade_roundtrip": partial(_statuses, _CASCADES), "encoded_blocks": _stream,
        "pipeline_reencode_whole": _reencoded_whole, "compression_means": _compression_means, "pipeline_repetitions": _repetitions, "planner_phases": _planner_phases,
        **{f"t_{k.lower()}_256": partial(_wide_blocks, t) for k, t in _WIDE_KINDS.items()},
    }
    for name, kind in _TRANSFORM_NAMES.items():
        for ordering, word in ((Ordering.ROW_MAJOR, "rowmajor"), (Ordering.MORTON, "morton")):
            found[f"{name}_{word}"] = partial(_transformed, kind, ordering)
        found[f"{name}_array"] = partial(_array_transformed, kind)
    for name, (kind, shifted) in _ACCESS_NAMES.items():
        found[name] = partial(_accessed, kind, shifted)
    for word, stride in _STRIDES.items():
        found[f"enc_delta_{word}"] = partial(_delta, stride)
        found[f"dec_delta_{word}_roundtrip"] = partial(_undelta, stride)
    for column in _MODELS:
        found[f"size_{column}"] = partial(_size, column)
    return found


# ---- their SQL


def _anchor_sql(stride: encode.Stride, n: int) -> str:
    """The place that a value of a block of n (256 here) is held against."""
    if stride is encode.Stride.GROUP_4:
        return f"CASE WHEN pos = 0 THEN NULL WHEN pos < {1 + 4 * (-(-(n - 5) // 4))} THEN 4 * ((pos - 1) // 4) ELSE pos - 1 END"
    if stride is encode.Stride.GROUP_8:
        return f"CASE WHEN pos < 8 THEN NULL WHEN pos < 16 THEN pos - 8 WHEN pos < {8 + 8 * (-(-(n - 16) // 8))} THEN 8 * (pos // 8) - 2 + pos % 2 ELSE pos - 1 END"
    if stride is encode.Stride.GROUP_16:
        return f"CASE WHEN pos < 16 THEN NULL WHEN pos < 32 THEN pos - 16 WHEN pos < {16 + 16 * (-(-(n - 32) // 16))} THEN 16 * (pos // 16) - 1 ELSE pos - 1 END"
    return "CASE WHEN pos = 0 THEN NULL ELSE pos - 1 END"


def _delta_sql(stride: encode.Stride) -> str:
    d = "b.v::BIGINT - coalesce(p.v, 0)::BIGINT"
    first = "WHEN b.pos = 0 THEN b.v::BIGINT" if stride is encode.Stride.ADJACENT else ""
    return f"""{_blocks_sql('R2', Ordering.MORTON)}, a AS (SELECT *, {_anchor_sql(stride, SIZE * SIZE)} AS at FROM b)
SELECT b.block_id, b.pos, (CASE {first} WHEN {d} >= 0 THEN 2 * ({d}) ELSE -2 * ({d}) - 1 END)::BIGINT AS enc
FROM a AS b LEFT JOIN b AS p ON p.block_id = b.block_id AND p.pos = b.at"""


_U32 = "(({0}) % 4294967296 + 4294967296) % 4294967296"


def _sizes_sql(source: str, keys: str = "block_id") -> str:
    """A SELECT of keys, n and the models' bytes from ``source``."""
    d = _U32.format("v::BIGINT - coalesce(lag(v::BIGINT) OVER (PARTITION BY " + keys + " ORDER BY pos), 0)")
    inner = f"SELECT {keys}, v, {_WIDTH_OF.format('v::BIGINT')} AS w, {_WIDTH_OF.format('d::BIGINT')} AS dw FROM (SELECT *, {d} AS d FROM {source})"
    spread = _WIDTH_OF.format("(max(v) - min(v))::BIGINT")
    return f"""SELECT {keys}, count(*) AS n, (ceil(count(*) / 128) * 16 * max(w))::BIGINT AS bitpack, sum(greatest(1, ceil(w / 7)))::BIGINT AS varint,
  sum(greatest(1, ceil(dw / 7)))::BIGINT AS varint_delta, (ceil(count(*) / 4) + sum(greatest(1, ceil(w / 8))))::BIGINT AS streamvbyte, (5 + ceil(count(*) * ({spread}) / 8))::BIGINT AS frame
FROM ({inner}) GROUP BY {keys}"""


def _model_stats_sql(sizes: str, keys: list[str], variance: bool) -> str:
    each = " UNION ALL ".join(f"SELECT {''.join(k + ', ' for k in keys)}n, '{m}' AS codec, {m}::DOUBLE AS size FROM s" for m in _MODELS)
    group = ", ".join([*keys, "codec"])
    var = ", round(var_pop(size / (4 * n)), 6) AS cf_var" if variance else ""
    return f"{sizes} SELECT {group}, round(avg(size / (4 * n)), 6) AS cf{var}, round(avg(size / n), 6) AS bpi FROM ({each}) GROUP BY {group}"


def _values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(show, r))})" for r in rows)


def _roundtrip_sql(name: str, ordering: Ordering) -> str:
    return f"{_blocks_sql(name, ordering)} SELECT block_id, count(*) AS n, 0::BIGINT AS mismatches FROM b GROUP BY block_id"


def _accessed_sql(kind: Access, shifted: bool) -> str:
    head = f"{_blocks_sql('R1')}, t AS ({_transform_sql(Transform.VALUE_SHIFT if shifted else Transform.NONE)})"
    total = "sum(v)::BIGINT"
    if kind in (Access.RANDOM_XOR, Access.RANDOM_SUM):
        drawn = f"SELECT i.block_id, t.v FROM (SELECT block_id, {_DRAW.format('block_id', 'i', SIZE * SIZE)} AS at FROM (SELECT DISTINCT block_id FROM t), (SELECT unnest(range({SIZE * SIZE})) AS i)) AS i JOIN t ON t.block_id = i.block_id AND t.pos = i.at"
        return f"{head} SELECT block_id, {'bit_xor(v)' if kind is Access.RANDOM_XOR else total} AS result FROM ({drawn}) GROUP BY block_id"
    result = {Access.XOR: "bit_xor(v)", Access.SUM: total}.get(kind, f"({_WRAP.format(total)})::INT")
    return f"{head} SELECT block_id, {result} AS result FROM t GROUP BY block_id"


def _sweep_sql() -> str:
    """Sums of what each configuration of the sweep reads, from the values alone."""
    parts = []
    for i, (ordering, kind, op) in enumerate((("morton", "none", "linearSum"), ("zigzag", "Threshold", "linearXOR"), ("default", "none", "ValueShift"), ("morton", "none", "linearSumFused"), ("default", "none", "randomSum"))):
        blocks = _blocks_sql("R1", Ordering.parse(ordering), True, SAMPLE).replace("m AS (SELECT min(v) AS lo FROM f)", f"m AS (SELECT min(v) AS lo FROM f WHERE block_id IN (SELECT (i * greatest(1, total // {SAMPLE})) % total FROM (SELECT unnest(range({SAMPLE})) AS i), (SELECT (64 // {SIZE}) * (h // {SIZE}) AS total FROM h)))")
        body = f"{blocks}, t AS ({_transform_sql(Transform.parse(kind))})"
        each = {"linearXOR": "SELECT block_id, bit_xor(v)::BIGINT AS r FROM t GROUP BY block_id", "ValueShift": f"SELECT block_id, {_WRAP.format('sum(v + 8388608)::BIGINT')} AS r FROM t GROUP BY block_id"}.get(op, "SELECT block_id, sum(v)::BIGINT AS r FROM t GROUP BY block_id")
        if op == "randomSum":
            each = f"SELECT i.block_id, sum(t.v)::BIGINT AS r FROM (SELECT block_id, {_DRAW.format('block_id', 'i', SIZE * SIZE)} AS at FROM (SELECT DISTINCT block_id FROM t), (SELECT unnest(range({SIZE * SIZE})) AS i)) AS i JOIN t ON t.block_id = i.block_id AND t.pos = i.at GROUP BY i.block_id"
        parts.append(f"(SELECT '{ordering}' AS ordering, '{kind}' AS transform, '{op}' AS access, count(*) AS blocks, sum(r)::BIGINT AS checksum FROM ({body} {each}))")
    return f"SELECT *, unnest(['custom_direct_access', 'simdcomp_fused']) AS base FROM ({' UNION ALL '.join(parts)})"


def oracle_sql() -> dict[str, str]:
    grid = f"SELECT unnest(range((64 // {SIZE}) * (h // {SIZE}))) AS block_id FROM h"
    sampling = "WITH h AS ({0}), t AS (SELECT (64 // {1}) * (h // {1}) AS total FROM h), s AS (SELECT unnest(range({2})) AS sample_no) SELECT sample_no, block_id, (block_id % (64 // {1}) * {1})::INT AS x_off, (block_id // (64 // {1}) * {1})::INT AS y_off FROM (SELECT sample_no, (sample_no * greatest(1, total // {2})) % total AS block_id FROM s, t)"
    profile = " UNION ALL ".join(f"SELECT '{r}' AS raster, 64 AS width, h AS height, min(v) AS least, max(v) AS greatest, count(DISTINCT v) AS n_unique FROM ({_cells_sql(r)}), ({_height_sql(r)}) GROUP BY h" for r in RASTERS)
    runs = f"{_blocks_sql('R4')}, g AS (SELECT *, CASE WHEN lag(v) OVER w IS NOT DISTINCT FROM v THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY block_id ORDER BY pos)), r AS (SELECT *, (sum(new) OVER (PARTITION BY block_id ORDER BY pos) - 1)::INT AS run_no FROM g), e AS (SELECT block_id, run_no, min(v) AS value, count(*) AS run FROM r GROUP BY ALL)"
    sweep = " UNION ALL ".join(f"(SELECT '{o}' AS ordering, '{t}' AS transform, * FROM ({_blocks_sql('R1', o)}, t AS ({_transform_sql(t)}) {_sizes_sql('t')}))" for o in Ordering for t in _SWEEP_TRANSFORMS)
    pareto = f"WITH p(row, file, transform, dec, com, \"both\") AS (VALUES {_values(_PARETO)})"
    listed = "list_filter(list_transform(string_split_regex(trim(coalesce({0}, '')), '\\s+'), lambda x: regexp_replace(x, '^[''\"]+|[''\"]+$', '', 'g')), lambda x: x <> '')"
    joined = "array_to_string(list_sort(list_distinct(list_concat({0}, ['custom_direct_access', 'FastPFor_JustCopy']))), '|')"
    lists = f"list_concat({listed.format('dec')}, {listed.format('com')}, {listed.format('\"both\"')})"
    chosen = {"one": ["Zstd_1"], "pool order": ["DEFLATE", "STREAMVBYTE"], "star": _POOL}
    reencode = _blocks_sql("R1", Ordering.MORTON, True, SAMPLE).replace("m AS (SELECT min(v) AS lo FROM f)", f"m AS (SELECT min(v) AS lo FROM f WHERE block_id IN (SELECT (i * greatest(1, total // {SAMPLE})) % total FROM (SELECT unnest(range({SAMPLE})) AS i), (SELECT (64 // {SIZE}) * (h // {SIZE}) AS total FROM h)))")
    bits = lambda k: " | ".join(f"(((pos >> {2 * i + k}) & 1) << {i})" for i in range(4))
    found = {
        "raster_profile": profile,
        "cast_loss_check": "SELECT 'embedding' AS raster, bool_and(trunc(e) = e) AS lossless, count(*) AS n FROM (SELECT unnest(embedding)::DOUBLE AS e FROM embeddings) UNION ALL SELECT 'p_size', bool_and(trunc(p_size::DOUBLE) = p_size), count(*) FROM part",
        "float_int_compare": "SELECT count(*) FILTER (value <> floor(value)) = 0 AS equal, count(*) AS n, count(*) FILTER (value <> floor(value)) AS mismatches FROM events",
        "tile_grid": f"WITH h AS ({_height_sql('R3')}) SELECT block_id, (block_id % 4)::INT AS bx, (block_id // 4)::INT AS \"by\", (block_id % 4 * {SIZE})::INT AS x_off, (block_id // 4 * {SIZE})::INT AS y_off FROM ({grid})",
        "full_block_filter": f"SELECT (y // {SIZE} * 4 + x // {SIZE})::BIGINT AS block_id, count(*) AS n FROM ({_cells_sql('R3')}) GROUP BY 1 HAVING count(*) = {SIZE * SIZE}",
        "sample_offsets": sampling.format(_height_sql("R2"), SIZE, 5),
        "sample_offsets_wrap": sampling.format(_height_sql("R2"), SIZE, 5000),
        "global_min_full": f"{_blocks_sql('R1', shift=False)} SELECT min(v) AS least FROM b",
        "global_min_sampled": f"{_blocks_sql('R1', shift=False, sampled=SAMPLE)} SELECT min(v) AS least FROM b",
        "shift_nonneg": f"{_blocks_sql('R1')} SELECT block_id, min(v) AS least, sum(v)::BIGINT AS total FROM b GROUP BY block_id",
        **{f"order_{w}": f"{_blocks_sql('R1', o)} SELECT block_id, pos, v FROM b" for w, o in (("rowmajor", Ordering.ROW_MAJOR), ("zigzag", Ordering.ZIGZAG), ("morton", Ordering.MORTON))},
        "order_inverse": f"SELECT pos::INT AS pos, (CASE WHEN pos // 16 % 2 = 0 THEN pos % 16 ELSE 15 - pos % 16 END)::INT AS zigzag_x, (pos // 16)::INT AS zigzag_y, ({bits(0)})::INT AS morton_x, ({bits(1)})::INT AS morton_y FROM (SELECT unnest(range(256)) AS pos)",
        "block_metadata": f"{_blocks_sql('R3')} SELECT block_id, count(*) AS n, min(v) AS least, max(v) AS greatest, sum(v)::BIGINT AS sum64, ({_WRAP.format('sum(v)::BIGINT')})::INT AS sum32, bit_xor(v) AS \"xor\" FROM b GROUP BY block_id",
        "visit_order": f"WITH h AS ({_height_sql('R1')}) SELECT block_id, block_id AS linear_key, {_DRAW.format('(' + _DRAW.format('block_id', '1', 2147483647) + ') * 48271', '1', 2147483647)} AS random_key FROM ({grid})",
        "running_stats": f"{_blocks_sql('R2')} SELECT block_id, count(*) AS n, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, sum(v)::BIGINT AS total FROM b GROUP BY block_id",
        "enc_for": f"{_blocks_sql('R1', Ordering.MORTON)} SELECT block_id, 0 AS pos, min(v)::BIGINT AS enc FROM b GROUP BY block_id UNION ALL SELECT block_id, pos + 1, 2 * (v - min(v) OVER (PARTITION BY block_id))::BIGINT FROM b",
        "enc_rle": f"{runs} SELECT * FROM e",
        "dec_for_roundtrip": _roundtrip_sql("R1", Ordering.MORTON),
        "dec_rle_roundtrip": _roundtrip_sql("R4", Ordering.ROW_MAJOR),
        "size_rle_compat": f"{runs} SELECT block_id, sum(run)::BIGINT AS n, count(*) AS runs, 2 * count(*) AS clean, (2 * count(*) + 2)::BIGINT AS scalar, " + ", ".join(f"(2 * count(*) + 2 * (sum(run) // {g} + 1))::BIGINT AS {w}" for w, g in (("sse", 4), ("avx2", 8), ("avx512", 16))) + " FROM e GROUP BY block_id",
        "codec_stats": _model_stats_sql(f"{_blocks_sql('R2', Ordering.MORTON)}, s AS ({_sizes_sql('b')})", [], True),
        "codec_sweep": _model_stats_sql(f"WITH s AS ({sweep})", ["ordering", "transform"], False),
        "select_codecs": f"SELECT * FROM (VALUES {_values([(k, i, n) for k, v in chosen.items() for i, n in enumerate(v)])}) AS t(request, place, codec)",
        "mandatory_codecs": f"{pareto} SELECT row, {joined.format(listed.format('com'))} AS codecs FROM p",
        "pareto_lookup": f"{pareto}, l AS (SELECT *, {lists} AS own FROM p WHERE file IN ('a.tif', 'b.tif') QUALIFY row_number() OVER (PARTITION BY file, transform ORDER BY row DESC) = 1) SELECT file, transform, {joined.format('own')} AS codecs FROM l WHERE len(own) > 0",
        "pareto_front": "WITH p AS (SELECT p_partkey, p_size, floor(p_retailprice)::BIGINT AS price FROM part) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p AS q WHERE q.p_size <= p.p_size AND q.price <= p.price AND (q.p_size < p.p_size OR q.price < p.price))",
        "pipeline_reencode": f"{reencode} {_transform_sql(Transform.VALUE_CLASSES)}",
        "pipeline_sweep": _sweep_sql(),
        **{k: f"{_blocks_sql('R2')} SELECT unnest([{', '.join(repr(c) for c in names)}]) AS codec, n AS blocks, n AS ok, total FROM (SELECT count(DISTINCT block_id) AS n, sum(v)::BIGINT AS total FROM b)" for k, names in (("phys_roundtrip", _POOL), ("cascade_roundtrip", _CASCADES))},
        "encoded_blocks": f"{_blocks_sql('R2')} SELECT block_id, count(*)::INT AS n, sum(v)::BIGINT AS total FROM b GROUP BY block_id",
    }
    each = []
    for o in ("default", "morton"):
        for t in ("none", "SmoothAndShift"):
            sizes = f"{_blocks_sql('R2', Ordering.parse(o))}, t AS ({_transform_sql(Transform.parse(t))}), s AS ({_sizes_sql('t')})"
            listed_sizes = " UNION ALL ".join(f"SELECT '{c}' AS codec, n, {m}::DOUBLE AS size FROM s" for c, m in _KNOWN_SIZES.items())
            each.append(f"(SELECT '{Ordering.parse(o)}' AS ordering, '{Transform.parse(t)}' AS transform, * FROM ({sizes} SELECT codec, count(*) AS blocks, 0::BIGINT AS failed, round(avg(size / (4 * n)), 6) AS cf_mean, round(var_pop(size / (4 * n)), 6) AS cf_var, round(avg(size / n), 6) AS bpi_mean FROM ({listed_sizes}) GROUP BY codec))")
    found["compression_means"] = " UNION ALL ".join(each)
    found["pipeline_reencode_whole"] = f"{_blocks_sql('R1', Ordering.MORTON)} {_transform_sql(Transform.VALUE_CLASSES)}"
    again = [(Access.THRESHOLD, Transform.THRESHOLD), (Access.SMOOTH_AND_SHIFT, Transform.SMOOTH_AND_SHIFT), (Access.SUM, Transform.NONE)]
    found["pipeline_repetitions"] = " UNION ALL ".join(
        f"(SELECT '{a}' AS access, blocks, {_REPS} AS reps, ({_REPS} * total)::BIGINT AS checksum, {_REPS} * blocks AS decode_n, {_REPS} * blocks AS transform_n, {_REPS if a.mutates else 0} * blocks AS encode_n"
        f" FROM (SELECT count(DISTINCT block_id) AS blocks, sum(v) AS total FROM ({_blocks_sql('R2', Ordering.MORTON)} {_transform_sql(t)})))"
        for a, t in again
    )
    wanted = [(p, f, i, a, one, two) for p, (initial, access_, one, two) in planner.PHASES.items() for f in ("a.tif", "b.tif") for i in initial for a in access_]
    study = f"WITH p(row, file, transform, dec, \"both\") AS (VALUES {_values(_STUDY)}), l AS (SELECT file, transform, {listed.format('dec')} AS dec, {listed.format('\"both\"')} AS both_ FROM p QUALIFY row_number() OVER (PARTITION BY file, transform ORDER BY row DESC) = 1)"
    found["planner_phases"] = f"""{study}, w(phase, file, initial, access, one, two) AS (VALUES {_values(wanted)}), j AS (
  SELECT w.*, CASE WHEN one = 'both' THEN i.both_ ELSE i.dec END AS first, a.both_ AS second FROM w JOIN l AS i ON i.file = w.file AND i.transform = w.initial LEFT JOIN l AS a ON a.file = w.file AND a.transform = w.access)
SELECT phase, file, initial, access, {joined.format('first')} AS first, CASE WHEN two IS NULL THEN 'FastPFor_JustCopy' ELSE {joined.format('second')} END AS second, unnest([500, 1000, 2000])::INT AS blocks, 10 AS reps, 256 AS size, 'morton' AS ordering, 'linear' AS pattern
FROM j WHERE len(first) > 0 AND (two IS NULL OR coalesce(len(second), 0) > 0)"""
    for name, kind in _WIDE_KINDS.items():
        found[f"t_{name}_256"] = _wide_sql(kind)
    for name, kind in _TRANSFORM_NAMES.items():
        for word, ordering in (("rowmajor", Ordering.ROW_MAJOR), ("morton", Ordering.MORTON), ("array", Ordering.MORTON)):
            found[f"{name}_{word}"] = f"{_blocks_sql('R1', ordering)} {_transform_sql(kind)}"
    for name, (kind, shifted) in _ACCESS_NAMES.items():
        found[name] = _accessed_sql(kind, shifted)
    for word, stride in _STRIDES.items():
        found[f"enc_delta_{word}"] = _delta_sql(stride)
        found[f"dec_delta_{word}_roundtrip"] = _roundtrip_sql("R2", Ordering.MORTON)
    for column in _MODELS:
        found[f"size_{column}"] = f"{_blocks_sql('R2', Ordering.MORTON)}, s AS ({_sizes_sql('b')}) SELECT block_id, {column} AS bytes FROM s"
    return found
