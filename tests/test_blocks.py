"""Parameters, orderings, transforms, access, encodings, sources, pipelines, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.functions.expressions import bit_width, draw, unzigzag, varint_bytes, whole_bytes, wrap32, zigzag
from blockloom.functions.order import cell, position
from blockloom.functions.params import Access, Ordering, Pattern, Transform
from blockloom.operators import access, encode, tiling
from blockloom.operators.codecs import registry
from blockloom.operators.transform import array_transform, transform
from blockloom.plans import catalogue, pipeline, planner
from blockloom.sources import raster
from blockloom.streaming import blocks as stream

SMALL = [10, 1, 9, 3, 4, 5, 6, 7, 2, 8]


def cells(spark, *blocks):
    return spark.createDataFrame([(b, i, v) for b, values in enumerate(blocks) for i, v in enumerate(values)], "block_id long, pos int, v int")


def values(frame, column="v"):
    out = {}
    for r in frame.orderBy("block_id", "pos").collect():
        out.setdefault(r.block_id, []).append(r[column])
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize("kind", [Ordering, Transform, Pattern, Access])
def test_names_round_trip(kind):
    for member in kind:
        assert kind.parse(str(member)) is member
    assert kind.parse("") is kind.parse("default") is next(iter(kind))
    with pytest.raises(ValueError):
        kind.parse("invalid_xyz")


def test_what_changes_blocks():
    assert sum(a.mutates for a in Access) == 5 and not Access.XOR.mutates and Access.VALUE_SHIFT.transform is Transform.VALUE_SHIFT


def test_expressions(spark):
    rows = spark.createDataFrame([(0,), (1,), (-1,), (127,), (128,), (-(2**31),), (2**31,), (2**32 + 5,), (-(2**40) - 3,)], "x long")
    for r in rows.select("x", wrap32(F.col("x")).alias("w"), unzigzag(zigzag(F.col("x"))).alias("back")).collect():
        assert r.w == (r.x + 2**31) % 2**32 - 2**31 and r.back == r.x
    small = rows.filter("x between 0 and 4294967295").select("x", bit_width(F.col("x")).alias("w"), varint_bytes(F.col("x")).alias("v"), whole_bytes(F.col("x")).alias("b"))
    for r in small.collect():
        assert (r.w, r.v, r.b) == (r.x.bit_length(), max(1, -(-r.x.bit_length() // 7)), max(1, -(-r.x.bit_length() // 8)))
    drawn = spark.range(256).select(draw(F.lit(3), F.col("id"), F.lit(256)).alias("d")).distinct().count()
    assert drawn > 150


def test_orderings(spark):
    ids = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    for ordering in Ordering:
        placed = ids.withColumn("pos", position(F.col("x"), F.col("y"), 8, ordering))
        x, y = cell(F.col("pos"), 8, ordering)
        got = placed.select("x", "y", "pos", x.alias("x2"), y.alias("y2")).collect()
        assert sorted(r.pos for r in got) == list(range(64)) and all((r.x, r.y) == (r.x2, r.y2) for r in got)
    grid = spark.range(16).select((F.col("id") % 4).alias("x"), F.floor(F.col("id") / 4).alias("y"), "id")
    read = lambda o: [r.id for r in grid.orderBy(position(F.col("x"), F.col("y"), 4, o)).collect()]
    assert read(Ordering.ZIGZAG) == [0, 1, 2, 3, 7, 6, 5, 4, 8, 9, 10, 11, 15, 14, 13, 12]
    assert read(Ordering.MORTON) == [0, 1, 4, 5, 2, 3, 6, 7, 8, 9, 12, 13, 10, 11, 14, 15]
    with pytest.raises(ValueError):
        position(F.lit(0), F.lit(0), 6, Ordering.MORTON)


GOLDENS = {
    Transform.NONE: SMALL,
    Transform.THRESHOLD: [1, 0, 1, 0, 0, 1, 1, 1, 0, 1],
    Transform.SMOOTH_AND_SHIFT: [5, 6, 4, 5, 4, 5, 6, 5, 5, 5],
    Transform.INDEX_CLASSES: [0, 1, 2, 3, 4, 5, 6, 7, 7, 7],
    Transform.VALUE_CLASSES: [7, 0, 7, 2, 3, 4, 5, 6, 1, 7],
    Transform.VALUE_SHIFT: [v + 2**23 for v in SMALL],
}


@pytest.mark.parametrize("kind", list(Transform))
def test_transforms(spark, kind):
    frame = cells(spark, SMALL, [-7, 3, -2, -2, 5, 0], [4], [9, 9, 9])
    long = values(transform(frame, kind))
    assert long[0] == GOLDENS[kind]
    if kind is Transform.SMOOTH_AND_SHIFT:
        assert long[1] == [0, 0, 2, 2, 3, 4] and long[2] == [4]
    if kind is Transform.VALUE_CLASSES:
        assert long[1] == [0, 7, 5, 5, 7, 7] and long[3] == [0, 0, 0]
    rows = pipeline.as_arrays(frame)
    assert values(pipeline.as_cells(rows.withColumn("data", array_transform(F.col("data"), kind)))) == long


def test_access(spark):
    frame = cells(spark, SMALL, [2**31 - 1, 2**31 - 1, 5])
    read = lambda kind: [r.result for r in access.access(spark, frame, kind, 3).orderBy("block_id").collect()]
    assert read(Access.SUM) == [55, 2**32 + 3] and read(Access.SUM_SIMD) == read(Access.SUM_FUSED) == [55, 3] and read(Access.XOR) == [11, 5]
    assert len(read(Access.RANDOM_SUM)) == 2
    with pytest.raises(ValueError):
        access.access(spark, frame, Access.THRESHOLD, 3)
    order = access.visit_order(spark.range(50).withColumnRenamed("id", "block_id"), Pattern.RANDOM).orderBy("visit_key").collect()
    assert sorted(r.block_id for r in order) == list(range(50)) != [r.block_id for r in order]


@pytest.mark.parametrize("stride", list(encode.Stride))
def test_deltas(spark, stride):
    rng = np.random.default_rng(1)
    blocks = [rng.integers(-(2**31), 2**31, n).tolist() for n in (1, 4, 5, 7, 8, 15, 16, 17, 31, 32, 40, 48)]
    frame = cells(spark, SMALL, *blocks)
    coded = encode.delta(frame, stride)
    want = {"adjacent": [10, 17, 16, 11, 2, 2, 2, 2, 9, 12], "group4_last": [20, 17, 1, 13, 11, 2, 4, 6, 3, 12], "group8_pair": [20, 2, 18, 6, 8, 10, 12, 14, 9, 12], "group16_last": [20, 17, 16, 11, 2, 2, 2, 2, 9, 12]}
    assert values(coded, "enc")[0] == want[stride.value]
    assert values(encode.undelta(coded, stride)) == [SMALL, *blocks]


def test_reference_runs_and_sizes(spark):
    frame = cells(spark, SMALL, [-7, 3, -2, -2, 5, 0], [5] * 40)
    assert values(encode.frame_of_reference(frame), "enc")[0] == [1, 18, 0, 16, 4, 6, 8, 10, 12, 2, 14]
    assert values(encode.unframe(encode.frame_of_reference(frame))) == values(frame) == values(encode.unrun(encode.run_lengths(frame)))
    one, _, two = encode.run_length_sizes(frame).orderBy("block_id").collect()
    assert (one.clean, one.scalar, one.sse, one.avx2, one.avx512) == (20, 22, 26, 24, 22) and (two.runs, two.n) == (1, 40)
    first = encode.sizes(frame).orderBy("block_id").first()
    assert (first.bitpack, first.varint, first.streamvbyte) == (64, 10, 13)


def small_raster(spark, width=37, height=20):
    frame = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % 11 - 4).cast("int").alias("v"))
    return raster.Raster(frame, width, height)


def test_tiling_and_sampling(spark):
    whole = small_raster(spark)
    assert tiling.grid(spark, whole, 8).count() == 4 * 2
    got = tiling.blocks(whole, 8).groupBy("block_id").count().collect()
    assert sorted((r.block_id, r["count"]) for r in got) == [(i, 64) for i in range(8)]
    assert tiling.full_blocks(whole, 8).count() == 8
    offsets = lambda n, side=640, size=64: [(r.x_off, r.y_off) for r in tiling.sample(spark, raster.Raster(None, side, side), size, n).orderBy("sample_no").collect()]
    assert offsets(5) == [(0, 0), (0, 128), (0, 256), (0, 384), (0, 512)] and offsets(1, 160, 32) == [(0, 0)]
    assert [r.block_id for r in tiling.sample(spark, raster.Raster(None, 4, 1), 1, 6).orderBy("sample_no").collect()] == [0, 1, 2, 3, 0, 1]
    with pytest.raises(ValueError):
        tiling.sample(spark, whole, 8, 0)
    shifted = tiling.shift_nonnegative(tiling.blocks(whole, 8))
    assert shifted.agg(F.min("v")).first()[0] == 0 and tiling.profile(whole).first().n_unique == 11


def test_lossless_and_equal_reads(spark):
    frame = spark.createDataFrame([(0, 0, 1.0), (1, 0, -2.5)], "x int, y int, v double")
    assert not tiling.is_lossless(frame, F.col("v")).first().lossless and tiling.is_lossless(frame.filter("x = 0"), F.col("v")).first().lossless
    found = tiling.compare_reads(frame, frame.withColumn("v", F.col("v").cast("int"))).first()
    assert (found.equal, found.n, found.mismatches) == (False, 2, 1)


@pytest.mark.parametrize("deflate", [False, True])
def test_tiff_files(spark, tmp_path, deflate):
    rng = np.random.default_rng(3)
    grid = rng.integers(-500, 500, (50, 37)).astype(np.int16)
    data = raster.write_tiff(grid, deflate)
    assert np.array_equal(raster.read_tiff(data), grid)
    (tmp_path / "a.tif").write_bytes(data)
    got = raster.geotiff_cells(spark, str(tmp_path), 16).collect()
    assert len(got) == grid.size and all(grid[r.y, r.x] == r.value for r in got)
    floats = rng.random((9, 5)).astype(np.float32)
    assert np.array_equal(raster.read_tiff(raster.write_tiff(floats)), floats)
    with pytest.raises(ValueError):
        raster.read_tiff(b"nothing at all")


def test_packed_tiff_strips():
    assert raster._unpack_bits(bytes([2, 1, 2, 3, 254, 7, 128, 0, 9])) == bytes([1, 2, 3, 7, 7, 7, 9])
    codes = [256, 1, 2, 258, 257]  # clear, 1, 2, "1 2", end
    bits = "".join(f"{c:09b}" for c in codes)
    assert raster._unpack_lzw(int(bits.ljust(48, "0"), 2).to_bytes(6, "big")) == bytes([1, 2, 1, 2])


def test_png_images(spark, tmp_path):
    grid = np.arange(12, dtype=np.uint8).reshape(3, 4)
    (tmp_path / "a.tif").write_bytes(raster.write_tiff(grid))
    png = raster.png_images(spark, str(tmp_path)).first().png
    assert bytes(png[:8]) == b"\x89PNG\r\n\x1a\n" and bytes(png[16:24]) == bytes([0, 0, 0, 4, 0, 0, 0, 3])
    with pytest.raises(ValueError):
        raster.to_png(np.array([[-1]]))


def test_pipeline_and_errors(spark):
    whole = small_raster(spark)
    rows = pipeline.as_arrays(pipeline.prepared(whole, 8, tiling.sample(spark, whole, 8, 3), Ordering.MORTON, Transform.NONE))
    grid = pipeline.encode(rows, "Zstd_1")
    assert sorted((r.block_id, r.data) for r in pipeline.decode(grid).collect()) == sorted((r.block_id, r.data) for r in rows.collect())
    results, after = pipeline.run_access(spark, grid, Access.VALUE_SHIFT, "LZ4", Pattern.RANDOM)
    shifted = {r.block_id: [v - 2**23 for v in r.data] for r in pipeline.decode(after).collect()}
    assert shifted == {r.block_id: r.data for r in rows.collect()} and results.count() == 3
    plain, same = pipeline.run_access(spark, grid, Access.SUM, "LZ4")
    assert same is grid and sum(r.result for r in plain.collect()) == sum(sum(r.data) for r in rows.collect())
    means = pipeline.codec_means(pipeline.bench(rows, ["Zstd_1", "simdcomp"])).collect()
    assert all(r.blocks == 3 and not r.failed and 0 < r.cf_mean < 1 and r.bpi_mean == 4 * r.cf_mean for r in means)
    with pytest.raises(ValueError):
        pipeline.encode(rows, "no_such_codec")
    with pytest.raises(ValueError):
        pipeline.prepared(whole, 8, None, Ordering.MORTON, Transform.NONE, "median")


def test_sweeps(spark):
    whole = small_raster(spark)
    found = pipeline.compression_sweep(spark, whole, 8, 4, ["default", "morton"], ["none", "Threshold"], ["default"], ["simdcomp", "LZ4"]).collect()
    assert len(found) == 8 and all(r.failed == 0 for r in found)
    rows = pipeline.pipeline_sweep(spark, whole, 8, 4, [("zigzag", "none", "linearSum")], ["LZ4", "custom_direct_access"], ["Zstd_1"], ["linear", "random"]).collect()
    assert len(rows) == 4 and len({r.checksum for r in rows}) == 1


def test_planner(spark, tmp_path):
    (tmp_path / "p.csv").write_text("File,Transformation,Pareto Decompression,Pareto Compression\na.tif,none,'LZ4'  Zstd_1,LZ4\na.tif,none,DEFLATE,\nb.tif,none,,\n")
    got = planner.jobs(planner.read_pareto(spark, str(tmp_path / "p.csv")).coalesce(1), ["a.tif", "b.tif"], ["none"], ["Pareto Decompression", "Pareto Compression"]).collect()
    assert [(r.file, r.codecs) for r in got] == [("a.tif", "DEFLATE|FastPFor_JustCopy|custom_direct_access")]
    costs = spark.createDataFrame([("a", 1, 5), ("b", 2, 2), ("c", 2, 3), ("d", 5, 1), ("e", 1, 5)], "codec string, size int, time int")
    assert sorted(r.codec for r in planner.pareto_front(costs, "codec", ["size", "time"]).collect()) == ["a", "b", "d", "e"]


def test_front_of_all_parts_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, int(a), float(b)) for i, (a, b) in enumerate(zip(rng.integers(20, 60, 900), rng.integers(500, 990, 900)))]
    rows += [(900, 19, 700.5), (901, 70, 400.0), (902, 70, 400.9), (903, 71, 400.0)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").repartition(5).write.parquet(str(tmp_path / "part.parquet"))
    cost = [(k, a, int(b)) for k, a, b in rows]
    want = sorted(x for x in cost if not any(y[1] <= x[1] and y[2] <= x[2] and y[1:] != x[1:] for y in cost))
    got = catalogue.queries()["pareto_front"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == want and max(want)[0] == 902
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_every_cascade_of_the_pipeline_pool_has_a_row(spark):
    found = catalogue.queries()["cascade_roundtrip"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.codec for r in found) == sorted(c.name for c in registry.pool("pipeline") if c.name.startswith("[+]_")) and len(found) == 216
    assert all(r.blocks == r.ok > 0 for r in found)


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = pipeline.as_arrays(tiling.blocks(small_raster(spark), 8))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    arriving = stream.read_blocks(spark, str(tmp_path / "in"), rows.schema, files=1)
    query = stream.write_blocks(stream.encode_blocks(stream.transform_blocks(arriving, Transform.THRESHOLD), "STREAMVBYTE"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    got = {r.block_id: r.data for r in pipeline.decode(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {r.block_id: r.data for r in rows.withColumn("data", array_transform(F.col("data"), Transform.THRESHOLD)).collect()}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    spark.sql("select timestamp_seconds(id * 30) as ts, id as value from range(100)").coalesce(1).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("ts timestamp, value long").parquet(str(tmp_path / "in"))
    query = stream.windowed_stats(arriving, "ts", "value", "10 minutes", "1 minute").writeStream.outputMode("append").format("memory").queryName("closed").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = spark.table("closed").orderBy("least").collect()
    assert [(r.n, r.least, r.greatest) for r in got][:2] == [(20, 0, 19), (20, 20, 39)]


def test_array_transforms_are_linear(spark):
    import time

    def took(kind, n):
        rows = spark.range(4).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i * 7919 % 1009).cast("int")).alias("data"))
        began = time.perf_counter()
        rows.select(F.aggregate(array_transform(F.col("data"), kind), F.lit(0).cast("long"), lambda a, v: a + v)).collect()
        return time.perf_counter() - began

    for kind in (Transform.THRESHOLD, Transform.SMOOTH_AND_SHIFT, Transform.VALUE_CLASSES):
        took(kind, 1000)
        assert took(kind, 65_536) < 20


@pytest.mark.parametrize("kind", [a for a in Access if a.mutates])
def test_repetitions_change_blocks_as_the_expressions_do(spark, kind):
    rng = np.random.default_rng(5)
    arrays = [rng.integers(0, 500, n).tolist() for n in (2, 9, 64, 100)]
    rows = spark.createDataFrame([(i, len(a), a) for i, a in enumerate(arrays)], "block_id long, n int, data array<int>")
    for r in rows.select("data", array_transform(F.col("data"), kind.transform).alias("out")).collect():
        assert pipeline._changed(kind, np.array(r.data)).tolist() == r.out
    got = pipeline.repetitions(rows, "simdcomp", kind, "LZ4", 4).first()
    assert (got.blocks, got.reps, got.decode_n, got.transform_n, got.encode_n) == (4, 4, 16, 16, 16)
    assert got.decode_total > 0 and abs(got.decode_mean * 16 - got.decode_total) < 1 and got.decode_variance >= 0 and got.peak_mb > 1
    assert pipeline.repetitions(rows, "simdcomp", Access.SUM, "LZ4", 2).first().encode_n == 0


def test_phases_of_the_study(spark):
    runs = catalogue.queries()["planner_phases"](spark, "").collect()
    assert {r.phase for r in runs} == set(planner.PHASES) and {r.blocks for r in runs} == {500, 1000, 2000}
    first = [r for r in runs if r.phase == "transform" and r.blocks == 500]
    assert sorted((r.file, r.access, r.first, r.second) for r in first) == [
        ("a.tif", "threshold", "FastPFor_JustCopy|LZ4|custom_direct_access|simdcomp", "DEFLATE|FastPFor_JustCopy|custom_direct_access"),
        ("a.tif", "valueShift", "FastPFor_JustCopy|LZ4|custom_direct_access|simdcomp", "FastPFor_JustCopy|LZ4|LZMA|custom_direct_access"),
    ]
    assert all(r.second == "FastPFor_JustCopy" for r in runs if r.phase != "transform")
