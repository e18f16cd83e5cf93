"""The pipeline on odd and on empty tables; what a fit gathers is bounded however often a row is repeated."""

from pyspark.sql import functions as F

from blockloom.llm import common


def test_the_pipeline_takes_odd_tables(spark, odd_docs, no_docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "a/labels.parquet"))
    odd_docs.write.parquet(str(tmp_path / "a/documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    ids = {r.doc_id for r in got}
    known = {r.doc_id for r in odd_docs.collect()}
    assert ids <= known and 403 in ids and all(r.length > 0 for r in got)
    assert len(ids & set(range(200, 220)) | ids & {300, 301}) < 22  # near copies go
    loads = {}
    for r in got:
        loads[r.sequence_id] = loads.get(r.sequence_id, 0) + r.length
    assert max(loads.values()) <= 4096


def test_labelled_rows_are_bounded(spark):
    docs = spark.range(0, 3000, 1, 6).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 500).alias("text"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, None)], "doc_id long, quality int")
    rows = common.labelled(docs, labels, 2)
    assert rows.count() == 500 and rows.select("quality").distinct().collect()[0][0] == 0
    assert common.first_of(rows.drop("text"), 2).count() == 2


def test_broadcast_only_what_is_small(spark):
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    few = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert hint(common.broadcast_if_small(few)) and not hint(common.broadcast_if_small(few, rows=9)) and not hint(common.broadcast_if_small(few, size=5000))
