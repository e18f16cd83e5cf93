"""What the n-gram join of the pipeline moves and keeps: texts and prefixes are shuffled once, its tables go before the texts move."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blockloom.llm import common, ngram


def below(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        return [plan.initialPlan()]
    found = plan.children()
    return [found.apply(i) for i in range(found.size())]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan()


def moves(plan, kind, number=1):
    """How often a row on its way through the plan is shuffled with so many columns of a type, at most."""
    own = plan.nodeName() == "Exchange" and plan.schema().simpleString().count(kind) >= number
    return own + max((moves(x, kind, number) for x in below(plan)), default=0)


def tables(plan):
    """Schemas of the checkpointed tables that a plan reads."""
    own = [plan.schema().simpleString()] if plan.nodeName().startswith("Scan ExistingRDD") else []
    return own + [t for x in below(plan) for t in tables(x)]


def rows_for(spark, odd_docs):
    docs = odd_docs.select(*corpus_pipeline.COLUMNS)
    more = [(None, "one two three", "en", "s1", 13), (None, "one two three", "en", "s1", 13), (None, "four", "en", "s1", 4), (403, "other words than before", "en", "s1", 23)]
    return docs, docs.unionByName(spark.createDataFrame(more, docs.schema))


def test_texts_are_shuffled_once_and_the_joins_tables_have_gone(spark, odd_docs, tmp_path):
    rows_for(spark, odd_docs)[0].write.parquet(str(tmp_path / "docs"))
    kept = plan_of(corpus_pipeline.one_of_each(spark, spark.read.parquet(str(tmp_path / "docs")), ""))
    assert moves(kept, ":string", 3) == 1
    assert tables(kept) == ["struct<__node:bigint>"]


def test_prefixes_are_shuffled_once_and_kept_of_heads_only(spark, odd_docs, monkeypatch):
    cuts, real = [], ngram.cut
    monkeypatch.setattr(ngram, "cut", lambda df: cuts.append(df) or real(df))
    out = ngram.linked(odd_docs.select("doc_id", "text"), 5, 80)
    heads = [x for x in cuts if "prefix" in x.columns][1]
    assert moves(plan_of(heads), "array<bigint>") == 1
    assert tables(plan_of(out)) and not any("array<bigint>" in t for t in tables(plan_of(out)))


def test_one_row_of_each_group_stays(spark, odd_docs):
    for docs in rows_for(spark, odd_docs):
        found = ngram.linked(docs.select(ngram.node_of(docs).alias("doc_id"), "text")).collect()
        named = {str(r.doc_id) for r in found if r.doc_id is not None and r.doc_id == r.component_id}
        unnamed = {r.text or "" for r in docs.filter("doc_id is null").collect()}
        kept = corpus_pipeline.one_of_each(spark, docs, "")
        got = kept.select(ngram.node_of(docs).alias("node"), *corpus_pipeline.COLUMNS).collect()
        assert sorted(str(r.node) for r in got if r.doc_id is not None) == sorted(named)
        assert sorted(r.text or "" for r in got if r.doc_id is None) == sorted(unnamed)
        whole = {tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()}
        assert {tuple(r)[1:] for r in got} <= whole


def test_few_rows_are_sent_at_once_and_the_setting_comes_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), "id").alias("text"))
    real = ngram.sets_of

    def sent(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    def watched(docs, k, percent):
        seen.append(docs.mapInArrow(sent, "n long").agg(F.max("n")).first()[0])
        return real(docs, k, percent)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(ngram, "sets_of", watched)
        assert ngram.linked(docs).count() == 3000
    assert seen == [common.BATCH_ROWS] and spark.conf.get(name) == before
