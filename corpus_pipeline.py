"""From raw documents to packed training sequences: quality, line dedup, near-duplicates, mixing, packing.

A stage takes (spark, docs, sf_dir) and returns a frame; all but the last have the columns of ``documents``. The
result of each is written as Parquet before the next reads it, so a lost executor costs the work of one stage.
A stage's table is deleted when the next one's is written; that which the last stage reads stays.

Null texts count as empty ones, null ids are documents of their own that link with nothing, and a null source is
a source. Rows that repeat an id with other texts are judged each on its own; rows that repeat id and text are
copies, of which the n-gram join keeps one. Further columns of ``documents`` are left out by the first stage, so
names cannot clash. Empty tables give an empty result; without labels the classifier keeps all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import lines, mixing, ngram, packing, quality
from blockloom.llm.common import cut, discard, few_rows, release, small_batches, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below its threshold; it learns without the held-out fifth.

    As its result runs later, the session keeps sending few rows to Python at once; run() puts that back.
    """
    few_rows(spark)
    labels = table(spark, sf_dir, "labels", False).filter(~quality.held_out(F.col("doc_id")))
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def no_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts boilerplate lines out of the texts; documents of which nothing else is left go."""
    left = lines.remove_boilerplate(docs)
    left = left.filter((F.col("n_removed") == 0) | (F.trim(F.col("text"), F.lit(lines.BLANK)) != ""))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates: five words, 80 percent. Texts that share an id count each.

    The join's tables go before any text is shuffled: only the ids that go are kept. Texts are shuffled once.
    """
    node = ngram.node_of(docs)
    found = ngram.linked(docs.select(node.alias("doc_id"), "text"))
    gone = cut(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__node")).distinct())
    del found
    release(spark)
    own = docs.select(*COLUMNS, node.alias("__node"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__t"))
    # Rows that repeat an id and its text are copies, too, those without an id by their texts alone.
    kept = own.filter("__node is not null").dropDuplicates(["__node"]).join(gone, "__node", "left_anti")
    return kept.select(*COLUMNS).unionByName(own.filter("__node is null").dropDuplicates(["__t"]).select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    counted = mixing.mix_sources(docs.select(*COLUMNS)).filter(F.col("copies") > 0)
    return counted.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("line dedup", no_boilerplate),
    ("n-gram join", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for number, (_, stage) in enumerate(STAGES, 1):
            before, docs = docs, stage(spark, docs, sf_dir)
            if number < len(STAGES):
                docs = stored(docs)
                if number > 1:
                    discard(before)
    return docs
