"""Helpers shared by the corpus operators: word splitting on Arrow batches, hashing, lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a Python worker handles at once.
CHUNK_BYTES = 2 << 20
#: Rows that a Python worker is sent at once where small_batches() holds: whole texts lie in memory on both sides of the pipe.
BATCH_ROWS = 500

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POLY = 0x9E3779B97F4A7C15


#: A table of fewer bytes for each core is dealt to all cores: it may be one row group, which only one task can read.
SMALL_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, deal: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if deal and size < SMALL_BYTES * cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and sc.getCheckpointDir():
        folder = sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="blockloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of frames that are no longer held."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def few_rows(spark: SparkSession) -> str:
    """Sends BATCH_ROWS rows to Python at once, at most, in what the session runs from now on; gives the setting before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    return before


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """few_rows() for what is run inside; frames that are returned and run later have the session's setting."""
    before = few_rows(spark)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def broadcast_if_small(df: DataFrame, rows: int = 100_000, size: int = 8 << 20) -> DataFrame:
    """A checkpointed frame, to be broadcast if it has at most so many rows and bytes; else joins shuffle it."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(sum(wide, F.lit(16 * len(df.columns)))).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["bytes"] or 0) <= size else df


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; ``discard`` deletes the files."""
    path = f"{shared_folder(df.sparkSession)}/blockloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a frame that stored() gave; nothing that still reads them may run later."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("blockloom-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """doc_id, t (hash of the text), text and quality of documents with a label: those of at most ``limit`` ids, by their hashes.

    Of several labels of an id the least counts, null ones do not. Rows that agree in id and text are one row, so
    copies meet before and after the shuffle; ids with several texts can still give more rows than ``limit``.
    """
    marked = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    marked = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))  # at most ``limit`` rows of two numbers
    text = F.coalesce("text", F.lit(""))
    both = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t")).join(marked, "doc_id")
    return both.groupBy("doc_id", "t").agg(F.first("text").alias("text"), F.first("quality").alias("quality"))


def first_of(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` of the rows made from labelled(), the same in every run."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(limit)


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in ``column`` each; a longer row is a slice of its own."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of words of each text; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    lens = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    flat = lists.flatten()
    real = np.asarray(pc.binary_length(flat)) > 0
    owner = np.repeat(np.arange(len(lens)), lens)[real]
    return flat.filter(pa.array(real)), np.bincount(owner, minlength=len(lens)).astype(np.int64)


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    from xxhash import xxh3_64_intdigest

    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    each = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return each[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 over all others."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of ``k`` neighbouring values, runs over document ends included."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(_POLY) + h[i : i + n]
    return mix(out)


def window_starts(counts: np.ndarray, k: int) -> np.ndarray:
    """Positions in the flat word array at which a run of ``k`` words of one document starts."""
    n = int(counts.sum())
    if n < k:
        return np.empty(0, np.int64)
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(n)
    return at[at + k <= ends]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Flags for the ``n`` positions that a run of ``k`` from any start covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + k, n), -1)
    return np.cumsum(edge[:-1]) > 0


def group_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups of the given sizes."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
